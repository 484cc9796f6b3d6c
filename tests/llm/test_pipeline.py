import hashlib
import random

from tokenizers import Tokenizer

import corpus_pipeline
from tenurekit.llm import quality, secrets
from tenurekit.llm.queries import vocabulary_path
from tenurekit.llm.tables import ORACLES, QUERIES
import test_decontaminate
import test_prefix_tree
import test_quality


def test_run_against_plain_stages(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["the", "re", "on"]) + rng.choice(["ti", "sh", "ou", "é"]) + rng.choice(["n", "m", ""]) + str(rng.randrange(40)) for _ in range(n))
    items = [(k, text(25)) for k in range(4)]
    docs = [(k, text(rng.randrange(5, 80))) for k in range(60)]
    docs += [(100 + k, t + " end") for k, t in docs[:15]] + [(200, "again and again " * 40), (201, None), (202, "")]
    docs += [(300 + k, text(30) + " " + items[k % 4][1] + " " + text(10)) for k in range(5)]
    docs += [(400, text(30) + " token = abcdefgh12 " + text(5))]
    rng.shuffle(docs)
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(i, t) for i, t in docs if test_quality.plain(t or "", quality.RULES)[2]]
    groups = {i: c for i, _, c in test_prefix_tree.plain(kept, 75, 5)}
    kept = [(i, t) for i, t in kept if groups[str(i)] == str(i)]
    kept = [(i, t) for i, t in kept if not test_decontaminate.plain(t, items, 10)[-1]]
    kept = [(i, secrets.mask(t, [(s, e) for s, e, _ in secrets.fixed_findings(t)], "[SECRET]")) for i, t in kept]
    library, want = Tokenizer.from_file(vocabulary_path()), {}
    for i, t in kept:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), ids, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert 0 < len(want) < len(docs) and 400 in want

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: (r.n_tokens, r.ids, r.decoded_sha256) for r in out.collect()} == want
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_one_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert ORACLES.keys() <= QUERIES.keys()

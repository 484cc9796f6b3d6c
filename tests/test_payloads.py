"""JSON payloads: leaves of any depth, equality whatever the order of keys, splits of decline reasons."""
import pytest
from pyspark.sql import functions as F

from tenurekit.operators import clean as C
from tenurekit.operators import evaluate as E
from tenurekit.operators import quality as Z


def leaves(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "event_id int, data string").withColumn("k", F.lit(1))
    return sorted((r.event_id, r.path, str(r.value), r.readable) for r in C.json_leaves(df, ["event_id"]).collect())


def test_leaves_of_any_depth_and_in_lists(spark):
    deep = '{"d":' * 12 + "5" + "}" * 12
    too_deep = '{"d":' * 5000 + "5" + "}" * 5000
    got = leaves(spark, '{"a": {"b": [{"c": 1}, {"c": 2.50}, [], [null]]}, "in_77": {"x": null, "y": true}, "z": {}}', deep, None, "no json", "{}", too_deep,
                 '"{\\"q\\": 1}"', "[1, [2, \"x\"]]", "null", '{"a": 1, "a": 2}', "")
    assert got == sorted([
        (0, "a.b[].c", "1", True), (0, "a.b[].c", "2.5", True), (0, "a.b[]", "[]", True), (0, "a.b[][]", "None", True), (0, "*.x", "None", True), (0, "*.y", "true", True), (0, "z", "{}", True),
        (1, ".".join("d" * 12), "5", True), (2, "", "None", True), (3, "", "no json", False), (4, "", "{}", True), (5, "", too_deep, False),
        (6, "", '{"q": 1}', True), (7, "[]", "1", True), (7, "[][]", "2", True), (7, "[][]", "x", True), (8, "", "None", True), (9, "", '{"a": 1, "a": 2}', False), (10, "", "", False)])


def test_leaves_need_no_shuffle_and_deep_texts_keep_theirs(spark):
    quoted = '{"a": "[{[{", "b\\\\": "\\"}}]", "c": [{"d": "\\\\"}]}'
    df = spark.createDataFrame([(0, quoted)], "event_id int, data string")
    found = C.json_leaves(df, ["event_id"])
    assert sorted((r.path, r.value) for r in found.collect()) == [("a", "[{[{"), ("b\\", '"}}]'), ("c[].d", "\\")]
    plan = found._jdf.queryExecution().toString()
    assert "UnionLoop" not in plan and "Exchange" not in plan
    both = leaves(spark, '{"d":' * 30 + "5" + "}" * 30, quoted, "[" * 13 + "7" + "]" * 13, "}{", "{" * 20)
    assert both == sorted([(0, ".".join("d" * 30), "5", True), (1, "a", "[{[{", True), (1, "b\\", '"}}]', True), (1, "c[].d", "\\", True), (2, "[]" * 13, "7", True),
                           (3, "", "}{", False), (4, "", "{" * 20, False)])


def test_exact_copies_by_hash(spark):
    got = C.dedup_exact(spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, None), (2, None), (3, "z")], "event_id int, data string"))
    assert sorted((r.event_id, str(r.data)) for r in got.collect()) == [(1, "x"), (1, "y"), (2, "None"), (3, "z")]
    plain = C.dedup_exact(spark.createDataFrame([(1, "x"), (2, "x")], "event_id int, data string"))
    assert plain.count() == 2 and "Aggregate" not in plain._jdf.queryExecution().toString()  # rows without a copy are not grouped


@pytest.mark.parametrize("a,b,same", [
    ('{"x":{"p":1,"q":[2,3]},"n":1}', '{"n":9,"x":{"q":[2,3],"p":1}}', True),  # order of keys, and the volatile key
    ('{"x":{"n":1}}', '{"x":{"n":2}}', False),  # the volatile key counts at the top only
    ('{"x":[2,3]}', '{"x":[3,2]}', False), ('{"x":1}', '{"x":1,"y":null}', False), ("broken {", "broken {", True), ("broken {", "{}", False)])
def test_equality_of_payloads(spark, a, b, same):
    df = spark.createDataFrame([(1, a), (1, b)], "event_id int, data string")
    r = C.same_payload(df, "n").collect()[0]
    assert (r.copies, r.benign) == (2, same)


def test_attribution_by_one_scan(spark):
    ts = "2024-01-{:02d} 00:00:00".format
    log = spark.createDataFrame([("a", ts(3), "FR", "s1", "c1"), ("a", ts(5), "DE", "s2", "c2"), ("a", ts(5), "AT", "s3", "c3"), ("a", ts(9), None, "s4", "c4"),
                                 ("b", ts(2), None, "s5", "c5"), ("b", ts(4), "IT", "s6", "c6"), ("n", ts(1), None, "s7", "c7")],
                                "email string, t string, country string, utm_source string, campaign_name string").withColumn("event_date", F.to_timestamp("t"))
    keys = spark.createDataFrame([(1, "a", ts(2)), (2, "a", ts(4)), (3, "a", ts(8)), (4, "b", ts(1)), (5, "n", ts(9)), (6, "zz", ts(9)), (7, None, ts(9)), (8, "a", None)],
                                 "key int, email string, t string").withColumn("install_date", F.to_timestamp("t"))
    got = {r.key: (r.country, r.utm_source, r.geo_status, r.geo_ambiguous) for r in C.resolve_attribution(keys, log).collect()}
    assert got == {1: ("FR", "s1", "resolved", True), 2: ("FR", "s1", "resolved", True), 3: ("AT", "s3", "resolved", True), 4: ("IT", "s6", "resolved", False),
                   5: (None, "s7", "unknown", False), 6: (None, None, "no_match", False), 7: (None, None, "no_match", False), 8: ("FR", "s1", "resolved", True)}


def test_class_split(spark):
    df = spark.createDataFrame([("x",)] * 3 + [("y",)] + [(None,)] * 5, "reason string")
    got = {(r.mapping, r["class"]): (r.n, r.share) for r in Z.class_split(df, "reason", {"m": {"x": "hard"}, "w": {"x": "soft", "y": "soft"}}).collect()}
    assert got == {("m", "hard"): (3, 0.75), ("m", "ambiguous"): (1, 0.25), ("w", "soft"): (4, 1.0)}


def test_folds_by_subtraction(spark):
    cells = spark.createDataFrame([("a", "u", 1, 5, 2), ("b", "u", 1, 7, 3), ("b", None, 2, 4, 1), ("c", "u", 1, 2, 2)], "app_id string, lever string, step_k int, n long, died long")
    folds = spark.createDataFrame([("a",), ("b",)], "app_id string")
    got = sorted(map(tuple, E.without_own(cells, folds, ["n", "died"]).collect()), key=str)
    assert got == sorted([("a", "u", 1, 9, 5), ("a", None, 2, 4, 1), ("b", "u", 1, 7, 4)], key=str)
    rates = spark.createDataFrame([("a", 1, 5, 10), ("b", 1, 8, 10), ("c", 1, 9, 10), ("c", 2, 1, 4), ("b", 3, 1, 2)], "app_id string, step_k int, surv long, n long")
    h = {(r.fold, r.step_k): (r.h, r.votes) for r in E.loo_hazard(rates, folds).collect()}
    assert h == {("a", 1): (pytest.approx(0.15), 2), ("b", 1): (pytest.approx(0.3), 2), ("a", 2): (pytest.approx(0.75), 1), ("b", 2): (pytest.approx(0.75), 1), ("a", 3): (pytest.approx(0.5), 1)}

"""Seeded samples and short picks. The size of the result is the feature here."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenurekit.functions.ordered import cut
from tenurekit.functions.ranks import percentiles


def bounded_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """At most n rows in a random but repeatable order of a hash."""
    return df.withColumn("_h", draw(seed, *keys)).orderBy("_h", *keys).limit(n).drop("_h")


def draw(seed: int, *keys: str) -> Column:
    """MD5 of the seed and the keys: a random order that other engines can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def stratified(keys: DataFrame, key: str, group: str, strata: Sequence[tuple[str, str, Column, int]], quota: int, seed: int = 0) -> DataFrame:
    """n keys per stratum, no key twice, then filled up to a quota per group.

    strata: (name, group value, condition, n). Only the first few candidates of each stratum by hash
    can ever be chosen, so the greedy choice runs on these."""
    k = keys.withColumn("_h", draw(seed, key))
    groups = sorted({g for _, g, _, _ in strata})
    depth = sum(n for *_, n in strata) + quota * len(groups)
    rules = [*strata, *[("fill", g, F.lit(True), quota) for g in groups]]
    cand = cut(reduce(lambda a, b: a.unionByName(b), [
        k.where((F.col(group) == g) & cond).orderBy("_h", key).limit(depth).select(key, group, "_h", F.lit(i).alias("_i"))
        for i, (_, g, cond, _) in enumerate(rules)]))
    picked = None
    for i, (name, g, _, n) in enumerate(rules):
        c = cand.where(F.col("_i") == i)
        if picked is not None:
            c = c.join(picked.select(key), key, "left_anti")
        if name == "fill":
            have = sum(m for _, gg, _, m in strata if gg == g)
            n = max(0, quota - have)
        got = c.orderBy("_h", key).limit(n).select(key, group, F.lit(name).alias("stratum"))
        picked = got if picked is None else picked.unionByName(got)
    return picked


def top_k(df: DataFrame, by: Column, k: int, tie: str) -> DataFrame:
    return df.orderBy(by.desc(), tie).limit(k)


def representatives(sizes: DataFrame, key: str, size: str, named: Sequence[str], n: int = 2) -> DataFrame:
    """The n largest, of the rest the n closest to the median size, and named ids; each once."""
    med = percentiles(sizes, size, [0.5]).select("q0").scalar()
    big = sizes.orderBy(F.desc(size), key).limit(n).select(key, F.lit(0).alias("_o"))
    mid = sizes.join(big, key, "left_anti").withColumn("_d", F.abs(F.col(size) - med)).orderBy("_d", key).limit(n).select(key, F.lit(1).alias("_o"))
    own = sizes.where(F.col(key).isin(*named)).select(key, F.lit(2).alias("_o"))
    why = F.when(F.min("_o") == 0, "largest").when(F.min("_o") == 1, "median").otherwise("named")
    return big.unionByName(mid).unionByName(own).groupBy(key).agg(why.alias("reason"))

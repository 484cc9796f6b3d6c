"""Ordered scans per key that survive a key holding a large share of all rows.

A window partitioned by key puts a whole key into one task. `Ordered` cuts the keys that hold more than
one of `slices` equal parts of the rows into slices by time and tie-break, so that a key, a day or an
instant with very many rows spans several tasks; all other keys are one slice, numbered 0. The window
runs per (key, slice), which is one shuffle of the rows; one summary row for each slice of a key that
was cut carries counts, sums and edge values forward, and is joined back. Null keys are keys like any
other, null times come first. Nothing runs before the result is used. The rows are persisted on disk,
so that all readers see the same ones; where a key is cut follows from the rows alone.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BLOCK, LEVELS = 32, 3  # rows of a block of an affine scan, levels of blocks
BINS, PICKS = 4096, 16  # bins of keys in the search for large ones, sampled rows in a slice of such a key
_LOCAL_DIR: str | None = None


def shared_dir(spark) -> str:
    """Folder for cut points: the one the cluster names, or a new local one on a local master."""
    global _LOCAL_DIR
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="tenurekit-")
    return _LOCAL_DIR


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write the rows as parquet and go on from the copy: later steps read only the columns they
    need, do not recompute the rows, and survive lost executors. The copy goes with the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write_once(df, path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Writes the rows; the shuffle files made for them go as soon as they are written, where Spark can do that."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(key, before)


def until_exit(spark, path: str) -> None:
    """Has the driver's file system delete a folder when it closes, at the end of the application."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


class Ordered:
    """Window columns over rows of one key in time order; ties are broken by `order`.

    `slices` is the number of parts of the rows of which a key may hold one uncut; left out, `default_slices` or the
    session's number of shuffle partitions. `stored` says that the rows are read from a written table, without a shuffle: they are
    then read again, each time the columns needed, and not kept on disk a second time."""

    default_slices: int | None = None

    def __init__(self, keys: Sequence[str], ts: str, order: Sequence[str] = (), *, slices: int | None = None, stored: bool = False):
        self.keys, self.order, self.slices, self.stored = list(keys), [ts, *order], slices or self.default_slices, stored

    def open(self, df: DataFrame) -> DataFrame:
        """The rows dealt into slices; several `add` calls on them share one partitioning."""
        rows = df if self.stored else df.persist(StorageLevel.DISK_ONLY)
        cuts = F.broadcast(self._cuts(rows).persist(StorageLevel.DISK_ONLY))
        at = F.struct(*[F.col(c) for c in self.order])
        before = F.size(F.filter("_at", lambda x: x <= at)) + 1
        dealt = rows.join(cuts, F.struct(*self.keys) == F.col("_of"), "left")
        # a struct is never null itself, and two structs are equal where their fields are null together
        return dealt.select(*df.columns, F.struct(*self.keys).alias("_key"), F.when(F.col("_at").isNull(), 0).otherwise(before).alias("_slice"))

    def _cuts(self, rows: DataFrame) -> DataFrame:
        """Of each key above its part of the rows (at most `slices` keys): `_of`, and in `_at` the first place of every slice but one.

        Keys are counted in bins first; of bins above the part, rows picked by a hash are collected, some PICKS for a slice."""
        slices = self.slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        at = F.struct(*[F.col(c) for c in self.order])
        bins = rows.groupBy(F.pmod(F.xxhash64(*self.keys), F.lit(BINS)).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        part = F.ceil(F.sum("_n") / slices)
        found = bins.agg(part.alias("part"), F.collect_list(F.struct("_b", "_n")).alias("all"))
        found = found.select(F.struct("part", F.greatest(F.lit(1), F.floor(F.col("part") / PICKS)).alias("every"), F.transform(
            F.filter("all", lambda x: x["_n"] > F.col("part")), lambda x: x["_b"]).alias("large")).alias("f")).scalar()
        picked = rows.select(F.struct(*self.keys).alias("_of"), at.alias("_p"), F.xxhash64(*self.keys).alias("_h"), found.alias("_f")).where(
            F.array_contains("_f.large", F.pmod("_h", F.lit(BINS))))
        picked = picked.where(F.pmod(F.xxhash64("_p"), F.col("_f.every")) == 0)
        each = picked.groupBy("_of").agg(F.sort_array(F.collect_list("_p")).alias("_s"), F.first(F.floor(F.col("_f.part") / F.col("_f.every"))).alias("_m"))
        first = F.filter("_s", lambda x, i: (i > 0) & (i % F.col("_m") == 0))
        return each.where(F.size("_s") > F.col("_m")).select("_of", first.alias("_at"))

    def close(self, df: DataFrame) -> DataFrame:
        return df.drop("_key", "_slice")

    def add(self, df: DataFrame, *, prev: dict[str, Column] | None = None,
            next: dict[str, Column] | None = None, last_before: dict[str, Column] | None = None,
            running_sum: dict[str, Column] | None = None,
            running_min: dict[str, Column] | None = None, row_no: str | None = None) -> DataFrame:
        """Add columns. prev/next: neighbouring row's value. last_before: latest non-null value of
        earlier rows. running_*: over rows up to and including this one."""
        prev, next, last_before = prev or {}, next or {}, last_before or {}
        running_sum, running_min = dict(running_sum or {}), running_min or {}
        if row_no:
            running_sum[row_no] = F.lit(1).cast("bigint")
        src = {}
        for group in (prev, next, last_before, running_sum, running_min):
            src |= {f"_v_{n}": c for n, c in group.items()}
        opened = "_slice" in df.columns
        rows = df.withColumns(src) if opened else self.open(df.withColumns(src))
        part = ["_key", "_slice"]
        order = F.struct(*[F.col(c) for c in self.order])

        def v(n):
            return F.col(f"_v_{n}")

        # one summary row per slice of a key that was cut
        edge = [F.lit(1).alias("_one")]
        edge += [F.max_by(F.struct(v(n).alias("x")), order).alias(f"_e_{n}") for n in prev]
        edge += [F.min_by(F.struct(v(n).alias("x")), order).alias(f"_e_{n}") for n in next]
        edge += [F.max_by(v(n), F.when(v(n).isNotNull(), order)).alias(f"_e_{n}") for n in last_before]
        edge += [F.sum(v(n)).alias(f"_e_{n}") for n in running_sum]
        edge += [F.min(v(n)).alias(f"_e_{n}") for n in running_min]
        by_slice = Window.partitionBy("_key").orderBy("_slice")
        earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
        carried = {}
        carried |= {f"_c_{n}": F.lag(f"_e_{n}").over(by_slice) for n in prev}
        carried |= {f"_c_{n}": F.lead(f"_e_{n}").over(by_slice) for n in next}
        carried |= {f"_c_{n}": F.last(f"_e_{n}", ignorenulls=True).over(earlier) for n in last_before}
        carried |= {f"_c_{n}": F.sum(f"_e_{n}").over(earlier) for n in running_sum}
        carried |= {f"_c_{n}": F.min(f"_e_{n}").over(earlier) for n in running_min}
        edges = rows.where("_slice > 0").groupBy(*part).agg(*edge[1:] or edge).withColumns(carried).select(*part, *carried)
        edges = edges.persist(StorageLevel.DISK_ONLY)  # small, and the plan does not hold the rows' plan twice

        w = Window.partitionBy(*part).orderBy(*self.order)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        local = {}
        local |= {f"_l_{n}": F.lag(F.struct(v(n).alias("x"))).over(w) for n in prev}
        local |= {f"_l_{n}": F.lead(F.struct(v(n).alias("x"))).over(w) for n in next}
        local |= {f"_l_{n}": F.last(v(n), ignorenulls=True).over(before) for n in last_before}
        local |= {f"_l_{n}": F.sum(v(n)).over(upto) for n in running_sum}
        local |= {f"_l_{n}": F.min(v(n)).over(upto) for n in running_min}
        # at most two or so for each of `slices`, which bounds the broadcast
        out = rows.withColumns(local).join(F.broadcast(edges), part, "left")

        def both(n):
            return F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}"))

        final = {}
        final |= {n: both(n)["x"] for n in (*prev, *next)}
        final |= {n: both(n) for n in last_before}
        final |= {n: F.when(F.col(f"_l_{n}").isNull(), F.col(f"_c_{n}")).otherwise(
            F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0))) for n in running_sum}
        final |= {n: F.least(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in running_min}
        kept = [c for c in df.columns if c not in final]
        return out.withColumns(final).select(*kept, *final)

    def add_affine(self, df: DataFrame, name: str, factor: Column, term: Column, before: str | None = None) -> DataFrame:
        """Add the state x that every row changes to factor * x + term, from 0 at the first row; in `before` the state a row finds.

        A row is the pair (factor, term), and pairs compose. Rows of a slice stand in blocks of BLOCK rows, which one pass over an array
        composes; blocks stand in blocks of BLOCK blocks, and so on for LEVELS levels, so no array is longer than a block (on the top
        level: a slice's rows by BLOCK ** (LEVELS + 1)). The pairs of earlier slices of a key give the state a slice begins with. Nothing
        is divided, so long runs keep their digits."""
        opened = "_slice" in df.columns
        src = {"_f": factor.cast("double"), "_t": term.cast("double")}
        rows = df.withColumns(src) if opened else self.open(df.withColumns(src))
        part = ["_key", "_slice"]
        n = F.row_number().over(Window.partitionBy(*part).orderBy(*self.order)) - 1
        own = [c for c in df.columns if c not in part]
        rows = rows.select(*part, n.alias("_n"), "_f", "_t", F.struct(*own).alias("_row"))
        blocks = rows.groupBy(*part, (F.col("_n") / BLOCK).cast("bigint").alias("_b")).agg(F.sort_array(F.collect_list(F.struct("_n", "_f", "_t", "_row"))).alias("_a"))
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("x"), F.array().cast("array<struct<p:double,x:double>>").alias("found"))
        run = F.aggregate("_a", start, lambda s, e: F.struct(
            (e["_f"] * s["p"]).alias("p"), (e["_f"] * s["x"] + e["_t"]).alias("x"), F.concat(s["found"], F.array(_pair(s["p"], s["x"]))).alias("found")))
        blocks = blocks.withColumn("_run", run).withColumn("_own", _pair(F.col("_run.p"), F.col("_run.x")))
        blocks = blocks.withColumn("_in", _pair(F.lit(1.0), F.lit(0.0))).withColumn("_full", F.col("_own"))
        size = 1
        for level in range(LEVELS + 1):
            size *= BLOCK
            outer = [(F.col("_b") / size).cast("bigint")] if level < LEVELS else []
            w = Window.partitionBy(*part, *outer).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
            # what the full blocks before this one's did, then what came before the block inside its own
            blocks = blocks.withColumn("_in", _composed(F.concat(F.collect_list("_full").over(w), F.array("_in"))))
            blocks = blocks.withColumn("_full", F.when(F.col("_b") % size == size - 1, _composed(F.array("_in", "_own"))))
        ends = blocks.groupBy(*part).agg(F.max_by(F.struct("_in", "_own"), "_b").alias("e")).select(*part, _composed(F.array("e._in", "e._own")).alias("e"))
        # a key has at most as many pairs as there are partitions
        pairs = ends.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_slice", "e"))).alias("s"))
        begin = F.transform("s", lambda at, i: F.struct(
            at["_slice"].alias("_slice"), _composed(F.transform(F.slice("s", F.lit(1), i), lambda y: y["e"]))["x"].alias("_begin")))
        begins = pairs.select("_key", F.explode(begin).alias("b")).select("_key", "b.*")
        out = blocks.join(begins, part).select(*part, (F.col("_in.x") + F.col("_in.p") * F.col("_begin")).alias("_x"), F.inline(F.arrays_zip("_a", F.col("_run.found").alias("found"))))
        found = F.col("found.x") + F.col("found.p") * F.col("_x")
        state = {name: F.col("_a._f") * found + F.col("_a._t")} | ({before: found} if before else {})
        return out.withColumns(state).select(*[F.col(c) if c in part else F.col(f"_a._row.{c}") for c in df.columns if c not in state], *state)


def _pair(p: Column, x: Column) -> Column:
    return F.struct(p.alias("p"), x.alias("x"))


def _then(first: Column, second: Column) -> Column:
    """The pair of two changes, one after the other."""
    return _pair(second["p"] * first["p"], second["p"] * first["x"] + second["x"])


def _composed(pairs: Column) -> Column:
    return F.aggregate(pairs, _pair(F.lit(1.0), F.lit(0.0)), _then)

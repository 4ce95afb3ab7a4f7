"""Ordered positions: near-duplicate suppression, islands, proximity joins, sliding maxima, overlaps of position lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spaced(rows: DataFrame, by: list[str], pos: str, gap: int) -> DataFrame:
    """Rows more than ``gap`` behind the row before them, whether that one is kept or not, and the first of each group."""
    last = F.lag(pos).over(Window.partitionBy(*by).orderBy(pos))
    return rows.withColumn("_last", last).where(F.col("_last").isNull() | (F.col(pos) - F.col("_last") > gap)).drop("_last")


def islands(rows: DataFrame, by: list[str], pos: str, gap: int) -> DataFrame:
    """rows with ``island``: numbered from 0 in each group; a row within ``gap`` of the one before belongs to its island."""
    w = Window.partitionBy(*by).orderBy(pos)
    new = F.when(F.col(pos) - F.lag(pos).over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("island", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("_new")


def merged(rows: DataFrame, by: list[str], pos: str, width: int, least: int = 2) -> DataFrame:
    """(by, first, last, n) of islands with ``least`` positions or more that follow each other within a width."""
    found = islands(rows, by, pos, width).groupBy(*by, "island").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least).drop("island")


def best_of_islands(rows: DataFrame, by: list[str], pos: str, score: str, gap: int) -> DataFrame:
    """The best row of each island, the earliest of equal ones: (by, pos, score)."""
    best = F.max_by(F.struct(pos, score), F.struct(score, -F.col(pos)))
    return islands(rows, by, pos, gap).groupBy(*by, "island").agg(best.alias("b")).select(*by, f"b.{pos}", f"b.{score}")


def competition(rows: DataFrame, by: list[str], pos: str, score: str, gap: int, withdrawn: float = 0.8) -> DataFrame:
    """(by, n, total): sites in order, where of two that lie within ``gap`` the better one counts, exp(score) each. A site that
    has to go takes back ``withdrawn`` of what it counted. by is a sequence's key, so a list is one sequence's sites."""
    sites = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).cast("long").alias("p"), F.col(score).alias("s")))).alias("_l"))
    start = F.struct(F.lit(None).cast("long").alias("p"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("t"))

    def add(acc, x):
        apart = acc["p"].isNull() | (x["p"] - acc["p"] > gap)
        new = F.struct(x["p"].alias("p"), x["s"].alias("s"), (acc["n"] + 1).alias("n"), (acc["t"] + F.exp(x["s"])).alias("t"))
        instead = F.struct(x["p"].alias("p"), x["s"].alias("s"), acc["n"].alias("n"), (acc["t"] - withdrawn * F.exp(acc["s"]) + F.exp(x["s"])).alias("t"))
        return F.when(apart, new).when(x["s"] > acc["s"], instead).otherwise(acc)

    return sites.select(*by, F.aggregate("_l", start, add).alias("_a")).select(*by, F.col("_a.n").alias("n"), F.col("_a.t").alias("total"))


def near(left: DataFrame, right: DataFrame, by: str, pos: str, within: int) -> DataFrame:
    """(by, a, b): all pairs of positions of the same group at most ``within`` apart, as an equality join on cells of that width.

    Each left row meets the three cells around it, so pairs cost what they are, not the product of the groups.
    """
    cell = lambda c: F.floor(c / max(1, within))
    a = left.select(by, F.col(pos).alias("a")).withColumn("cell", F.explode(F.array(*(cell(F.col("a")) + d for d in (-1, 0, 1)))))
    b = right.select(by, F.col(pos).alias("b")).withColumn("cell", cell(F.col("b")))
    return a.join(b, [by, "cell"]).where(F.abs(F.col("a") - F.col("b")) <= within).select(by, "a", "b")


def greedy_pairs(left: list, right: list, within: int, compat: bool = False) -> list[tuple]:
    """One-to-one pairs of two sorted lists: whenever the heads are within reach they pair, else the lesser one is passed.

    compat: stops when either list is on its last element, as older programs do, after looking at the heads that it is on.
    """
    i = j = 0
    out = []
    while i < len(left) and j < len(right):
        if abs(left[i] - right[j]) <= within:
            out.append((left[i], right[j]))
            i, j = i + 1, j + 1
        elif left[i] < right[j]:
            i += 1
        else:
            j += 1
        if compat and (i >= len(left) - 1 or j >= len(right) - 1):
            break
    return out


def greedy(left: DataFrame, right: DataFrame, by: str, pos: str, within: int, compat: bool = False) -> DataFrame:
    """(by, a, b) of the greedy one-to-one pairing in each group; a group's two sorted lists are one row."""
    lists = lambda side, name: side.groupBy(by).agg(F.sort_array(F.collect_list(F.col(pos).cast("long"))).alias(name))

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def pair(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[{"a": int(i), "b": int(j)} for i, j in greedy_pairs(list(p), list(q), within, compat)] for p, q in zip(x, y, strict=True)], dtype=object)

    both = lists(left, "_x").join(lists(right, "_y"), by)
    return both.select(by, F.explode(pair("_x", "_y")).alias("_p")).select(by, "_p.a", "_p.b")


def sliding_max(rows: DataFrame, by: list[str], pos: str, score: str, reach: int) -> Column:
    """The greatest score from ``reach`` before a position to one less than ``reach`` behind it."""
    return F.max(score).over(Window.partitionBy(*by).orderBy(pos).rangeBetween(-reach, reach - 1))


def coverage(rows: DataFrame, by: str, seq: str) -> DataFrame:
    return rows.groupBy(by).agg(F.countDistinct(seq).alias("n_seqs"))


def adjacent(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """(seq_id, pos): positions of left that have one of right exactly ``distance`` behind: an equality join on the sum."""
    return left.select("seq_id", "pos").join(right.select("seq_id", (F.col("pos") - distance).alias("pos")), ["seq_id", "pos"], "left_semi")


def overlap_ratio(hits: DataFrame, within: int) -> DataFrame:
    """(m1, m2, n_near, ratio) of each pair of motifs: greedy pairs over the smaller list's length and one.

    hits: (motif, seq_id, pos). Lists meet by sequence, so a task holds one sequence's hits of two motifs.
    """
    sizes = hits.groupBy("motif").agg(F.count("*").alias("n"))
    lists = hits.groupBy("motif", "seq_id").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    pairs = lists.alias("x").join(lists.alias("y"), (F.col("x.seq_id") == F.col("y.seq_id")) & (F.col("x.motif") < F.col("y.motif")))

    @F.pandas_udf("long")
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(greedy_pairs(list(x), list(y), within)) for x, y in zip(a, b, strict=True)], dtype="int64")

    met = pairs.select(F.col("x.motif").alias("m1"), F.col("y.motif").alias("m2"), count("x.p", "y.p").alias("k")).groupBy("m1", "m2").agg(F.sum("k").alias("n_near"))
    s1, s2 = sizes.select(F.col("motif").alias("m1"), F.col("n").alias("n1")), sizes.select(F.col("motif").alias("m2"), F.col("n").alias("n2"))
    every = s1.join(F.broadcast(s2), F.col("m1") < F.col("m2")).join(met, ["m1", "m2"], "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    return every.select("m1", "m2", "n_near", (F.col("n_near") / (F.least("n1", "n2") + 1)).alias("ratio"))

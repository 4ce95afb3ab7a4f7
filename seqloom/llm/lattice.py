"""Embedding near-dedup with lattice hashing.

In each of ``TABLES`` tables a normalised vector is projected to two times 8 dimensions and decoded to the nearest points of
the E8 lattice; the pair of points is its cell. Its neighbouring cells are those with one of the ``PROBES`` nearest neighbours
of either point in its stead. Two vectors are compared where one's own cell is among the other's cells, and are linked if
their cosine, in double precision, is at least the threshold. The settings find 98.5 % of random pairs at a cosine of exactly
0.95, nearly all above; a random pair of vectors meets in about one of 10**5 tables. Every vector is indexed and nothing is capped.

Equal vectors are one class with a count, and count as links of each other, so that copies cost nothing. Cells of at most
``LIGHT`` classes make pairs; larger cells are cut into blocks of about ``BLOCK`` classes, each pair of blocks is one matrix
product, and only counts and spanning edges leave it. A link that several cells hold is counted once: in the large cell with
the least key, or else as a distinct pair.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
lengths or rows with a null vec_id. Repeated rows count as vectors of their own. An empty table gives an empty result. Only
vec_id and embedding are looked at, whatever other columns there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import e8
from .components import components
from .flattext import mix
from .tables import table, written

THRESHOLD = 0.95
TABLES, PARTS, PROBES, SCALE = 6, 2, 2, 0.6
LIGHT, BLOCK = 32, 1024
SEED = 17

_projections: dict[tuple[int, int, int], np.ndarray] = {}


def _projection(dim: int, t: int, part: int) -> np.ndarray:
    if (dim, t, part) not in _projections:
        _projections[dim, t, part] = np.random.default_rng([SEED, dim, t, part]).normal(size=(dim, 8)) * SCALE
    return _projections[dim, t, part]


def keys(vectors: np.ndarray) -> np.ndarray:
    """[rows, TABLES, (1 + PROBES) ** PARTS] cell keys of normalised vectors; the first of each table is the own cell."""
    n, dim = vectors.shape
    spin = (np.arange(8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    out = []
    for t in range(TABLES):
        key = np.full((n, 1), dim * 64 + t, dtype=np.uint64)
        for part in range(PARTS):
            points = e8.cells(vectors @ _projection(dim, t, part), PROBES).astype(np.uint64)
            cell = np.zeros(points.shape[:2], dtype=np.uint64)
            for k in range(8):
                cell = mix(cell * np.uint64(31) + points[..., k] * spin[k] + np.uint64(k + 1))
            key = mix(key[:, :, None] * np.uint64(0xD6E8FEB86659FD93) + cell[:, None, :]).reshape(n, -1)
        out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def normalised(column: pa.Array) -> np.ndarray:
    """Rows of equal length, as doubles of length one."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    top = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / np.where(top > 0, top, 1.0)  # lest squares overflow or vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def usable(embedding: str) -> str:
    return f"vec_id IS NOT NULL AND {embedding} IS NOT NULL AND forall({embedding}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists({embedding}, x -> x <> 0)"


def _indexed(classes: DataFrame) -> DataFrame:
    """(key, cid, home) of every class in all its cells."""

    def made(batches):
        for batch in batches:
            sizes = batch.column("embedding").value_lengths().to_numpy()
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                for low in range(0, len(at), 2048):
                    part = batch.take(pa.array(at[low : low + 2048]))
                    found = keys(normalised(part.column("embedding")))
                    home = np.zeros(found.shape, dtype=bool)
                    home[:, :, 0] = True
                    cid = np.repeat(part.column("cid").to_numpy(), found[0].size)
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(cid), pa.array(home.ravel())], ["key", "cid", "home"])

    return classes.select("cid", "embedding").mapInArrow(made, "key long, cid long, home boolean")


def _close(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, na, nb, x, y) whose vectors x and y are close, as (a, b, na, nb)."""

    def checked(batches):
        for batch in batches:
            same = batch.column("x").value_lengths().to_numpy()
            keep = np.zeros(len(batch), dtype=bool)
            for dim in np.unique(same):
                at = np.flatnonzero(same == dim)
                part = batch.take(pa.array(at))
                keep[at] = (normalised(part.column("x")) * normalised(part.column("y"))).sum(axis=1) >= threshold
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep))

    return pairs.where("size(x) = size(y)").mapInArrow(checked, "a long, b long, na long, nb long")


def _block_links(threshold: float):
    def linked(group: pd.DataFrame) -> pd.DataFrame:
        key, i, j = group["key"].iloc[0], group["i"].iloc[0], group["j"].iloc[0]
        rows = pa.array(group["embedding"])
        x = normalised(rows)
        a = np.flatnonzero(group["block"].to_numpy() == i)
        b = np.flatnonzero(group["block"].to_numpy() == j)
        home = group["home"].to_numpy()
        near = (x[a] @ x[b].T >= threshold) & (home[a][:, None] | home[b][None, :])
        if i == j:
            near &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
        # links that a large cell with a lesser key holds too are counted there
        lists, homes = group["cells"].to_list(), group["homes"].to_list()
        size = np.array([len(c) for c in lists])
        owner, cell = np.repeat(np.arange(len(group)), size), np.concatenate(lists)
        own = np.concatenate(homes).astype(bool)
        less = cell < key
        for k in np.unique(cell[less]):
            here = np.zeros(len(group), dtype=np.int8)
            at = cell == k
            here[owner[at]] = 1 + own[at]
            ia, ib = np.flatnonzero(here[a]), np.flatnonzero(here[b])
            if len(ia) and len(ib):
                near[np.ix_(ia, ib)] &= (here[a][ia][:, None] < 2) & (here[b][ib][None, :] < 2)
        n, cid = group["n"].to_numpy(), group["cid"].to_numpy()
        links, least = np.zeros(len(group), dtype=np.int64), np.arange(len(group))
        links[a] += near @ n[b]
        links[b] += near.T @ n[a]
        near_a, near_b = np.nonzero(near)
        near_a, near_b = a[near_a], b[near_b]
        while len(near_a):  # spanning edges within the block: least label over the links, until it is the same at both ends
            before = least.copy()
            np.minimum.at(least, near_a, least[near_b])
            np.minimum.at(least, near_b, least[near_a])
            least = least[least]
            if (before == least).all():
                break
        touched = np.flatnonzero(links > 0)
        return pd.DataFrame({"cid": cid[touched], "links": links[touched], "other": cid[least[touched]]})

    return linked


def links(classes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(cid, links) summed over the classes' other members, and edges (a, b), of classes (cid, n, embedding)."""
    index = written(_indexed(classes), "cells")
    cells = written(index.groupBy("key").agg(F.count("*").alias("size"), F.max("home").alias("met")).where("size > 1 AND met").select("key", "size"), "shared-cells")
    heavy = index.join(cells.where(F.col("size") > LIGHT), "key")
    of = heavy.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("key", "home"))).alias("l"))
    of = written(of.select("cid", F.col("l.key").alias("cells"), F.col("l.home").alias("homes")), "large-cells")

    light = index.join(cells.where(F.col("size") <= LIGHT).select("key"), "key")
    pairs = light.select("key", F.col("cid").alias("a"), F.col("home").alias("ha")).join(light.select("key", F.col("cid").alias("b"), F.col("home").alias("hb")), "key").where("a < b AND (ha OR hb)").select("a", "b").distinct()
    side = lambda c: of.select(F.col("cid").alias(c), F.col("cells").alias(f"cells_{c}"), F.expr("filter(cells, (x, i) -> homes[i])").alias(f"homes_{c}"))
    pairs = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where("NOT coalesce(arrays_overlap(homes_a, cells_b) OR arrays_overlap(cells_a, homes_b), false)").select("a", "b")
    pairs = pairs.join(classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("embedding").alias("x")), "a").join(classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("embedding").alias("y")), "b")
    close = written(_close(pairs.select("a", "b", "na", "nb", "x", "y"), threshold), "close-pairs")

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = heavy.withColumn("blocks", blocks).withColumn("block", F.expr("cast(pmod(xxhash64(cid, key), blocks) as int)"))
    dealt = dealt.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("key", "cid", "home", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    dealt = dealt.join(of, "cid").join(classes, "cid")
    many = written(dealt.groupBy("key", "i", "j").applyInPandas(_block_links(threshold), "cid long, links long, other long"), "block-links")

    counts = close.select(F.col("a").alias("cid"), F.col("nb").alias("links")).union(close.select(F.col("b").alias("cid"), F.col("na").alias("links"))).union(many.select("cid", "links"))
    return counts.groupBy("cid").agg(F.sum("links").alias("links")), close.select("a", "b").union(many.select(F.col("cid").alias("a"), F.col("other").alias("b")).distinct())


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    # equal vectors share a class, known by 128 bits, so that vectors themselves are shuffled once
    usable_rows = embeddings.where(usable("embedding")).select("vec_id", "embedding", F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(SEED), "embedding").alias("g"))
    classes = usable_rows.groupBy("h", "g", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("rep"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    counts, edges = links(classes.select("cid", "n", "embedding"), threshold)
    named = classes.select("cid", "h", "g", "n", "rep").join(components(edges).withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    result = named.join(ids, "component").join(counts, "cid", "left").select("h", "g", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), "component_id")
    linked = usable_rows.select("vec_id", "h", "g").join(result, ["h", "g"]).select("vec_id", "n_links", "component_id")
    alone = embeddings.where(f"NOT coalesce({usable('embedding')}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def sql_of() -> str:
    """The same by the cosine of every two vectors."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT vec_id AS root, vec_id AS node FROM v UNION SELECT root, b FROM reach JOIN links ON a = node),
least AS (SELECT root, min(node) AS component FROM reach GROUP BY root), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(vec_id = coalesce(component, vec_id), false) AS kept
FROM embeddings LEFT JOIN least ON root = vec_id LEFT JOIN counts ON a = vec_id"""

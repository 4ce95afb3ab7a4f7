"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

Words are runs of letters, digits and non-ASCII characters, lower-cased. A fixed mask over consecutive words keeps some
positions and ignores the others; the hash of the kept words is a seed. Seeds of the documents and of the benchmark items
are joined, and around each hit the item is laid over the document on the hit's diagonal: a document contains an item's
passage if, in some window of ``WINDOW`` aligned words (of the whole item, if that is shorter), at least ``SHARE`` of the
words are equal. So words that were replaced don't hide a passage, wherever the masks' ignored positions meet them.

The masks lose nothing: whichever words of a window that counts differ, one of its masks meets equal words somewhere in it
(the tests go through all cases). Which masks do so depends on the number of words; an item is indexed under those of its
size, and the texts under the masks of the sizes that the benchmark has. Items of up to 4 words are found whole only.

Words are compared by a 64-bit hash. The first pass only makes (document, item, diagonal) rows, the second splits the texts of
the documents that have some, once each, and lays the items over the words. The benchmark's seeds, and then the places found,
are broadcast if their counted size is within ``BROADCAST_BYTES``; else those joins are dealt by hash.

Null and empty texts contain nothing, and items without a word aren't contained in any. Texts are read whole, however long.
Repeated rows of a document are one result, and so are all texts of one doc_id; a null doc_id is a document of its own. An
empty table gives an empty result. Of the tables, only doc_id and text, and item_id and text, are looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import BROADCAST_BYTES, fitting, free_name, table, written

#: Masks by the least number of words of the items that they serve.
MASKS = {13: ("110111", "111101"), 5: ("1101", "1011"), 4: ("1111",), 3: ("111",), 2: ("11",), 1: ("1",)}
WINDOW = 20
SHARE = 0.8

_SPLIT = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def masks_of(words: int) -> tuple[str, ...]:
    """The masks that an item of so many words is indexed under."""
    return MASKS[max(n for n in MASKS if n <= words)]


def _sized(words: str) -> str:
    """The class of an item by its number of words: the key of its masks."""
    return "CASE " + " ".join(f"WHEN size({words}) >= {n} THEN {n}" for n in sorted(MASKS, reverse=True)) + " END"


def _seeds(masks: list[str]) -> str:
    """The seeds of place p; the mask itself keeps masks apart. A mask that goes beyond the words has none."""
    parts = []
    for mask in masks:
        kept = ", ".join(f"words[p + {i}]" for i, c in enumerate(mask) if c == "1")
        parts.append(f"CASE WHEN p <= n - {len(mask)} THEN xxhash64('{mask}', {kept}) END")
    return f"array({', '.join(parts)})"


def _exploded(rows: DataFrame, key: str, masks: list[str], at: str) -> DataFrame:
    """(key, at, h) of every seed of rows (key, words)."""
    rows = rows.withColumn("n", F.size("words")).where(F.col("n") >= min(map(len, masks)))
    rows = rows.select(key, "words", "n", F.explode(F.expr(f"sequence(0, n - {min(map(len, masks))})")).alias("p"))
    return rows.select(key, F.col("p").alias(at), F.explode(F.expr(_seeds(masks))).alias("h")).where("h IS NOT NULL")


def _small(df: DataFrame, rows: int, width: int) -> DataFrame:
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def passages(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_places, n_equal, n_window, item_words): which documents contain a passage of which items.

    n_places: diagonals on which it does; n_equal of n_window words are equal in the best window.
    """
    items = benchmark.select("item_id", F.expr(f"transform(filter(split(lower(text), '{_SPLIT}'), w -> w <> ''), w -> xxhash64(w))").alias("item")).where(F.size("item") > 0).distinct()
    items = written(items.withColumn("masks", F.expr(_sized("item"))), "items")
    sizes = items.groupBy("masks").agg(F.count("*").alias("items"), F.sum(F.size("item")).alias("words")).collect()
    n_items, n_words = sum(r["items"] for r in sizes), sum(r["words"] for r in sizes)
    present = sorted({m for r in sizes for m in MASKS[r["masks"]]}) or ["1"]
    seeds = [_exploded(items.where(F.col("masks") == r["masks"]).select("item_id", F.col("item").alias("words")), "item_id", list(MASKS[r["masks"]]), "q") for r in sizes]
    seeds = seeds or [_exploded(items.select("item_id", F.col("item").alias("words")), "item_id", present, "q")]
    for more in seeds[1:]:
        seeds[0] = seeds[0].union(more)
    seeds = _small(seeds[0], 2 * n_words, 64)
    # the empty string before a separator that a text begins with, or after its last one, is a word that no item has
    words = F.expr(f"transform(split(lower(coalesce(text, '')), '{_SPLIT}'), w -> xxhash64(w))")
    met = _exploded(documents.select("doc_id", words.alias("words")), "doc_id", present, "p").join(seeds, "h")
    places = written(met.select("doc_id", "item_id", F.expr("p - q").alias("diagonal")).distinct(), "places")

    found = _small(places.select(F.col("doc_id").alias("id")).distinct(), places.count(), 48)
    rows = documents.select("doc_id", "text").join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    rows = rows.select("doc_id", words.alias("words")).distinct().withColumnRenamed("doc_id", "id")
    rows = rows.join(_small(places, places.count(), 64), F.col("doc_id").eqNullSafe(F.col("id"))).drop("id")
    rows = rows.join(_small(items.drop("masks"), n_items * 16 + n_words * 8, 1), "item_id")
    laid = "transform(item, (w, i) -> CASE WHEN diagonal + i >= 0 AND diagonal + i < size(words) AND words[diagonal + i] = w THEN 1 ELSE 0 END)"
    window = f"least({WINDOW}, size(equal))"
    best = f"array_max(transform(sequence(0, size(equal) - {window}), i -> aggregate(slice(equal, i + 1, {window}), 0, (a, x) -> a + x)))"
    judged = rows.select("doc_id", "item_id", "diagonal", F.expr(laid).alias("equal")).select("doc_id", "item_id", "diagonal", F.size("equal").alias("item_words"), F.expr(window).alias("n_window"), F.expr(best).alias("n_equal"))
    judged = judged.where(F.col("n_equal") >= F.ceil(F.lit(SHARE) * F.col("n_window")))
    diagonals = judged.groupBy("doc_id", "item_id", "diagonal").agg(F.max("n_equal").alias("n_equal"), F.max("n_window").alias("n_window"), F.max("item_words").alias("item_words"))
    return diagonals.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_places"), F.max("n_equal").cast("long").alias("n_equal"), F.max("n_window").cast("long").alias("n_window"), F.max("item_words").cast("long").alias("item_words")
    )


def without_passages(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that hold no passage of the benchmark, all columns unchanged.

    Rows are told apart by doc_id and text, so a clean text under the id of another one stays.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    own = free_name(documents, "found_in")
    found = written(passages(documents.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(own)).distinct(), "contaminated")
    return documents.join(fitting(found, 48), F.col(own).eqNullSafe(key), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_RE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Every diagonal on which enough words are equal, without seeds: each equal word of a document and an item is a point of its
#: diagonal, a window of an item that counts has SHARE of its words there, and so has the item at least ``least`` points.
_HITS = f"""
items AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(text), '{_RE}'), lambda w: w <> '') AS item FROM benchmark),
item_words AS (SELECT item_id, unnest(item) AS w, unnest(range(0, len(item))) AS q, len(item) AS m FROM items),
words AS (SELECT DISTINCT doc_id, string_split_regex(lower(coalesce(text, '')), '{_RE}') AS words FROM {{documents}}),
doc_words AS (SELECT DISTINCT doc_id, hash(words) AS text_hash, unnest(words) AS w, unnest(range(0, len(words))) AS p FROM words),
points AS (SELECT doc_id, text_hash, item_id, p - q AS diagonal, m, q FROM doc_words JOIN item_words USING (w)),
lines AS (SELECT doc_id, text_hash, item_id, diagonal, m, list(DISTINCT q) AS qs FROM points GROUP BY ALL HAVING count(DISTINCT q) >= ceil({SHARE} * least({WINDOW}, m))),
judged AS (SELECT doc_id, item_id, diagonal, m AS item_words, least({WINDOW}, m) AS n_window,
  list_max(list_transform(range(0, m - least({WINDOW}, m) + 1), lambda i: len(list_filter(qs, lambda q: q >= i AND q < i + least({WINDOW}, m))))) AS n_equal FROM lines),
hits AS (SELECT doc_id, item_id, diagonal, max(n_equal) AS n_equal, max(n_window) AS n_window, max(item_words) AS item_words FROM judged WHERE n_equal >= ceil({SHARE} * n_window) GROUP BY ALL)"""


def sql_of(documents: str = "documents") -> str:
    return f"WITH {_HITS.format(documents=documents)} SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS n_places, CAST(max(n_equal) AS BIGINT) AS n_equal, CAST(max(n_window) AS BIGINT) AS n_window, CAST(max(item_words) AS BIGINT) AS item_words FROM hits GROUP BY doc_id, item_id"

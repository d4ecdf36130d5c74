"""Benchmark decontamination: a set join on the rarest words of item windows, verified in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.cluster import at_most
from alarmlens.llm.common import LOWER, UPPER, ascii_lower, small, stored, text_key

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATORS_UPPER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are lower-cased
WINDOW = 10
BLOCK = 100_000  # windows that one pass over the documents looks for


def words_of(text: Column) -> Column:
    """Words of the text as written; NULL and texts without words give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SEPARATORS_UPPER), "")


def lower_words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def item_windows(benchmark: DataFrame, length: int) -> DataFrame:
    """``item_id, words``: each distinct window of each item; a shorter item, but not an empty one, is one window."""
    rows = benchmark.select("item_id", lower_words_of(F.col("text")).alias("_words")).where(F.size("_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - length + 1, F.lit(1)))
    rows = rows.withColumn("_start", F.explode(starts))
    return rows.select("item_id", F.slice("_words", F.col("_start"), length).alias("words")).distinct()


def rarity(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``word, n``: how often each of ``words`` stands in all documents; partial sums before the shuffle."""
    rows = docs.select(F.explode(words_of(F.col("text"))).alias("word")).withColumn("word", ascii_lower(F.col("word")))
    found = rows.join(small(words), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.join(found, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Each window with its prefix: ``window_id, item_ids, words, probe, offset``.

    All words of a window have to occur, so the necessary prefix in order of rarity is the rarest
    word alone; ``offset`` is its place in the window, and bounds where an occurrence starts.
    """
    distinct = stored(
        windows.groupBy("words").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")),
        "windows",
    )
    ranked = stored(rarity(docs, distinct.select(F.explode("words").alias("word")).distinct()), "word-counts")
    placed = distinct.select("words", F.posexplode("words").alias("offset", "word")).join(small(ranked), "word")
    probe = F.min(F.struct("n", "word", "offset"))
    probes = placed.groupBy("words").agg(probe.alias("_probe"))
    return stored(
        distinct.join(probes, "words").select(
            "words", "item_ids", F.col("_probe.word").alias("probe"), F.col("_probe.offset").alias("offset")
        ),
        "prefixes",
    )


def occurrences(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """``doc_id, _text, start, n, item_ids``: each place at which a window stands in a document, word for word.

    The windows are broadcast in blocks of ``BLOCK``, whatever their number; the documents are never shuffled. A word of a
    document meets the windows whose rarest word it is. The bounds are checked next (the window has to fit
    around the word), then the words themselves, in the row that holds the document.
    """
    windows = prefixes(docs, item_windows(benchmark, length))
    rows = docs.select(
        "doc_id", text_key(F.col("text")).alias("_text"), words_of(F.col("text")).alias("_words")
    ).select("*", F.posexplode("_words").alias("_place", "_word"))
    rows = rows.withColumn("probe", ascii_lower(F.col("_word")))

    def found(block):
        start = F.col("_place") - F.col("offset")
        size = F.size("words")
        fits = (start >= 0) & (start + size <= F.size("_words"))
        joined = rows.join(F.broadcast(block), "probe").where(fits)
        own = F.translate(F.array_join(F.slice("_words", start + 1, size), " "), UPPER, LOWER)
        return joined.where(own == F.array_join("words", " ")).select(
            "doc_id", "_text", start.alias("start"), size.alias("n"), "item_ids"
        )

    if at_most(windows, BLOCK):
        return found(windows)
    blocks = -(-windows.count() // BLOCK)
    numbered = windows.withColumn("_block", F.pmod(F.xxhash64("words"), F.lit(2 * blocks)))
    parts = [found(numbered.where(F.col("_block") == b).drop("_block")) for b in range(2 * blocks)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: ``doc_id, _text, n_words, n_hit, n_items, items_sha256, contaminated``.

    Rows that repeat a doc_id with another text are judged each on its own; equal rows get equal results. NULL texts have no words, and
    items without words have no window. An empty benchmark hits nothing. A NULL item_id counts for hits, not as an item.
    """
    hits = stored(occurrences(docs, benchmark, length), "occurrences")
    spans = hits.select("doc_id", "_text", "start", F.col("start").cast("bigint").alias("_from"), (F.col("start") + F.col("n")).cast("bigint").alias("_to"))
    # Overlapping spans: each adds what lies beyond the end of those before it.
    own = Window.partitionBy("doc_id", "_text").orderBy("_from", "_to").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("_to").over(own), F.lit(0))
    spans = spans.select("doc_id", "_text", F.greatest(F.col("_to") - F.greatest("_from", reached), F.lit(0)).alias("_new"))
    n_hit = spans.groupBy("doc_id", "_text").agg(F.sum("_new").alias("n_hit"))
    items = hits.select("doc_id", "_text", F.explode("item_ids").alias("item")).distinct()
    items = items.groupBy("doc_id", "_text").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("_items")
    )
    found = n_hit.join(items, F.expr("true") & n_hit["doc_id"].eqNullSafe(items["doc_id"]) & (n_hit["_text"] == items["_text"]), "left")
    found = stored(
        found.select(n_hit["doc_id"].alias("_id"), n_hit["_text"].alias("_key"), "n_hit", "n_items", "_items"), "hits"
    )
    rows = docs.select("doc_id", text_key(F.col("text")).alias("_text"), F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key"))
    joined = rows.join(small(found), same, "left")
    none = F.lit(0).cast("bigint")
    return joined.select(
        "doc_id",
        "_text",
        "n_words",
        F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce("n_items", none).alias("n_items"),
        F.sha2(F.coalesce("_items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", none) > 0).alias("contaminated"),
    )

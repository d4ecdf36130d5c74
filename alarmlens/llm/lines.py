"""Line dedup across documents: ranges of hashed lines, first occurrences, keep bitmaps per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.llm.common import small, stored, text_key

SPACES = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
SALTS = 64  # pieces into which the documents of one line are dealt before they meet


def line_key(line: Column) -> Column:
    """Equal for lines that differ in the case of A-Z alone.

    The bytes of the line are read as Latin-1 and lower-cased. Besides A-Z that only moves lead
    bytes of UTF-8, whose meaning still follows from the number of bytes behind them, so no two other lines
    come to be equal. It is far cheaper than replacing letters one by one.
    """
    return F.lower(F.decode(line.cast("binary"), "ISO-8859-1"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, _text, place, hi, lo``: one row per line whose key is long enough, with 128 bits of its key."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("_text"), F.posexplode(lines_of(F.col("text"))).alias("place", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(SPACES))).where(F.length("line") >= min_chars)
    rows = rows.withColumn("key", line_key(F.col("line")))
    second = F.xxhash64(F.lit("line"), F.col("key"), F.length("key"))
    return rows.select("doc_id", "_text", "place", F.xxhash64("key").alias("hi"), second.alias("lo"))


def repeated_keys(lines: DataFrame) -> DataFrame:
    """Keys of two documents or more, with the smallest document that holds each: ``hi, lo, first``.

    The hashes are dealt into ranges and sorted there by document and position. A range is walked once;
    only the first row of a run goes on. The documents of one line are dealt over ``SALTS`` runs,
    so a line that a third of all documents share does not meet in one range; the runs'
    heads, a row per line and salt, are then reduced with partial sums.
    """
    dealt = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    ranges = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionByRange(ranges, "hi", "lo", "salt")
    run = Window.partitionBy("hi", "lo", "salt").orderBy("doc_id", "place")  # fits the ranges: no further shuffle
    walked = dealt.select(
        "hi", "lo", "doc_id", F.row_number().over(run).alias("_row"), F.lag("doc_id").over(run).alias("_before")
    )
    # The first row of a run, and one of the next document in it: enough to tell one document from several.
    heads = walked.where("_row = 1 or not doc_id <=> _before")
    merged = heads.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    several = merged.where("first < last or (nulls > 0 and first is not null)")
    return several.select("hi", "lo", F.when(F.col("nulls") == 0, F.col("first")).alias("first"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document that loses lines its keep bitmap: ``doc_id, _text, runs, n_dropped``.

    ``runs`` is the bitmap in run lengths: pairs of first line and number of lines that go. Documents are told
    apart by doc_id (NULL is the smallest id); rows that repeat a doc_id are the same document, whatever their text.
    """
    lines = occurrences(docs, min_chars)
    first = stored(repeated_keys(lines), "line-keys")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.col("doc_id").isNotNull())
    gone = lines.join(small(first), ["hi", "lo"]).where(later).select("doc_id", "_text", "place").distinct()
    # A run is a maximal row of neighbours: its lines have one value of place minus rank.
    own = Window.partitionBy("doc_id", "_text").orderBy("place")
    runs = gone.withColumn("_run", F.col("place") - F.row_number().over(own))
    runs = runs.groupBy("doc_id", "_text", "_run").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    pair = F.struct("place", F.col("n").cast("int").alias("n"))
    return runs.groupBy("doc_id", "_text").agg(
        F.sort_array(F.collect_list(pair)).alias("runs"), F.sum("n").alias("n_dropped")
    )


def kept_text(text: Column, runs: Column) -> Column:
    """The lines that stay, joined by a line feed; ``runs`` may be NULL."""
    lines = lines_of(text)
    gone = F.flatten(F.transform(runs, lambda r: F.sequence(r["place"], r["place"] + r["n"] - 1)))
    # One flag per line, so that a document of many lines is walked once.
    flags = F.map_from_arrays(gone, F.transform(gone, lambda _: F.lit(True)))
    stay = F.filter(lines, lambda _, i: ~F.coalesce(F.try_element_at(flags, i), F.lit(False)))
    return F.when(runs.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(stay, "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, kept_text, n_lines, n_dropped`` for each row of ``docs``.

    NULL and empty texts are one empty line. Lines with keys below ``min_chars`` code points always stay, as do all
    lines of the smallest document of a key.
    """
    maps = stored(keep_bitmaps(docs, min_chars), "line-maps").withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("_key"))
    maps = maps.withColumnRenamed("_text", "_other")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_other"))
    joined = rows.join(small(maps, 20_000), same, "left")
    return joined.select(
        "doc_id",
        kept_text(F.col("text"), F.col("runs")).alias("kept_text"),
        F.size(lines_of(F.col("text"))).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
    )

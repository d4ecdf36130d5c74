"""What several operators share: words, row keys, tables in the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmlens.cluster import at_most, scratch_path

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 200_000  # rows a broadcast side may have, counted first


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if a count shows that it has at most ``rows`` rows."""
    return F.broadcast(df) if at_most(df, rows) else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; texts of ASCII alone take the fast built-in."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> Column:
    """Tells rows that share a doc_id but not the text apart; equal rows share it."""
    return F.xxhash64(text)


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def word_places(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, in order of first sight; the place of every word among them; how many words each text has."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    real = pc.binary_length(words).to_numpy() > 0  # white space at either end leaves an empty string
    counts = np.diff(np.concatenate([[0], np.cumsum(real)])[offsets])
    coded = words.filter(pa.array(real)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), counts

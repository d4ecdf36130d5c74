"""Corpus preparation: stages that each read all that the one before has kept.

``STAGES`` are functions of ``(spark, docs, sf_dir)``. All but the last return the columns of ``docs``. ``run`` writes every
stage to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmlens.llm import decontaminate, jaccard, mixing, token_files, toxicity
from alarmlens.llm.common import small, stored, table, text_key
from alarmlens.llm.queries_learned import tokenizer_path

IDS = 1_000_000  # ids in a broadcast: at most 16 MB


def _same(docs: DataFrame, rows: DataFrame) -> Column:
    """Whether a row of ``docs`` has the id and the text of one of ``rows`` (``doc_id, _text``)."""
    return docs["doc_id"].eqNullSafe(rows["doc_id"]) & text_key(docs["text"]).eqNullSafe(rows["_text"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay; the model is trained on those of ``docs`` that are not held out."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id (NULL last) stays; rows that repeat id and text stay once.

    Rows that share an id but not the text are told apart. NULL, empty and blank texts link with nothing.
    """
    found = stored(jaccard.jaccard_groups(docs), "groups")
    gone = small(found.where("not leads").select("doc_id", "_text").distinct(), IDS)
    kept = docs.join(gone, _same(docs, gone), "left_anti")
    repeated = found.where("leads").groupBy("doc_id", "_text").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if repeated.isEmpty():
        return kept
    repeated = small(stored(repeated.select("doc_id", "_text"), "repeated"), IDS)
    once = docs.join(repeated, _same(docs, repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, _same(kept, repeated), "left_anti").unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item stay."""
    found = stored(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")), "contamination")
    hit = small(found.where("contaminated").select("doc_id", "_text").distinct(), IDS)
    return docs.join(hit, _same(docs, hit), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times, or not at all."""
    read = ("doc_id", "source", "text")
    own = {c: c if c in read else f"_column{i}" for i, c in enumerate(docs.columns)}  # no name of the mix clashes with these
    mixed = mixing.mix(docs.withColumnsRenamed(own), mixing.words_in(F.col("text")))
    copies = mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("repeats"))))
    return copies.select(*[F.col(name).alias(c) for c, name in own.items()])


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of the mix, read back: one row per document of the mix."""
    return token_files.round_trip(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token files", write_tokens),
]

ORACLE_SQL = None  # a trained model and a tokenizer; tests/llm holds the stages against plain definitions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

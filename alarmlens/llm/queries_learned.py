"""Queries of the operators that train a model or use a tokenizer; none of them has an SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from alarmlens.llm import hmm, jaccard, language, quality, repeats, token_files, toxicity, whitening
from alarmlens.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op2_token_files(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_hmm(spark, sf_dir):
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op5_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_repeats(spark, sf_dir):
    cut = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_language(spark, sf_dir):
    return language.predictions(table(spark, sf_dir, "documents"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_token_files": op2_token_files,
    "op3_toxicity": op3_toxicity,
    "op5_jaccard": op5_jaccard,
    "op8_hmm": op8_hmm,
    "op9_repeats": op9_repeats,
    "op11_language": op11_language,
    "op12_whitening": op12_whitening,
}

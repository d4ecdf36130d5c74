"""Quality rules: boosted trees over document statistics, behind two base rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlens.llm import gbt

LABELLED_ROWS = 20_000  # bound of the labelled sample that the trees are fitted on
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Features and how quality may move with each: 0 is free.
FEATURES = {
    "words": 0,
    "chars_per_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 0,
    "upper_share": -1,
    "digit_share": 0,
    "bar_share": -1,
    "bang_share": -1,
    "words_per_line": 0,
    "other_share": 0,
}
_SPACES = b" \t\n\r\x0b\x0c"
_MIN_WORDS, _MAX_REPEATED = 50, 50


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows that occur twice or more; overlapping windows count a word once."""
    if len(words) <= window:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(len(words))), np.int64, len(words))
    code = ids[: len(ids) - window + 1]
    for k in range(1, window):
        # Renumbering keeps the pair of numbers within 64 bits, however long the text.
        _, code = np.unique(code * len(words) + ids[k : len(ids) - window + 1 + k], return_inverse=True)
    again = np.bincount(code)[code] > 1
    hit = np.zeros(len(words), bool)
    for k in range(window):
        hit[k : k + len(again)] |= again
    return int(hit.sum())


def statistics(text: str | None) -> list[float]:
    """The base counts, then the features, of one whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, _SPACES))
    chars = len(text) - spaces
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [line for line in raw.split(b"\n") if line.strip(_SPACES)]
    dup = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    per_char, per_word, per_line = 1 / max(chars, 1), 1 / max(n, 1), 1 / max(len(lines), 1)
    ascii_letters = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    return [
        n, chars, symbols, dup, repeated,
        np.log1p(n), chars * per_word, symbols * per_char, dup * per_line, repeated * per_word,
        len(set(words)) * per_word, upper / max(ascii_letters, 1), digits * per_char, raw.count(b"|") * per_char,
        raw.count(b"!") * per_char, n * per_line, (len(text) - ascii_letters - digits - spaces) * per_char,
    ]


_KIND = "struct<" + ", ".join(f"{c}: bigint" for c in BASE) + ", x: array<double>, score: double>"


def measured(text: Column, forest: gbt.Forest | None = None) -> Column:
    """A struct of the base counts, the features and, with a forest, the probability of good quality."""

    @F.arrow_udf(_KIND)
    def run(texts: pa.Array) -> pa.Array:
        rows = np.array([statistics(t.as_py()) for t in texts], float).reshape(len(texts), len(BASE) + len(FEATURES))
        x = rows[:, len(BASE) :]
        score = forest.probability(x) if forest is not None else np.zeros(len(x))
        columns = [pa.array(rows[:, i].astype(np.int64)) for i in range(len(BASE))]
        offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
        columns += [pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1))), pa.array(score)]
        return pa.StructArray.from_arrays(columns, [*BASE, "x", "score"])

    return run(text)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> gbt.Forest:
    """Trees from at most ``rows`` labelled documents, those with the lowest md5 of their id.

    Documents with a NULL label or text are left out; several rows or labels of one id count once. Only the
    bounded sample's statistics reach the driver.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(rows)
    texts = docs.where("text is not null").join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text")
    sample = texts.select("doc_id", "quality", measured(F.col("text"))["x"].alias("x"))
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("v")).orderBy("doc_id").toArrow()
    found = sample["v"].combine_chunks()
    y = np.array([v["quality"] for v in found.to_pylist()], float)
    x = np.array([v["x"] for v in found.to_pylist()], float).reshape(-1, len(FEATURES))
    return gbt.fit(x, y, np.array(list(FEATURES.values())))


def judge(docs: DataFrame, forest: gbt.Forest) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed, kept, score`` for each row of ``docs``.

    A document that fails a base rule (fewer than 50 words, or more than half of its words in repeated windows) goes;
    of the others those with a probability of 0.5 or more stay. NULL and empty texts have no words and go.
    """
    rows = docs.select("doc_id", measured(F.col("text"), forest).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < _MIN_WORDS) | (100 * F.col("n_repeat_words") > _MAX_REPEATED * F.col("n_words"))
    return rows.select(
        "doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.col("score") >= 0.5)).alias("kept"), "score"
    )

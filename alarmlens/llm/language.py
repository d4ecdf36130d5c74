"""Language identification by character language models with interpolated Kneser-Ney smoothing, one per language.

A model is a pair of sorted hash arrays per order: what an n-gram itself is worth, and what its context leaves to the shorter one. The
language with the lowest cross-entropy per character is chosen; documents kept apart set how sure that is, and what is rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.cluster import at_most
from alarmlens.llm.common import crc_of_id, stored

ORDER = 5
SAMPLE = 2_000  # documents per language that the models are fitted on, at most; their whole texts count
ENTRIES = 1_000_000  # n-grams of the longest order in all models together; beyond it a shorter order is taken
APART = 5  # one document of so many of the sample is kept for the calibration
ACCEPTED_RIGHT = 0.99  # share of accepted calibration documents that should be right
REJECTED = 0.005  # share of a language's own calibration documents that look too unlike it
UNKNOWN = "und"  # fixed: what stands for a text without any letter
_SPACE = 32
_SLICE = 1 << 18
_TOGETHER = 1 << 20  # characters looked up at once
_FACTOR = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


class Level(NamedTuple):
    """One order of one language: sorted hashes and values of n-grams, and of their contexts."""

    grams: np.ndarray
    own: np.ndarray
    contexts: np.ndarray
    rest: np.ndarray


class Model(NamedTuple):
    order: int
    languages: list[str]
    levels: list[list[Level]]  # by language, from order 1 up
    base: float  # probability of any character before the first order
    slope: float  # of the posterior: exp(-slope * characters ** power * cross-entropy)
    power: float
    limits: list[float]  # cross-entropy by language, in bits, beyond which a text is rejected
    least_score: float


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter, and whether it is a letter or a mark."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    letters = np.array([k == "L" for k in kinds])
    return letters, letters | np.array([k == "M" for k in kinds])


def has_letter(text: str) -> bool:
    letters, _ = _classes()
    return any(letters[_codes(text[i : i + _SLICE])].any() for i in range(0, len(text), _SLICE))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(text: str, order: int) -> Iterator[np.ndarray]:
    """Lower-case letters and marks, one space for whatever lies between words, each piece behind ``order - 1`` earlier characters.

    Characters behind the first ``order - 1`` of each piece are what the models predict; a text begins after spaces and ends with one.
    """
    _, inner = _classes()
    context, before = np.full(order - 1, _SPACE, np.uint32), False
    for i in range(0, len(text), _SLICE):
        codes = _codes(text[i : i + _SLICE].lower())
        word = inner[codes]
        kept = word.copy()
        kept[0] |= before
        kept[1:] |= word[:-1]
        before = bool(word[-1])
        codes = np.where(word, codes, _SPACE)[kept].astype(np.uint32)
        if len(codes):
            piece = np.concatenate([context, codes])
            yield piece
            context = piece[len(piece) - order + 1 :]
    if before:
        yield np.concatenate([context, np.array([_SPACE], np.uint32)])


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1 to ``order`` characters that end at each place; a place too near the front holds no meaning."""
    units = codes.astype(np.uint64) + np.uint64(1)
    found, power = [units], 1
    for n in range(1, order):
        power = power * _FACTOR & _WORD
        longer = found[-1].copy()
        longer[n:] += units[:-n] * np.uint64(power)
        found.append(longer)
    return found


def _windows(parts: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces in a row, the places to predict, and where each piece's places begin among them."""
    flat = np.concatenate(parts)
    ends = np.cumsum([len(p) for p in parts])
    places = np.ones(len(flat), bool)
    for start in ends - [len(p) for p in parts]:
        places[start : start + order - 1] = False
    counts = np.array([len(p) - order + 1 for p in parts])
    return flat, np.flatnonzero(places), np.cumsum(counts) - counts


def _count_grams(sample: DataFrame, order: int) -> DataFrame:
    """``lang, gram, count`` of the n-grams of the longest order."""

    def run(batches):
        for batch in batches:
            totals = {}

            def add(lang, parts):
                flat, places, _ = _windows(parts, order)
                _, first, counts = np.unique(_hashes(flat, order)[-1][places], return_index=True, return_counts=True)
                ends = places[first]
                rows = flat[ends[:, None] + np.arange(1 - order, 1)]
                grams = rows.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                own = totals.setdefault(lang, {})
                for i, count in enumerate(counts.tolist()):
                    gram = grams[i * order : (i + 1) * order]
                    own[gram] = own.get(gram, 0) + count

            held, size = {}, 0
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for piece in pieces(text, order):
                    held.setdefault(lang, []).append(piece)
                    size += len(piece)
                    if size > _TOGETHER:
                        for name, parts in held.items():
                            add(name, parts)
                        held, size = {}, 0
            for name, parts in held.items():
                add(name, parts)
            rows = [(lang, gram, count) for lang, own in totals.items() for gram, count in own.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", "gram", "count"])

    counted = sample.select("lang", "text").mapInArrow(run, "lang string, gram string, count long")
    return counted.groupBy("lang", "gram").agg(F.sum("count").alias("count"))


def _grouped(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    found, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return found, first, *[np.bincount(inverse, weights=s, minlength=len(found)) for s in sums]


def smooth(codes: np.ndarray, counts: np.ndarray) -> list[Level]:
    """The levels of one language, from the rows of code points and the counts of its n-grams of the longest order.

    Below the longest order an n-gram counts as often as there are different characters before it. The discount of an order is
    n1 / (n1 + 2 n2), from the n-grams counted once and twice.
    """
    levels = []
    while codes.shape[1]:
        order = codes.shape[1]
        hashes = _row_hashes(codes)
        grams, first, counts = _grouped(hashes, counts)
        codes = codes[first]
        before = _row_hashes(codes[:, :-1])
        contexts, inverse = np.unique(before, return_inverse=True)
        totals = np.bincount(inverse, weights=counts, minlength=len(contexts))
        kinds = np.bincount(inverse, minlength=len(contexts))
        once, twice = int((counts == 1).sum()), int((counts == 2).sum())
        discount = once / (once + 2 * twice) if once and twice else 0.5
        levels.append(Level(grams, (counts - discount) / totals[inverse], contexts, discount * kinds / totals))
        codes, counts = codes[:, 1:], np.ones(len(codes))
        if order == 1:
            break
    return levels[::-1]


def _row_hashes(codes: np.ndarray) -> np.ndarray:
    if not codes.shape[1]:
        return np.zeros(len(codes), np.uint64)
    total, power = np.zeros(len(codes), np.uint64), 1
    for i in range(codes.shape[1] - 1, -1, -1):
        total += (codes[:, i].astype(np.uint64) + np.uint64(1)) * np.uint64(power)
        power = power * _FACTOR & _WORD
    return total


def _looked_up(hashes: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    places = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return np.where(hashes[places] == wanted, values[places], missing)


def bits(model: Model, hashes: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    """Bits that each language needs for the character at each place, given those before it: one column per language."""
    found = np.empty((len(places), len(model.languages)))
    for column, levels in enumerate(model.levels):
        share = np.full(len(places), model.base)
        for n, level in enumerate(levels, 1):
            before = hashes[n - 2][places - 1] if n > 1 else np.zeros(len(places), np.uint64)
            own = _looked_up(level.grams, level.own, hashes[n - 1][places], 0.0)
            share = own + _looked_up(level.contexts, level.rest, before, 1.0) * share
        found[:, column] = -np.log2(share)
    return found


def cross_entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Predicted characters of each text, and bits per character by language."""
    lengths, totals = np.zeros(len(texts)), np.zeros((len(texts), len(model.languages)))

    def flush(rows, parts):
        flat, places, starts = _windows(parts, model.order)
        hashes = _hashes(flat, model.order)
        _, first, inverse = np.unique(hashes[-1][places], return_index=True, return_inverse=True)
        table = bits(model, hashes, places[first])
        for column in range(table.shape[1]):
            np.add.at(totals[:, column], rows, np.add.reduceat(table[inverse, column], starts))
        np.add.at(lengths, rows, np.diff(np.append(starts, len(places))))

    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        if text is None or not has_letter(text):
            continue
        for piece in pieces(text, model.order):
            rows.append(row)
            parts.append(piece)
            size += len(piece)
            if size > _TOGETHER:
                flush(rows, parts)
                rows, parts, size = [], [], 0
    if parts:
        flush(rows, parts)
    return lengths, totals / np.maximum(lengths, 1)[:, None]


def _posterior(entropies: np.ndarray, lengths: np.ndarray, slope: float, power: float) -> np.ndarray:
    scaled = -slope * (lengths**power)[:, None] * entropies
    weights = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def learnable(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` rows per language with a text: those whose ids and texts have the smallest hashes, equal rows once."""
    rows = docs.where("text is not null and lang is not null").select("doc_id", "lang", "text")
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = rows.select("lang", F.xxhash64(id_text, "text").alias("_share"), F.sha2("text", 256).alias("_key"), "text")
    counts = stored(drawn.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows")), "language-counts")
    # Twice the wanted share passes first, so that the ranking sees few rows of a frequent language.
    often = F.broadcast(counts.where(F.col("_rows") > 4 * sample))
    bound = F.lit(2.0**64 * 2 * sample) / F.col("_rows") - F.lit(2.0**63)
    near = drawn.join(often, "lang", "left").where(F.col("_rows").isNull() | (F.col("_share") <= bound))
    near = near.groupBy("lang", "_share", "_key").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_share", "_key"))
    chosen = near.withColumn("_place", place).where(F.col("_place") <= sample)
    return stored(chosen.select("lang", "text", (F.col("_place") % APART == 0).alias("apart")), "language-sample")


def train(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> Model | None:
    """Fit the models on a sample of ``docs``; None if no row has a text with a letter and a language.

    The sample is bounded per language; the n-grams of its whole texts are counted on the cluster. The driver takes the
    counts, at most ``ENTRIES`` of them, and the results of the documents kept apart.
    """
    chosen = learnable(docs, sample)
    fitted = chosen.where("not apart")
    counted = stored(_count_grams(fitted, order), "grams")
    while order > 1 and not at_most(counted, ENTRIES):
        order -= 1
        shorter = counted.select("lang", F.expr("substring(gram, 2)").alias("gram"), "count")
        counted = stored(shorter.groupBy("lang", "gram").agg(F.sum("count").alias("count")), "grams")
    frame = counted.orderBy("lang", "gram").toPandas()
    if not len(frame):
        return None
    languages, levels, characters = [], [], set()
    for lang, rows in frame.groupby("lang", sort=True):
        codes = _codes("".join(rows["gram"])).reshape(-1, order)
        languages.append(lang)
        levels.append(smooth(codes, rows["count"].to_numpy(np.float64)))
        characters.update(np.unique(codes).tolist())
    model = Model(order, languages, levels, 1.0 / (len(characters) + 1), 1.0, 1.0, [float("inf")] * len(languages), 0.0)
    return _calibrated(model, chosen.where("apart"))


def _calibrated(model: Model, apart: DataFrame) -> Model:
    """Slope and power that make the labels of the documents kept apart likeliest, then the limits of the rejection."""
    schema = "lang string, length double, entropies array<double>"

    def run(batches):
        for batch in batches:
            lengths, entropies = cross_entropies(model, batch.column("text").to_pylist())
            columns = [batch.column("lang"), pa.array(lengths), pa.array(list(entropies), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "length", "entropies"])

    rows = apart.select("lang", "text").mapInArrow(run, schema).where("length > 0").collect()
    rows = sorted((r for r in rows if r["lang"] in set(model.languages)), key=lambda r: (r["lang"], r["length"], r["entropies"]))
    if not rows:
        return model
    truth = np.array([model.languages.index(r["lang"]) for r in rows])
    lengths, entropies = np.array([r["length"] for r in rows]), np.array([r["entropies"] for r in rows])
    best = None
    for power in (0.0, 0.5, 1.0):
        for slope in 2.0 ** np.arange(-6, 9):
            right = _posterior(entropies, lengths, slope, power)[np.arange(len(rows)), truth]
            loss = -np.log(np.maximum(right, 1e-9)).mean()
            if best is None or loss < best[0] - 1e-12:
                best = loss, float(slope), power
    _, slope, power = best
    chosen = entropies.argmin(axis=1)
    scores = _posterior(entropies, lengths, slope, power)[np.arange(len(rows)), chosen]
    limits = []
    for i in range(len(model.languages)):
        own = entropies[truth == i, i]
        limits.append(float(np.quantile(own, 1 - REJECTED)) if len(own) else float("inf"))
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum((chosen == truth)[order]) / np.arange(1, len(rows) + 1)
    enough = np.flatnonzero(right >= ACCEPTED_RIGHT)
    least = float(scores[order][enough[-1]]) if len(enough) else 1.0
    return model._replace(slope=slope, power=power, limits=limits, least_score=least)


def language_of(model: Model | None, text: Column) -> Column:
    """A struct: ``language`` (of the lowest cross-entropy), ``score``, ``cross_entropy`` in bits, ``characters``, ``rejected``.

    A NULL text, one without a letter, and every text if nothing has been learned have the language ``und`` and score 0, and are rejected.
    ``score`` is the share of the language in the calibrated posterior. Of languages that need equally many bits the first by code point is taken.
    Texts of any length are read whole, in slices. ``rejected`` marks texts that look unlike their language's own, or are too uncertain.
    """
    schema = "language string, score double, cross_entropy double, characters long, rejected boolean"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield identify(model, [t if isinstance(t, str) else None for t in texts])

    return F.pandas_udf(run, schema)(text)


def identify(model: Model | None, texts: list[str | None]) -> pd.DataFrame:
    """``language_of`` for texts in memory."""
    count = len(texts)
    if model is None:
        lengths, entropies = np.zeros(count), np.zeros((count, 1))
    else:
        lengths, entropies = cross_entropies(model, texts)
    known = lengths > 0
    language, rejected = np.full(count, UNKNOWN, object), np.ones(count, bool)
    score, lowest = np.zeros(count), np.full(count, np.nan)
    if known.any():
        chosen = entropies[known].argmin(axis=1)
        rows = np.arange(len(chosen))
        language[known] = np.array(model.languages, object)[chosen]
        score[known] = _posterior(entropies[known], lengths[known], model.slope, model.power)[rows, chosen]
        lowest[known] = entropies[known][rows, chosen]
        rejected[known] = (lowest[known] > np.array(model.limits)[chosen]) | (score[known] < model.least_score)
    lowest = pd.Series(lowest, dtype=object).where(known, None)
    columns = {"language": language, "score": score, "cross_entropy": lowest}
    return pd.DataFrame({**columns, "characters": lengths.astype(np.int64), "rejected": rejected})


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 3 == 1


def predictions(docs: DataFrame) -> DataFrame:
    """Language of every text, learned from the labelled rows that are not held out.

    Rows are independent, so repeated rows and ids get the same result each; a NULL doc_id counts as the empty text in the choice of the
    rows held out. NULL languages are not learned from; an empty table gives no rows. Other columns are not read.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = docs.select("doc_id", language_of(model, F.col("text")).alias("_found"))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_found.language").alias("lang_pred"),
        "_found.score",
        "_found.cross_entropy",
        "_found.rejected",
    )

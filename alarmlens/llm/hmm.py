"""Hidden Markov language model: Baum-Welch with counts summed across partitions, exact scaled forward scores.

The states emit word classes: each of the commonest words, the end of a text, and one class for all rarer words. A word
of that class is then drawn by its smoothed count, so every word, known or not, has a probability and all sum to 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlens.llm.common import crc_of_id, stored, word_places

STATES, ROUNDS, SEED = 8, 4, 7
COMMON_WORDS = 65_000  # words with a class of their own; bounds the model
_GROUP = 16 << 20  # bytes of text whose words are told apart at once
_CHUNK = 1 << 18  # tokens whose vectors the recursions hold at once; a longer text goes in pieces
_BLOCKS = 32  # pieces in which emission counts are summed


def tokens_of(texts: pa.Array) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    """Lower-cased (A-Z) words in groups of whole texts: the first text, distinct words, the place of every word among these, words of
    each text. The ends follow from the lengths."""
    before = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))])
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(before, before[start] + _GROUP, "right")) - 1)
        words, places, counts = word_places(pc.ascii_lower(texts[start:stop]))
        yield start, words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), places, counts
        start = stop


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc_of_id(doc_id), F.lit(7)) == 2


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` over the rows of ``docs``; tasks sum those of a group of texts first. The end of a text is the empty word."""

    def run(batches):
        for batch in batches:
            for _, words, places, counts in tokens_of(batch.column("text")):
                n = np.append(np.bincount(places, minlength=len(words)), len(counts))
                yield pa.RecordBatch.from_arrays([pa.array([*words, b""], pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """The common words with their counts, and sums over all training tokens. The class behind them holds all other words."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int

    @property
    def rare_mass(self) -> int:
        """Smoothed count of the rare class: its tokens, its words, and one for all unknown ones."""
        return self.tokens - int(self.counts.sum()) + self.distinct - len(self.words) + 1

    def unigram(self) -> np.ndarray:
        return np.append(self.counts + 1.0, self.rare_mass) / (self.tokens + self.distinct + 1)


def vocabulary(counts: DataFrame, common: int) -> Vocabulary:
    """The ``common`` most frequent words, ties by their bytes; the end of a text always has a class."""
    tokens, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    end = F.col("word") == F.lit(b"")
    rows = counts.orderBy(end.desc(), F.col("n").desc(), "word").limit(common).toArrow()
    words, n = rows["word"].to_pylist(), rows["n"].to_numpy()
    if not words:  # no training text at all
        words, n = [b""], np.zeros(1, np.int64)
        return Vocabulary(words, n, 0, 1)
    return Vocabulary(words, n, int(tokens), int(distinct))


ENCODED = (
    "row_id long, doc_id long, held_out boolean, n_tokens long, n_common long, log_common double, ids binary, rare array<binary>"
)


def encode(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """Each row of ``docs`` as packed class numbers with its rare words beside them.

    ``row_id`` is the place of a row in its partition, so that repeated rows stay apart. It is meant to be stored at once.
    """
    lookup = docs.sparkSession.sparkContext.broadcast((words.words, np.log10(words.counts + 1.0)))

    def run(batches):
        listed, logs = lookup.value
        place = {w: i for i, w in enumerate(listed)}
        other = len(place)
        pack, row = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 33
        logs = np.append(logs, 0.0)
        for batch in batches:
            columns = [[] for _ in range(8)]
            ids_of_rows, out_of_rows = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
            for first, listed_here, places, counts in tokens_of(batch.column("text")):
                classes = np.fromiter(map(place.get, listed_here, repeat(other)), np.uint16, len(listed_here))
                ends = np.cumsum(counts)
                for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist()), first):
                    own = places[a:b]
                    ids = np.append(classes[own], np.uint16(place[b""]))
                    rare = [listed_here[j] for j in own[ids[:-1] == other].tolist()]
                    values = (row, ids_of_rows[i], out_of_rows[i], len(ids), len(ids) - len(rare), float(logs[ids].sum()), pack.compress(ids.tobytes()), rare)
                    for column, value in zip(columns, values):
                        column.append(value)
                    row += 1
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
            names = [c.split()[0] for c in ENCODED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, ENCODED)


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes by states


def first_model(words: Vocabulary, states: int = STATES, seed: int = SEED) -> Model:
    """States that stay as they are, with seeded variations of the word frequencies."""
    draw = np.random.default_rng(seed)
    emit = words.unigram()[:, None] * draw.uniform(0.3, 1.7, (len(words.words) + 1, states))
    move = np.full((states, states), 0.05 / max(states - 1, 1))
    np.fill_diagonal(move, 0.95)
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _chunks(packed: list[bytes]):
    """Texts in order of length, in padded groups: which texts, their lengths, ids by time and text."""
    unpack = zstandard.ZstdDecompressor()
    texts = [np.frombuffer(unpack.decompress(v), np.uint16) for v in packed]
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        longest = len(texts[order[at]])
        own = order[at : at + max(1, _CHUNK // longest)]
        ids = np.zeros((longest, len(own)), np.uint16)
        for column, i in enumerate(own):
            ids[: len(texts[i]), column] = texts[i]
        yield own, np.array([len(texts[i]) for i in own]), ids
        at += len(own)


def _pieces(lengths: np.ndarray, ids: np.ndarray):
    """The steps of a group in pieces of about ``_CHUNK`` tokens: class numbers, and how many texts reach each step."""
    size = max(1, _CHUNK // ids.shape[1])
    for at in range(0, len(ids), size):
        piece = ids[at : at + size]
        yield piece, (lengths[None, :] > np.arange(at, at + len(piece))[:, None]).sum(axis=1)


def _forward(model: Model, ids: np.ndarray, active: np.ndarray, now: np.ndarray | None, keep: bool):
    """Scaled forward recursion over a piece, from the vectors before it (None at the start of the texts).

    Texts stand in falling order of length. Returns scales by time and text, the vectors if kept, and the last vectors.
    """
    steps, width = ids.shape
    ones = np.ones(len(model.start))
    scales = np.ones((steps, width))
    kept = np.empty((steps, width, len(model.start))) if keep else None
    for t in range(steps):
        n = active[t]
        now = np.broadcast_to(model.start, (width, len(model.start))) if now is None else now[:n] @ model.move
        now = now * model.emit[ids[t, :n]]
        scale = now @ ones  # a product is faster than a sum along so short an axis
        now /= scale[:, None]
        scales[t, :n] = scale
        if keep:
            kept[t, :n] = now
    return scales, kept, now


def expected(model: Model, packed: list[bytes], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
    """Add the expected counts of some texts to the three sums; the log10 probability of the texts.

    Of a text of several pieces only the vectors at their borders are kept; each piece is run forward again on the way back.
    """
    total, classes, states = 0.0, len(model.emit), len(model.start)
    for _, lengths, ids in _chunks(packed):
        pieces = list(_pieces(lengths, ids))
        borders = [None]
        for piece, active in pieces[:-1]:
            borders.append(_forward(model, piece, active, borders[-1], False)[2])
        ahead = None  # what the next step says about the one before it
        pairs = np.zeros((states, states))
        for k in range(len(pieces) - 1, -1, -1):
            piece, active = pieces[k]
            scales, gamma, _ = _forward(model, piece, active, borders[k], True)
            total += float(np.log10(scales).sum())
            for t in range(len(piece) - 1, -1, -1):
                n = active[t]
                now = gamma[t, :n]
                emitted = model.emit[piece[t, :n]]
                emitted /= scales[t, :n, None]
                if ahead is not None:
                    m = len(ahead)
                    pairs += now[:m].T @ ahead
                    back = ahead @ model.move.T  # texts that end here begin with ones
                    emitted[:m] *= back
                    now[:m] *= back
                ahead = emitted
            real = np.arange(piece.shape[1])[None, :] < active[:, None]
            flat, weight = piece[real], gamma[real].T
            for s in range(states):
                emit[:, s] += np.bincount(flat, weight[s], classes)
        start += gamma[0].sum(axis=0)
        move += model.move * pairs
    return total


def sum_expected(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all ``rows``: each task sums its own, then each piece of the table is summed once more.

    The driver receives one table of classes by states, whatever the number of rows. Tasks round their sums to 24 bits for the
    way; these are added in the order of the tasks, so reruns over the same files agree.
    """
    classes, states = model.emit.shape
    shared = rows.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))
    size = -(-classes * states // _BLOCKS)

    def run(batches):
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
        own = Model(*shared.value)
        for batch in batches:
            expected(own, batch.column("ids").to_pylist(), start, move, emit)
        parts = [emit.reshape(-1)[b * size : (b + 1) * size].astype(np.float32) for b in range(_BLOCKS)]
        parts.append(np.concatenate([start, move.reshape(-1)]).astype(np.float32))
        task = [TaskContext.get().partitionId()] * (_BLOCKS + 1)
        columns = [pa.array(range(_BLOCKS + 1), pa.int32()), pa.array(task, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["block", "task", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                sums[block] = sums.get(block, 0.0) + np.frombuffer(counts, np.float32).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "counts"])

    parts = rows.select("ids").mapInArrow(run, "block int, task int, counts binary").repartition("block")
    found = parts.sortWithinPartitions("block", "task").mapInArrow(add, "block int, counts binary").toArrow()
    sums = {b: np.frombuffer(c, float) for b, c in zip(found["block"].to_pylist(), found["counts"].to_pylist())}
    if not sums:
        return np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
    emit = np.concatenate([sums[b] for b in range(_BLOCKS)]).reshape(classes, states)
    rest = sums[_BLOCKS]
    return rest[:states], rest[states:].reshape(states, states), emit


def improved(counts: tuple[np.ndarray, np.ndarray, np.ndarray], words: Vocabulary) -> Model:
    """The maximising step, with one count of the unigram distribution per thousand of a state's own, and a tenth per move."""
    start, move, emit = counts
    smooth = np.maximum(emit.sum(axis=0), 1.0) * 1e-3
    emit = emit + words.unigram()[:, None] * smooth
    start, move = start + 0.1, move + 0.1
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def baum_welch(rows: DataFrame, words: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Model:
    model = first_model(words, states)
    for _ in range(rounds):
        model = improved(sum_expected(rows, model), words)
    return model


def forward_scores(rows: DataFrame, model: Model) -> DataFrame:
    """``row_id, doc_id, held_out, n_tokens, n_common, log_common, log_classes``: exact log10 probability of the classes."""
    shared = rows.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))

    def run(batches):
        own_model = Model(*shared.value)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for own, lengths, ids in _chunks(batch.column("ids").to_pylist()):
                now, logs = None, 0.0
                for piece, active in _pieces(lengths, ids):
                    scales, _, now = _forward(own_model, piece, active, now, False)
                    logs = logs + np.log10(scales).sum(axis=0)
                out[own] = logs
            columns = [batch.column(c) for c in names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out)], names)

    names = ["row_id", "doc_id", "held_out", "n_tokens", "n_common", "log_common", "log_classes"]
    kind = "row_id long, doc_id long, held_out boolean, n_tokens long, n_common long, log_common double, log_classes double"
    return rows.select("row_id", "doc_id", "held_out", "n_tokens", "n_common", "log_common", "ids").mapInArrow(run, kind)


def score_documents(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, common: int = COMMON_WORDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    All texts that are not held out are learned from, each whole. NULL and empty texts are an end alone. Counts of
    rare words are looked up by a join, so the model itself stays bounded. Without training texts all tokens are unknown.
    """
    counts = stored(count_words(docs.where(~held_out(F.col("doc_id")))), "word-counts")
    words = vocabulary(counts, common)
    rows = stored(encode(docs, words), "classes")
    model = baum_welch(rows.where(~F.col("held_out")), words, states, rounds)
    scores = forward_scores(rows, model)

    rare = rows.select("row_id", F.explode("rare").alias("word")).groupBy("row_id", "word").agg(F.count(F.lit(1)).alias("_times"))
    found = rare.join(counts, "word")
    found = found.groupBy("row_id").agg(
        F.sum(F.col("_times") * F.log10(F.col("n") + 1.0)).alias("_log"), F.sum("_times").alias("_known")
    )
    joined = scores.join(found, "row_id", "left")
    rare_log = F.coalesce("_log", F.lit(0.0))
    everything = math.log10(words.tokens + (words.distinct if words.tokens else 0) + 1)
    n_rare = F.col("n_tokens") - F.col("n_common")
    known = F.col("n_common") + F.coalesce("_known", F.lit(0)) if words.tokens else F.lit(0)
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        known.cast("bigint").alias("n_known"),
        F.lit(words.tokens).cast("bigint").alias("train_tokens"),
        (F.col("log_common") + rare_log - F.col("n_tokens") * F.lit(everything)).alias("base_score"),
        (F.col("log_classes") + rare_log - n_rare * F.lit(math.log10(words.rare_mass))).alias("score"),
    )

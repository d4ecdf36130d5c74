"""Token ids in files: ranks by frequency in whole bytes, lengths in separate control bytes, decoded by table lookup.

Encoding and decoding run in Arrow batches inside Spark tasks; files are Parquet tables of pages, so
they can lie wherever Spark writes.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alarmlens.cluster import scratch_path
from alarmlens.llm.common import stored, word_places

END_ID = 1
PAGE_IDS = 1 << 18  # ids after which a page ends; a longer document has a page of its own
CACHED_WORDS = 300_000  # words whose ids a worker remembers before it forgets those not met again: some 75 MB
_PER_CALL = 256  # words that go through the library in one string
_SIGNS = r"!-&(-/:;=?-@\[-`{-~"  # ASCII without ', which may stand for a contraction, and <, which may begin a special token
_LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"  # letters whose lower case is one letter
_PLAIN = rf"^[{_SIGNS}]*[{_LETTERS}]+[{_SIGNS}]*$"  # signs, letters and signs are a unit and a piece each


def _gather(pool: np.ndarray, spans: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some entries in a row, and how many each has."""
    starts, own = spans[0][which], spans[1][which]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(starts - ends + own, own)], own


class WordEncoder:
    """Ids of whole texts, from the ids of their distinct words.

    Where a vocabulary drops white space, the ids of a text are those of its words, one after the other, and each distinct word goes
    through the library once. Whether that holds, and whether case counts, is what ``word_rules`` reads from the tokenizer's settings; with any
    other tokenizer whole texts go through it.
    """

    def __init__(self, settings: str, by_word: bool, folds: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(settings)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids beyond 65,535 have no place in the packed form")
        self.by_word, self.folds = by_word, folds
        if by_word:
            # For plain units alone: the same model behind a cut at white space, which is all that they need. Units of ASCII stand for
            # their own bytes, and no special token can begin in them.
            bare = json.dumps({**json.loads(settings), "normalizer": None, "post_processor": None, "added_tokens": []})
            self.plain = Tokenizer.from_str(bare)
            to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            whole = pre_tokenizers.WhitespaceSplit()
            self.cuts = {True: whole, False: pre_tokenizers.Sequence([whole, to_bytes])}
            self.cut = None
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self, kept: np.ndarray | None = None):
        """Forget all words, or all but ``kept``."""
        words = list(self.place) if kept is not None and len(kept) else []
        self.place: defaultdict[bytes, int] = defaultdict(count(len(words) and len(kept)).__next__)
        if words:
            self.place.update((words[i], at) for at, i in enumerate(kept.tolist()))
            self.pool, own = _gather(self.pool, self.spans, kept)
            self.spans = np.stack([np.cumsum(own) - own, own])
        else:
            self.spans = np.empty((2, 0), np.int64)  # start in the pool and number of ids of each word
            self.pool = np.empty(0, np.uint16)
        self.again = np.zeros(len(self.place), bool)  # words met in more than one group of texts

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_plain(self, words: list[str]) -> np.ndarray:
        text = " ".join(words)
        if self.cut != text.isascii():
            self.cut = text.isascii()
            self.plain.pre_tokenizer = self.cuts[self.cut]
        return np.array(self.plain.encode_batch_fast([text.lower() if self.folds else text], add_special_tokens=False)[0].ids, np.uint16)

    def _learn(self, words: pa.Array) -> None:
        """Words of plain units share a call, parted again at the ends of their pieces; others have a call each."""
        is_plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        is_ascii = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        plain = np.concatenate([np.flatnonzero(is_plain & is_ascii), np.flatnonzero(is_plain & ~is_ascii)])
        some = words.take(pa.array(plain))
        before, behind = (pc.match_substring_regex(some, p).to_numpy(zero_copy_only=False) for p in (f"^[{_SIGNS}]", f"[{_SIGNS}]$"))
        parted = pc.replace_substring_regex(some, f"[{_LETTERS}]+", r" \0 ").to_numpy(zero_copy_only=False)
        units = 1 + before.astype(np.int64) + behind
        order, ids_of, sizes, alone = [], [], [], [np.flatnonzero(~is_plain)]
        for at in range(0, len(plain), _PER_CALL):
            chunk = plain[at : at + _PER_CALL]
            last = np.cumsum(units[at : at + _PER_CALL])
            ids = self._encode_plain(parted[at : at + _PER_CALL])
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != last[-1] or cuts[-1] != len(ids):
                alone.append(chunk)
                continue
            order.append(chunk)
            ids_of.append(ids)
            sizes.append(np.diff(cuts[last - 1], prepend=0))
        order.append(np.concatenate(alone))
        single = self._encode(words.take(pa.array(order[-1])).to_pylist())
        ids_of.append(np.fromiter(chain.from_iterable(single), np.uint16))
        sizes.append(np.fromiter(map(len, single), np.int64, len(single)))
        sizes = np.concatenate(sizes)
        spans = np.empty((2, len(words)), np.int64)
        spans[:, np.concatenate(order)] = len(self.pool) + np.cumsum(sizes) - sizes, sizes
        self.spans = np.concatenate([self.spans, spans], axis=1)
        self.pool = np.concatenate([self.pool, *ids_of])

    def _folded(self, texts: pa.Array) -> pa.Array:
        """Texts in lower case where that changes nothing: special tokens are told by their case, and so are some letters before
        combining marks."""
        if not self.folds:
            return texts
        as_they_are = pc.match_substring_regex(texts, r"<\||[\x{0300}-\x{037f}]")
        return pc.if_else(as_they_are, texts, pc.ascii_lower(texts))

    def batch(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many of them each text has."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not self.by_word:
            ids = self._encode([t or "" for t in texts.to_pylist()])
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.uint16, int(counts.sum())), counts
        if len(self.place) > CACHED_WORDS:
            kept = np.flatnonzero(self.again)
            self._forget(kept if len(kept) <= CACHED_WORDS // 2 else None)
        words, which, counts = word_places(self._folded(texts))
        known = len(self.place)
        place = np.fromiter(map(self.place.__getitem__, words.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.int64, len(words))
        new = place >= known
        self.again[place[~new]] = True
        if new.any():
            self._learn(words.filter(pa.array(new)))
            self.again = np.append(self.again, np.zeros(int(new.sum()), bool))
        which = place[which]
        ids, own = _gather(self.pool, self.spans, which)
        ends = np.concatenate([[0], np.cumsum(own)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


# The parts of tokenizer files that give the words of a text the same ids as the text. A pattern of the second form
# matches no white space.
_BY_SIGN = ("NFC", "Lowercase")
_SPACES = {"Regex": r"\s+"}
_NO_SPACE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _steps(settings: dict, part: str) -> list[dict]:
    step = settings[part]
    if step is None:
        return []
    inner = {"normalizer": "normalizers", "pre_tokenizer": "pretokenizers"}[part]
    return step[inner] if step["type"] == "Sequence" else [step]


def word_rules(text: str) -> tuple[bool, bool]:
    """Whether only white space parts words, none of it is kept, and no special token can span it; and whether case is dropped, too."""
    settings = json.loads(text)
    normal = _steps(settings, "normalizer")
    by_sign = all(
        n["type"] in _BY_SIGN or (n["type"] == "Replace" and n["pattern"] == _SPACES and n["content"] == " ") for n in normal
    )
    first, *rest = _steps(settings, "pre_tokenizer") or [{}]
    splits = first.get("type") == "Split" and first["pattern"] == {"Regex": _NO_SPACE}
    splits = splits and first["behavior"] == "Removed" and first["invert"]
    plain = [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
    special = all(t["content"].startswith("<|") and not set(t["content"]) & set(" \t\n\v\f\r") for t in settings["added_tokens"])
    special = special and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in settings["added_tokens"])
    return by_sign and splits and plain and special, any(n["type"] == "Lowercase" for n in normal)


def _groups(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with about ``size`` bytes each, so that memory follows the text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    start, before = 0, 0
    while start < len(texts):
        stop = min(int(np.searchsorted(ends, before + size)) + 1, len(texts))
        yield start, stop
        start, before = stop, int(ends[stop - 1])


@lru_cache(maxsize=1)
def _encoder(settings: str, by_word: bool, folds: bool) -> WordEncoder:
    """One per Python worker: the words that a task has learned serve the next one, too."""
    return WordEncoder(settings, by_word, folds)


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, ids``: the ids of each whole text with the end id, packed; NULL texts are empty.

    The driver reads the tokenizer's file; tasks get its content, so executors need not hold it. Texts stay in
    Arrow; about 1 MB of them is worked on at once.
    """
    text = Path(tokenizer_path).read_text(encoding="utf-8")
    settings = docs.sparkSession.sparkContext.broadcast((text, *word_rules(text)))

    def run(batches):
        encoder, pack = _encoder(*settings.value), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            keys, texts = batch.column("doc_id"), batch.column("text").cast(pa.string())
            for start, stop in _groups(texts):
                ids, counts = encoder.batch(texts.slice(start, stop - start))
                ends = np.cumsum(counts)
                packed = [
                    pack.compress(np.append(ids[e - n : e], np.uint16(END_ID)).tobytes()) for e, n in zip(ends, counts)
                ]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(start, stop - start), pa.array(packed, pa.binary())], ["doc_id", "ids"]
                )
            pa.default_memory_pool().release_unused()  # workers live on, and other tasks of the executor need it

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def _unpacked(column) -> Iterator[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    return (np.frombuffer(unpack.decompress(v), np.uint16) for v in column.to_pylist())


def frequencies(encoded: DataFrame) -> DataFrame:
    """``id, n`` over all documents: each task sums its own, as many rows as the vocabulary at most."""

    def run(batches):
        total, held, size = np.zeros(1 << 16, np.int64), [], 0
        for batch in batches:
            for ids in _unpacked(batch.column("ids")):
                held.append(ids)
                size += len(ids)
                if size > PAGE_IDS:
                    total += np.bincount(np.concatenate(held), minlength=1 << 16)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def rank_table(encoded: DataFrame) -> np.ndarray:
    """Ids in order of frequency, ties by id. One row per id of the vocabulary (65,536 at most) goes to the driver."""
    rows = frequencies(encoded).toArrow()
    ids, n = rows["id"].to_numpy(), rows["n"].to_numpy()
    return ids[np.lexsort((ids, -n))].astype(np.uint32)


# The length code of a value is its number of bytes less one; four codes share a control byte, the first in its low bits.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of some ranks."""
    code = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    four = np.ascontiguousarray(ranks.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return control.tobytes(), four[np.arange(4) <= code[:, None]].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The way back: lengths from the table of control bytes, then all values at once."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    four = np.zeros((n, 4), np.uint8)
    four[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return four.view("<u4").reshape(-1)


PAGES = "part int, first long, doc_ids array<bigint>, n_ids array<bigint>, control binary, data binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str) -> np.ndarray:
    """Write ``docs`` in ascending doc_id order (NULL first, then by their ids) below ``path``; return the rank table.

    Rows that share a doc_id are documents of their own. An empty table gives files without pages. Only ids cross
    the network: they are range-partitioned by doc_id. ``part`` and ``first`` (ids of the part before
    the page) come from the partition alone, so a task that runs again writes the same page.
    """
    encoded = stored(encode_documents(docs, tokenizer_path), "encoded")
    ids_by_rank = rank_table(encoded)
    rank_of = np.zeros(1 << 16, np.uint32)
    rank_of[ids_by_rank] = np.arange(len(ids_by_rank), dtype=np.uint32)

    def run(batches):
        part, first = TaskContext.get().partitionId(), 0
        keys, held, size = [], [], 0

        def page():
            control, data = pack_ranks(rank_of[np.concatenate(held)])
            row = [[part], [first], [keys], [[len(x) for x in held]], [control], [data]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = ["part", "first", "doc_ids", "n_ids", "control", "data"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for key, ids in zip(batch.column("doc_id").to_pylist(), _unpacked(batch.column("ids"))):
                if held and size + len(ids) > PAGE_IDS:
                    yield page()
                    first, keys, held, size = first + size, [], [], 0
                keys.append(key)
                held.append(ids)
                size += len(ids)
        if held:
            yield page()

    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, PAGES).write.option("compression", "zstd").parquet(path)
    return ids_by_rank


def read_token_files(spark: SparkSession, path: str, ids_by_rank: np.ndarray) -> DataFrame:
    """``part, in_part, doc_id, n_tokens, ids_crc32``: each document decoded from the files.

    ``in_part`` counts the ids of its part before the document. The table of ranks is as long as the
    vocabulary, so it travels with the tasks.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["n_ids"], np.int64)
                ids = ids_by_rank[unpack_ranks(row["control"], row["data"], int(n.sum()))]
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[e - k : e].astype("<u4").tobytes()) for e, k in zip(ends, n)]
                columns = [
                    pa.array(np.full(len(n), row["part"], np.int32)),
                    pa.array(row["first"] + ends - n),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(n),
                    pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "in_part", "doc_id", "n_tokens", "ids_crc32"])

    pages = spark.read.schema(PAGES).parquet(path)
    return pages.mapInArrow(run, "part int, in_part long, doc_id long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the token files and read them back: ``doc_id, start, n_tokens, ids_crc32``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    ids_by_rank = write_token_files(docs, tokenizer_path, path)
    sums = F.aggregate("n_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    parts = spark.read.schema(PAGES).parquet(path).groupBy("part").agg(F.sum(sums).alias("_ids"))
    # A row per written file; their order is that of the ids.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_base"))
    read = read_token_files(spark, path, ids_by_rank).join(F.broadcast(parts), "part")
    return read.select("doc_id", (F.col("_base") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")

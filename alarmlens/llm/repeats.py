"""Repeated byte strings by sorted suffixes at chosen places, merged by loser trees that keep common prefixes.

Every string of ``length`` bytes holds an anchor: the place of its smallest hashed k-gram. Equal strings have
their anchors at equal distances, so it is enough to sort what lies right of the anchors that
occur more than once. The sorted suffixes' common prefixes to the right, and those of what lies left of the anchors, tell which
strings are equal, byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlens.llm.common import small, stored, text_key

LENGTH, GRAM = 400, 100
_SPAN = 1 << 19  # bytes that a task hashes at once; longer texts go in pieces that overlap
RUN_BYTES = 16 << 20  # suffixes that a task sorts at once
BUCKET_BYTES = 16 << 20  # suffixes of one merge, on average
IDS = 1_000_000  # ids in a broadcast: at most 16 MB
_FEW = 24  # suffixes of one anchor that are compared one by one


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed polynomial hash of the ``gram`` bytes from each place on, by doubling."""
    factor = np.uint64(0x9E3779B97F4A7C15)
    power, width = factor, 1
    now = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    done, size, rest = None, 0, gram
    while rest:
        if rest & 1:
            if done is None:
                done, size = now, width
            else:  # longer blocks stand in front of those taken before
                n = len(data) - size - width + 1
                done = now[:n] * _power(factor, size) + done[width : width + n]
                size += width
        rest >>= 1
        if rest:
            n = len(now) - width
            now = now[:n] * power + now[width : width + n]
            power, width = power * power, 2 * width
    done = done ^ (done >> np.uint64(31))
    done = done * np.uint64(0xBF58476D1CE4E5B9)
    return done ^ (done >> np.uint64(29))


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    now, have = values, 1
    while 2 * have <= width:
        now = np.minimum(now[:-have], now[have:])
        have *= 2
    return np.minimum(now[: len(values) - width + 1], now[width - have :]) if have < width else now


def anchors_of(raws: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Which text, hash, anchor, first and last start: one entry per row of neighbouring strings with one anchor."""
    pieces = []  # text, offset, bytes
    for i, raw in enumerate(raws):
        for at in range(0, max(len(raw) - length + 1, 0), _SPAN):
            pieces.append((i, at, raw[at : at + _SPAN + length - 1]))
    found = []
    group, held = [], 0
    for piece in [*pieces, None]:
        if group and (piece is None or held + len(piece[2]) > 2 * _SPAN):
            found.append(_anchors(group, length, gram))
            group, held = [], 0
        if piece is not None:
            group.append(piece)
            held += len(piece[2])
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*found))


def _anchors(group, length, gram):
    data = np.frombuffer(b"".join(p[2] for p in group), np.uint8)
    sizes = np.array([len(p[2]) for p in group], np.int64)
    starts = np.cumsum(sizes) - sizes
    hashes = _gram_hashes(data, gram)
    # The high half of the hash decides, and the first place among equals: a matter of the bytes alone.
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    place = (_window_min(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    n = sizes - length + 1
    piece = np.repeat(np.arange(len(group)), n)
    first = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - starts, n)
    anchor = place[first]
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(piece) != 0)) + 1
    head, tail = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(first) - 1]])
    own = piece[head]
    text = np.array([p[0] for p in group], np.int64)[own]
    shift = np.array([p[1] for p in group], np.int64)[own] - starts[own]
    return text, hashes[anchor[head]].view(np.int64), anchor[head] + shift, first[head] + shift, first[tail] + shift


ANCHORS = "doc_id long, _text long, hash long, hi long, lo long, start long, left int, n int"


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per anchor: where its strings start (``n`` of them from ``start``, the anchor ``left`` bytes
    behind the first), and 128 bits of all bytes they cover."""

    def run(batches):
        for batch in batches:
            raws = [(t or "").encode() for t in batch.column("text").to_pylist()]
            text, hashes, anchor, first, last = anchors_of(raws, length, gram)
            digest = b"".join(xxhash.xxh3_128_digest(raws[t][a : b + length]) for t, a, b in zip(text.tolist(), first.tolist(), last.tolist()))
            halves = np.frombuffer(digest, np.int64).reshape(-1, 2)
            rows = pa.array(text)
            columns = [batch.column("doc_id").take(rows), batch.column("_text").take(rows), pa.array(hashes, pa.int64())]
            columns += [pa.array(np.ascontiguousarray(halves[:, i])) for i in (0, 1)]
            columns += [pa.array(first), pa.array((anchor - first).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ANCHORS.split(", ")])

    return docs.select("doc_id", text_key(F.col("text")).alias("_text"), "text").mapInArrow(run, ANCHORS)


RUNS = "bucket int, shared array<int>, rest array<binary>, before array<binary>, hi array<long>, lo array<long>, left array<int>, n array<int>"


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which the first ``known`` bytes are not looked at."""
    size = min(len(a), len(b))
    differ = int.from_bytes(a[known:size]) ^ int.from_bytes(b[known:size])
    return size - (differ.bit_length() + 7) // 8


def sorted_runs(rows: DataFrame, buckets: int, length: int) -> DataFrame:
    """Suffixes of the wanted anchors as sorted, front-coded runs, cut by ranges of the anchor's hash.

    A suffix is the hash and the bytes from the anchor on, as far as the strings reach; with it go the bytes before, backwards.
    """

    def run(batches):
        held, size = [], 0

        def out():
            held.sort(key=lambda x: x[0])
            columns, before, last = {}, b"", -1
            for key, back, hi, lo, left, n in held:
                bucket = int.from_bytes(key[:8]) * buckets >> 64
                if bucket != last:
                    before, last = b"", bucket
                    columns[bucket] = [[] for _ in range(7)]
                shared = _common(before, key, 0)
                for column, value in zip(columns[bucket], (shared, key[shared:], back, hi, lo, left, n)):
                    column.append(value)
                before = key
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            names = ["shared", "rest", "before", "hi", "lo", "left", "n"]
            arrays = [pa.array([c[i] for c in columns.values()], pa.list_(k)) for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([pa.array(list(columns), pa.int32()), *arrays], ["bucket", *names])

        for batch in batches:
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                raw = text.encode()
                for w in wanted:
                    a, left = w["start"], w["left"]
                    key = (w["hash"] % (1 << 64)).to_bytes(8) + raw[a + left : a + w["n"] - 1 + length]
                    held.append((key, raw[a : a + left][::-1], w["hi"], w["lo"], left, w["n"]))
                    size += len(key) + left
                    if size > RUN_BYTES:
                        yield out()
                        held, size = [], 0
        yield out()

    return rows.select("text", "wanted").mapInArrow(run, RUNS)


def merge_runs(runs: list[Iterator[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """Merge front-coded runs by a tree of losers; yields the prefix shared with the one before, the key, its payload.

    Every candidate remembers how much it shares with the last winner. The one that shares more is the smaller; only of
    equals are further bytes compared, from the known prefix on, so no byte is compared twice on a path.
    """
    k = 1
    while k < len(runs):
        k *= 2
    keys: list[bytes | None] = [None] * k
    loads: list[object] = [None] * k
    prefix = [0] * k
    tails: list[bytes] = [b""] * k

    def advance(i):
        step = next(runs[i], None) if i < len(runs) else None
        if step is None:
            keys[i], prefix[i] = None, -1
        else:
            shared, rest, loads[i] = step
            keys[i] = tails[i] = tails[i][:shared] + rest
            prefix[i] = shared  # the run's last key has just won

    def beats(a, b):
        """Whether ``a`` stays ahead; the loser's prefix becomes that with the winner."""
        if prefix[a] != prefix[b]:
            return prefix[a] > prefix[b]
        if keys[a] is None:
            return True
        x, y = keys[a], keys[b]
        shared = _common(x, y, prefix[a])
        first = len(x) <= len(y) if shared == min(len(x), len(y)) else x[shared] < y[shared]
        prefix[b if first else a] = shared
        return first

    for i in range(k):
        advance(i)
    losers = [0] * k

    def play(node):
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        won = beats(a, b)
        losers[node] = b if won else a
        return a if won else b

    winner = play(1) if k > 1 else 0
    while keys[winner] is not None:
        yield prefix[winner], keys[winner], loads[winner]
        advance(winner)
        node = (winner + k) // 2
        while node:
            if not beats(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


def equal_strings(shared: list[int], keys: list[bytes], loads: list[tuple], length: int) -> list[list[tuple[int, int]]]:
    """For each suffix of one anchor, in sorted order: which of its strings occur at another one, as ranges of the bytes before the anchor."""
    g = len(keys)
    high = np.array([x[3] for x in loads])
    low = high - np.array([x[4] for x in loads]) + 1
    right = np.array(shared) - 8
    before = [x[0] for x in loads]
    if g <= _FEW:
        found: list[list[tuple[int, int]]] = [[] for _ in range(g)]
        for i in range(g):
            ahead = length
            for j in range(i + 1, g):
                ahead = min(ahead, int(right[j]))
                most = _common(before[i], before[j], 0)
                for one in (i, j):
                    a, b = max(length - ahead, int(low[one])), min(most, int(high[one]))
                    if a <= b:
                        found[one].append((a, b))
        return found
    # Classes of suffixes that share enough to the right, and of those that share enough to the left, for each distance.
    order = sorted(range(g), key=before.__getitem__)
    back = np.array([-1] + [_common(before[a], before[b], 0) for a, b in zip(order, order[1:])])
    have_left, have_right = np.array([len(b) for b in before]), np.array([len(k) - 8 for k in keys])
    hit = np.zeros((g, int(high.max()) + 2), bool)
    for left in range(int(high.max()) + 1):
        ahead = np.cumsum(right < length - left)
        behind = np.empty(g, np.int64)
        behind[order] = np.cumsum(back < left)
        there = np.flatnonzero((have_left >= left) & (have_right >= length - left))
        _, name, times = np.unique(ahead[there] * (g + 1) + behind[there], return_inverse=True, return_counts=True)
        hit[there, left] = times[name] > 1
    hit &= (np.arange(hit.shape[1]) >= low[:, None]) & (np.arange(hit.shape[1]) <= high[:, None])
    found = []
    for row in hit:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], row]).astype(np.int8)))
        found.append([(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2])])
    return found


MATCHES = "hash long, hi long, lo long, nearest int, farthest int"


def matches(runs: DataFrame, buckets: int, length: int) -> DataFrame:
    """Merge the runs of each bucket and compare neighbours: ranges of repeated strings by anchor and covered bytes."""

    def run(batches):
        def merged(rows):
            def walk(row):
                loads = zip(row["before"], row["hi"], row["lo"], row["left"], row["n"])
                return iter(list(zip(row["shared"], row["rest"], loads)))

            rows_out = [[] for _ in range(5)]

            def close():
                if len(keys) > 1:
                    number = int.from_bytes(keys[0][:8], signed=True)
                    for ranges, load in zip(equal_strings(shared, keys, loads, length), loads):
                        for a, b in ranges:
                            for column, value in zip(rows_out, (number, load[1], load[2], a, b)):
                                column.append(value)

            shared, keys, loads = [], [], []
            for common, key, load in merge_runs([walk(r) for r in rows]):
                if common < 8 and keys:
                    close()
                    shared, keys, loads = [], [], []
                shared.append(common)
                keys.append(key)
                loads.append(load)
            close()
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows_out, kinds)], [c.split()[0] for c in MATCHES.split(", ")])

        bucket, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket and rows:
                    yield merged(rows)
                    rows = []
                bucket = row["bucket"]
                rows.append(row)
        if rows:
            yield merged(rows)

    return runs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, MATCHES)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, _text, spans``: for each text with repeated strings the byte ranges ``[from, to)`` they cover, unmerged."""
    found = stored(anchors(docs, length, gram), "anchors")
    counts = found.groupBy("hash").agg(F.count(F.lit(1)).alias("_n"), F.min("hi").alias("_a"), F.max("hi").alias("_b")).where("_n > 1")
    again = stored(counts.select("hash", (F.col("_a") != F.col("_b")).alias("mixed")), "again")
    again = stored(found.join(small(again), "hash"), "repeated-anchors")
    place = F.struct("doc_id", "_text", "start", "left", "n")
    variants = again.groupBy("hash", "hi", "lo", "mixed").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("at"))
    variants = stored(variants, "variants")

    # One example of each text around an anchor that has several.
    wanted = variants.where("mixed").select("hash", "hi", "lo", "at.*")
    size = wanted.agg(F.sum(F.col("left") + F.col("n") + F.lit(length))).first()[0] or 0
    wanted = wanted.groupBy("doc_id", "_text").agg(F.collect_list(F.struct("hash", "hi", "lo", "start", "left", "n")).alias("wanted"))
    wanted = stored(wanted, "wanted")
    # Rows that repeat a document give the same example twice; one is enough.
    texts = _with(docs, wanted).dropDuplicates(["doc_id", "_text"])
    buckets = max(1, -(-size // BUCKET_BYTES))
    runs = stored(sorted_runs(texts, buckets, length), "runs")
    ranges = stored(matches(runs, buckets, length), "matches")

    keys = ["hash", "hi", "lo"]
    whole = again.join(small(variants.where("times > 1").select(*keys)), keys)
    whole = whole.select("doc_id", "_text", F.col("start").alias("from"), (F.col("start") + F.col("n") - 1 + length).alias("to"))
    anchor = F.col("start") + F.col("left")
    single = variants.where("times = 1 and mixed").select(*keys, "at.*").join(ranges, keys)
    single = single.select("doc_id", "_text", (anchor - F.col("farthest")).alias("from"), (anchor - F.col("nearest") + length).alias("to"))
    spans = whole.unionByName(single).distinct()
    return spans.groupBy("doc_id", "_text").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key(F.col("text")).alias("_text"), "text")


def _same(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["_text"] == right["_text"])


def _with(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``found`` has a row for, with its last column; only their texts are shuffled."""
    rows = _keyed(docs)
    ids = small(found.select("doc_id", "_text"), IDS)
    rows = rows.join(ids, _same(rows, ids), "left_semi")
    last = found.columns[-1]
    return rows.join(found, _same(rows, found)).select(rows["doc_id"], rows["_text"], "text", last)


_CUT = "struct<kept: binary, n_bytes: bigint, n_removed: bigint, n_spans: bigint>"


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans`` for each row of ``docs``; ``kept`` holds the bytes that stay.

    A byte goes if a string of ``length`` bytes over it also starts elsewhere, in this row or another one; that includes rows that
    repeat a document whole. Spans that touch or overlap count once. NULL texts are empty; texts shorter than ``length`` stay.
    """

    @F.arrow_udf(_CUT)
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        columns = [[], [], [], []]
        for text, own in zip(texts.to_pylist(), spans.to_pylist()):
            raw, at, removed, merged, kept = text.encode(), 0, 0, 0, []
            for a, b in sorted((s["from"], s["to"]) for s in own):
                if a > at or not merged:
                    merged += 1
                    kept.append(raw[at:a])
                removed += max(0, b - max(a, at))
                at = max(at, b)
            kept.append(raw[at:])
            for column, value in zip(columns, (b"".join(kept), len(raw), removed, merged)):
                column.append(value)
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kept", "n_bytes", "n_removed", "n_spans"])

    spans = stored(repeated_spans(docs, length, gram), "spans")
    hit = _with(docs, spans).select("doc_id", cut(F.col("text"), F.col("spans")).alias("c")).select("doc_id", "c.*")
    rows = _keyed(docs)
    ids = small(spans.select("doc_id", "_text"), IDS)
    text = F.coalesce("text", F.lit("")).cast("binary")
    none = F.lit(0).cast("bigint")
    clean = rows.join(ids, _same(rows, ids), "left_anti").select(
        "doc_id", text.alias("kept"), F.length(text).cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans")
    )
    return hit.unionByName(clean)

"""N-gram Jaccard join: sparse products of documents by n-grams, in blocks of documents that can be linked at all.

Equal sets are merged first. The sizes of two linked sets bound by how many n-grams they differ. N-grams are dealt by hash into
more parts than that, so linked sets agree in whole parts, and in more than one; sets that agree in one of their rarer parts
form groups. Only inside a group are overlaps counted, by products of blocks of the incidence matrix, after pairs of too
different sizes are discarded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlens.cluster import at_most
from alarmlens.llm.common import BROADCAST_ROWS, small, stored, text_key

WINDOW, PERCENT = 4, 85
GROWTH = 1.6  # sizes of one class differ by less than this factor, or by what a link allows if that is more
BUCKETS = 12  # upper bits of a mark, by which postings are dealt; 32 lower bits are sent
SENT = 1_000_000  # marks that a task packs at once, 12 MB
SEEN = 1_000_000  # sets that a task remembers, so that it gives the marks of copies once
BLOCK_GRAMS = 4_000_000  # n-grams of one block; 32 MB of hashes
IDS = 2_000_000  # hashed ids in a broadcast
PILOTS = 8  # a cut group's pilots, which join every block of it, take this part of a block


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_FACTOR, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


class Hasher:
    """Sets of hashed n-grams of words.

    A word's hash is a polynomial over its bytes, taken from running sums over the whole text, so that no
    word is touched on its own.
    """

    def __init__(self, window: int):
        self.window = window
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        ones = np.ones(n, np.uint64)
        ones[1:] = _FACTOR
        self.up = np.multiply.accumulate(ones)
        ones[1:] = _INVERSE
        self.down = np.multiply.accumulate(ones)

    def __call__(self, raw: bytes | None) -> np.ndarray:
        data = np.frombuffer(raw or b"", np.uint8)
        inside = np.concatenate([[False], ~_SPACE[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.empty(0, np.uint64)
        if len(data) > len(self.up):
            self._grow(2 * len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * self.up[: len(data)], out=sums[1:])
        codes = (sums[ends] - sums[starts]) * self.down[starts]
        codes ^= (ends - starts).astype(np.uint64) << np.uint64(48)
        width = min(self.window, len(codes))
        mixed = np.full(len(codes) - width + 1, np.uint64(width))
        for k in range(width):
            mixed = (mixed ^ codes[k : len(codes) - width + 1 + k]) * np.uint64(_FACTOR)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


SIGNATURES = "doc_id long, _text long, n long, node long"
_POSTING = np.dtype([("mark", "<u4"), ("node", "<i8")])


def _node(grams: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(grams.tobytes()), "big", signed=True)


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    values = (values ^ np.uint64(salt)) * np.uint64(_FACTOR)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def _width(percent: int) -> tuple[float, float]:
    """Logarithms: by how much the sizes of linked sets, and those of one class, can differ."""
    link = math.log(100 / (percent - 0.1))
    return link, max(link, math.log(GROWTH))


def _classes(n: int, percent: int) -> range:
    """Size classes in which a set of ``n`` n-grams has marks: its own, and that of the largest sets it can be linked with."""
    link, width = _width(percent)
    return range(math.floor(math.log(n) / width), math.floor((math.log(n) + link) / width) + 1)


@lru_cache(None)
def _shape(kind: int, percent: int) -> tuple[int, int, int]:
    """Of a size class: the parts that n-grams are dealt into, the marks that a set has, and how many of these it can spare.

    Linked sets of a class differ by at most ``apart`` n-grams, so all parts but ``apart`` are equal. No part if only equal sets can be linked.
    """
    apart = int(2 * math.exp((kind + 1) * _width(percent)[1]) * (100 - percent) / (100 + percent) + 1e-6)
    spare = apart // 4
    given = apart + 1 + spare
    return (given + 1 + apart // 2 if apart else 0), given, spare


def marks_of(grams: np.ndarray, percent: int) -> np.ndarray:
    """Marks of a set. Two linked but different sets share more marks of a class than a set of it can spare; see ``_shape``.

    A mark is the number and content of a part. A set leaves out its parts with the fewest n-grams, empty ones first. That order is
    the same for all sets, so the parts in which two sets agree lose no more than one set leaves out, not twice that.
    The lowest bit tells the two classes of a set apart.
    """
    found = []
    for kind in _classes(len(grams), percent):
        parts, given, _ = _shape(kind, percent)
        if not parts:
            continue
        mixed = _mixed(grams, kind + 2)
        part = (((mixed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        filled, order = np.bincount(part, minlength=parts), np.argsort(part, kind="stable")
        sums, ends = np.append(np.uint64(0), np.cumsum(_mixed(mixed[order], 1))), np.cumsum(filled)
        content = sums[ends] - sums[ends - filled]
        marks = _mixed(content ^ _mixed(np.arange(parts, dtype=np.uint64), kind + 7), kind + 3) >> np.uint64(32 - BUCKETS)
        marks = marks.view(np.int64) & ~1 | kind & 1
        found.append(marks[np.lexsort((marks, -filled))[:given]])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def signatures(docs: DataFrame, window: int) -> DataFrame:
    """Each row's set size and the name of its set (``node``)."""

    def run(batches):
        hasher = Hasher(window)
        for batch in batches:
            n, node = [], []
            for text in _texts(batch):
                grams = hasher(text)
                n.append(len(grams))
                node.append(_node(grams) if len(grams) else None)
            columns = [batch.column("doc_id"), batch.column("_text"), pa.array(n, pa.int64()), pa.array(node, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_text", "n", "node"])

    return docs.select("doc_id", text_key(F.col("text")).alias("_text"), "text").mapInArrow(run, SIGNATURES)


def postings(docs: DataFrame, window: int, percent: int) -> DataFrame:
    """``bucket, packed``: marks with their sets, 12 bytes each; a row has those of a bucket that a task has met together.

    A task gives the marks of a set that it meets again once, so copies cost few marks.
    """

    def packed(nodes, marks):
        node, mark = np.repeat(np.array(nodes, np.int64), [len(m) for m in marks]), np.concatenate(marks)
        order = np.argsort(mark)
        mark, rows = mark[order], np.empty(len(mark), _POSTING)
        rows["mark"], rows["node"] = mark & 0xFFFFFFFF, node[order]
        bucket, first = np.unique(mark >> 32, return_index=True)
        ends = (np.append(first, len(rows)) * _POSTING.itemsize).astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(bucket), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), binary], ["bucket", "packed"])

    def run(batches):
        hasher, seen = Hasher(window), set()
        nodes, marks, held = [], [], 0
        for batch in batches:
            for text in _texts(batch):
                grams = hasher(text)
                node = _node(grams) if len(grams) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                nodes.append(node)
                marks.append(marks_of(grams, percent))
                held += len(marks[-1])
                if held >= SENT:
                    yield packed(nodes, marks)
                    nodes, marks, held = [], [], 0
            if len(seen) > SEEN:
                seen = set()
        if held:
            yield packed(nodes, marks)

    return docs.select("text").mapInArrow(run, "bucket long, packed binary")


def shared_marks(rows: DataFrame) -> DataFrame:
    """``node, mark, sets``: marks that more than one set has, and how many have it, from ``postings``. A bucket is held in one task."""

    def matched(bucket, held):
        rows = np.frombuffer(b"".join(held), _POSTING)
        order = np.argsort(rows["mark"])
        mark = rows["mark"][order]
        again = mark[1:] == mark[:-1]
        rows = rows[order[np.append(again, False) | np.append(False, again)]]
        rows = rows[np.lexsort((rows["node"], rows["mark"]))]
        fresh = np.ones(len(rows), bool)  # copies of a set in several tasks are one
        fresh[1:] = rows[1:] != rows[:-1]
        rows = rows[fresh]
        _, place, sets = np.unique(rows["mark"], return_inverse=True, return_counts=True)
        sets = sets[place]
        rows, sets = rows[sets > 1], sets[sets > 1]
        return rows["node"], rows["mark"].astype(np.int64) | bucket << 32, sets

    def out(found):
        columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)]
        return pa.RecordBatch.from_arrays(columns, ["node", "mark", "sets"])

    def run(batches):
        bucket, held, found = None, [], []
        for batch in batches:
            for key, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
                if key != bucket and held:
                    found.append(matched(bucket, held))
                    held = []
                    if len(found) == 64:
                        yield out(found)
                        found = []
                bucket = key
                held.append(packed)
        if held:
            yield out([*found, matched(bucket, held)])

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "node long, mark long, sets long")


def rarer_marks(shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``node, marks``: the shared marks of each set without the most frequent ones of a class, as many as it can spare.

    Linked sets share more marks than that. The rarest of these has as many as a set can spare behind it in both, so both keep it.
    """
    lists = shared.groupBy("node").agg(F.collect_list(F.struct("sets", "mark")).alias("shared")).join(nodes.select("node", "n"), "node")

    def run(batches):
        for batch in batches:
            lists, n = batch.column("shared"), batch.column("n").to_pylist()
            each = lists.flatten()
            sets, mark = each.field("sets").to_numpy(), each.field("mark").to_numpy()
            kind = 2 * np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy()) + (mark & 1)
            order = np.lexsort((mark, sets, kind))
            mark, kind = mark[order], kind[order]
            spare = {(i, k & 1): _shape(k, percent)[2] for i in set(n) for k in _classes(i, percent)}
            kinds, first, count = np.unique(kind, return_index=True, return_counts=True)
            left = count - np.array([spare[n[k >> 1], k & 1] for k in kinds.tolist()], np.int64)
            stays = np.arange(len(mark)) - np.repeat(first, count) < np.repeat(left, count)
            ends = np.append(0, np.cumsum(np.bincount(kind[stays] >> 1, minlength=len(n))))
            marks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(mark[stays], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), marks], ["node", "marks"])

    return lists.mapInArrow(run, "node long, marks array<long>").where(F.size("marks") > 0)


def touching(marks: DataFrame) -> DataFrame:
    """``node, other``: sets that share a mark, each with the first one that has it, from rows ``node, marks``.

    Postings are ordered by mark and set over all tasks and read as a stream, so a mark of any number of sets is split among tasks.
    Each task links to the first set of a mark that it sees; where a mark goes on in the next task, these first sets are linked, too.
    """

    def stars(batches):
        last_mark = last_leader = None
        for batch in batches:
            mark, node = batch.column("mark").to_numpy(), batch.column("node").to_numpy()
            if not len(mark):
                continue
            new = np.append(True, mark[1:] != mark[:-1])
            goes_on = last_mark is not None and mark[0] == last_mark
            new[0] = not goes_on
            firsts = node[new]
            leader = np.append([last_leader] if goes_on else firsts[:0], firsts)[np.cumsum(new) - (0 if goes_on else 1)]
            linked = leader != node
            edge = np.zeros(int(linked.sum()), bool)
            columns = [node[linked], leader[linked], np.zeros(len(edge), np.int64), edge]
            if last_mark is None:  # the first mark of the task may go on from the one before
                columns = [np.append(c, v) for c, v in zip(columns, (node[0], node[0], mark[0], True))]
            last_mark, last_leader = mark[-1], leader[-1]
            yield _edges(*columns)
        if last_mark is not None:
            yield _edges(*[np.array([v]) for v in (last_leader, last_leader, last_mark, True)])

    def _edges(node, other, mark, border):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((node, other, mark, border), kinds)], ["node", "other", "mark", "border"])

    postings = marks.select("node", F.explode("marks").alias("mark"))
    ordered = postings.repartitionByRange("mark", "node").sortWithinPartitions("mark", "node")
    # Links have no mark, so those of many marks are one row before they are shuffled or written.
    found = ordered.mapInArrow(stars, "node long, other long, mark long, border boolean").distinct()
    found = stored(found, "stars")
    borders = found.where("border").select("mark", "node")  # two rows a task
    lead = borders.groupBy("mark").agg(F.min("node").alias("other"))
    across = borders.join(lead, "mark").where("node <> other").select("node", "other")
    return found.where("not border").select("node", "other").unionByName(across)


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, root`` for every end of an edge ``(node, other)``: the smallest node that can be reached.

    Labels go to neighbours; all nodes of one label take the smallest label that any of them has met, so whole clusters merge in a
    round; then labels jump to their label's label. All are joins and partial minima, until a round changes none;
    each round is written to the shared folder. Nothing but a count comes to the driver.
    """
    both = edges.select("node", "other").unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
    both = stored(both.where("node <> other").distinct(), f"{name}-edges")
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root")), f"{name}-labels")
    while True:
        seen = both.join(labels.withColumnsRenamed({"node": "other"}), "other").groupBy("node").agg(F.min("root").alias("seen"))
        near = labels.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        near = stored(near, f"{name}-near")
        met = near.where("root <> old").groupBy("old").agg(F.min("root").alias("met"))
        near = near.join(met, "old", "left").select("node", "old", F.coalesce("met", "root").alias("root"))
        jump = near.select(F.col("node").alias("root"), F.col("root").alias("far"))
        labels = near.join(jump, "root", "left").select("node", "old", F.coalesce("far", "root").alias("root"))
        labels = stored(labels, f"{name}-labels")
        if labels.where("root <> old").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")


def _links(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """What exact links join among the sets of one block, as stars: each set with the first one of its kind.

    Sets are rows of a sparse incidence matrix. Rows reached by a link are multiplied, some at a time, with all rows that no
    link has reached yet; overlaps are summed by n-gram. A row stands in one product, and rows
    once reached leave the other side, so a group of near copies costs a few products, not all pairs.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    nodes, sets, sizes = nodes[order], [sets[i] for i in order], sizes[order]
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])

    def by_column(alive):
        keep = alive[row]
        c, r = column[keep], row[keep]
        by = np.argsort(c, kind="stable")
        return np.searchsorted(c[by], np.arange(column.max() + 2)), r[by]

    alive = np.ones(len(sets), bool)
    pointers, rows = by_column(alive)
    indexed = len(sets)
    frontier: list[int] = []
    next_seed = seed = 0
    while True:
        if not frontier:
            while next_seed < len(sets) and not alive[next_seed]:
                next_seed += 1
            if next_seed == len(sets):
                return
            frontier, seed = [next_seed], int(nodes[next_seed])
            alive[next_seed] = False
        left = int(alive.sum())
        if not left:
            return
        if left < indexed // 2:
            pointers, rows = by_column(alive)
            indexed = left
        i = frontier.pop()
        own = column[starts[i] : starts[i + 1]]
        low, high = pointers[own], pointers[own + 1]
        n = high - low
        total = int(n.sum())
        if not total:
            continue
        place = np.arange(total) - np.repeat(np.cumsum(n) - n - low, n)
        overlap = np.bincount(rows[place], minlength=len(sets))
        near = np.flatnonzero(alive & (overlap > 0) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])))
        shared = overlap[near]
        near = near[100 * shared >= percent * (sizes[near] + sizes[i] - shared)]
        alive[near] = False
        frontier.extend(near.tolist())
        for j in near.tolist():
            yield seed, int(nodes[j])


def linked(blocks: DataFrame, window: int, percent: int) -> DataFrame:
    """``node, other`` from rows ``block, node, packed``; a block is held in one task and bounded by its making.

    Sets are made from the texts here, as these are smaller on the way; rows whose set is not that of ``node`` go.
    """

    def run(batches):
        unpack, hasher = zstandard.ZstdDecompressor(), Hasher(window)
        block, nodes, sets = None, {}, []

        def out():
            pairs = list(_links(np.array(list(nodes)), sets, percent)) if len(nodes) > 1 else []
            a, b = zip(*pairs) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["node", "other"])

        for batch in batches:
            for key, node, text in zip(*(batch.column(c).to_pylist() for c in ("block", "node", "packed"))):
                if key != block:
                    if len(nodes) > 1:
                        yield out()
                    block, nodes, sets = key, {}, []
                if node not in nodes:
                    grams = hasher(unpack.decompress(text))
                    if len(grams) and _node(grams) == node:
                        nodes[node] = True
                        sets.append(grams)
        yield out()

    return blocks.select("block", "node", "packed").mapInArrow(run, "node long, other long")


def packed_texts(rows: DataFrame) -> DataFrame:
    """``node, blocks, packed``: texts as they travel to their blocks, a fraction of the size of their hashed sets."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = pa.array([pack.compress(t or b"") for t in _texts(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("blocks"), texts], ["node", "blocks", "packed"])

    return rows.select("node", "blocks", "text").mapInArrow(run, "node long, blocks array<long>, packed binary")


def with_texts(docs: DataFrame, wanted: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``wanted`` (``lowest, node, blocks``) with the texts of its ids. Beyond ``rows`` texts are shuffled, but none of other ids."""
    texts = docs.select(F.col("doc_id").alias("lowest"), "text")
    if not at_most(wanted, rows):
        ids = wanted.select(F.xxhash64("lowest").alias("_key")).distinct()
        if at_most(ids, IDS):
            texts = texts.join(F.broadcast(ids), F.xxhash64(texts["lowest"]) == ids["_key"], "left_semi")
    return texts.join(small(wanted, rows), texts["lowest"].eqNullSafe(wanted["lowest"]))


def links_in_blocks(docs: DataFrame, wanted: DataFrame, window: int, percent: int) -> DataFrame:
    """Links among the sets ``wanted`` (``lowest, node, blocks``): the text of each set goes to all its blocks."""
    dealt = packed_texts(with_texts(docs, wanted)).withColumn("block", F.explode("blocks")).select("block", "node", "packed")
    return linked(dealt.repartition("block").sortWithinPartitions("block", "node"), window, percent)


def _numbers(n: Column) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), n - 1)


def _own(pieces: Column, salt: str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), pieces)


def first_blocks(sets: DataFrame) -> DataFrame:
    """A group within the bound is one block. A larger one is cut, and its pilots stand in every piece, so that pieces of near copies connect."""
    pieces = F.col("pieces")
    pilot = (pieces > 1) & (_own(pieces * PILOTS, "pilot") == 0)
    numbers = F.when(pilot, _numbers(pieces)).otherwise(F.array(_own(pieces, "piece")))
    return sets.select("lowest", "node", F.transform(numbers, lambda i: F.xxhash64("root", i)).alias("blocks"))


def rest_blocks(sets: DataFrame, reached: DataFrame, block_grams: int) -> DataFrame:
    """Blocks in which the sets outside the largest cluster of a cut group meet all sets of it; none if it is one cluster.

    What the pilots connected needs no block, so the copies made follow the size of the rest, not the square of the group.
    """
    cut = sets.where("pieces > 1").join(reached.withColumnRenamed("root", "_cluster"), "node", "left")
    cut = stored(cut.withColumn("cluster", F.coalesce("_cluster", "node")).drop("_cluster"), "clusters")
    sums = cut.groupBy("root", "cluster").agg(F.sum("n").alias("grams"))
    groups = sums.groupBy("root").agg(F.max(F.struct("grams", "cluster")).alias("main"), F.sum("grams").alias("all"))
    groups = groups.where(F.col("all") > F.col("main.grams")).select(
        "root",
        F.col("main.cluster").alias("main"),
        F.ceil((F.col("all") - F.col("main.grams")) / F.lit(block_grams)).cast("bigint").alias("slices"),
    )
    found = cut.join(small(groups), "root")
    block = lambda i, j: F.xxhash64("root", F.lit("rest"), i, j)
    every = F.transform(_numbers(F.col("slices")), lambda i: block(i, _own(F.col("pieces"), "piece")))
    rest = F.transform(_numbers(F.col("pieces")), lambda j: block(_own(F.col("slices"), "slice"), j))
    blocks = F.when(F.col("cluster") == F.col("main"), every).otherwise(F.array_union(every, rest))
    return found.select("lowest", "node", blocks.alias("blocks"))


def jaccard_components(docs: DataFrame, window: int = WINDOW, percent: int = PERCENT, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``; see ``jaccard_groups``."""
    return jaccard_groups(docs, window, percent, block_grams).select("doc_id", "n_shingles", "component_id")


def jaccard_groups(docs: DataFrame, window: int = WINDOW, percent: int = PERCENT, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """``doc_id, _text, n_shingles, component_id, leads`` for each row of ``docs``; ``_text`` is the key of its text.

    Two rows link when their sets of distinct ``window``-word n-grams overlap by ``percent`` of their union; fewer words are
    one n-gram. Rows that repeat a doc_id are rows of their own that share an id. NULL, empty and blank texts have an empty set, link
    with nothing and are their own component. NULL ids are never the smallest; a component of them alone has a NULL id. ``leads`` marks
    the row of each component with the smallest id (NULL last) and, of these, the smallest key; equal rows are marked alike.
    """
    marks = stored(signatures(docs, window), "signatures")
    full = marks.where("n > 0")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_text")
    nodes = stored(full.groupBy("node").agg(F.min(row).alias("leader"), F.min("n").alias("n")), "nodes")
    nodes = nodes.select("node", F.col("leader.doc_id").alias("lowest"), "leader", "n")
    shared = shared_marks(postings(docs, window, percent))
    touch = touching(stored(rarer_marks(shared, nodes, percent), "marks"))
    groups = components(touch, "touch")

    # How many pieces a group is cut into, from the n-grams of all its sets.
    sized = groups.join(nodes.drop("leader"), "node")
    pieces = sized.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(block_grams)).cast("bigint").alias("pieces"))
    sets = stored(sized.join(pieces, "root").select("lowest", "node", "n", "root", "pieces"), "wanted")
    links = stored(links_in_blocks(docs, first_blocks(sets), window, percent), "links")
    linked_nodes = components(links, "links")
    if not sets.where("pieces > 1").isEmpty():
        wanted = stored(rest_blocks(sets, linked_nodes, block_grams), "rest")
        if not wanted.isEmpty():
            more = links_in_blocks(docs, wanted, window, percent).union(linked_nodes.select("node", F.col("root").alias("other")))
            linked_nodes = components(stored(more, "more-links"), "more-links")

    first = linked_nodes.join(nodes, "node").groupBy("root").agg(F.min("leader").alias("first"))
    named = linked_nodes.join(first, "root").select("node", "first")
    ids = nodes.join(named, "node", "left").select("node", F.coalesce("first", "leader").alias("first"))
    ids = stored(ids, "components")
    filled = F.col("n") > 0
    return (
        marks.select("doc_id", "_text", "n", "node")
        .join(small(ids), "node", "left")
        .select(
            "doc_id",
            "_text",
            F.col("n").alias("n_shingles"),
            F.when(filled, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
            F.when(filled, row.eqNullSafe(F.col("first"))).otherwise(F.lit(True)).alias("leads"),
        )
    )

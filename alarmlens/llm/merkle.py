"""Merkle manifest of a data set: a tree of digests per source, one tree over the sources, and a proof per row.

Nodes are numbered inside their tree. The window functions work inside blocks of 243 consecutive numbers, on which five
levels of runs of three nest, so that no task holds a tree, however large its source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.cluster import attach
from alarmlens.limits import DEFAULT_LIMITS
from alarmlens.llm.common import crc_of_id, small, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")  # fixed: what a leaf covers, in this order
RUN = 3  # fixed: nodes under one parent
HEIGHT = 5
BLOCK = RUN**HEIGHT
_TREE = ("_tree", "_pos", "_n", "_digest")
_PATH = "array<struct<left:string,right:string>>"


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root, digest of the proof and outcome of the check, for each row of ``docs``.

    NULL fields count as ``-``. Rows that share a source and a doc_id are ordered by their leaf; equal rows are leaves of their own. A
    NULL doc_id comes first and counts as the empty text in the choice of rows that are tampered with. Texts of any length are hashed
    whole and go into no shuffle. Other columns are neither read nor returned. An empty table gives no rows.
    """
    rows = stored(_leaves(docs), "leaves")
    sources = stored(rows.groupBy("source").agg(F.count(F.lit(1)).alias("_n")), "sources")
    sources = stored(_numbered(sources, [], ["source"]).withColumnRenamed("_pos", "_tree"), "source-numbers")
    leaves = stored(_numbered(attach(rows, sources, ["source"], DEFAULT_LIMITS), ["_tree"], ["doc_id", "leaf"]), "places")

    levels = _climb(leaves.select("_tree", "_pos", "_n", F.col("leaf").alias("_digest")))
    count = sources.count()
    subroots = levels[-1].select(
        F.lit(0).cast("bigint").alias("_tree"), F.col("_tree").alias("_pos"), F.lit(count).alias("_n"), "_digest"
    )
    tops = _climb(subroots)
    root = tops[-1].select("_digest").first()

    above = tops[-1].select("_tree", "_pos", F.array().cast(_PATH).alias("_path"))
    for nodes in reversed(tops[:-1]):
        above = _descend(nodes, above, [])
    names = subroots.select(F.col("_pos").alias("_tree"), F.col("_digest").alias("subroot"))
    above = above.select(F.col("_pos").alias("_tree"), "_path").join(names, "_tree")
    above = stored(above.select("_tree", F.lit(0).cast("bigint").alias("_pos"), "_path", "subroot"), "subroots")
    for nodes in reversed(levels[1:-1]):
        above = stored(_descend(nodes, above, ["subroot"]), "paths")
    if len(levels) > 1:
        leaves = _descend(leaves.withColumn("_digest", F.col("leaf")), above, ["subroot"], ["doc_id", "leaf", "_tampered"])
    else:
        leaves = leaves.join(above.drop("_pos"), "_tree")
    return _checked(leaves, root[0] if root else None)


def _field(name: str) -> Column:
    text = F.col(name).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _leaves(docs: DataFrame) -> DataFrame:
    """Digest of each row, and, where tampering changes the text, that of the changed row."""
    fields = {name: _field(name) for name in FIELDS}
    cut = F.translate(F.col("text"), "\n", "")
    changed = {**fields, "text": F.concat(F.octet_length(cut).cast("string"), F.lit(":"), cut)}
    tampered = (crc_of_id(F.col("doc_id")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    return docs.select(
        "doc_id",
        "source",
        _digest(*fields.values()).alias("leaf"),
        F.when(tampered, _digest(*changed.values())).alias("_tampered"),
    )


def _numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Add ``_pos``, the place from 0 inside ``by``, and ``_n``, the size of the group, if it is not there yet.

    Rows are range-partitioned by group and order, with their place in the input as the last key, so that equal rows spread, too. What
    lies before a partition comes from one count per partition and group.
    """
    keys = [*[F.col(c) for c in by], *[F.col(c).asc_nulls_first() for c in order], F.col("_row")]
    cut = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys)
    cut = cut.sortWithinPartitions(*keys).drop("_row").withColumn("_at", F.monotonically_increasing_id())
    cut = stored(cut.withColumn("_part", F.shiftright("_at", 33)), "ranges")
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    parts = cut.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # At most one row per partition and group that begins or goes on in it.
    before = F.sum("_rows").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*by, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = cut.join(small(stored(parts, "range-counts")), [*by, "_part"])
    return placed.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("_pos"))


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of every fifth level, until each tree has one left."""
    levels = [nodes]
    while not levels[-1].where("_n > 1").isEmpty():
        levels.append(stored(_parents(levels[-1]), "nodes"))
    return levels


def _parents(nodes: DataFrame) -> DataFrame:
    """Five levels up: first-child rows hash their run; a tree that has one node left keeps it."""
    nodes = nodes.select(*_TREE, F.expr(f"_pos div {BLOCK}").alias("_block"))
    block = Window.partitionBy("_tree", "_block").orderBy("_pos")
    for _ in range(HEIGHT):
        ahead = [F.lead("_digest", i).over(block).alias(f"_next{i}") for i in range(1, RUN)]
        length = F.col("_n") - F.col("_pos")
        run = [F.when(length > i, F.col(f"_next{i}")).otherwise(F.lit("")) for i in range(1, RUN)]
        parent = F.when(F.col("_n") > 1, _digest(F.col("_digest"), *run)).otherwise(F.col("_digest"))
        nodes = nodes.select("*", *ahead).where(f"_pos % {RUN} = 0")
        nodes = nodes.select(
            "_tree",
            F.expr(f"_pos div {RUN}").alias("_pos"),
            F.expr(f"(_n + {RUN - 1}) div {RUN}").alias("_n"),
            parent.alias("_digest"),
            "_block",
        )
    return nodes.select(*_TREE)


def _descend(nodes: DataFrame, above: DataFrame, carried: list[str], kept: list[str] | None = None) -> DataFrame:
    """Add ``_path``, the siblings to the left and right of each node and its ancestors, to the nodes five levels below ``above``.

    A node of a higher level stands in the row of its first leaf. From there its siblings lie a fixed number of rows before or
    behind; the other rows of its subtree take them from the last such row.
    """
    kept = kept or []
    upper = above.select("_tree", F.col("_pos").alias("_block"), F.col("_path").alias("_above"), *carried)
    rows = nodes.select("_tree", "_pos", "_n", "_digest", *kept, F.expr(f"_pos div {BLOCK}").alias("_block"))
    rows = rows.join(upper, ["_tree", "_block"])
    block = Window.partitionBy("_tree", "_block").orderBy("_pos")
    found = []
    for level in range(HEIGHT):
        stride = RUN**level
        count = F.expr(f"(_n + {stride - 1}) div {stride}")
        slot = F.expr(f"(_pos div {stride}) % {RUN}")
        length = F.least(F.lit(RUN), count - F.expr(f"_pos div {stride * RUN} * {RUN}"))
        here = F.expr(f"_pos % {stride} = 0") & (count > 1)
        near = {f"_b{i}": F.lag("_digest", i * stride).over(block) for i in range(1, RUN)}
        near |= {f"_a{i}": F.lead("_digest", i * stride).over(block) for i in range(1, RUN)}
        rows = rows.select("*", *[c.alias(n) for n, c in near.items()])
        left = F.concat(*[F.when(slot >= i, F.col(f"_b{i}")).otherwise(F.lit("")) for i in range(RUN - 1, 0, -1)])
        right = F.concat(*[F.when(slot + i < length, F.col(f"_a{i}")).otherwise(F.lit("")) for i in range(1, RUN)])
        side = F.when(here, F.struct(left.alias("left"), right.alias("right")))
        found.append(f"_side{level}")
        rows = rows.withColumn(found[-1], side).drop(*near)
        up = F.when(count > 1, _digest(F.col("_digest"), F.col(f"{found[-1]}.right"))).otherwise(F.col("_digest"))
        rows = rows.withColumn("_digest", F.when(F.expr(f"_pos % {stride * RUN} = 0"), up))
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = [F.col(found[0]), *[F.last(name, ignorenulls=True).over(so_far).alias(name) for name in found[1:]]]
    rows = rows.select("_tree", "_pos", *kept, "_above", *carried, *sides)
    path = F.concat(F.filter(F.array(*found), lambda side: side.isNotNull()), F.col("_above"))
    return rows.select("_tree", "_pos", *kept, path.alias("_path"), *carried)


def _checked(leaves: DataFrame, root: str | None) -> DataFrame:
    """Hash each leaf, changed or not, along its siblings up to a root, and compare that with the real one."""
    proof = F.array_join(F.transform("_path", lambda side: F.concat(side["left"], side["right"])), "")
    start = F.coalesce("_tampered", "leaf")
    folded = F.aggregate("_path", start, lambda node, side: _digest(side["left"], node, side["right"]))
    rows = leaves.select(
        "doc_id",
        "leaf",
        "subroot",
        F.lit(root).cast("string").alias("root"),
        F.sha2(proof.cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Principal components and whitening of embeddings, with equal vectors taken together.

Rows of equal whole-number vectors are grouped first. The covariance, the whitening and its check see each distinct vector once, with
its copies as an optional weight; only the result goes back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlens.llm.common import small, stored

STEPS = 256  # fixed: whole numbers per unit
COMPONENTS = 4
HOT_COPIES = 100_000  # rows of one vector from which on its result is broadcast
_LONG = 2**63
_TINY = 1e-12  # an eigenvalue below this share of the trace is no variance


class Space(NamedTuple):
    """What is known of the vectors of one length."""

    n: int  # sum of the weights
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # one column per component
    trace: float


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, x``: the entries as whole numbers; rows with a missing or non-finite entry are left out."""
    usable = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform(vector, lambda c: F.floor(F.lit(float(STEPS)) * c.cast("double")))
    return rows.where(F.col(vector).isNotNull() & usable).select("vec_id", x.cast("array<bigint>").alias("x"))


def key_of(x: Column) -> Column:
    """256 bits that stand for a vector in joins."""
    return F.unhex(F.sha2(F.array_join(x.cast("array<string>"), " ").cast("binary"), 256))


def whiten(rows: DataFrame, components: int = COMPONENTS, weights: str = "one", vector: str = "embedding") -> DataFrame:
    """A row per usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    ``weights``: ``one`` fits on each distinct vector once, ``counts`` on each as often as it occurs. Vectors of different lengths
    are spaces of their own; those of length 0 have no component and give no row. Rows that repeat (or share a vec_id, or have none)
    give a result each. Without variance along a component, ``whitened`` is NULL (``explained`` 0, or NULL if nothing varies), and a
    deviation that no long holds is NULL. Entries beyond the range of a long are cut to it. Other columns are not read. Components of
    equal eigenvalues are any orthonormal choice. The driver holds one matrix of a vector's length squared.
    """
    if weights not in ("one", "counts"):
        raise ValueError(f"weights must be 'one' or 'counts', not {weights!r}")
    whole = whole_vectors(rows, vector)
    weight = F.count(F.lit(1)) if weights == "counts" else F.lit(1).cast("bigint")
    groups = whole.where(F.size("x") > 0).groupBy("x").agg(F.count(F.lit(1)).alias("copies"), weight.alias("weight"))
    groups = stored(groups.select(key_of(F.col("x")).alias("key"), "x", "copies", "weight"), "vectors")
    spaces = fit(groups, components)
    distinct = stored(_whitened(groups, spaces), "whitened")
    errors = {size: _identity_error(distinct.where(F.col("size") == size), space) for size, space in spaces.items()}
    keyed = whole.select("vec_id", key_of(F.col("x")).alias("key"))
    back = distinct.select("key", "copies", "size", "deviation", "whitened")
    # At most one in HOT_COPIES rows is such a vector; the others are few rows per key.
    hot = stored(back.where(F.col("copies") >= HOT_COPIES), "hot-vectors")
    if hot.isEmpty():
        found = keyed.join(back.drop("copies"), "key")
    else:
        hot = small(hot.drop("copies"))
        rest = keyed.join(small(hot.select("key")), "key", "left_anti")
        found = rest.join(back.where(F.col("copies") < HOT_COPIES).drop("copies"), "key")
        found = found.unionByName(keyed.join(hot, "key"))
    return _by_component(found, spaces, errors)


def fit(groups: DataFrame, components: int = COMPONENTS) -> dict[int, Space]:
    """Sums first, then the covariance of the centred vectors; both summed per task, then in the order of the tasks."""
    spaces = {}
    for size, n, sums in _sums(groups):
        covariance = _centred_product(groups.where(F.size("x") == size), size, n, sums) / n
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        largest = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.sign(vectors[largest, np.arange(size)])  # the same sign in every run
        spaces[size] = Space(n, sums, values[:components], vectors[:, :components], float(np.trace(covariance)))
    return spaces


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, row numbers and matrix of the vectors of each length in a batch."""
    x = batch.column(batch.schema.get_field_index("x"))
    sizes = x.value_lengths().to_numpy(zero_copy_only=False)
    values = x.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        places = (ends[rows] - size)[:, None] + np.arange(size)
        yield int(size), rows, values[places]


def _exact(matrix: np.ndarray, largest: int) -> np.ndarray:
    """``matrix`` as it is where sums up to ``largest`` fit a long, else as unbounded whole numbers."""
    return matrix if largest < _LONG else matrix.astype(object)


def _top(matrix: np.ndarray) -> int:
    return max(abs(int(matrix.max())), abs(int(matrix.min()))) if matrix.size else 0


def _sums(groups: DataFrame) -> list[tuple[int, int, list[int]]]:
    """Sum of the weights and of the weighted vectors for each length."""

    def run(batches):
        totals = {}
        for batch in batches:
            weights = batch.column("weight").to_numpy()
            for size, rows, x in _arrays(batch):
                w = weights[rows]
                n, sums = totals.get(size, (0, [0] * size))
                added = (_exact(x, _top(x) * int(w.sum())) * w[:, None]).sum(axis=0)
                totals[size] = n + int(w.sum()), [a + int(b) for a, b in zip(sums, added)]
        rows = [(size, i, str(v), n) for size, (n, sums) in totals.items() for i, v in enumerate(sums)]
        if rows:
            columns = [pa.array(c) for c in zip(*rows)]
            schema = pa.schema([("size", pa.int32()), ("i", pa.int32()), ("total", pa.string()), ("n", pa.int64())])
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)

    parts = groups.select("x", "weight").mapInArrow(run, "size int, i int, total string, n long")
    total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    found = {}
    for row in parts.groupBy("size", "i").agg(total, F.sum("n").alias("n")).orderBy("size", "i").collect():
        found.setdefault(row["size"], (row["n"], []))[1].append(int(row["total"]))
    return [(size, n, sums) for size, (n, sums) in found.items()]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n`` from the exact ``n * x - sums``."""
    s = np.array(sums, dtype=object)
    if n * _top(x) + max(abs(v) for v in sums) < _LONG:
        return (n * x - s.astype(np.int64)).astype(np.float64) / n
    return (n * x.astype(object) - s).astype(np.float64) / n


def _centred_product(vectors: DataFrame, size: int, n: int, sums: list[int]) -> np.ndarray:
    """Weighted product of the centred vectors with themselves: one matrix per task, added row by row."""

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros((size, size))
        for batch in batches:
            weights = batch.column("weight").to_numpy()
            for _, rows, x in _arrays(batch):
                centred = _centred(x, n, sums)
                total += (centred * weights[rows][:, None]).T @ centred
        part = TaskContext.get().partitionId()
        columns = [np.full(size, part, np.int32), np.arange(size, dtype=np.int32), pa.array(list(total))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "i", "products"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size)
        for products in frame.sort_values("part")["products"]:
            total += products
        return pd.DataFrame({"i": [frame["i"].iloc[0]], "products": [total]})

    parts = vectors.select("x", "weight").mapInArrow(run, "part int, i int, products array<double>")
    rows = parts.groupBy("i").applyInPandas(added, "i int, products array<double>").orderBy("i").collect()
    return np.array([row["products"] for row in rows]).reshape(size, size)


def _projection(space: Space) -> np.ndarray:
    """Components over the root of their eigenvalue; NaN where nothing varies."""
    usable = space.values > _TINY * space.trace
    return space.vectors / np.sqrt(np.where(usable, space.values, np.nan))


def _whitened(groups: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """Each distinct vector's deviation from the mean and its coordinates."""

    def run(batches):
        for batch in batches:
            count = batch.num_rows
            deviation, whitened, sizes = [None] * count, [None] * count, np.zeros(count, np.int32)
            for size, rows, x in _arrays(batch):
                space = spaces[size]
                sizes[rows] = size
                coordinates = _centred(x, space.n, space.sums) @ _projection(space)
                top = space.n * _top(x) + max(abs(v) for v in space.sums)
                moved = _exact(x, size * top * top) * space.n - np.array(space.sums, dtype=object if size * top * top >= _LONG else np.int64)
                for row, d, c in zip(rows, (moved * moved).sum(axis=1), coordinates):
                    deviation[row] = int(d) if d < _LONG else None
                    whitened[row] = [None if np.isnan(v) else v for v in c.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("copies"),
                    batch.column("weight"),
                    pa.array(sizes),
                    pa.array(deviation, pa.int64()),
                    pa.array(whitened, pa.list_(pa.float64())),
                ],
                ["key", "copies", "weight", "size", "deviation", "whitened"],
            )

    schema = "key binary, copies long, weight long, size int, deviation long, whitened array<double>"
    return groups.mapInArrow(run, schema)


def _identity_error(distinct: DataFrame, space: Space) -> float | None:
    """Largest entry, without sign, of the whitened vectors' covariance minus the identity, measured on the stored vectors."""
    usable = np.flatnonzero(space.values > _TINY * space.trace)
    if not len(usable):
        return None
    w = {int(i): F.col("whitened")[int(i)] for i in usable}
    n = F.lit(float(space.n))
    means = distinct.agg(*[(F.sum(c * F.col("weight")) / n).alias(f"m{i}") for i, c in w.items()]).first()
    pairs = [(i, j) for i in w for j in w if i <= j]
    products = [F.sum((w[i] - means[f"m{i}"]) * (w[j] - means[f"m{j}"]) * F.col("weight")) / n for i, j in pairs]
    row = distinct.agg(*[p.alias(f"c{k}") for k, p in enumerate(products)]).first()
    return max(abs(value - (i == j)) for (i, j), value in zip(pairs, row))


def _by_component(found: DataFrame, spaces: dict[int, Space], errors: dict[int, float | None]) -> DataFrame:
    """One row per component, with what all rows of a space share."""
    shared = [
        (size, i, space.n, float(max(value, 0.0) / space.trace) if space.trace > 0 else None, errors[size])
        for size, space in spaces.items()
        for i, value in enumerate(space.values)
    ]
    schema = "size int, _place int, n long, explained double, identity_error double"
    shared = F.broadcast(found.sparkSession.createDataFrame(shared, schema))  # components x lengths
    rows = found.select("vec_id", "size", "deviation", F.posexplode("whitened").alias("_place", "whitened"))
    return rows.join(shared, ["size", "_place"]).select(
        "vec_id",
        (F.col("_place") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        "explained",
        "identity_error",
    )

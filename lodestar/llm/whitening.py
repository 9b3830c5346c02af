"""Whitening of embeddings by principal components, from an exact mean and a two-pass covariance.

Pass 1 sums count and integer vectors per task, exactly, and ``treeAggregate`` merges the tasks' sums. With these, pass 2
centres every vector before it is multiplied and adds up outer products by matrix product (GEMM); ``treeAggregate``
merges them, level by level, so the driver gets a few matrices however many tasks there are. The driver takes the
symmetric eigen decomposition (LAPACK). Pass 3 measures the covariance of the whitened vectors, centred batch by batch and
merged by count, mean and scatter; the projection goes to the tasks by broadcast: ``8 x dim`` doubles a length.

A vector's entry c counts as the integer floor(1024 c) + 100000. With S = q n + r per dimension (0 <= r < n), x - S/n is
(x - q) - r/n: the first term is exact, so no digits cancel.

Memory: a task holds a batch and one ``dim x dim`` matrix for each length of vectors; nothing grows with the rows. The table is
read four times, which costs less than keeping a copy; it must give the same rows each time.

Defined cases: vectors that are null, empty, or hold a null or non-finite entry are dropped; vectors of each length have their
own fit (``n``, components and error count that length alone); repeated rows and null vec_ids count and are returned; entries
beyond 2^50 / 1024 in size saturate there, so that x is exact in a double. A component without variance (eigenvalue
under ``FLAT`` of the largest, as with one vector or equal ones) has whitened null, counts as explaining 0 and is left out of the error.
A deviation beyond a long is null in the query, where deviation_exact has up to 38 digits. An empty table gives an empty result.
Columns with the names of the results are replaced, others kept by ``project``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.resident import trim
from lodestar.runtime import bound_arrow

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
FLAT = 1e-12
LARGEST = 2.0**50
NEW = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType())),
    T.StructField("explained", T.ArrayType(T.DoubleType())), T.StructField("identity_error", T.DoubleType()),
])


@dataclass
class Fit:
    """Of the vectors of one length: count, sums, and by component direction, eigenvalue and share of the variance."""

    n: int
    sums: list[int]
    axes: np.ndarray | None = None  # dim x components, unit columns
    values: np.ndarray | None = None
    explained: np.ndarray | None = None
    error: float | None = None

    def __post_init__(self) -> None:
        self.q = np.array([s // self.n for s in self.sums], np.int64)
        self.r = [s - int(q) * self.n for s, q in zip(self.sums, self.q, strict=True)]
        self.rest = np.array([r / self.n for r in self.r])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.q).astype(np.float64) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; NaN where a component has no variance."""
        safe = np.where(self.values > 0, self.values, 1.0)
        return np.where(self.values > 0, self.centred(x) @ self.axes / np.sqrt(safe), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S)^2, exactly."""
        z = x - self.q
        n, dim, most = self.n, len(self.q), int(np.abs(z).max(initial=0)) + 1
        if (most * n) ** 2 * dim < 1 << 63:
            d = z * n - np.array(self.r, np.int64)
            return (d * d).sum(axis=1).tolist()
        if most <= 1 << 20 and n < 1 << 40 and dim < 1 << 20:
            low, high = (np.array([f(r) for r in self.r], np.int64) for f in (lambda r: r & (1 << 20) - 1, lambda r: r >> 20))
            rest = sum(r * r for r in self.r)
            return [n * n * a - 2 * n * ((b << 20) + c) + rest for a, b, c in zip((z * z).sum(axis=1).tolist(), (z @ high).tolist(), (z @ low).tolist(), strict=True)]
        return [sum((n * a - r) ** 2 for a, r in zip(row, self.r, strict=True)) for row in z.tolist()]


def integers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the rows, their integer vectors), once for each length, of the usable rows of an array<double> column."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == dim)
        c = flat[starts[at][:, None] + np.arange(dim)]
        good = np.isfinite(c).all(axis=1)
        if good.any():
            with np.errstate(over="ignore"):
                yield at[good], np.clip(np.floor(SCALE * c[good]), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _gather(vectors: DataFrame, add: Callable[[dict, np.ndarray], None], merge: Callable[[object, object], object]) -> dict:
    """By length of vectors: what ``add`` sums up over the batches of a task and ``merge`` over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for _, x in integers(batch.column(0)):
                add(held, x)
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], names=["part"])

    def both(a: dict, b: dict) -> dict:
        return {k: merge(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in {**a, **b}}

    parts = vectors.mapInArrow(run, "part binary").rdd.map(lambda row: pickle.loads(row[0]))
    return parts.treeAggregate({}, both, both)


def _add_sums(held: dict, x: np.ndarray) -> None:
    n, s = held.get(x.shape[1], (0, 0))
    held[x.shape[1]] = (n + len(x), s + x.sum(axis=0).astype(object))  # a batch's sums fit a long, the total need not


def _merge_scatter(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred scatter of two sets together."""
    n, shift = a[0] + b[0], b[1] - a[1]
    return n, a[1] + shift * (b[0] / n), a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)


def decompose(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors as columns, eigenvalues and shares of the trace, of the ``k`` largest; no variance counts as 0."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    values, vectors = values[order], vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    values = np.where((values > 0) & (values > FLAT * max(values[0], 0.0)), values, 0.0)
    trace = float(np.trace(covariance))
    return vectors * sign, values, values / trace if trace > 0 else values * 0.0


def fit(table: DataFrame, *, embedding: str = "embedding", components: int = COMPONENTS) -> dict[int, Fit]:
    """A fit for each length of the table's vectors, over all of them."""
    spark = table.sparkSession
    bound_arrow(spark)
    vectors = table.select(F.col(embedding).cast("array<double>").alias("vector"))
    sums = _gather(vectors, _add_sums, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    fits = {dim: Fit(n, [int(v) for v in s]) for dim, (n, s) in sums.items()}
    if not fits:
        return fits
    known = spark.sparkContext.broadcast(fits)

    def add_products(held: dict, x: np.ndarray) -> None:
        z = known.value[x.shape[1]].centred(x)
        held[x.shape[1]] = held.get(x.shape[1], 0.0) + z.T @ z

    for dim, products in _gather(vectors, add_products, lambda a, b: a + b).items():
        f = fits[dim]
        f.axes, f.values, f.explained = decompose(products / f.n, components)
    known = spark.sparkContext.broadcast(fits)

    def add_scatter(held: dict, x: np.ndarray) -> None:
        f = known.value[x.shape[1]]
        w = f.whitened(x)[:, f.values > 0]
        mean = w.mean(axis=0)
        now = (len(w), mean, (w - mean).T @ (w - mean))
        held[x.shape[1]] = _merge_scatter(held[x.shape[1]], now) if x.shape[1] in held else now

    for dim, (n, _, scatter) in _gather(vectors, add_scatter, _merge_scatter).items():
        fits[dim].error = float(np.abs(scatter / n - np.eye(len(scatter))).max(initial=0.0))
    return fits


def project(table: DataFrame, fits: dict[int, Fit], *, embedding: str = "embedding") -> DataFrame:
    """The usable rows of ``table`` with n, deviation, whitened and explained (arrays by component) and identity_error."""
    spark = table.sparkSession
    bound_arrow(spark)
    names = {f.name for f in NEW}
    kept = table.select(*[c for c in table.columns if c.lower() not in names], F.col(embedding).cast("array<double>").alias("_x"))
    known = spark.sparkContext.broadcast(fits)
    limit = 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in integers(batch.column(batch.num_columns - 1)):
                f = known.value[x.shape[1]]
                w = f.whitened(x)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel(), pa.float64(), from_pandas=True), w.shape[1]).cast(pa.list_(pa.float64()))
                new = [
                    pa.array([f.n] * len(at), pa.int64()), pa.array([Decimal(d) if d < limit else None for d in f.deviations(x)], pa.decimal128(38, 0)), lists,
                    pa.array([f.explained.tolist()] * len(at), pa.list_(pa.float64())), pa.array([f.error] * len(at), pa.float64()),
                ]
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *new], names=[*rows.schema.names[:-1], *[c.name for c in NEW]])
        trim()

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], *NEW.fields]))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = project(table, fit(table)).select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("pos", "whitened"))
    return rows.select(
        "vec_id", (F.col("pos") + 1).cast("int").alias("component"), "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        F.get("explained", "pos").alias("explained"), "identity_error", F.col("deviation").alias("deviation_exact"),
    )

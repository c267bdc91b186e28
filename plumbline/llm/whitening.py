"""Whitening of embeddings by the principal components of their covariance.

A vector's entries become integers x = floor(scale * c) + shift. Each distinct x vector is fitted once. The
first pass adds them up exactly; the second one adds outer products of (n * x - S) / n, whose numerator is an
exact integer, by matrix products of blocks; both merge their partitions' sums by treeAggregate. What the
driver holds are the sums of one vector and matrices of dimension squared, whatever the number of rows. LAPACK's symmetric
solver gives the components, which are broadcast (dimension times `components` numbers), and every row is projected by a matrix product of its block.
A third pass over the fit list measures how far the whitened covariance is from the identity.

Steps read two tables in the shared folder, the rows' x vectors and the distinct ones, so that a lost executor costs no more than its tasks.

Defined cases: rows whose vector is null or holds a null or non-finite entry are left out; so are empty
vectors. Vectors of different lengths are separate spaces and are fitted apart. Repeated vectors weigh once in the fit and
each give their rows. Components without variance (fewer distinct vectors than dimensions, constant entries) have explained
0 and whitened 0.0, and are left out of identity_error; a single vector has such components only. An empty table gives an empty result.
Null ids pass through; other columns are not used, whatever their names. Entries beyond 2^52 / scale lose their last digits as doubles do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import materialize

#: Components that are returned at most.
COMPONENTS = 16
#: Rows in one block of a matrix product.
BLOCK = 4096
#: Variance below this share of the largest counts as none.
RANK_SHARE = 1e-13


@dataclass(frozen=True)
class Fit:
    """n vectors with sums S; columns of `axes` are unit components with variances e, of `trace` in all."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float

    @property
    def divided(self) -> np.ndarray:
        """Components over the square roots of their variances; zero where there is none."""
        held = self.variances > 0
        return np.where(held, self.axes / np.sqrt(np.where(held, self.variances, 1.0)), 0.0)


def integer_vector(c: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    return F.transform(c, lambda v: (F.floor(v.cast("double") * scale) + shift).cast("long"))


def usable(c: Column) -> Column:
    """Neither null nor empty, and all entries are finite."""
    far = F.lit(float("inf"))
    odd = F.exists(c, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == far))
    return F.coalesce((F.size(c) > 0) & ~odd, F.lit(False))


def _blocks(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix of int64) for the list column of a batch."""
    lists = batch.column(batch.schema.get_field_index(name))
    for k in range(0, len(lists), BLOCK):
        part = lists.slice(k, BLOCK)
        flat = part.flatten().to_numpy(zero_copy_only=False)
        yield k, flat.reshape(len(part), -1)


def _exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums of columns as Python integers, which never wrap."""
    small = len(x) == 0 or int(np.abs(x).max()) < (1 << 62) // len(x)
    return (x.sum(axis=0) if small else x.astype(object).sum(axis=0)).astype(object)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exact: int64 if it fits, else Python integers."""
    fits = x.size == 0 or (int(np.abs(x).max()) + 1) * n < 1 << 62 and max(map(abs, sums)) < 1 << 62
    return x * np.int64(n) - np.array(sums, dtype=np.int64) if fits else x.astype(object) * n - np.array(sums, dtype=object)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return deviations(x, n, sums).astype(np.float64) / n


def _reduced(vectors: DataFrame, each: Callable[[np.ndarray], list[np.ndarray]]) -> list[np.ndarray] | None:
    """Sums over all blocks of the arrays that each(block) gives, by a tree of tasks; None without rows."""

    def partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        total = None
        for batch in batches:
            for _, x in _blocks(batch, "x"):
                got = each(x)
                total = got if total is None else [a + b for a, b in zip(total, got)]
        if total is not None:
            yield pa.record_batch({"sums": pa.array([pickle.dumps(total)], pa.binary())})

    def read(row) -> list[np.ndarray]:
        import pickle

        return pickle.loads(bytes(row[0]))

    def merge(a, b):
        return b if a is None else a if b is None else [p + q for p, q in zip(a, b)]

    parts = vectors.select("x").mapInArrow(partition, "sums binary").rdd
    return parts.treeAggregate(None, lambda a, row: merge(a, read(row)), merge, depth=3)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The fit of distinct vectors (x array<long>, all of one length); None without any."""
    counted = _reduced(vectors, lambda x: [np.array([len(x)], dtype=object), _exact_sums(x)])
    if counted is None:
        return None
    n, sums = int(counted[0][0]), tuple(int(s) for s in counted[1])

    def outer(x: np.ndarray) -> list[np.ndarray]:
        d = _centred(x, n, sums)
        return [d.T @ d]

    covariance = _reduced(vectors, outer)[0] / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    kept = np.where(values[order] > RANK_SHARE * max(values.max(), 0.0), values[order], 0.0)
    found = Fit(n, sums, np.ascontiguousarray(axes[:, order]), kept, float(np.trace(covariance)), 0.0)
    held, divided = kept > 0, found.divided
    if not held.any():
        return found

    def whitened(x: np.ndarray) -> list[np.ndarray]:
        z = _centred(x, n, sums) @ divided[:, held]
        return [z.T @ z]

    error = _reduced(vectors, whitened)[0] / n - np.eye(int(held.sum()))
    return Fit(n, sums, found.axes, kept, found.trace, float(np.abs(error).max()))


def project(rows: DataFrame, found: Fit) -> DataFrame:
    """rows(vec_id, x) -> (vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error), a row a component."""
    shared = rows.sparkSession.sparkContext.broadcast(found)
    kind = rows.schema["vec_id"].dataType
    schema = T.StructType([
        T.StructField("vec_id", kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.StringType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Fit = shared.value
        k = f.axes.shape[1]
        explained = f.variances / f.trace if f.trace > 0 else np.zeros(k)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            for first, x in _blocks(batch, "x"):
                m = len(x)
                d = deviations(x, f.n, f.sums)
                far = [str(sum(v * v for v in row)) for row in d.astype(object).tolist()] if int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 62 else (d * d).sum(axis=1).astype(str).tolist()
                z = (d.astype(np.float64) / f.n) @ f.divided
                repeated = pa.array(np.repeat(np.arange(m), k))
                yield pa.record_batch({
                    "vec_id": ids.slice(first, m).take(repeated), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, f.n, dtype=np.int64)), "deviation": pa.array(far, pa.string()).take(repeated), "whitened": pa.array(z.ravel()),
                    "explained": pa.array(np.tile(explained, m)), "identity_error": pa.array(np.full(m * k, f.identity_error)),
                })

    return rows.select("vec_id", "x").mapInArrow(run, schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whiten(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """The whitened components of all usable vectors; see `project` for the columns."""
    good = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("c")).filter(usable(F.col("c")))
    rows = materialize(good.select("vec_id", integer_vector(F.col("c"), scale, shift).alias("x")), "integer-vectors")
    distinct = materialize(rows.select("x").distinct(), "distinct-vectors")
    lengths = sorted(r[0] for r in distinct.select(F.size("x").alias("d")).distinct().collect())  # one, as a rule
    out = None
    for d in lengths:
        one = project(rows.filter(F.size("x") == d), fit(distinct.filter(F.size("x") == d), components))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else project(rows, Fit(0, (0,), np.zeros((1, 1)), np.zeros(1), 0.0, 0.0))

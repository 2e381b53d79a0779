"""Whitening of vectors by principal components.

Entries become whole numbers first, so the sums, and the products of the centred entries, are exact and do not depend on
the order of rows: each task multiplies its vectors, centred at the whole numbers next to the mean, and what the mean
differs from those is taken out of the total. The covariance is factored by Cholesky with pivoting, and one-sided Jacobi
rotations are applied to the columns of the triangular factor itself until they are orthogonal. Their squared norms are
the eigenvalues, the normalised columns the components; no eigenvalue problem of the covariance is formed, which keeps
small ones accurate.

Only sums of a size given by the number of dimensions reach the driver. Vectors are read once for the sums, once for the
products and once to be projected; the whitened coordinates are written to the shared folder and read for the check.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries, or entries too large to become a long,
are left out, and so are vectors that have another length than most (of equally common lengths the largest counts) and
those of no entries. Repeated rows count as often as they occur; a null id stays null. A component whose eigenvalue is
zero to working precision has no whitened coordinates and is left out, so equal vectors, or one, give no rows, and so
does an empty table. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import keep

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
SWEEPS = 60
EPSILON = float(np.finfo(np.float64).eps)
# Whole numbers below it are exact in double precision, and products of a batch in a long.
EXACT, LONG = 2 ** 53, 2 ** 62


def whole_entries(vector: Column) -> Column:
    """The entries as whole numbers; null for a vector that has none, or any that is no number or too large."""
    entries = F.transform(vector, lambda entry: entry.cast("double") * SCALE)
    sound = F.forall(entries, lambda entry: entry.isNotNull() & ~F.isnan(entry) & (F.abs(entry) < float(LONG)))
    return F.when(sound & (F.size(vector) > 0), F.transform(entries, lambda entry: F.floor(entry) + OFFSET))


def exact_products(rows: np.ndarray) -> np.ndarray:
    """The exact sum of each row's products, entry by entry."""
    largest = max(abs(int(rows.min())), abs(int(rows.max()))) ** 2 * len(rows)
    if largest < EXACT:
        narrow = rows.astype(np.float64)
        return (narrow.T @ narrow).astype(np.int64)
    if largest < LONG:
        return rows.T @ rows
    wide = rows.astype(object)
    return wide.T @ wide


def matrix(vectors: pa.Array, dimensions: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def sums(vectors: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the sum of each entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dimensions, object)
        for batch in batches:
            if batch.num_rows:
                n += batch.num_rows
                total += matrix(batch.column(0), dimensions).sum(0, dtype=object)
        if n:
            values = pa.array([n, *total.tolist()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(dimensions + 1), pa.int32()), values], ["place", "value"])

    parts = vectors.select("x").mapInArrow(add, "place int, value decimal(38,0)")
    found = {row["place"]: int(row["value"]) for row in parts.groupBy("place").agg(F.sum("value").alias("value")).collect()}
    return (found[0], [found[k] for k in range(1, dimensions + 1)]) if found else (0, [])


def scatter(vectors: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The covariance, divisor n, of the vectors: exact sums of centred products, rounded once."""
    dimensions = len(total)
    centre = np.array([(2 * one + n) // (2 * n) for one in total], np.int64)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((dimensions, dimensions), object)
        for batch in batches:
            if batch.num_rows:
                found += exact_products(centred(matrix(batch.column(0), dimensions), centre))
        i, j = np.triu_indices(dimensions)
        if found.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(found[i, j].tolist(), pa.decimal128(38, 0))], ["i", "j", "value"])

    parts = vectors.select("x").mapInArrow(multiply, "i int, j int, value decimal(38,0)")
    rest = [one - n * int(middle) for one, middle in zip(total, centre)]
    found = np.zeros((dimensions, dimensions))
    for row in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        i, j = row["i"], row["j"]
        found[i, j] = found[j, i] = (n * int(row["value"]) - rest[i] * rest[j]) / (n * n)
    return found


def centred(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Rows less the centre; as Python's whole numbers where a long might not hold them."""
    if max(abs(int(rows.min())), abs(int(rows.max())), int(np.abs(centre).max())) < LONG // 2:
        return rows - centre
    return rows.astype(object) - centre.astype(object)


def pivoted_cholesky(covariance: np.ndarray) -> np.ndarray:
    """The factor L of V = L L', its rows in the order of V's; it has a column for each pivot above rounding."""
    rest = np.diag(covariance).astype(np.float64).copy()
    size = len(rest)
    factor = np.zeros((size, size))
    least = size * EPSILON * rest.max(initial=0.0)
    order, rank = np.arange(size), 0
    while rank < size:
        left = order[rank:]
        pivot = int(rest[left].argmax())
        if rest[left[pivot]] <= least:
            break
        order[[rank, rank + pivot]] = order[[rank + pivot, rank]]
        chosen, below = order[rank], order[rank + 1:]
        factor[chosen, rank] = np.sqrt(rest[chosen])
        factor[below, rank] = (covariance[below, chosen] - factor[below, :rank] @ factor[chosen, :rank]) / factor[chosen, rank]
        rest[below] -= factor[below, rank] ** 2
        rank += 1
    return factor[:, :rank]


def rounds(count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of columns once, in rounds of pairs that share none."""
    even = count + count % 2
    seats, found = list(range(even)), []
    for _ in range(even - 1):
        pairs = [(a, b) for a, b in zip(seats[:even // 2], reversed(seats[even // 2:])) if max(a, b) < count]
        if pairs:
            found.append(tuple(np.array(side) for side in zip(*pairs)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return found


def jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor with its columns rotated, two at a time, until all are orthogonal to working precision."""
    columns = factor.T.copy()
    schedule = rounds(len(columns))
    for _ in range(SWEEPS):
        largest = 0.0
        for first, second in schedule:
            a, b = columns[first], columns[second]
            aa, bb, ab = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1)
            cosine = np.abs(ab) / np.sqrt(aa * bb)
            largest = max(largest, float(cosine.max()))
            turn = cosine > EPSILON
            ratio = (bb[turn] - aa[turn]) / (2 * ab[turn])
            tangent = np.where(ratio < 0, -1.0, 1.0) / (np.abs(ratio) + np.hypot(1, ratio))
            c = 1 / np.hypot(1, tangent)
            s = c * tangent
            columns[first[turn]] = c[:, None] * a[turn] - s[:, None] * b[turn]
            columns[second[turn]] = s[:, None] * a[turn] + c[:, None] * b[turn]
        if largest <= len(columns) * EPSILON:
            break
    return columns.T


@dataclass(frozen=True)
class Whitening:
    """What projects a vector: how many vectors were seen, their sums, and components by falling eigenvalue."""

    n: int
    total: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def project(self, vectors: DataFrame) -> DataFrame:
        """Vectors (x) with their exact ``deviation`` and their ``whitened`` coordinates, one for each component."""
        n, total = self.n, self.total
        weights = self.components / np.sqrt(self.eigenvalues)

        @F.arrow_udf("deviation decimal(38,0), whitened array<double>")
        def projected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                rows = matrix(batch, len(total))
                largest = max(abs(int(rows.min(initial=0))), abs(int(rows.max(initial=0)))) * n + max(map(abs, total))
                kind = np.int64 if largest < LONG else object
                apart = rows.astype(kind) * n - np.array(total, kind)
                if int(np.abs(apart).max(initial=0)) ** 2 * len(total) >= LONG:
                    apart = apart.astype(object)
                deviation = (apart * apart).sum(1).tolist()
                values = (apart / n).astype(np.float64) @ weights
                lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), weights.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.StructArray.from_arrays([pa.array(deviation, pa.decimal128(38, 0)), lists], ["deviation", "whitened"])

        return vectors.withColumn("_projected", projected("x")).select(
            *[name for name in vectors.columns if name != "x"], "_projected.deviation", "_projected.whitened")


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, int]:
    """The whitening of all vectors (x) of the usual length, and that length; none where nothing varies."""
    lengths = vectors.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return None, 0
    alike = vectors.filter(F.size("x") == lengths["size"])
    n, total = sums(alike, lengths["size"])
    covariance = scatter(alike, n, total)
    columns = jacobi(pivoted_cholesky(covariance))
    norms = np.sqrt((columns * columns).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > len(total) * EPSILON * norms.max(initial=0.0)][:components]
    if not len(order):
        return None, lengths["size"]
    eigenvalues = norms[order] ** 2
    return Whitening(n, total, columns[:, order] / norms[order], eigenvalues, eigenvalues / np.trace(covariance)), lengths["size"]


def identity_error(rows: DataFrame, components: int) -> Column:
    """The largest difference of the coordinates' covariance, divisor n and centred, from the identity."""
    coordinate = [F.get("whitened", F.lit(k)) for k in range(components)]
    entries = [F.abs(F.covar_pop(coordinate[i], coordinate[j]) - float(i == j)) for i in range(components) for j in range(i + 1)]
    return F.array_max(F.array(*entries))


def whiten(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) of every vector that takes part: ``whitened`` and
    ``explained`` are lists by component, numbered by falling eigenvalue; ``deviation`` is a whole number."""
    vectors = table.select(F.col(f"`{vec_id}`").alias("vec_id"), whole_entries(F.col(f"`{vector}`")).alias("x")).filter("x IS NOT NULL")
    fitted, size = fit(vectors, components)
    if fitted is None:
        kind = "n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
        none = F.from_json(F.lit(None).cast("string"), kind)
        return vectors.limit(0).select("vec_id", none.alias("one")).select("vec_id", "one.*")
    projected = keep(fitted.project(vectors.filter(F.size("x") == size)), "whitened")
    error = projected.agg(identity_error(projected, len(fitted.eigenvalues)).alias("error")).first()["error"]
    return projected.select(
        "vec_id", F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*map(F.lit, fitted.explained.tolist())).alias("explained"), F.lit(error).alias("identity_error"))

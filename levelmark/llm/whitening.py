"""Whitening of embeddings with an exactly known spectrum.

Vectors become whole numbers. Tasks sum the distinct ones and, around a whole
centre, their products, so the scatter matrix is exact at any number of rows.
Its characteristic polynomial is found modulo enough primes by reduction to
Hessenberg form, a prime at a time in tasks, and put together by the Chinese
remainder theorem. The largest roots are isolated among its real roots to many
more bits than a double has, and each one's vectors solved for by inverse
iteration in a task of its own.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelmark.llm import exact_roots
from levelmark.sources.shared import written

#: Whole numbers are floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Entries from here on have no 64-bit whole number.
BEYOND = 2.0**56
#: Sums leave tasks in parts of so many bits, lowest first; the last is signed.
PART_BITS, PARTS = 60, 4
#: Entries are multiplied in parts of LIMB_BITS bits, ROWS rows at a time, which doubles hold exactly.
LIMB_BITS, ROWS = 20, 4096


def _row_schema(vectors: DataFrame, vec_id: str) -> str:
    return f"vec_id {vectors.schema[vec_id].dataType.simpleString()}, x array<bigint>"


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part. Null and empty vectors and those
    holding null, non-finite or BEYOND entries go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            starts = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            with np.errstate(invalid="ignore"):
                bad = np.concatenate([[0], np.cumsum(~(np.abs(values) < BEYOND))])
            lengths = np.diff(starts)
            fit = lists.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0) & (bad[starts[1:]] == bad[starts[:-1]])
            within = np.repeat(fit, lengths)
            x = np.floor(SCALE * values[starts[0] : starts[-1]][within]).astype(np.int64) + OFFSET
            ends = np.concatenate([[0], np.cumsum(lengths[fit])]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fit)), column], ["vec_id", "x"])

    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, _row_schema(vectors, vec_id))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _parts(total: int) -> list[int]:
    low = [(total >> (PART_BITS * i)) & ((1 << PART_BITS) - 1) for i in range(PARTS - 1)]
    return [*low, total >> (PART_BITS * (PARTS - 1))]


def _summed(rows: DataFrame, sums) -> dict[tuple[int, int], int]:
    """Sums over all rows of what `sums` finds per batch: whole numbers of any
    size by (i, j). As many come back as the dimensions have pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            for key, value in sums(batch.column(0)):
                totals[key] = totals.get(key, 0) + value
        if totals:
            columns = zip(*((*key, *_parts(value)) for key, value in totals.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    parts = [f"p{i}" for i in range(PARTS)]
    names = ["i", "j", *parts]
    found = rows.select("x").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
    found = found.groupBy("i", "j").agg(*(F.sum(F.col(p).cast("decimal(20,0)")).alias(p) for p in parts))
    return {(r["i"], r["j"]): sum(int(r[p]) << (PART_BITS * k) for k, p in enumerate(parts)) for r in found.collect()}


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as a sum of parts times 2^(LIMB_BITS k), each small enough for exact products."""
    out = []
    while True:
        if not len(y) or np.abs(y).max() < 1 << LIMB_BITS:
            return [*out, y.astype(np.float64)]
        low = y & ((1 << LIMB_BITS) - 1)
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB_BITS


def _products(y: np.ndarray) -> np.ndarray:
    """Sum of the outer products of the rows of y, as Python's whole numbers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for start in range(0, len(y), ROWS):
        limbs = _limbs(y[start : start + ROWS])
        for a, left in enumerate(limbs):
            for b, right in enumerate(limbs):
                total += (left.T @ right).astype(np.int64).astype(object) << (LIMB_BITS * (a + b))
    return total


def _column_sums(column: pa.ListArray, dims: int) -> Iterator[tuple[tuple[int, int], int]]:
    x = _matrix(column, dims)
    low, high = x & 0xFFFFFFFF, x >> 32
    for i, (a, b) in enumerate(zip(low.sum(axis=0).tolist(), high.sum(axis=0).tolist(), strict=True)):
        yield (i, -1), a + (b << 32)
    yield (-1, -1), len(x)


@dataclass
class Whitening:
    """What a fit knows: n distinct vectors, their sums, and the components."""

    dims: int
    n: int
    sums: list[int]
    scatter: list[list[int]]  # n^2 times the covariance
    roots: list[int]  # eigenvalues of the scatter, times 2^shift
    shifts: list[int]
    vectors: np.ndarray  # components, one per row

    @property
    def eigenvalues(self) -> list[float]:
        return [float(Fraction(r, self.n**2 << s)) for r, s in zip(self.roots, self.shifts, strict=True)]

    @property
    def explained(self) -> list[float]:
        trace = sum(self.scatter[i][i] for i in range(self.dims))
        return [float(Fraction(r, trace << s)) for r, s in zip(self.roots, self.shifts, strict=True)]

    def projection(self) -> np.ndarray:
        """Maps a centred vector to its whitened components (columns)."""
        return (self.vectors / np.sqrt(np.array(self.eigenvalues))[:, None]).T if self.roots else np.empty((self.dims, 0))

    def identity_error(self) -> float:
        """Largest absolute entry of the whitened fit list's covariance minus the
        identity: the projection as it is applied, on the exact covariance."""
        covariance = np.array([[c / self.n**2 for c in row] for row in self.scatter])
        p = self.projection()
        return float(np.abs(p.T @ covariance @ p - np.eye(p.shape[1])).max()) if p.size else 0.0

    def transform(self, rows: DataFrame) -> DataFrame:
        """vec_id, component, n, deviation, whitened, explained, identity_error for
        each row (vec_id, x) and component."""
        n, dims, count = self.n, self.dims, len(self.roots)
        centre = [s // n for s in self.sums] if n else []
        rest = [s - n * c for s, c in zip(self.sums, centre, strict=True)] if n else []
        fraction = np.array([r / n for r in rest])
        projection, explained, error = self.projection(), self.explained, self.identity_error()
        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

        def deviations(y: np.ndarray) -> list[int | None]:
            if len(y) and n * (int(np.abs(y).max()) + 1) < 2 ** (31 - (dims - 1).bit_length() / 2):
                d = n * y - np.array(rest, np.int64)
                return (d * d).sum(axis=1).tolist()
            exact = (sum((n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y.tolist())
            return [d if d < 2**63 else None for d in exact]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = np.array(centre, np.int64)
            for batch in batches:
                y = _matrix(batch.column("x"), dims) - at
                of = np.repeat(np.arange(len(y)), count)
                columns = [
                    batch.column("vec_id").take(pa.array(of)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(y))),
                    pa.array(np.full(len(of), n, np.int64)),
                    pa.array(deviations(y), pa.int64()).take(pa.array(of)),
                    pa.array(((y - fraction) @ projection).ravel()),
                    pa.array(np.tile(np.array(explained), len(y))),
                    pa.array(np.full(len(of), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

        kinds = [rows.schema["vec_id"].dataType.simpleString(), "int", "bigint", "bigint", "double", "double", "double"]
        schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
        if not count:
            return rows.sparkSession.createDataFrame([], schema)
        return rows.where(F.size("x") == dims).mapInArrow(run, schema)


def _polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Characteristic polynomial, highest coefficient first; the primes go to tasks."""
    wanted = exact_roots.primes(2 * exact_roots.coefficient_bound(matrix) + 1)
    sent = spark.sparkContext.broadcast([[str(c) for c in row] for row in matrix])  # dims^2 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [[int(c) for c in row] for row in sent.value]
        for batch in batches:
            found = batch.column("p").to_pylist()
            rows = [exact_roots.polynomial_modulo(np.array([[c % p for c in row] for row in whole], np.int64), p) for p in found]
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array([r.tolist() for r in rows], pa.list_(pa.int64()))], ["p", "c"])

    chosen = spark.createDataFrame([(p,) for p in wanted], "p bigint").repartition(min(64, len(wanted)), "p")
    found = sorted((r["p"], r["c"]) for r in chosen.mapInArrow(run, "p bigint, c array<bigint>").collect())
    return exact_roots.remaindered(found)


def _components(spark: SparkSession, matrix: list[list[int]], roots: list[exact_roots.Root]) -> np.ndarray:
    """Vectors of the roots, one root per task."""
    sent = spark.sparkContext.broadcast([[str(c) for c in row] for row in matrix])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [[int(c) for c in row] for row in sent.value]
        for batch in batches:
            for row in batch.to_pylist():
                found = exact_roots.null_space(whole, int(row["low"]), row["shift"], row["times"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["k"]] * len(found)), pa.array(found.tolist(), pa.list_(pa.float64()))], ["k", "v"]
                )

    rows = [(k, str(r.low), r.shift, r.times) for k, r in enumerate(roots)]
    df = spark.createDataFrame(rows, "k bigint, low string, shift int, times int").repartitionByRange(len(rows), "k")
    found = df.mapInArrow(run, "k bigint, v array<double>").collect()
    vectors = np.array([r["v"] for r in sorted(found, key=lambda r: r["k"])])
    largest = np.abs(vectors).argmax(axis=1)  # its sign is made positive
    return vectors * np.sign(vectors[np.arange(len(vectors)), largest])[:, None]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fits on the distinct vectors of `rows` (vec_id, x).

    Only vectors of the commonest length count (of equally common ones, the
    longest). What comes to the driver is of the order of the dimensions'
    square: sums, scatter, polynomial, vectors. Components of eigenvalue 0 do
    not exist, as nothing can be divided by it.
    """
    spark = rows.sparkSession
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return Whitening(0, 0, [], [], [], [], np.empty((0, 0)))
    dims = lengths["d"]
    distinct = written(rows.where(F.size("x") == dims).select("x").distinct(), "fit_list")
    totals = _summed(distinct, lambda column: _column_sums(column, dims))
    n, sums = totals[-1, -1], [totals[i, -1] for i in range(dims)]
    centre = np.array([s // n for s in sums], np.int64)

    def products(column: pa.ListArray) -> Iterator[tuple[tuple[int, int], int]]:
        found = _products(_matrix(column, dims) - centre)
        for i in range(dims):
            for j in range(i, dims):
                yield (i, j), found[i, j]

    sent = _summed(distinct, products)
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    scatter = [[n * sent[min(i, j), max(i, j)] - rest[i] * rest[j] for j in range(dims)] for i in range(dims)]
    roots = exact_roots.largest_roots(_polynomial(spark, scatter), components)
    if not roots:
        return Whitening(dims, n, sums, scatter, [], [], np.empty((0, dims)))
    vectors = _components(spark, scatter, roots)[:components]
    repeated = [r for r in roots for _ in range(r.times)][:components]
    return Whitening(dims, n, sums, scatter, [2 * r.low + 1 for r in repeated], [r.shift + 1 for r in repeated], vectors)


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row
    for each vector that takes part and each component.

    Rows go whose vector is null, empty, holds null or non-finite entries or
    ones of 2^56 and more, or is not of the commonest length. Repeated vectors
    count once in the fit and get a row each in the result; ids may be null or
    repeat; other columns are not read. There are as many components as positive
    eigenvalues, `components` at most: none where all vectors are equal or the
    table is empty. Vectors of equal eigenvalues are one orthonormal basis of
    their space. `deviation` is null beyond 64 bits.
    """
    rows = whole_vectors(vectors, vec_id, vector)
    return fit(rows, components).transform(rows)

"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Entries become integers, so the scatter matrix n * sum(x x') - S S' is one of integers
and known exactly. Its characteristic polynomial is found modulo many primes, each by
reduction to Hessenberg form, and put together by Chinese remainders. All roots of it
are real, so the sign changes of the shifted polynomial count the roots above a place
exactly (Budan and Fourier); halving intervals isolates the largest roots and finds
them to some hundred bits. Inverse iteration in long integers gives the null vector of
the matrix minus the root.

Sums over vectors, primes and roots are Spark jobs. The driver holds the scatter
matrix and the polynomial: numbers in the square of the dimension, whatever the count
of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Bits to which roots are found, and bits more of the numbers in inverse iteration.
ROOT_BITS, GUARD_BITS = 256, 64
#: Exact sums travel as so many parts of so many bits, and a rest with the sign.
PARTS, PART_BITS = 4, 40


@dataclass
class Whitening:
    """What was fitted: vectors, their entries' sums, and the components.

    ``roots`` are the eigenvalues of the scatter, as (numerator, bits of denominator);
    those of the covariance are smaller by the square of ``n``.
    """

    dimension: int
    n: int
    sums: list[int]  # of the entries without OFFSET
    scatter: list[list[int]]
    polynomial: list[int]  # from the constant term on
    roots: list[tuple[int, int]]
    vectors: np.ndarray  # a row for each component
    identity_error: float

    @property
    def trace(self) -> int:
        return sum(self.scatter[i][i] for i in range(self.dimension))

    def explained(self) -> list[float]:
        return [number / (self.trace << bits) for number, bits in self.roots]

    def scales(self) -> np.ndarray:
        """Square roots of the scatter's eigenvalues."""
        return np.sqrt(np.array([number / (1 << bits) for number, bits in self.roots], dtype=float))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows whose entries can all be whitened."""
    df = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    most = F.lit(float(1 << 55))  # SCALE times it, and OFFSET, fit a long
    fits = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= most))
    return df.filter(F.col("vector").isNotNull() & fits & (F.size("vector") > 0))


def entries(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    """The rows' integers without OFFSET, as longs."""
    values = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * values).astype(np.int64).reshape(-1, dimension)


def exact_gram(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers; through doubles where these are exact."""
    most = int(np.abs(x).max(initial=0))
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    if most >= 1 << 26:
        wide = x.astype(object)
        return total + wide.T @ wide
    step = (1 << 53) // max(1, most * most)
    for at in range(0, len(x), step):
        part = x[at : at + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def in_parts(value: int) -> list[int]:
    mask = (1 << PART_BITS) - 1
    return [(value >> (PART_BITS * k)) & mask for k in range(PARTS)] + [value >> (PART_BITS * PARTS)]


def moments(rows: DataFrame, dimension: int) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and sums of products of the entries, exactly.

    A one before each vector makes all three one matrix. Each task sends one of them.
    """
    names = [f"p{k}" for k in range(PARTS + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension + 1, dimension + 1), dtype=object)
        for batch in batches:
            x = entries(batch, dimension)
            total += exact_gram(np.hstack([np.ones((len(x), 1), dtype=np.int64), x]))
        i, j = np.triu_indices(dimension + 1)
        parts = list(zip(*(in_parts(int(v)) for v in total[i, j])))
        columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(p, pa.int64()) for p in parts)]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *names])

    schema = "i int, j int, " + ", ".join(f"{p} long" for p in names)
    sums = rows.select("vector").mapInArrow(run, schema).groupBy("i", "j").agg(*(F.sum(p) for p in names))
    whole = [[0] * (dimension + 1) for _ in range(dimension + 1)]
    for i, j, *parts in sums.collect():
        whole[i][j] = whole[j][i] = sum(p << (PART_BITS * k) for k, p in enumerate(parts))
    return whole[0][0], whole[0][1:], [row[1:] for row in whole[1:]]


def is_prime(n: int) -> bool:
    """Miller and Rabin's test; these four bases decide all numbers below 2**31."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def enough_primes(bound: int) -> list[int]:
    """Primes below 2**31, the largest first, whose product is above the bound."""
    primes, product = [], 1
    for n in count((1 << 31) - 1, -2):
        if product > bound:
            return primes
        if is_prime(n):
            primes.append(n)
            product *= n


def hessenberg(matrix: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo p that is zero below the first subdiagonal."""
    h = matrix % p
    d = len(h)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        pivot = k + int(below[0])
        if pivot != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        factors = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - factors[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factors % p).sum(axis=1)) % p
    return h


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """The characteristic polynomial modulo p, from the constant term on."""
    h = hessenberg(matrix, p)
    d = len(h)
    minors = np.zeros((d + 1, d + 1), dtype=np.int64)  # those of the leading parts
    minors[0, 0] = 1
    for k in range(1, d + 1):
        factors, product = np.zeros(k, dtype=np.int64), 1
        for i in range(k - 1, -1, -1):
            factors[i] = int(h[i, k - 1]) * product % p
            product = product * int(h[i, i - 1]) % p if i else 0
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - (factors[:, None] * minors[:k] % p).sum(axis=0)) % p
    return minors[d]


def characteristic_polynomial(spark: SparkSession, scatter: list[list[int]]) -> list[int]:
    """Exact coefficients from the constant term on; the primes are dealt to tasks.

    The eigenvalues are not negative and their mean is trace / d, so the coefficient of
    degree d - k is at most C(d, k) * (trace / d) ** k, with the sign of (-1) ** k.
    """
    d = len(scatter)
    mean = -(-sum(scatter[i][i] for i in range(d)) // d)
    primes = enough_primes(max(comb(d, k) * mean**k for k in range(d + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.column(0).to_pylist():
                p = primes[place]
                reduced = np.array([[v % p for v in row] for row in scatter], dtype=np.int64)
                found = [polynomial_modulo(reduced, p).tolist()]
                columns = [pa.array([place], pa.int64()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "rests"])

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    found = spark.range(0, len(primes), 1, tasks).mapInArrow(run, "id long, rests array<long>")
    rests = dict(found.collect())
    whole = 1
    for p in primes:
        whole *= p
    units = [whole // p * pow(whole // p % p, -1, p) for p in primes]
    out = []
    for degree in range(d + 1):
        sign = -1 if (d - degree) % 2 else 1
        size = sum(unit * (sign * rests[i][degree] % p) for i, (unit, p) in enumerate(zip(units, primes)))
        out.append(sign * (size % whole))
    return out


def roots_above(polynomial: list[int], number: int, bits: int) -> int:
    """How many roots are above number / 2**bits, with multiplicity; all roots are real."""
    d = len(polynomial) - 1
    shifted = [c << (bits * (d - k)) for k, c in enumerate(polynomial)]
    for first in range(d):
        for k in range(d - 1, first - 1, -1):
            shifted[k] += number * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(polynomial: list[int], number: int, bits: int) -> int:
    value, unit = 0, 1
    for c in reversed(polynomial):
        value = value * number + c * unit
        unit <<= bits
    return (value > 0) - (value < 0)


def isolate(polynomial: list[int], highest: int, place: int) -> tuple[int, int, int, int]:
    """The root at a place, counted from 1 by falling size, as (number, bits, first, many).

    It is number / 2**bits, off by less than its 2**-ROOT_BITS part; it and others that
    cannot be told from it have the places from ``first`` on, ``many`` in all.
    """
    low, high, bits = 0, highest, 0
    above_low, above_high = roots_above(polynomial, 0, 0), 0
    sign = sign_at(polynomial, high, bits)
    while high - low > 1 or high.bit_length() <= ROOT_BITS + 1:
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        if above_low - above_high == 1 and sign:  # one simple root: its signs decide
            at_middle = sign_at(polynomial, middle, bits)
            if at_middle == 0:
                return middle, bits, place, 1
            if at_middle == sign:
                high = middle
            else:
                low = middle
            continue
        above = roots_above(polynomial, middle, bits)
        if above >= place:
            low, above_low = middle, above
        else:
            high, above_high = middle, above
            sign = sign_at(polynomial, high, bits)
    return high, bits, above_high + 1, above_low - above_high


def null_vectors(
    matrix: list[list[int]], number: int, bits: int, many: int = 1, wanted: int | None = None
) -> list[list[int]]:
    """Orthogonal long-integer vectors for the eigenvalue number / 2**bits.

    ``many`` is how often it is one; the first ``wanted`` vectors are returned, by
    default all. Gauss's elimination with pivots of 2**bits * matrix - number, in
    numbers of fixed size; then two solutions from each of the fixed starts. The shift
    for a multiple eigenvalue is a little off, so that all its vectors grow alike.
    """
    d = len(matrix)
    if many > 1:
        number += number >> (ROOT_BITS // 2)
    a = np.array(matrix, dtype=object) * (1 << bits)
    for i in range(d):
        a[i, i] -= number
    one = int(max(abs(v) for v in a.flat)).bit_length() + GUARD_BITS
    order = list(range(d))
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if a[k, k] == 0:
            a[k, k] = 1  # the matrix is singular here, as it should be
        a[k + 1 :, k] = (a[k + 1 :, k] << one) // a[k, k]
        a[k + 1 :, k + 1 :] -= (a[k + 1 :, k][:, None] * a[k, k + 1 :][None, :]) >> one

    def solve(b: np.ndarray) -> np.ndarray:
        x = b[order]
        for k in range(d):
            x[k + 1 :] -= (a[k + 1 :, k] * x[k]) >> one
        for k in range(d - 1, -1, -1):
            x[k] = ((x[k] << one) - int(a[k, k + 1 :] @ x[k + 1 :])) // a[k, k]
        return x

    def sized(x: np.ndarray) -> np.ndarray:
        excess = max(1, max(abs(v) for v in x)).bit_length() - one
        return x >> excess if excess > 0 else x << -excess

    found: list[np.ndarray] = []
    for start in range(many if wanted is None else wanted):
        x = np.array([1 + (i + 1) * (start + 2) * 7919 % 104729 for i in range(d)], dtype=object) << one
        for _ in range(2):
            x = sized(solve(x))
            for other in found:
                x = sized(x - other * int(x @ other) // int(other @ other))
        found.append(x)
    return [[int(v) for v in x] for x in found]


def unit(vector: list[int]) -> list[float]:
    """The vector as doubles of length 1; its largest entry is positive."""
    largest = max(vector, key=abs)
    length = isqrt(sum(v * v for v in vector)) * (1 if largest > 0 else -1)
    return [v / length for v in vector]


def principal(spark: SparkSession, scatter: list[list[int]], polynomial: list[int], wanted: int) -> list[tuple]:
    """(root as number and bits, unit vector) by falling root; the roots are dealt to tasks."""
    highest = sum(scatter[i][i] for i in range(len(scatter)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.column(0).to_pylist():
                number, bits, first, many = isolate(polynomial, highest, place)
                vector = unit(null_vectors(scatter, number, bits, many, place - first + 1)[-1])
                columns = [[place], [str(number)], [bits], [vector]]
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64())]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "number", "bits", "vector"])

    schema = "id long, number string, bits int, vector array<double>"
    found = spark.range(1, wanted + 1, 1, wanted).mapInArrow(run, schema).collect()
    return [(int(number), bits, vector) for _, number, bits, vector in sorted(found)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: as longs where they surely fit, else as Python integers."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if most < 1 << 61:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def projector(fit: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    """From centred entries to whitened ones: the count of vectors cancels out."""
    by_component = fit.vectors.T / fit.scales()
    return lambda z: z.astype(np.float64) @ by_component


def whitened_error(rows: DataFrame, fit: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    k, n, dimension = len(fit.roots), fit.n, fit.dimension

    def summed(of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            project, total = projector(fit), np.zeros(size)
            for batch in batches:
                total += of(project(centred(entries(batch, dimension), n, fit.sums)))
            columns = [pa.array(np.arange(size), pa.int32()), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "v"])

        sums = rows.select("vector").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v"))
        return np.array([v for _, v in sorted(sums.collect())])

    mean = summed(lambda w: w.sum(axis=0), k) / n
    covariance = summed(lambda w: ((w - mean).T @ (w - mean)).ravel(), k * k).reshape(k, k) / n
    return float(np.abs(covariance - np.eye(k)).max())


def fit_whitening(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
) -> Whitening | None:
    """Fit on all usable vectors; None if there is none, or all of them are equal.

    Components are numbered by falling eigenvalue. Those of an eigenvalue 0 (fewer
    vectors than dimensions, or constant entries) do not exist, as nothing can be
    divided by their deviation. Of equal eigenvalues the components are some orthogonal
    ones, the same in every run.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    dimension = rows.agg(F.max(F.size("vector"))).first()[0]
    if dimension is None:
        return None
    rows = rows.filter(F.size("vector") == dimension)
    n, sums, products = moments(rows, dimension)
    scatter = [[n * v - sums[i] * sums[j] for j, v in enumerate(row)] for i, row in enumerate(products)]
    if not any(scatter[i][i] for i in range(dimension)):
        return None
    polynomial = characteristic_polynomial(spark, scatter)
    zeros = next(i for i, c in enumerate(polynomial) if c)
    found = principal(spark, scatter, polynomial, min(components, dimension - zeros))
    roots = [(number, bits) for number, bits, _ in found]
    units = np.array([vector for *_, vector in found])
    fit = Whitening(dimension, n, sums, scatter, polynomial, roots, units, 0.0)
    fit.identity_error = whitened_error(rows, fit)
    return fit


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    fit: Whitening | None = None,
) -> DataFrame:
    """``id_col``, component, n, deviation, whitened, explained and identity_error.

    Each entry c becomes x = floor(64 * c) + 1000000. Rows whose vector is null, empty,
    or holds an entry that is null, not finite or too large for x to be a long are left
    out. So are vectors with fewer entries than the longest, as their last entries are
    missing. Equal rows and ids are all kept, a null id too; an empty table, and one
    whose vectors are all equal, give an empty result. Other columns are not read.

    ``deviation`` is exact; it is null where it does not fit a long. ``explained`` is the
    eigenvalue's share of the trace. ``fit`` is fitted on the same table if not given.

    Nothing is shuffled but one matrix of sums for each task.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    if fit is None:
        fit = fit_whitening(vectors, id_col, vector_col, components)
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    rows = usable(vectors, id_col, vector_col).filter(F.size("vector") == fit.dimension)
    explained, k = np.array(fit.explained()), len(fit.roots)
    largest = (1 << 63) - 1

    def deviations(z: np.ndarray) -> pa.Array:
        if z.dtype != object and fit.dimension * int(np.abs(z).max(initial=0)) ** 2 <= largest:
            return pa.array((z * z).sum(axis=1), pa.int64())
        exact = [sum(int(v) ** 2 for v in row) for row in z]
        return pa.array([v if v <= largest else None for v in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = projector(fit)
        for batch in batches:
            z = centred(entries(batch, fit.dimension), fit.n, fit.sums)
            rows = len(z)
            row = pa.array(np.repeat(np.arange(rows), k))
            columns = [
                batch.column(0).take(row),
                pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                pa.array(np.full(rows * k, fit.n), pa.int64()),
                deviations(z).take(row),
                pa.array(project(z).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, fit.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema_names)

    schema_names = [part.split()[0] for part in schema.split(", ")]
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)

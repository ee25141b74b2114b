"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix.

Entries become integers, x = floor(256 * c).  The fit list is each distinct integer vector once; its n, sums S and products
are added up exactly, so n * sum(x x') - S S' is an integer matrix, n * n times the covariance.  Its characteristic
polynomial is taken modulo 31-bit primes by Hessenberg reduction - one Spark task's work for each share of the primes - and
put together by Chinese remaindering.  All its roots are real, so the sign changes of the polynomial moved by a number
count the roots above it exactly; bisection isolates each root to 2**-120 of the trace, and inverse iteration on the nearly
singular matrix gives the vector of its null space in 100-digit decimals.

What reaches the driver has a size given by the dimension and not by the rows: d * d sums and a few residues for each
prime.  Rows are read three times: for the distinct vectors, for the figures of the whitened fit list, for the result.

Defined results: rows with a NULL vector, or NULL, NaN or infinite entries, are left out; so are vectors of other than the
most usual length (of equally usual ones the longest), and empty vectors.  Integers are held within plus or minus 2**40,
and a deviation beyond a long is the largest long.  Components of variance 0 don't exist, so fewer than four may come back
and none for a single distinct vector or an empty table.  Equal variances are taken in any order with orthogonal vectors;
the sign makes a component's largest entry positive (of equally large ones the first).  Repeated rows give a row each and count
once in the fit; a NULL id is an id like another; other columns of the vectors are not read.  Vectors of any length fit, at
a cost of the fourth power of the dimension.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.llm.common import stored
from tillwatch.llm.vectors import finite_rows, scaled

SCALE = 256
COMPONENTS = 4
LIMIT = 2**40
ROOT_BITS = 120
DIGITS = 100
#: Rows of one exact product in doubles: 8192 * 2**20 * 2**20 is 2**53.
PRODUCT_ROWS = 8192
HALF_BITS = 20


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: n, sums, unit vectors as columns, root of each variance, shares of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    spreads: np.ndarray
    explained: list[float]


def as_integers(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and x, the integer vector as 64-bit little-endian bytes, of the rows whose entries are all finite."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in finite_rows(batch.column(1)):
                if not matrix.shape[1]:
                    continue
                packed = [row.tobytes() for row in scaled(matrix, scale, LIMIT).astype("<i8")]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(packed, pa.binary())], ["vec_id", "x"])

    return vectors.select("vec_id", column).mapInArrow(pack, f"vec_id {kind}, x binary")


def unpacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(len(column), -1)


def products(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers; the doubles in between stay exact."""
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    whole = lambda a, b: (a.T.astype(np.float64) @ b.astype(np.float64)).astype(np.int64).astype(object)
    for i in range(0, len(x), PRODUCT_ROWS):
        part = x[i : i + PRODUCT_ROWS]
        if np.abs(part).max() < 1 << HALF_BITS:
            total += whole(part, part)
        else:
            high, low = part >> HALF_BITS, part & ((1 << HALF_BITS) - 1)
            cross = whole(high, low)
            total += (whole(high, high) << 2 * HALF_BITS) + ((cross + cross.T) << HALF_BITS) + whole(low, low)
    return total


def moments(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, the sums and the matrix of sums of products of the fit list, exact."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, square, total = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = unpacked(batch.column(0))
                n += len(x)
                one, sums = products(x), x.astype(object).sum(axis=0)
                square, total = (one, sums) if square is None else (square + one, total + sums)
        if n:
            rows = [(-1, -1, n), *((-1, j, int(v)) for j, v in enumerate(total))]
            rows += [(i, j, int(square[i, j])) for i in range(len(total)) for j in range(i, len(total))]
            i, j, value = zip(*rows)
            columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(list(map(Decimal, value)), pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "value"])

    parts = fit.mapInArrow(add, "i int, j int, value decimal(38,0)")
    # (d + 1) * (d + 2) / 2 + 1 rows at most, whatever the number of vectors.
    found = {(r["i"], r["j"]): int(r["value"]) for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}
    n = found.get((-1, -1), 0)
    d = max((j for _, j in found), default=-1) + 1
    square = np.array([[found[min(i, j), max(i, j)] for j in range(d)] for i in range(d)], dtype=object).reshape(d, d)
    return n, [found[-1, j] for j in range(d)], square


def is_prime(n: int) -> bool:
    """Miller and Rabin's test; these bases decide every number below 3.2 * 10**9."""
    if n < 11:
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """31-bit primes whose product exceeds `bound`."""
    found, product, at = [], 1, 2**31 - 1
    while product <= bound:
        if is_prime(at):
            found.append(at)
            product *= at
        at -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """The coefficients of det(x - matrix) modulo a 31-bit prime, the leading one first."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for j in range(d - 2):
        pivots = np.flatnonzero(h[j + 1 :, j])
        if not len(pivots):
            continue
        k = j + 1 + int(pivots[0])
        if k != j + 1:
            h[[j + 1, k]] = h[[k, j + 1]]
            h[:, [j + 1, k]] = h[:, [k, j + 1]]
        times = h[j + 2 :, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2 :] = (h[j + 2 :] - times[:, None] * h[j + 1] % p) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2 :] * times % p).sum(axis=1)) % p
    # The leading minors of the Hessenberg form, lowest coefficient first.
    minors = [np.zeros(d + 1, dtype=np.int64)]
    minors[0][0] = 1
    for k in range(1, d + 1):
        last = minors[-1]
        out = (np.roll(last, 1) - h[k - 1, k - 1] * last) % p
        below = 1
        for i in range(k - 2, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            out = (out - below * int(h[i, k - 1]) % p * minors[i]) % p
        minors.append(out)
    return minors[-1][::-1].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """det(x - matrix) of a positive semidefinite integer matrix: its integer coefficients, the leading one first."""
    d, trace = len(matrix), int(np.trace(matrix))
    # The k-th symmetric function of the roots is greatest where they are all trace / d.
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_for(2 * bound)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [polynomial_modulo(matrix, p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["p", "residues"])

    tasks = min(len(primes), 2 * spark.sparkContext.defaultParallelism)
    listed = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    # d + 1 residues for each prime.
    rows = listed.mapInArrow(residues, "p long, residues array<long>").collect()
    product = math.prod(primes)
    parts = [(product // r["p"]) * pow(product // r["p"], -1, r["p"]) for r in rows]
    sums = [sum(part * r["residues"][k] for part, r in zip(parts, rows)) % product for k in range(d + 1)]
    return [s - product if 2 * s > product else s for s in sums]


def roots_above(polynomial: list[int], at: int) -> int:
    """How many roots, counted as often as they occur, exceed `at`; exact, as all of them are real."""
    moved = list(polynomial)
    for end in range(len(moved) - 1, 0, -1):
        for i in range(1, end + 1):
            moved[i] += at * moved[i - 1]
    signs = [c > 0 for c in moved if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(polynomial: list[int], trace: int, count: int) -> tuple[list[int], int]:
    """Up to `count` positive roots in falling order as (numbers a, shift): each root is in (a, a + 1] / 2**shift."""
    shift = max(0, ROOT_BITS - trace.bit_length())
    polynomial = [c << shift * k for k, c in enumerate(polynomial)]
    found: list[int] = []
    high = trace << shift
    for k in range(1, min(count, roots_above(polynomial, 0)) + 1):
        low, top = 0, high
        while low < top:  # the greatest a with at least k roots above it
            middle = (low + top + 1) // 2
            low, top = (middle, top) if roots_above(polynomial, middle) >= k else (low, middle - 1)
        found.append(low)
        high = low
    return found, shift


def null_vectors(matrix: np.ndarray, roots: list[int], shift: int) -> np.ndarray:
    """Unit vectors (columns) of the matrix for the isolated roots, by inverse iteration in decimals."""
    d = len(matrix)
    found: list[np.ndarray] = []
    with localcontext() as context:
        context.prec = DIGITS
        exact = np.array([[Decimal(int(v)) for v in row] for row in matrix], dtype=object)
        tiny = (abs(exact).max() + 1).scaleb(-DIGITS)
        for root in roots:
            value = (Decimal(2 * root + 1)) / (Decimal(2) ** (shift + 1))
            a = exact.copy()
            a[np.arange(d), np.arange(d)] -= value
            order = np.arange(d)
            for j in range(d):  # elimination with row pivots, factors kept below the diagonal
                k = j + int(np.argmax(abs(a[j:, j])))
                if k != j:
                    a[[j, k]], order[[j, k]] = a[[k, j]], order[[k, j]]
                if not a[j, j]:
                    a[j, j] = tiny
                a[j + 1 :, j] = a[j + 1 :, j] / a[j, j]
                a[j + 1 :, j + 1 :] -= np.outer(a[j + 1 :, j], a[j, j + 1 :])
            v = np.array([1 + Decimal((7 * i * i + 3 * i + len(found)) % 101) / 101 for i in range(d)], dtype=object)
            for _ in range(3):
                v = v[order]
                for j in range(d):
                    v[j + 1 :] -= a[j + 1 :, j] * v[j]
                for j in range(d - 1, -1, -1):
                    v[j] = v[j] / a[j, j]
                    v[:j] -= a[:j, j] * v[j]
                v = v / max(abs(v))
                for other in found:  # roots that are equal, or closer than the digits tell
                    v = v - other * (other * v).sum()
                v = v / (v * v).sum().sqrt()
            greatest = max(abs(v))
            first = next(i for i in range(d) if abs(v[i]) > greatest * (1 - Decimal("1e-12")))
            found.append(-v if v[first] < 0 else v)
    return np.array([[float(c) for c in v] for v in found]).reshape(len(found), d).T


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a stored list of distinct integer vectors of one length."""
    n, sums, square = moments(fit)
    if not n:
        return None
    total = np.array(sums, dtype=object)
    scatter = n * square - np.outer(total, total)
    trace = int(np.trace(scatter))
    if not trace:
        return None
    polynomial = characteristic_polynomial(fit.sparkSession, scatter)
    roots, shift = largest_roots(polynomial, trace, components)
    values = [(2 * a + 1, 1 << (shift + 1)) for a in roots]
    spreads = np.array([math.sqrt(v / (w * n * n)) for v, w in values])
    return Whitening(n, sums, null_vectors(scatter, roots, shift), spreads, [v / (w * trace) for v, w in values])


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """`rows` (with integer vectors x) with w, the whitened components, and deviation, the exact squared distance n * x - S."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in rows.columns if c != "x"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sums = np.array(m.sums, dtype=object)
        largest = max(map(abs, m.sums))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpacked(batch.column(batch.schema.names.index("x")))
            reach = m.n * int(np.abs(x).max()) + largest
            if reach * reach * x.shape[1] < 2**62:
                centred = m.n * x - sums.astype(np.int64)
                deviation = (centred * centred).sum(axis=1)
            else:
                centred = m.n * x.astype(object) - sums
                deviation = [min(int(v), 2**63 - 1) for v in (centred * centred).sum(axis=1)]
            w = (centred / m.n).astype(np.float64) @ m.vectors / m.spreads
            columns = [batch.column(batch.schema.names.index(c)) for c in kept]
            columns += [pa.array(deviation, pa.int64()), pa.array(w.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "deviation", "w"])

    return rows.mapInArrow(project, ", ".join(filter(None, [schema, "deviation long, w array<double>"])))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    k = len(model.explained)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    entries = [F.covar_pop(F.col("w")[i], F.col("w")[j]) - F.lit(float(i == j)) for i, j in pairs]
    return whiten(fit, model).agg(F.greatest(F.lit(0.0), *[F.abs(e) for e in entries]).alias("e")).first()["e"]


def whitening_digest(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Every remaining row and component: n, deviation, whitened, explained and identity_error."""
    rows = stored(as_integers(vectors, column), "whitening-integers")
    usual = rows.groupBy(F.octet_length("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if usual is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.octet_length("x") == usual["size"])
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    model = fit_whitening(fit)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shares = F.array(*[F.lit(e) for e in model.explained])
    out = whiten(rows, model).select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("at")].alias("explained"),
        F.lit(identity_error(fit, model)).alias("identity_error"),
    )

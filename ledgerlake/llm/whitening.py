"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix.

Vectors are rounded to a grid of integers, and every distinct one counts once. Sums and sums of products are
exact integers, so n times the scatter matrix (n * sum(x x') - S S', which is n^2 times the covariance) is
exact too. Its characteristic polynomial is computed modulo many primes, by reduction to Hessenberg form, and
put together by the Chinese remainder theorem. All roots of that polynomial are real, so the changes of sign
after a shift by a count the roots above a exactly; bisection isolates each root and goes on to far more
digits than a double has. Inverse iteration at a root, in decimal arithmetic of 80 digits, gives the null space
of matrix less root: the component.

Tasks sum over vectors; primes and components are tasks of their own. Only numbers whose count follows from
the dimension reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import fresh, staged

#: Bits of a root behind those of the largest one, and digits of the arithmetic that uses it.
ROOT_BITS, DIGITS = 192, 80
#: A sum of products travels as limbs of 40 bits, which sum without overflow over 2^22 tasks.
_LIMB, _LIMBS = 40, 5


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with ``sums`` a dimension; ``components`` (unit rows), their ``eigenvalues`` and ``explained`` share of the trace."""

    scale: int
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def on_grid(vector: str, scale: int) -> Column:
    """floor(scale * entry) of every entry, as BIGINTs; null for vectors that take no part.

    Those are null, hold null or non-finite entries, or entries beyond 2^61 / scale, whose grid place is
    no BIGINT. A constant added to every place changes nothing that is computed here, so none is.
    """
    scaled = F.transform(vector, lambda c: F.floor(F.lit(scale) * c.cast("double")))
    fit = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) * scale < 2.0**61))  # false for NaN, which is largest
    return F.when(fit, scaled)


def _products(a: np.ndarray) -> np.ndarray:
    """a' a, exactly, as Python integers."""
    top = max(int(np.abs(a).max(initial=0)), 1)
    if top * top * len(a) < 2**53:  # sums of products stay whole numbers that a double holds
        return (a.T.astype(np.float64) @ a.astype(np.float64)).astype(np.int64).astype(object)
    pieces, rest = [], a
    while True:  # digits of base 2^16, the last one signed
        last = bool(np.abs(rest).max() < 2**15)
        pieces.append((rest if last else rest & 0xFFFF).astype(np.float64))
        if last:
            break
        rest = rest >> 16
    total = np.zeros((a.shape[1],) * 2, object)
    for at in range(0, len(a), 2**20):
        block = [p[at : at + 2**20] for p in pieces]
        for i, p in enumerate(block):
            for j, q in enumerate(block):
                total = total + ((p.T @ q).astype(np.int64).astype(object) << (16 * (i + j)))
    return total


def _sum_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """i, j and limbs of the sums of products of (1, x), once for each task."""
    total = None
    for b in batches:
        flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
        if b.num_rows:
            a = np.hstack([np.ones((b.num_rows, 1), np.int64), flat.reshape(b.num_rows, -1)])
            total = _products(a) if total is None else total + _products(a)
    if total is None:
        return
    i, j = np.triu_indices(len(total))
    values = total[i, j]
    limbs = [((values >> (_LIMB * k)) & (2**_LIMB - 1) if k < _LIMBS - 1 else values >> (_LIMB * k)).astype(np.int64) for k in range(_LIMBS)]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i.astype(np.int32), j.astype(np.int32), *limbs)], ["i", "j", *[f"limb{k}" for k in range(_LIMBS)]])


def sums_of_products(vectors: DataFrame, size: int) -> np.ndarray:
    """Exact sums over all rows of (1, x)' (1, x), for a column of integer vectors of that size; zeros for no rows."""
    limbs = [f"limb{k}" for k in range(_LIMBS)]
    parts = vectors.mapInArrow(_sum_products, "i int, j int, " + ", ".join(f"{x} bigint" for x in limbs))
    out = np.zeros((size + 1, size + 1), object)
    for r in parts.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in limbs]).collect():  # as many as the matrix has places
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = sum(r[x] << (_LIMB * k) for k, x in enumerate(limbs))
    return out


def _is_prime(n: int) -> bool:
    """Of odd numbers from 9 to 3.2 * 10^9 (Miller-Rabin to the bases 2, 3, 5 and 7, exact there)."""
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    return all(pow(a, d, n) == 1 or any(pow(a, d << r, n) == n - 1 for r in range(s)) for a in (2, 3, 5, 7))


def primes_for(bits: int) -> list[int]:
    """The largest primes below 2^31 whose product has more than ``bits`` bits."""
    out, n, have = [], 2**31 - 1, 0.0
    while have <= bits:
        if _is_prime(n):
            out.append(n)
            have += log2(n)
        n -= 2
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo the prime p, the constant first."""
    h = np.array(matrix % p, np.int64)
    d = len(h)
    for m in range(1, d - 1):  # similar matrix without entries below the first subdiagonal
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + below[0]
        h[[m, pivot]] = h[[pivot, m]]
        h[:, [m, pivot]] = h[:, [pivot, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        polys[k + 1, 1:] = polys[k, :-1]
        weights, product = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weights[i] = int(h[i, k]) * product % p
            product = product * int(h[i, i - 1]) % p if i else 0
        polys[k + 1] = (polys[k + 1] - (weights[:, None] * polys[: k + 1] % p).sum(axis=0)) % p
    return polys[d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Integer coefficients of det(x - matrix), the constant first, of a positive semidefinite matrix of Python integers.

    A coefficient is a sum of products of the roots, so none exceeds (1 + trace / size) to the power of the
    size in magnitude. Each prime is a row of a job of its own.
    """
    d = len(matrix)
    primes = primes_for(int(d * log2(1 + int(np.trace(matrix)) / d)) + 3)

    def residues(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"p": b["p"], "c": [polynomial_modulo(matrix, int(p)) for p in b["p"]]})

    jobs = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64))
    value, product = [0] * (d + 1), 1
    for r in sorted(jobs.mapInPandas(residues, "p long, c array<long>").collect()):
        p, inverse = r["p"], pow(product, -1, r["p"])
        value = [v + product * ((c - v) * inverse % p) for v, c in zip(value, r["c"], strict=True)]
        product *= p
    return [v - product if 2 * v > product else v for v in value]


def _shifted(c: list[int], a: int) -> list[int]:
    """Coefficients of p(x + a)."""
    out = list(c)
    for k in range(len(c) - 1):
        for j in range(len(c) - 2, k - 1, -1):
            out[j] += a * out[j + 1]
    return out


def roots_above(c: list[int], a: int) -> int:
    """The number of roots greater than a, by multiplicity, of a polynomial whose roots are all real (Descartes' rule is exact for those)."""
    signs = [x > 0 for x in _shifted(c, a) if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def largest_roots(c: list[int], most: int, bits: int = ROOT_BITS) -> tuple[list[int], int]:
    """(the ``most`` largest positive roots times 2^shift, falling, multiple ones repeated; shift).

    ``c``: the constant first, leading coefficient 1, roots real and not negative. Roots are rounded up to
    whole units of 2^-shift, which are ``bits`` finer than the sum of all roots; roots closer than that come out equal.
    """
    d = len(c) - 1
    shift = max(0, bits - max(-c[d - 1], 1).bit_length()) if d else 0
    c = [x << (shift * (d - k)) for k, x in enumerate(c)]
    most = min(most, d - next(k for k, x in enumerate(c) if x))  # zero is a root as often as trailing coefficients are zero
    found: list[int] = []
    todo = [(0, -c[d - 1], d, 0)] if most else []  # low, high, roots above low, roots above high
    while todo and len(found) < most:
        low, high, above_low, above_high = todo.pop()
        if above_low == above_high:
            continue
        if high - low == 1:
            found += [high] * (above_low - above_high)
        elif above_low - above_high == 1:
            found.append(_only_root(c, low, high))
        else:
            middle = (low + high) // 2
            above = roots_above(c, middle)
            todo += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return found[:most], shift


def _value(c: list[int], x: int) -> int:
    out = 0
    for k in reversed(c):
        out = out * x + k
    return out


def _only_root(c: list[int], low: int, high: int) -> int:
    """The one root in (low, high], rounded up to a whole number."""
    at_high = _value(c, high)
    if at_high == 0:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        v = _value(c, middle)
        if v == 0:
            return middle
        low, high = (low, middle) if (v > 0) == (at_high > 0) else (middle, high)
    return high


def null_vectors(matrix: np.ndarray, root: int, shift: int, count: int, rounds: int = 3) -> np.ndarray:
    """``count`` orthonormal vectors that matrix less root / 2^shift sends (nearly) to zero, as rows; the largest entry of each is positive."""
    d = len(matrix)
    with localcontext(Context(prec=DIGITS)):
        at = Decimal(root) / Decimal(2**shift)
        tiny = max(at, Decimal(1)) * Decimal(10) ** (5 - DIGITS)
        rows = [[Decimal(int(matrix[i, j])) - (at if i == j else 0) for j in range(d)] for i in range(d)]
        order = list(range(d))
        for k in range(d):  # triangular factors, with the largest pivot of each column
            p = max(range(k, d), key=lambda i: abs(rows[i][k]))
            rows[k], rows[p], order[k], order[p] = rows[p], rows[k], order[p], order[k]
            if abs(rows[k][k]) < tiny:
                rows[k][k] = tiny
            for i in range(k + 1, d):
                f = rows[i][k] / rows[k][k]
                rows[i][k] = f
                if f:
                    above, row = rows[k], rows[i]
                    for j in range(k + 1, d):
                        row[j] -= f * above[j]

        def solved(b: list[Decimal]) -> list[Decimal]:
            x = [b[k] for k in order]
            for i in range(d):
                x[i] -= sum((rows[i][j] * x[j] for j in range(i)), Decimal(0))
            for i in reversed(range(d)):
                x[i] = (x[i] - sum((rows[i][j] * x[j] for j in range(i + 1, d)), Decimal(0))) / rows[i][i]
            return x

        def unit(x: list[Decimal]) -> list[Decimal]:
            for _ in range(2):
                for y in out:
                    along = sum((a * b for a, b in zip(x, y, strict=True)), Decimal(0))
                    x = [a - along * b for a, b in zip(x, y, strict=True)]
            length = sum((a * a for a in x), Decimal(0)).sqrt()
            return [a / length for a in x]

        out: list[list[Decimal]] = []
        for k in range(count):
            x = unit([Decimal(int(v)) for v in np.random.default_rng(k).integers(1, 1000, d)])
            for _ in range(rounds):
                x = unit(solved(x))
            largest = max(x, key=abs)
            out.append([a if largest > 0 else -a for a in x])
        return np.array([[float(a) for a in x] for x in out])


def _components(spark: SparkSession, matrix: np.ndarray, roots: list[int], shift: int) -> np.ndarray:
    """A unit row for each root; each distinct root is a row of a job of its own."""
    distinct = sorted(set(roots), reverse=True)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [null_vectors(matrix, distinct[k], shift, roots.count(distinct[k])) for k in b["k"]]
            yield pd.DataFrame({"k": b["k"], "v": [x.ravel() for x in found]})

    jobs = spark.range(len(distinct), numPartitions=len(distinct)).withColumnRenamed("id", "k")
    parts = {r["k"]: np.array(r["v"]).reshape(-1, len(matrix)) for r in jobs.mapInPandas(solve, "k long, v array<double>").collect()}
    return np.vstack([parts[k] for k in range(len(distinct))])


def _projected(model: Whitening, x: np.ndarray) -> np.ndarray:
    """Centred rows on the components, over the root of their eigenvalues."""
    whole = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([s % model.n / model.n for s in model.sums])
    return ((x - whole) - rest) @ (model.components / np.sqrt(model.eigenvalues)[:, None]).T


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of whitened vectors less the identity."""
    m = len(model.components)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 1, m + 1))
        for b in batches:
            if b.num_rows:
                w = np.hstack([np.ones((b.num_rows, 1)), _projected(model, b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))])
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "v"])

    sums = np.zeros((m + 1) * (m + 1))
    for r in fit.mapInArrow(partial, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        sums[r["k"]] = r["v"]
    sums = sums.reshape(m + 1, m + 1)
    mean = sums[0, 1:] / model.n  # zero but for rounding, for rows were centred before they were multiplied
    return float(np.abs(sums[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(m)).max())


def fit_whitening(vectors: DataFrame, vector: str = "embedding", components: int = 16, scale: int = 64) -> Whitening | None:
    """Fit on every distinct grid vector of the most frequent length (the longer one, if two are as frequent).

    Vectors that take no part (see ``on_grid``) and those of other lengths are left out. Components have
    positive eigenvalues, so there may be fewer than asked for; None where there is none: no vectors,
    vectors of length 0, or one distinct vector only.
    """
    spark = vectors.sparkSession
    placed = vectors.select(on_grid(vector, scale).alias("x")).where("x IS NOT NULL")
    lengths = placed.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None or lengths["d"] == 0:
        return None
    fit = staged(placed.where(F.size("x") == lengths["d"]).distinct())
    products = sums_of_products(fit, lengths["d"])
    n, sums = int(products[0, 0]), [int(s) for s in products[0, 1:]]
    scatter = n * products[1:, 1:] - np.outer(products[0, 1:], products[0, 1:])
    trace = int(np.trace(scatter))
    if trace == 0:
        return None
    roots, shift = largest_roots(characteristic_polynomial(spark, scatter), components)
    unit = (n * n) << shift
    model = Whitening(scale, n, sums, _components(spark, scatter, roots, shift), np.array([r / unit for r in roots]), np.array([r / (trace << shift) for r in roots]))
    return Whitening(model.scale, n, sums, model.components, model.eigenvalues, model.explained, _identity_error(fit, model))


def with_whitened(vectors: DataFrame, model: Whitening, vector: str = "embedding", whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """All columns, and two more: the vector's whitened entries, one for each component, and the sum over dimensions of (n * x - S)^2.

    Both are null for vectors that take no part in the fit. The sum is exact, and null too where it is no
    BIGINT. Columns of those names are replaced.
    """
    kept = vectors.select(*[c for c in vectors.columns if c.lower() not in (whitened.lower(), deviation.lower())])
    size = len(model.sums)
    x = on_grid(vector, model.scale)
    grid = fresh(kept.columns, "grid")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = b.column(b.num_columns - 1)
            rows = np.flatnonzero(places.is_valid().to_numpy(zero_copy_only=False))
            x = places.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            flat = _projected(model, x)
            ends = np.zeros(b.num_rows + 1, np.int32)
            ends[rows + 1] = flat.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(flat.ravel()), mask=pa.array(places.is_null()))
            top = model.n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums))
            exact = np.int64 if top * top * size < 2**63 else object
            far = ((x.astype(exact) * model.n - np.array(model.sums, exact)) ** 2).sum(axis=1).tolist()
            sums: list[int | None] = [None] * b.num_rows
            for at, v in zip(rows.tolist(), far, strict=True):
                sums[at] = int(v) if v < 2**63 else None
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists, pa.array(sums, pa.int64())], [*b.schema.names[:-1], whitened, deviation])

    placed = kept.withColumn(grid, F.when(F.size(x) == size, x))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return placed.mapInArrow(measure, f"{fields}, `{whitened}` array<double>, `{deviation}` bigint")


def whitened_rows(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = 64) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector that takes part and component.

    Rows that agree in id or vector each give their own rows; a null id stays null. Without components
    (see ``fit_whitening``) or rows the result is empty. Other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(ident).alias("vec_id"), F.col(vector).alias("embedding"))
    model = fit_whitening(rows, "embedding", components, scale)
    if model is None:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    each = with_whitened(rows, model).where("whitened IS NOT NULL").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.get(F.array(*[F.lit(float(x)) for x in model.explained]), F.col("at"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(model.identity_error).alias("identity_error"))

"""Embedding whitening: exact covariance on Spark, its leading eigenpairs by spectrum slicing."""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE, SHIFT = 64, 1_000_000  # an entry c becomes floor(SCALE * c) + SHIFT
COMPONENTS = 32
_LONG = 1 << 63
_EXACT = float(1 << 53)  # sums of whole numbers below this are exact in double precision
_EPS = np.finfo(np.float64).eps


@dataclass
class Whitener:
    """What is fitted: number of vectors, exact sums by dimension, eigenpairs by falling eigenvalue, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray  # leading eigenvalues
    vectors: np.ndarray  # dimension x components, unit columns
    trace: float
    identity_error: float = math.nan

    @property
    def full(self) -> np.ndarray:
        """Components whose eigenvalue is above rounding; the others cannot be scaled to one."""
        top = self.values[0] if len(self.values) else 0.0
        return self.values > len(self.sums) * _EPS * max(top, 0.0) * 4


def finite(vector: Column) -> Column:
    """Whether a vector is not null and holds no null or non-finite entry."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return F.coalesce(~bad, F.lit(False))


def _whole(column: pa.Array, size: int) -> np.ndarray:
    """Entries of a batch of vectors as whole numbers, rows x size: longs, or Python numbers where a long could overflow."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    low = np.floor(SCALE * flat)
    if not low.size or np.abs(low).max() < 1 << 52:
        return low.astype(np.int64) + SHIFT
    return np.array([[math.floor(SCALE * x) if math.isfinite(SCALE * x) else SCALE * int(x) for x in row] for row in flat.tolist()], object) + SHIFT


def _sum_rows(source: DataFrame, add, size: int) -> dict[int, int]:
    """Sum of what `add` returns for each batch (cell -> whole number), over all vectors; one row for each cell reaches the driver."""

    def partial(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in stream:
            if batch.num_rows:
                for cell, value in enumerate(add(_whole(batch.column(0), size))):
                    total[cell] = total.get(cell, 0) + int(value)
        # Digits travel in three parts, since a sum may need more than a long.
        low, middle, high = ([(v >> s) & m if m else v >> s for v in total.values()] for s, m in ((0, 0xFFFFFFFF), (32, 0xFFFFFFFF), (64, 0)))
        columns = [pa.array(list(total), pa.int32()), pa.array(low, pa.int64()), pa.array(middle, pa.int64()), pa.array([max(-_LONG, min(_LONG - 1, v)) for v in high], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "low", "middle", "high"])

    parts = source.mapInArrow(partial, "cell int, low bigint, middle bigint, high bigint")
    summed = parts.groupBy("cell").agg(F.sum("low").alias("low"), F.sum("middle").alias("middle"), F.sum(F.col("high").cast("decimal(30,0)")).alias("high"))
    return {r["cell"]: r["low"] + (r["middle"] << 32) + (int(r["high"]) << 64) for r in summed.collect()}


def _products(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Upper triangle of the sum of d d' over the rows, d = x - centre, exactly."""
    upper = np.triu_indices(x.shape[1])
    d = x - centre
    most = int(abs(d).max())
    if most * most >= _EXACT:
        d = d.astype(object)
        return (d.T @ d)[upper]
    total = np.zeros(len(upper[0]), object)
    step = max(1, int(_EXACT // max(1, most * most)))
    for at in range(0, len(d), step):
        block = d[at : at + step].astype(np.float64)
        total = total + (block.T @ block)[upper].astype(np.int64).astype(object)
    return total


def negative_count(a: np.ndarray) -> int:
    """Number of negative eigenvalues of a symmetric matrix: the inertia of D in its LDL' factors.

    Symmetric elimination with diagonal pivots of one or two rows, chosen as Bunch and Kaufman do. An exact zero pivot counts as not negative.
    """
    a = a.copy()
    n, k, below = len(a), 0, 0
    ratio = (1 + math.sqrt(17)) / 8
    while k < n:
        column = np.abs(a[k + 1 :, k])
        r = int(column.argmax()) + k + 1 if len(column) else k
        most = column[r - k - 1] if len(column) else 0.0
        width, swap = 1, k
        if most > 0 and abs(a[k, k]) < ratio * most:
            others = np.abs(a[r, k:])
            others[r - k] = 0.0
            widest = others.max()
            if abs(a[k, k]) * widest >= ratio * most * most:
                pass
            elif abs(a[r, r]) >= ratio * widest:
                swap = r
            else:
                width, swap = 2, r
        at = k + width - 1
        if swap != at:
            a[[at, swap], k:] = a[[swap, at], k:]
            a[k:, [at, swap]] = a[k:, [swap, at]]
        if width == 1:
            pivot = a[k, k]
            below += pivot < 0
            if pivot != 0.0:
                c = a[k + 1 :, k].copy()
                a[k + 1 :, k + 1 :] -= np.outer(c, c / pivot)
        else:
            block, c = a[k : k + 2, k : k + 2].copy(), a[k + 2 :, k : k + 2].copy()
            below += 1 if block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0] < 0 else 2 * (block[0, 0] + block[1, 1] < 0)
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(block, c.T)
        k += width
    return int(below)


def _rayleigh(a: np.ndarray, low: float, high: float, known: np.ndarray, seed: int, scale: float) -> tuple[float, np.ndarray]:
    """Eigenpair of `a` in (low, high]: inverse steps at the middle, then Rayleigh quotient iteration, at right angles to `known`."""
    n = len(a)
    x = np.random.Generator(np.random.PCG64(seed)).standard_normal(n)

    def next_of(x, shift):
        for nudge in (0.0, 1.0, -1.0, 4.0):  # a shift that meets an eigenvalue to the last bit is moved by a rounding
            try:
                y = np.linalg.solve(a - (shift + nudge * _EPS * scale) * np.eye(n), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all() and (size := np.linalg.norm(y)) > 0:
                y = y / size
                for _ in range(2):
                    y = y - known @ (known.T @ y)
                return y / np.linalg.norm(y)
        raise ArithmeticError("no solution near an eigenvalue")

    shift = (low + high) / 2
    for _ in range(3):
        x = next_of(x, shift)
    value, best = float(x @ a @ x), (math.inf, 0.0, x)
    for _ in range(20):
        rest = float(np.linalg.norm(a @ x - value * x))
        if rest < best[0]:
            best = (rest, value, x)
        elif rest >= best[0] and best[0] <= 64 * n * _EPS * scale:
            break
        shift = value if low <= value <= high else (low + high) / 2
        x = next_of(x, shift)
        value = float(x @ a @ x)
    return best[1], best[2]


def leading_eigenpairs(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    The number of negative pivots of a - s I is the number of eigenvalues below s. Bisection by these counts gives each of the leading
    eigenvalues an interval that holds it alone, or, where eigenvalues agree to rounding, an interval as narrow as rounding. Rayleigh
    quotient iteration finishes each of them; a result outside its interval is refused and its interval narrowed, so the counts certify
    which eigenvalue has which number.
    """
    n = len(a)
    count = min(count, n)
    scale = float(np.abs(a).sum(axis=1).max()) if n else 0.0  # no eigenvalue is larger in size
    if not scale:
        return np.zeros(count), np.eye(n)[:, :count]
    known_counts: dict[float, int] = {}

    def above(s: float) -> int:
        if s not in known_counts:
            known_counts[s] = n - negative_count(a - s * np.eye(n))
        return known_counts[s]

    edge = scale * (1 + 1e-6)
    known_counts[edge], known_counts[-edge] = 0, n
    values, vectors = np.zeros(count), np.zeros((n, count))
    narrowest = 4 * n * _EPS * scale
    k = 0
    while k < count:
        # Largest point with more than k eigenvalues above it, and smallest with at most k, among those counted so far.
        low = max(s for s, c in known_counts.items() if c > k)
        high = min(s for s, c in known_counts.items() if c <= k)
        while True:
            alone = known_counts[low] - known_counts[high] == 1
            found = None
            if alone or high - low <= narrowest:
                value, vector = _rayleigh(a, low, high, vectors[:, :k], k, scale)
                if low - narrowest <= value <= high + narrowest:
                    found = value, vector
                elif high - low <= narrowest:
                    raise ArithmeticError("an eigenvalue could not be certified")
            if found:
                break
            middle = (low + high) / 2
            if above(middle) > k:
                low = middle
            else:
                high = middle
        values[k], vectors[:, k] = found
        k += 1
    return values, vectors


def _centred(x: np.ndarray, model: Whitener) -> tuple[np.ndarray, list[int]]:
    """x - floor(S / n) as whole numbers, and the rests S mod n."""
    base = [s // model.n for s in model.sums]
    kind = np.int64 if x.dtype != object and max(map(abs, base)) < 1 << 53 else object
    return x - np.array(base, kind), [s % model.n for s in model.sums]


def _projected(x: np.ndarray, model: Whitener) -> np.ndarray:
    """Whitened components of whole-number vectors. They are centred on whole numbers first, so that nothing large is rounded."""
    d, rests = _centred(x, model)
    d = d.astype(np.float64) - np.array([r / model.n for r in rests])
    with np.errstate(invalid="ignore", divide="ignore"):
        made = (d @ model.vectors) / np.sqrt(np.where(model.full, model.values, np.nan))
    return made


def _source(rows: DataFrame, vector_column: str) -> DataFrame:
    vectors = rows.select(F.col(vector_column).cast("array<double>").alias("vector"))
    return vectors.filter(finite(F.col("vector")))


def fit(rows: DataFrame, components: int = COMPONENTS, vector_column: str = "embedding") -> Whitener:
    """Fits on every usable vector: null vectors and ones with null or non-finite entries are left out.

    Vectors must agree in length to have a covariance: those of another length than the commonest (ties: the longer one) lack entries or
    hold too many, and are left out like vectors with null entries. Sums and products are whole numbers, added in tasks and then by cell in
    a shuffle, and exact, so neither the order of the rows nor a repeated task changes the result. One number for each cell of the
    covariance reaches the driver, whatever the number of rows; the eigenpairs of that matrix are found there.
    """
    source = _source(rows, vector_column)
    lengths = source.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if lengths is None or not lengths["size"]:
        return Whitener(lengths["n"] if lengths else 0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    size, n = lengths["size"], lengths["n"]
    source = source.filter(F.size("vector") == size)
    sums = _sum_rows(source, lambda x: x.astype(object).sum(axis=0) if x.dtype == object else x.sum(axis=0), size)
    sums = [sums[k] for k in range(size)]
    centre = np.array([s // n for s in sums])
    cells = _sum_rows(source, lambda x: _products(x, centre), size)
    v = np.zeros((size, size))
    off = [s - n * int(c) for s, c in zip(sums, centre)]  # sum of the centred entries
    for cell, (i, j) in enumerate(zip(*np.triu_indices(size))):
        exact = n * cells[cell] - off[i] * off[j]  # n^2 times the covariance, as a whole number
        v[i, j] = v[j, i] = exact / (n * n)
    values, vectors = leading_eigenpairs(v, components)
    model = Whitener(n, sums, values, vectors, float(np.trace(v)))
    model.identity_error = _identity_error(source, model)
    return model


def _identity_error(source: DataFrame, model: Whitener) -> float:
    """Largest entry of (covariance of the whitened fit list - identity) in size, from one more pass over the list.

    Tasks pass on sums and centred products of their own rows, which are combined by the rule for parts of a sample.
    """
    size, used = len(model.sums), np.flatnonzero(model.full)
    if not len(used):
        return 0.0

    def partial(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, np.zeros(len(used)), np.zeros((len(used), len(used)))
        for batch in stream:
            if batch.num_rows:
                w = _projected(_whole(batch.column(0), size), model)[:, used]
                m = w.mean(axis=0)
                d = w - m
                gap, both = m - mean, n + len(w)
                products += d.T @ d + np.outer(gap, gap) * (n * len(w) / both)
                mean, n = mean + gap * (len(w) / both), both
        if n:
            # Products about zero, the mean of all, are what adds up over tasks.
            flat = np.concatenate([n * mean, (products + n * np.outer(mean, mean)).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["cell", "value"])

    summed = source.mapInArrow(partial, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(len(used) * (len(used) + 1))
    for r in summed:
        flat[r["cell"]] = r["value"]
    mean = flat[: len(used)] / model.n
    covariance = flat[len(used) :].reshape(len(used), -1) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(len(used))).max())


def whiten(rows: DataFrame, model: Whitener, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of each usable row; repeated rows stay repeated, null ids stay null.

    `deviation` is the exact sum over dimensions of (n x - S)^2, null where it is no long. A component whose eigenvalue is zero to rounding
    has no scale: its value is null. An empty model (no vectors, or empty ones) gives no rows. Other columns aren't read.
    """
    size = len(model.sums)
    source = rows.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    source = source.filter(finite(F.col("vector")) & (F.size("vector") == size) & F.lit(size > 0))
    n = model.n

    def project(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            x = _whole(batch.column(1), size)
            w = _projected(x, model)
            d, rests = _centred(x, model)
            kind = np.int64 if size * (n * (int(abs(d).max()) + 1)) ** 2 < _LONG else object
            deviation = ((d.astype(kind) * n - np.array(rests, kind)) ** 2).sum(axis=1).tolist()
            deviation = [v if v < _LONG else None for v in deviation]
            flat = pa.array(w.ravel(), mask=np.isnan(w).ravel())
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(w) + 1) * w.shape[1]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return source.mapInArrow(project, "vec_id bigint, deviation bigint, whitened array<double>")

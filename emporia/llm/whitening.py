"""Operator 12: embedding whitening by spectrum slicing.

Method: entries become whole numbers x = floor(64 c) + 1000000, so counts and
sums are exact.  The covariance is gathered in two passes (sums, then products
of the centred entries) as one triangle a task.  Its leading eigenvalues are
found by slicing the spectrum: the covariance is brought to tridiagonal form
by reflections, where the LDL^T factors of the matrix minus a shift take one
step a row, and the signs of D count the eigenvalues above the shift
(Sylvester).  Bisection by counts isolates each eigenvalue from its
neighbours, Rayleigh quotient iteration on the covariance converges to it
cubically, and counts on both sides certify its number.  Vectors of eigenvalues
that lie close together are kept orthogonal.  Every row is then centred,
projected on the components and divided by their deviations; a last pair of
passes measures how far the covariance of the results is from the identity.

What reaches the driver is one sum a dimension and one triangle of
dimensions x dimensions for each length of vectors, whatever the number of rows.

Cases: rows whose vector is null or holds null, non-finite or huge entries
(64 c beyond 2^53) are dropped; vectors of each length are a fit list of their
own; an empty vector has no components; a component without variance (at most
``FLAT`` of the largest eigenvalue) cannot be whitened and is left out, so one
vector, or equal ones, give none; null ids and repeated rows are rows like
all others; an empty table gives an empty result; other columns pass through
``whiten``, but those named like a new one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from .scratch import ship, stored, table

# Fixed values of the contract.
SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 32
#: Rows taken at a time: so many entries below 2^54 sum up in 64 bits.
ROWS = 256
#: Eigenvalues at most this share of the largest count as zero; those closer than CLOSE of it get orthogonal vectors.
FLAT, CLOSE = 1e-12, 1e-3
LARGEST = 2.0**53


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector holds numbers only."""
    def fine(c):
        c = c.cast("double")
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) <= LARGEST)

    return vectors.where(F.coalesce(F.forall(column, fine), F.lit(False)))


def by_length(batch: pa.RecordBatch, column: str):
    """(rows, x) for the vectors of each length, ROWS at a time."""
    values = batch.column(column)
    sizes = np.asarray(values.value_lengths())
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        for low in range(0, len(rows), ROWS):
            part = rows[low:low + ROWS]
            flat = values.take(pa.array(part)).flatten().cast(pa.float64())
            yield part, np.floor(flat.to_numpy(zero_copy_only=False) * SCALE).astype(np.int64).reshape(len(part), d) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in 64 bits where that holds them, else as Python integers."""
    if len(x) and n * max(int(np.abs(x).max()), 1) < 2**62 and max(map(abs, sums), default=0) < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squares(y: np.ndarray) -> list[int]:
    """Sums of squares of whole numbers, exact."""
    if y.dtype != object and y.size and int(np.abs(y).max()) ** 2 * y.shape[1] < 2**62:
        return (y * y).sum(1).tolist()
    return [sum(int(v) ** 2 for v in row) for row in y.tolist()]


# -- eigenvalues


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of ``a`` (symmetric)."""
    a = a.copy()
    n = len(a)
    off = np.zeros(max(n - 1, 0))
    for k in range(n - 1):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        if not np.any(x[1:]):
            off[k] = x[0]
            continue
        off[k] = -np.copysign(size, x[0])
        x[0] -= off[k]
        x /= np.linalg.norm(x)
        rest = a[k + 1:, k + 1:]
        p = rest @ x
        p -= (x @ p) * x
        rest -= 2 * (np.outer(x, p) + np.outer(p, x))
    return np.diag(a).copy(), off


def above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues exceed each shift: the positive pivots of the LDL^T factors of T - shift."""
    least = np.finfo(float).tiny * 2**20 + np.finfo(float).eps ** 2 * np.abs(off).max(initial=0.0)
    found = np.zeros(len(shifts), int)
    pivot = np.ones(len(shifts))
    for k, d in enumerate(diagonal):
        pivot = (d - shifts) - (off[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        found += pivot > 0
    return found


def rayleigh(a: np.ndarray, shift: float, fixed: list[np.ndarray], rng: np.random.Generator, steps: int = 12) -> tuple[float, np.ndarray]:
    """An eigenvalue near ``shift`` and its vector, orthogonal to ``fixed``: two steps with the shift, then Rayleigh quotients."""
    n = len(a)
    scale = np.abs(a).sum(1).max()

    def clean(x):
        for _ in range(2 if fixed else 0):
            for f in fixed:
                x = x - (f @ x) * f
        return x / np.linalg.norm(x)

    x, value, last = clean(rng.normal(size=n)), shift, np.inf
    best = (np.inf, value, x)
    for step in range(steps):
        try:
            x = clean(np.linalg.solve(a - value * np.eye(n), x))
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            value += 4 * np.finfo(float).eps * scale
            continue
        quotient = x @ a @ x
        wrong = np.linalg.norm(a @ x - quotient * x)
        if wrong < best[0]:
            best = (wrong, quotient, x)
        if step and (wrong <= 4 * np.finfo(float).eps * scale or wrong >= last / 2 and step > 4):
            break
        last = wrong
        if step:
            value = quotient
    return best[1], best[2]


def leading(a: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their unit vectors (columns)."""
    n = len(a)
    count = min(count, n)
    if not n or not np.any(a):
        return np.empty(0), np.empty((n, 0))
    diagonal, off = tridiagonal(a)
    reach = np.abs(diagonal) + np.append(np.abs(off), 0) + np.append(0, np.abs(off))  # Gershgorin
    scale = float(reach.max())
    slack = 16 * n * np.finfo(float).eps * scale
    low, high = np.full(count, -scale - slack), np.full(count, scale + slack)
    number = np.arange(1, count + 1)

    def halve(which):
        middle = (low[which] + high[which]) / 2
        up = above(diagonal, off, middle) >= number[which]
        low[which], high[which] = np.where(up, middle, low[which]), np.where(up, high[which], middle)

    # Isolate: one eigenvalue between low and high, or no room left between neighbours.
    while True:
        alone = (above(diagonal, off, low) == number) & (above(diagonal, off, high) == number - 1)
        open_ = ~(alone & (high - low <= scale / 4)) & (high - low > slack / 8)
        if not open_.any():
            break
        halve(np.flatnonzero(open_))
    rng = np.random.default_rng(12)
    values, vectors = [], []
    for k in range(count):
        close = [v for v, e in zip(vectors, values) if abs(e - (low[k] + high[k]) / 2) <= CLOSE * scale + (high[k] - low[k])]
        while True:
            value, x = rayleigh(a, (low[k] + high[k]) / 2, close, rng)
            # Certified: at least k eigenvalues above a step below, at most k - 1 above a step beyond.
            counts = above(diagonal, off, np.array([value - slack, value + slack]))
            if counts[0] >= k + 1 and counts[1] <= k:
                break
            if high[k] - low[k] <= slack / 8:
                raise ArithmeticError(f"eigenvalue {k + 1} could not be certified")
            halve(np.array([k]))
        if value <= FLAT * max(values[0] if values else value, value) or value <= slack:
            break
        values.append(value)
        vectors.append(x)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors).T.reshape(n, -1)[:, order] if values else np.empty((n, 0))


# -- the fit


@dataclass
class Fit:
    """What is known of the vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace).tolist() if self.trace else []

    def whitened(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Deviations and whitened rows of some vectors."""
        y = centred(x, self.n, self.sums)
        return squares(y), (y.astype(float) / self.n) @ self.vectors / np.sqrt(self.values)


def sums_of(vectors: DataFrame, column: str = "embedding") -> dict[int, tuple[int, list[int]]]:
    """n and the sums S of the vectors of each length."""
    def work(batches):
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for rows, x in by_length(batch, column):
                n, s = total.get(x.shape[1], (0, np.zeros(x.shape[1], object)))
                total[x.shape[1]] = n + len(rows), s + x.sum(0).astype(object)
        out = [(d, j, n, Decimal(int(v))) for d, (n, s) in total.items() for j, v in enumerate(s)]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], ["d", "j", "n", "s"])

    rows = (vectors.select(column).mapInArrow(work, "d int, j int, n bigint, s decimal(38,0)")
            .groupBy("d", "j").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).collect())  # one a dimension
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r["d"], r["j"])):
        out.setdefault(r["d"], (r["n"], []))[1].append(int(r["s"]))
    return out


def triangle(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums of (d, i, j, v), i <= j, as symmetric matrices."""
    found = rows.groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toPandas()  # a triangle a length of vectors
    out = {}
    for d, part in found.groupby("d"):
        size = int(part["j"].max()) + 1
        m = np.zeros((size, size))
        m[part["i"], part["j"]] = part["v"]
        m[part["j"], part["i"]] = part["v"]
        out[int(d)] = m
    return out


TRIANGLE = "d int, i int, j int, v double"


def triangle_rows(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    parts = [(np.full(len(i), d), i, j, m[i, j]) for d, m in total.items() for i, j in [np.triu_indices(len(m))]]
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [[], [], [], []]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.float64()))], ["d", "i", "j", "v"])


def covariances(vectors: DataFrame, sums: dict[int, tuple[int, list[int]]], column: str = "embedding") -> dict[int, np.ndarray]:
    """The covariance (divisor n, centred before multiplying) of the vectors of each length."""
    shared = vectors.sparkSession.sparkContext.broadcast(sums)  # one number a dimension

    def work(batches):
        total = {}
        for batch in batches:
            for _, x in by_length(batch, column):
                if x.shape[1]:
                    n, s = shared.value[x.shape[1]]
                    y = centred(x, n, s).astype(float) / n
                    total[x.shape[1]] = total.get(x.shape[1], 0.0) + y.T @ y
        yield triangle_rows(total)

    return {d: m / sums[d][0] for d, m in triangle(vectors.select(column).mapInArrow(work, TRIANGLE)).items()}


def fit(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> dict[int, Fit]:
    """The fits of all lengths of the usable vectors."""
    ship(vectors.sparkSession)
    sums = sums_of(vectors, column)
    out = {}
    for d, matrix in covariances(vectors, sums, column).items():
        out[d] = Fit(*sums[d], *leading(matrix, components), float(np.trace(matrix)))
    return out


NEW = ["d", "n", "deviation", "whitened"]


def whiten(vectors: DataFrame, fits: dict[int, Fit], column: str = "embedding") -> DataFrame:
    """The usable rows of ``vectors`` with d (length), n, deviation (exact) and whitened (one double a component)."""
    ship(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(fits)  # components x dimensions
    keep = usable(vectors, column).drop(*NEW)
    schema = StructType([*keep.schema.fields, StructField("d", IntegerType()), StructField("n", LongType()),
                         StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType()))])

    def work(batches):
        for batch in batches:
            for rows, x in by_length(batch, column):
                own = shared.value.get(x.shape[1])
                if own is None:  # empty vectors
                    n, deviations, w = 0, [0] * len(rows), np.empty((len(rows), 0))
                else:
                    n, (deviations, w) = own.n, own.whitened(x)
                before = pa.array(np.arange(len(rows) + 1) * w.shape[1], pa.int32())
                yield pa.record_batch([*(c.take(pa.array(rows)) for c in batch.columns), pa.array(np.full(len(rows), x.shape[1]), pa.int32()),
                                       pa.array(np.full(len(rows), n), pa.int64()), pa.array([Decimal(v) for v in deviations], pa.decimal128(38, 0)),
                                       pa.ListArray.from_arrays(before, pa.array(w.reshape(-1), pa.float64()))], [*batch.schema.names, *NEW])

    return keep.mapInArrow(work, schema)


def identity_errors(whitened: DataFrame) -> dict[int, float]:
    """For each length, the largest entry of the covariance of ``whitened`` (d, whitened) minus the identity."""
    def matrices(batch):
        values = batch.column("whitened")
        d = batch.column("d").to_numpy()
        for size in np.unique(d).tolist():
            rows = pa.array(np.flatnonzero(d == size))
            w = values.take(rows)
            yield size, w.flatten().to_numpy(zero_copy_only=False).reshape(len(w), -1)

    def means(batches):
        total = {}
        for batch in batches:
            for d, w in matrices(batch):
                n, s = total.get(d, (0, 0.0))
                total[d] = n + len(w), s + w.sum(0)
        rows = [(d, j, n, v) for d, (n, s) in total.items() for j, v in enumerate(s.tolist())]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.float64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], ["d", "j", "n", "s"])

    rows = whitened.mapInArrow(means, "d int, j int, n bigint, s double").groupBy("d", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    mean: dict[int, tuple[int, list[float]]] = {}
    for r in sorted(rows, key=lambda r: (r["d"], r["j"])):  # one a component
        mean.setdefault(r["d"], (r["n"], []))[1].append(r["s"] / r["n"])

    def products(batches):
        total = {}
        for batch in batches:
            for d, w in matrices(batch):
                if w.shape[1]:
                    y = w - np.array(mean[d][1])
                    total[d] = total.get(d, 0.0) + y.T @ y
        yield triangle_rows(total)

    found = triangle(whitened.mapInArrow(products, TRIANGLE))
    return {d: float(np.abs(m / mean[d][0] - np.eye(len(m))).max()) for d, m in found.items()}


def components_of(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = usable(vectors.select("vec_id", "embedding"))
    fits = fit(rows, components)
    done = stored(whiten(rows, fits).drop("embedding"), "whitened")
    errors = identity_errors(done.select("d", "whitened"))
    told = [(d, k + 1, v, errors[d]) for d, f in fits.items() for k, v in enumerate(f.explained)]  # one a component
    about = spark.createDataFrame(told, "d int, component int, explained double, identity_error double")
    each = done.select("vec_id", "d", "n", "deviation", F.posexplode("whitened").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    # A deviation that no long holds (beyond about 10^8 rows) is null here; ``whiten`` returns all of its digits.
    return each.join(F.broadcast(about), ["d", "component"]).select(
        "vec_id", "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", "explained", "identity_error")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "embeddings"))

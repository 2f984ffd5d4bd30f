"""Embedding whitening by a bidiagonal qd solver (operator 13).

Three passes over the vectors: exact integer sums, block QR of the centred rows (only one upper triangle per
task leaves it, and triangles are merged in a tree), and the projection.  The last triangle R has
R'R = n * covariance.  On the driver R, whose size is the dimension of the vectors whatever their number, is made
bidiagonal by Householder reflections; dqds finds its singular values to high relative accuracy and twisted
factorisations of the Golub-Kahan matrix give the directions.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atril.llm.common import materialise

SCALE = 1024
SHIFT = 100_000
#: Rows that are reduced together, and triangles that are merged together.
BLOCK_ROWS = 4096
FAN = 32
EPS = float(np.finfo(float).eps)
_EXACT = 1 << 62


# ---- the solver ----------------------------------------------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V): U' r V is upper bidiagonal with non-negative entries for some orthogonal U."""
    a, v = np.array(r, float), np.eye(r.shape[1])
    n = len(v)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.abs(x).max(initial=0.0)
        if len(x) < 2 or not np.any(x[1:]):
            return None
        w = x / size
        w[0] += np.copysign(np.linalg.norm(w), w[0])
        return w / np.linalg.norm(w)

    for k in range(n):
        w = reflector(a[k:, k])
        if w is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        w = reflector(a[k, k + 1 :]) if k + 1 < n else None
        if w is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    # Signs go into U and V: column k of V turns with the product of the signs met so far.
    sign, diagonal, above = 1.0, np.diag(a).copy(), np.diag(a, 1).copy()
    for k in range(1, n):
        left = -1.0 if diagonal[k - 1] * sign < 0 else 1.0  # sign of row k - 1 of U
        sign = -left if above[k - 1] < 0 else left
        v[:, k] *= sign
    return np.abs(diagonal), np.abs(above), v


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal matrix, falling: differential quotient-difference steps with shifts.

    A shift that turns a quotient negative is taken back and lessened, down to none, so no accuracy is lost.
    """
    if not len(diagonal):
        return np.zeros(0)
    scale = max(diagonal.max(), above.max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    work = [([float(x) ** 2 for x in diagonal / scale], [float(x) ** 2 for x in above / scale], 0.0)]
    while work:
        q, e, moved = work.pop()
        least = None  # the smallest quotient of the last step bounds the smallest value
        while True:
            n = len(q)
            if n == 1:
                found.append(q[0] + moved)
                break
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS * EPS * (moved + min(q[i], q[i + 1])) or e[i] < 1e-300), None)
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], moved))
                q, e, least = q[cut + 1 :], e[cut + 1 :], None
                continue
            if least is None and q[0] < q[-1]:  # once for each block: small values belong at the end
                q, e = q[::-1], e[::-1]
            shift = 0.0 if least is None else max(0.0, 0.98 * least - 0.5 * (e[-1] * q[-1]) ** 0.5)
            while True:
                step = _step(q, e, shift)
                if step is not None:
                    break
                shift = 0.0 if shift < 1e-3 * q[-1] else shift / 4
            q, e, least = step
            moved += shift
    return scale * np.sqrt(np.sort(np.maximum(found, 0))[::-1])


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds step; None if the shift is larger than the smallest value."""
    new_q, new_e, d = [], [], q[0] - shift
    least = d
    for i in range(len(e)):
        if d < 0:
            return None
        total = d + e[i]
        ratio = q[i + 1] / total if total > 0 else 0.0
        new_q.append(total)
        new_e.append(e[i] * ratio)
        d = (d * ratio if total > 0 else q[i + 1]) - shift
        least = min(least, d)
    if d < 0:
        return None
    new_q.append(d)
    return new_q, new_e, least


def twisted(diagonal: np.ndarray, above: np.ndarray, sigma: float) -> np.ndarray:
    """Right singular vector of an unreduced upper bidiagonal matrix for its singular value `sigma` > 0.

    The matrix with zero diagonal and the entries a1, b1, a2, b2 ... beside it has the eigenvalue `sigma` with
    v1, u1, v2, u2 ... as its vector.  It is factorised from both ends; where both meet with the least rest,
    the vector is largest, and substitution outwards from there gives it.
    """
    n = len(diagonal)
    off = np.empty(2 * n - 1)
    off[0::2], off[1::2] = diagonal, above
    tiny, m = EPS * EPS * sigma, 2 * n
    down, up = np.empty(m), np.empty(m)
    down[0] = up[m - 1] = -sigma
    for i in range(1, m):
        down[i] = -sigma - off[i - 1] ** 2 / (down[i - 1] if abs(down[i - 1]) > tiny else tiny)
    for i in range(m - 2, -1, -1):
        up[i] = -sigma - off[i] ** 2 / (up[i + 1] if abs(up[i + 1]) > tiny else tiny)
    k = int(np.abs(down + up + sigma).argmin())
    z = np.zeros(m)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -off[i] * z[i + 1] / (down[i] if abs(down[i]) > tiny else tiny)
    for i in range(k + 1, m):
        z[i] = -off[i - 1] * z[i - 1] / (up[i] if abs(up[i]) > tiny else tiny)
    v = z[0::2]
    return v / np.linalg.norm(v)


def directions(r: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(all singular values of r, falling; its first `wanted` right singular vectors as columns).

    Directions of values that are zero to working precision are zero columns.
    """
    diagonal, above, v = bidiagonal(r)
    largest = max(diagonal.max(initial=0.0), above.max(initial=0.0))
    above[above <= EPS * largest * 0.5] = 0.0
    ends = [*np.flatnonzero(above == 0.0) + 1, len(diagonal)]
    values = []  # (value, first row of its block, end)
    start = 0
    for end in ends:
        values += [(float(s), start, end) for s in dqds(diagonal[start:end], above[start : end - 1])]
        start = end
    values.sort(key=lambda x: -x[0])
    sigma = np.array([s for s, _, _ in values])
    out = np.zeros((len(diagonal), min(wanted, len(values))))
    for k in range(out.shape[1]):
        s, start, end = values[k]
        if s <= len(sigma) * EPS * sigma[0]:
            continue
        x = np.zeros(len(diagonal))
        x[start:end] = twisted(diagonal[start:end], above[start : end - 1], s)
        near = [j for j in range(k) if values[j][1] == start and values[j][0] - s <= 1e-3 * s]
        for _ in range(2):
            for j in near:
                x -= (out[:, j] @ x) * out[:, j]
        size = np.linalg.norm(x)
        if size < 0.1:  # the cluster's vectors can't be told apart: inverse iteration across from those found
            b = np.diag(diagonal[start:end]) + np.diag(above[start : end - 1], 1)
            shifted = b.T @ b - s * s * (1 - 4 * EPS) * np.eye(end - start)
            y = np.cos(np.arange(1, end - start + 1))
            for _ in range(5):
                for j in near:
                    y -= (out[start:end, j] @ y) * out[start:end, j]
                y = np.linalg.solve(shifted, y)
                y /= np.linalg.norm(y)
            for _ in range(2):
                for j in near:
                    y -= (out[start:end, j] @ y) * out[start:end, j]
            x[:] = 0
            x[start:end], size = y, np.linalg.norm(y)
        out[:, k] = x / size
    return sigma, v @ out


# ---- the passes over the rows --------------------------------------------------------------------------------


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id and `v`, the vector in double precision, of rows whose vector is whole and finite."""
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~bad)


def _integers(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, integer vectors of that length) of a batch."""
    lists = batch.column(batch.schema.get_field_index("v"))
    flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy()
    x = (np.clip(np.floor(SCALE * flat), -(2.0**62), 2.0**62).astype(np.int64)) + SHIFT
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield int(length), rows, x[starts[rows][:, None] + np.arange(length)]


def _wide(x: np.ndarray, times: int) -> np.ndarray:
    """`x` as Python integers where `times` of its entries could leave the range of a long."""
    return x.astype(object) if x.size and int(np.abs(x).max()) * times >= _EXACT else x


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: dict[int, int] = {}
    s: dict[int, np.ndarray] = {}
    for batch in batches:
        for length, rows, x in _integers(batch):
            n[length] = n.get(length, 0) + len(rows)
            s[length] = s.get(length, 0) + _wide(x, len(rows)).sum(axis=0).astype(object)
    for length, total in s.items():
        yield pa.RecordBatch.from_pydict({
            "length": pa.array([length] * length, pa.int32()), "at": pa.array(range(length), pa.int32()),
            "n": pa.array([n[length]] * length, pa.int64()), "s": pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0)),
        })


def _triangle(r: np.ndarray) -> bytes:
    d = r.shape[1]
    return np.vstack([r, np.zeros((d - len(r), d))]).tobytes() if len(r) < d else r.tobytes()


def triangle(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The upper triangle R of the QR factorisation of all centred rows (x - S/n)."""
    d, total = len(sums), np.array(sums, dtype=object)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, waiting, rows = np.zeros((0, d)), [], 0
        for batch in batches:
            for length, _, x in _integers(batch):
                if length == d:
                    for start in range(0, len(x), BLOCK_ROWS):
                        waiting.append(_centred(x[start : start + BLOCK_ROWS], n, total).astype(float) / n)
                        rows += len(waiting[-1])
                        if rows >= BLOCK_ROWS:
                            r, waiting, rows = np.linalg.qr(np.vstack([r, *waiting]), "r"), [], 0
        if waiting:
            r = np.linalg.qr(np.vstack([r, *waiting]), "r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([_triangle(r)], pa.binary())})

    def merge(parts: pa.Table) -> pa.Table:
        r = np.zeros((0, d))
        for raw in parts["r"]:
            r = np.linalg.qr(np.vstack([r, np.frombuffer(raw.as_buffer()).reshape(d, d)]), "r")
        return pa.table({"part": pa.array([parts["part"][0].as_py() // FAN], pa.int64()), "r": pa.array([_triangle(r)], pa.binary())})

    parts = materialise(vectors.select("v").mapInArrow(factor, "part long, r binary"), "triangles")
    while parts.count() > 1:
        parts = materialise(parts.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(merge, "part long, r binary"), "triangles")
    return np.frombuffer(bytes(parts.first().r)).reshape(d, d)


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - S, exact."""
    x = _wide(x, n)
    return n * x - (total if x.dtype == object or any(abs(t) >= _EXACT for t in total) else total.astype(np.int64))


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are left out.  All vectors must have one length; where
    they don't, those of the most frequent one (ties: the longest) are whitened and the others left out.  Entries
    beyond 2**62 / 1024 count as that.  Repeated rows count and are returned each; a null vec_id is kept; columns other
    than vec_id and embedding are ignored; an empty table, or vectors of length 0, give no rows.  Vectors shorter
    than `components` have as many components as entries.  Where the variance along a component is zero, `whitened` is
    null.  With equal eigenvalues any orthonormal directions of their space are used.  `identity_error` is measured on
    the rows of `whitened`, without the null components (null if all are null).
    """
    spark = vectors.sparkSession
    rows = _usable(vectors)
    lengths = rows.select("v").mapInArrow(_sums, "length int, at int, n long, s decimal(38,0)").groupBy("length", "at")
    # One row per entry of a vector, whatever the number of vectors.
    sums = lengths.agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).orderBy(F.desc("n"), F.desc("length"), "at").collect()
    sums = [s for s in sums if s.length == sums[0].length]
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not sums:
        return spark.createDataFrame([], schema)
    n, total = int(sums[0].n), [int(s.s) for s in sums]
    sigma, towards = directions(triangle(rows, n, total), components)
    kept = towards.shape[1]
    # whitened = ((n x - S) / n) . direction / sqrt(sigma^2 / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        weights = np.where(towards.any(axis=0), towards / (sigma[:kept] / np.sqrt(n)), np.nan)
    total = np.array(total, dtype=object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, at, x in _integers(batch):
                if length == len(total):
                    m = _centred(x, n, total)
                    z = (m.astype(float) / n) @ weights
                    exact = m if m.dtype == object or length * int(np.abs(m).max()) ** 2 < _EXACT else m.astype(object)
                    square = (exact * exact).sum(axis=1)
                    yield pa.RecordBatch.from_pydict({
                        "vec_id": batch.column(0).take(pa.array(at)),
                        "deviation": pa.array([Decimal(int(v)) for v in square], pa.decimal128(38, 0)),
                        "z": pa.array(list(np.where(np.isnan(z), None, z)), pa.list_(pa.float64())),
                    })

    made = materialise(
        rows.withColumn("vec_id", F.col("vec_id").cast("long")).mapInArrow(project, "vec_id long, deviation decimal(38,0), z array<double>"), "whitened"
    )
    whole = [k for k in range(kept) if towards[:, k].any()]
    pairs = [(a, b) for a in whole for b in whole if a <= b]
    error = None
    if pairs:
        found = made.agg(*(F.covar_pop(F.col("z")[a], F.col("z")[b]) for a, b in pairs)).first()
        error = max(abs(c - (a == b)) for c, (a, b) in zip(found, pairs, strict=True))
    all_of_it = float((sigma**2).sum())
    shares = [float(s * s) / all_of_it if all_of_it else 0.0 for s in sigma[:kept]]
    return made.select("vec_id", "deviation", F.posexplode("z").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*map(F.lit, shares)), F.col("k") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )

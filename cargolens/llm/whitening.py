"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation (operator 13).

The rows are the centred vectors ``y = x - S / n`` with whole x, worked out as ``(n * x - S) / n``, so the
offset in x costs no digits.  One step of the bidiagonalisation is one pass over the rows in which every task
multiplies its blocks twice: ``u = Y q`` and then ``Y' u``; only sums of the dimension's length leave it.

    alpha_k u_k = Y v_k - beta_(k-1) u_(k-1)          beta_k v_(k+1) = Y' u_k - alpha_k v_k

A left vector has as many entries as there are rows and is never stored: each is ``Y p`` for a short p that the
driver knows, and its products with the others are products of short vectors (``u_j' Y q = (Y' u_j)' q``).  So both sides
are fully reorthogonalised, twice a step, without another pass.  The singular values of the small
bidiagonal matrix give the eigenvalues ``e = sigma^2 / n``, its right vectors the components.

Steps go on until the wanted triplets' residuals are at rounding level, or until the whole space is spanned.  A step
that breaks down (the space so far is invariant) goes on from a new vector orthogonal to it.  One start vector meets each
multiple eigenvalue once only, so a second run, orthogonal to what was found, shows that nothing larger was
missed, or adds it.

Passes read the table itself; nothing is stored.  What a pass brings to the driver is the dimension's size.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped; a shorter vector (also an empty
one) counts as filled up with zeros to the longest one's length; null and repeated ids are rows like others; components without
variance (a standard deviation of at most ``NOISE`` of the largest one, so all for a single row or equal rows) are not returned;
entries c with ``|1024 * c| * n`` beyond 2 ** 62 raise an error; a deviation that fits no long is null; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import importable_on_workers

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Residual, relative to the largest singular value, at which a triplet has converged.
CONVERGED = 1e-14
#: Relative size of a singular value that counts as zero, and of a step that counts as broken down.
NOISE, BROKEN = 1e-8, 1e-13
#: Entries of vectors that are worked on together.
ENTRIES = 1 << 20


def _valid(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whether a row takes part, where its entries start, how many, all entries as doubles)."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = pc.fill_null(pc.cast(lists.flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    end = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    ok = ~lists.is_null().to_numpy(zero_copy_only=False) & (bad[end] == bad[end - size])
    return ok, end - size, size, entries


def _whole(entries: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * entries).astype(np.int64) + OFFSET


def _blocks(batch: pa.RecordBatch, dim: int, vec: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows that take part, their x) for some rows of the batch at a time."""
    step = max(1, ENTRIES // max(dim, 1))
    for a in range(0, len(batch), step):
        ok, start, size, entries = _valid(batch.column(vec).slice(a, step))
        row = np.flatnonzero(ok)
        if not len(row):
            continue
        if (size[row] == dim).all():
            x = _whole(entries[start[row][:, None] + np.arange(dim)])
        else:
            x = np.full((len(row), dim), OFFSET, np.int64)
            for i, r in enumerate(row):
                x[i, : size[r]] = _whole(entries[start[r]: start[r] + size[r]])
        yield row + a, x


@dataclass
class Centred:
    """The centred rows of a table: how to multiply with them."""

    rows: DataFrame
    n: int
    sums: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.sums)

    def reduce(self, work: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
        """The sum over all blocks Y of the vector ``work(Y)``."""
        n, sums, dim = self.n, self.sums, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(length)
            for batch in batches:
                for _, x in _blocks(batch, dim, 0):
                    total += work((n * x - sums) / n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), pa.array(total)], names=["at", "value"])

        found = self.rows.select("vector").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
        out = np.zeros(length)
        for r in found.collect():  # as many rows as the dimension has
            out[r["at"]] = r["value"]
        return out

    def both(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        """``Y' Y q`` and the squared length of ``Y q``, in one pass."""
        def work(y: np.ndarray) -> np.ndarray:
            u = y @ q
            return np.append(u @ y, u @ u)

        out = self.reduce(work, self.dim + 1)
        return out[:-1], float(out[-1])


def centre(rows: DataFrame) -> Centred:
    """Counts the rows of (vector) that take part and sums each dimension, exactly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, most = 0, np.zeros(0, np.int64), 0
        for batch in batches:
            ok, start, size, entries = _valid(batch.column(0))
            dim = int(size[ok].max(initial=0))
            if dim > len(total):  # what was counted so far is filled up with zeros
                total = np.append(total, np.full(dim - len(total), n * OFFSET))
            most = max(most, float(np.abs(entries[np.isfinite(entries)]).max(initial=0)))
            for _, x in _blocks(batch, len(total), 0):
                n += len(x)
                total += x.sum(0)
        if most * SCALE >= 2.0 ** 52:
            raise OverflowError("entries are too large for exact sums")
        if n:
            # Sums of x - OFFSET: zero for the entries that a shorter vector lacks.
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(total))), pa.array(np.concatenate([[int(most * SCALE) + OFFSET, n], total - n * OFFSET]))],
                                             names=["at", "value"])

    found = {r["at"]: r for r in rows.select("vector").mapInArrow(run, "at long, value long").groupBy("at").agg(
        F.sum("value").alias("total"), F.max("value").alias("most")).collect()}
    n = found[-1]["total"] if found else 0
    if n and n * found[-2]["most"] >= 1 << 62:
        raise OverflowError("entries are too large for exact products with the number of rows")
    return Centred(rows, n, np.array([found[k]["total"] + n * OFFSET for k in range(max(found, default=-2) + 1)], np.int64))


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    if basis:
        q = np.array(basis)
        for _ in range(2):
            v = v - q.T @ (q @ v)
    return v


def bidiagonalise(y: Centred, wanted: int, rng: np.random.Generator, locked: list[np.ndarray], at_most: float | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """The ``wanted`` largest singular values of Y orthogonal to ``locked``, their right vectors, and whether the whole space was spanned.

    With ``at_most``, the run also ends once the largest value is known to lie below it.
    """
    dim = y.dim - len(locked)
    right: list[np.ndarray] = []
    short: list[np.ndarray] = []   # p_k with u_k = Y p_k
    image: list[np.ndarray] = []   # Y' u_k
    alpha: list[float] = []
    beta: list[float] = []
    v = _orthogonal(rng.standard_normal(y.dim), locked)
    v /= np.linalg.norm(v)
    while True:
        right.append(v)
        q = v - beta[-1] * short[-1] if beta and beta[-1] else v
        for _ in range(2):
            if image:
                q = q - np.array(short).T @ (np.array(image) @ q)
        z, square = y.both(q)
        a = np.sqrt(max(square, 0.0))
        scale = max([a, *alpha])
        if a > BROKEN * scale:
            short.append(q / a)
            image.append(z / a)
            left = image[-1] - a * v
        else:  # Y v lies in the space of the left vectors so far
            a = 0.0
            short.append(np.zeros(y.dim))
            image.append(np.zeros(y.dim))
            left = np.zeros(y.dim)
        alpha.append(a)
        left = _orthogonal(left, [*locked, *right])
        b = float(np.linalg.norm(left))
        whole = len(right) >= dim
        broken = b <= BROKEN * max(scale, 1e-300)
        p, sigma, qt = np.linalg.svd(np.diag(alpha) + np.diag(beta, 1) if len(alpha) > 1 else np.array([alpha]))
        residual = np.zeros(len(sigma)) if broken else b * np.abs(p[-1])
        k = min(wanted, len(sigma))
        enough = len(sigma) >= wanted and not broken and bool((residual[:k] <= CONVERGED * max(sigma[0], 1e-300)).all())
        below = at_most is not None and not broken and len(sigma) > 2 and sigma[0] + residual[0] < at_most
        if whole or enough or below:
            return sigma[:k], qt[:k] @ np.array(right), whole
        if broken:
            b, left = 0.0, _orthogonal(rng.standard_normal(y.dim), [*locked, *right])
        beta.append(b)
        v = left / np.linalg.norm(left)


def principal(y: Centred, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of Y, largest first, and their right vectors as rows; those without variance are left out."""
    wanted = min(wanted, y.dim)
    if y.n == 0 or wanted == 0:
        return np.zeros(0), np.zeros((0, y.dim))
    rng = np.random.default_rng(13)
    sigma, right, whole = bidiagonalise(y, wanted, rng, [])
    while not whole and sigma[0] > 0:
        more, other, _ = bidiagonalise(y, 1, rng, list(right), float(sigma[-1]))
        if more[0] <= sigma[-1] * (1 + 1e-12):
            break
        sigma, right = np.append(sigma, more), np.vstack([right, other])
        order = np.argsort(-sigma, kind="stable")[:wanted]
        sigma, right = sigma[order], right[order]
    keep = sigma > NOISE * max(sigma[0], 1e-300)
    return sigma[keep], right[keep]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: one row for each row that takes part and component."""
    importable_on_workers(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
    y = centre(rows)
    sigma, right = principal(y, components)
    n, sums, dim, k = y.n, y.sums, y.dim, len(sigma)
    # Whitened is the projection over sqrt(e), e = sigma^2 / n.
    onto = (right / (sigma / np.sqrt(n))[:, None]).T if k else np.zeros((dim, 0))

    def moments(block: np.ndarray) -> np.ndarray:
        w = block @ onto
        return np.concatenate([w.sum(0), (w.T @ w).ravel(), [(block * block).sum()]])

    explained, error = [0.0], 0.0
    if k:
        m = y.reduce(moments, k + k * k + 1)
        mean = m[:k] / n
        covariance = m[k:-1].reshape(k, k) / n - np.outer(mean, mean)
        error = float(np.abs(covariance - np.eye(k)).max())
        explained = (sigma ** 2 / m[-1]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if k else ():
            for row, x in _blocks(batch, dim, 1):
                far = n * x - sums
                if (far.astype(float) ** 2).sum(1).max() < 2.0 ** 62:
                    deviation = pa.array((far * far).sum(1))
                else:
                    exact = [sum(c * c for c in r) for r in far.tolist()]
                    deviation = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
                each = np.repeat(np.arange(len(row)), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(row))),
                     deviation.take(pa.array(each)), pa.array(((far / n) @ onto).ravel())], names=["id", "component", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, component int, deviation long, whitened double")
    return out.select(F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.element_at(F.array(*map(F.lit, explained)), F.col("component")).alias("explained"), F.lit(error).alias("identity_error"))

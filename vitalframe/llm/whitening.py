"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance V is never formed. A pass of Spark over the centred rows X multiplies a block of directions, V Q =
Xᵀ(X Q) / n: each task sends one matrix of width times block numbers, whatever its rows, and these are added up by
entry. On the driver QR and a Rayleigh-Ritz step on that small block give the next directions, until the residuals
|V q - e q| certify all components. A block that hardly gains is made wider.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.llm.common import bounded, materialize

#: First width of the block, the widest one, most passes, and the residual (against the largest eigenvalue) that certifies a component.
BLOCK, WIDEST, PASSES, RESIDUAL = 16, 256, 400, 1e-13
#: Eigenvalues up to this share of the trace count as zero: such a direction cannot be whitened.
NOTHING = 1e-12


def _packed(vectors: pa.Array) -> list[bytes]:
    """floor(256 * c) of each vector's entries as long, in the fewest bytes an entry that hold all of them, named by the first byte."""
    out = []
    for v in vectors:
        x = np.floor(256 * np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
        kind = next((k for k in "bhi" if not len(x) or (np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)), "q")
        out.append(kind.encode() + x.astype(f"<{kind}", copy=False).tobytes() if kind != "q" else b"q" + x.tobytes())
    return out


def _matrix(packed: list[bytes]) -> np.ndarray:
    """The long vectors of one width as rows."""
    rows = [np.frombuffer(p, {"b": "<i1", "h": "<i2", "i": "<i4", "q": "<i8"}[chr(p[0])], offset=1) for p in packed]
    return np.array(rows, np.int64).reshape(len(rows), -1)


def _fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = _packed(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["ident", "x"])


def _added(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of fit of part(matrix of a batch), a flat array of `size` numbers; integers stay exact."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(_matrix(batch.column(0).to_pylist()))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([repr(v) for v in total.tolist()], pa.string())], names=["i", "v"])

    kind = "decimal(38,0)" if part.__name__ == "exact" else "double"
    rows = fit.select("x").mapInArrow(partial, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast(kind)).alias("v")).collect()
    out = np.zeros(size, object if kind != "double" else np.float64)
    for r in rows:
        out[r["i"]] = int(r["v"]) if kind != "double" else r["v"]
    return out


class Whitening:
    """Means (sums over n), components (columns), eigenvalues, trace and identity error of a fit list."""

    def __init__(self, n: int, sums: np.ndarray, trace: float = 0.0):
        self.n, self.sums, self.trace = n, sums, trace
        self.centre = np.array([int(s) / max(1, n) for s in sums], np.float64)
        self.values, self.vectors, self.identity_error, self.passes = np.empty(0), np.empty((len(sums), 0)), 0.0, 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) - self.centre

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the entries of (n * x - S) squared, exactly; None where it does not fit into 64 bits."""
        most = max([abs(int(s)) for s in self.sums], default=0) + self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        kind = np.int64 if most * most * max(1, x.shape[1]) < 2**62 else object
        return [int(v) if v < 1 << 63 else None for v in ((self.n * x.astype(kind) - np.array(list(self.sums), kind)) ** 2).sum(axis=1)]


def fitted(fit: DataFrame, width: int, k: int, block: int = BLOCK) -> Whitening:
    """The first k components of the distinct vectors of fit (x binary), by subspace iteration; RuntimeError if the residuals do not settle."""

    def exact(x: np.ndarray) -> np.ndarray:
        kind = np.int64 if max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * len(x) < 2**62 else object
        return np.append(np.full(1, len(x), object), x.astype(kind).sum(axis=0).astype(object))

    found = _added(fit, exact, width + 1)
    model = Whitening(int(found[0]), found[1:])
    if model.n < 2 or not width:
        return model

    rng = np.random.default_rng(13)
    q = np.linalg.qr(rng.standard_normal((width, min(width, max(block, k + 2)))))[0]
    last, slow = np.inf, 0
    for step in range(1, PASSES + 1):

        def product(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            c = model.centred(x)
            return np.append((c.T @ (c @ q)).ravel(), np.square(c).sum())

        found = _added(fit, product, q.size + 1)
        z, model.trace = found[:-1].reshape(q.shape) / model.n, float(found[-1]) / model.n
        small = q.T @ z
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, moved = q @ turn, z @ turn
        wanted = min(k, q.shape[1])
        residual = float(np.linalg.norm(moved[:, :wanted] - ritz[:, :wanted] * values[:wanted], axis=0).max()) / max(values[0], np.finfo(float).tiny)
        model.passes = step
        settled = residual <= RESIDUAL or (q.shape[1] == width and step > 1) or (residual <= 100 * RESIDUAL and residual > last / 2)
        if values[0] <= 0 or settled:
            break
        slow = slow + 1 if residual > last / 10 else 0
        last = residual
        # Equal directions of V Q would leave the QR rank-deficient: it is filled up with random ones, which also widens a slow block.
        more = q.shape[1] if slow >= 2 and q.shape[1] < min(width, WIDEST) else 0
        slow = 0 if more else slow
        grown = np.hstack([moved, np.linalg.norm(moved) * rng.standard_normal((width, min(more, min(width, WIDEST) - q.shape[1])))])
        q = np.linalg.qr(grown)[0]
        q = np.linalg.qr(q)[0]
    else:
        raise RuntimeError(f"components did not settle in {PASSES} passes")

    keep = [i for i in range(wanted) if values[i] > NOTHING * model.trace]
    model.values, model.vectors = values[keep], ritz[:, keep] / np.linalg.norm(ritz[:, keep], axis=0)
    if keep:

        def spread(x: np.ndarray) -> np.ndarray:
            z = model.centred(x) @ model.vectors / np.sqrt(model.values)
            return np.append((z.T @ z).ravel(), z.sum(axis=0))

        m = len(keep)
        found = _added(fit, spread, m * m + m)
        mean = found[m * m :] / model.n
        model.identity_error = float(np.abs(found[: m * m].reshape(m, m) / model.n - np.outer(mean, mean) - np.eye(m)).max())
    return model


def whiten(vectors: DataFrame, k: int = 4, ident: str = "vec_id", column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Per row of vectors (ident, column) and component 1 to k: ident, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty, or holds null or non-finite entries, give no rows, and neither do those of
    another width than most vectors have (ties: the smaller). A null ident is kept. Vectors x = floor(256 * c) are
    fitted each once, however often they are repeated, but every row is returned. Directions without variance
    cannot be whitened and are left out: fewer than k components; a table that is empty, or has one distinct
    vector only, gives no rows. Equal eigenvalues: any orthonormal basis of their space, the same for all rows.
    Other columns are ignored. Entries must keep 256 * c within 64 bits; a
    deviation beyond 64 bits is null.
    """
    v = F.col(column).cast("array<double>")
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    rows = vectors.filter(F.col(column).isNotNull() & (F.size(column) > 0) & finite).select(F.col(ident).cast("long").alias("ident"), v.alias("v"))
    first = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.col("count").desc(), "w").first()
    width = first["w"] if first else 0
    fixed = bounded(rows.filter(F.size("v") == width)).mapInArrow(_fixed, "ident long, x binary")
    model = fitted(materialize(fixed.select("x").distinct()), width, k, block)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(model.values)
        for batch in batches:
            if not batch.num_rows or not m:
                continue
            x = _matrix(batch.column(1).to_pylist())
            size = len(x) * m
            white = model.centred(x) @ model.vectors / np.sqrt(model.values)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), m))),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(size, model.n, np.int64)),
                    pa.array([d for d in model.deviations(x) for _ in range(m)], pa.int64()),
                    pa.array(white.ravel()),
                    pa.array(np.tile(model.values / model.trace, len(x))),
                    pa.array(np.full(size, model.identity_error)),
                ],
                names=["ident", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    out = fixed.mapInArrow(projected, "ident long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("ident", ident)

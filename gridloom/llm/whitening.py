"""Embedding whitening: leading components by a distributed block Jacobi-Davidson iteration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import stored

SCALE, OFFSET = 64, 1_000_000
COMPONENTS, GUARD = 16, 4  # wanted pairs, and further ones that iterate along
INNER_STEPS, OUTER_STEPS = 8, 60
ROWS_PER_TASK = 250_000
BLOCK_BYTES = 1 << 20
PARTS_AT_ONCE = 64  # partial products of more tasks are added up on executors first


def quantised(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``x`` (little-endian 64-bit integers), ``dims`` of the rows whose vector is whole and finite."""
    picked = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = picked.where("size(v) > 0 and not exists(v, c -> c is null or isnan(c) or abs(c) = double('infinity'))")

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            # beyond 2^52 entries stay at the bound: doubles have no finer steps there
            x = np.clip(np.floor(SCALE * values), -(2.0**52), 2.0**52).astype("<i8") + OFFSET
            packed = [x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            dims = pa.array(np.diff(ends).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary()), dims], names=["id", "x", "dims"])

    return whole.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, x binary, dims int")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a batch of packed rows, one a line."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dims)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums over the dimensions of (n x - S) squared, one for each line of ``x``."""
    bound = 2**62
    if not len(x):
        return []
    if n * int(np.abs(x).max()) >= bound or max(map(abs, sums)) >= bound:
        far = n * x.astype(object) - np.array(sums, dtype=object)
        return (far * far).sum(axis=1).tolist()
    far = np.abs(n * x - np.array(sums))
    most, dims = int(far.max()), x.shape[1]
    if dims * most**2 < bound:
        return (far * far).sum(axis=1).tolist()
    if dims * (most >> 20) ** 2 < bound and dims * (most + (1 << 20)) < bound >> 20:
        high, low = far >> 20, far & (2**20 - 1)  # squares in three parts that hold 64 bits each
        parts = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
        return [(h << 40) + (m << 21) + v for h, m, v in zip(*(p.tolist() for p in parts))]
    far = far.astype(object)
    return (far * far).sum(axis=1).tolist()


@dataclass
class FitList:
    """Distinct vectors in blocks: a stored table whose rows hold a megabyte of vectors each, less
    1 000 000, in the fewest bytes a number that hold them all (``width``)."""

    blocks: DataFrame
    n: int
    dims: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def fold(self, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum over all blocks of what ``part`` makes of a block's centred vectors.

        A task adds up its blocks and sends one small array; beyond 64 tasks these are added
        up on executors before the driver reads them.
        """
        dims, mean = self.dims, np.array([(s - OFFSET * self.n) / self.n for s in self.sums])

        def run(batches):
            total = None
            for batch in batches:
                for block, width in zip(batch.column("x"), batch.column("width").to_pylist()):
                    centred = np.frombuffer(block.as_buffer(), f"<i{width}").reshape(-1, dims) - mean
                    made = part(centred)
                    total = made if total is None else total + made
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["part"])

        def add(batches):
            total = sum((np.frombuffer(p, "<f8") for b in batches for p in b.column(0).to_pylist()), np.zeros(1))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        parts = self.blocks.select("x", "width").mapInArrow(run, "part binary")
        if self.n > PARTS_AT_ONCE * ROWS_PER_TASK:
            parts = parts.repartition(PARTS_AT_ONCE).mapInArrow(add, "part binary")
        shape = part(np.zeros((0, dims))).shape
        sums = [np.frombuffer(r["part"], "<f8") for r in parts.collect()]
        return np.sum([s.reshape(shape) for s in sums if s.size == np.prod(shape)], axis=0)

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a few vectors, without the covariance: each vector is centred first."""
        return self.fold(lambda c: c.T @ (c @ block)) / self.n

    def variances(self) -> np.ndarray:
        return self.fold(lambda c: (c * c).sum(axis=0)) / self.n


def fit_list(rows: DataFrame) -> FitList | None:
    """Distinct vectors of ``rows`` (``x``, ``dims`` of one length) in blocks, their number and exact sums."""
    first = rows.select("dims").first()
    if first is None:
        return None
    dims = first["dims"]

    step = max(1, BLOCK_BYTES // (8 * dims))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                x = _matrix(batch.column("x").slice(at, step), dims) - OFFSET
                width = next(w for w in (2, 4, 8) if w == 8 or np.abs(x).max() < 1 << (8 * w - 1))
                # halves of the numbers, so that sums stay exact
                high, low = (x >> 26).sum(axis=0).tolist(), (x & (2**26 - 1)).sum(axis=0).tolist()
                exact = [str((h << 26) + v + OFFSET * len(x)) for h, v in zip(high, low)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x.astype(f"<i{width}").tobytes()], pa.binary()), pa.array([width], pa.int32()),
                    pa.array([len(x)]), pa.array([exact], pa.list_(pa.string())),
                ], names=["x", "width", "rows", "sums"])

    distinct = rows.select("x").distinct()
    blocks = stored(distinct.mapInArrow(run, "x binary, width int, rows long, sums array<string>"), "vectors")
    n = blocks.agg(F.sum("rows")).first()[0]
    sums = (
        blocks.select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).orderBy("pos")
    )
    return FitList(blocks, n, dims, [int(r["s"]) for r in sums.collect()])


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, one a column, by minimal residuals; all columns share
    each call of ``product``.  A column that has reached ``tolerance`` of its right side stays as it is."""
    x = np.zeros_like(right)
    beta = np.linalg.norm(right, axis=0)
    start, size = beta.copy(), beta.copy()
    going = beta > 0
    v_old, v = np.zeros_like(right), right / np.where(going, beta, 1)
    d_old, d = np.zeros_like(right), np.zeros_like(right)
    beta = np.zeros_like(beta)
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        if not going.any():
            break
        w = product(v) - beta * v_old
        alpha = (v * w).sum(axis=0)
        w -= alpha * v
        w -= v * (v * w).sum(axis=0)
        beta_new = np.linalg.norm(w, axis=0)
        epsilon, rest = s_old * beta, c_old * beta
        delta, gamma = c * rest + s * alpha, c * alpha - s * rest
        rho = np.hypot(gamma, beta_new)
        going &= rho > 1e-300
        safe = np.where(rho > 0, rho, 1)
        c_old, s_old, c, s = c, s, gamma / safe, beta_new / safe
        d_old, d = d, (v - delta * d - epsilon * d_old) / safe
        x += np.where(going, c * size, 0) * d
        size = size * -s
        going &= (np.abs(size) > tolerance * start) & (beta_new > 1e-14 * start)
        v_old, v, beta = v, w / np.where(beta_new > 0, beta_new, 1), beta_new
    return x


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns of ``block`` made orthogonal to ``against`` and each other; dependent ones go."""
    kept: list[np.ndarray] = []
    for column in block.T:
        size = np.linalg.norm(column)
        if size == 0:
            continue
        column = column / size
        for _ in range(3):
            for basis in against:
                column = column - basis @ (basis.T @ column)
            for other in kept:
                column = column - other * (other @ column)
        size = np.linalg.norm(column)
        if size > 1e-10:
            kept.append(column / size)
    return np.array(kept).T.reshape(len(block), len(kept))


def leading_pairs(
    product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 11
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric, positive matrix known by its products only,
    their unit vectors (columns) and the residuals' lengths.

    Block Jacobi-Davidson: Rayleigh-Ritz in a growing subspace; for each pair that is not yet
    exact a correction orthogonal to all pairs, from (A - theta) t = -r projected, solved by a
    few minimal-residual steps; pairs whose residual has reached rounding are locked and the
    rest goes on orthogonal to them.  Each step is one product with a block of vectors.  The
    subspace is cut back to the best vectors at four blocks.
    """
    wanted = min(wanted, dims)
    size = min(dims, wanted + GUARD)
    limit = min(dims, 4 * size)
    draw = np.random.default_rng(seed)
    locked, locked_image = np.zeros((dims, 0)), np.zeros((dims, 0))
    basis = _orthonormal(draw.standard_normal((dims, size)))
    image = product(basis)
    scale, best, stale = 0.0, np.inf, 0
    for outer in range(OUTER_STEPS):
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1]
        values, vectors = values[order], vectors[:, order]
        scale = max(scale, values[0] if len(values) else 0.0)
        front = min(len(values), size)
        ritz, ritz_image, theta = basis @ vectors[:, :front], image @ vectors[:, :front], values[:front]
        errors = ritz_image - ritz * theta
        errors -= locked @ (locked.T @ errors)
        lengths = np.linalg.norm(errors, axis=0)
        rounding = 4 * np.finfo(float).eps * np.sqrt(dims) * scale
        missing = wanted - locked.shape[1]
        worst = lengths[:missing].max(initial=0.0)
        stale = stale + 1 if worst > best / 2 else 0
        best = min(best, worst)
        full = basis.shape[1] + locked.shape[1] >= dims
        # rounding of the products themselves is the floor: stop once no step improves on it
        done = lengths <= rounding
        if full or (stale >= 3 and worst < 1e-11 * scale):
            done[:missing] = True
        ready = int(np.argmin(done)) if not done.all() else len(done)
        if ready >= missing or front == 0:
            locked = np.hstack([locked, ritz[:, :missing]])
            break
        if ready:
            locked, locked_image = np.hstack([locked, ritz[:, :ready]]), np.hstack([locked_image, ritz_image[:, :ready]])
            basis, image = basis @ vectors[:, ready:], image @ vectors[:, ready:]
            ritz, ritz_image, theta, errors, lengths = (a[..., ready:] for a in (ritz, ritz_image, theta, errors, lengths))
            values, vectors = values[ready:], np.eye(basis.shape[1])
        else:
            basis, image, vectors = basis @ vectors, image @ vectors, np.eye(basis.shape[1])
        if basis.shape[1] + ritz.shape[1] > limit - locked.shape[1] and basis.shape[1] > size:
            basis, image = basis[:, : 2 * size], image[:, : 2 * size]
        todo = lengths > rounding
        frozen = np.hstack([locked, ritz])

        def projected(block, shift=theta[todo]):
            block = block - frozen @ (frozen.T @ block)
            block = product(block) - block * shift
            return block - frozen @ (frozen.T @ block)

        right = -(errors[:, todo] - frozen @ (frozen.T @ errors[:, todo]))
        steps = minres(projected, right, INNER_STEPS, 2.0 ** -(outer + 2))
        fresh = _orthonormal(steps, locked, basis)
        if fresh.shape[1] == 0:  # nothing new from the corrections: other directions
            fresh = _orthonormal(draw.standard_normal((dims, size)), locked, basis)[:, : dims - basis.shape[1] - locked.shape[1]]
        fresh_image = product(fresh) if fresh.shape[1] else fresh
        basis, image = np.hstack([basis, fresh]), np.hstack([image, fresh_image])
    else:
        raise ArithmeticError(f"residual {best:g} of {scale:g} after {OUTER_STEPS} steps")
    locked = _orthonormal(locked)
    image = product(locked)
    small = locked.T @ image
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1]
    values, locked, image = values[order], locked @ vectors[:, order], image @ vectors[:, order]
    return values, locked, np.linalg.norm(image - locked * values, axis=0)


def whiten(
    table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per usable row of ``table`` and component: id, ``component`` (from 1), ``n``, ``deviation``
    (decimal), ``whitened``, ``explained``, ``identity_error``, ``residual``.

    Entries c become floor(64 c) + 1 000 000, held at 2^52 either way.  The covariance is that of the distinct integer
    vectors, divisor ``n``; components are its leading unit eigenvectors, found by products
    only.  Rows whose vector is null, empty or holds a null, NaN or infinite entry give no rows;
    of vectors of several lengths those of the most frequent length count (of equals the
    longest), the others give no rows.  Rows that repeat, also under one id, and null ids give
    their own rows.  Directions without variance (all vectors alike, or fewer vectors than
    components) are no components.  ``identity_error`` is the largest entry of the whitened
    vectors' covariance minus the identity; ``residual`` the greatest length of V u - e u, over
    the greatest eigenvalue.  The driver holds blocks of some vectors of the embedding's length.
    """
    rows = quantised(table, id_col, vector_col)
    kind = rows.schema["id"].dataType.simpleString()
    out = f"id {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double, residual double"
    wide = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    fitted = None if wide is None else fit_list(rows.where(F.col("dims") == wide["dims"]))
    spectrum = np.zeros(0)
    if fitted is not None and fitted.n > 1:
        trace = fitted.variances().sum()
        if trace > 0:
            spectrum, vectors, residuals = leading_pairs(fitted.product, fitted.dims, components)
            usable = spectrum > 1e-12 * trace
            spectrum, vectors, residuals = spectrum[usable], vectors[:, usable], residuals[usable]
    if not len(spectrum):
        empty = table.sparkSession.createDataFrame([], out)
        return _named(empty, id_col)
    mean, dims, n, sums = fitted.mean, fitted.dims, fitted.n, fitted.sums
    axes = vectors / np.sqrt(spectrum)
    k = len(spectrum)
    drift = fitted.fold(lambda c: (c @ axes).sum(axis=0)) / n

    def products(centred):
        w = centred @ axes - drift
        return w.T @ w

    identity_error = float(np.abs(fitted.fold(products) / n - np.eye(k)).max())
    explained, residual = spectrum / trace, float(residuals.max() / spectrum[0])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("x"), dims)
                deviation = [str(d) for d in deviations(x, n, sums)]
                w = (x - mean) @ axes
                index = pa.array(np.repeat(np.arange(len(x)), k))
                each = len(x) * k
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(index), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(each, n)), pa.array(deviation).take(index), pa.array(w.ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(each, identity_error)), pa.array(np.full(each, residual)),
                ], names=[f.split()[0] for f in out.split(", ")])

    same = rows.where(F.col("dims") == dims).select("id", "x")
    return _named(same.mapInArrow(run, out), id_col)


def _named(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")).withColumnRenamed("id", id_col)

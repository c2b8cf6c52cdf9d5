"""Embedding whitening by shifted CholeskyQR: Gram passes over centred rows, then an SVD of R."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import dropped, stored
from spendlens.llm.vectors import usable

#: Gram passes at most; three do for a matrix of full rank.
PASSES = 6
#: Rows that are multiplied at once.
ROWS = 4096
_ROUNDING = np.finfo(np.float64).eps / 2


@dataclass
class Whitening:
    """What is known of the vectors of one size.

    ``factors`` are the triangular factors so far: the centred rows are Q times
    their product, the last one first.
    """

    n: int
    sums: list[int]
    factors: list[np.ndarray] = field(default_factory=list)
    gram: np.ndarray | None = None
    trace: float = 0.0
    directions: np.ndarray | None = None
    explained: list[float] = field(default_factory=list)
    identity_error: float = 0.0

    def __post_init__(self):
        self.mean = np.array([s / self.n for s in self.sums])

    def orthogonalised(self, x: np.ndarray) -> np.ndarray:
        """Centred rows, solved against each factor in turn."""
        q = x - self.mean
        for r in self.factors:
            for j in range(len(r)):
                q[:, j] = (q[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        return q

    def settled(self) -> bool:
        """Whether the rows' Gram matrix is the identity, but for directions in which there is nothing."""
        values = np.linalg.eigvalsh(self.gram)
        return bool(np.all((np.abs(values - 1) < 1e-10) | (values < self.nothing())))

    def nothing(self) -> float:
        """Eigenvalues of an orthogonalised Gram matrix below this are rounding."""
        return 1e-13 * len(self.sums)

    def factor(self) -> None:
        """Append the Cholesky factor of the Gram matrix.

        The first is shifted by a bound of the rounding in the matrix, so that
        it exists for any condition number; a later one only if it has to be.
        Directions without variance are lifted to one then: they stay empty.
        """
        d = len(self.gram)
        shift = 11 * (self.n * d + d * (d + 1)) * _ROUNDING * np.trace(self.gram)
        gram = self.gram
        if self.factors:
            values, vectors = np.linalg.eigh(gram)
            empty = vectors[:, values < self.nothing()]
            gram = gram + empty @ empty.T
            shift = shift if values[values >= self.nothing()].min(initial=np.inf) <= shift else 0.0
        else:
            self.trace = float(np.trace(gram))
        self.factors.append(np.linalg.cholesky(gram + shift * np.eye(d)).T)

    def finish(self, components: int) -> None:
        """Directions and shares of the leading components, from the SVD of the composed factor."""
        d = len(self.sums)
        self.directions, self.explained = np.zeros((d, 0)), []
        if not self.factors:
            return
        r = np.eye(d)
        for f in self.factors:
            r = f @ r
        # What the last Gram matrix still differs from the identity belongs to R.
        values, vectors = np.linalg.eigh(self.gram)
        values = np.where(values < self.nothing(), 0.0, values)
        _, scale, rows = np.linalg.svd((vectors * np.sqrt(values)).T @ r)
        kept = min(components, int(np.sum(scale > 1e-12 * scale[0])))
        variance = scale**2 / self.n
        self.directions = rows[:kept].T / np.sqrt(variance[:kept])
        self.explained = (variance[:kept] / (self.trace / self.n)).tolist()


def _matrices(batch: pa.RecordBatch):
    """The vectors of a batch, by size: (rows, matrix of long)."""
    lists = batch.column("x")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        for a in range(0, len(rows), ROWS):
            part = rows[a : a + ROWS]
            yield part, lists.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(len(part), size)


def _summed(fit: DataFrame, product) -> dict[int, np.ndarray]:
    """The sum over all rows of ``product(matrix)`` (rows by size -> square matrix) for each vector size.

    Each task adds up its own; Spark adds up the tasks' entries. Only the sums reach the driver.
    """

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch):
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + product(x)
        for size, total in sums.items():
            values = np.ascontiguousarray(total).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), size)), pa.array(np.arange(len(values))), pa.array(values)], names=["size", "at", "value"])

    parts = fit.select("x").mapInArrow(partial, "size long, at long, value double")
    out: dict[int, np.ndarray] = {}
    # At once: an iterator would run a job of its own for every shuffle partition.
    found = parts.groupBy("size", "at").agg(F.sum("value").alias("value")).toArrow()
    sizes, at, value = (found.column(c).to_numpy() for c in ("size", "at", "value"))
    for size in np.unique(sizes).tolist():
        here = sizes == size
        values = np.empty(int(here.sum()))
        values[at[here]] = value[here]
        width = int(round(len(values) ** 0.5))
        out[size] = values.reshape(width, width)
    return out


def _counted(fit: DataFrame) -> dict[int, Whitening]:
    """Number of vectors and exact sum of each dimension, by vector size."""

    def partial(batches):
        for batch in batches:
            for _, x in _matrices(batch):
                # Halves of 32 bits, so that no sum of a batch can overflow.
                columns = [np.full(x.shape[1], x.shape[1]), np.arange(x.shape[1]), np.full(x.shape[1], len(x)), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["size", "at", "n", "high", "low"])

    parts = fit.select("x").mapInArrow(partial, "size long, at long, n long, high long, low long")
    whole = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for row in parts.groupBy("size", "at").agg(F.sum("n").alias("n"), whole("high"), whole("low")).collect():
        found.setdefault(row["size"], {})[row["at"]] = (row["n"], (int(row["high"]) << 32) + int(row["low"]))
    return {size: Whitening(sums[0][0], [sums[at][1] for at in range(size)]) for size, sums in found.items()}


def fit_whitening(fit: DataFrame, components: int) -> dict[int, Whitening]:
    """A whitening of the distinct vectors ``x`` of ``fit``, for each vector size.

    Every pass reads all rows, centres them, solves them against the triangular
    factors found so far and adds up their Gram matrix, whose Cholesky factor is
    the next. The product of the factors is the R of a QR decomposition of the
    centred rows; its singular values and right vectors are those of the rows,
    and lose no digits to a squared condition number.
    """
    models = _counted(fit)
    todo = set(models)
    for _ in range(PASSES):
        if not todo:
            break
        active = {size: models[size] for size in todo}
        grams = _summed(
            fit.filter(F.size("x").isin(*todo)), lambda x, active=active: (lambda q: q.T @ q)(active[x.shape[1]].orthogonalised(x.astype(np.float64)))
        )
        for size, gram in grams.items():
            model = models[size]
            model.gram = gram
            if not gram.any() or model.factors and model.settled():
                todo.discard(size)
            else:
                model.factor()
    for model in models.values():
        if model.gram is not None and len(model.factors) and model.gram.any():
            model.finish(components)
    ready = {size: m for size, m in models.items() if m.directions is not None and m.directions.shape[1]}
    if ready:
        white = lambda x: (x - ready[x.shape[1]].mean) @ ready[x.shape[1]].directions
        squares = _summed(fit.filter(F.size("x").isin(*ready)), lambda x: (lambda w: w.T @ w)(white(x)))
        for size, total in squares.items():
            ready[size].identity_error = float(np.abs(total / ready[size].n - np.eye(len(total))).max())
    return ready


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 for each row, exact; None where a long can't hold it."""
    largest = model.n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums))
    if largest * largest * x.shape[1] < 2**63:
        gaps = model.n * x - np.array(model.sums, np.int64)
        return (gaps * gaps).sum(axis=1).tolist()
    exact = [sum((model.n * v - s) ** 2 for v, s in zip(row, model.sums)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(
    rows: DataFrame, components: int = 4, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), one row per vector and component.

    A vector's entries become ``x = floor(scale * entry)`` as long, to the ends
    of that type. The whitening is fitted to the distinct x vectors, ``n`` in
    all with dimension sums S: ``whitened`` is ``x - S/n`` along a unit
    eigenvector of their covariance over the root of its eigenvalue, components
    numbered by falling eigenvalue, whose share is ``explained``. ``deviation``
    is the sum over dimensions of ``(n x - S)^2``, NULL where a long can't hold
    it; ``identity_error`` the largest entry by which the whitened fit list's
    covariance differs from the identity.

    Vectors that are NULL or hold NULL or non-finite entries are left out, as
    are empty ones. Vectors of different sizes are whitened apart. Directions
    without variance are no components, so one distinct vector gives no row.
    Repeated rows and NULL ids are rows like others; each vector counts once in
    the fit, however many copies it has.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    entry = lambda c: F.floor(c.cast("double") * scale)
    good = rows.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.transform(vector_col, entry).alias("x"))
    fit = stored(good.select("x").distinct(), "vectors")
    models = fit_whitening(fit, components)
    dropped(fit)

    def whitened(batches):
        for batch in batches:
            for part, x in _matrices(batch):
                if not (model := models.get(x.shape[1])):
                    continue
                k = model.directions.shape[1]
                ids = batch.column("id").take(pa.array(np.repeat(part, k)))
                values = ((x - model.mean) @ model.directions).ravel()
                deviation = [v for v in _deviations(x, model) for _ in range(k)]
                columns = [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(len(ids), model.n)),
                    pa.array(deviation, pa.int64()), pa.array(values), pa.array(model.explained * len(part)),
                    pa.array(np.full(len(ids), model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return good.mapInArrow(whitened, schema)

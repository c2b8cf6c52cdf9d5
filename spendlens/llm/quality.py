"""Quality classifier: positive-unlabelled learning with a non-negative risk."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import dropped, stored

#: Bytes that are a class of their own; the others fall into letters, digits and so on.
_MARKS = b" \n.,;:!?'\"-|*#$%&@/()<>=_+~^[]{}\\"
_KINDS = len(_MARKS) + 6
_TRIGRAMS = 512
_STATS = 9
FEATURES = _KINDS * _KINDS + _TRIGRAMS + _STATS


def _kinds() -> np.ndarray:
    kinds = np.full(256, len(_MARKS), np.int64)
    for first, last, kind in ((65, 90, 1), (97, 122, 2), (48, 57, 3), (128, 191, 4), (192, 255, 5)):
        kinds[first : last + 1] = len(_MARKS) + kind
    kinds[list(_MARKS)] = np.arange(len(_MARKS))
    return kinds


_KIND = _kinds()


def features(text: str | None) -> np.ndarray:
    """What a score sees of a text: byte-class pairs, hashed byte trigrams, word and line figures."""
    out = np.zeros(FEATURES, np.float32)
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) > 1:
        kind = _KIND[raw]
        pairs = np.bincount(kind[:-1] * _KINDS + kind[1:], minlength=_KINDS * _KINDS)
        out[: _KINDS * _KINDS] = np.sqrt(pairs / (len(raw) - 1))
    if len(raw) > 2:
        wide = raw.astype(np.uint32)
        grams = (wide[:-2] * 0x9E3779B1 + wide[1:-1] * 0x85EBCA6B + wide[2:] * 0xC2B2AE35).astype(np.uint32) >> 23
        out[_KINDS * _KINDS : -_STATS] = np.sqrt(np.bincount(grams, minlength=_TRIGRAMS) / len(grams))
    words, lines = text.split(), text.split("\n")
    n = len(words)
    if n:
        repeats = sum(map(str.__eq__, words, words[1:]))
        out[-_STATS:] = (
            np.log1p(len(text)) / 10,
            np.log1p(n) / 10,
            min(len(text) / n / 10, 5),
            len(set(words)) / n,
            repeats / n,
            sum(map(str.isupper, words)) / n,
            sum(map(str.isalpha, words)) / n,
            len(set(lines)) / len(lines),
            np.log1p(len(lines)) / 10,
        )
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(grad: Callable[[np.ndarray], np.ndarray], size: int, steps: int, rate: float = 0.03) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(size, np.float32), np.zeros(size, np.float32), np.zeros(size, np.float32)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def prior_of_counts(positive: np.ndarray, above: np.ndarray, unlabelled: int, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from scores neither side was fitted on.

    ``above`` counts the ``unlabelled`` scores at or over each distinct score of
    ``positive``. Best-bin estimation: above any threshold the unlabelled share
    is at least the prior times the positive share, so the prior is at most
    their ratio; the threshold with the least upper confidence bound of that
    ratio decides.
    """
    share_p = 1 - np.searchsorted(np.sort(positive), np.unique(positive)) / len(positive)
    share_u = above / unlabelled
    noise = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(unlabelled) + 1 / np.sqrt(len(positive)))
    best = np.argmin((share_u + (1 + delta) * noise) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """``prior_of_counts`` of two arrays of scores."""
    above = len(unlabelled) - np.searchsorted(np.sort(unlabelled), np.unique(positive))
    return prior_of_counts(positive, above, len(unlabelled), delta)


def _fit_plain(x: np.ndarray, y: np.ndarray, l2: float, steps: int) -> np.ndarray:
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
    penalty = np.r_[np.full(x.shape[1] - 1, l2), 0].astype(np.float32)
    return _descend(lambda w: x.T @ (weight * (_sigmoid(x @ w) - y)) + penalty * w, x.shape[1], steps)


def _fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, l2: float, steps: int) -> np.ndarray:
    """Minimise prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).

    While the second term is below zero, the step raises it instead, as the
    non-negative estimator prescribes.
    """
    penalty = np.r_[np.full(pos.shape[1] - 1, l2), 0].astype(np.float32)

    def grad(w):
        zp, zu = pos @ w, unl @ w
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_negative = unl.T @ su / len(unl) - prior * (pos.T @ sp) / len(pos)
        if negative < 0:
            return -g_negative
        return prior * (pos.T @ (sp - 1)) / len(pos) + g_negative + penalty * w

    return _descend(grad, pos.shape[1], steps)


def _standardised(pos: np.ndarray, unl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of the unlabelled; both sides are standardised by them in place."""
    mean, spread = unl[:, :-1].mean(axis=0), unl[:, :-1].std(axis=0) + 1e-3
    for side in (pos, unl):
        side[:, :-1] -= mean
        side[:, :-1] /= spread
    return mean, spread


def _raw_weights(w: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Weights for standardised features as weights for raw ones; the last is the intercept."""
    return np.r_[w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum()].astype(np.float32)


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, l2: float = 1e-2, steps: int = 250) -> np.ndarray:
    """Weights (the last is the intercept, for raw features) of the least non-negative risk under ``prior``.

    Rows end in a one for the intercept; they are standardised in place. Without
    rows on either side every score is one half.
    """
    if not len(pos) or not len(unl):
        return np.zeros(FEATURES + 1, np.float32)
    mean, spread = _standardised(pos, unl)
    return _raw_weights(_fit_nnpu(pos, unl, prior, l2, steps), mean, spread)


def _grid(z: np.ndarray) -> np.ndarray:
    """Plain scores in steps coarser than their rounding, so that equal texts score alike in any batch."""
    return np.round(z.astype(np.float64) * 1024) / 1024


def _vectors(batches):
    for batch in batches:
        made = [features(t.as_py()).tobytes() for t in batch.column("text")]
        columns = [batch.column(n) for n in ("id", "known", "fold")] + [pa.array(made, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "known", "fold", "x"])


def _sides(batches) -> dict[tuple[bool, int], np.ndarray]:
    """Matrices of the sample by (known, fold), rows ending in a one."""
    rows: dict[tuple[bool, int], list[bytes]] = {(known, fold): [] for known in (True, False) for fold in (0, 1)}
    for batch in batches:
        for known, fold, x in zip(*(batch.column(c).to_pylist() for c in ("known", "fold", "x"))):
            rows[known, fold].append(x)
    out = {}
    for key, held in rows.items():
        out[key] = np.ones((len(held), FEATURES + 1), np.float32)
        for i in range(len(held)):
            out[key][i, :-1] = np.frombuffer(held[i], np.float32)
            held[i] = b""
    return out


def _plain_models(batches, l2: float = 1e-2, steps: int = 250):
    """For each fold a plain model fitted on the other one, and its scores of the fold's positives."""
    sides, found = _sides(batches), []
    for fold in (0, 1):
        pos, unl, judged = sides[True, 1 - fold].copy(), sides[False, 1 - fold].copy(), sides[True, fold]
        if len(pos) and len(unl) and len(judged):
            mean, spread = _standardised(pos, unl)
            both = np.concatenate([pos, unl])
            weights = _raw_weights(_fit_plain(both, np.arange(len(both)) < len(pos), l2, steps), mean, spread)
            scores = _grid(judged @ weights)
            found.append({"fold": fold, "weights": weights.tobytes(), "scores": scores.tobytes()})
    yield pa.RecordBatch.from_pylist(found, pa.schema([("fold", pa.int32()), ("weights", pa.binary()), ("scores", pa.binary())]))


def _fitted(prior: float):
    def fitted(batches):
        sides = _sides(batches)
        pos, unl = (np.concatenate([sides.pop((known, fold)) for fold in (0, 1)]) for known in (True, False))
        yield pa.RecordBatch.from_pydict({"weights": pa.array([fit(pos, unl, prior).tobytes()], pa.binary())})

    return fitted


def _fold(ident: Column) -> Column:
    """Half of the ids, for models that judge only what they were not fitted on."""
    return F.pmod(F.xxhash64(F.lit(11), ident), F.lit(2)).cast("int")


def corpus_prior(texts: DataFrame, sample: DataFrame) -> float:
    """Share of good documents among all rows of ``texts`` (id, text).

    Each row is scored by the plain model that was fitted on the other half of
    the ids, and counted between the scores of that half's positives, so a count
    a gap is all that comes back: at most as many as the sample has positives.
    The halves' estimates are averaged by their rows. One half where there are
    no positives, or no rows, to compare.
    """
    found = sample.repartition(1).sortWithinPartitions("known", "id").mapInArrow(_plain_models, "fold int, weights binary, scores binary").collect()
    models = {r["fold"]: np.frombuffer(bytes(r["weights"]), np.float32) for r in found}
    positives = {r["fold"]: np.frombuffer(bytes(r["scores"])) for r in found}
    cuts = {fold: np.unique(scores) for fold, scores in positives.items()}

    @F.pandas_udf("int")
    def passed(text, fold):
        out = np.empty(len(text), np.int32)
        for start in range(0, len(text), 256):
            x = np.stack([features(t) for t in text.iloc[start : start + 256]])
            for f, weights in models.items():
                here = np.flatnonzero(fold.iloc[start : start + 256] == f)
                z = _grid(x[here] @ weights[:-1] + weights[-1])
                out[start + here] = np.searchsorted(cuts[f], z, side="right")
        return type(fold)(out)

    fold = _fold(F.col("id"))
    judged = texts.filter(fold.isin(list(models))).select(fold.alias("fold"), passed("text", fold).alias("passed"))
    counts = {f: np.zeros(len(c) + 1, np.int64) for f, c in cuts.items()}
    for row in judged.groupBy("fold", "passed").count().collect() if models else []:
        counts[row["fold"]][row["passed"]] = row["count"]
    rows = {f: int(c.sum()) for f, c in counts.items() if c.sum()}
    # A row that passed i scores lies at or over the first i of them.
    estimates = {f: prior_of_counts(positives[f], np.cumsum(counts[f][::-1])[::-1][1:], n) for f, n in rows.items()}
    return sum(estimates[f] * n for f, n in rows.items()) / sum(rows.values()) if rows else 0.5


def train(
    docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positive: int = 5000, max_unlabelled: int = 10000
) -> tuple[np.ndarray, float]:
    """Weights and prior: a bounded sample is fitted, the prior is that of all ``docs``.

    At most ``max_positive`` of the trusted ``positives`` (ids) and
    ``max_unlabelled`` documents, those whose ids hash lowest, are turned into
    vectors on the executors and fitted in one task; both bounds are fixed,
    however large the corpus. The class prior between the two fits comes from a
    pass over every row of ``docs``. Repeated ids count once in the sample, NULL
    ids are no positives.
    """
    by_hash = [F.xxhash64(id_col), F.col(id_col)]
    known = positives.select(id_col).filter(F.col(id_col).isNotNull()).distinct().orderBy(*by_hash).limit(max_positive)
    # Other salt: the unlabelled sample is drawn apart from that of the positives.
    drawn = docs.select(id_col).distinct().orderBy(F.xxhash64(F.lit(7), F.col(id_col)), F.col(id_col)).limit(max_unlabelled)
    ids = known.withColumn("known", F.lit(True)).unionByName(drawn.withColumn("known", F.lit(False)))
    ids = ids.select(F.col(id_col).alias("id"), "known")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    # The id list has a fixed bound, so it may be sent to every executor.
    chosen = texts.join(F.broadcast(ids), "id").select("id", "known", _fold(F.col("id")).alias("fold"), "text")
    vectors = chosen.mapInArrow(_vectors, f"id {kind}, known boolean, fold int, x binary").dropDuplicates(["id", "known"])
    sample = stored(vectors, "sample")
    prior = corpus_prior(texts, sample)
    row = sample.repartition(1).sortWithinPartitions("known", "id").mapInArrow(_fitted(prior), "weights binary").first()
    dropped(sample)
    # Without documents there is no partition to fit in.
    return np.frombuffer(bytes(row["weights"]), np.float32) if row else np.zeros(FEATURES + 1, np.float32), prior


def score(text: Column, weights: np.ndarray) -> Column:
    """Probability of good quality, from the text alone."""

    @F.pandas_udf("double")
    def scored(texts):
        out = np.empty(len(texts))
        for start in range(0, len(texts), 256):
            x = np.stack([features(t) for t in texts.iloc[start : start + 256]])
            out[start : start + len(x)] = _sigmoid((x @ weights[:-1] + weights[-1]).astype(np.float64))
        return type(texts)(out)

    return scored(text)


def is_held_out(doc_id: Column) -> Column:
    """The fifth of all ids that no label is learnt from; false for NULL."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def trusted_positives(labels: DataFrame) -> DataFrame:
    """Ids outside the held-out fold that every label calls good."""
    return (
        labels.filter(~is_held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("worst"))
        .filter("worst = 1")
        .select("doc_id")
    )


def with_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(row, held_out, score, predicted) for every row of ``docs``, ``row`` being all its columns.

    NULL and empty texts get a score like any other text. Only ids outside the
    held-out fold enter the training sample.
    """
    seen = docs.filter(~is_held_out(F.col(id_col)))
    positives = trusted_positives(labels).select(F.col("doc_id").alias(id_col))
    weights, _ = train(seen, positives, id_col, text_col)
    scored = docs.select(
        F.struct("*").alias("row"), is_held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col), weights).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

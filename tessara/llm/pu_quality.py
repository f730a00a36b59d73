"""Quality classifier learnt from trusted positives and unlabelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_FEATURES = 15
BINS = 16

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}[]\\^~_=+@/")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:?")] = True


def features(text: str | None) -> list[float]:
    """What the classifier sees of a whole text; a text without words gives zeros."""
    raw = text.encode("utf-8", "replace") if text else b""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(bytes_[_UPPER].sum()), int(bytes_[_LOWER].sum())
    size = sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = n - 2
    return [
        log(n),
        size / n,
        upper / (upper + lower) if upper + lower else 0.5,
        float(bytes_[_SYMBOL].sum()) / n,
        float(bytes_[33]) / n,
        float(bytes_[_DIGIT].sum()) / size,
        float(bytes_[_STOP].sum()) / n,
        float(bytes_[128:].sum()) / size,
        log(len(set(words))) / log(n) if n > 1 else 1.0,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:], words[2:]))) / triples if triples > 0 else 1.0,
        len(set(lines)) / len(lines),
        n / len(lines),
        float(sum(map(str.istitle, map(bytes.decode, words)))) / n if raw.isascii() else float(sum(65 <= w[0] <= 90 for w in words)) / n,
        float(max(map(len, words))),
    ]


def feature_rows(docs: DataFrame, columns: list[str], text_col: str = "text", rows: int = 512) -> DataFrame:
    """`columns` of docs with array<double> x."""
    few = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                batch = whole.slice(lo, rows)
                x = [features(t.as_py()) for t in batch.column(len(columns))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(x, pa.list_(pa.float64()))], [*columns, "x"])

    return few.mapInArrow(run, few.drop("_text").withColumn("x", F.lit(None).cast("array<double>")).schema)


@dataclass
class Classifier:
    """A weight for each bin of each feature, and a constant."""

    edges: np.ndarray
    weights: np.ndarray
    prior: float = 0.5

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = [np.searchsorted(self.edges[j], x[:, j], side="right") + j * BINS for j in range(x.shape[1])]
        return np.stack(out, 1) if len(x) else np.zeros((0, x.shape[1]), int)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[bins].sum(1) + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.bins(x)), -30, 30)))


def _descend(bins: np.ndarray, gradient, steps: int, rate: float, ridge: float) -> np.ndarray:
    """Adam over all rows at once. gradient: of logits, by row, at given logits."""
    w = np.zeros(N_FEATURES * BINS + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    flat = bins.reshape(-1)
    for t in range(1, steps + 1):
        g_rows = gradient(w[bins].sum(1) + w[-1])
        g = np.bincount(flat, np.repeat(g_rows, bins.shape[1]), len(w))
        g[-1] = g_rows.sum()
        g += ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.1) -> float:
    """Share of positives among unlabelled rows, from scores that tell trusted from unlabelled ones.

    Above any threshold lie at least prior * (share of positives above it) of the unlabelled rows; the smallest such
    ratio, over thresholds with enough rows above to be sure of, is the estimate. Each ratio gets one standard
    deviation added, so that a few rows don't set it."""
    best = 1.0
    for t in np.quantile(positive, np.linspace(0, 1 - least, 60)):
        p, u = (positive >= t).mean(), (unlabelled >= t).mean()
        slack = (u * (1 - u) / len(unlabelled) + p * (1 - p) / len(positive)) ** 0.5
        best = min(best, (u + slack) / p)
    return float(np.clip(best, 0.05, 0.99))


def fit_rows(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, rate: float = 0.05, threshold: float = 0.7) -> Classifier:
    """The classifier of least non-negative risk.

    Risk: prior * loss of positives as positive, plus what unlabelled rows lose as negative less prior * what positives
    lose as negative. The latter two together estimate the negatives' loss, which can't be below zero; where the
    estimate is, its gradient is turned round, so that the fit doesn't eat further into noise. Loss: logistic. The class
    prior and the cut that `threshold` stands for come from scores of rows by weights that haven't seen them."""
    both = np.concatenate([positive, unlabelled])
    edges = np.quantile(both, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
    model = Classifier(edges, np.zeros(N_FEATURES * BINS + 1))
    bins, n = model.bins(both), len(positive)
    is_p = np.arange(len(both)) < n
    half = (bins @ (np.arange(bins.shape[1]) * 7919 + 13)) % 2 == 0  # rows that look alike are in the same half

    def train(rows: np.ndarray, prior: float | None) -> np.ndarray:
        """Weights of some of the rows; without a prior, those that tell trusted from unlabelled rows."""
        p, b = is_p[rows], bins[rows]
        n, k = max(1, p.sum()), max(1, (~p).sum())
        ridge = max(1e-4, 0.5 / n)
        if prior is None:
            rate_p, rate_u = p * 0.5 / n, ~p * 0.5 / k
            return _descend(b, lambda z: rate_u * _sigmoid(z) - rate_p * _sigmoid(-z), steps // 2, rate, ridge)

        def gradient(z: np.ndarray) -> np.ndarray:
            loss = np.logaddexp(0, z)  # as negative
            negative = loss[~p].sum() / k - prior * loss[p].sum() / n
            sign = 1.0 if negative >= 0 else -1.0
            s = _sigmoid(z)
            return np.where(p, (-prior * (1 - s) - sign * prior * s) / n, sign * s / k)

        return _descend(b, gradient, steps, rate, ridge)

    def unseen(prior: float | None) -> np.ndarray:
        """Logits of each half by weights of the other."""
        z = np.zeros(len(both))
        for part in (half, ~half):
            w = train(~part, prior)
            z[part] = w[bins[part]].sum(1) + w[-1]
        return z

    z = unseen(None)
    prior = model.prior = class_prior(z[:n], z[n:])
    z = unseen(prior)
    model.weights = train(np.ones(len(both), bool), prior)
    model.weights[-1] += log(threshold / (1 - threshold)) - best_cut(z[:n], z[n:], prior)
    return model


def best_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The logit at which fewest rows would be on the wrong side: prior * (positives below) + (unlabelled above, less
    prior * positives above). In the middle of what is as good as the best, to within one standard deviation."""
    cuts = np.unique(np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0.001, 0.999, 400)))
    p, u = (1 - np.searchsorted(np.sort(x), cuts) / len(x) for x in (positive, unlabelled))
    wrong = prior * (1 - p) + np.maximum(0, u - prior * p)
    good = cuts[wrong <= wrong.min() + (0.25 / len(unlabelled)) ** 0.5 * wrong.min() ** 0.5 + 1e-9]
    return float((good.min() + good.max()) / 2)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether crc32 of the id as text leaves `fold`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """About `most` of the rows, by hash of id and text; all, if no more."""
    share = min(1.0, most / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positive: int = 8_000, max_unlabelled: int = 12_000) -> Classifier | None:
    """Trusted positives: documents labelled quality 1 that aren't held out, about max_positive of them. Unlabelled: about
    max_unlabelled of all that aren't held out, whose labels are not looked at. None if either is missing."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).where(~held_out("key"))
    trusted = labels.where("quality = 1").select(F.col(id_col).alias("key")).distinct()
    sides = [_bounded(rows.join(trusted, "key", "left_semi"), max_positive), _bounded(rows, max_unlabelled)]
    x = [np.array(feature_rows(s, ["key"]).select("x").toPandas().x.tolist(), float).reshape(-1, N_FEATURES) for s in sides]
    return fit_rows(*x) if all(map(len, x)) else None


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, model: Classifier | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs. Only the text enters the score.

    Null and empty texts score as a text whose features are zero. Repeated rows score alike. Without trusted positives
    every score is 0. An empty table gives an empty result."""
    model = model or fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out())
    found = feature_rows(rows, ["doc_id", "held_out"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
            score = m.score(x) if m else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score)], ["doc_id", "held_out", "score"])

    scored = found.mapInArrow(run, found.drop("x").withColumn("score", F.lit(0.0)).schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

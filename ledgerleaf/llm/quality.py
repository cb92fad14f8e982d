"""Quality classifier: regularised quadratic discriminant on transformed document statistics.

Each text gives a short vector of statistics on unbounded scales (logs and logits). The two classes' means and covariances come
from sums that Spark adds up; each covariance is shrunk towards the pooled one and towards a multiple of the identity, and its
Cholesky factor is kept, so that a text's class log density is one triangular solve. The score is the posterior of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import attached, saved

#: Share of the pooled covariance and of the scaled identity in each class covariance; least eigenvalue scale.
POOLED, IDENTITY, LEAST = 0.2, 0.02, 1e-4
NAMES = (
    "chars", "words", "word_length", "upper", "digits", "marks", "letters", "distinct", "repeats", "line_words", "line_copies",
    "top_word", "long_words", "short_words", "spread",
)
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK = np.zeros(256, bool)
_MARK[[i for i in range(33, 127) if not _ALNUM[i] and chr(i) not in ",.'-"]] = True


def _logit(part: float, whole: float) -> float:
    """Log odds of a share, with half a case added to each side."""
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str | None) -> list[float]:
    """The statistics named in NAMES; a null text counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total = int(counts.sum())
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    upper, digits, marks = int(counts[65:91].sum()), int(counts[48:58].sum()), int(counts[_MARK].sum())
    letters = int(counts[_ALNUM].sum()) - digits
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    share = counts[counts > 0] / max(1, total)
    return [
        np.log1p(total), np.log1p(n), np.log1p(float(lengths.mean()) if n else 0.0), _logit(upper, max(upper, letters)), _logit(digits, total),
        _logit(marks, total), _logit(letters, total), _logit(len(seen), n), _logit(repeats, max(0, n - 1)),
        np.log1p(n / max(1, len(lines))), _logit(len(lines) - len(set(lines)), len(lines)), _logit(max(seen.values(), default=0), n),
        _logit(int((lengths > 20).sum()), n), _logit(int((lengths == 1).sum()), n),
        float(-(share * np.log(share)).sum()),
    ]


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and stats, array<double>, of its text."""

    def each(texts: list) -> Iterator[tuple[int, int, list]]:
        yield 0, len(texts), [[statistics(t) for t in texts]]

    return attached(docs, keep, ("text",), "stats array<double>", each)


class Discriminant:
    """Means, Cholesky factors of the inverse transform and log priors of the classes 0 and 1."""

    def __init__(self, count: np.ndarray, total: np.ndarray, square: np.ndarray):
        """``count`` [2], ``total`` [2, p] and ``square`` [2, p, p]: sums over each class of 1, x and x x'."""
        p = total.shape[1]
        both = np.maximum(count, 1)[:, None]
        self.mean = total / both
        scatter = square - self.mean[:, :, None] * total[:, None, :]
        pooled = scatter.sum(0) / max(1, count.sum())
        self.prior = np.log((count + 1) / (count.sum() + 2))
        self.factor, self.half = [], []
        for k in (0, 1):
            own = scatter[k] / both[k]
            own = (1 - POOLED) * own + POOLED * pooled
            scale = max(np.trace(own) / p, LEAST)
            chol = np.linalg.cholesky((1 - IDENTITY) * own + (IDENTITY * scale + LEAST) * np.eye(p))
            self.factor.append(np.linalg.inv(chol))
            self.half.append(np.log(np.diag(chol)).sum())

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log posterior odds of label 1 for the rows of ``x``."""
        side = [self.prior[k] - self.half[k] - 0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) for k in (0, 1)]
        return side[1] - side[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -500, 500)))


def fit(rows: DataFrame) -> Discriminant:
    """``rows`` (stats, label 0 or 1) → the discriminant. Every row counts; each class's sums are 1 + p + p * p numbers."""
    p = len(NAMES)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + p + p * p))
        for b in batches:
            for k in (0, 1):
                x = np.array(b.loc[b["label"] == k, "stats"].tolist(), float).reshape(-1, p)
                total[k] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pd.DataFrame({"label": np.repeat([0, 1], total.shape[1]), "at": np.tile(np.arange(total.shape[1]), 2), "value": total.ravel()})

    added = rows.select("label", "stats").mapInPandas(sums, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))
    out = np.zeros((2, 1 + p + p * p))
    for label, at, value in added.collect():
        out[label, at] = value
    return Discriminant(out[:, 0], out[:, 1 : 1 + p], out[:, 1 + p :].reshape(2, p, p))


def learned(docs: DataFrame, labels: DataFrame, learn: Column) -> Discriminant:
    """The discriminant of ``docs`` (doc_id, text, ...) and ``labels`` (doc_id, quality), from the rows where ``learn`` holds."""
    return _learned(with_statistics(docs, "doc_id"), labels, learn)


def _learned(stats: DataFrame, labels: DataFrame, learn: Column) -> Discriminant:
    marks = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label")).distinct()
    return fit(stats.where(learn).join(marks, F.col("doc_id") == F.col("_id")).select("label", "stats"))


def scorer(model: Discriminant):  # noqa: ANN201
    """A function of a text column: the score."""

    @F.pandas_udf("double")
    def each(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], float).reshape(-1, len(NAMES))
        return pd.Series(model.score(x))

    return each


def score(rows: DataFrame, model: Discriminant, limit: float = 0.3) -> DataFrame:
    """``rows`` (stats, ...) with score and predicted in the place of stats."""
    keep = [c for c in rows.columns if c != "stats"]

    def each(stats: list) -> Iterator[tuple[int, int, list]]:
        s = model.score(np.array(stats, float).reshape(-1, len(NAMES)))
        yield 0, len(stats), [s, (s >= limit).astype("int32")]

    return attached(rows, tuple(keep), ("stats",), "score double, predicted int", each)


def classify(docs: DataFrame, labels: DataFrame, learn: Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` (doc_id, text, ...) → ``keep``, score, predicted; learned from ``labels`` (doc_id, quality) of the rows where ``learn`` holds.

    Every row is scored, null and empty texts and repeated rows too, over its whole text, however long. An id that is labelled more
    than once counts once for each label; null labels and null ids teach nothing. Without any label all scores are 0.5; an empty
    table gives no rows. Other columns don't matter, whatever their names.
    """
    stats = saved(with_statistics(docs, *keep))
    return score(stats, _learned(stats, labels, learn))

"""Language identification by nearest centroids.

A text becomes the counts of its hashed character n-grams, dampened, weighted by inverse document frequency and scaled to length
one. Each language has several centroids, found by spherical k-means; the language of the centroid with the highest cosine wins.
A text is rejected if its best cosine is far below those that the learning rows of that language have: nothing learned is near it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import attached, release

#: Hash buckets for n-grams; n-gram lengths; centroids of a language; rounds of k-means.
BUCKETS, GRAMS, CENTROIDS, ROUNDS = 4096, (1, 2, 3), 4, 12
#: Most labelled texts of a language, about, that the clustering takes (those with the smallest hashes, equal ones once).
SAMPLE = 2000
#: A text is rejected below this cosine, and below the part SLACK of the cosine that all but the part RARE of its language's learning rows reach;
#: cosines are counted in BINS, and raised for short texts: n letters have n / (n + SHORT) of a long text's cosine.
REJECT = 0.05
RARE, SLACK, BINS, SHORT = 0.001, 0.85, 1000, 50
_FACTORS = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]


def counts(text: str) -> np.ndarray:
    """Counts of the n-grams of the text's letters, lower-cased; each run of other characters counts as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letters(points)
    if not letters.any():
        return np.zeros(BUCKETS)
    points = np.where(letters, points, np.uint32(32))
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    points = np.concatenate([[np.uint32(32)], points[keep], [np.uint32(32)]])
    out = np.zeros(BUCKETS)
    for n in GRAMS:
        size = len(points) - n + 1
        if size > 0:
            h = np.full(size, n * 40503, np.uint32)
            for j in range(n):
                h = (h ^ points[j : j + size]) * _FACTORS[j]
                h ^= h >> np.uint32(15)
            out += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return out


def _letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters: ASCII and Latin-1 by range, others by Python's own table, looked up once for each."""
    low = ((points >= 97) & (points <= 122)) | ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0x24F) & (points != 0xD7) & (points != 0xF7)) | (points == 0xAA) | (points == 0xB5) | (points == 0xBA)
    rest = points > 0x24F
    if rest.any():
        kinds, at = np.unique(points[rest], return_inverse=True)
        low[rest] = np.array([chr(x).isalpha() for x in kinds])[at]
    return low


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one (zero where a text has no letter)."""
    x = np.empty((len(texts), BUCKETS), np.float32)
    for row, text in zip(x, texts, strict=True):
        row[:] = counts(text)
    np.sqrt(x, out=x)
    x *= idf.astype(np.float32)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.where(norm > 0, norm, 1)
    return x


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; deterministic. At most ``k`` rows of length one."""
    seeds = [int(np.argmax(x @ x.mean(0)))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(1))))
    c = x[seeds]
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[at == i].sum(0) if (at == i).any() else c[i] for i in range(len(c))])
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        c = c / np.where(norm > 0, norm, 1)
    return c


def raised(texts: list[str], cosines: np.ndarray) -> np.ndarray:
    """Cosines that texts as like their centroids would have if they were long."""
    n = np.array([_letters(np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)).sum() for t in texts], float)
    return cosines * (n + SHORT) / np.maximum(n, 1)


class Centroids:
    def __init__(self, idf: np.ndarray, names: list[str], rows: np.ndarray):
        self.idf, self.names, self.rows = idf.astype("float32"), names, rows.astype("float32")
        self.limits: dict[str, float] = {}

    def accepted(self, texts: list[str], names: list[str], cosines: np.ndarray, reject: float) -> np.ndarray:
        return np.array([c >= reject and r >= self.limits.get(n, 0.0) for n, c, r in zip(names, cosines, raised(texts, cosines), strict=True)], bool)

    def nearest(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and cosine of the nearest centroid for each text."""
        names, best = [], np.zeros(len(texts))
        for i in range(0, len(texts), 128):
            cosines = vectors(texts[i : i + 128], self.idf) @ self.rows.T
            at = np.argmax(cosines, axis=1)
            names += [self.names[j] for j in at]
            best[i : i + 128] = np.clip(cosines[np.arange(len(at)), at], 0, 1)
        return names, best


def fit(rows: DataFrame) -> Centroids | None:
    """``rows`` (doc_id, text, lang) → centroids; None if none has a language and a letter.

    Document frequencies count all rows. Each language's centroids come from about SAMPLE rows: those whose hashed id and text lie
    below a share that its row count sets, rows equal in both once, so one language's sample is the same wherever it is drawn, and
    of bounded size.
    """
    rows = rows.where("lang is not null and text is not null").select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = {}, np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                total[1:] += counts(text.as_py()) > 0
                total[0] += 1
                seen[lang] = seen.get(lang, 0) + 1
        at = np.flatnonzero(total)
        columns = [None] * len(at) + list(seen), [*at, *([-1] * len(seen))], [*total[at], *seen.values()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()), strict=True)], ["lang", "at", "n"])
        release()

    added = rows.mapInArrow(frequencies, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()
    known = {lang: n for lang, at, n in added if at < 0}
    if not known:
        return None
    df = np.zeros(BUCKETS + 1)
    for _, at, n in added:
        if at >= 0:
            df[at] = n
    idf = np.log((1 + df[0]) / (1 + df[1:])) + 1
    share = F.lit(0.0)
    for lang, n in known.items():
        share = F.when(F.col("lang") == lang, min(1.0, SAMPLE / n)).otherwise(share)
    hashed = rows.withColumn("at", F.xxhash64("doc_id", "text"))
    drawn = hashed.where(F.pmod(F.xxhash64(F.lit("sample"), "at"), F.lit(1 << 20)) < share * (1 << 20)).select("at", "text", "lang")

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(at, lang, x): the vectors of texts with a letter, so that a language's group holds no texts."""
        for b in batches:
            for at in range(0, len(b), 128):
                part = b.slice(at, 128)
                texts = part.column("text").to_pylist()
                good = [i for i, t in enumerate(texts) if has_letter(t)]
                x = vectors([texts[i] for i in good], idf)
                yield pa.RecordBatch.from_arrays([part.column("at").take(pa.array(good, pa.int64())), part.column("lang").take(pa.array(good, pa.int64())), pa.array(list(x), pa.list_(pa.float32()))], ["at", "lang", "x"])
        release()

    def centroids(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = cluster(np.array(group.sort_values("at")["x"].tolist(), np.float32))
        return pd.DataFrame({"lang": [key[0]] * len(rows), "row": [r.astype(float) for r in rows]})

    drawn = drawn.mapInArrow(points, "at long, lang string, x array<float>").dropDuplicates(["lang", "at"])
    found = sorted(((r["lang"], r["row"]) for r in drawn.groupBy("lang").applyInPandas(centroids, "lang string, row array<double>").collect()), key=lambda r: (r[0], r[1]))
    if not found:
        return None
    model = Centroids(idf, [r[0] for r in found], np.array([r[1] for r in found]))
    model.limits = limits(rows, model)
    return model


def limits(rows: DataFrame, model: Centroids) -> dict[str, float]:
    """Least raised cosine that is accepted for each language, from those of all ``rows`` (text, lang) that are nearest to their own language."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        for b in batches:
            for at in range(0, len(b), 128):
                part = [(t, x) for t, x in zip(b.column("text").slice(at, 128).to_pylist(), b.column("lang").slice(at, 128).to_pylist(), strict=True) if has_letter(t)]
                names, cosines = model.nearest([t for t, _ in part])
                cosines = raised([t for t, _ in part], cosines)
                for (_, lang), name, cosine in zip(part, names, cosines, strict=True):
                    if name == lang:
                        key = lang, int(cosine * BINS)
                        seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["lang", "bin", "n"])
        release()

    added: dict[str, list[tuple[int, int]]] = {}
    for lang, bin_, n in rows.select("text", "lang").mapInArrow(binned, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n")).collect():
        added.setdefault(lang, []).append((bin_, n))
    out = {}
    for lang, bins in added.items():
        whole, below = sum(n for _, n in bins), 0
        for bin_, n in sorted(bins):
            below += n
            if below > RARE * whole:
                out[lang] = SLACK * bin_ / BINS
                break
    return out


def accepter(model: Centroids | None, reject: float = REJECT):  # noqa: ANN201
    """A function of a text column: whether the text is in one of the learned languages."""

    @F.pandas_udf("boolean")
    def each(texts: pd.Series) -> pd.Series:
        known = [i for i, t in enumerate(texts) if model and has_letter(t)]
        out = np.zeros(len(texts), bool)
        if known:
            some = [texts.iat[i] for i in known]
            out[known] = model.accepted(some, *model.nearest(some), reject)
        return pd.Series(out)

    return each


def identify(docs: DataFrame, learn: Column, keep: tuple[str, ...] = ("doc_id",), reject: float = REJECT) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) → ``keep``, lang_pred, score, rejected; learned from the rows where ``learn`` holds.

    A text that is null or has no letter is ``und`` with score 0 and is rejected. Others get the nearest learned language, its
    cosine as score, and are rejected below ``reject`` or the language's own limit; of equal cosines the first centroid's wins. Texts
    of any length count whole. Repeated rows are answered one by one and count in learning. Where nothing could be learned, every text
    is ``und`` and rejected; an empty table gives no rows. Columns other than those named don't matter.
    """
    model = fit(docs.where(learn))

    def each(texts: list) -> Iterator[tuple[int, int, list]]:
        known = [i for i, t in enumerate(texts) if model and has_letter(t)]
        names, scores, fine = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if known:
            some = [texts[i] for i in known]
            found, cosines = model.nearest(some)
            scores[known], fine[known] = cosines, model.accepted(some, found, cosines, reject)
            for i, name in zip(known, found, strict=True):
                names[i] = name
        yield 0, len(texts), [names, scores, ~fine]

    return attached(docs, keep, ("text",), "lang_pred string, score double, rejected boolean", each)

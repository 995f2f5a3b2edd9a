"""Quality scores: a Gaussian kernel on document statistics by random Fourier features, ridge regression, isotonic calibration.

Statistics of whole texts are computed once. The normal equations of the ridge
regression are summed by partition and fold, so training reads every labelled
row and what reaches the driver has the size of one matrix per fold. Models that
leave out a fold score that fold; the best penalty and the calibration come from
those scores. The calibration is the pool-adjacent-violators fit of a histogram.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerpulse.llm.frames import TEXTS_AT_ONCE, unused
from ledgerpulse.session import stage

FEATURES = 384
SEED = 42
PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1)
#: Width of the kernel in units of the square root of the number of statistics.
WIDTH = 1.0
BINS = 4096
THRESHOLD = 0.3
#: Rows whose features a worker holds at once, 3 MB.
AT_ONCE = 1000
#: Bytes that the compression statistic looks at together.
BLOCK = 1 << 16

_CLASS = np.zeros(256, dtype=np.int64)  # kinds of bytes: 0 letters, also beyond ASCII
_CLASS[[*range(33)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[*range(65, 91)]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_NEWLINE = 10

STATISTICS = (
    "log_bytes", "log_words", "upper", "digit", "punctuation", "symbol", "space", "newline", "word_length", "word_length_spread",
    "longest_word", "sentence_ends", "comma_ends", "symbol_ends", "no_letters", "capital_first", "all_upper", "repeated_next",
    "distinct_words", "most_frequent_word", "distinct_lines", "line_words", "compression", "entropy", "distinct_pairs", "inner_symbols",
)


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text, named by STATISTICS. A null text is empty; an empty text has zeros."""
    data = text.encode("utf-8", "replace") if text else b""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(STATISTICS)
    n, w = len(data), len(words)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=6) / n
    shares = counts[counts > 0] / n
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=w)
    last = Counter(x[-1] for x in words)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    packed = sum(len(zlib.compress(data[i : i + BLOCK], 1)) for i in range(0, n, BLOCK))
    pairs = len(set(zip(words, words[1:])))
    symbols = "!#$%&*+/<=>@[\\]^_`{|}~"
    return [
        math.log1p(n),
        math.log1p(w),
        kinds[3],
        kinds[2],
        kinds[4],
        kinds[5],
        kinds[1],
        counts[_NEWLINE] / w,
        math.log1p(lengths.mean()),
        math.log1p(lengths.std()),
        math.log1p(lengths.max()),
        sum(last[c] for c in ".?") / w,
        last[","] / w,
        sum(last[c] for c in symbols) / w,
        sum(not any(map(str.isalpha, x)) * c for x, c in seen.items()) / w if kinds[2] + kinds[4] + kinds[5] else 0.0,
        sum(x[0].isupper() * c for x, c in seen.items()) / w,
        sum((x.isupper() and len(x) > 1) * c for x, c in seen.items()) / w,
        sum(map(eq, words, words[1:])) / w,
        math.log(len(seen)) / math.log(w) if w > 1 else 1.0,
        max(seen.values()) / w,
        len(set(lines)) / len(lines),
        math.log1p(w / len(lines)),
        packed / (n + 12),
        float(-(shares * np.log2(shares)).sum()) / 8,
        pairs / (w - 1) if w > 1 else 1.0,
        last["|"] / w,
    ]


def text_statistics(text: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts], dtype="object")

    return F.pandas_udf(run, "array<double>").asNondeterministic()(text)


@dataclass
class QualityModel:
    """Scores statistics: standardise, random Fourier features, linear score, calibration by interpolation."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.spread, -8, 8)
        waves = np.cos(z @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(rows), 1))])

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(rows) @ self.weights, self.knots, self.levels), 0.0, 1.0)


def _slices(batches: Iterator[Any]) -> Iterator[Any]:
    """The batches in parts of at most ``AT_ONCE`` rows."""
    for batch in batches:
        for at in range(0, len(batch), AT_ONCE):
            yield batch.iloc[at : at + AT_ONCE]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), len(STATISTICS))


def _sums(model: QualityModel, folds: int):
    """Per partition and fold the sums x xᵀ and x y, a row of the matrix per output row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(model.phases) + 1
        total = np.zeros((folds, size, size + 1))
        for batch in _slices(batches):
            x, y, fold = model.features(_matrix(batch["statistics"])), batch["label"].to_numpy(dtype=np.float64), batch["fold"].to_numpy()
            for k in range(folds):
                mine = fold == k
                total[k] += x[mine].T @ np.column_stack([x[mine], y[mine]])
        for k in range(folds):
            if total[k].any():
                yield pd.DataFrame({"fold": k, "line": np.arange(size), "sums": list(total[k])})

    return run


def _summed(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"fold": [key[0]], "line": [key[1]], "sums": [np.sum(group["sums"].tolist(), axis=0)]})


def isotonic(position: np.ndarray, positives: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the mean position and the level of each block, both rising."""
    blocks: list[list[float]] = []  # weight, positives, weight times position
    for x, p, w in zip(position, positives, weight, strict=True):
        blocks.append([w, p, w * x])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def fit(rows: DataFrame, folds: int = 4, features: int = FEATURES, seed: int = SEED) -> QualityModel | None:
    """A model from all rows (statistics, label 0 or 1, fold 0 to folds - 1); None without rows.

    ``rows`` should be stored: it is read four times.
    """
    size = len(STATISTICS)
    at = [F.col("statistics")[i] for i in range(size)]
    base = rows.agg(F.count("*"), *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    if not base[0]:
        return None
    random = np.random.default_rng(seed)
    model = QualityModel(
        mean=np.array(base[1 : size + 1]),
        spread=np.array([s if s > 1e-9 else 1.0 for s in base[size + 1 :]]),
        directions=random.normal(0, 1 / (WIDTH * math.sqrt(size)), (size, features)),
        phases=random.uniform(0, 2 * math.pi, features),
        weights=np.zeros(features + 1),
        knots=np.zeros(1),
        levels=np.zeros(1),
    )
    schema = "fold int, line int, sums array<double>"
    sums = rows.mapInPandas(_sums(model, folds), schema).groupBy("fold", "line").applyInPandas(_summed, schema)
    total = np.zeros((folds, features + 1, features + 2))
    for r in sums.toLocalIterator():
        total[r.fold, r.line] = r.sums
    whole = total.sum(axis=0)

    def solved(part: np.ndarray, penalty: float) -> np.ndarray:
        n = max(1.0, part[-1, -2])
        ridge = penalty * n / features * np.eye(features + 1)
        ridge[-1, -1] = 1e-9
        return np.linalg.solve(part[:, :-1] + ridge, part[:, -1])

    # scores of each fold by the models that have not seen it, for every penalty; a fold that is all there is has no other
    others = [whole - total[k] if (whole - total[k]).any() else whole for k in range(folds)]
    trial = np.array([[solved(o, p) for p in PENALTIES] for o in others])
    errors, counts = np.zeros(len(PENALTIES)), []
    table = rows.mapInPandas(_histogram(model, trial), "penalty int, bin int, rows double, positives double, score double, error double")
    for r in table.groupBy("penalty", "bin").agg(*[F.sum(c).alias(c) for c in ("rows", "positives", "score", "error")]).toLocalIterator():
        errors[r.penalty] += r.error
        counts.append((r.penalty, r.score / r.rows, r.positives, r.rows))
    best = int(errors.argmin())
    chosen = np.array(sorted(c[1:] for c in counts if c[0] == best))
    model.weights = solved(whole, PENALTIES[best])
    model.knots, model.levels = isotonic(*chosen.T)
    return model


def _histogram(model: QualityModel, trial: np.ndarray):
    """Rows, positives, summed score and squared error by penalty and bin of the left-out score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(PENALTIES), BINS, 4))
        for batch in _slices(batches):
            x, y, fold = model.features(_matrix(batch["statistics"])), batch["label"].to_numpy(dtype=np.float64), batch["fold"].to_numpy()
            for p in range(len(PENALTIES)):
                score = np.einsum("ij,ij->i", x, trial[fold, p])
                place = np.clip(((score + 1) / 3 * BINS).astype(int), 0, BINS - 1)
                for i, part in enumerate((np.ones(len(y)), y, score, (score - y) ** 2)):
                    sums[p, :, i] += np.bincount(place, weights=part, minlength=BINS)
        used = np.argwhere(sums[:, :, 0] > 0)
        values = sums[used[:, 0], used[:, 1]]
        yield pd.DataFrame({"penalty": used[:, 0], "bin": used[:, 1]} | {c: values[:, i] for i, c in enumerate(("rows", "positives", "score", "error"))})

    return run


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 5; 0 is never trained on. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)).cast("int")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Learns from rows whose fold is not 0 and that have a quality of 0 or 1; of several labels of one id the mean rounded
    half up counts. Without any the score is 0.5, with a single class its share. Null texts are empty, repeated rows have one
    score, and an empty table gives an empty one.
    """
    rows = stage(docs.select("doc_id", fold_of(F.col("doc_id")).alias("crc"), text_statistics(F.col("text")).alias("statistics")), "statistics", TEXTS_AT_ONCE)
    model = _model(rows, labels)
    return rows.select(
        "doc_id",
        (F.col("crc") == 0).alias("held_out"),
        _scores(model)(F.col("statistics")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _model(rows: DataFrame, labels: DataFrame) -> QualityModel | None:
    marked = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("labelled")).agg(F.floor(F.avg("quality") + 0.5).cast("int").alias("label"))
    known = rows.where("crc > 0").join(marked, F.col("doc_id") == F.col("labelled"))
    return fit(stage(known.select("statistics", "label", (F.col("crc") - 1).alias("fold")), "labelled"))


def _scores(model: QualityModel | None):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            parts = [model.score(_matrix(part)) if model else np.full(len(part), 0.5) for part in _slices([rows])]
            yield pd.Series(np.concatenate([np.zeros(0), *parts]))

    return F.pandas_udf(run, "double").asNondeterministic()


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score is below the threshold.

    The rows are stored once with the statistics of their text, which training and scoring both read. Null texts are
    empty, repeated rows have one score, an empty table gives an empty one; without labels every score is 0.5.
    """
    statistics, score = unused(docs, "text_statistics", "quality_score")
    rows = stage(docs.withColumn(statistics, text_statistics(F.col("text"))), "statistics", TEXTS_AT_ONCE)
    crc = fold_of(F.col("doc_id")).alias("crc")
    model = _model(rows.select("doc_id", crc, F.col(statistics).alias("statistics")).where("crc > 0"), labels)
    return rows.withColumn(score, _scores(model)(F.col(statistics))).where(F.col(score) >= threshold).select(*docs.columns)

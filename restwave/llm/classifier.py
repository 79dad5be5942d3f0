"""Quality by regularised quadratic discriminant analysis of document statistics.

Each text becomes a short vector of transformed statistics. Counts, sums and outer products by class are added
up over all training rows by Spark, so the fit needs no sample and one small matrix for each class is all that
reaches the driver. Each covariance is shrunk towards a scaled diagonal; its Cholesky factor is computed once
and sent with the model. A score is the logistic of the difference of the two log densities (Mahalanobis
distance and log determinant) plus the log prior odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restwave.llm.common import durable, named, row_struct, ship_package, with_outputs

#: Weight of the shrinkage target in the covariances; fraction of the target that is the pooled mean variance.
SHRINKAGE, SPHERE = 0.10, 0.05
#: Held-out rows are those whose crc32 of the id's text leaves this remainder.
FOLDS, HELD_OUT = 5, 0
#: Log density differences are scaled by this before the logistic: statistics of one text are dependent.
TEMPERATURE = 4.0

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 digit, 3 space, 4 sentence mark, 5 symbol, 6 lower, 7 beyond ASCII
for _members, _code in ((range(65, 91), 1), (range(48, 58), 2), (b" \t\n\x0b\x0c\r", 3), (b".,;:?-'\"()", 4), (b"!#*$%&|<>@^~_=+/\\{}[]`", 5), (range(97, 123), 6), (range(128, 256), 7)):
    _CLASS[list(_members)] = _code

STATISTICS = ("log_words", "word_length", "word_spread", "upper", "digits", "marks", "symbols", "symbol_words", "distinct_words", "distinct_pairs",
              "repeats", "top_word", "log_line", "distinct_lines", "ended_lines", "short_words")


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text; those of an empty one are all zero."""
    data = text.encode() if text else b""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8)
    chars = max(1, len(data) - int(kinds[3]))
    sizes = np.fromiter(map(len, words), np.float64, n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    odd = sum(w[-1] in b"!#*$%&|<>@^~_=+/\\" for w in words)

    def share(part: float, whole: float) -> float:  # variance-stabilising for proportions
        return float(np.arcsin(np.sqrt(min(1.0, part / whole)))) if whole else 0.0

    return [float(np.log1p(n)), float(np.log(sizes.mean())), float(np.log1p(sizes.std())), share(kinds[1], chars), share(kinds[2], chars), share(kinds[4], chars),
            share(kinds[5], chars), share(odd, n), share(len(counts), n), share(len(set(zip(words, words[1:]))), n - 1), share(sum(map(eq, words, words[1:])), n),
            share(max(counts.values()), n), float(np.log(n / len(lines))), share(len(set(lines)), len(lines)), share(sum(x.rstrip()[-1:] in b".!?:;\"'" for x in lines), len(lines)),
            share(float((sizes <= 3).sum()), n)]


def with_statistics(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None) -> DataFrame:
    """row (struct of `keep`), id and x (array of statistics)."""
    ship_package(docs.sparkSession)
    source = docs.select(row_struct(docs, keep).alias("row"), named(docs, id_col).cast("long").alias("id"), named(docs, text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], pa.array(x, pa.list_(pa.float64()))], ["row", "id", "x"])

    return source.mapInArrow(run, T.StructType([source.schema["row"], source.schema["id"], T.StructField("x", T.ArrayType(T.DoubleType()))]))


@dataclass
class Model:
    """Log prior odds of label 1 and, unless a class was too small to fit, mean and Cholesky factor of each.

    The factors are inverted once, so a batch costs one product for each class.
    """

    log_odds: float
    means: list[np.ndarray] | None = None
    factors: list[np.ndarray] | None = None

    def __post_init__(self) -> None:
        self.inverses = None if self.factors is None else [np.tril(np.linalg.inv(f)) for f in self.factors]

    def log_density(self, label: int, x: np.ndarray) -> np.ndarray:
        z = (x - self.means[label]) @ self.inverses[label].T  # Mahalanobis distance is |z|^2
        return -0.5 * (z**2).sum(axis=1) - np.log(np.diag(self.factors[label])).sum()

    def scores(self, x: np.ndarray) -> np.ndarray:
        difference = np.zeros(len(x)) if self.factors is None else self.log_density(1, x) - self.log_density(0, x)
        return 1 / (1 + np.exp(-np.clip(difference / TEMPERATURE + self.log_odds, -700, 700)))


def fit(features: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """Fits on rows of (label 0 or 1, x array<double>), all of them. A class of fewer than two rows has no
    covariance: the score is then the prior, with one row added to each class."""
    d = len(STATISTICS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.array(batch["x"].flatten()).reshape(-1, d)
            y = batch["label"].to_numpy(zero_copy_only=False)
            for label in (0, 1):
                part = x[y == label]
                total[label] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel())], ["i", "v"])

    rows = features.mapInArrow(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(2 * (1 + d + d * d))
    for i, v in rows:
        total[i] = v
    total = total.reshape(2, -1)
    n = total[:, 0]
    log_odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if n.min() < 2:
        return Model(log_odds)
    means = [t[1:1 + d] / t[0] for t in total]
    covariances = [t[1 + d:].reshape(d, d) / t[0] - np.outer(m, m) for t, m in zip(total, means)]
    pooled = sum(c * k for c, k in zip(covariances, n)) / n.sum()
    spread = np.diag(pooled) + SPHERE * max(np.diag(pooled).mean(), 1e-9)
    shrunk = [(1 - shrinkage) * c + shrinkage * np.diag(spread) for c in covariances]
    return Model(log_odds, means, [np.linalg.cholesky(c) for c in shrunk])


def held_out(id_column) -> F.Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if None) and held_out, score (that the label is 1), predicted.

    Labels are learnt from rows that aren't held out; several labels of one id count as their least, null and
    other labels as none. Only the text enters a score. Null, empty and blank texts have all-zero statistics and
    a score like any other; a null id is neither held out nor learnt from. Empty tables are fine: without labels
    of both classes every score is the prior. Input columns named like an output give way to it.
    """
    features = durable(with_statistics(docs, id_col, text_col, keep))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    training = features.select("id", "x").where(~held_out(F.col("id"))).join(known, "id").select("label", "x")
    model = fit(training)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch["x"].flatten()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], pa.array(model.scores(x))], ["row", "id", "score"])

    scored = features.mapInArrow(run, T.StructType([features.schema["row"], features.schema["id"], T.StructField("score", T.DoubleType())]))
    judged = scored.select("row", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    return with_outputs(judged, "row", ["held_out", "score", "predicted"])

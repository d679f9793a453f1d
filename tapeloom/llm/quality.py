"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

A document becomes a short vector of bounded statistics (shares of character classes, word and line shape, repetition).
Each class has a mean and a covariance, shrunk towards the pooled covariance and towards its diagonal, whose Cholesky
factor is computed once; a score is the logistic of the difference of the two Mahalanobis log densities, divided by a temperature.

Training reads every labelled row outside the held-out fold; no sample is taken. The two shrinkages and the temperature are the
ones of a fixed grid that have the least logistic loss in cross-validation over FOLDS parts of the training rows: a pass adds up
counts, sums and cross products by part and label, a second one the losses of every setting. Only (features + 1)^2 numbers
for each label and part and one for each setting reach the driver.

Defined results: a null text is the empty text and gets a score like any other; very long texts are read whole; labels that
are null or neither 0 nor 1 (0.5, say) are not used; a document with several labels counts once for each, as do rows repeated under a
key, and each row gets its own score; null keys count as the empty key for the folds and have no label; without rows of both classes every
score is the share of label 1 among the training rows (1.0 without any); with too few rows for cross-validation the
defaults below are used; an empty table gives no rows; other columns, also those named like results, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tapeloom.llm.common import Scratch, crc_fold, list_array, pieces, utf8

#: Weight of the pooled covariance in a class's, then of the diagonal in the result, where nothing is estimated; smallest variance of a statistic.
TO_POOLED, TO_DIAGONAL, FLOOR = 0.8, 0.1, 1e-4
#: Log densities differ by a multiple of the real evidence where statistics are not Gaussian; their difference is divided by this.
TEMPERATURE = 2.0
#: What cross-validation chooses from, and its parts.
GRID = [(p, d, t) for p in (0.0, 0.2, 0.4, 0.6, 0.8, 0.95) for d in (0.0, 0.1, 0.3) for t in (1.0, 1.5, 2.0, 3.0, 5.0)]
FOLDS = 4

_CLASS = np.zeros(256, np.int64)  # 0 others
_CLASS[[32, *range(9, 14)]] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[[c for c in range(33, 127) if _CLASS[c] == 0]] = 6
_CLASS[128:192] = 7  # UTF-8 continuation bytes
_CLASS[192:] = 8
NAMES = ("length", "space", "digit", "upper", "mark", "symbol", "wide", "word_length", "distinct", "symbol_words", "caps_words", "distinct_lines", "line_length", "commonest", "sentence", "long_words")


def statistics(text: bytes) -> list[float]:
    """The vector of one document, every component between about 0 and 2."""
    n = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=9)
    chars = max(1, len(text) - n[7])
    words = text.split()
    m = max(1, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    ends = sum(w[-1] in b".!?" for w in words)
    odd = sum(c * (w[-1] in b"#$%&*@^~|<>=+_\\/{}[]" or w[-2:] == b"!!") for w, c in seen.items())
    caps = sum(c for w, c in seen.items() if len(w) > 2 and w.isupper())
    long = sum(c for w, c in seen.items() if len(w) > 24)
    lines = [x for x in text.split(b"\n") if x]
    k = max(1, len(lines))
    root = lambda a, b: (a / b) ** 0.5
    return [
        np.log1p(m) / 8, root(n[1], chars), root(n[2], chars), root(n[3], chars), root(n[5], chars), root(n[6], chars), root(n[8], chars), np.log1p(chars / m) / 3,
        len(seen) / m if words else 1.0, root(odd, m), root(caps, m), len(set(lines)) / k if lines else 1.0, np.log1p(m / k) / 6, root(max(seen.values(), default=0), m), root(ends, m), root(long, m),
    ]


def features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and x (array of double) for each row of df."""
    return with_features(df.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("_text")), "x", "_text").select(key, "x")


def with_features(df: DataFrame, name: str, text: str = "text") -> DataFrame:
    """df plus the column name: its rows' statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = np.array([statistics(t) for t in utf8(batch.column(text))], np.float64).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns, list_array(x.ravel(), np.full(batch.num_rows, len(NAMES)))], names=[*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))]))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(n, len(NAMES))


def moments(rows: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """For each part and label the matrix of cross products of (1, x): rows has part, label and x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            group = np.asarray(batch.column("part")) * 2 + np.asarray(batch.column("label"))
            x = _matrix(batch.column("x"), batch.num_rows)
            for g in np.unique(group).tolist():
                own = np.hstack([np.ones(((group == g).sum(), 1)), x[group == g]])
                total[g] = total.get(g, 0) + own.T @ own
        for g, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.ravel())], names=["g", "cell", "value"])

    cells = rows.mapInArrow(run, "g int, cell int, value double").groupBy("g", "cell").agg(F.sum("value").alias("value")).collect()
    out = {divmod(r.g, 2): np.zeros((len(NAMES) + 1) ** 2) for r in cells}
    for r in cells:
        out[divmod(r.g, 2)][r.cell] = r.value
    return {g: m.reshape(len(NAMES) + 1, -1) for g, m in out.items()}


@dataclass
class Discriminant:
    """Two Gaussian classes with cached Cholesky factors."""

    share: float
    parts: list[tuple[np.ndarray, np.ndarray, float]]  # of classes 0 and 1: mean, Cholesky factor, half the log determinant
    temperature: float = TEMPERATURE

    @classmethod
    def fit(cls, cross: dict[int, np.ndarray], to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL, temperature: float = TEMPERATURE) -> Discriminant:
        n = {c: cross[c][0, 0] if c in cross else 0.0 for c in (0, 1)}
        share = n[1] / (n[0] + n[1]) if n[0] + n[1] else 1.0
        if not n[0] or not n[1]:
            return cls(share, [])
        mean = {c: cross[c][0, 1:] / n[c] for c in (0, 1)}
        scatter = {c: cross[c][1:, 1:] - n[c] * np.outer(mean[c], mean[c]) for c in (0, 1)}
        pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
        parts = []
        for c in (0, 1):
            cov = (1 - to_pooled) * scatter[c] / n[c] + to_pooled * pooled
            cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + FLOOR * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            parts.append((mean[c], factor, float(np.log(np.diag(factor)).sum())))
        return cls(share, parts, temperature)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """The log density of class 1 over that of class 0, shares included."""
        density = [-half - 0.5 * (np.linalg.solve(factor, (x - mean).T) ** 2).sum(0) for mean, factor, half in self.parts]
        return density[1] - density[0] + np.log(self.share / (1 - self.share))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.evidence(x) / self.temperature, -500, 500)))


def score(rows: DataFrame, model: Discriminant) -> DataFrame:
    """rows (with x) plus score."""
    names = [c for c in rows.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(model.score(_matrix(batch.column("x"), batch.num_rows)))], names=[*names, "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "x")
    return rows.mapInArrow(run, f"{schema}, score double")


def losses(rows: DataFrame, cross: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """The summed logistic loss of each setting of GRID, every part scored by a model of the other parts (rows has part, label and x)."""
    models: dict[int, list[Discriminant]] = {}
    for part in {p for p, _ in cross}:
        rest = {c: sum(m for (p, label), m in sorted(cross.items()) if p != part and label == c) for c in (0, 1)}
        if all(isinstance(m, np.ndarray) for m in rest.values()):
            models[part] = [Discriminant.fit(rest, p, d) for p, d in dict.fromkeys((p, d) for p, d, _ in GRID)]
    warm = np.array(list(dict.fromkeys(t for _, _, t in GRID)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(GRID))
        for batch in batches:
            x, part, label = _matrix(batch.column("x"), batch.num_rows), np.asarray(batch.column("part")), np.asarray(batch.column("label"))
            for own, fitted in models.items():
                at = part == own
                if at.any():
                    side = np.where(label[at] == 1, -1.0, 1.0)
                    total += np.concatenate([np.logaddexp(0, m.evidence(x[at])[None] * side / warm[:, None]).sum(1) for m in fitted])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(GRID)), pa.int32()), pa.array(total)], names=["setting", "loss"])

    found = rows.mapInArrow(run, "setting int, loss double").groupBy("setting").agg(F.sum("loss").alias("loss")).collect() if models else []
    out = np.zeros(len(GRID))
    for r in found:
        out[r.setting] = r.loss
    return out


def train(x: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", folds: int = 4, held_out: int = 2) -> Discriminant:
    """Fits on the labelled rows of x (key, x) outside the held-out fold."""
    usable = F.col(label).isin(0, 1) & (crc_fold(key, folds) != held_out)
    part = F.pmod(F.xxhash64(F.col(key), F.lit(9)), F.lit(FOLDS)).cast("int")
    own = labels.where(usable).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label"), part.alias("part"))
    rows = Scratch(x.sparkSession, "quality-training").write(x.join(own, F.col(key) == F.col("_key")).select("part", "label", "x"), "rows")
    cross = moments(rows)
    whole = {c: sum(m for (_, own), m in sorted(cross.items()) if own == c) for c in {c for _, c in cross}}
    loss = losses(rows, cross)
    best = GRID[int(loss.argmin())] if loss.any() else (TO_POOLED, TO_DIAGONAL, TEMPERATURE)
    return Discriminant.fit(whole, *best)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 4, held_out: int = 2) -> DataFrame:
    """key, held_out and score for each row of docs."""
    x = Scratch(docs.sparkSession, "quality").write(features(docs, key, text), "features")
    return score(x, train(x, labels, key, folds=folds, held_out=held_out)).withColumn("held_out", crc_fold(key, folds) == held_out)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text", folds: int = 4, held_out: int = 2) -> DataFrame:
    """The rows of docs that score threshold or more, with docs' columns; results are defined as above. Statistics are
    computed once and written beside the rows; the documents are never shuffled."""
    rows = Scratch(docs.sparkSession, "quality").write(with_features(docs, "_statistics", text), "rows")
    model = train(rows.select(F.col(key).cast("bigint").alias(key), F.col("_statistics").alias("x")), labels, key, folds=folds, held_out=held_out)

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            stay = model.score(_matrix(batch.column("_statistics"), batch.num_rows)) >= threshold
            yield batch.select(names).filter(pa.array(stay))

    return rows.mapInArrow(run, docs.schema)

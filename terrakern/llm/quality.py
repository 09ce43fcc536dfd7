"""Quality classifier from positive and unlabelled documents.

Surface shares of each whole text (letters, capitals, digits, marks, repeated words, lengths) and their squares feed a linear
score. Training minimises the non-negative unbiased risk with the logistic loss: trusted positives are the documents whose
label is 1, the unlabelled ones are the other documents of the learning folds; a label of 0 isn't used. The class prior is
estimated from the least ratio of unlabelled to positive shares above any bound of a first score. Training sees a bounded
sample (SAMPLE rows of each kind, by the hash of the id); every document is scored, by column arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrakern.llm import textbytes as tb
from terrakern.llm.common import cut, id_text_crc, sample, table

#: Rows of each kind that training sees at most.
SAMPLE = 20_000
FOLDS, HELD_OUT = 3, 1

_CLASS = np.zeros(256, np.uint8)
_CLASS[tb.SPACE] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[46, 44, 59, 58, 39, 34, 45, 63, 40, 41]] = 5  # . , ; : ' " - ? ( )
_CLASS[33] = 6  # !
_CLASS[124] = 7  # |
_CLASS[128:] = 8
_CLASS[(_CLASS == 0) & (np.arange(256) > 32)] = 9  # other marks
KINDS = 10
FEATURES = ("space", "lower", "upper", "digit", "stop", "shout", "bar", "beyond", "mark", "control", "length", "word_length", "words", "repeated", "distinct", "marked", "capital", "longest")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    n = len(offsets) - 1
    lengths = np.diff(offsets).astype(float)
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(owner * KINDS + _CLASS[data], minlength=n * KINDS).reshape(n, KINDS)
    out[:, :10] = counts[:, [1, 2, 3, 4, 5, 6, 7, 8, 9, 0]] / np.maximum(lengths, 1)[:, None]
    out[:, 10] = np.log1p(lengths) / 10
    starts, ends, text = tb.word_spans(data, offsets)
    if len(starts):
        h = tb.word_hashes(data, starts, ends)
        words = np.bincount(text, minlength=n).astype(float)
        some = np.maximum(words, 1)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        order = np.lexsort((h, text))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
        last = _CLASS[data[ends - 1]]
        out[:, 11] = np.bincount(text, ends - starts, n) / some / 10
        out[:, 12] = np.log1p(words) / 10
        out[:, 13] = np.bincount(text[same], minlength=n) / some
        out[:, 14] = np.bincount(text[order][fresh], minlength=n) / some
        out[:, 15] = np.bincount(text[(last == 9) | (last == 6)], minlength=n) / some
        out[:, 16] = np.bincount(text[_CLASS[data[starts]] == 3], minlength=n) / some
        longest = np.zeros(n)
        np.maximum.at(longest, text, (ends - starts).astype(float))
        out[:, 17] = np.log1p(longest) / 10
    return out


def with_features(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns of docs under the new names that `columns` gives them, and f, an array of FEATURES, for each row of docs."""
    chosen = docs.select(*[F.col(c).alias(n) for c, n in columns.items()])
    given = chosen.schema.fields
    schema = T.StructType([*given, T.StructField("f", T.ArrayType(T.FloatType()))])
    if "text" in columns:
        place = list(columns).index("text")
    else:
        place, chosen = len(given), docs.select(*[F.col(c).alias(n) for c, n in columns.items()], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.texts(batch.column(place))
            rows = [features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in tb.slices(offsets)]
            values = np.concatenate(rows).astype(np.float32) if rows else np.empty((0, len(FEATURES)), np.float32)
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(FEATURES)), pa.array(values.ravel()))
            yield pa.record_batch([*batch.columns[: len(given)], arrays], [*[f.name for f in given], "f"])

    return chosen.mapInArrow(run, schema)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]  # for each feature, then for each square
    bias: float
    prior: float

    def score(self, f: Column) -> Column:
        """Probability of the positive class."""
        raw = F.lit(self.bias)
        n = len(FEATURES)
        for i in range(n):
            x = F.get(f, F.lit(i)).cast("double")
            raw = raw + x * (F.lit(self.weights[i]) + x * F.lit(self.weights[n + i]))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(raw, F.lit(500.0)), F.lit(-500.0))))


def _loss(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, -g)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(g, -500, 500)))


def _descend(x: np.ndarray, gradient, steps: int, rate: float = 0.1) -> np.ndarray:
    """Adam over all rows."""
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, ridge: float = 1e-2) -> Model:
    """Features of trusted positives and of unlabelled documents; without either, a model that scores 0.5."""
    n = len(FEATURES)
    if not len(positive) or not len(unlabelled):
        return Model((0.0,) * (2 * n), 0.0, 0.5)
    both = np.concatenate([positive, unlabelled]).astype(float)
    both = np.concatenate([both, both**2], axis=1)
    mean, spread = both.mean(axis=0), both.std(axis=0)
    spread[spread < 1e-6] = 1.0
    x = np.concatenate([(both - mean) / spread, np.ones((len(both), 1))], axis=1)
    p, u = x[: len(positive)], x[len(positive) :]

    def plain(w: np.ndarray) -> np.ndarray:
        return -p.T @ _sigmoid(-p @ w) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + ridge * w

    first = _descend(x, plain, steps // 2)
    above = np.quantile(p @ first, np.linspace(0.0, 0.7, 36))
    prior = float(np.clip(min((u @ first >= b).mean() / max((p @ first >= b).mean(), 1e-9) for b in above), 0.02, 0.98))

    def non_negative(w: np.ndarray) -> np.ndarray:
        gp, gu = p @ w, u @ w
        of_positive = -prior * p.T @ _sigmoid(-gp) / len(p)
        of_negative = u.T @ _sigmoid(gu) / len(u) - prior * p.T @ _sigmoid(gp) / len(p)
        risk = _loss(-gu).mean() - prior * _loss(-gp).mean()
        # Below zero the negative part is overfitted; the step goes back up it.
        return (of_positive + of_negative if risk >= 0 else -of_negative) + ridge * w

    w = _descend(x, non_negative, steps)
    weights = w[:-1] / spread
    return Model(tuple(weights.tolist()), float(w[-1] - weights @ mean), prior)


def _sampled(rows: DataFrame, limit: int) -> np.ndarray:
    """Features of at most `limit` rows, by the hash of the id."""
    got = sample(rows.select("f", "doc_id"), ["doc_id"], limit).select("f").collect()
    return np.array([r["f"] for r in got], np.float64).reshape(-1, len(FEATURES))


def held_out(doc_id: Column) -> Column:
    return id_text_crc(doc_id) % FOLDS == HELD_OUT


def train(featured: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """featured: (doc_id, f). Labels (doc_id, quality): a document is a trusted positive if any of its labels is 1."""
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    learning = featured.where(~held_out(F.col("doc_id"))).select("doc_id", "f")
    positive = learning.join(trusted, "doc_id", "left_semi")
    unlabelled = learning.join(trusted, "doc_id", "left_anti")
    return fit(_sampled(positive, most), _sampled(unlabelled, most))


def rate(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` (doc_id unless given), held_out, score and predicted of every row of docs (doc_id, text, ...).

    A null or empty text is scored by its empty features. A null id counts as the empty text for its fold. Repeated rows
    each give a row. Without labels of 1, every score is 0.5. Whole texts are read, however long; equal texts score alike, and
    of labels that repeat an id each counts. An empty table gives an empty one.
    """
    keep = keep or ["doc_id"]
    names = {c: f"_in_{c}" for c in dict.fromkeys([*keep, "doc_id"])}
    featured = cut(with_features(docs, names))
    model = train(featured.select(F.col("_in_doc_id").alias("doc_id"), "f"), labels)
    score = model.score(F.col("f"))
    out = featured.select(*[F.col(names[c]).alias(c) for c in keep], held_out(F.col("_in_doc_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns. The texts are read twice and never shuffled."""
    model = train(cut(with_features(docs, {"doc_id": "doc_id"})), labels)
    names = {c: f"_in_{c}" for c in docs.columns}
    scored = with_features(docs, names).where(model.score(F.col("f")) >= 0.5)
    return scored.select(*[F.col(n).alias(c) for c, n in names.items()])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rate() over all documents and labels."""
    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Random cosines approximate a Gaussian kernel over the standardised statistics. The normal equations are summed per
partition and then by Spark, entry by entry, so the driver gets one matrix of fixed size however many rows are
labelled. Rows are dealt by crc32 of the id as text: remainder 0 of 3 fits the ridge scores, 2 calibrates them, 1 is
held out from both.

Defined cases: a null or empty text has statistics of zero and a score like any other; repeated rows are scored each;
documents whose labels disagree teach nothing; without labels of both kinds every score is 0.5; an empty table gives
an empty result; language, source and id are never looked at.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, stored

N_FEATURES = 192
BANDWIDTH = 2.0
RIDGE = 1e-3
SEED = 7
CALIBRATION_BINS = 400

STATISTICS = ("log_chars", "log_words", "upper", "symbols", "bangs", "pipes", "digits", "word_length", "lines", "distinct", "stops", "commas", "wide", "repeats", "top_word")

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_SYMBOLS = b"#*$%&<>"
_DIGITS = b"0123456789"
_WIDE = bytes(range(0xC0, 0x100))  # first bytes of characters beyond ASCII


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    count = lambda marks: len(raw) - len(raw.translate(None, marks))
    letters = max(count(_LETTERS), 1)
    pairs = len(set(zip(words, words[1:], strict=False)))
    each = Counter(words)
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        count(_UPPER) / letters,
        min(count(_SYMBOLS) / n, 3.0),
        min(raw.count(b"!") / n, 3.0),
        min(raw.count(b"|") / n, 1.0),
        count(_DIGITS) / size,
        min(size / n, 20.0),
        min(raw.count(b"\n") / n, 1.0),
        len(each) / n,
        min((raw.count(b".") + raw.count(b"?")) / n, 1.0),
        min(raw.count(b",") / n, 1.0),
        count(_WIDE) / size,
        1 - pairs / max(len(words) - 1, 1) if len(words) > 1 else 0.0,
        max(each.values(), default=0) / n,
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([np.ones((len(x), 1)), waves])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0) if len(x) else np.zeros(0)


def with_statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns `carry` (under slot names _c0, _c1, ...) and `stats`."""
    slots = [f"_c{i}" for i in range(len(carry))]
    kinds = dict(docs.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = pa.array([statistics(t.as_py()) for t in batch.column(len(slots))], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(slots)], stats], names=[*slots, "stats"])

    named = docs.select(*(F.col(f"`{c}`").alias(s) for c, s in zip(carry, slots, strict=True)), F.col("text").alias("_text"))
    return map_columns(named, named.columns, run, ", ".join([*(f"{s} {kinds[c]}" for s, c in zip(slots, carry, strict=True)), "stats array<double>"]))


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing means nearest to sums / counts."""
    blocks: list[list[float]] = []
    for s, c in zip(sums.tolist(), counts.tolist(), strict=True):
        blocks.append([s, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, c2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + c2, blocks[-1][2] + n2]
    return np.repeat([s / c for s, c, _ in blocks], [n for _, _, n in blocks])


def _matrix(batch: pa.RecordBatch, at: int) -> np.ndarray:
    column = batch.column(at)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(stats: DataFrame, labels: DataFrame, n_features: int = N_FEATURES, ridge: float = RIDGE) -> Model:
    """stats: a stored table of doc_id and stats."""
    agreed = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    agreed = agreed.filter("lo = hi").select("doc_id", F.col("lo").cast("double").alias("label"))
    taught = stored(stats.join(agreed, "doc_id").withColumn("fold", fold()).filter("fold <> 1"), "taught")
    f = len(STATISTICS)
    sums = taught.filter("fold = 0").agg(F.count("*"), F.sum("label"), *(F.sum(F.col("stats")[i]) for i in range(f)), *(F.sum(F.col("stats")[i] * F.col("stats")[i]) for i in range(f))).first()
    n, good = sums[0], sums[1] or 0
    draw = np.random.default_rng(SEED)
    directions = draw.normal(size=(f, n_features)) / (BANDWIDTH * np.sqrt(f / 4))
    phases = draw.uniform(0, 2 * np.pi, n_features)
    if not 0 < good < n:
        blank = np.zeros(n_features + 1)
        return Model(np.zeros(f), np.ones(f), directions, phases, blank, np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    mean = np.array(sums[2 : 2 + f]) / n
    spread = np.sqrt(np.maximum(np.array(sums[2 + f :]) / n - mean**2, 1e-6))
    blank = Model(mean, spread, directions, phases, np.zeros(n_features + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    pull = np.array([0.5 * n / (n - good), 0.5 * n / good])  # both labels weigh the same

    def normal(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                z = blank.features(_matrix(batch, 0))
                y = batch.column(1).to_numpy()
                zw = z * pull[y.astype(int)][:, None]
                part = np.concatenate([(zw.T @ z).ravel(), zw.T @ y])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    parts = taught.filter("fold = 0").select("stats", "label").mapInArrow(normal, "sums array<double>")
    cells = parts.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect()
    d = n_features + 1
    flat = np.zeros(d * d + d)
    for row in cells:
        flat[row["at"]] = row["value"]
    gram = flat[: d * d].reshape(d, d)
    gram[np.diag_indices(d)] += ridge * n
    weights = np.linalg.solve(gram, flat[d * d :])

    fitted = Model(mean, spread, directions, phases, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def binned(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = np.clip(((fitted.raw(_matrix(batch, 0)) + 0.5) / 2 * CALIBRATION_BINS).astype(int), 0, CALIBRATION_BINS - 1)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column(1)], names=["bin", "label"])

    bins = map_columns(taught.filter("fold = 2"), ["stats", "label"], binned, "bin int, label double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()
    if not bins or not 0 < sum(r["good"] for r in bins) < sum(r["n"] for r in bins):
        return fitted
    bins.sort(key=lambda r: r["bin"])
    knots = (np.array([r["bin"] for r in bins]) + 0.5) / CALIBRATION_BINS * 2 - 0.5
    levels = isotonic(np.array([r["good"] for r in bins], float), np.array([r["n"] for r in bins], float))
    # flat steps keep a little of the ridge score, so that ties are broken as it ranks them
    levels = 0.98 * levels + 0.02 * np.clip(knots, 0, 1)
    return Model(mean, spread, directions, phases, weights, np.concatenate([[knots[0] - 1], knots, [knots[-1] + 1]]), np.concatenate([[0.98 * levels[0]], levels, [levels[-1] + 0.02 * (1 - levels[-1])]]))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats of every row, stored."""
    return stored(with_statistics(docs, ["doc_id"]).withColumnRenamed("_c0", "doc_id"), "statistics")


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for a table of doc_id and stats."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(_matrix(batch, 1)))], names=["doc_id", "score"])

    return map_columns(stats, ["doc_id", "stats"], run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents whose score is `least` or more, with their own columns (whatever their names)."""
    own, slots = docs.columns, [f"_c{i}" for i in range(len(docs.columns))]
    kinds = dict(docs.dtypes)

    # statistics and score in one function: one Python worker a task
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = np.array([statistics(t.as_py()) for t in batch.column(len(slots))], float).reshape(batch.num_rows, -1)
        return batch.select(slots).filter(pa.array(model.scores(stats) >= least))

    named = docs.select(*(F.col(f"`{c}`").alias(s) for c, s in zip(own, slots, strict=True)), F.col("text").alias("_text"))
    kept = map_columns(named, named.columns, run, ", ".join(f"{s} {kinds[c]}" for c, s in zip(own, slots, strict=True)))
    return kept.select(*(F.col(s).alias(c) for s, c in zip(slots, own, strict=True)))

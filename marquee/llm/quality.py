"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise part is computed in linear time as
half of the sum over factors of (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2.

Inputs of a score come from the text alone: hashed distinct words, structure statistics (also cut into bins,
so that pairs of bins interact) and, where named, metadata columns as hashed name=value pairs. The model is fitted by stochastic
gradient steps on a bounded sample of labelled rows (TRAIN_ROWS at most, the smallest hashes of the
id); every row of the table is scored with its whole text.

Defined results: a null text counts as empty; an empty text has a score like any other; null labels and labels without a
document teach nothing; repeated rows each get a row; if there is no labelled row, every score is 0.5
(label 1); with one class only, the share of label 1 with one case of each added; an empty table gives an empty result; an id that stands on several
rows teaches once for each; other columns are not read, and stay as they are in with_scores(), whose score_col must be a new name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import text_or_empty

TRAIN_ROWS = 12_000
WORD_SLOTS = 1 << 14
FACTORS = 8
EPOCHS = 12
#: Upper edges of the bins of every statistic.
EDGES = np.array([0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.14, 0.18, 0.22, 0.27, 0.33, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.96])
STATISTICS = ("upper", "digit", "symbol", "bang", "pipe", "other_bytes", "spaces", "line_feeds", "distinct", "repeated_next", "mean_word", "marked_words", "bare_symbols", "caps_words", "log_words", "line_words")
META_SLOTS = 1 << 10
SLOTS = WORD_SLOTS + len(STATISTICS) * (len(EDGES) + 2) + META_SLOTS
WORD_WEIGHT = 1.0

def features(text: str, metadata: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of one document."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    different = set(words)
    upper, digit = counts[65:91].sum(), counts[48:58].sum()
    letters = upper + counts[97:123].sum() + counts[128:].sum()
    white = counts[9:14].sum() + counts[32]
    visible = max(1, size - white)
    word = max(1, n)
    lines = data.count(b"\n") + 1
    values = [
        upper / max(1, letters), digit / visible, (visible - letters - digit) / visible, counts[33] / visible * 4, counts[124] / visible * 4, counts[128:].sum() / size, white / size, lines / word,
        len(different) / word, sum(map(bytes.__eq__, words, words[1:])) / word, min(1.0, visible / word / 20), sum(len(w) > 1 and not (w[-1:].isalnum() or w[-1] > 127 or w[-1] in b".,") for w in different) / max(1, len(different)),
        sum(not w.strip(b"#$%&*|!?.,;:-=+<>/\\~^_@'\"()[]{}") for w in different) / max(1, len(different)), sum(w.isupper() for w in different) / max(1, len(different)), min(1.0, np.log1p(n) / 12), min(1.0, n / lines / 200),
    ]
    values = np.clip(np.array(values), 0, 1)
    k = len(STATISTICS)
    bins = WORD_SLOTS + np.arange(k) * (len(EDGES) + 2)
    slots = [np.fromiter(map(zlib.crc32, different), np.int64, len(different)) % WORD_SLOTS, bins + 1 + np.searchsorted(EDGES, values), bins]
    weights = [np.full(len(different), WORD_WEIGHT / np.sqrt(max(1, len(different)))), np.full(k, 0.5), values]
    if metadata:
        slots.append(SLOTS - META_SLOTS + np.array([zlib.crc32(m.encode()) % META_SLOTS for m in metadata]))
        weights.append(np.full(len(metadata), 0.5))
    return np.concatenate(slots), np.concatenate(weights).astype(np.float32)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One margin for each document; starts: its first place in slots."""
        v = self.factors[slots] * values[:, None]
        sums, squares = np.add.reduceat(v, starts), np.add.reduceat(v * v, starts)
        return self.bias + np.add.reduceat(self.linear[slots] * values, starts) + 0.5 * (sums**2 - squares).sum(axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.08, decay: float = 1e-4) -> Model:
    """Adagrad on the logistic loss, minibatches of 64 documents; the classes weigh as they occur."""
    rng = np.random.default_rng(1)
    w, v = np.zeros(SLOTS, np.float32), rng.normal(0, 0.02, (SLOTS, FACTORS)).astype(np.float32)
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(float(np.log(share / (1 - share))), w, v)
    if len(set(labels.tolist())) < 2:
        model.factors[:] = 0
        return model if len(labels) else Model(0.0, w, model.factors)
    gw, gv, gb = np.full(SLOTS, 1e-2, np.float32), np.full((SLOTS, FACTORS), 1e-2, np.float32), 1e-2
    rounds = max(epochs, int(np.ceil(600 * 64 / len(labels))))  # at least 600 steps
    for _ in range(min(rounds, 200)):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            slots, values = (np.concatenate(x) for x in zip(*(rows[i] for i in batch)))
            lengths = np.array([len(rows[i][0]) for i in batch])
            starts = np.cumsum(lengths) - lengths
            x = v[slots] * values[:, None]
            sums = np.add.reduceat(x, starts)
            squares = np.add.reduceat(x * x, starts)
            margin = model.bias + np.add.reduceat(w[slots] * values, starts) + 0.5 * (sums**2 - squares).sum(axis=1)
            error = (sigmoid(margin) - labels[batch]).astype(np.float32)
            each = np.repeat(error, lengths)
            different, inverse = np.unique(slots, return_inverse=True)
            dw = np.bincount(inverse, each * values, len(different)).astype(np.float32) + decay * w[different]
            per = (each * values)[:, None] * (np.repeat(sums, lengths, axis=0) - x)
            dv = np.stack([np.bincount(inverse, per[:, f], len(different)) for f in range(FACTORS)], axis=1).astype(np.float32) + decay * v[different]
            gw[different] += dw**2
            gv[different] += dv**2
            w[different] -= rate * dw / np.sqrt(gw[different])
            v[different] -= rate * dv / np.sqrt(gv[different])
            db = float(error.sum())
            gb += db**2
            model.bias -= rate * db / np.sqrt(gb)
    return model


def held_out(id_col) -> F.Column:
    """True for the rows whose labels are never learnt."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = (), train_rows: int = TRAIN_ROWS) -> Model:
    """A model from at most train_rows labelled rows that are not held out."""
    usable = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    sample = usable.orderBy(F.xxhash64("id"), "label").limit(train_rows)  # a bounded table, so it may be sent to every task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, tuple(m)) for t, m in zip(batch.column("text").to_pylist(), batch.column("meta").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([s.astype(np.int32).tobytes() for s, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], names=["label", "slots", "vals"]
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for label, slots, values in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                rows.append((label, np.frombuffer(slots.as_buffer(), np.int32), np.frombuffer(values.as_buffer(), np.float32)))
        rows.sort(key=lambda r: (r[0], len(r[1]), zlib.crc32(r[1]), zlib.crc32(r[2])))  # rows come in any order
        model = fit([(s, v) for _, s, v in rows], np.array([label for label, _, _ in rows], np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([model.linear.tobytes()], pa.binary()), pa.array([model.factors.tobytes()], pa.binary())], names=["bias", "linear", "factors"])

    # train_rows at most meet in one task, which alone has them all; the driver gets the model
    joined = _inputs(docs, id_col, text_col, meta_cols).join(F.broadcast(sample), "id").select("label", "text", "meta")
    found = joined.mapInArrow(run, "label int, slots binary, vals binary").repartition(1).mapInArrow(learn, "bias double, linear binary, factors binary").first()
    if found is None:  # an empty table has no task
        return fit([], np.zeros(0))
    return Model(found.bias, np.frombuffer(found.linear, np.float32), np.frombuffer(found.factors, np.float32).reshape(SLOTS, FACTORS))


def _inputs(docs: DataFrame, id_col: str, text_col: str, meta_cols: tuple[str, ...]) -> DataFrame:
    meta = F.array(*[F.concat(F.lit(c + "="), F.coalesce(docs[c].cast("string"), F.lit(""))) for c in meta_cols]).cast("array<string>")
    return docs.select(docs[id_col].cast("long").alias("id"), text_or_empty(docs, text_col).alias("text"), meta.alias("meta"))


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", meta_cols: tuple[str, ...] = (), score_col: str = "score") -> DataFrame:
    """docs with one more column, the score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def score(texts, meta):
        out = []
        for at in range(0, len(texts), 256):
            found = [features(t, tuple(m)) for t, m in zip(texts[at : at + 256], meta[at : at + 256])]
            slots, values = (np.concatenate(x) for x in zip(*found))
            lengths = np.array([len(s) for s, _ in found])
            out.append(sigmoid(shared.value.margins(slots, values, np.cumsum(lengths) - lengths)))
        import pandas as pd

        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    meta = F.array(*[F.concat(F.lit(c + "="), F.coalesce(docs[c].cast("string"), F.lit(""))) for c in meta_cols]).cast("array<string>")
    return docs.withColumn(score_col, score(text_or_empty(docs, text_col), meta))

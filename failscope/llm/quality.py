"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after the other, fits a shallow tree to the residuals over that
feature's bins, and adds a small step of it to the feature's lookup table. With the main effects
done, the pairs of features whose residuals a coarse grid explains best are boosted likewise, with
trees of two cuts on each of two axes. A document's score is the logistic function of the sum of
the looked-up values: vectorised bin additions.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.llm.common import table

#: Labelled rows that the model is fitted on, at most: those of the smallest hashes.
SAMPLE_ROWS = 20_000
#: Documents at or above this score are accepted.
ACCEPT = 0.3
#: Of so many parts of the labels by checksum of the doc_id, part 0 is held out.
FOLDS = 5

FEATURES = (
    "log_bytes", "log_words", "upper_share", "digit_share", "symbol_share", "bang_share", "pipe_share", "punct_share", "mean_word", "distinct_words",
    "plain_words", "symbol_words", "caps_words", "one_char_words", "top_words", "echo_words", "repeated_lines", "words_a_line", "worst_line", "packed", "worst_piece",
)

#: Bytes of the pieces whose worst compression counts; a last piece of less than half goes uncounted where there are others.
PIECE = 2048
#: Classes of bytes: white space, line feed, capital, small letter (and all beyond ASCII), digit, punctuation, symbol.
_CLASS = bytearray(b"s" * 256)
for _chars, _name in ((bytes(range(65, 91)), "U"), (bytes(range(97, 123)) + bytes(range(128, 256)), "l"), (b"0123456789", "d"), (b".,;:?'\"()-", "p"), (b" \t\x0b\x0c\r", " "), (b"\n", "\n")):
    for _c in _chars:
        _CLASS[_c] = ord(_name)
_CLASS = bytes(_CLASS)


def text_features(text: str) -> list[float]:
    """The values of ``FEATURES`` for a whole text. Neither ids, labels, language nor source count."""
    data = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        return [float(np.log1p(len(data)))] + [0.0] * (len(FEATURES) - 1)
    n, size = len(words), len(data)
    kinds = data.translate(_CLASS)
    lines = [x for x in text.split("\n") if x]
    rows = [x + b" " for x in kinds.split(b"\n") if x]
    # a space before and after each word, so that patterns of neighbours don't overlap
    flat = b"  " + kinds.replace(b"\n", b" ").replace(b" ", b"  ") + b"  "
    upper, lower = kinds.count(b"U"), kinds.count(b"l")
    ends = [(x.count(b"s "), x.count(b" ")) for x in rows]
    counts = Counter(words)
    packed = len(zlib.compress(data, 1)) / size
    return [
        float(np.log1p(size)), float(np.log1p(n)), upper / max(1, upper + lower), kinds.count(b"d") / size, kinds.count(b"s") / size, data.count(b"!") / size, data.count(b"|") / size, kinds.count(b"p") / size,
        (size - n) / n, len(counts) / n, (flat.count(b"l ") + flat.count(b"U ")) / n, flat.count(b"s ") / n, flat.count(b" UU") / n, (flat.count(b" l ") + flat.count(b" U ") + flat.count(b" s ")) / n,
        sum(heapq.nlargest(8, counts.values())) / n, sum(map(eq, words, words[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))),
        max((s / w for s, w in ends if w >= 3), default=0.0), packed, max(len(zlib.compress(data[i : i + PIECE], 1)) / len(data[i : i + PIECE]) for i in range(0, max(1, size - PIECE // 2), PIECE)),
    ]


@dataclass
class AdditiveModel:
    """Bin edges of the features, a lookup table for each, and one for each chosen pair."""

    start: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        b = self.bins(x) if self.edges else []
        for f, values in enumerate(self.tables):
            total += values[b[f]]
        for i, j, values in self.pairs:
            total += values[b[i], b[j]]
        return 1 / (1 + np.exp(-total))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, last bin on the left) of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    lg, lh = np.cumsum(g), np.cumsum(h)
    gain = lg**2 / (lh + 1) + (lg[-1] - lg) ** 2 / (lh[-1] - lh + 1) - lg[-1] ** 2 / (lh[-1] + 1)
    k = int(np.argmax(gain[:-1]))
    return float(gain[k]), k


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Value of each bin under a tree of up to ``leaves`` leaves, grown best gain first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gains = [(*_best_cut(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, k, a, b = max(gains)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + k + 1), (a + k + 1, b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _shallow_pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """As :func:`_shallow_tree` on a grid: one cut of the rows, then one of the columns on each side."""
    best = (-1.0, None)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        gain, k = _best_cut(gg.sum(1), hh.sum(1))
        out = np.zeros_like(gg)
        for side in (slice(0, k + 1), slice(k + 1, None)):
            more, c = _best_cut(gg[side].sum(0), hh[side].sum(0))
            gain += more
            for part in (slice(0, c + 1), slice(c + 1, None)):
                out[side, part] = gg[side, part].sum() / (hh[side, part].sum() + 1)
        if gain > best[0]:
            best = (gain, out.T if flip else out)
    return best[1]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 6, max_bins: int = 32, rate: float = 0.1) -> AdditiveModel:
    """Cyclic boosting of main effects, then of the ``n_pairs`` strongest pairs."""
    mean = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(mean / (1 - mean))))
    if len(y) < 20 or y.min() == y.max():
        return model
    n_features = x.shape[1]
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, max_bins + 1)[1:-1])) for f in range(n_features)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b = model.bins(x)
    total = np.full(len(y), model.start)
    for _ in range(rounds):
        for f in range(n_features):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[f])
            step = rate * _shallow_tree(np.bincount(b[f], y - p, size), np.bincount(b[f], p * (1 - p), size))
            model.tables[f] += step
            total += step[b[f]]
    p = 1 / (1 + np.exp(-total))
    strength = []
    for i in range(n_features):
        for j in range(i + 1, n_features):
            si, sj = len(model.tables[i]), len(model.tables[j])
            cell = b[i] * 8 // si * 8 + b[j] * 8 // sj
            g, h = np.bincount(cell, y - p, 64), np.bincount(cell, p * (1 - p), 64)
            strength.append((float((g**2 / (h + 1)).sum()), i, j))
    chosen = sorted(strength, reverse=True)[:n_pairs]
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for _, i, j in chosen]
    for _ in range(pair_rounds):
        for i, j, values in model.pairs:
            p = 1 / (1 + np.exp(-total))
            cell, size = b[i] * values.shape[1] + b[j], values.size
            g = np.bincount(cell, y - p, size).reshape(values.shape)
            h = np.bincount(cell, p * (1 - p), size).reshape(values.shape)
            step = rate * _shallow_pair_tree(g, h)
            values += step
            total += step[b[i], b[j]]
    return model


def _feature_rows(batches):
    for batch in batches:
        texts = batch.column("text")
        rows = [text_features(t) for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()]
        flat = pa.array(np.array(rows, dtype=np.float64).reshape(-1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "x"])


def _score_rows(batches, model: AdditiveModel):
    for batch in _feature_rows(batches):
        lists = batch.column("x")
        x = lists.flatten().to_numpy().reshape(len(lists), len(FEATURES))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x))], names=[*batch.schema.names[:-1], "score"])


def fold(col: str = "doc_id"):
    """Remainder of the checksum of the doc_id as text; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> AdditiveModel:
    """Fits the model on the labelled documents that aren't held out, ``sample_rows`` at most.

    Labels: doc_id, quality; rows with a null in either are left out, and a doc_id that has several
    labels takes their majority, 1 in a tie. The sample is the rows of the smallest hashes of doc_id. A doc_id
    that stands on several rows of ``docs`` is learnt once, from the least of their feature rows.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold() != 0))
    usable = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    sample = usable.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample_rows)
    kind = labels.schema["doc_id"].dataType.simpleString()
    known = docs.sparkSession.createDataFrame(sample.collect(), f"of_id {kind}, y double")  # sample_rows at most
    chosen = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(known), F.col("id") == F.col("of_id"))
    rows = chosen.select("of_id", "y", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_feature_rows, f"of_id {kind}, y double, x array<double>")
    got = rows.groupBy("of_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toArrow()  # a row a label, however often its doc_id stands in docs
    ids = got["of_id"].to_pylist()
    order = sorted(range(len(ids)), key=ids.__getitem__)
    x = np.array(got["x"].to_pylist(), dtype=np.float64).reshape(len(ids), len(FEATURES))
    return fit(x[order], got["y"].to_numpy()[order])


def quality_scores(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    Null texts count as empty; empty texts are scored like all others. A null doc_id is held out.
    Without labels, or with labels of one value, every score is the smoothed share of label 1.
    Repeated rows stay; no rows give no rows. Columns other than doc_id and text are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scored = plain.mapInArrow(lambda it: _score_rows(it, model), f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def _accept(batches, model: AdditiveModel):
    for batch in batches:
        texts = batch.column("text")
        rows = [text_features(t or "") for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()]
        yield batch.filter(pa.array(model.score(np.array(rows).reshape(len(rows), len(FEATURES))) >= ACCEPT))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier accepts."""
    model = train(docs, labels)
    return docs.mapInArrow(lambda it: _accept(it, model), docs.schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))

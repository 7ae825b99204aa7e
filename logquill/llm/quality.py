"""Quality classifier: a generalised additive model with pairwise interactions.

A bounded sample of labelled rows (the smallest digests of doc_id, SAMPLE rows at most) trains the
model from features of their whole texts: feature by feature in a cycle, a
shallow tree over the feature's bins is boosted onto the feature's lookup table; then the pairs with
the largest gain get tables in the same way. Scoring
computes each text's features once and adds one table entry for each feature and pair, in vectors.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquill.llm.common import slices, stored

#: Labelled rows that train the model, at most.
SAMPLE = 20000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, L2 = 120, 40, 0.15, 5.0
FEATURES = (
    "chars", "words", "word_length", "long_words", "distinct_words", "top_word", "repeated_next",
    "upper", "digits", "marks", "odd_marks", "bars", "exclamations", "spaces", "full_stops",
    "lines", "distinct_lines", "line_words", "shouted_words", "marked_words", "distinct_triples", "capital_starts",
)
_ODD = "#$%&*@^~<>{}[]\\=+_`"
_ODD_OUT, _BARS_OUT = str.maketrans("", "", _ODD), str.maketrans("", "", "|")
_MARKS_OUT = str.maketrans("", "", "!\"'(),-./:;?" + _ODD + "|")
_DIGITS_OUT, _UPPER_OUT = str.maketrans("", "", "0123456789"), str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÓÍÁÀ")


def text_features(text: str) -> list[float]:
    """FEATURES of a text; all are 0 for an empty one except those that are shares of nothing (0)."""
    n, words = len(text), text.split()
    w, counts = len(words), Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    per_char, per_word = 1 / max(n, 1), 1 / max(w, 1)
    triples = set(zip(words, words[1:], words[2:], strict=False))
    return [
        np.log1p(n), np.log1p(w), sum(map(len, words)) * per_word, sum(c for x, c in counts.items() if len(x) > 14) * per_word,
        len(counts) * per_word, max(counts.values(), default=0) * per_word, sum(map(str.__eq__, words, words[1:])) * per_word,
        (n - len(text.translate(_UPPER_OUT))) * per_char, (n - len(text.translate(_DIGITS_OUT))) * per_char,
        (n - len(text.translate(_MARKS_OUT))) * per_char, (n - len(text.translate(_ODD_OUT))) * per_char,
        text.count("|") * per_word, text.count("!") * per_word, (n - sum(map(len, words))) * per_char, text.count(".") * per_word,
        np.log1p(len(lines)), len(set(lines)) / max(len(lines), 1), w / max(len(lines), 1),
        sum(c for x, c in counts.items() if x.isupper() and len(x) > 2) * per_word,
        sum(c for x, c in counts.items() if x[-1] in _ODD) * per_word, len(triples) / max(w - 2, 1),
        sum(c for x, c in counts.items() if x[0].isupper()) * per_word,
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and features (array<double>) of each row of docs. A null text counts as empty."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [text_features(t or "") for t in batch["text"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(compute, "doc_id long, features array<double>")


def held_out(doc_id="doc_id"):
    """Rows whose label is never learned: crc32 of doc_id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """base, tables and interaction tables over bins cut at edges."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, total = self.bins(x), np.full(len(x), self.base)
        for table, b in zip(self.tables, bins, strict=True):
            total += table[b]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse(bins[i], len(self.edges[i])), coarse(bins[j], len(self.edges[j]))]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def coarse(bins: np.ndarray, edges: int) -> np.ndarray:
    return bins * PAIR_BINS // (edges + 1)


def _value(g, h):
    return g / (h + L2)


def _gain(g, h):
    return g * g / (h + L2)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Value by bin of a tree of up to three leaves on ordered bins: the best cut, then the best one
    inside a side."""

    def cut(a: int, b: int) -> tuple[float, int]:
        gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        gains = _gain(gs[:-1], hs[:-1]) + _gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1]) - _gain(gs[-1], hs[-1])
        k = int(np.argmax(gains)) if len(gains) else 0
        return (float(gains[k]), a + k + 1) if len(gains) and gains[k] > 1e-9 else (0.0, 0)

    bounds = [0, len(g)]
    for _ in range(2):
        gain, at = max((cut(a, b) for a, b in itertools.pairwise(bounds)), default=(0.0, 0))
        if not at:
            break
        bounds = sorted([*bounds, at])
    out = np.zeros(len(g))
    for a, b in itertools.pairwise(bounds):
        out[a:b] = _value(g[a:b].sum(), h[a:b].sum())
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and table of the best pair of cuts, one on each feature, by two-way cumulative sums."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = lambda s: (s[:-1, :-1], s[:-1, -1:] - s[:-1, :-1], s[-1:, :-1] - s[:-1, :-1], s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + s[:-1, :-1])
    four = list(zip(parts(gs), parts(hs), strict=True))
    gains = sum(_gain(a, b) for a, b in four)
    r, c = np.unravel_index(int(np.argmax(gains)), gains.shape)
    table = np.empty_like(g)
    for (rows, cols), (a, b) in zip(itertools.product((slice(0, r + 1), slice(r + 1, None)), (slice(0, c + 1), slice(c + 1, None))), four, strict=True):
        table[rows, cols] = _value(a[r, c], b[r, c])
    return float(gains[r, c]), table


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of features x and labels y (0 or 1). With no rows it gives 0.5; with one label
    only, that label's smoothed share."""
    edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) if len(x) else np.empty(0) for c in x.T]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    if len(np.unique(y)) < 2:
        return model
    bins, total = model.bins(x), np.full(len(x), model.base)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = (np.bincount(b, v, len(edges[j]) + 1) for v in residuals())
            step = RATE * shallow_tree(g, h)
            model.tables[j] += step
            total += step[b]
    wide = [coarse(b, len(e)) for b, e in zip(bins, edges, strict=True)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(wide[i] * PAIR_BINS + wide[j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    g, h = residuals()
    gains = {(i, j): quadrants(grid(i, j, g), grid(i, j, h))[0] for i, j in itertools.combinations(range(len(bins)), 2)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = residuals()
            step = RATE * quadrants(grid(i, j, g), grid(i, j, h))[1]
            model.pair_tables[k] += step
            total += step[wide[i], wide[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the rows of docs that labels (doc_id, quality) marks, held-out rows left out; only
    their features are computed. Null ids and labels don't count; of several labels, or of several
    rows, of a document the smallest does."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = stored(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "chosen")  # of ids and labels only
    features = with_features(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))  # `sample` ids at most
    rows = features.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("features").alias("features")).orderBy("doc_id").toArrow()
    x = np.array(rows["features"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, rows["quality"].to_numpy().astype(float))


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    return model.score(np.array([text_features(t or "") for t in texts], dtype=float).reshape(-1, len(FEATURES)))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text), as labels.quality marks.

    Only text enters a score. Null texts are empty ones, null ids are scored and count as not held
    out, repeated rows are scored each, texts of any length whole; without any label every score is
    0.5; an empty table gives an empty result; other columns are not read."""
    model = train(docs, labels, sample)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch([batch["doc_id"], batch["held_out"], pa.array(scores(batch["text"].to_pylist(), model))], names=["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(add, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns."""
    model = train(docs, labels, sample)

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(scores(batch["text"].to_pylist(), model) >= 0.5))

    return docs.mapInArrow(accept, docs.schema).select(docs.columns)

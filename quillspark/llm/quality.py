"""A quality classifier: a generalised additive model with pairwise interactions, boosted in cycles.

Every text becomes a few counts and shares. Each feature is cut into bins; the model is a lookup table per feature and one
per pair of features, and a text's score is the sum of the entries its bins point at. Tables are learned by cyclic
boosting: in every round each feature in turn gets a shallow tree on the residuals, which is a step function over its
bins and so adds to its table; pairs that explain most of what is left then get two-dimensional trees in
the same way. Counting, fitting and scoring see the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, is_space, span_hashes

FEATURES = (
    "words",  # log of their number
    "word_length",  # code points a word
    "distinct",  # share of the words that are distinct
    "distinct_threes",  # the same for runs of three words
    "commonest",  # share of the most frequent word
    "capitals",  # of the letters
    "marked",  # symbols, of the code points
    "stops",  # . ! ? of the code points
    "shouts",  # !
    "digits",
    "spaces",
    "lines",  # log of the words a line
    "repeated_lines",  # share of the lines that are copies of others in the text
    "bare",  # share of the words without any letter
    "odd_ends",  # share of the words that end on a symbol
)
BINS, COARSE, PAIRS = 48, 12, 8  #: bins a feature, bins a feature in a pair, pairs
ROUNDS, RATE, RIDGE = 300, 0.08, 2.0
SAMPLE = 20_000  #: labelled documents that a fit uses about, by hash of doc_id
THRESHOLD = 0.7

# classes of code points below 0x500; higher ones count as letters where Python says so
_LIMIT = 0x500
_CHARS = [chr(i) for i in range(_LIMIT)]
_UPPER = np.array([c.isupper() for c in _CHARS] + [False])
_LETTER = np.array([c.isalpha() for c in _CHARS] + [True])
_DIGIT = np.array([c.isdigit() for c in _CHARS] + [False])
_SYMBOL = np.array([c in "#$%&*|<>{}[]~^\\=+_@/" for c in _CHARS] + [False])


def _shares(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    return n / np.maximum(of, 1)


def _distinct(codes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct codes each text has, and how often its commonest occurs."""
    if not len(codes):
        return np.zeros(texts), np.zeros(texts)
    order = np.lexsort((codes, owner))
    c, o = codes[order], owner[order]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (o[1:] != o[:-1])])
    first = np.flatnonzero(new)
    most = np.zeros(texts)
    np.maximum.at(most, o[first], np.diff(np.concatenate([first, [len(c)]])))
    return np.bincount(o[first], minlength=texts).astype(float), most


def features(texts: Sequence[str | None]) -> np.ndarray:
    """A row of FEATURES for each text; null counts as empty. Words are split at the six white-space characters of common.SPACES."""
    held = [t or "" for t in texts]
    n = len(held)
    ends = np.cumsum([len(t) + 1 for t in held], dtype=np.int64)
    points = np.frombuffer("\n".join([*held, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.minimum(points, _LIMIT)
    owner = np.repeat(np.arange(n), np.diff(np.concatenate([[0], ends])))
    size = np.diff(np.concatenate([[0], ends])) - 1.0
    count = lambda which: np.bincount(owner[which], minlength=n).astype(float)
    space = (points < 128) & is_space(np.minimum(points, 127).astype(np.uint8))
    letters = count(_LETTER[at])
    capitals, symbol = count(_UPPER[at]), _SYMBOL[at]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    first, last = edge[0::2], edge[1::2]
    whose = owner[first] if len(first) else np.zeros(0, np.int64)
    words = np.bincount(whose, minlength=n).astype(float)
    raw = points.view(np.uint8)
    codes = span_hashes(raw, first * 4, last * 4)
    distinct, most = _distinct(codes, whose, n)
    together = np.flatnonzero(whose[2:] == whose[:-2]) if len(whose) > 2 else np.zeros(0, np.int64)
    step = np.uint64(0x9E3779B97F4A7C15)
    threes = (codes[together] * step + codes[together + 1]) * step + codes[together + 2] if len(together) else np.zeros(0, np.uint64)
    distinct_threes, _ = _distinct(threes, whose[together], n)
    runs = np.bincount(whose[together], minlength=n)
    ink = np.concatenate([[0], np.cumsum(_LETTER[at])])
    bare = np.bincount(whose[ink[last] == ink[first]], minlength=n)
    odd = np.bincount(whose[symbol[last - 1]], minlength=n) if len(last) else np.zeros(n)
    # lines that aren't empty
    breaks = np.flatnonzero(points == 10)
    start = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else np.zeros(0, np.int64)
    full = breaks > start
    line_owner = owner[start[full]] if len(breaks) else np.zeros(0, np.int64)
    lines = np.bincount(line_owner, minlength=n).astype(float)
    distinct_lines, _ = _distinct(span_hashes(raw, start[full] * 4, breaks[full] * 4), line_owner, n) if full.any() else (np.zeros(n), None)
    spaces = count(space) - 1.0  # without the line end put after each text
    table = {
        "words": np.log1p(words),
        "word_length": _shares(size - spaces, words),
        "distinct": _shares(distinct, words),
        "distinct_threes": np.where(runs > 0, _shares(distinct_threes, runs), 1.0),
        "commonest": _shares(most, words),
        "capitals": _shares(capitals, letters),
        "marked": _shares(count(symbol), size),
        "stops": _shares(count(np.isin(points, [33, 46, 63])), size),
        "shouts": _shares(count(points == 33), size),
        "digits": _shares(count(_DIGIT[at]), size),
        "spaces": _shares(spaces, size),
        "lines": np.log1p(_shares(words, lines)),
        "repeated_lines": _shares(lines - distinct_lines, lines),
        "bare": _shares(bare, words),
        "odd_ends": _shares(odd, words),
    }
    return np.stack([table[f] for f in FEATURES], axis=1)


@dataclass
class Model:
    """Lookup tables of a fitted model. edges[f]: where feature f's bins end; coarse[f]: the same for its bins in pairs."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """One sum of table entries per row of features."""
        out = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, f], side="right")]
        near = {f: np.searchsorted(self.coarse[f], x[:, f], side="right") for f in {f for p in self.pairs for f in p}}
        for (a, b), table in zip(self.pairs, self.pair_tables):
            out += table[near[a], near[b]]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Bin ends between distinct values, as near to equal counts as values that repeat allow."""
    known = np.unique(values)
    if len(known) <= 1:
        return np.zeros(0)
    if len(known) <= bins:
        return (known[1:] + known[:-1]) / 2
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="midpoint"))


def _worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What a leaf with gradient sums g and curvature sums h takes off the loss."""
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best cut of a row of bins in two: its gain, and how many bins go to the left (0: none gains)."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gain = _worth(left_g, left_h) + _worth(g.sum() - left_g, h.sum() - left_h) - _worth(g.sum(), h.sum())
    k = int(gain.argmax())
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A step over the bins, of at most 2^depth leaves: each leaf's value is its Newton step."""
    gain, k = _cut(g, h) if depth else (0.0, 0)
    if not k:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate([shallow_tree(g[:k], h[:k], depth - 1), shallow_tree(g[k:], h[k:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree of two levels over a grid: a cut along one axis, then each side cut along the other. Its gain and its values."""
    best, found = 0.0, np.full(g.shape, g.sum() / (h.sum() + RIDGE))
    whole = _worth(g.sum(), h.sum())
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        left_g, left_h = np.cumsum(a, 0)[:-1], np.cumsum(b, 0)[:-1]  # sums of the first rows, by column
        for k in range(len(left_g)):
            sides = [(left_g[k], left_h[k]), (a.sum(0) - left_g[k], b.sum(0) - left_h[k])]
            cuts = [_cut(*s) for s in sides]
            gain = sum(_worth(s[0].sum(), s[1].sum()) + c[0] for s, c in zip(sides, cuts)) - whole
            if gain > best + 1e-9:
                rows = [np.concatenate([np.full(c, s[0][:c].sum() / (s[1][:c].sum() + RIDGE)) if c else np.zeros(0), np.full(len(s[0]) - c, s[0][c:].sum() / (s[1][c:].sum() + RIDGE))]) for s, (_, c) in zip(sides, cuts)]
                made = np.concatenate([np.tile(rows[0], (k + 1, 1)), np.tile(rows[1], (len(a) - k - 1, 1))])
                best, found = gain, made.T if turned else made
    return best, found


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, bins: int = BINS, coarse: int = COARSE) -> Model:
    """x: a row of features for each document; y: 0 or 1. With one label alone every text scores as it."""
    n, width = x.shape if x.ndim == 2 else (0, len(FEATURES))
    edges = [cut_points(x[:, f], bins) if n else np.zeros(0) for f in range(width)]
    rough = [cut_points(x[:, f], coarse) if n else np.zeros(0) for f in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    mean = float(np.mean(y)) if n else 1.0
    if mean in (0.0, 1.0):
        return Model(10.0 if mean else -10.0, edges, tables, rough, [], [])
    base = float(np.log(mean / (1 - mean)))
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    near = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(rough)]
    logit = np.full(n, base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            g, h = slopes()
            size = len(tables[f])
            step = RATE * shallow_tree(np.bincount(at[f], g, size), np.bincount(at[f], h, size))
            tables[f] += step
            logit += step[at[f]]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(rough[a]) + 1, len(rough[b]) + 1)
        code = near[a] * shape[1] + near[b]
        g, h = slopes()
        return np.bincount(code, g, shape[0] * shape[1]).reshape(shape), np.bincount(code, h, shape[0] * shape[1]).reshape(shape)

    rated = sorted(((pair_tree(*grid(a, b))[0], (a, b)) for a, b in combinations(range(width), 2)), key=lambda r: (-r[0], r[1]))
    chosen = [p for gain, p in rated[:pairs] if gain > 0]
    pair_tables = [np.zeros((len(rough[a]) + 1, len(rough[b]) + 1)) for a, b in chosen]
    for _ in range(rounds // 4):
        for (a, b), table in zip(chosen, pair_tables):
            step = RATE * pair_tree(*grid(a, b))[1]
            table += step
            logit += step[near[a], near[b]]
    for f, table in enumerate(tables):  # what a table adds to every text belongs to the base
        middle = float(table[at[f]].mean())
        table -= middle
        base += middle
    for (a, b), table in zip(chosen, pair_tables):
        middle = float(table[near[a], near[b]].mean())
        table -= middle
        base += middle
    return Model(base, edges, tables, rough, chosen, pair_tables)


def held_out(name: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(name).cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def _measured(extra: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [features(list(b["text"][s])) for s in in_chunks(b["text"].to_list())]
            yield pd.DataFrame({"x": list(np.concatenate(x)) if x else [], extra: b[extra]})

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fit on about `most` labelled documents that aren't held out: all where there are fewer, else those whose hash of doc_id is below that share.

    Null labels and ids are left out; a document with several labels counts as good if none of them is 0. Documents
    without a label, and labels without a document, have no part in it. The sample's texts are measured where they lie; one short row of numbers a document comes to the driver.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out())
    n = known.count()
    if n > most:
        draw = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
        known = known.where(draw < int((1 << 32) * most / n))
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # about `most` ids
    rows = sample.select("text", "quality").mapInPandas(_measured("quality"), "x array<double>, quality int").toPandas()
    if not len(rows):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(rows["x"].to_numpy()), (rows["quality"].to_numpy() == 1).astype(float)
    order = np.lexsort((y, *x.T))  # the same model whatever the order of the rows
    return fit(x[order], y[order])


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from the threshold on).

    Empty and null texts score by the first bins of their features. The text alone is read; extra columns, labels included, have
    no effect. Repeated rows and null ids stay and score as any other; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].to_list()
            p = np.concatenate([np.zeros(0), *(model.probability(features(texts[s])) for s in in_chunks(texts))])
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": p, "predicted": (p >= threshold).astype(np.int32)})

    scored = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")

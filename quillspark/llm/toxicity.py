"""Toxicity by a subsequence string kernel and a support vector machine with Nystrom landmarks.

The kernel of two words counts their common subsequences of three letters, each occurrence weighted by
DECAY to the power of its span, so letters put between or left out of an insult lower the similarity
gently. Landmarks are words of the training sentences; the Nystrom map K_LL^(-1/2) k(L, word) feeds a
linear machine. Training is by sentences: all sentences of clean documents are negative; of a toxic
document the sentence that scores highest is positive, as are sentences with a word that toxic sentences
have far more often; their best words are the witnesses, and fitting repeats until the choice settles. Because the kernel is a dot product of subsequence weights, landmarks and
machine fold into one weight per subsequence and a word's score is a short sum.

A document scores as its best word; a logistic curve fitted on the training documents turns that into
a probability. Letters are lower-cased and lose accents; other characters inside a word are left out,
and runs of single letters are also read as one word.
"""

from __future__ import annotations

import os
import pickle
import re
import subprocess
import sys
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_chunks

LENGTH, DECAY = 3, 0.7
ALPHABET = 32  #: a to z are 1 to 26, any other letter 27
WINDOW, STEP = 24, 12  #: longer words are read in overlapping windows
POSITIVES, NEGATIVES = 1500, 3000  #: labelled documents used at most, by smallest hash of doc_id
LANDMARKS, BACKGROUND = 160, 64
TELLING = 5.0  #: standard errors by which a word's share of toxic sentences exceeds its share of clean ones
RARER = 0.2  #: share of clean sentences over share of toxic ones that a witness may have
BENT = 0.5  #: cost of a bent witness in costs of the witness
SPREAD, HARD = 8_000, 8_000  #: defaults of fit(): clean words of the sample that a turn sees, some of all and those that score highest
_SENTENCE = re.compile(r"[.!?\n]+(?:\s+|$)")
_SPELLED = re.compile(r"(?<!\S)[^\W\d_](?:[\s.\-_*]+[^\W\d_]){2,}(?!\S)")
_PARTS = re.compile(r"[^\W\d_]+")


def letters(token: str) -> str:
    """Lower-case letters without accents."""
    t = token.lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return t if t.isalpha() else "".join(c for c in t if c.isalpha())


def readings(token: str) -> list[str]:
    """The words that a white-space token may stand for, each at most WINDOW letters."""
    whole = letters(token)
    found = {whole}
    if not token.isalpha():
        found.update(letters(p) for p in _PARTS.findall(token))
    return [w[i : i + WINDOW] for w in found for i in range(0, max(1, len(w) - WINDOW + STEP), STEP) if len(w) >= LENGTH]


def tokens_of(text: str) -> list[str]:
    """White-space tokens, and runs of single letters put together."""
    low = text.lower()
    return low.split() + ["".join(c for c in m if c.isalpha()) for m in _SPELLED.findall(low)]


_positions: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _subsequences(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _positions:
        at = np.array(list(combinations(range(n), LENGTH)))
        _positions[n] = at, (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)
    return _positions[n]


def by_length(words: Sequence[str], most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of words of one length: their indices, subsequence codes and normalised weights, codes sorted with equal ones summed into the first."""
    sizes = np.array([len(w) for w in words], np.int64)
    for n in np.unique(sizes):
        if n < LENGTH:
            continue
        at, weight = _subsequences(int(n))
        index = np.flatnonzero(sizes == n)
        for part in np.array_split(index, -(-len(index) * len(at) // most)):
            chars = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), np.uint32).reshape(len(part), n)
            code = np.where((chars >= 97) & (chars <= 122), chars - 96, 27).astype(np.int32)
            codes = (code[:, at[:, 0]] * ALPHABET + code[:, at[:, 1]]) * ALPHABET + code[:, at[:, 2]]
            order = np.argsort(codes, axis=1, kind="stable")
            codes = np.take_along_axis(codes, order, 1)
            new = np.ones(codes.shape, bool)
            new[:, 1:] = codes[:, 1:] != codes[:, :-1]
            first = np.flatnonzero(new)
            summed = np.zeros(codes.size, np.float32)
            summed[first] = np.add.reduceat(weight[order].ravel(), first)
            summed = summed.reshape(codes.shape)
            yield part, codes, summed / np.sqrt((summed * summed).sum(1, keepdims=True))


def word_scores(words: Sequence[str], weights: np.ndarray) -> np.ndarray:
    """weights: one for each subsequence code."""
    out = np.zeros(len(words))
    for part, codes, value in by_length(words):
        out[part] = (weights[codes] * value).sum(1)
    return out


def profiles(words: Sequence[str]) -> np.ndarray:
    """Dense normalised subsequence weights of a bounded number of words."""
    out = np.zeros((len(words), ALPHABET**LENGTH), np.float32)
    for part, codes, value in by_length(words):
        np.add.at(out, (part[:, None], codes), value)
    return out


def kernel(words: Sequence[str], landmark_profiles: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), len(landmark_profiles)), np.float32)
    table = np.ascontiguousarray(landmark_profiles.T)
    for part, codes, value in by_length(words, 20_000):
        out[part] = np.einsum("nt,ntm->nm", value, table[codes])
    return out


def _choose(ranked: Sequence[str], most: int, alike: float = 0.85) -> list[str]:
    """The first words of ranked that aren't much like one chosen before."""
    chosen: list[str] = []
    rows = np.zeros((most, ALPHABET**LENGTH), np.float32)
    for w in ranked:
        if len(chosen) == most:
            break
        p = profiles([w])[0]
        if not chosen or (rows[: len(chosen)] @ p).max() < alike:
            rows[len(chosen)] = p
            chosen.append(w)
    return chosen


def _machine(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps on the active rows."""
    n = x.shape[1] + 1
    w = np.zeros(n)
    pull = np.eye(n) * ridge
    pull[-1, -1] = 1e-6
    active = np.ones(len(y), bool)
    for _ in range(30):
        gram, moment = pull.copy(), np.zeros(n)
        for part in np.array_split(np.flatnonzero(active), 16):
            a = np.concatenate([x[part], np.ones((len(part), 1))], 1)
            weighted = a * c[part][:, None]
            gram += weighted.T @ a
            moment += weighted.T @ y[part]
        w = np.linalg.solve(gram, moment)
        now = y * (x @ w[:-1] + w[-1]) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


@dataclass
class Model:
    weights: np.ndarray  #: per subsequence code
    bias: float
    slope: float
    offset: float

    def raw(self, words: Sequence[str]) -> np.ndarray:
        return word_scores(words, self.weights) + self.bias

    def probability(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1.

    Where a gap parts nearly all documents of the two labels the curve's middle is the gap's middle, so that
    insults bent a little out of shape still fall on their side; else it is the likeliest curve.
    """
    low, high = np.quantile(x[y == 0], 0.999), np.quantile(x[y == 1], 0.02)
    if low < high:
        slope = 8 / (high - low)
        return float(slope), float(-slope * (low + high) / 2)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = c * (p - y), c * p * (1 - p) + 1e-9
        hess = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * x).sum() + 1e-2 * a, g.sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def bent(word: str, rng: np.random.Generator) -> list[str]:
    """The word with a letter put in, one and two doubled and, where it is long, one left out."""
    at = rng.integers(1, len(word), 4)
    more = [word[:i] + chr(97 + rng.integers(26)) + word[i:] for i in at[:2]] + [word[: at[2]] + word[at[2] - 1] + word[at[2] :]]
    i, j = np.sort(rng.choice(np.arange(1, len(word) + 1), 2, replace=False))
    more.append(word[:i] + word[i - 1] + word[i:j] + word[j - 1] + word[j:])
    return more + [word[: at[3]] + word[at[3] + 1 :]] * (len(word) > 5)


def fit(texts: Sequence[str], labels: Sequence[int], shares: tuple[float, float] = (1.0, 1.0), turns: int = 4, spread: int = SPREAD, hard: int = HARD) -> Model:
    """shares: how many documents each sampled clean and toxic one stands for.

    spread, hard: how many of the sample's distinct clean words a turn of the machine sees, drawn from all and taken from those that
    score highest; every other clean word is still scored in each turn and enters once it is among the highest. Words bound
    the memory of the fit together with the sample's size.
    """
    y = np.asarray(labels)
    if len(set(labels)) < 2:  # nothing to tell apart: everything scores its one label
        return Model(np.zeros(ALPHABET**LENGTH), 0.0, 0.0, 30.0 if len(y) and y[0] else -30.0)
    numbers: dict[str, int] = {}
    flat, ends, last = array("i"), array("i", [0]), array("i", [0])  # word numbers; where sentences end; the last sentence of each document
    counted, fresh, sizes = (array("i"), array("i")), (set(), set()), [0, 0]
    for t, label in zip(texts, y.tolist()):
        for sentence in _SENTENCE.split(t or ""):
            if ids := sorted({numbers.setdefault(w, len(numbers)) for k in tokens_of(sentence) for w in readings(k)}):
                flat.extend(ids)
                ends.append(len(flat))
                # Equal sentences count once, so copies of a document weigh no more than the document.
                if (mark := hash(tuple(ids))) not in fresh[label]:
                    fresh[label].add(mark)
                    counted[label].extend(ids)
                    sizes[label] += 1
        last.append(len(ends) - 1)
    words, flat, ends = list(numbers), np.frombuffer(flat, np.int32), np.frombuffer(ends, np.int32)
    seen = [np.bincount(np.frombuffer(x, np.int32), minlength=len(words)) if len(x) else np.zeros(len(words), np.int64) for x in counted]
    del counted, fresh
    toxic = np.flatnonzero(y == 1)
    sentences = lambda i: (flat[ends[j] : ends[j + 1]] for j in range(last[i], last[i + 1]))
    p0, p1 = (n / max(1, size) for n, size in zip(seen, sizes))
    lift = (p1 - p0) / np.sqrt((p0 + p1) / 2 / max(1, sizes[1]) + (p0 + p1) / 2 / max(1, sizes[0]) + 1e-12)
    ranked = [words[i] for i in np.argsort(-lift, kind="stable")[:4000] if seen[1][i] > 1]
    landmarks = _choose(ranked, LANDMARKS)
    landmarks += [w for w in _choose([words[i] for i in np.argsort(-seen[0], kind="stable")[:1000]], BACKGROUND) if w not in landmarks]
    if not landmarks:
        return Model(np.zeros(ALPHABET**LENGTH), 0.0, 0.0, -30.0)
    rows = profiles(landmarks)
    value, vector = np.linalg.eigh((rows @ rows.T).astype(np.float64))
    whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    rare = p0 <= RARER * p1  # witnesses are words that clean sentences hardly have
    score, floor = lift, TELLING
    present = np.flatnonzero(seen[0])
    seen_always = np.random.default_rng(0).permutation(present)[:spread]
    before = None
    for _ in range(turns):
        # positive sentences of a toxic document: the best one, and all with a telling word
        positive: Counter = Counter()
        for i in toxic:
            best = [max(ws, key=lambda w: (lift[w] if lift[w] >= TELLING else 0.0, score[w])) for s in sentences(i) if (ws := s[rare[s]].tolist())]
            if best:
                top = max(best, key=lambda w: score[w])
                positive.update({top, *(w for w in best if lift[w] >= TELLING or score[w] >= floor)})
        if positive == before:
            break
        before, floor = positive, 0.0
        negative = np.union1d(seen_always, present[np.argsort(-score[present], kind="stable")[:hard]])
        index = np.concatenate([np.fromiter(positive, np.int64, len(positive)), negative])
        rng = np.random.default_rng(1)
        more = [(v, n * BENT) for i, n in positive.items() for v in bent(words[i], rng) if v not in numbers]
        x = kernel([words[i] for i in index] + [v for v, _ in more], rows) @ whiten
        target = np.concatenate([np.ones(len(positive)), -np.ones(len(negative)), np.ones(len(more))])
        cost = np.concatenate([np.fromiter(positive.values(), float, len(positive)), seen[0][negative].astype(float), [n for _, n in more]])
        w, bias = _machine(x, target, cost)
        weights = ((whiten @ w) @ rows).astype(np.float32)
        score = word_scores(words, weights) + bias
    best = np.array([score[flat[ends[last[i]] : ends[last[i + 1]]]].max() if last[i + 1] > last[i] else bias for i in range(len(y))])
    slope, offset = _logistic(best, y.astype(float), np.where(y == 1, shares[1], shares[0]))
    return Model(weights, bias, slope, offset)


_known: tuple[bytes, dict[str, float]] = (b"", {})


def probabilities(model: Model, texts: Sequence[str | None], remembered: int = 150_000) -> np.ndarray:
    """One score per text. Texts are cut into tokens a chunk at a time; tokens stay scored from task to task."""
    global _known
    mark = model.weights.tobytes()
    if _known[0] != mark:
        _known = mark, {}
    known, out = _known[1], [np.zeros(0)]
    for s in in_chunks(texts, 300_000):
        tokens = [tokens_of(t or "") for t in texts[s]]
        if len(known) > remembered:
            known.clear()
        new = list(set().union(*tokens).difference(known))
        read = [readings(t) for t in new]
        words = list({w for r in read for w in r})
        raw = dict(zip(words, model.raw(words).tolist()))
        known.update((t, max(map(raw.__getitem__, r), default=model.bias)) for t, r in zip(new, read))
        out.append(np.array([max(map(known.__getitem__, t), default=model.bias) for t in tokens], float))
    return model.probability(np.concatenate(out))


def _score(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = probabilities(model, list(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    return run


def _keep(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(probabilities(model, b["text"].to_pylist()) < 0.5))

    return run


def held_out(name: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(name).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, spread: int = SPREAD, hard: int = HARD) -> Model:
    """Fit on at most so many labelled documents of either class that aren't held out; spread and hard as in fit().

    Null labels are left out; a document with several counts as toxic if one of them is 1; documents
    without a label, and labels without a document, have no part in it.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.md5(F.col("doc_id").cast("string")), "doc_id"]
    chosen = [known.where(F.col("toxic") == v).orderBy(*order).limit(n) for v, n in ((0, negatives), (1, positives))]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # bounded by the two parameters
    sample = docs.select("doc_id", "text").join(ids, "doc_id")
    fitted = sample.repartition(1).mapInPandas(_fit_sample(counts, spread, hard), "model binary").first()  # one task, of a bounded sample
    return pickle.loads(fitted["model"]) if fitted else fit([], [])


def _fit_sample(counts: dict[int, int], spread: int, hard: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted({(d, t or "", y) for b in batches for d, t, y in zip(b["doc_id"], b["text"], b["toxic"])})
        shares = tuple(counts.get(v, 0) / max(1, sum(r[2] == v for r in rows)) for v in (0, 1))
        job = pickle.dumps(([r[1] for r in rows], [r[2] for r in rows], shares, 4, spread, hard))
        # An interpreter of its own, started anew, so that the worker, which other tasks use again, doesn't keep the fit's memory.
        env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
        done = subprocess.run([sys.executable, "-c", f"from {__name__} import main; main()"], input=job, stdout=subprocess.PIPE, check=True, env=env)
        yield pd.DataFrame({"model": [done.stdout]})

    return run


def main() -> None:
    """Reads fit()'s arguments, pickled, and writes its model."""
    model = fit(*pickle.loads(sys.stdin.buffer.read()))
    sys.stdout.buffer.write(pickle.dumps(model))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Empty and null texts score as a document without any word that matters. The text alone is read;
    extra columns, labels included, have no effect. Repeated rows and null ids stay and score as any other; an
    empty table gives an empty result. Letters outside a to z are one symbol to the kernel and words of fewer than three letters are
    not read, so insults in other scripts, and two-letter ones, can't be told from other words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInPandas(_score(model), f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that aren't predicted toxic."""
    return docs.mapInArrow(_keep(model), docs.schema)

"""Language-model scoring by cross-entropy difference.

Two bigram models, one of the target documents and one of all documents, share one vocabulary: every word
of the table. The models are matched: same order, vocabulary and smoothing, with background counts scaled to
the target's number of tokens. Neither model counts the document that it scores, so a target document
doesn't vouch for itself. A document's score is the mean over its tokens of target loss less background
loss (nats); the lower, the more like the target.

The models are counts, so scoring is counting in the other direction. Documents are packed into batches of
a million words and written as word numbers. A batch asks once for every distinct word and
pair that it holds, with its own counts; the questions are dealt by key range, each range adds up what all
batches have and answers every batch in the order it asked, without repeating the keys. A batch then has the
whole corpus's counts of all it holds and finishes its documents. What is gathered grows with the corpus, a
frequent word or pair is one question per batch, and no table of the model passes the driver or a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, materialise, mix64, partitions, word_hashes

SMOOTHING = 64.0  #: tokens of the unigram distribution added to each history
BATCH_CHARS = 8_000_000  #: characters of a batch of documents
PART_TOKENS = 4_000_000  #: tokens of the corpus for each range of keys
ID_ROWS = 1_000_000  #: target ids up to which they are broadcast; beyond, documents and ids are shuffled
PAIR, WORD = np.uint64(0), np.uint64(1)  #: kinds of key, in its last bit
_STEP = np.uint64(0x9FB21C651E98DF25)


def _marked(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, text, target (whether doc_id is a target's)."""
    ids = target_ids.select("doc_id", F.lit(True).alias("t")).where("doc_id is not null").distinct()
    marked = docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= ID_ROWS else ids, "doc_id", "left")
    return marked.select("doc_id", "text", F.coalesce("t", F.lit(False)).alias("target"))


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def pack_numbers(n: np.ndarray) -> bytes:
    """Unsigned numbers by planes of one byte, of which the upper are mostly zero."""
    planes = n.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return squeeze(np.ascontiguousarray(planes[: max(1, -(-int(n.max(initial=0)).bit_length() // 8))]).tobytes())


def unpack_numbers(data: bytes, size: int) -> np.ndarray:
    planes = np.zeros((size, 8), np.uint8)
    if size:
        given = np.frombuffer(unsqueeze(data), np.uint8).reshape(-1, size)
        planes[:, : len(given)] = given.T
    return planes.view("<u8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return pack_numbers(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(unpack_numbers(data, size), dtype=np.uint64)


class Batch:
    """Documents as numbers of the batch's words. Words and pairs are known by 64-bit hashes."""

    def __init__(self, sizes: np.ndarray, target: np.ndarray, tokens: np.ndarray, words: np.ndarray):
        self.sizes, self.target = sizes, target
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.word = tokens.astype(np.int64)
        self.history = np.concatenate([[0], self.word[:-1] + 1]) if len(tokens) else self.word  # 0: the start of a text
        self.history[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
        size = len(words) + 1
        pairs, self.pair = np.unique(self.history * size + self.word, return_inverse=True)
        before = np.concatenate([[np.uint64(0)], words])
        keys = np.concatenate([mix64(words * _STEP) | WORD, mix64(mix64(before)[pairs // size] + words[pairs % size] * _STEP) & ~WORD])
        order = np.argsort(keys, kind="stable")
        self.keys, at = keys[order], np.empty(len(keys), np.int64)
        at[order] = np.arange(len(keys))
        self.word_at, self.pair_at = at[: len(words)], at[len(words) :]  # places of words and pairs among the keys

    def counts(self) -> np.ndarray:
        """Four rows of the batch's counts of its keys: in all documents, in target documents, and both as the last word of a text."""
        of_target = self.target[self.owner]
        last = np.zeros(len(self.word), bool)
        last[np.cumsum(self.sizes)[self.sizes > 0] - 1] = True
        count = lambda rows, at, values: np.bincount(at[values[rows]], minlength=len(self.keys))
        everything = np.ones(len(self.word), bool)
        whole = [count(r, self.word_at, self.word) + count(r, self.pair_at, self.pair) for r in (everything, of_target)]
        return np.array([*whole, count(last, self.word_at, self.word), count(last & of_target, self.word_at, self.word)])

    def _own(self, values: np.ndarray) -> np.ndarray:
        """For every token, how often its document has the value."""
        _, back, times = np.unique(self.owner * (int(values.max(initial=0)) + 1) + values, return_inverse=True, return_counts=True)
        return times[back]

    def means(self, counts: np.ndarray, totals: dict[str, int]) -> list[np.ndarray]:
        """Mean target and background loss of every document under the counts of all other documents."""
        own = [self._own(v) for v in (self.word, self.history, self.pair)]
        of_target, out = self.target[self.owner], []
        first = self.history == 0
        after = self.word_at[np.where(first, 0, self.history - 1)] if len(self.word) else self.word
        scale = totals["target_tokens"] / max(1, totals["tokens"])
        for row, k, mine, tokens, texts in ((1, 1.0, of_target, "target_tokens", "target_texts"), (0, scale, 1, "tokens", "texts")):
            history = np.where(first, totals[texts], counts[row][after] - counts[row + 2][after])
            word, history, pair = ((n - mine * o) * k for n, o in zip((counts[row][self.word_at[self.word]], history, counts[row][self.pair_at[self.pair]]), own))
            loss = -np.log((pair + SMOOTHING * ((word + 1) / (totals[tokens] * k + totals["words"]))) / (history + SMOOTHING))
            with np.errstate(invalid="ignore", divide="ignore"):
                out.append(np.bincount(self.owner, loss, len(self.sizes)) / self.sizes)
        return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per batch of documents."""
    number = TaskContext.get().partitionId() << 32
    for b in batches:
        texts = b.column("text").to_pylist()
        for s in in_chunks(texts, BATCH_CHARS):
            h, at = word_hashes(texts[s])
            words, tokens, times = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # frequent words have small numbers
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            n = len(at) - 1
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), b.column(c).slice(s.start, n)) for c in ("doc_id", "target")]
            sizes = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(np.diff(at), pa.int64()))
            packed = pack_numbers(rank[tokens]), words[order].astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([number]), *lists, sizes, *(pa.array([x]) for x in packed)], ["batch", "doc_id", "target", "size", "tokens", "words"])
            number += 1


def _restored(row: dict) -> Batch:
    sizes = np.array(row["size"], np.int64)
    return Batch(sizes, np.array(row["target"], bool), unpack_numbers(row["tokens"], int(sizes.sum())), np.frombuffer(row["words"], "<u8"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(len(b)):
            yield b.slice(i, 1).to_pylist()[0]


def _ask(ranges: int):
    """A row per batch and key range: the keys in ascending order and the batch's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.uint64((1 << 64) // ranges + 1)
        for row in _rows(batches):
            batch = _restored(row)
            counts = batch.counts()
            found, first = np.unique(batch.keys // width, return_index=True)
            cuts = [*first.tolist(), len(batch.keys)]
            spans = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_pydict({
                "range": found.astype(np.int32), "batch": np.full(len(found), row["batch"]), "size": [b - a for a, b in spans],
                "keys": [pack_keys(batch.keys[a:b]) for a, b in spans], "counts": [pack_numbers(counts[:, a:b].ravel()) for a, b in spans],
            })

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of range. All batches' counts of a range's keys are added up and returned to every batch; distinct words and tokens are counted once a range."""
    held: list[dict] = []

    def settle() -> Iterator[pa.RecordBatch]:
        cuts = np.cumsum([0, *(r["size"] for r in held)])
        distinct, place = np.unique(np.concatenate([unpack_keys(r["keys"], r["size"]) for r in held]), return_inverse=True)
        totals = np.zeros((4, len(distinct)), np.int64)
        for a, b, r in zip(cuts[:-1], cuts[1:], held):
            totals[:, place[a:b]] += unpack_numbers(r["counts"], 4 * r["size"]).astype(np.int64).reshape(4, -1)  # a batch has a key once
        word = distinct & WORD == WORD
        known = [int(word.sum()), *(int(x) for x in totals[:, word].sum(1))]
        for a, b, r in zip(cuts[:-1], cuts[1:], held):
            yield pa.RecordBatch.from_pydict({
                "batch": [r["batch"]], "range": pa.array([r["range"]], pa.int32()), "counts": [pack_numbers(totals[:, place[a:b]].ravel())],
            } | {k: [v] for k, v in zip(("words", "tokens", "target_tokens", "texts", "target_texts"), known)})
            known = [0] * 5

    for row in _rows(batches):
        if held and held[0]["range"] != row["range"]:
            yield from settle()
            held = []
        held.append(row)
    if held:
        yield from settle()


def _finish(ranges: int, totals: dict[str, int]):
    """Rows in order of batch, the documents (range -1) before the answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict | None = None
        answers: list[dict] = []
        kind = None

        def settle() -> pa.RecordBatch:
            batch, width = _restored(docs), np.uint64((1 << 64) // ranges + 1)
            lengths = np.unique(batch.keys // width, return_counts=True)[1]
            if len(lengths) != len(answers):
                raise RuntimeError("a batch of documents and its answers differ")
            counts = [np.zeros((4, 0), np.int64), *(unpack_numbers(a["counts"], 4 * k).astype(np.int64).reshape(4, -1) for a, k in zip(answers, lengths.tolist()))]
            target, background = batch.means(np.concatenate(counts, 1), totals)
            none = batch.sizes == 0
            columns = [pa.array(docs["doc_id"], kind), pa.array(batch.sizes), *(pa.array(x, pa.float64(), mask=none) for x in (target, background, target - background))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

        for b in batches:
            kind = b.schema.field("doc_id").type.value_type
            for row in _rows([b]):
                if row["range"] == -1:
                    if docs is not None:
                        yield settle()
                    docs, answers = row, []
                else:
                    answers.append(row)
        if docs is not None:
            yield settle()

    return run


def score_documents(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, target_loss, background_loss, score (their difference).

    target_ids: doc_ids of the target documents, which count in the background too; null ones are left out. Words are
    A-Z lower-cased and split at the six white-space characters. Each row is a document of its own, also where
    doc_ids or texts repeat or doc_ids are null: a copy counts for its fellow. Null and empty texts have no tokens and
    null losses. Without target documents the target model is uniform over the vocabulary. An empty table
    gives an empty result. Extra columns have no effect.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = _marked(docs, target_ids).mapInArrow(_pack, f"batch long, doc_id array<{kind}>, target array<boolean>, size array<long>, tokens binary, words binary")
    packed = materialise(packed, "batches")
    tokens = packed.agg(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    n = partitions(spark)
    ranges = max(n, -(-tokens // PART_TOKENS))
    asked = packed.select("batch", "target", "size", "tokens", "words").mapInArrow(_ask(ranges), "range int, batch long, size long, keys binary, counts binary")
    tasks = min(ranges, 100 * n)
    asked = asked.repartitionById(tasks, F.pmod("range", F.lit(tasks))).sortWithinPartitions("range", "batch")
    totals = ("words", "tokens", "target_tokens", "texts", "target_texts")
    answers = materialise(asked.mapInArrow(_answer, f"batch long, range int, counts binary, {', '.join(f'{c} long' for c in totals)}"), "answers")
    known = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in totals)).first().asDict()
    empty = lambda like, *names: [F.lit(None).cast(like.schema[c].dataType).alias(c) for c in names]
    rows = packed.select("batch", F.lit(-1).alias("range"), "doc_id", "target", "size", "tokens", "words", *empty(answers, "counts"))
    rows = rows.unionByName(answers.select("batch", "range", "counts", *empty(packed, "doc_id", "target", "size", "tokens", "words")))
    rows = rows.repartition(n, "batch").sortWithinPartitions("batch", "range")
    return rows.mapInArrow(_finish(ranges, known), f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")

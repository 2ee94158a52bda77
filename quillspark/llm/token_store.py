"""Token ids in directly addressable codes, in files in ascending doc_id order.

A segment holds the ids of consecutive documents. Each id is cut into 8-bit chunks, low chunk first;
level k stores the k-th chunk of every id that has one, one byte each, with a continuation bitmap (bit i
set: entry i goes on at level k + 1) and a rank directory (ones before each block of 512 bits). The
place of id i at the next level is the number of ones before it, so any id is read with one directory
lookup and one partial popcount per level; nothing else is decoded.

Segment layout, little-endian: magic `QDAC1`, three zero bytes, uint64 documents, uint64 ids, uint64
levels; int64 doc_ids; uint8 doc_id validity; uint64 first id of each document, then the id count; per
level uint64 entries, its bytes, bitmap (padded to 64 bytes) and uint32 directory.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import eights, hash_eights, in_chunks, is_space, materialise, partitions

MAGIC = b"QDAC1\0\0\0"
BLOCK = 512


def pack(doc_ids: Sequence[int | None], counts: Sequence[int], ids: np.ndarray) -> bytes:
    """A segment of the given documents; ids: all their ids in order."""
    ids = np.ascontiguousarray(ids, np.uint32)
    starts = np.concatenate([[0], np.cumsum(np.asarray(counts, np.uint64))]).astype(np.uint64)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    body, rest = [], ids
    levels = 0
    while len(rest) or not levels:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bitmap.view("<u8")).reshape(-1, BLOCK // 64).sum(1)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        body += [np.uint64(len(rest)).tobytes(), (rest & 0xFF).astype(np.uint8).tobytes(), bitmap.tobytes(), directory.tobytes()]
        rest, levels = rest[more] >> 8, levels + 1
    head = np.array([len(known), len(ids), levels], "<u8").tobytes()
    plain = np.array([0 if d is None else int(d) for d in doc_ids], "<i8")
    return b"".join([MAGIC, head, plain.tobytes(), known.tobytes(), starts.astype("<u8").tobytes(), *body])


class Segment:
    """Random access to a packed segment."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a token segment")
        n, self.size, levels = map(int, np.frombuffer(blob, "<u8", 3, 8))
        at = 32
        self.ids = np.frombuffer(blob, "<i8", n, at)
        self.known = np.frombuffer(blob, np.uint8, n, at := at + 8 * n)
        self.starts = np.frombuffer(blob, "<u8", n + 1, at := at + n)
        at += 8 * (n + 1)
        self.levels = []
        for _ in range(levels):
            m = int(np.frombuffer(blob, "<u8", 1, at)[0])
            blocks = -(-m // BLOCK)
            chunk = np.frombuffer(blob, np.uint8, m, at := at + 8)
            bitmap = np.frombuffer(blob, np.uint8, blocks * BLOCK // 8, at := at + m)
            directory = np.frombuffer(blob, "<u4", blocks + 1, at := at + len(bitmap))
            at += 4 * (blocks + 1)
            self.levels.append((chunk, bitmap, directory))

    @property
    def doc_ids(self) -> list[int | None]:
        return [int(d) if k else None for d, k in zip(self.ids, self.known)]

    def place(self, doc_id: int) -> int | None:
        """The first document with the id, which are in ascending order after those without one."""
        first = len(self.known) - int(self.known.sum())
        k = first + int(np.searchsorted(self.ids[first:], doc_id))
        return k if k < len(self.ids) and self.ids[k] == doc_id else None

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        """Id number i, by one rank per level."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for k, (chunk, bitmap, directory) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            part = np.unpackbits(bitmap[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i = int(directory[block]) + int(part.sum())
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        value, where = np.zeros(self.size, np.uint32), np.arange(self.size)
        for k, (chunk, bitmap, _) in enumerate(self.levels):
            value[where] |= chunk.astype(np.uint32) << np.uint32(8 * k)
            where = where[np.unpackbits(bitmap, bitorder="little")[: len(chunk)].astype(bool)]
        return value

    def document(self, k: int) -> list[int]:
        return [self[i] for i in range(int(self.starts[k]), int(self.starts[k + 1]))]


class Encoder:
    """Ids of whole texts, equal to the library's encode(add_special_tokens=False).

    A byte-level tokenizer's pattern never joins a word to what follows it, and of a run of white space
    only the last character may belong to the next word; a sign after a letter begins anew. So a text is cut at those places into units,
    each distinct unit is encoded once by the library, and texts are put together from the remembered
    units by array operations. Units are found by a hash, and every hit is compared byte by byte; should two
    units ever have one hash, the texts go to the library. Cutting holds where the white space is known: for texts
    of characters below U+0240 without U+0085, U+00A0 and control characters. Other texts, texts with an
    added token's string in them, and tokenizers of other kinds go to the library whole.
    """

    def __init__(self, path: str, remembered: int = 1_500_000, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        self.added = [] if special_as_text else [t["content"] for t in spec.get("added_tokens", [])]
        self.odd = np.zeros(256, bool)
        self.odd[[*range(9), *range(14, 32), 127, *range(0xC9, 256)]] = True
        self.letter, self.sign = np.zeros(256, bool), np.zeros(256, bool)
        self.letter[[*range(65, 91), *range(97, 123)]] = True
        self.sign[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
        self.width = np.zeros(1 + max(self.tokenizer.get_vocab().values(), default=0), np.int64)  # bytes of each id: a byte-level token has a character for each
        for t, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(t)
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted, with each unit's number
        self.ids, self.upto = np.zeros(0, np.uint32), np.zeros(1, np.int64)  # by number: every unit's ids, and where they end
        self.bytes, self.ends = np.zeros(0, np.uint64), np.zeros(1, np.int64)  # every unit in eights of bytes, and where each ends

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of distinct units with one space before a word, which go to the library as one text, and how many each has."""
        ids, counts = [], []
        for k in range(0, len(starts), 20_000):
            length = stops[k : k + 20_000] - starts[k : k + 20_000]
            ends = np.cumsum(length)
            raw = buf[np.repeat(starts[k : k + 20_000] - (ends - length), length) + np.arange(ends[-1])].tobytes()
            found = self.library([raw.decode()])[0]
            upto = np.cumsum(self.width[found])
            last = np.minimum(np.searchsorted(upto, ends), len(found) - 1)
            if len(found) and upto[-1] == ends[-1] and (upto[last] == ends).all():
                ids.append(found)
                counts.append(np.diff(last, prepend=-1))
            else:  # a tokenizer that leaves bytes out, or joins units
                alone = self.library([raw[b - n : b].decode() for b, n in zip(ends.tolist(), length.tolist())])
                ids += alone
                counts.append(np.array([len(x) for x in alone], np.int64))
        return ids, counts

    def _learn(self, hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, stops: np.ndarray, size: np.ndarray, eight: np.ndarray) -> None:
        """Remember units, those of _joined() first, of size[i] eights of bytes each."""
        joined = int(self._is_joined(buf, starts, stops).sum())
        ids, counts = self._joined(buf, starts[:joined], stops[:joined])
        alone = self.library([buf[a:b].tobytes().decode() for a, b in zip(starts[joined:].tolist(), stops[joined:].tolist())])
        count = np.concatenate([*counts, np.array([len(x) for x in alone], np.int64)])
        place = len(self.ends) - 1 + np.arange(len(hashes))
        self.ids, self.upto = np.concatenate([self.ids, *ids, *alone]), np.concatenate([self.upto, self.upto[-1] + np.cumsum(count)])
        self.bytes, self.ends = np.concatenate([self.bytes, eight]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.place = np.insert(self.hashes, at, hashes[order]), np.insert(self.place, at, place[order])

    @staticmethod
    def _is_joined(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return is_space(buf[starts]) & ~is_space(buf[stops - 1])

    def _fast(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all texts and how many each has; None where two different units have one hash."""
        buf = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum([len(d) for d in data])
        space = is_space(buf)
        after = np.append(space[1:], True)
        after[ends - 1] = True
        before = np.insert(space[:-1], 0, False)
        cut = space & (~after | ~before)
        letter = self.letter[buf]
        letter[1:] |= (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        cut[1:] |= letter[:-1] & self.sign[buf[1:]]
        cut[ends - [len(d) for d in data]] = True
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(buf))
        eight, inside, begin = eights(buf, starts, stops)
        size = np.diff(np.append(begin, len(eight)))
        h = hash_eights(eight, inside, begin, stops - starts)
        distinct, sample, place = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > self.remembered:
            self.forget()
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        if new.any():
            chosen, hashes = sample[new], distinct[new]
            order = np.argsort(~self._is_joined(buf, starts[chosen], stops[chosen]), kind="stable")
            chosen, hashes = chosen[order], hashes[order]
            wanted = eight[np.repeat(begin[chosen] - (np.cumsum(size[chosen]) - size[chosen]), size[chosen]) + np.arange(int(size[chosen].sum()))]
            self._learn(hashes, buf, starts[chosen], stops[chosen], size[chosen], wanted)
            at = np.searchsorted(self.hashes, distinct)
        unit = self.place[at][place]
        if (self.ends[unit + 1] - self.ends[unit] != size).any() or (self.bytes[np.repeat(self.ends[unit], size) + inside] != eight).any():
            return None
        count = self.upto[unit + 1] - self.upto[unit]
        upto = np.cumsum(count)
        ids = self.ids[np.repeat(self.upto[unit] - (upto - count), count) + np.arange(upto[-1])]
        return ids, np.diff(np.concatenate([[0], upto[np.searchsorted(starts, ends) - 1]]))

    def __call__(self, texts: Sequence[str]) -> list[np.ndarray]:
        data = [t.encode("utf-8", "replace") for t in texts]
        buf = np.frombuffer(b"".join(data), np.uint8)
        odd = self.odd[buf]
        odd[:-1] |= (buf[:-1] == 0xC2) & (buf[1:] <= 0xA0)
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        odd = np.diff(np.concatenate([[0], np.cumsum(odd)])[bounds])
        out: list = [np.zeros(0, np.uint32)] * len(texts)
        fast = [i for i, t in enumerate(texts) if t and self.plain and not odd[i] and not any(a in t for a in self.added)]
        if fast and (found := self._fast([data[i] for i in fast])) is None:
            fast = []
        if fast:
            ids, counts = found
            for i, x in zip(fast, np.split(ids, np.cumsum(counts)[:-1])):
                out[i] = x
        taken = set(fast)
        slow = [i for i, t in enumerate(texts) if t and i not in taken]
        for i, x in zip(slow, self.library([texts[i] for i in slow])):
            out[i] = x
        return out


_encoders: dict[tuple, Encoder] = {}


def shared_encoder(path: str, special_as_text: bool) -> Encoder:
    """This process's encoder, which keeps what it remembers from task to task."""
    key = path, special_as_text
    if key not in _encoders:
        _encoders[key] = Encoder(path, special_as_text=special_as_text)
    return _encoders[key]


def _segments(path: str, end_id: int, most: int, special_as_text: bool):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = shared_encoder(path, special_as_text), np.array([end_id], np.uint32)
        shard, part = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        held = 0

        def segment() -> pd.DataFrame:
            counts = [len(x) + 1 for x in ids]
            blob = pack(docs, counts, np.concatenate([y for x in ids for y in (x, end)]))
            known = [d for d in docs if d is not None] or [None]
            return pd.DataFrame({"shard": [shard], "part": [part], "n_ids": [sum(counts)], "first_doc": pd.array(known[:1], "Int64"), "last_doc": pd.array(known[-1:], "Int64"), "segment": [blob]})

        for b in batches:
            texts = ["" if t is None else t for t in b["text"]]
            keys = [int(d) if k else None for d, k in zip(b["doc_id"], b["known"])]
            for s in in_chunks(texts):
                for d, x in zip(keys[s], encode(texts[s])):
                    docs.append(d)
                    ids.append(x)
                    held += len(x) + 1
                    if held >= most:
                        yield segment()
                        ids, docs, held, part = [], [], 0, part + 1
        if docs:
            yield segment()

    return write


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 0, ids_per_segment: int = 200_000, special_as_text: bool = False) -> DataFrame:
    """Write all documents' ids, each followed by end_id, and read the files back: shard, part, n_ids, first_doc, last_doc, segment.

    Segments in (shard, part) order hold the documents in ascending doc_id order (null doc_ids first,
    equal ones by text). They lie in the files as they are, without compression, each in a page of its own, under
    the range of doc_ids that it holds. Null texts count as empty and have the end id alone. A text longer than a
    segment has one of its own size. An empty table gives an empty store. Extra columns have no effect.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text")
    rows = rows.withColumn("start", F.substring("text", 1, 40))  # parts rows that share a doc_id or have none
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "known", "doc_id", "start").sortWithinPartitions("known", "doc_id", "text").drop("start")
    packed = rows.mapInPandas(_segments(tokenizer, end_id, ids_per_segment, special_as_text), "shard int, part int, n_ids long, first_doc long, last_doc long, segment binary")
    return materialise(packed, "tokens", **{"compression": "none", "parquet.page.size": "65536", "parquet.page.row.count.limit": "1"})


def token(store: DataFrame, doc_id: int, i: int) -> int | None:
    """Id number i (from 0) of the document, the end id included; None where there is none.

    The scan keeps the pages of the one or few segments whose range of doc_ids holds the document; of a segment the
    document's place and one byte, bit and rank a level are read, and no other id is decoded.
    """
    near = store.where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).select("shard", "part", "segment").mapInPandas(_one(doc_id, i), "shard int, part int, value long")
    found = near.orderBy("shard", "part").first()
    return found and found["value"]


def _one(doc_id: int, i: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, part, blob in zip(b["shard"], b["part"], b["segment"]):
                s = Segment(blob)
                k = s.place(doc_id)
                if k is not None and 0 <= i < int(s.starts[k + 1]) - int(s.starts[k]):
                    yield pd.DataFrame({"shard": [shard], "part": [part], "value": [s[int(s.starts[k]) + i]]})

    return run


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for shard, part, blob in zip(b["shard"], b["part"], b["segment"]):
            s = Segment(blob)
            ids = memoryview(s.all().astype("<u4").tobytes())
            bounds = s.starts.tolist()
            crc = [zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(bounds[:-1], bounds[1:])]
            yield pd.DataFrame({"shard": shard, "part": part, "doc_id": pd.array(s.doc_ids, "Int64"), "start": s.starts[:-1].astype(np.int64), "n_tokens": np.diff(s.starts.astype(np.int64)), "ids_crc32": crc})


def document_index(store: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, read from the segments."""
    parts = store.select("shard", "part", "n_ids")
    shards = parts.groupBy("shard").agg(F.sum("n_ids").alias("in_shard"))  # one row per output partition
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("in_shard").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("shard", "part", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("part_start")).join(shards, "shard")
    read = store.select("shard", "part", "segment").mapInPandas(_read, "shard int, part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return read.join(parts, ["shard", "part"]).select("doc_id", (F.col("start") + F.col("shard_start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")

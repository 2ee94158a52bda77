"""Shared helpers: scratch tables in the shared folder, text rules, word and shingle hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words, as a translate() source and as a regular expression class.
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, else the context's checkpoint folder.

    Where neither is set a local master gets a temporary folder of this machine, where all its tasks run; on a cluster
    that would lose data, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    if not (spark.sparkContext.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quillspark-')}")
    return shared_folder(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, under the application's id."""
    return f"{shared_folder(spark).rstrip('/')}/quillspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a short lineage that outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what materialise() wrote for df."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_by_size(rows: DataFrame, sizes: DataFrame, keys: list[str], size: str = "members", share: int = 8) -> DataFrame:
    """rows joined (inner) with sizes, which has one row per key and, in the column `size`, the number of rows that have it.

    A key with more than 1/share of the mean partition's rows comes by broadcast; there are at most share * partitions
    of those whatever the data. The first of the largest keys always does, so the plan is the same for all data. All others are
    shuffled, so no task gets much more than its part.
    """
    sizes = materialise(sizes, "sizes")
    known = sizes.agg(F.sum(size), F.max(F.struct(size, *keys))).first()
    most = (known[0] or 0) / (share * partitions(rows.sparkSession))
    largest = F.lit(True)
    for k in keys:
        largest &= F.col(k).eqNullSafe(F.lit(known[1][k] if known[1] else None))
    large = (F.col(size) > most) | largest
    heavy, light = sizes.where(large), sizes.where(~large)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(light, keys))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- word and shingle hashes -------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_BYTES_KEPT = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (the finaliser of MurmurHash3)."""
    s = np.uint64(33)
    x = (x ^ (x >> s)) * _MIX1
    x = (x ^ (x >> s)) * _MIX2
    return x ^ (x >> s)


def is_space(buf: np.ndarray) -> np.ndarray:
    return _SPACE[buf]


def eights(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans' bytes in eights, each as one number (the last filled up with zero bytes), their places in the spans, and where each span's begin. No span is empty."""
    n = -(-(stops - starts) // 8)
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    at = np.repeat(starts, n) + 8 * place
    loads = np.ndarray(len(buf), "<u8", np.concatenate([buf, np.zeros(7, np.uint8)]), strides=(1,))
    return loads[at] & _BYTES_KEPT[np.minimum(np.repeat(stops, n) - at, 8)], place, first


def span_hashes(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans, other ones for each seed: every eight bytes pass a mixer of their place before they are added up."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return hash_eights(*eights(buf, starts, stops), stops - starts, seed)


def hash_eights(data: np.ndarray, place: np.ndarray, first: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """span_hashes() of spans that eights() has taken apart."""
    keys = mix64(np.arange(1, int(place.max(initial=0)) + 2, dtype=np.uint64) * _STEP[1] + np.uint64(seed))
    return mix64(np.add.reduceat(mix64(data ^ keys[place]), first) + lengths.astype(np.uint64) * _STEP[0])


def word_hashes(texts: Sequence[str | None], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased, split at SPACES) of all texts, and the position where each text's words begin (one more at the end)."""
    buf, first, last, at = word_spans(texts)
    return span_hashes(buf, first, last, seed), at


def word_spans(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, where words start and stop in them, and the position where each text's words begin."""
    data = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES) for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data], dtype=np.int64)
    buf = np.frombuffer(b" ".join(data) + b" ", np.uint8) if data else np.zeros(0, np.uint8)
    none = np.zeros(0, np.int64)
    if not len(buf):
        return buf, none, none, np.zeros(len(texts) + 1, np.int64)
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    first, last = edge[0::2], edge[1::2]
    return buf, first, last, np.concatenate([[0], np.searchsorted(first, ends)]).astype(np.int64)


def shingle_hashes(texts: Sequence[str | None], k: int = 5, seeds: Sequence[int] = (0,)) -> tuple[np.ndarray, ...]:
    """For each seed, hashes of the k-word shingles of all texts in order, repeats kept; then where each text's begin.

    A text of 1 to k-1 words has its whole sequence as its one shingle; one without words has none.
    """
    buf, first, last, at = word_spans(texts)
    n = np.diff(at)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    pos = at[owner] + np.arange(len(owner)) - out_at[owner]
    full = n[owner] >= k
    found = []
    for seed in seeds:
        h = span_hashes(buf, first, last, seed)
        out = np.zeros(len(owner), np.uint64)
        for i in range(k):
            inside = full if i else np.ones(len(owner), bool)
            out[inside] = mix64(out[inside] + h[pos[inside] + i] * _STEP[i % len(_STEP)])
        for j in np.flatnonzero(~full):
            for i in range(1, n[owner[j]]):
                out[j : j + 1] = mix64(out[j : j + 1] + h[pos[j] + i : pos[j] + i + 1] * _STEP[i % len(_STEP)])
        found.append(mix64(out + np.minimum(n[owner], k).astype(np.uint64)))
    return *found, out_at


def numbered_shingles(words: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text as numbers, equal only for equal shingles of these texts.

    words: exact word numbers of all texts in order; text i has those from at[i] to at[i + 1]. Nothing is hashed.
    """
    n = np.diff(at)
    size = int(words.max(initial=0)) + 1
    code = words
    for i in range(1, k):
        if len(code) <= 1:
            code = code[:0]
            break
        code = np.unique(code[:-1] * size + words[i:], return_inverse=True)[1]
    short: dict[tuple, int] = {}
    return [np.unique(code[a : b - k + 1]) if m >= k else np.array([-1 - short.setdefault(tuple(words[a:b].tolist()), len(short))] if m else [], np.int64) for a, b, m in zip(at[:-1], at[1:], n)]


def in_chunks(texts: Sequence[str | None], limit: int = 400_000) -> Iterator[slice]:
    """Slices of consecutive texts of about limit characters; a longer text has a slice of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if i > start and size + n > limit:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def distinct_sets(hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of each text."""
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:])]

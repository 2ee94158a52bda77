"""Reading survey exports: encoding, delimiter, headers, and the row number everything else hangs on."""

from __future__ import annotations

import csv
import io
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.graph import written
from . import quoted_lines

DELIMITERS = (",", "\t", ";", "|")
HEAD_BYTES = 65536  #: bytes that show the delimiter, and the headers where they are no longer
GUESS_BYTES = 16 << 20  #: bytes from which an encoding is guessed
JAVA = {"utf-8-sig": "UTF-8", "utf_16": "UTF-16"}  #: encodings that the reader knows; others are read byte for byte as Latin-1 and decoded cell by cell


class IngestError(ValueError):
    """The file can't be read as a table."""


def decodes(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except (UnicodeDecodeError, LookupError, UnicodeError):
        return False
    return True


def guess(data: bytes) -> list[str]:
    """What charset_normalizer and chardet, where they are installed, take the bytes for."""
    found = []
    try:
        from charset_normalizer import from_bytes

        found.append(best.encoding if (best := from_bytes(data).best()) is not None else None)
    except ImportError:
        pass
    try:
        import chardet

        found.append(chardet.detect(data)["encoding"])
    except ImportError:
        pass
    return [e for e in found if e]


def detect_encoding(data: bytes) -> str:
    """UTF-16 by its mark, UTF-8 (reported with signature), a guess that decodes, cp1252, then latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf_16"
    return next(e for e in ("utf-8-sig", *guess(data), "cp1252", "latin-1") if decodes(data, e))


def detect_delimiter(text: str) -> str:
    """The sniffer's choice, else the delimiter whose count per line agrees most."""
    try:
        return csv.Sniffer().sniff(text, delimiters="".join(DELIMITERS)).delimiter
    except csv.Error:
        pass
    lines = [x for x in text.splitlines() if x.strip()][:25]
    best, rank = ",", (0, 0, 0)
    for d in DELIMITERS:
        counts = [x.count(d) for x in lines if d in x]
        if counts:
            modal, rows = Counter(counts).most_common(1)[0]
            if (rows, modal, len(counts)) > rank:
                best, rank = d, (rows, modal, len(counts))
    return best


@dataclass(frozen=True)
class Table:
    """An all-string table with columns c0..ck and row_number, and the headers as they were."""

    frame: DataFrame
    headers: tuple[str, ...]
    encoding: str
    delimiter: str

    def head(self, n: int = 25) -> DataFrame:
        """The first rows."""
        return self.frame.orderBy("row_number").limit(n)

    def sample(self, n: int = 25) -> list[dict[str, str | None]]:
        """The first rows as dicts idx_0..idx_k, safe from repeated headers."""
        rows = self.head(n).collect()
        return [{f"idx_{i}": r[f"c{i}"] for i in range(len(self.headers))} for r in rows]


def _head(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> bytes:
    """The first bytes, through Spark's own file systems; of a folder, those of its first file that isn't empty."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        files = [f.getPath() for f in fs.listStatus(p) if f.isFile() and f.getLen() and f.getPath().getName()[0] not in "._"]
        if not files:
            return b""
        p = min(files, key=lambda f: f.getName())
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


#: A record and its line end; line ends inside quotes don't end it.
_RECORD = re.compile(r'(?:[^"\r\n]++|"[^"]*+")*+(?:\r\n|\n|\r(?=[^\n]))')


def header_record(spark: SparkSession, path: str, head: bytes, encoding: str) -> str:
    """The first record, whatever its length: the file's first bytes, four times as many each time, until they hold its end or all of the file."""
    size = HEAD_BYTES
    while True:
        text = head.decode(encoding, "ignore")
        if (found := _RECORD.match(text)) is not None or len(head) < size:
            return found.group() if found is not None else text
        size *= 4
        head = _head(spark, path, size)


@dataclass(frozen=True)
class Survey:
    """What a scan of the whole file finds; lines are split at line ends, whatever the quotes say."""

    utf8: bool
    cp1252: bool
    quotes: int
    torn: int  #: lines with an odd number of quotes: a quoted cell goes on at the next line


def survey(spark: SparkSession, path: str) -> Survey:
    """One pass over all lines in parallel. No line end lies inside a UTF-8 character, so lines are valid as the file is."""
    value = F.col("value")
    raw = F.decode(value.cast("binary"), "ISO-8859-1")
    quotes = F.char_length(raw) - F.char_length(F.replace(raw, F.lit('"'), F.lit("")))
    found = spark.read.text(path).agg(
        F.bool_and(F.is_valid_utf8(value)), F.bool_and(~raw.rlike("[\u0081\u008d\u008f\u0090\u009d]")), F.sum(quotes), F.sum(quotes % 2)
    ).first()
    return Survey(found[0] is not False, found[1] is not False, found[2] or 0, found[3] or 0)


def recoded(c: Column, encoding: str) -> Column:
    """Cells read as Latin-1, decoded: by a table of 128 characters, or in Arrow batches where a character takes several bytes."""
    if encoding.lower().replace("_", "-") in ("latin-1", "iso-8859-1"):
        return c
    if all(len(bytes([b, 0xB0]).decode(encoding, "replace")) == 2 for b in range(128, 256)):
        pairs = [(chr(b), bytes([b]).decode(encoding, "replace")) for b in range(128, 256)]
        return F.translate(c, "".join(a for a, _ in pairs), "".join(x for _, x in pairs))

    @F.pandas_udf("string")
    def decoded(cells: pd.Series) -> pd.Series:
        return cells.map(lambda x: x.encode("latin-1").decode(encoding, "replace"), na_action="ignore")

    return decoded(c)


def _all_decode(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether every line decodes. For encodings of one byte a character, or those that keep line ends apart from other characters."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = sum(not decodes(x, encoding) for x in b.column("value").to_pylist())
            yield pa.RecordBatch.from_pydict({"bad": pa.array([bad], pa.int64())})

    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("value"))
    return not lines.mapInArrow(check, "bad long").agg(F.sum("bad")).first()[0]


def file_encoding(spark: SparkSession, path: str, head: bytes, found: Survey) -> str:
    """S02 for a file of any size: a verdict holds for every byte of it.

    A guess is made from the whole file up to GUESS_BYTES, beyond from as many bytes of its lines that aren't ASCII, and counts only where the whole
    file decodes by it.
    """
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf_16"
    if found.utf8:
        return "utf-8-sig"
    telling = _head(spark, path, GUESS_BYTES + 1)
    if len(telling) > GUESS_BYTES:
        lines = spark.read.text(path).select(F.col("value").cast("binary").alias("line")).where(~F.decode("line", "ISO-8859-1").rlike(r"^[\x00-\x7f]*$"))
        size = lines.agg(F.sum(F.octet_length("line"))).first()[0]
        part = lines if size <= GUESS_BYTES else lines.where(F.pmod(F.xxhash64("line"), F.lit(-(-size // GUESS_BYTES))) == 0)
        telling = b"\n".join(bytes(r["line"]) for r in part.toLocalIterator())
    for e in guess(telling):  # wide characters have a mark at the start
        if not e.lower().replace("-", "_").startswith(("utf_16", "utf_32")) and _all_decode(spark, path, e):
            return e
    return "cp1252" if found.cp1252 else "latin-1"


def numbered(df: DataFrame, ids: str | None = None) -> DataFrame:
    """Give rows consecutive numbers from 1 in the table's order: rows per partition are counted, then added up.

    All in the JVM; no row moves. The second scan must see the first one's partitions, as file scans do. ids: a column that
    holds monotonically_increasing_id() already.
    """
    low = (1 << 33) - 1
    marked = df.withColumn("__id", F.col(ids) if ids else F.monotonically_increasing_id()).withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(low)})
    sizes = marked.groupBy("__part").agg((F.max("__at") + 1).alias("__size"))  # one row per partition
    before = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return marked.join(F.broadcast(starts), "__part").select(*df.columns, (F.col("__before") + F.col("__at") + 1).alias("row_number"))


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None) -> Table:
    """Every cell a string, quoted line ends kept, headers by position.

    path: a file, or a folder of files with the same header, whose rows are numbered in the order Spark reads the files.
    Headers may be of any length and number; blank lines before them aren't skipped. Empty cells are null. A quote that never ends is an error that asks for a new export.
    The file is read in splits, also where quoted cells hold line ends: its records are then cut by `quoted_lines`, written once, and a folder's rows are
    numbered by its files' paths. Only UTF-16 files are one task's.
    """
    head = _head(spark, path)
    if not head.strip():
        raise IngestError("The file is empty.")
    found = survey(spark, path)
    encoding = encoding or file_encoding(spark, path, head, found)
    encoding = "utf_16" if encoding.lower().replace("-", "_") in ("utf_16", "utf16") else encoding
    wide = encoding == "utf_16"
    quotes = found.quotes
    if wide:
        whole = F.decode(F.col("content"), JAVA["utf_16"])
        quotes = spark.read.format("binaryFile").load(path).agg(F.sum(F.char_length(whole) - F.char_length(F.replace(whole, F.lit('"'), F.lit(""))))).first()[0]
    if quotes % 2:
        raise IngestError("The file has an unterminated quote; please reexport it.")
    text = head.decode(encoding, "ignore")
    delimiter = delimiter or detect_delimiter(text)
    record = header_record(spark, path, head, encoding)
    csv.field_size_limit(max(csv.field_size_limit(), len(record)))
    headers = next(csv.reader(io.StringIO(record, newline=""), delimiter=delimiter))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(headers))])
    names = tuple(h.replace("\ufeff", "") for h in headers)
    reading = {"sep": delimiter, "quote": '"', "escape": '"', "maxColumns": max(20480, len(headers) + 1)}
    if found.torn and not wide:
        line_end = "\r" if record.endswith("\r") else "\n"
        return Table(_recoded(_torn_cells(spark, path, encoding, delimiter, line_end, schema, reading), encoding), names, encoding, delimiter)
    cells = _recoded(spark.read.schema(schema).options(header=True, enforceSchema=True, multiLine=wide, encoding=JAVA.get(encoding, "ISO-8859-1"), **reading).csv(path), encoding)
    if found.torn and record.rstrip("\n").endswith("\r") and "\n" in record.rstrip("\r\n"):
        # the reader took the line end inside a header for the file's, so the last cells still have their carriage return, and quotes before it
        last = F.regexp_replace(F.col(cells.columns[-1]), "\r$", "")
        bare = F.replace(F.expr(f"substring({cells.columns[-1]}, 2, char_length({cells.columns[-1]}) - 3)"), F.lit('""'), F.lit('"'))
        quoted = F.col(cells.columns[-1]).rlike('(?s)^".*"\r$')
        cells = cells.withColumn(cells.columns[-1], F.nullif(F.when(quoted, bare).otherwise(last), F.lit("")))
    return Table(numbered(cells), names, encoding, delimiter)


def _recoded(cells: DataFrame, encoding: str) -> DataFrame:
    return cells if encoding in JAVA else cells.select(*(F.col(c) if c == "row_number" else recoded(F.col(c), encoding).alias(c) for c in cells.columns))


def _torn_cells(spark: SparkSession, path: str, encoding: str, delimiter: str, line_end: str, schema: T.StructType, reading: dict) -> DataFrame:
    """Cells and row_number of a file whose quoted cells hold line ends. The records are written once, so all that follows sees the same splits."""
    text = F.make_valid_utf8("value") if encoding in JAVA else F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    lines = quoted_lines.split_lines(spark, path, text, line_end)
    begins = quoted_lines.beginnings(quoted_lines.effects(lines, delimiter))
    pieces = written(quoted_lines.parts(lines, begins, delimiter, line_end), "records")
    cells = F.from_csv("text", ", ".join(f"{c} string" for c in schema.names), {k: str(v) for k, v in reading.items()})
    return quoted_lines.records(pieces, line_end).select(cells.alias("cells"), "row_number").select("cells.*", "row_number")


def from_frame(df: DataFrame, order: str) -> Table:
    """An existing table as survey input: all columns but the unique `order` become strings; rows are numbered by it.

    Numbers are given within ranges of the order, to which the rows of the ranges before are added.
    """
    columns = [c for c in df.columns if c != order]
    keys = df.select(F.col(f"`{order}`").alias("__order"))
    ranged = keys.repartitionByRange("__order").sortWithinPartitions("__order").withColumn("__id", F.monotonically_increasing_id())
    numbers = numbered(written(ranged, "numbers"), "__id").select("__order", "row_number")
    cells = [F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)]
    frame = df.select(*cells, F.col(f"`{order}`").alias("__order")).join(numbers, "__order").drop("__order")
    return Table(frame, tuple(columns), "utf-8-sig", ",")


def parse_filters(raw: str | None) -> dict[str, list[str]]:
    """`{"column": ["value", ...]}`; one value may stand without its list."""
    if raw is None or not raw.strip():
        return {}
    try:
        found = json.loads(raw)
    except json.JSONDecodeError as e:
        raise ValueError("filters must be valid JSON") from e
    if not isinstance(found, dict):
        raise ValueError("filters must be a JSON object")
    out = {}
    for k, v in found.items():
        values = [v] if isinstance(v, str) else v
        if not isinstance(values, list) or not all(isinstance(x, str) for x in values):
            raise ValueError(f"filter values of {k!r} must be strings")
        if str(k).strip() and values:
            out[str(k)] = values
    return out

"""CSV files whose quoted cells go on over line ends, read in splits.

Whether a line is the start of a record depends on all lines before it. So each split is walked twice in one pass, as if it began outside a quoted
cell and as if it began inside one; a split's effect is then which of the two it ends in, and the effects of the splits before one add up to its true
beginning. A second pass cuts records, and the parts of a record that lies across splits are put together by its number.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a pass over one split finds, for a beginning outside and inside a quoted cell.
EFFECTS = "path string, start long, ends_out boolean, ends_in boolean, n_out long, n_in long"
RECORDS = "record long, row_number long, start long, whole boolean, text string"


def closed_line(delimiter: str) -> re.Pattern:
    """Matches in full a line that, begun at the start of a record, leaves no quoted cell open. A quote counts only at a cell's start and inside a quoted cell."""
    d = re.escape(delimiter)
    plain = f"[^{d}]*+" if len(delimiter) == 1 else f"(?:(?!{d}).)*+"
    cell = f'(?:"[^"]*+(?:""[^"]*+)*+"{plain}|(?!"){plain})'
    return re.compile(f"{cell}(?:{d}{cell})*+", re.DOTALL)


def open_after(line: str, inside: bool, closed: re.Pattern) -> bool:
    """Whether a quoted cell is open at the line's end; inside: whether one was at its beginning."""
    if '"' not in line:
        return inside
    return closed.fullmatch('"' + line if inside else line) is None


def split_lines(spark: SparkSession, path: str, text: Column, line_end: str) -> DataFrame:
    """Lines in their splits' order, with the file and the offset where the split begins. text: the line from the column `value`."""
    return spark.read.option("lineSep", line_end).text(path).select(text.alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def _by_split(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """(columns but the line, lines) of the splits in each batch; a split goes on over batches."""
    for b in batches:
        lines = b.column("line").to_pylist()
        others = list(zip(*(b.column(c).to_pylist() for c in b.schema.names if c != "line")))
        at = 0
        for key, rows in groupby(others):
            n = sum(1 for _ in rows)
            yield key, lines[at : at + n]
            at += n


def _bare(line: str, first: bool) -> str:
    return line.removeprefix("\ufeff") if first else line


def effects(lines: DataFrame, delimiter: str) -> DataFrame:
    """One row a split: where it ends and how many records begin in it, for both beginnings. Empty lines outside cells are no records."""
    pattern = closed_line(delimiter)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, last = [], None
        for (path, start), part in _by_split(batches):
            fresh = (path, start) != last
            if fresh:
                last = (path, start)
                made.append([path, start, False, True, 0, 0])
            row = made[-1]
            out, inn, n_out, n_in = row[2:]
            for i, line in enumerate(part):
                line = _bare(line, fresh and not i and not start)
                if line not in ("", "\r"):
                    n_out += not out
                    n_in += not inn
                    if '"' in line:
                        out, inn = open_after(line, out, pattern), open_after(line, inn, pattern)
            row[2:] = out, inn, n_out, n_in
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["path", "start", "ends_out", "ends_in", "n_out", "n_in"])

    return lines.select("path", "start", "line").mapInArrow(walk, EFFECTS)


def beginnings(found: DataFrame) -> DataFrame:
    """path, start, inside (whether the split begins in a quoted cell), first (records before it), in_file (those of its file), headers (files with a record so far).

    An effect that ends alike either way settles what follows; otherwise it keeps or swaps. So a split's beginning is where the last settling one
    ended, swapped once for each swap since. found: one row a split, so a few for each gigabyte.
    """
    file = Window.partitionBy("path").orderBy("start")
    earlier = file.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.sum((F.col("ends_out") & ~F.col("ends_in")).cast("long")).over(file)
    t = found.withColumn("swaps", swaps)
    settled = F.when(F.col("ends_out") == F.col("ends_in"), F.struct("ends_out", "swaps"))
    t = t.withColumns({"settled": F.last(settled, ignorenulls=True).over(earlier), "swaps_before": F.coalesce(F.lag("swaps").over(file), F.lit(0))})
    odd = (F.col("swaps_before") - F.coalesce("settled.swaps", F.lit(0))) % 2 == 1
    t = t.withColumn("inside", F.coalesce("settled.ends_out", F.lit(False)) != odd)
    t = t.withColumn("n", F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out")))
    t = t.withColumn("in_file", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    order = Window.orderBy("path", "start")
    opens = ((F.col("in_file") == 0) & (F.col("n") > 0)).cast("long")
    t = t.withColumns({"first": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "headers": F.sum(opens).over(order)})
    return t.select("path", "start", "inside", "first", "in_file", "headers")


def parts(lines: DataFrame, begins: DataFrame, delimiter: str, line_end: str = "\n") -> DataFrame:
    """Records that lie in one split whole, and the parts of the others: RECORDS. Files' first records are their headers and left out."""
    pattern = closed_line(delimiter)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        inside, whole, nth = False, True, 0
        made: list[tuple] = []

        def put(done: bool) -> None:
            """The lines held are a record, or a part of one."""
            _, start, _, first, in_file, headers = last
            if in_file + nth > 0:  # else the header
                made.append((first + nth, first + nth - headers + 1, start, done, line_end.join(held)))
            held.clear()

        for key, part in _by_split(batches):
            fresh = key != last
            if fresh:
                if held:
                    put(False)
                last = key
                if key[2] is None:
                    raise RuntimeError("the file's splits changed while it was read; read it again")
                inside, whole = key[2], not key[2]
                nth = -1  # a split that begins inside goes on with the record before its first
            for i, line in enumerate(part):
                line = _bare(line, fresh and not i and not key[1])
                if not inside:
                    if line in ("", "\r"):
                        continue
                    nth += 1
                held.append(line)
                inside = open_after(line, inside, pattern)
                if not inside:
                    put(whole)
                    whole = True
            if made:
                yield _batch(made)
                made.clear()
        if held:
            put(False)
        if made:
            yield _batch(made)

    known = lines.join(F.broadcast(begins), ["path", "start"], "left")
    return known.select("path", "start", "inside", "first", "in_file", "headers", "line").mapInArrow(cut, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["record", "row_number", "start", "whole", "text"])


def records(pieces: DataFrame, line_end: str = "\n") -> DataFrame:
    """row_number and the text of every record, without its line end; only records across splits are moved."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), line_end)
    torn = pieces.where("NOT whole").groupBy("record", "row_number").agg(text.alias("text")).select("row_number", "text")
    both = pieces.where("whole").select("row_number", "text").unionByName(torn)
    return both.select("row_number", F.regexp_replace("text", "\r\\z", "").alias("text"))

"""Results by id: paging, role changes, filtered views, written exports, and what expires when."""

from __future__ import annotations

import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import facets, profile
from .assembly import q
from .graph import join_groups


@dataclass(frozen=True)
class Page:
    """Rows of one page, the totals behind it and whether more follow."""

    rows: list[dict]
    offset: int
    limit: int
    total: int
    unfiltered: int

    @property
    def has_more(self) -> bool:
        return self.offset + len(self.rows) < self.total


def page(df: DataFrame, offset: int, limit: int, order: Sequence[str] = ("row_number",), unfiltered: int | None = None) -> Page:
    total = df.count()
    rows = [r.asDict(recursive=True) for r in df.orderBy(*map(q, order)).offset(max(0, offset)).limit(max(0, limit)).collect()]
    return Page(rows, offset, limit, total, total if unfiltered is None else unfiltered)


def after(df: DataFrame, last: int | None, limit: int, order: str = "row_number") -> DataFrame:
    """Keyset paging: the rows after the last one seen; the filter reaches the scan, so deep pages cost what the first costs."""
    return (df if last is None else df.where(q(order) > last)).orderBy(q(order)).limit(limit)


def ngram_key(size: int, term: str) -> str:
    return f"{size}::{term.casefold()}"


def community_rows(rows: DataFrame, documents: DataFrame, group_order: DataFrame) -> DataFrame:
    """Rows with the community of their documents; a row in several takes the one last in the groups' order.

    documents: row_number, community; group_order: community, place, label.
    """
    last = join_groups(documents, group_order, ["community"]).groupBy("row_number").agg(F.max_by("community", "place").alias("community_id"), F.max_by("label", "place").alias("community_label"))
    return rows.join(last, "row_number")


def with_group(rows: DataFrame, documents: DataFrame, group_order: DataFrame, name: str = "community_group") -> DataFrame:
    """The label column, empty where a row is in no group."""
    last = community_rows(rows.select("row_number"), documents, group_order).select("row_number", F.col("community_label").alias(name))
    return rows.drop(name).join(last, "row_number", "left").withColumn(name, F.coalesce(name, F.lit("")))


def refiltered(documents: DataFrame, surviving: DataFrame, group: str = "community") -> DataFrame:
    """Counts and shares of the documents whose rows survive a filter; the model isn't run again."""
    kept = documents.join(surviving.select("row_number"), "row_number", "left_semi")
    counts = kept.groupBy(group).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total_documents"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.bround(F.col("count") / F.col("total_documents"), 4))


def refiltered_edges(edges: DataFrame, surviving_nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends survive."""
    n = surviving_nodes.select("node")
    return edges.join(n.toDF("src"), "src", "left_semi").join(n.toDF("dst"), "dst", "left_semi")


def write_csv(df: DataFrame, path: str, metadata: Sequence[str], verbatim: Sequence[str], scope: str = "clean_data", filters: Mapping[str, Sequence[str]] | None = None) -> None:
    """The table or its verbatim columns as CSV files with headers, in row order; each file begins with a byte-order mark; cells keep their white space."""
    if scope not in ("clean_data", "verbatim_only"):
        raise ValueError(f"unknown scope {scope!r}")
    if scope == "verbatim_only" and not verbatim:
        raise ValueError("there is no verbatim column to export")
    chosen = facets.apply_filters(df, filters, metadata)
    columns = [c for c in df.columns if c != "row_number"] if scope == "clean_data" else list(verbatim)
    ordered = chosen.orderBy("row_number").select(*map(q, columns))
    named = ordered.toDF("﻿" + columns[0], *columns[1:])  # the mark is part of the first header
    named.write.option("header", True).option("escape", '"').option("encoding", "UTF-8").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).mode("errorifexists").csv(path)


def export_name(source: str | None, scope: str, filtered: bool) -> str:
    stem = (source or "survey").rsplit("/", 1)[-1].rsplit(".", 1)[0] or "survey"
    return f"{stem}-{scope.replace('_', '-')}{'-filtered' if filtered else ''}.csv"


@dataclass
class Stored:
    table: DataFrame
    metadata: list[str]
    verbatim: list[str]
    owner: str | None
    at: float
    snapshots: dict[tuple, dict] = field(default_factory=dict)

    @property
    def analysis(self) -> DataFrame:
        return profile.analysis_table(self.table, self.metadata, self.verbatim)


class Results:
    """The most recent results, each for a limited time, one live result per owner.

    Tables are kept persisted and released on removal. The clock is a parameter for tests.
    """

    def __init__(self, most: int = 8, seconds: float = 10_800, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.clock = most, seconds, clock
        self.held: OrderedDict[str, Stored] = OrderedDict()

    def save(self, table: DataFrame, metadata: Sequence[str], verbatim: Sequence[str], owner: str | None = None) -> str:
        self.expire()
        if owner is not None:
            for k in [k for k, s in self.held.items() if s.owner == owner]:
                self.delete(k)
        key = uuid.uuid4().hex
        self.held[key] = Stored(table.persist(), list(metadata), list(verbatim), owner, self.clock())
        while len(self.held) > self.most:
            self.delete(next(iter(self.held)))
        return key

    def get(self, key: str) -> Stored:
        self.expire()
        if key not in self.held:
            raise KeyError(f"no result {key!r}")
        self.held.move_to_end(key)
        return self.held[key]

    def delete(self, key: str) -> bool:
        found = self.held.pop(key, None)
        if found is not None:
            found.table.unpersist()
        return found is not None

    def expire(self) -> int:
        old = [k for k, s in self.held.items() if self.clock() - s.at > self.seconds]
        return sum(map(self.delete, old))

    def set_role(self, key: str, column: str, role: str) -> Stored:
        """A column becomes metadata or verbatim; analyses made before no longer hold. Row numbers stay."""
        s = self.get(key)
        if column not in s.table.columns or column == "row_number":
            raise ValueError(f"unknown column {column!r}")
        if role not in ("metadata", "verbatim"):
            raise ValueError(f"unknown role {role!r}")
        order = [c for c in s.table.columns if c != "row_number"]
        sets = {"metadata": {*s.metadata} - {column}, "verbatim": {*s.verbatim} - {column}}
        sets[role].add(column)
        s.metadata, s.verbatim = ([c for c in order if c in sets[r]] for r in ("metadata", "verbatim"))
        s.snapshots.clear()
        return s

    def page(self, key: str, dataset: str = "analysis", offset: int = 0, limit: int = 100, filters: Mapping[str, Sequence[str]] | None = None) -> Page:
        s = self.get(key)
        if dataset not in ("analysis", "transformed"):
            raise ValueError(f"unknown dataset {dataset!r}")
        df = s.analysis if dataset == "analysis" else s.table
        return page(facets.apply_filters(df, filters, s.metadata), offset, limit, unfiltered=df.count())

    def snapshot(self, key: str, model: str, column: str, threshold: float | None, documents: DataFrame, filters: Mapping[str, Sequence[str]] | None) -> None:
        """Keep a finished analysis with the filter it was made under."""
        self.get(key).snapshots[model, column, None if threshold is None else round(threshold, 9)] = {"documents": documents, "filters": {k: set(v) for k, v in (filters or {}).items()}}

    def narrowed(self, key: str, model: str, column: str, threshold: float | None, filters: Mapping[str, Sequence[str]] | None) -> DataFrame | None:
        """A snapshot's groups under a filter, or None where none fits: the filter must ask for no more than the snapshot's own."""
        s = self.get(key)
        held = s.snapshots.get((model, column, None if threshold is None else round(threshold, 9)))
        wanted = {k: set(v) for k, v in (filters or {}).items()}
        if held is None or any(k not in wanted or not wanted[k] <= v for k, v in held["filters"].items()):
            return None
        return refiltered(held["documents"], facets.apply_filters(s.table, filters, s.metadata))


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts whose key isn't cached; texts and cache have the column `key`."""
    return texts.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def cached(texts: DataFrame, cache: DataFrame) -> DataFrame:
    return texts.join(cache, "key", "left")


def text_column(df: DataFrame, name: str) -> DataFrame:
    """row_number and the answers of a verbatim column that say something."""
    return df.select("row_number", X.answer(q(name)).alias("text")).where("text IS NOT NULL")

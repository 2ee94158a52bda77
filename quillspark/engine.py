"""The engine as a user meets it: ingest a file, analyse a column, page through the results, export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import providers
from .functions import text as X
from .operators import assembly, communities, facets, graph, layout, profile, report, store, terms, topics
from .operators import languages as L
from .operators.result_tables import ResultTables
from .plans import manifest as M
from .sources import csv_source

NODE = 4096  #: node numbers a row has at least


class AnalysisError(ValueError):
    """the request or the data can't be analysed."""


@dataclass(frozen=True)
class Settings:
    """Defaults that change results."""

    threshold: float = graph.THRESHOLD
    neighbours: int = graph.NEIGHBOURS
    resolution: float = graph.RESOLUTION
    mutual: bool = True
    top_terms: int = 6
    top_ngrams: int = 12
    examples: int = 3
    characters: int = 3000
    sample: int = 25

    @property
    def nodes(self) -> int:
        """Node numbers of a row: no answer has more fragments than characters."""
        return max(NODE, self.characters)


@dataclass
class Analysis:
    """Frames of a finished analysis; which are present depends on the model."""

    model: str
    column: str
    documents: DataFrame
    groups: DataFrame | None = None
    points: DataFrame | None = None
    edges: DataFrame | None = None
    ngrams: DataFrame | None = None
    ngram_documents: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, embedder: providers.Embedder | None = None, translator: providers.Translator | None = None, labels: providers.LabelService | None = None, diagnoser: M.Diagnoser | None = None, folder: str | None = None, languages: L.Model | None = None):
        """folder: a shared folder in which results outlive this session; without it they end with it. languages: a fitted model; without it function words tell."""
        self.spark, self.settings = spark, settings or Settings()
        self.results = store.Results() if folder is None else ResultTables(spark, folder)
        self.embedder, self.translator = embedder or providers.HashedEmbedder(), translator or providers.SameText()
        self.labels, self.diagnoser, self.languages = labels, diagnoser, languages
        self.cache: DataFrame | None = None

    def config(self) -> dict:
        return {"modes": ["rule_based", *(["ai"] if self.diagnoser else [])], **vars(self.settings)}

    # --- ingest --------------------------------------------------------------------------------------

    def ingest(self, path: str, mode: str = "rule_based", owner: str | None = None, manifest: M.Manifest | None = None) -> str:
        """Read, diagnose, assemble, find roles and store; returns the result's id."""
        table = csv_source.read_csv(self.spark, path)
        rows = [[r[f"c{i}"] for i in range(len(table.headers))] for r in table.head(self.settings.sample).collect()]
        manifest = manifest or M.diagnose(table.headers, rows, mode, self.diagnoser)
        wide, _ = assembly.transform(table, manifest)
        metadata, verbatim, _ = profile.roles(wide)
        return self.results.save(wide, metadata, verbatim, owner)

    def facets(self, key: str) -> DataFrame:
        s = self.results.get(key)
        return facets.definitions(s.table, s.metadata)

    def rows(self, key: str, dataset: str = "analysis", offset: int = 0, limit: int = 100, filters: Mapping[str, Sequence[str]] | None = None) -> store.Page:
        return self.results.page(key, dataset, offset, limit, filters)

    def set_role(self, key: str, column: str, role: str) -> None:
        self.results.set_role(key, column, role)

    def delete(self, key: str) -> bool:
        return self.results.delete(key)

    def export_csv(self, key: str, path: str, scope: str = "clean_data", filters: Mapping[str, Sequence[str]] | None = None) -> None:
        s = self.results.get(key)
        store.write_csv(s.table, path, s.metadata, s.verbatim, scope, filters)

    # --- analysis --------------------------------------------------------------------------------------

    def _documents(self, key: str, column: str, filters: Mapping[str, Sequence[str]] | None, language: str) -> tuple[DataFrame, list[str]]:
        s = self.results.get(key)
        if column not in s.verbatim:
            raise AnalysisError(f"{column!r} is not an open-text column")
        rows = facets.apply_filters(s.analysis, filters, s.metadata)
        counts = terms.usable_responses(rows, column).first()
        if not counts["analysed"]:
            raise AnalysisError("there is no response to analyse")
        warnings = [f"Skipped {counts[k]} {what}." for k, what in (("empty_or_placeholder", "empty or placeholder response(s)"), ("single_word", "single-word response(s)")) if counts[k]]
        if counts["analysed"] < 5:
            warnings.append("Fewer than five responses: groups say little.")
        docs = terms.prepare(rows, column, most=self.settings.characters)
        if self.languages is not None and language.lower() in ("", "auto"):
            docs = L.detected(docs, self.languages, ["row_number", "fragment_no"])
        else:
            docs = docs.withColumn("language", providers.detect_language(F.col("text"), F.lit(language)))
        translated = providers.translate(docs, self.translator)
        return translated.withColumns({"source_text": F.col("text"), "text": F.col("translated_text")}).drop("translated_text"), warnings

    def analyse(self, key: str, column: str, model: str = "community", filters: Mapping[str, Sequence[str]] | None = None, threshold: float | None = None, language: str = "auto") -> Analysis:
        """Run a model, or narrow a stored community analysis where the filter asks for no more than its own."""
        if model not in ("community", "ngrams"):
            raise AnalysisError(f"unknown model {model!r}")
        if model == "community" and (held := self.results.narrowed(key, model, column, threshold, filters)) is not None:
            return Analysis(model, column, documents=held, groups=held)
        docs, warnings = self._documents(key, column, filters, language)
        docs = self._kept(docs)
        if model == "ngrams":
            items = docs.withColumn("tokens", X.tokens(F.col("text")))
            tops = [terms.top_ngrams(items, n, self.settings.top_ngrams) for n in (1, 2, 3)]
            having = [terms.ngram_documents(items, n, t).withColumn("ngram_size", F.lit(n)) for n, t in zip((1, 2, 3), tops)]
            return Analysis(model, column, docs, ngrams=tops[0].unionByName(tops[1]).unionByName(tops[2]), ngram_documents=having[0].unionByName(having[1]).unionByName(having[2]), warnings=warnings)
        found = self._community(docs, column, threshold, warnings)
        self.results.snapshot(key, model, column, threshold, found.documents, filters)
        return found

    def _kept(self, df: DataFrame) -> DataFrame:
        """Written once in the shared folder, so plans stay short and lost executors cost nothing done; a cluster without such a folder is an error."""
        return graph.written(df, "kept")

    def _community(self, docs: DataFrame, column: str, threshold: float | None, warnings: list[str]) -> Analysis:
        if docs.select(X.fold(F.col("text"))).distinct().limit(2).count() < 2:
            raise AnalysisError("at least two different responses are needed")
        node = F.col("row_number") * self.settings.nodes + F.col("fragment_no")
        embedded, self.cache = providers.embed(docs.withColumn("node", node), self.embedder, cache=self.cache)
        self.cache = self._kept(self.cache)
        vectors = self._kept(graph.unit_vectors(embedded, "node", "embedding", "language"))
        v = vectors.select("node", "v")
        s = self.settings
        assigned, edges = communities.run(v, s.threshold if threshold is None else threshold, s.neighbours, s.resolution, s.mutual, vectors.select("node", F.col("language").alias("lang")))
        grouped = self._kept(docs.withColumn("node", node).join(assigned, "node").select("row_number", "fragment_no", "community", "text"))
        labeler = self._labeler(warnings) if self.labels is not None else None
        placed, groups, aliases = topics.analyse(grouped, labeler=labeler, top=s.top_terms)
        placed = self._kept(placed)
        label = groups.select(F.col("id").alias("community"), F.when(F.col("noise"), topics.NOISE_LABEL).otherwise(F.col("label")).alias("label"))
        final = topics.summaries(placed.select("row_number", "fragment_no", "community", "text"), top=s.top_terms, examples=s.examples).drop("label").join(label, "community", "left")
        final = final.withColumn("label", F.coalesce("label", F.lit(topics.NOISE_LABEL)))
        final = final.withColumn("comment", X.group_comment(F.col("label"), F.col("count"), F.col("total_documents"), F.col("example_rows")))
        places = graph.circle(v) if edges.isEmpty() else layout.forced_layout(graph.principal_layout(v), edges)
        nodes = placed.select((F.col("row_number") * s.nodes + F.col("fragment_no")).alias("node"), "row_number", "community")
        points = graph.plot_points(nodes.select("node", "community"), places, nodes.select("node", "row_number"))
        return Analysis("community", column, placed, final, points, graph.plot_edges(edges, points), warnings=warnings)

    def _labeler(self, warnings: list[str]):
        labelling = providers.Labelling(self.labels, warnings=warnings)

        def run(groups: DataFrame, docs: DataFrame) -> DataFrame:
            """A row a group; groups reach the service, which answers the driver, a batch at a time."""
            known = groups.where(~F.col("noise")).join(topics.evidence(docs).withColumnRenamed("community", "id"), "id", "left").select("id", "terms", "texts").orderBy("id")
            found: dict[str, str] = {}
            rows = known.toLocalIterator()
            while part := list(islice(rows, labelling.batch)):
                found |= labelling([{"group_id": r["id"], "terms": list(r["terms"]), "texts": [*r["terms"], *(r["texts"] or ())]} for r in part])
            return self.spark.createDataFrame([(int(k), v) for k, v in found.items()], "id long, label string")

        return run

    def translate_outputs(self, analysis: Analysis) -> Analysis:
        """The analysis with labels and terms translated for display; the comments follow the labels."""
        groups, ngrams = analysis.groups, analysis.ngrams
        if groups is not None and "comment" in groups.columns:
            groups = providers.translate_outputs(groups, self.translator, "label", F.col("label") == topics.NOISE_LABEL)
            groups = groups.withColumn("comment", X.group_comment(F.col("label"), F.col("count"), F.col("total_documents"), F.col("example_rows")))
        if ngrams is not None:
            ngrams = providers.translate_outputs(ngrams, self.translator, "term")
        return replace(analysis, groups=groups, ngrams=ngrams)

    # --- results -------------------------------------------------------------------------------------

    def group_documents(self, analysis: Analysis, community: int, offset: int = 0, limit: int = 100) -> store.Page:
        return store.page(analysis.documents.where(F.col("community") == community), offset, min(limit, 500), ("rank",))

    def ngram_documents(self, analysis: Analysis, size: int, term: str, offset: int = 0, limit: int = 100) -> store.Page:
        wanted = store.ngram_key(size, term)
        docs = analysis.ngram_documents.where(F.concat_ws("::", "ngram_size", "term") == wanted)
        return store.page(docs, offset, min(limit, 500), ("row_number", "fragment_no"))

    def report(self, analysis: Analysis, title: str, kind: str = "docx", filters: dict[str, Sequence[str]] | None = None) -> bytes:
        if kind not in report.WRITERS:
            raise ValueError(f"unknown report kind {kind!r}")
        if analysis.model == "ngrams":
            made = report.ngram_report(analysis.ngrams, analysis.ngram_documents, title, filters)
        else:
            first = analysis.documents.where(F.col("rank") <= self.settings.examples)
            made = report.build(analysis.groups, first, title, filters)
        return report.WRITERS[kind](made)

    def translate(self, texts: Sequence[str], language: str = "auto") -> list[str]:
        df = self.spark.createDataFrame([(i, t, language) for i, t in enumerate(texts)], "i long, text string, language string")
        return [r["translated_text"] for r in providers.translate(df, self.translator).orderBy("i").collect()]

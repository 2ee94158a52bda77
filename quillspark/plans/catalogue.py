"""Registry of the engine's own queries over the driver's tables, and their SQL twins.

The tables stand in for survey exports: `documents` for answers with language and source as metadata,
`conversations` and `events` for vertical tables, `part` and `orders` for wide ones, `embeddings` for
answers' vectors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import providers
from ..functions import text as X
from ..functions.words import LEADING_TRIM, RELEVANCE_STOPWORDS, STOPWORDS, TRAILING_TRIM
from ..operators import assembly, communities, facets, graph, languages, layout as forces, neighbours, profile, rank, report, store, survey, terms, topics
from ..operators.result_tables import ResultTables
from ..sources import csv_source
from . import manifest as M

QUERIES: dict = {}
ORACLE: dict = {}

#: The similarity that gives the driver's random vectors a sparse graph; the default leaves none.
SIMILARITY = 0.35


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """documents as fragments of one each."""
    return load(spark, sf, "documents").select(F.col("doc_id").alias("row_number"), F.lit(0).alias("fragment_no"), "text", "lang", "source")


# --- SQL parts -----------------------------------------------------------------------------------


def _words(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _fold(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def _tokens(c: str) -> str:
    return rf"list_filter(regexp_extract_all({_fold(f"coalesce({c}, '')")}, '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 2 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({_words(STOPWORDS)}))"


def _relevance(c: str) -> str:
    return f"list_filter(regexp_extract_all({_fold(f"coalesce({c}, '')")}, '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_words(RELEVANCE_STOPWORDS)}))"


def _grams(tokens: str, n: int) -> str:
    return f"CASE WHEN len({tokens}) >= {n} THEN list_transform(range(1, len({tokens}) - {n - 2}), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' ')) ELSE [] END"


def _occurrences(n: int, group: str = "") -> str:
    """CTEs ending in o(row, group, term)."""
    g = f"{group}, " if group else ""
    return f"t AS (SELECT doc_id AS r, {g}text, {_tokens('text')} AS w FROM documents), o AS (SELECT r, {g}unnest({_grams('w', n)}) AS term FROM t)"


def _clean(c: str) -> str:
    return rf"trim(regexp_replace(trim(translate({c}, '‘’`´′' || chr(146) || chr(65279), ''''''''''''''), E' \t\n\r\f\x0b'), '''+$', ''), E' \t\n\r\f\x0b')"


# --- text --------------------------------------------------------------------------------------


@query(
    f"""WITH c AS (SELECT doc_id, {_clean("text")} AS c FROM documents),
    s AS (SELECT doc_id, CASE WHEN {_fold("c")} NOT IN ('', 'n/a', 'na', 'none', 'null', '.', '-', '<na>', 'nan') THEN c END AS cleaned FROM c)
    SELECT doc_id, md5(cleaned) AS cleaned_md5, length(cleaned) AS cleaned_chars, length(trim(regexp_replace(cleaned, '\\s+', ' ', 'g'))) AS collapsed_chars FROM s"""
)
def text_clean(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", X.clean_cell(F.col("text"), M.NULLS).alias("c"))
    return d.select("doc_id", F.md5("c").alias("cleaned_md5"), F.char_length("c").cast("long").alias("cleaned_chars"), F.char_length(X.collapse(F.col("c"))).cast("long").alias("collapsed_chars"))


PROFILED = {"documents": ("text", "lang", "source"), "part": ("p_name", "p_brand", "p_type")}


@query(
    r"""WITH v AS (SELECT 'documents.' || col AS col, trim(val, E' \t\n\r\f\x0b') AS v FROM (UNPIVOT (SELECT text, lang, source FROM documents) ON text, lang, source INTO NAME col VALUE val)
        UNION ALL SELECT 'part.' || col, trim(val, E' \t\n\r\f\x0b') FROM (UNPIVOT (SELECT p_name, p_brand, p_type FROM part) ON p_name, p_brand, p_type INTO NAME col VALUE val)),
    c AS (SELECT col, v, count(*) AS n FROM v WHERE v <> '' GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS place FROM c)
    SELECT col AS "column", sum(n)::BIGINT AS n, count(*) AS distinct_n, round_even(sum(n * length(v)) / sum(n), 6) AS mean_length,
        round_even(sum(CASE WHEN length(v) >= 25 THEN n ELSE 0 END) / sum(n), 6) AS long_ratio,
        round_even(sum(CASE WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN n ELSE 0 END) / sum(n), 6) AS numeric_ratio,
        round_even(sum(CASE WHEN regexp_matches(v, '\p{L}') THEN n ELSE 0 END) / sum(n), 6) AS text_ratio,
        round_even(sum(CASE WHEN place <= 5 THEN n ELSE 0 END) / sum(n), 6) AS top5, round_even(sum(CASE WHEN place <= 10 THEN n ELSE 0 END) / sum(n), 6) AS top10
    FROM k GROUP BY col"""
)
def text_profile(spark, sf):
    found = None
    for name, columns in PROFILED.items():
        df = load(spark, sf, name)
        one = profile.value_profile(profile.unpivoted(df, columns, df.columns[0])).withColumn("column", F.concat(F.lit(f"{name}."), "column"))
        found = one if found is None else found.unionByName(one)
    ratios = ["mean_length", "long_ratio", "numeric_ratio", "text_ratio", "top5", "top10"]
    return found.select("column", "n", "distinct_n", *[F.bround(c, 6).alias(c) for c in ratios])


@query(
    r"""WITH v AS (SELECT 'pages.url' AS col, trim(url) AS v FROM pages UNION ALL SELECT 'customer.c_name', trim(c_name) FROM customer)
    SELECT col AS "column", round_even(avg(CASE WHEN v <> '' AND NOT contains(v, ' ') AND (regexp_full_match(lower(v), '[0-9a-f]{6,}(?:-[0-9a-f]{2,}){2,}')
        OR (length(v) >= 12 AND contains(v, '-') AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]'))) THEN 1.0::DOUBLE ELSE 0 END), 6) AS identifier_ratio FROM v WHERE v <> '' GROUP BY col"""
)
def identifier_ratio(spark, sf):
    long = profile.unpivoted(load(spark, sf, "pages"), ["url"], "page_id").withColumn("column", F.lit("pages.url"))
    long = long.unionByName(profile.unpivoted(load(spark, sf, "customer"), ["c_name"], "c_custkey").withColumn("column", F.lit("customer.c_name")))
    return long.groupBy("column").agg(F.bround(F.avg(profile.is_identifier().cast("double")), 6).alias("identifier_ratio"))


@query(
    rf"""WITH c AS (SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    a AS (SELECT CASE WHEN {_fold("t")} NOT IN ('', 'na', 'n/a', 'nan', 'none', 'null', 'nil', '-', '--') THEN t END AS t FROM c),
    s AS (SELECT t, coalesce(len(list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}_'']*[\p{{L}}\p{{N}}_])?'), lambda w: trim(w, '_''') <> '')) = 1, false) AS single FROM a)
    SELECT count(*) AS total, count(*) FILTER (t IS NULL) AS empty_or_placeholder, count(*) FILTER (single) AS single_word, count(*) FILTER (t IS NOT NULL AND NOT single) AS analysed FROM s"""
)
def usable_responses(spark, sf):
    return terms.usable_responses(load(spark, sf, "documents"), "text")


@query(
    rf"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    a AS (SELECT doc_id, t FROM c WHERE {_fold("t")} NOT IN ('', 'na', 'n/a', 'nan', 'none', 'null', 'nil', '-', '--')),
    s AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, '[^.]+\.'), lambda x: trim(x)) AS chunks FROM a),
    k AS (SELECT doc_id, t, CASE WHEN len(chunks) >= 2 AND array_to_string(chunks, ' ') = t THEN 'sentences' WHEN contains(t, '.') THEN 'whole' ELSE 'commas' END AS kind FROM s)
    SELECT kind, count(*) AS n, sum(length(t))::BIGINT AS chars FROM k GROUP BY kind"""
)
def fragment_kinds(spark, sf):
    """Which of the three ways of cutting applies to an answer (before chunks are validated)."""
    a = load(spark, sf, "documents").select(X.answer(F.col("text")).alias("t")).where("t IS NOT NULL")
    kind = F.when(X.covers(X.sentences(F.col("t")), F.col("t")), "sentences").when(F.col("t").contains("."), "whole").otherwise("commas")
    return a.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.char_length("t")).alias("chars"))


@query()
def fragments(spark, sf):
    """Sentences and clauses of whole answers with continuations merged; checked against a plain statement of the rule in the tests."""
    return terms.prepare(load(spark, sf, "documents"), "text", order="doc_id", most=None)


@query(
    r"""WITH a AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, md5(CASE WHEN length(t) > 3000 THEN rtrim(t[1:3000]) ELSE t END) AS capped_md5, md5(CASE WHEN length(t) <= 160 THEN t ELSE rtrim(t[1:157]) || '...' END) AS short_md5,
        length(CASE WHEN length(t) <= 160 THEN t ELSE rtrim(t[1:157]) || '...' END) AS short_chars FROM a"""
)
def capped_answers(spark, sf):
    """Answers at the setting's limit of characters, and as a report shows them."""
    d = load(spark, sf, "documents").select("doc_id", X.capped(X.collapse(F.col("text"))).alias("capped"), X.shortened(F.col("text"), 160).alias("short"))
    return d.select("doc_id", F.md5("capped").alias("capped_md5"), F.md5("short").alias("short_md5"), F.char_length("short").cast("long").alias("short_chars"))


@query(
    r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_](?:[\p{L}\p{N}_'']*[\p{L}\p{N}_])?')) AS words FROM documents"""
)
def word_counts(spark, sf):
    """X13."""
    return load(spark, sf, "documents").select("doc_id", X.word_count(F.col("text")).cast("long").alias("words"))


@query(
    """SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
        CASE WHEN p_size % 5 = 0 THEN 'auto' WHEN p_size % 5 = 1 THEN 'zh-CN' WHEN p_size % 5 = 2 THEN 'zh-TW' WHEN p_size % 5 = 3 THEN 'pt' ELSE 'De' END AS language,
        sha256('local' || chr(31) || p_type || chr(31) || p_size || chr(31) || p_name) AS cache_key FROM part"""
)
def names_and_keys(spark, sf):
    """Cache keys, language codes, and names for files."""
    code = F.element_at(F.array(*[F.lit(x) for x in (" auto ", "ZH-cn", "zh-TW", "pt-BR", " De ")]), F.col("p_size").cast("int") % 5 + 1)
    name = F.concat_ws(" / ", "p_name", "p_brand")
    return load(spark, sf, "part").select("p_partkey", X.slug(name).alias("slug"), X.language_code(code).alias("language"), X.cache_key(F.lit("local"), F.col("p_type"), F.col("p_size"), F.col("p_name")).alias("cache_key"))


@query(
    """WITH w AS (SELECT doc_id, ' ' || replace(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), 'ß', 'ss') || ' ' AS t, text FROM documents),
    n AS (SELECT doc_id, text, len(regexp_extract_all(t, ' the ')) + len(regexp_extract_all(t, ' and ')) + len(regexp_extract_all(t, ' of ')) AS en, len(regexp_extract_all(t, ' der ')) + len(regexp_extract_all(t, ' die ')) + len(regexp_extract_all(t, ' und ')) AS de,
        len(regexp_extract_all(t, ' le ')) + len(regexp_extract_all(t, ' les ')) + len(regexp_extract_all(t, ' et ')) AS fr, len(regexp_extract_all(t, ' el ')) + len(regexp_extract_all(t, ' los ')) + len(regexp_extract_all(t, ' y ')) AS es FROM w)
    SELECT doc_id, CASE WHEN length(trim(text, E' \\t\\n\\r\\f\\x0b')) < 8 OR text IS NULL OR greatest(en, de, fr, es) = 0 THEN NULL WHEN en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(en, de, fr, es) THEN 'de' WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS guess FROM n"""
)
def language_guess(spark, sf):
    """The default detector by function words."""
    return load(spark, sf, "documents").select("doc_id", providers.detect_language(F.col("text")).alias("guess"))


@query(
    """WITH c AS (SELECT doc_id, lang, CASE WHEN lang = 'en' OR doc_id % 2 = 0 THEN source ELSE lang END AS community FROM documents),
    z AS (SELECT community, count(*) AS size FROM c GROUP BY community), b AS (SELECT community, lang, count(*) AS n FROM c WHERE lang NOT IN ('', 'auto', 'en') GROUP BY community, lang QUALIFY row_number() OVER (PARTITION BY community ORDER BY n DESC, lang DESC) = 1)
    SELECT community, lang FROM b JOIN z USING (community) WHERE size >= 4 AND n >= 0.75 * size"""
)
def dominant_languages(spark, sf):
    """The languages other than English that rule a community."""
    d = load(spark, sf, "documents").withColumn("node", F.col("doc_id"))
    own = F.when((F.col("lang") == "en") | (F.col("doc_id") % 2 == 0), F.col("source")).otherwise(F.col("lang"))
    return graph.dominant_language(d.select("node", own.alias("community")), d.select("node", "lang"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY 31 * c_custkey + c_nationkey) AS row_number FROM customer")
def renumbered_rows(spark, sf):
    """Row numbers with gaps become consecutive."""
    return assembly.renumber(load(spark, sf, "customer").select("c_custkey", (31 * F.col("c_custkey") + F.col("c_nationkey")).cast("long").alias("row_number")))


@query(
    """SELECT o_orderkey, CASE WHEN o_custkey % 4 < 2 THEN o_custkey END::BIGINT AS user_id,
        CASE o_custkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus ELSE '__MISSING_TITLE__' END AS full_title_norm, CASE WHEN o_custkey % 3 = 2 THEN '__MISSING_MAIN__' ELSE o_orderstatus END AS main_title_norm FROM orders"""
)
def survey_titles(spark, sf):
    """User ids that aren't whole numbers are null, titles fall back and are normalised."""
    k = F.col("o_custkey")
    user = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(k.cast("string"), F.lit(".0"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit(".5"))).otherwise(F.lit("x"))
    full = F.when(k % 3 == 0, F.concat(F.lit(" "), "o_orderpriority", F.lit("’")))
    main = F.when(k % 3 == 2, F.lit("  ")).otherwise(F.concat(F.col("o_orderstatus"), F.lit("﻿ ")))
    return survey.prepared(load(spark, sf, "orders").select("o_orderkey", user.alias("user_id"), full.alias("full_title"), main.alias("main_title"))).select("o_orderkey", "user_id", "full_title_norm", "main_title_norm")


def survey_events(spark, sf) -> DataFrame:
    """events as a long survey: country from the user, two main titles, the type as full title; small values count as no answer."""
    e = load(spark, sf, "events")
    country = F.when(F.col("user_id") % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("country "), (F.col("user_id") % 5).cast("string")))
    main = F.when(F.col("event_type").isin("click", "view"), "Use").otherwise("Other")
    return e.select(F.col("event_id").alias("row_number"), "user_id", country.alias("country"), main.alias("main_title_norm"), F.col("event_type").alias("full_title_norm"), F.when(F.col("value") > 5, F.col("value").cast("string")).alias("answer_value"))


_SURVEY = """l AS (SELECT user_id, 'country ' || (user_id % 5) AS country, CASE WHEN event_type IN ('click', 'view') THEN 'Use' ELSE 'Other' END AS main_title_norm, event_type AS full_title_norm,
    arg_max(value, event_id) AS answer FROM events WHERE user_id % 5 <> 0 AND value > 5 GROUP BY ALL)"""


@query(f"WITH {_SURVEY} SELECT user_id, country, main_title_norm, full_title_norm, answer FROM l")
def survey_answers(spark, sf):
    """P18 in long form."""
    return survey.answers_long(survey_events(spark, sf)).withColumn("answer", F.col("answer").cast("double"))


@query(
    f"""WITH {_SURVEY} SELECT user_id, country, max(answer) FILTER (full_title_norm = 'click') AS "Use | click", max(answer) FILTER (full_title_norm = 'error') AS "Other | error", max(answer) FILTER (full_title_norm = 'purchase') AS "Other | purchase",
    max(answer) FILTER (full_title_norm = 'signup') AS "Other | signup", max(answer) FILTER (full_title_norm = 'view') AS "Use | view" FROM l GROUP BY user_id, country"""
)
def survey_answers_wide(spark, sf):
    """P18 for export."""
    titles = [("Use", "click"), ("Other", "error"), ("Other", "purchase"), ("Other", "signup"), ("Use", "view")]
    made = survey.answers_wide(survey.answers_long(survey_events(spark, sf)), titles)
    return made.select("user_id", "country", *[F.col(f"`{' | '.join(t)}`").cast("double").alias(" | ".join(t)) for t in titles])


@query(f"WITH {_SURVEY} SELECT user_id, full_title_norm AS full_title, answer FROM l WHERE main_title_norm = 'Use'")
def survey_question_texts(spark, sf):
    """One main question chosen, its texts by user."""
    chosen = survey.select_questions(survey.answers_long(survey_events(spark, sf)), [" Use' "])
    return survey.question_texts(chosen, "Use ").select("user_id", "full_title", F.col("text").cast("double").alias("answer"))


@query("SELECT doc_id, source, md5(text) AS text_md5 FROM documents WHERE trim(text, E' \\t\\n\\r\\f\\x0b') <> ''")
def analysis_rows(spark, sf):
    """The role columns of rows that have an answer."""
    return profile.analysis_table(load(spark, sf, "documents"), ["source"], ["text"], True, "doc_id").select("doc_id", "source", F.md5("text").alias("text_md5"))


@query(
    """WITH p AS (SELECT md5(p_name || '/' || p_type || '/' || p_size) AS key, p_partkey, p_size FROM part), h AS (SELECT DISTINCT key FROM p WHERE p_size > 25)
    SELECT key, 'miss' AS state, min(p_partkey) AS partkey FROM p WHERE key NOT IN (SELECT key FROM h) GROUP BY key
    UNION ALL SELECT key, CASE WHEN key IN (SELECT key FROM h) THEN 'hit' ELSE 'none' END, p_partkey FROM p"""
)
def cache_lookup(spark, sf):
    """Texts that must be sent, once each, and every text with what the cache holds of it."""
    p = load(spark, sf, "part").select(F.md5(F.concat_ws("/", "p_name", "p_type", "p_size")).alias("key"), "p_partkey", "p_size")
    known = p.where("p_size > 25").select("key", F.lit("hit").alias("state")).distinct()
    misses = store.cache_misses(p, known).select("key").join(p.groupBy("key").agg(F.min("p_partkey").alias("partkey")), "key").select("key", F.lit("miss").alias("state"), "partkey")
    return misses.unionByName(store.cached(p, known).select("key", F.coalesce("state", F.lit("none")).alias("state"), F.col("p_partkey").alias("partkey")))


class Bracketed:
    """A stand-in for a translation service."""

    def translate(self, texts):
        return [f"[{t}]" for t in texts]


@query(
    """SELECT doc_id AS row_number, CASE WHEN lang <> 'en' THEN md5(trim(regexp_replace('[' || text || ']', '\\s+', ' ', 'g'))) ELSE md5(text) END AS translated_md5, lang <> 'en' AS translated FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL"""
)
def translated_answers(spark, sf):
    """Distinct foreign texts go through the translator in batches; a stand-in puts brackets round them."""
    d = load(spark, sf, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("doc_id").alias("row_number"), "text", F.col("lang").alias("language"))
    return providers.translate(d, Bracketed()).select("row_number", F.md5("translated_text").alias("translated_md5"), "translated")


@query(
    r"""WITH t AS (SELECT doc_id, lang, length(trim(text)) AS size, string_split(regexp_replace(' ' || regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g') || ' ', ' +', ' ', 'g'), '') AS c FROM documents),
    g AS (SELECT doc_id, lang, size, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM t),
    n AS (SELECT lang, gram, count(*) AS n FROM g WHERE lang IS NOT NULL GROUP BY ALL),
    v AS (SELECT DISTINCT gram FROM (SELECT gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM n) WHERE r <= 2000),
    a AS (SELECT l.lang, v.gram, coalesce(n.n, 0) AS n FROM v CROSS JOIN (SELECT DISTINCT lang FROM n) l LEFT JOIN n ON n.gram = v.gram AND n.lang = l.lang),
    w AS (SELECT lang, gram, round(1000 * ln((n + 1) / (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))))::BIGINT AS w FROM a),
    s AS (SELECT doc_id, w.lang, sum(w) AS s FROM g JOIN w USING (gram) WHERE size >= 8 GROUP BY ALL),
    b AS (SELECT doc_id, min(lang) AS guess FROM (SELECT *, max(s) OVER (PARTITION BY doc_id) AS top FROM s) WHERE s = top GROUP BY doc_id)
    SELECT doc_id, guess FROM documents LEFT JOIN b USING (doc_id)"""
)
def language_model(spark, sf):
    """The language of every whole text by a model of letter triples fitted on all labelled texts."""
    d = load(spark, sf, "documents").select("doc_id", "text", "lang")
    return languages.detected(d, languages.fit(d, language="lang"), ["doc_id"], name="guess").select("doc_id", "guess")


@query("SELECT doc_id::VARCHAR AS doc_id, md5(nullif(text, '')) AS text_md5, source, (SELECT count(*) FROM documents) AS rows, (SELECT count(*) FROM documents) AS last_row FROM documents")
def csv_round_trip(spark, sf):
    """The table as a CSV export, read back with its encoding, separator and headers found; row numbers are consecutive."""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("row_number"), "doc_id", "text", "source")
    path = f"{graph.shared_folder(spark)}/export-{uuid.uuid4().hex}"
    store.write_csv(d, path, ["source"], ["text"])
    table = csv_source.read_csv(spark, path)
    cells = table.frame.select("row_number", *[F.col(f"c{i}").alias(h) for i, h in enumerate(table.headers)])
    numbers = cells.agg(F.count_distinct("row_number").alias("rows"), F.max("row_number").alias("last_row"))  # one row
    n = numbers.first()
    return cells.select("doc_id", F.md5("text").alias("text_md5"), "source", F.lit(n["rows"]).alias("rows"), F.lit(n["last_row"]).alias("last_row"))


_QUESTIONS = [f"Question {i}:" + f" how much of part {i} did you see, and why?" * 40 for i in range(1, 61)]  # over 64 KiB of headers


@query(
    f"""SELECT doc_id::VARCHAR AS doc_id, {len(_QUESTIONS) + 1} AS columns, md5(array_to_string(list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(34), '      '), ' ')[1:{len(_QUESTIONS)}], lambda w: w <> ''), '|')) AS cells_md5
    FROM documents"""
)
def csv_long_headers(spark, sf):
    """An export whose header record is longer than the first look at the file, read back with all its columns under their names."""
    words = F.split(F.translate("text", '\t\n\x0b\f\r"', " " * 6), " ")
    d = load(spark, sf, "documents").select("doc_id", *[F.get(words, i).alias(q) for i, q in enumerate(_QUESTIONS)])
    path = f"{graph.shared_folder(spark)}/export-{uuid.uuid4().hex}"
    d.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    table = csv_source.read_csv(spark, path)
    cells = [F.nullif(F.col(f"c{table.headers.index(q)}"), F.lit("")) for q in _QUESTIONS]
    return table.frame.select(F.col("c0").alias("doc_id"), F.lit(len(table.headers)).alias("columns"), F.md5(F.concat_ws("|", *cells)).alias("cells_md5"))


# --- vertical and wide assembly ------------------------------------------------------------------


@query("SELECT conv_id, role, arg_max(text, turn) AS answer FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL GROUP BY conv_id, role")
def vertical_dedupe(spark, sf):
    c = load(spark, sf, "conversations")
    return assembly.last_answers(assembly.drop_invalid(c, ["conv_id"], "role", "text"), ["conv_id"], "role", "text", "turn").withColumnRenamed("text", "answer")


@query(
    """WITH a AS (SELECT conv_id, role, arg_max(text, turn) AS answer FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL GROUP BY conv_id, role),
    m AS (SELECT conv_id, arg_min(role, turn) AS opener FROM conversations GROUP BY conv_id)
    SELECT m.conv_id, opener, max(answer) FILTER (role = 'system') AS system, max(answer) FILTER (role = 'user') AS "user", max(answer) FILTER (role = 'assistant') AS assistant
    FROM m LEFT JOIN a USING (conv_id) GROUP BY m.conv_id, opener"""
)
def vertical_pivot(spark, sf):
    c = load(spark, sf, "conversations")
    last = assembly.last_answers(assembly.drop_invalid(c, ["conv_id"], "role", "text"), ["conv_id"], "role", "text", "turn")
    wide = assembly.pivot_answers(last, ["conv_id"], "role", "text", ["system", "user", "assistant"])
    people = assembly.first_values(c.withColumn("opener", F.col("role")), ["conv_id"], ["opener"], "turn").drop("turn")
    return people.join(wide, "conv_id", "left")


@query(
    """SELECT user_id, """
    + ", ".join(f"arg_max(value, event_id) FILTER (event_type = '{t}') AS \"{t}\"" for t in ("click", "error", "purchase", "signup", "view"))
    + " FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL AND user_id IS NOT NULL GROUP BY user_id"
)
def event_pivot(spark, sf):
    e = load(spark, sf, "events")
    last = assembly.last_answers(assembly.drop_invalid(e, ["user_id"], "event_type", "value"), ["user_id"], "event_type", "value", "event_id")
    return assembly.pivot_answers(last, ["user_id"], "event_type", "value", ["click", "error", "purchase", "signup", "view"])


@query(
    """SELECT user_id, arg_min(CASE WHEN event_type <> 'view' THEN event_type END, event_id) FILTER (event_type <> 'view') AS first_type,
    arg_min(value, event_id) FILTER (value > 50) AS first_large, min(event_id) AS event_id FROM events GROUP BY user_id"""
)
def first_non_null(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("first_type"), F.when(F.col("value") > 50, F.col("value")).alias("first_large"))
    return assembly.first_values(e, ["user_id"], ["first_type", "first_large"], "event_id")


@query(
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, '__MISSING_TITLE__') AS title FROM orders"""
)
def question_coalesce(spark, sf):
    o = load(spark, sf, "orders").withColumns({"first": F.when(F.col("o_orderstatus") == "F", " nan ").otherwise(F.col("o_orderstatus")), "second": F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority"))})
    return o.select("o_orderkey", F.coalesce(X.usable_title(F.col("first")), X.usable_title(F.col("second")), F.lit(survey.MISSING_TITLE)).alias("title"))


@query("SELECT p_partkey, concat_ws(', ', CASE WHEN p_size > 10 THEN p_brand END, nullif(trim(p_type), ''), nullif(trim(p_name), '')) AS \"Top words\" FROM part")
def multipart_concat(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise(" ").alias("24.1: Top words: Word 1"), F.col("p_type").alias("24.2: Top words: Word 2"), F.col("p_name").alias("24.3: Top words: Word 3"))
    from ..operators.headers import multipart

    return assembly.merge_parts(p, multipart(p.columns[1:], []), "p_partkey")


@query(
    """SELECT p_partkey AS user_id, q AS full_title, trim(v) AS text FROM (UNPIVOT (SELECT p_partkey, p_brand, p_type, p_name FROM part) ON p_brand, p_type, p_name INTO NAME q VALUE v)
    WHERE lower(trim(v)) NOT IN ('', 'nan', '<na>', 'none')"""
)
def unpivot_question(spark, sf):
    p = load(spark, sf, "part")
    long = p.unpivot("p_partkey", ["p_brand", "p_type", "p_name"], "full_title_norm", "answer").select(F.col("p_partkey").alias("user_id"), F.lit("About the part").alias("main_title_norm"), "full_title_norm", "answer")
    return survey.question_records(long, "About the part")


@query(
    """WITH l AS (SELECT doc_id, min(CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END) AS g FROM labels GROUP BY doc_id)
    SELECT d.doc_id, coalesce(CASE WHEN lang <> 'en' THEN lang END, g) AS career_group FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id"""
)
def backfill_join(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", " ").otherwise(F.col("lang")).alias("career_group"))
    source = load(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("career_group"))
    filled = survey.backfill(d, source, ["doc_id"], ["career_group"])
    return filled.withColumn("career_group", survey.filled(F.col("career_group")))


@query(
    """WITH u AS (SELECT user_id, count(*) AS n, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS a FROM events GROUP BY user_id)
    SELECT sum(n)::BIGINT AS total_rows, count(user_id) AS total_users, count(*) FILTER (a = 1 AND user_id IS NOT NULL) AS users_with_any_answer, count(*) FILTER (a = 0 AND user_id IS NOT NULL) AS users_with_no_answers FROM u"""
)
def answer_coverage(spark, sf):
    return survey.coverage(load(spark, sf, "events").select("user_id", F.when(F.col("event_type") == "purchase", "yes").otherwise(" ").alias("answer_value")))


@query("SELECT c_custkey, c_name, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE lower(trim(n_name)) = 'nation_3'")
def country_filter(spark, sf):
    c = load(spark, sf, "customer").join(F.broadcast(load(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nations are few by definition
    return facets.by_country(c.select("c_custkey", "c_name", F.col("n_name").alias("country")), " Nation_3 ")


# --- facets, filters, pages -------------------------------------------------------------------


@query(
    """SELECT 'lang' AS "column", lang AS value, count(*) AS n, min(doc_id) AS first_seen FROM documents WHERE trim(lang) <> '' GROUP BY lang
    UNION ALL SELECT 'source', source, count(*), min(doc_id) FROM documents WHERE trim(source) <> '' GROUP BY source"""
)
def facet_counts(spark, sf):
    return facets.value_counts(load(spark, sf, "documents"), ["lang", "source"], "doc_id")


@query(
    """WITH c AS (SELECT 'c_mktsegment' AS col, 'C Mktsegment' AS display_name, c_mktsegment AS value, count(*) AS n, min(c_custkey) AS f FROM customer GROUP BY c_mktsegment
        UNION ALL SELECT 'c_nationkey', 'C Nationkey', c_nationkey::VARCHAR, count(*), min(c_custkey) FROM customer GROUP BY c_nationkey
        UNION ALL SELECT 'c_name', 'C Name', c_name, count(*), min(c_custkey) FROM customer GROUP BY c_name),
    t AS (SELECT col, count(*) AS v, sum(n) AS r FROM c WHERE trim(value) <> '' GROUP BY col HAVING count(*) BETWEEN 2 AND 120 AND (count(*) < 25 OR count(*) / sum(n) <= 0.45))
    SELECT col AS "column", display_name, value, n, row_number() OVER (PARTITION BY col ORDER BY f, value)::INTEGER AS place FROM c SEMI JOIN t USING (col)"""
)
def facet_definitions(spark, sf):
    return facets.definitions(load(spark, sf, "customer"), ["c_mktsegment", "c_nationkey", "c_name"], "c_custkey")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT'")
def facet_filter(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return facets.apply_filters(o, {"o_orderstatus": ["F", "P", " "], "o_orderpriority": ["1-URGENT"]}, ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def row_page(spark, sf):
    o = facets.apply_filters(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), {"o_orderstatus": ["F"]})
    return o.orderBy("o_orderkey").offset(100).limit(50)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark, sf):
    return store.after(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), 500, 50, "o_orderkey")


# --- terms and n-grams ----------------------------------------------------------------------------


def _ngram(n: int) -> None:
    def run(spark, sf):
        return terms.top_ngrams(answers(spark, sf), n, 12, tie="term")

    run.__name__ = f"ngram_{n}"
    query(f"WITH {_occurrences(n)} SELECT {n} AS ngram_size, term, count(*) AS n, count(DISTINCT r) AS documents FROM o GROUP BY term ORDER BY n DESC, term LIMIT 12")(run)


for _n in (1, 2, 3):
    _ngram(_n)


@query(f"WITH {_occurrences(2)}, b AS (SELECT term FROM o GROUP BY term ORDER BY count(*) DESC, term LIMIT 3) SELECT DISTINCT term, r AS row_number, length(text) AS chars FROM o JOIN t USING (r) WHERE term IN (SELECT term FROM b)")
def ngram_documents(spark, sf):
    d = answers(spark, sf)
    found = terms.ngram_documents(d, 2, terms.top_ngrams(d, 2, 3, tie="term"))
    return found.select("term", "row_number", F.char_length("text").cast("long").alias("chars"))


@query(f"WITH {_occurrences(2)}, b AS (SELECT term FROM o GROUP BY term ORDER BY count(*) DESC, term LIMIT 1) SELECT DISTINCT term, r AS row_number FROM o WHERE term IN (SELECT term FROM b) ORDER BY row_number LIMIT 5 OFFSET 2")
def ngram_page(spark, sf):
    d = answers(spark, sf)
    return terms.ngram_documents(d, 2, terms.top_ngrams(d, 2, 1, tie="term")).select("term", "row_number").orderBy("row_number").offset(2).limit(5)


@query(
    f"""WITH {_occurrences(1, "lang")}, c AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term),
    k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM c QUALIFY rank <= 6)
    SELECT lang, rank::INTEGER AS rank, term, n, round_even(n / max(n) OVER (PARTITION BY lang), 4) AS strength FROM k"""
)
def top_terms_by_group(spark, sf):
    return terms.top_terms(answers(spark, sf), ["lang"], 6, tie="term")


@query(
    f"""WITH {_occurrences(1, "lang")}, p AS (SELECT r, lang, term, row_number() OVER () AS i FROM o),
    q AS (SELECT lang, r, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'term': w[i], 'pos': i}})) AS x FROM t),
    c AS (SELECT lang, x.term AS term, count(*) AS n, min((r, x.pos)) AS first FROM q GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first, term)::INTEGER AS rank, term, n FROM c QUALIFY rank <= 6"""
)
def top_terms_first_seen(spark, sf):
    return terms.top_terms(answers(spark, sf), ["lang"], 6).drop("strength")


@query(
    f"""WITH t AS (SELECT doc_id AS r, source, {_tokens("text")} AS w FROM documents),
    """
    + ", ".join(
        f"c{n} AS (SELECT source, term, count(*) AS n FROM (SELECT source, unnest({_grams('w', n)}) AS term FROM t) GROUP BY ALL), b{n} AS (SELECT source, term FROM c{n} WHERE n >= {2 if n > 1 else 1} QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, term) <= {1 if n > 1 else 2})"
        for n in (1, 2, 3)
    )
    + """, u AS (SELECT source, string_agg(term, ' ' ORDER BY n DESC, term) AS uni FROM b1 JOIN c1 USING (source, term) GROUP BY source)
    SELECT s.source, coalesce(b3.term, b2.term, u.uni, '') AS phrase FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN b3 USING (source) LEFT JOIN b2 USING (source) LEFT JOIN u USING (source)"""
)
def top_phrase(spark, sf):
    return terms.top_phrase(answers(spark, sf), ["source"], tie="term")


@query(
    f"""WITH d AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 120), t AS (SELECT doc_id AS r, source, {_tokens("text")} AS w FROM d),
    z AS (SELECT source, count(*) AS size FROM d GROUP BY source), o AS (SELECT r, source, unnest({_grams("w", 2)}) AS term FROM t),
    c AS (SELECT source, term, count(*) AS n, count(DISTINCT r) AS documents FROM o WHERE split_part(term, ' ', 1) <> split_part(term, ' ', 2) GROUP BY ALL)
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY documents DESC, n DESC, term)::INTEGER AS rank, term, n, documents FROM c JOIN z USING (source) WHERE documents >= least(4, size) QUALIFY rank <= 3"""
)
def evidence_ngrams(spark, sf):
    return terms.evidence_ngrams(answers(spark, sf), 2, ["source"], 3)


def _from_first(words: str, stop) -> str:
    """words from the first on that isn't in stop; the last one where all are."""
    return f"{words}[coalesce(nullif(list_position(list_transform({words}, lambda x: x NOT IN ({_words(stop)})), true), 0), len({words})):]"


@query(
    rf"""WITH RECURSIVE d AS (SELECT * FROM (SELECT doc_id, source, text FROM documents QUALIFY row_number() OVER (PARTITION BY source, {_fold("text")} ORDER BY doc_id) = 1) QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 120),
    t AS (SELECT doc_id, source, list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1), lambda x: {_fold("x")}) AS w FROM d),
    g AS (SELECT doc_id, source, 2 AS n, unnest(range(1, len(w))) AS i, w FROM t UNION ALL SELECT doc_id, source, 3, unnest(range(1, len(w) - 1)), w FROM t),
    a AS (SELECT doc_id, source, n, i, w[i:i + n - 1] AS w FROM g), l AS (SELECT doc_id, source, n, i, list_reverse({_from_first("w", LEADING_TRIM)}) AS w FROM a),
    f AS (SELECT doc_id, source, n, i, array_to_string(list_reverse({_from_first("w", TRAILING_TRIM)}), ' ') AS term FROM l),
    o AS (SELECT doc_id, source, term, min((n, i)) AS pos FROM f WHERE contains(term, ' ') GROUP BY ALL),
    k AS (SELECT source, term, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min((doc_id, pos)), term) AS k FROM o GROUP BY source, term HAVING count(*) >= 2),
    r(source, k, held) AS (SELECT DISTINCT source, 0::BIGINT, []::VARCHAR[] FROM k
        UNION ALL SELECT r.source, k.k, CASE WHEN len(held) < 8 AND len(list_filter(held, lambda h: contains(h, term) OR contains(term, h))) = 0 THEN list_append(held, term) ELSE held END FROM r JOIN k ON k.source = r.source AND k.k = r.k + 1)
    SELECT source, array_to_string(arg_max(held, k), '; ') AS phrases FROM r GROUP BY source"""
)
def context_phrases(spark, sf):
    chosen = terms.chosen_phrases(terms.context_phrases(answers(spark, sf), ["source"]), ["source"], 8)
    return chosen.select("source", F.array_join("phrases", "; ").alias("phrases"))


# --- ranking ---------------------------------------------------------------------------------------

TOPICS = {"en": ("The For And", ["ing", "the", "was"]), "de": ("Der Und Die", ["der", "ung", "die"]), "fr": ("Les Pour Dans", ["les", "pour"]), "es": ("Para Las", ["para", "las"])}


def topic_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, label, t) for k, (label, t) in TOPICS.items()], "lang string, label string, terms array<string>")


_TOPIC_SQL = "topics(lang, label, terms) AS (VALUES " + ", ".join(f"('{k}', '{label}', [{_words(t)}])" for k, (label, t) in TOPICS.items()) + ")"


@query(
    f"""WITH {_TOPIC_SQL}, s AS (SELECT lang, doc_id, text, {_fold("text")} AS key, len(list_filter(terms, lambda x: contains({_fold("text")}, x))) AS hits, abs(length(text) - 220) AS off FROM documents JOIN topics USING (lang)),
    o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, key ORDER BY hits DESC, off, doc_id) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY hits DESC, off, doc_id)::INTEGER AS rank, doc_id AS row_number, hits::INTEGER AS hits, text FROM o QUALIFY rank <= 3"""
)
def examples(spark, sf):
    return rank.examples(answers(spark, sf), topic_table(spark).select("lang", "terms"), ["lang"]).drop("fragment_no")


def _hits(term: str) -> str:
    return rf"len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_\p{{M}}]+'), lambda w: w = {term}))"


@query(
    f"""WITH {_TOPIC_SQL}, h AS (SELECT lang, doc_id, list_transform(terms, lambda x: {_hits("x")}) AS f FROM documents JOIN topics USING (lang))
    SELECT lang, doc_id AS row_number, len(list_filter(f, lambda n: n > 0))::INTEGER AS hits FROM h"""
)
def representativeness_hits(spark, sf):
    """Distinct terms found in each document, the second key of the representativeness order."""
    return rank.representativeness(answers(spark, sf), topic_table(spark).select("lang", "terms"), ["lang"], texts=False).select("lang", "row_number", "hits")


def _place(term: str) -> str:
    """Where a whole word starts first, from 1."""
    return rf"length(regexp_extract(lower(text), '(?s)^((?:.*?[^\p{{L}}\p{{N}}_\p{{M}}])?)' || {term} || '(?:[^\p{{L}}\p{{N}}_\p{{M}}]|$)', 1)) + 1"


@query(
    rf"""WITH {_TOPIC_SQL}, h AS (SELECT lang, doc_id, text, list_transform(terms, lambda x: {_hits("x")}) AS f, list_transform(terms, lambda x: {_place("x")}) AS places,
        len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}_'']*[\p{{L}}\p{{N}}_])?')) AS n_words FROM documents JOIN topics USING (lang)),
    s AS (SELECT *, len(list_filter(f, lambda n: n > 0)) AS hits, list_sum(f) AS matches, list_sum(list_transform(f, lambda n, i: n * (len(f) + 1 - i))) AS weighted,
        list_position(list_transform(f, lambda n: n > 0), true) AS best, list_min(list_filter(list_transform(f, lambda n, i: CASE WHEN n > 0 THEN places[i] END), lambda p: p IS NOT NULL)) AS first FROM h)
    SELECT lang, doc_id AS row_number, hits::INTEGER AS hits, row_number() OVER (PARTITION BY lang ORDER BY hits > 0 DESC, hits DESC, matches DESC, weighted DESC,
        CASE WHEN hits > 0 THEN n_words ELSE 0 END, CASE WHEN hits > 0 THEN length(text) ELSE 0 END, CASE WHEN hits > 0 THEN best ELSE 0 END, CASE WHEN hits > 0 THEN first ELSE 0 END, doc_id) AS rank FROM s"""
)
def representativeness(spark, sf):
    """The whole order."""
    return rank.representativeness(answers(spark, sf), topic_table(spark).select("lang", "terms"), ["lang"], texts=False).select("lang", "row_number", "hits", "rank")


_REL = f"""{_TOPIC_SQL}, d AS (SELECT lang, doc_id, text, {_relevance("text")} AS w, label, terms, {_relevance("label")} AS l FROM documents JOIN topics USING (lang)),
    g AS (SELECT *, {_grams("w", 2)} AS w2, {_grams("w", 3)} AS w3, {_grams("l", 2)} AS l2, {_grams("l", 3)} AS l3, list_distinct(flatten(list_transform(terms, lambda x: {_relevance("x")}))) AS tw FROM d),
    s AS (SELECT *, len(list_intersect(list_distinct(w3), l3)) AS trigrams, len(list_intersect(list_distinct(w2), l2)) AS bigrams, len(list_intersect(list_distinct(w), l)) AS words, len(list_intersect(list_distinct(w), tw)) AS term_words FROM g)"""


@query(
    f"""WITH {_REL} SELECT lang, doc_id AS row_number, trigrams::INTEGER AS trigrams, bigrams::INTEGER AS bigrams, words::INTEGER AS words, term_words::INTEGER AS term_words,
    row_number() OVER (PARTITION BY lang ORDER BY trigrams DESC, bigrams DESC, words DESC, term_words DESC, len(regexp_extract_all(text, '[A-Za-z0-9]+')), length(text), doc_id)::INTEGER AS rank FROM s"""
)
def label_relevance(spark, sf):
    return rank.label_relevance(answers(spark, sf), topic_table(spark), ["lang"], texts=False).select("lang", "row_number", "trigrams", "bigrams", "words", "term_words", F.col("rank").cast("int").alias("rank"))


@query(f"""WITH {_REL} SELECT lang, doc_id AS row_number, count(*) OVER (PARTITION BY lang) >= 2 AND words + term_words = 0 AS off_topic FROM s""")
def off_topic(spark, sf):
    return rank.off_topic(answers(spark, sf), topic_table(spark), ["lang"]).select("lang", "row_number", "off_topic")


# --- groups --------------------------------------------------------------------------------------

_SUMMARY = f"""t AS (SELECT doc_id AS r, lang, {_tokens("text")} AS w FROM documents), c AS (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(w) AS term FROM t) GROUP BY ALL),
    k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) <= 6),
    m AS (SELECT lang, list(term ORDER BY n DESC, term) AS terms, list(round_even(n / x, 4) ORDER BY n DESC, term) AS strengths FROM (SELECT *, max(n) OVER (PARTITION BY lang) AS x FROM k) GROUP BY lang),
    z AS (SELECT lang, count(*) AS count FROM documents GROUP BY lang)"""


@query(f"WITH {_SUMMARY} SELECT lang, count, sum(count) OVER ()::BIGINT AS total_documents, round_even(count / sum(count) OVER (), 4) AS share, array_to_string(terms, ' ') AS terms, array_to_string(strengths, ' ') AS strengths FROM z JOIN m USING (lang)")
def group_summary(spark, sf):
    g = topics.summaries(answers(spark, sf), "lang", tie="term")
    return g.select("lang", "count", "total_documents", "share", F.array_join("terms", " ").alias("terms"), F.array_join(F.transform("strengths", lambda s: s.cast("string")), " ").alias("strengths"))


@query(
    f"""WITH t AS (SELECT source, {_tokens("text")} AS w FROM documents), c AS (SELECT source, term, count(*) AS n FROM (SELECT source, unnest(w) AS term FROM t) GROUP BY ALL),
    k AS (SELECT source, term FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, term) <= 2),
    s AS (SELECT source, string_agg(term, '+' ORDER BY term) AS signature FROM k GROUP BY source), z AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
    SELECT signature, arg_min(source, (-n, source)) AS primary_source, sum(n)::BIGINT AS n, count(*) AS groups FROM s JOIN z USING (source) GROUP BY signature"""
)
def signature_merge(spark, sf):
    """A16 as a distributed aggregation: groups of one signature and the largest of them."""
    d = answers(spark, sf)
    two = terms.top_terms(d, ["source"], 2, tie="term").groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("term")), "+").alias("signature"))
    sizes = d.groupBy("source").agg(F.count("*").alias("n"))
    return two.join(sizes, "source").groupBy("signature").agg(F.min_by("source", F.struct(-F.col("n"), F.col("source"))).alias("primary_source"), F.sum("n").alias("n"), F.count("*").alias("groups"))


_ACRONYMS = _words(X.ACRONYMS)
_KNOWN_GROUPS = (
    f"""t AS (SELECT doc_id AS r, regexp_extract(source, '[0-9]+')::BIGINT AS c, text, {_tokens("text")} AS w FROM documents), z AS (SELECT c, count(*) AS n FROM t GROUP BY c), """
    + ", ".join(
        f"""x{n} AS (SELECT c, r, unnest(list_transform({_grams("w", n)}, lambda g, i: {{'term': g, 'pos': i}})) AS x FROM t),
        k{n} AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, first, term) AS k FROM (SELECT c, x.term AS term, count(*) AS n, min((r, x.pos)) AS first FROM x{n} GROUP BY ALL))"""
        for n in (1, 2, 3)
    )
    + f""", b AS (SELECT z.c, z.n, coalesce(u.terms, []) AS terms, coalesce(k3.term, k2.term, array_to_string(u.terms[1:2], ' '), '') AS phrase
        FROM z LEFT JOIN (SELECT c, list(term ORDER BY k) AS terms FROM k1 WHERE k <= 6 GROUP BY c) u USING (c) LEFT JOIN k3 ON k3.c = z.c AND k3.k = 1 AND k3.n >= 2 LEFT JOIN k2 ON k2.c = z.c AND k2.k = 1 AND k2.n >= 2),
    g AS (SELECT c, n, terms, CASE WHEN phrase = '' THEN 'Community ' || c ELSE array_to_string(list_transform(string_split(phrase, ' '), lambda p: CASE WHEN p IN ({_ACRONYMS}) THEN upper(p) ELSE upper(p[1:1]) || p[2:] END), ' ') END AS label,
        CASE WHEN len(terms) >= 2 THEN array_to_string(list_sort(terms[1:2]), '+') ELSE '-' || c END AS signature FROM b),
    s AS (SELECT *, first_value(c) OVER (PARTITION BY signature ORDER BY n DESC, c::VARCHAR) AS c1 FROM g)"""
)
_MERGED = f"""{_KNOWN_GROUPS}, s1 AS (SELECT c1, sum(n) AS n, flatten(list(terms)) AS terms FROM s GROUP BY c1),
    m AS (SELECT s1.*, g.label, row_number() OVER (ORDER BY s1.n DESC, c1::VARCHAR) AS i, list_filter(regexp_extract_all(lower(g.label), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ({_words(w for w in RELEVANCE_STOPWORDS if w != "too")})) AS w FROM s1 JOIN g ON g.c = c1),
    y AS (SELECT i, 'label ' || lower(label) AS key FROM m UNION SELECT i, unnest({_grams("w", 2)}) FROM m UNION SELECT i, unnest({_grams("w", 3)}) FROM m),
    p AS MATERIALIZED (SELECT DISTINCT a.i AS a, b.i AS b FROM y a JOIN y b USING (key)), v(i, j) AS (SELECT i, i FROM m UNION SELECT p.b, v.j FROM v JOIN p ON p.a = v.i),
    e AS (SELECT i, min(j) AS j FROM v GROUP BY i), f AS (SELECT h.c1 AS c2, any_value(h.label) AS label, flatten(list(m.terms)) AS terms FROM m JOIN e USING (i) JOIN m h ON h.i = e.j GROUP BY h.c1),
    d AS (SELECT t.r, t.text, h.c1 AS c2 FROM t JOIN s USING (c) JOIN m ON m.c1 = s.c1 JOIN e USING (i) JOIN m h ON h.i = e.j),
    q AS (SELECT d.r, d.c2, f.label, count(*) OVER (PARTITION BY d.c2) AS size, len(list_intersect({_relevance("d.text")}, list_concat({_relevance("f.label")}, flatten(list_transform(f.terms, lambda x: {_relevance("x")}))))) AS shared FROM d JOIN f USING (c2))"""


@query(
    f"""WITH RECURSIVE {_MERGED} SELECT CASE WHEN size >= 2 AND shared = 0 THEN -1 ELSE c2 END AS community, CASE WHEN size >= 2 AND shared = 0 THEN '{topics.NOISE_LABEL}' ELSE label END AS label, count(*) AS n, count(*) AS last_rank FROM q GROUP BY ALL"""
)
def merged_topics(spark, sf):
    """Steps 6 to 11 on sources as groups: merged by terms and by label, off-topic documents among the noise, with counts and last ranks."""
    d = answers(spark, sf).withColumn("community", F.regexp_extract("source", "[0-9]+", 0).cast("long")).drop("lang", "source")
    placed, groups, _ = topics.analyse(d)
    names = topics.topics_frame(groups).select("community", "label").unionByName(spark.createDataFrame([(-1, topics.NOISE_LABEL)], "community long, label string"))
    return placed.groupBy("community").agg(F.count("*").alias("n"), F.max("rank").alias("last_rank")).join(names, "community")


@query(
    f"""WITH {_KNOWN_GROUPS} SELECT c AS community, '[' || label || ']' AS label, label AS source_label, true AS translated, n FROM g WHERE c % 2 = 0
    UNION ALL SELECT c, label, NULL, false, n FROM g WHERE c % 2 = 1"""
)
def translated_labels(spark, sf):
    """Labels of groups translated for display, but for those that are done (odd numbers); a stand-in puts brackets round them."""
    d = answers(spark, sf).withColumn("community", F.regexp_extract("source", "[0-9]+", 0).cast("long")).drop("lang", "source")
    g = topics.summaries(d).select("community", "label", F.col("count").alias("n"))
    return providers.translate_outputs(g, Bracketed(), "label", F.col("community") % 2 == 1)


# --- graph -----------------------------------------------------------------------------------------


def vectors(spark, sf, *keep):
    return graph.unit_vectors(load(spark, sf, "embeddings"), "vec_id", "embedding", *keep)


def _near(k: int = 16) -> str:
    return f"""v AS (SELECT vec_id AS node, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
    p AS (SELECT a.node AS a, b.node AS b, a.label AS la, b.label AS lb, list_dot_product(a.v, b.v) AS sim FROM v a JOIN v b ON a.node <> b.node),
    n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM p QUALIFY rank <= {k})"""


def _edge_sql(threshold: str) -> str:
    return f"{_near()}, d AS (SELECT * FROM n WHERE sim >= {threshold}), e AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, min(sim) AS weight FROM d GROUP BY ALL HAVING count(*) = 2)"


@query(f"WITH {_near()} SELECT a, b, round_even(sim, 6) AS sim, rank::INTEGER AS rank FROM n")
def knn_topk(spark, sf):
    return graph.nearest(vectors(spark, sf)).select("a", "b", F.bround("sim", 6).alias("sim"), "rank")


@query()
def knn_index(spark, sf):
    """J03, W02, G02 by cells of principal directions at a recall of 0.95; the tests measure it against knn_topk."""
    return neighbours.neighbours_by_recall(vectors(spark, sf)).select("a", "b", F.bround("sim", 6).alias("sim"), "rank")


@query(f"WITH {_edge_sql(str(SIMILARITY))} SELECT src, dst, round_even(weight, 6) AS weight FROM e")
def mutual_edges(spark, sf):
    return graph.exported(graph.similarity_edges(vectors(spark, sf), SIMILARITY))


@query(f"WITH {_near()}, d AS (SELECT * FROM n WHERE sim >= {SIMILARITY}) SELECT least(a, b) AS src, greatest(a, b) AS dst, round_even(min(sim), 6) AS weight FROM d GROUP BY ALL")
def loose_edges(spark, sf):
    return graph.exported(graph.similarity_edges(vectors(spark, sf), SIMILARITY, mutual=False))


@query(f"WITH {_edge_sql('CASE WHEN la = lb AND la <> 0 THEN 0.78 ELSE ' + str(SIMILARITY) + ' END')} SELECT src, dst, round_even(weight, 6) AS weight FROM e")
def language_edges(spark, sf):
    """Label 0 stands for English, the other labels for languages that need the higher similarity."""
    lang = F.when(F.col("label") == 0, "en").otherwise(F.concat(F.lit("l"), F.col("label").cast("string")))
    v = vectors(spark, sf, lang.alias("lang"))
    return graph.exported(graph.similarity_edges(v.select("node", "v"), SIMILARITY, languages=v.select("node", "lang")))


@query(f"WITH {_edge_sql(str(SIMILARITY))}, b AS (SELECT src AS node, weight FROM e UNION ALL SELECT dst, weight FROM e) SELECT node, round_even(sum(greatest(weight, 0)), 6) AS degree, count(*) AS neighbours FROM b GROUP BY node")
def degree(spark, sf):
    return graph.degrees(graph.similarity_edges(vectors(spark, sf), SIMILARITY)).select("node", F.bround("degree", 6).alias("degree"), "neighbours")


_COMPONENTS = f"""{_edge_sql(str(SIMILARITY))}, b AS MATERIALIZED (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e),
    r(x, m) AS (SELECT x, x FROM b UNION SELECT b.y, r.m FROM r JOIN b ON b.x = r.x), c AS (SELECT v.node, coalesce(min(r.m), v.node) AS component FROM v LEFT JOIN r ON r.x = v.node GROUP BY v.node)"""


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT node, component FROM c")
def components(spark, sf):
    v = vectors(spark, sf)
    return graph.components(graph.similarity_edges(v, SIMILARITY), v.select("node"))


@query(
    f"""WITH RECURSIVE {_COMPONENTS}, w AS (SELECT component FROM c GROUP BY component HAVING count(*) >= 4 AND count(*) FILTER (node % 5 <> 0) >= 0.75 * count(*)),
    sb AS MATERIALIZED (SELECT src AS x, dst AS y FROM e WHERE weight >= {graph.split_threshold(SIMILARITY)} UNION SELECT dst, src FROM e WHERE weight >= {graph.split_threshold(SIMILARITY)}),
    sr(x, m) AS (SELECT x, x FROM sb UNION SELECT sb.y, sr.m FROM sr JOIN sb ON sb.x = sr.x), least AS (SELECT x, min(m) AS m FROM sr GROUP BY x)
    SELECT c.node, CASE WHEN w.component IS NULL THEN c.component ELSE coalesce(least.m, c.node) END AS community FROM c LEFT JOIN w USING (component) LEFT JOIN least ON least.x = c.node"""
)
def language_split(spark, sf):
    """Components that one language rules fall apart; four nodes of five stand for Spanish, the fifth for English."""
    v = vectors(spark, sf)
    e = graph.similarity_edges(v, SIMILARITY)
    found = graph.components(e, v.select("node")).withColumnRenamed("component", "community")
    return graph.split_by_language(found, e, v.select("node", F.when(F.col("node") % 5 == 0, "en").otherwise("es").alias("lang")), SIMILARITY)


_NAMED = f"{_COMPONENTS}, z AS (SELECT component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS id FROM c GROUP BY component HAVING count(*) >= 3), named AS (SELECT node, coalesce(id, -1) AS community FROM c LEFT JOIN z USING (component))"


@query(f"WITH RECURSIVE {_NAMED} SELECT node, community FROM named")
def noise_groups(spark, sf):
    v = vectors(spark, sf)
    return _named(v, graph.similarity_edges(v, SIMILARITY))


def _named(v: DataFrame, e: DataFrame) -> DataFrame:
    found = graph.components(e, v.select("node")).withColumnRenamed("component", "community")
    return graph.named_communities(found, v.count())


@query(f"WITH RECURSIVE {_NAMED}, q AS (SELECT node // 2 AS row_number, max(CASE WHEN community >= 0 THEN 1 ELSE 0 END) AS real FROM named GROUP BY ALL) SELECT count(*) FILTER (real = 1) AS assigned, count(*) FILTER (real = 0) AS unassigned FROM q")
def assigned_counts(spark, sf):
    """Two vectors stand for the two fragments of one respondent."""
    return graph.assigned_counts(noise_groups(spark, sf).select(F.floor(F.col("node") / 2).alias("row_number"), "community"))


@query(
    f"""WITH RECURSIVE {_NAMED} SELECT e.src, e.dst, round_even(weight, 6) AS weight, e.src + 1 AS src_row, s.community AS src_community, e.dst + 1 AS dst_row, d.community AS dst_community
    FROM e JOIN named s ON s.node = e.src JOIN named d ON d.node = e.dst"""
)
def plot_edges(spark, sf):
    v = vectors(spark, sf)
    e = graph.similarity_edges(v, SIMILARITY)
    points = graph.plot_points(_named(v, e), graph.circle(v.select("node")), v.select("node", (F.col("node") + 1).alias("row_number")))
    return graph.plot_edges(e, points)


@query()
def found_communities(spark, sf):
    """Modularity communities; the tests check that they partition the nodes and beat components and singletons."""
    return communities.run(vectors(spark, sf), SIMILARITY)[0]


_PROPERTIES = f"""WITH RECURSIVE {_COMPONENTS}, k AS (SELECT node, sum(weight) AS k FROM (SELECT src AS node, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY node),
    q AS (SELECT 1 - {graph.RESOLUTION} * sum(s * s) / (4 * pow((SELECT sum(weight) FROM e), 2)) AS q FROM (SELECT sum(k) AS s FROM c JOIN k USING (node) GROUP BY component))
    SELECT (SELECT count(*) FROM embeddings) AS nodes, (SELECT count(*) FROM e) AS edges, round_even(q, 6) AS modularity_of_components, true AS connected, true AS named_by_least, true AS not_below_components FROM q"""


def _properties(spark, sf, solver) -> DataFrame:
    v = vectors(spark, sf)
    e = graph.similarity_edges(v, SIMILARITY)
    found = graph.written(solver(e, v.select("node"), graph.RESOLUTION), "found")
    s, d = (found.select(F.col("node").alias(n), F.col("community").alias(f"c_{n}")) for n in ("src", "dst"))
    parts = graph.components(e.join(s, "src").join(d, "dst").where("c_src = c_dst").select("src", "dst"), v.select("node"))
    same = found.join(parts, "node").agg(F.bool_and(F.col("community") == F.col("component")).alias("connected"), F.count("*").alias("nodes"))
    named = found.groupBy("community").agg(F.min("node").alias("least")).agg(F.bool_and(F.col("community") == F.col("least")).alias("named_by_least"))
    whole = communities.modularity_of(e, graph.components(e, v.select("node")).withColumnRenamed("component", "community")).withColumnRenamed("modularity", "of_components")
    ours = communities.modularity_of(e, found)
    row = same.join(named).join(whole).join(ours).join(e.agg(F.count("*").alias("edges")))  # one row each
    return row.select("nodes", "edges", F.bround("of_components", 6).alias("modularity_of_components"), "connected", "named_by_least", (F.col("modularity") >= F.col("of_components") - 1e-9).alias("not_below_components"))


@query(_PROPERTIES)
def community_properties(spark, sf):
    """Communities are connected, named by their smallest node, and at least as good as the components, whose modularity SQL gives too."""
    return _properties(spark, sf, communities.communities)


@query(_PROPERTIES)
def greedy_properties(spark, sf):
    """G06 under the same questions."""
    return _properties(spark, sf, communities.greedy)


@query("SELECT vec_id AS node, -1::BIGINT AS community FROM embeddings")
def all_noise(spark, sf):
    """At the usual similarity random vectors have no edge, so all is noise."""
    return communities.run(vectors(spark, sf), 0.66)[0]


@query("SELECT vec_id AS node, true AS placed FROM embeddings")
def layout(spark, sf):
    """Every node gets a place; where exactly is a matter of looks."""
    return graph.principal_layout(vectors(spark, sf)).select("node", (~F.isnan("x") & ~F.isnan("y")).alias("placed"))


_PULL = """{after} AS (SELECT p.node, coalesce(p.x + 0.5 * (n.x - p.x), p.x) AS x, coalesce(p.y + 0.5 * (n.y - p.y), p.y) AS y FROM {before} p LEFT JOIN
    (SELECT b.src AS node, sum(weight * x) / sum(weight) AS x, sum(weight * y) / sum(weight) AS y FROM both_ways b JOIN {before} q ON q.node = b.dst GROUP BY b.src) n USING (node))"""


@query(
    f"""WITH {_edge_sql(str(SIMILARITY))}, both_ways AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e), p0 AS (SELECT node, v[1] AS x, v[2] AS y FROM v),
    {_PULL.format(before="p0", after="p1")}, {_PULL.format(before="p1", after="p2")} SELECT node, round_even(x, 6) AS x, round_even(y, 6) AS y FROM p2"""
)
def pulled_layout(spark, sf):
    """Where edges pull the nodes, from their vectors' first two coordinates."""
    v = vectors(spark, sf)
    start = v.select("node", F.get("v", 0).alias("x"), F.get("v", 1).alias("y"))
    return graph.pulled_layout(start, graph.similarity_edges(v, SIMILARITY)).select("node", F.bround("x", 6).alias("x"), F.bround("y", 6).alias("y"))


@query(
    f"""WITH {_edge_sql(str(SIMILARITY))}, both_ways AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e), p0 AS (SELECT node, v[1] AS x, v[2] AS y FROM v),
    box AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) AS side, greatest(max(x) - min(x), max(y) - min(y)) ** 2 / count(*) AS k2 FROM p0),
    marks AS (SELECT node, x, y, least(floor((x - x0) / side * 32), 31) AS cx, least(floor((y - y0) / side * 32), 31) AS cy FROM p0, box),
    cells AS (SELECT cx, cy, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM marks m GROUP BY cx, cy),
    gaps AS (SELECT m.node, c.n, m.x - c.sx / c.n AS dx, m.y - c.sy / c.n AS dy FROM marks m JOIN cells c ON m.cx <> c.cx OR m.cy <> c.cy
        UNION ALL SELECT m.node, c.n - 1, m.x - (c.sx - m.x) / (c.n - 1), m.y - (c.sy - m.y) / (c.n - 1) FROM marks m JOIN cells c USING (cx, cy) WHERE c.n > 1),
    push AS (SELECT node, sum(k2 * n * dx / (dx * dx + dy * dy + k2 / 100)) AS fx, sum(k2 * n * dy / (dx * dx + dy * dy + k2 / 100)) AS fy FROM gaps, box GROUP BY node),
    pull AS (SELECT b.src AS node, sum(weight * (q.x - p.x)) AS px, sum(weight * (q.y - p.y)) AS py FROM both_ways b JOIN p0 p ON p.node = b.src JOIN p0 q ON q.node = b.dst GROUP BY b.src),
    forces AS (SELECT node, x, y, side, coalesce(fx, 0) + coalesce(px, 0) AS mx, coalesce(fy, 0) + coalesce(py, 0) AS my FROM p0 LEFT JOIN push USING (node) LEFT JOIN pull USING (node), box),
    moves AS (SELECT *, least(1, 0.1::DOUBLE * side / greatest(sqrt(mx * mx + my * my), 1e-300)) AS part FROM forces f)
    SELECT node, round_even(x + part * mx, 6) AS x, round_even(y + part * my, 6) AS y FROM moves g"""
)
def forced_layout(spark, sf):
    """One round of forces, from the vectors' first two coordinates: edges pull, the cells of a grid push."""
    v = vectors(spark, sf)
    start = graph.written(v.select("node", F.get("v", 0).alias("x"), F.get("v", 1).alias("y")), "places")
    moved = forces.force_round(start, graph.similarity_edges(v, SIMILARITY))
    return moved.select("node", F.bround("x", 6).alias("x"), F.bround("y", 6).alias("y"))


# --- views of finished results -------------------------------------------------------------------


@query("WITH k AS (SELECT lang, count(*) AS count FROM documents WHERE source IN ('src0', 'src1') GROUP BY lang) SELECT lang, count, sum(count) OVER ()::BIGINT AS total_documents, round_even(count / sum(count) OVER (), 4) AS share FROM k")
def refilter(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("row_number"), "lang", "source")
    return store.refiltered(d, facets.apply_filters(d, {"source": ["src0", "src1"]}), "lang")


@query(ORACLE["refilter"])
def kept_results(spark, sf):
    """A table and a finished analysis that one store saved, narrowed by a filter through another that knows only the folder."""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("row_number"), "lang", "source")
    folder = f"{graph.shared_folder(spark)}/results-{uuid.uuid4().hex}"
    saving = ResultTables(spark, folder)
    key = saving.save(d, ["lang", "source"], ["text"])
    saving.snapshot(key, "community", "text", None, d.select("row_number", F.col("lang").alias("community")), None)
    return ResultTables(spark, folder).narrowed(key, "community", "text", None, {"source": ["src0", "src1"]}).withColumnRenamed("community", "lang")


@query("WITH l AS (SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')) SELECT d.doc_id AS row_number, coalesce(l.lang, '') AS community_group FROM documents d LEFT JOIN l USING (doc_id)")
def group_write_back(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("row_number"), "lang")
    order = spark.createDataFrame([(0, 0, "de"), (1, 1, "fr")], "community long, place int, label string")
    placed = d.where(F.col("lang").isin("de", "fr")).select("row_number", F.when(F.col("lang") == "de", 0).otherwise(1).cast("long").alias("community"))
    return store.with_group(d.select("row_number"), placed, order)


@query(
    f"""WITH {_SUMMARY} SELECT row_number() OVER (ORDER BY count DESC, lang)::INTEGER AS place, lang AS label, count, round_even(count / sum(count) OVER () * 100, 1) AS percent, array_to_string(terms[1:4], ', ') AS top_terms FROM z JOIN m USING (lang)"""
)
def report_sections(spark, sf):
    g = topics.summaries(answers(spark, sf), "lang", tie="term").withColumn("label", F.col("lang"))
    return report.summary_sections(g).select("place", "label", "count", "percent", "top_terms")


@query("SELECT term, n FROM (WITH " + _occurrences(1) + " SELECT term, count(*) AS n FROM o GROUP BY term) ORDER BY n DESC, term LIMIT 10")
def chart_bars(spark, sf):
    return report.chart_bars(terms.ngram_counts(answers(spark, sf), 1), "term")


@query("SELECT regexp_extract(p_name, '^[a-z]+') AS first_word, upper(p_name[1:1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1:1]) || split_part(p_name, ' ', 2)[2:] AS label, p_partkey FROM part")
def label_format(spark, sf):
    p = load(spark, sf, "part")
    return p.select("p_partkey", F.get(X.label_tokens(F.col("p_name")), 0).alias("first_word"), X.topic_label(F.upper("p_name")).alias("label"))


# --- whole ingests -------------------------------------------------------------------------------


@query(
    """WITH a AS (SELECT conv_id, role, arg_max(text, turn) AS answer FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL AND trim(text) <> '' GROUP BY conv_id, role)
    SELECT conv_id::VARCHAR AS "conv_id__idx_0", md5(max(answer) FILTER (role = 'assistant')) AS assistant, md5(max(answer) FILTER (role = 'system')) AS system, md5(max(answer) FILTER (role = 'user')) AS "user" FROM a GROUP BY conv_id"""
)
def ingest_vertical(spark, sf):
    """conversations as a vertical survey: conv_id is the record, role the question, text the answer."""
    from ..sources.csv_source import Table

    c = load(spark, sf, "conversations")
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) + F.col("conv_id") * 1_000_000
    table = Table(c.select(F.col("conv_id").cast("string").alias("c0"), F.col("role").alias("c1"), F.col("text").alias("c2"), order.cast("long").alias("row_number")), ("conv_id", "role", "text"), "utf-8-sig", ",")
    m = M.Manifest(M.VERTICAL, (0,), (), M.Assembly((0,), (1,), 2)).validated()
    out, _ = assembly.transform(table, m)
    return out.select("conv_id__idx_0", *[F.md5(c).alias(c) for c in ("assistant", "system", "user")])


@query(
    """SELECT p_partkey::VARCHAR AS "user id__idx_0", p_type AS "country__idx_1", concat_ws(', ', p_name, p_brand) AS "Top words" FROM part"""
)
def ingest_wide(spark, sf):
    from ..sources.csv_source import Table

    p = load(spark, sf, "part")
    table = Table(p.select(F.col("p_partkey").cast("string").alias("c0"), F.col("p_type").alias("c1"), F.col("p_name").alias("c2"), F.col("p_brand").alias("c3"), F.col("p_partkey").alias("row_number")), ("user id", "country", "1. Top words: Word 1", "2. Top words: Word 2"), "utf-8-sig", ",")
    out, _ = assembly.transform(table, M.Manifest(M.WIDE, (0, 1), (2, 3)).validated())
    return out.drop("row_number")


@query("""SELECT * FROM (VALUES ('user id__idx_0', 'metadata'), ('country__idx_1', 'metadata'), ('Why?__idx_2', 'verbatim'), ('score__idx_3', 'left out')) AS t("column", role)""")
def column_roles(spark, sf):
    """documents as a survey: the text is found to be open, the length a number."""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("row_number"), F.col("doc_id").cast("string").alias("user id__idx_0"), F.col("lang").alias("country__idx_1"), F.col("text").alias("Why?__idx_2"), F.col("n_chars").cast("string").alias("score__idx_3"))
    metadata, verbatim, left = profile.roles(d)
    return spark.createDataFrame([(c, "metadata") for c in metadata] + [(c, "verbatim") for c in verbatim] + [(c, "left out") for c in left], "column string, role string")

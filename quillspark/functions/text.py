"""Text scalars as pure Column -> Column functions; no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import RELEVANCE_STOPWORDS, STOPWORDS

WS = r"(?U)\s"
#: Sign characters that stand for an apostrophe (fixed values).
APOSTROPHES = "‘’`´′\u0092"
#: Texts that count as no answer (fixed values).
PLACEHOLDERS = ("", "na", "n/a", "nan", "none", "null", "nil", "-", "--")
CONTINUATIONS = ("because", "but", "however", "so", "therefore", "still")
ACRONYMS = ("ai", "api", "csv", "pdf", "ppt", "pptx", "uk", "us", "usa")
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"

# Folding differs from lower-casing in characters whose full folding is another text. One-to-one cases go
# through one translate(); of the one-to-many cases those that occur in practice are replaced one by one.
_ONE = {c: f for c in map(chr, range(0x80, 0x2C00)) if len(f := c.casefold()) == 1 and f != c.lower() and len(c.lower()) == 1}
_MANY = {c: c.casefold() for c in "ßﬀﬁﬂ"}


def fold(c: Column) -> Column:
    """Case-insensitive form, as full Unicode case folding gives it."""
    c = F.lower(c)
    for k, v in _MANY.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.translate(c, "".join(_ONE), "".join(_ONE.values()))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends; trim() takes spaces only."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{WS}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{WS}+", " "))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c worked out once however often use() names it."""
    return F.transform(F.array(c), use)[0]


def clean(c: Column) -> Column:
    """No byte-order marks, plain apostrophes, no white space at the ends, no apostrophes at the end."""
    c = F.translate(c, APOSTROPHES + "\ufeff", "'" * len(APOSTROPHES))
    return _bare(once(_bare(c), lambda t: F.when(t.endswith("'"), F.regexp_replace(t, "'+$", "")).otherwise(t)))


def _bare(c: Column) -> Column:
    """strip(), which looks at the whole text only where one of its ends is white space."""
    return once(c, lambda t: F.when(F.substring(t, 1, 1).rlike(WS) | F.substring(t, -1, 1).rlike(WS), strip(t)).otherwise(t))


def _tokens(nulls: Sequence[str]) -> list[str]:
    return sorted({t.strip().casefold() for t in nulls} | {"", "nan", "<na>"})


def scrub(c: Column, nulls: Sequence[str]) -> Column:
    """Null where the stripped, folded text is one of the tokens; survivors stay as they are."""
    return once(c, lambda t: F.when(~_says_nothing(_bare(t), _tokens(nulls)), t))


def _says_nothing(stripped: Column, tokens: Sequence[str]) -> Column:
    """Folding never shortens a text, so one longer than every token need not be folded."""
    return once(stripped, lambda t: F.when(F.char_length(t) <= max(map(len, tokens)), fold(t).isin(list(tokens))).otherwise(F.when(t.isNotNull(), F.lit(False))))


def clean_cell(c: Column, nulls: Sequence[str]) -> Column:
    """Both cleaning passes in one expression; the second differs only for cells that still end in an apostrophe, like `na' '`."""
    first = scrub(clean(c), nulls)
    return once(first, lambda t: F.when(t.endswith("'"), scrub(clean(t), nulls)).otherwise(t))


def usable_title(c: Column) -> Column:
    """The cleaned text, null where it says nothing."""
    t = clean(c)
    return F.when(~fold(t).isin("", "nan", "<na>", "none"), t)


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


# --- tokens -----------------------------------------------------------------------------------


def tokens(c: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Folded runs of letters and digits of three characters or more, neither numbers nor stopwords."""
    words = F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.filter(words, lambda w: (F.char_length(w) > 2) & ~w.rlike(r"^[\p{Nd}²³¹⁰-⁹₀-₉]+$") & ~w.isin(list(stopwords)))


def relevance_tokens(c: Column) -> Column:
    """Folded ASCII words of three characters or more outside the short stop list, in order."""
    words = F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.filter(words, lambda w: (F.char_length(w) > 2) & ~w.isin(list(RELEVANCE_STOPWORDS)))


def evidence_tokens(c: Column) -> Column:
    """Runs of letters and digits of two characters or more, folded afterwards."""
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.transform(F.filter(words, lambda w: F.char_length(w) > 1), fold)


def label_tokens(c: Column) -> Column:
    """X05."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z0-9]+"), 0), fold)


def ngrams(words: Column, n: int) -> Column:
    """N-grams in order, repeats kept; none where there are fewer than n words."""
    made = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<string>"))


def word_count(c: Column) -> Column:
    """X13."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("int")


def sanitised_terms(terms: Column, most: int | None = None) -> Column:
    """Each term as its distinct tokens, empty and repeated terms dropped."""
    made = F.transform(terms, lambda t: F.array_join(F.array_distinct(tokens(F.replace(t, F.lit("_"), F.lit(" ")))), " "))
    kept = F.array_distinct(F.filter(made, lambda t: t != ""))
    return F.slice(kept, 1, most) if most else kept


# --- answers and fragments ------------------------------------------------------------------


def answer(c: Column) -> Column:
    """collapsed text, null for placeholders."""
    t = collapse(c)
    return F.when(~fold(t).isin(list(PLACEHOLDERS)), t)


def is_single_word(c: Column) -> Column:
    """exactly one word once underscores and apostrophes at its ends are gone."""
    words = F.regexp_extract_all(c, F.lit(WORD), 0)
    return F.size(F.filter(words, lambda w: F.regexp_replace(w, "^[_']+|[_']+$", "") != "")) == 1


def capped(c: Column, most: int = 3000) -> Column:
    """X10."""
    return F.when(F.char_length(c) > max(200, most), rstrip(F.substring(c, 1, max(200, most)))).otherwise(c)


def _merged(chunks: Column) -> Column:
    """A chunk that begins with a continuation word joins the one before it. Collapsed texts have no line ends, so one can part chunks."""
    first = lambda c: F.regexp_extract(fold(F.regexp_extract(c, WORD, 0)), WORD, 0)
    marked = F.transform(chunks, lambda c, i: F.concat(F.when((i > 0) & first(c).isin(list(CONTINUATIONS)), " ").otherwise("\n"), c))
    return F.transform(F.split(F.substring(F.array_join(marked, ""), 2, 1 << 30), "\n"), strip)


def _valid(chunks: Column, text: Column) -> Column:
    good = lambda m: (F.size(m) >= 2) & F.forall(m, lambda s: word_count(s) > 3)
    return once(_merged(chunks), lambda m: F.when(good(m), m).otherwise(F.array(text)))


def sentences(text: Column) -> Column:
    """Runs up to a full stop. A run begins at the start or after a stop, so a text without stops is looked through once."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?<![^.])[^.]+\."), 0), strip)


def covers(parts: Column, text: Column) -> Column:
    return (F.size(parts) >= 2) & (collapse(F.array_join(parts, " ")) == collapse(text))


def fragments(text: Column) -> Column:
    """X11: the sentences of a collapsed text, or its comma clauses, or the text itself."""
    clauses = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^,]+,?"), 0), strip), lambda s: s != "")
    bare = lambda parts: F.transform(parts, lambda s: F.when(s.endswith(","), strip(F.regexp_replace(s, ",$", ""))).otherwise(s))
    by_clauses = once(clauses, lambda c: F.when(covers(c, text), _valid(bare(c), text)).otherwise(F.array(text)))
    return F.when(text.contains("."), once(sentences(text), lambda s: F.when(covers(s, text), _valid(s, text)).otherwise(F.array(text)))).otherwise(by_clauses)


# --- labels and sentences about groups ---------------------------------------------------------


def topic_label(phrase: Column) -> Column:
    """Lower-case words with capitals at the start of every hyphenated part; acronyms in capitals."""
    words = F.split(F.lower(F.regexp_replace(collapse(phrase), "^[ ,.-]+|[ ,.-]+$", "")), " ")
    part = lambda p: F.when(p.isin(list(ACRONYMS)), F.upper(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))
    return F.array_join(F.transform(words, lambda w: F.array_join(F.transform(F.split(w, "-"), part), "-")), " ")


def group_comment(label: Column, n: Column, total: Column, rows: Column) -> Column:
    """Count, share in per cent (half to even) and the rows that represent the group."""
    share = F.when(total > 0, F.bround(n / total * 100).cast("int")).otherwise(0)
    listed = F.array_join(F.transform(rows, lambda r: r.cast("string")), ", ")
    end = F.when(F.size(rows) == 0, "").when(F.size(rows) == 1, F.concat(F.lit(" Representative document: row "), listed, F.lit("."))).otherwise(F.concat(F.lit(" Representative documents: rows "), listed, F.lit(".")))
    return F.concat(label, F.lit(" appears in "), n.cast("string"), F.lit(" response(s), representing "), share.cast("string"), F.lit("% of the filtered sample."), end)


def shortened(c: Column, most: int) -> Column:
    """Collapsed text cut to `most` characters, the last three being dots where it was cut."""
    t = collapse(c)
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(rstrip(F.substring(t, 1, max(0, most - 3))), F.lit("...")))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def language_code(c: Column) -> Column:
    """`auto` for blanks; regional codes in the form translators take."""
    t = strip(F.coalesce(c, F.lit("")))
    f = fold(t)
    return F.when(f.isin("", "auto"), "auto").when(f == "zh-cn", "zh-CN").when(f == "zh-tw", "zh-TW").when(f == "pt-br", "pt").otherwise(t)


# --- vectors -----------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    return once(F.sqrt(dot(v, v)), lambda norm: F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double"))))


def cache_key(provider: Column, model: Column, dimensions: Column, text: Column) -> Column:
    """X22."""
    return F.sha2(F.concat_ws("\x1f", provider, model, dimensions.cast("string"), text), 256)

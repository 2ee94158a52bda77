"""Embedding, translation, language detection and labelling: contracts, deterministic defaults, retries and fallback.

Calls to services run over distinct texts only. The defaults need no network.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as X

BATCH, PROVIDER_MOST = 128, 100


class Embedder(Protocol):
    name: str
    dimensions: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class Translator(Protocol):
    def translate(self, texts: Sequence[str]) -> list[str]: ...


class LabelService(Protocol):
    def label(self, evidence: Sequence[dict]) -> dict[str, str]: ...


class ProviderError(RuntimeError):
    """What went wrong, whether to try again, and when."""

    def __init__(self, message: str, code: str = "provider_error", retry_after: float | None = None, retry: bool = False):
        super().__init__(message)
        self.code, self.retry_after, self.retry = code, retry_after, retry


def seconds_in(text: object) -> float | None:
    """`12.5s`, a number of seconds, or `retry in 3 s` inside a message."""
    t = str(text or "").strip()
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*s?", t, re.IGNORECASE):
        return float(m[1])
    m = re.search(r"retry (?:in|after)\s+(\d+(?:\.\d+)?)\s*s", t, re.IGNORECASE)
    return float(m[1]) if m else None


def classified(status: int, body: str = "", headers: dict[str, str] | None = None) -> ProviderError:
    """408, 429 and 5xx can be tried again unless a daily quota is used up; the wait comes from headers, details or the message."""
    wait = seconds_in((headers or {}).get("Retry-After"))
    if wait is None:
        m = re.search(r'"retryDelay"\s*:\s*"([^"]+)"', body)
        wait = seconds_in(m[1]) if m else seconds_in(body)
    daily = status == 429 and bool(re.search(r"per.?day|daily", body, re.IGNORECASE))
    if status == 429:
        return ProviderError("The daily quota is used up." if daily else "Too many requests.", "quota" if daily else "rate_limit", wait, not daily)
    return ProviderError(f"The provider answered {status}.", "provider_error", wait, status == 408 or status >= 500)


def with_retries(call: Callable[[], object], retries: int = 1, longest: float = 8.0, sleep: Callable[[float], None] = time.sleep):
    """As many further tries as told, after the wait asked for or 1, 2, 4 seconds, never longer than `longest`."""
    for turn in range(retries + 1):
        try:
            return call()
        except ProviderError as e:
            if not e.retry or turn == retries:
                raise
            sleep(min(longest, e.retry_after if e.retry_after is not None else 2.0**turn))
    return None


def in_batches(texts: Sequence[str], size: int = BATCH) -> Iterator[Sequence[str]]:
    for i in range(0, len(texts), size):
        yield texts[i : i + size]


@dataclass(frozen=True)
class HashedEmbedder:
    """The default: signed hashed word counts."""

    dimensions: int = 256
    name: str = "hashed-words"

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", t.casefold()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, (h >> 1) % self.dimensions] += 1 - 2 * (h & 1)
        return out


@dataclass(frozen=True)
class FallbackEmbedder:
    """The second service where the first fails, but not where it only asks to slow down."""

    first: Embedder
    second: Embedder

    @property
    def name(self) -> str:
        return self.first.name

    @property
    def dimensions(self) -> int:
        return self.first.dimensions

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        try:
            return self.first.embed(texts)
        except ProviderError as e:
            if e.code == "rate_limit":
                raise
            return self.second.embed(texts)


def _normalised(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.where(length > 0, v / np.where(length > 0, length, 1), v)


def embed(df: DataFrame, embedder: Embedder, text: str = "text", cache: DataFrame | None = None, batch: int = BATCH, retries: int = 1) -> tuple[DataFrame, DataFrame]:
    """(df with key and embedding, the cache with the new rows).

    Only distinct texts that the cache doesn't hold are sent, in batches; vectors have length 1.
    """
    key = X.cache_key(F.lit("embed"), F.lit(embedder.name), F.lit(embedder.dimensions), F.col(text))
    keyed = df.withColumn("key", key)
    missing = keyed.select("key", F.col(text).alias("t")).where("t IS NOT NULL").dropDuplicates(["key"])
    if cache is not None:
        missing = missing.join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [with_retries(lambda t=t: embedder.embed(t), retries) for t in in_batches(b["t"].tolist(), batch)]
            if parts:
                yield pd.DataFrame({"key": b["key"], "embedding": list(_normalised(np.concatenate(parts)).astype(np.float32))})

    made = missing.mapInPandas(run, "key string, embedding array<float>")
    whole = made if cache is None else cache.select("key", "embedding").unionByName(made)
    return keyed.join(whole, "key", "left"), whole


def detect_language(c, known=None):
    """The given language where it isn't `auto`; else null for texts under eight characters, and a plain guess by function words."""
    t = F.concat(F.lit(" "), X.fold(X.collapse(F.coalesce(c, F.lit("")))), F.lit(" "))
    words = {"en": (" the ", " and ", " of "), "de": (" der ", " die ", " und "), "fr": (" le ", " les ", " et "), "es": (" el ", " los ", " y ")}
    hits = X.once(t, lambda s: F.array(*[sum((F.regexp_count(s, F.lit(w)) for w in ws), F.lit(0)) for ws in words.values()]))
    codes = F.array(*map(F.lit, words))
    guess = X.once(hits, lambda h: F.when(F.array_max(h) > 0, F.element_at(codes, F.array_position(h, F.array_max(h)).cast("int"))))
    guess = F.when(F.char_length(X.strip(c)) >= 8, guess)
    return guess if known is None else F.when(~F.lower(F.coalesce(known, F.lit(""))).isin("", "auto"), known).otherwise(guess)


@dataclass(frozen=True)
class SameText:
    """The default translator: texts stay as they are."""

    def translate(self, texts: Sequence[str]) -> list[str]:
        return list(texts)


def translate(df: DataFrame, translator: Translator, text: str = "text", language: str = "language") -> DataFrame:
    """Df with `translated_text` and `translated`; distinct texts in languages other than English are sent.

    A batch that fails is tried text by text; a text that fails stays as it is. Changes of case alone are none.
    """
    foreign = df.where(F.col(language).isNotNull() & (F.col(language) != "en")).select(F.col(text).alias("source")).where("source IS NOT NULL").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[str] = []
            for part in in_batches(b["source"].tolist()):
                try:
                    found = translator.translate(part)
                    if len(found) != len(part):
                        raise ValueError("as many translations as texts are needed")
                except Exception:  # noqa: BLE001  whatever the service raises
                    found = []
                    for t in part:
                        try:
                            found.append(translator.translate([t])[0])
                        except Exception:  # noqa: BLE001
                            found.append(t)
                out += [" ".join(str(t or "").split()) or s for s, t in zip(part, found)]
            yield pd.DataFrame({"source": b["source"], "found": out})

    made = foreign.mapInPandas(run, "source string, found string")
    joined = df.join(made, (df[text] == made["source"]) & df[language].isNotNull() & (df[language] != "en"), "left")
    changed = F.col("found").isNotNull() & (X.fold(X.collapse(F.col("found"))) != X.fold(X.collapse(F.col(text))))
    return joined.select(*[df[c] for c in df.columns], F.when(changed, F.col("found")).otherwise(F.col(text)).alias("translated_text"), changed.alias("translated"))


def translate_outputs(df: DataFrame, translator: Translator, text: str = "label", done=None) -> DataFrame:
    """Df with the text translated for display, `source_<text>` (the text before, null where nothing changed) and `translated`.

    For labels of groups, terms of n-grams and the texts that represent them. Rows for which the condition `done` holds
    (labels a model wrote, texts translated before) and blank texts stay; equal texts are sent once.
    """
    said = X.strip(F.col(text))
    wanted = said != "" if done is None else (said != "") & ~F.coalesce(done, F.lit(False))
    made = translate(df.withColumns({"__said": said, "__language": F.when(wanted, "auto")}), translator, "__said", "__language")
    shown = F.when(F.col("translated"), F.col("translated_text")).otherwise(F.col(text)).alias(text)
    return made.select(*[shown if c == text else F.col(c) for c in df.columns], F.when(F.col("translated"), F.col("__said")).alias(f"source_{text}"), "translated")


# --- labels by a language model --------------------------------------------------------------------

#: Labels that say nothing, and words of placeholders.
GENERIC = frozenset((
    "feedback", "general feedback", "general responses", "general topics", "misc", "miscellaneous", "mixed", "mixed feedback", "other",
    "other feedback", "other responses", "responses", "survey feedback", "topic", "topics", "uncategorized", "unclear", "unclear feedback",
    "unclear responses", "unknown",
))
PLACEHOLDER_WORDS = frozenset(("abc", "blah", "example", "foo", "ipsum", "lorem", "placeholder", "sample", "test", "todo", "tbd", "xxx"))
#: Sets of words that only a stitched list of keywords has together; none by default, as they belong to one survey.
STITCHED: tuple[frozenset[str], ...] = ()


def label_words(text: str) -> list[str]:
    return [w.casefold() for w in re.findall("[A-Za-z0-9]+", text or "")]


def valid_label(label: str, evidence: Sequence[str] = (), stitched: Sequence[frozenset[str]] = STITCHED) -> bool:
    """Specific, three to eight words, 4 to 80 characters, without placeholders or repetition, and supported by the evidence."""
    words = label_words(label)
    distinct = set(words)
    if " ".join(words) in GENERIC or distinct & PLACEHOLDER_WORDS or not 3 <= len(words) <= 8 or not 4 <= len(label.strip()) <= 80:
        return False
    if len(distinct) == 1 or len(words) >= 4 and len(distinct) <= 2 or any(s <= distinct for s in stitched):
        return False
    known = {w for e in evidence for w in label_words(e) if len(w) > 2}
    content = [w for w in words if w not in GENERIC]
    return not known or bool(content) and (bool(known & set(content)) or len(content) > 2)


def cleaned_label(label: str) -> str:
    """X17."""
    return " ".join(str(label or "").split()).strip(" \"'`.,;:!?-")[:80].rstrip()


def parsed_labels(answer: str, allowed: Sequence[str]) -> dict[str, str]:
    """{group id: label} from `{"labels": [{"group_id": ..., "label": ...}]}`; unknown ids and blanks are left out."""
    try:
        items = json.loads(answer).get("labels", [])
    except (json.JSONDecodeError, AttributeError):
        return {}
    found = ((str(i.get("group_id", "")), cleaned_label(i.get("label", ""))) for i in items if isinstance(i, dict))
    return {k: v for k, v in found if k in set(allowed) and v}


def consolidated(labels: dict[str, str], merges: Sequence[dict], evidence: dict[str, Sequence[str]] | None = None) -> dict[str, str]:
    """Groups of two known ids or more take a valid common label."""
    out = dict(labels)
    for m in merges:
        ids = [str(i) for i in m.get("group_ids", []) if str(i) in labels]
        name = cleaned_label(m.get("label", ""))
        if len(set(ids)) >= 2 and valid_label(name, [e for i in ids for e in (evidence or {}).get(i, ())]):
            out |= dict.fromkeys(ids, name)
    return out


@dataclass
class Labelling:
    """Labels in batches of ten, a failed batch retried and then left out, invalid labels rejected."""

    service: LabelService | None
    batch: int = 10
    retries: int = 1
    sleep: Callable[[float], None] = time.sleep
    warnings: list[str] = field(default_factory=list)

    def __call__(self, evidence: Sequence[dict]) -> dict[str, str]:
        """evidence: per group `group_id` and `texts` (terms, phrases, responses)."""
        if self.service is None:
            return {}
        labels: dict[str, str] = {}
        failed = rejected = 0
        for i in range(0, len(evidence), self.batch):
            part = evidence[i : i + self.batch]
            try:
                found = with_retries(lambda p=part: self.service.label(p), self.retries, sleep=self.sleep)
            except ProviderError:
                failed += 1
                continue
            for g in part:
                if name := cleaned_label(found.get(str(g["group_id"]), "")):
                    if valid_label(name, g.get("texts", ())):
                        labels[str(g["group_id"])] = name
                    else:
                        rejected += 1
        if failed:
            self.warnings.append(f"{failed} labelling batch(es) failed; built-in labels stay.")
        if rejected:
            self.warnings.append(f"{rejected} suggested label(s) were rejected; built-in labels stay.")
        return labels

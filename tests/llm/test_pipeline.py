import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as P
from quillspark.llm import toxicity
from tests.llm import brute


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def shingles(t, k=5):
    w = words(t)
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({" ".join(w)} if w else set())


def topic(t, n):
    t = t or ""
    if t.count("|") * 10 > n:
        return "tabular"
    if sum(map(t.count, "#$%&*")) * 4 > n:
        return "symbolic"
    return "note" if n < 100 else "article" if n < 600 else "essay"


def mixed(rows):
    """doc_ids that the plain form of the fitting keeps."""
    n = {r["doc_id"]: len(brute.WORD.findall(r["text"] or "")) for r in rows}
    cell = {r["doc_id"]: (r["source"] or "", r["lang"] or "", topic(r["text"], n[r["doc_id"]])) for r in rows}
    tokens = {}
    for d, c in cell.items():
        tokens[c] = tokens.get(c, 0) + n[d]
    fitted = {c: float(v) for c, v in tokens.items()}
    targets = []
    for m in range(3):
        t = {}
        for c, v in tokens.items():
            t[c[m]] = t.get(c[m], 0) + v
        t = {k: v**0.8 for k, v in t.items()}
        targets.append({k: v / sum(t.values()) for k, v in t.items()})
    for _ in range(20):
        for m, t in enumerate(targets):
            whole = {}
            for c, v in fitted.items():
                whole[c[m]] = whole.get(c[m], 0) + v
            fitted = {c: v * t[c[m]] / whole[c[m]] if whole[c[m]] > 0 else 0.0 for c, v in fitted.items()}
    factor = {c: fitted[c] / tokens[c] for c in tokens if tokens[c]}
    top = max(factor.values())
    draw = lambda d: int(hashlib.md5(f"mix:{d}".encode()).hexdigest()[:13], 16) / (1 << 52)
    return {d for d, c in cell.items() if draw(d) < (round(factor[c] / top, 9) if c in factor else 1.0)}


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(P.materialise(stage(spark, out[-1], sf), "test"))
    return out


def test_stages_are_named_and_keep_the_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "tokens"]
    assert all(tuple(s.columns) == P.COLUMNS for s in stages[:-1])


def test_toxicity_stage_drops_what_the_model_rejects(spark, sf, stages):
    model = toxicity.train(stages[0], spark.read.parquet(f"{sf}/labels.parquet"))
    rows = stages[0].collect()
    keep = {r["doc_id"] for r, p in zip(rows, toxicity.probabilities(model, [r["text"] for r in rows])) if p < 0.5}
    assert {r["doc_id"] for r in stages[1].collect()} == keep and 0 < len(keep) < len(rows)


def test_near_dedup_stage_equals_brute_force(stages):
    found = brute.near([(r["doc_id"], r["text"]) for r in stages[1].collect()], 80)
    assert {r["doc_id"] for r in stages[2].collect()} == {d for d, (_, c) in found.items() if c == d}


def test_decontamination_stage_equals_brute_force(spark, sf, stages):
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    keep = {r["doc_id"] for r in stages[2].collect() if not any(i and len(i & shingles(r["text"])) >= 0.8 * len(i) for i in items)}
    assert {r["doc_id"] for r in stages[3].collect()} == keep


def test_mixing_stage_equals_the_plain_fitting(stages):
    assert {r["doc_id"] for r in stages[4].collect()} == mixed(stages[3].collect())


def test_token_stage_equals_the_library(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, want = 0, set()
    for r in sorted(stages[4].collect(), key=lambda r: r["doc_id"]):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want.add((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {tuple(r) for r in stages[5].collect()} == want


def test_stages_take_empty_and_hard_tables(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    hard = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "a b", None, "s", 3), (4, "w " * 30_000, "en", "s", 1), (4, "again", "en", "s", 1)]
    for rows in ([], hard):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in P.STAGES:
            docs = P.materialise(stage(spark, docs, sf), "test")
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and docs.count() <= len(rows)

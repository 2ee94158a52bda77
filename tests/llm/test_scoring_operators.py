"""Operators 11 to 13, and the mends of mixing and url rules, against plain code."""

import os
import random
import subprocess
import sys
import zlib
from itertools import permutations

import numpy as np
import pytest

from quillspark.llm import filter_audit, mixing, quality, url_rules, whitening
from tests.llm import brute
from tests.llm.test_operators import DOCS, HARD, docs

# --- 3 and 7 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [100_000, 0])
def test_sample_holds_the_rows_that_mix_keeps(spark, monkeypatch, most):
    """Rows of one doc_id in different cells part as their cells say."""
    monkeypatch.setattr(mixing, "MOST_CELLS", most)
    rows = [(i % 40, "w " * (3 + i % 11), "en", f"s{i % 4}", i, "x", None, "y") for i in range(400)] + [(None, None, None, None, 1, "x", None, "y")] * 2
    d = spark.createDataFrame(rows, DOCS)
    targets = {"source": {"s0": 1, "s1": 0.3, "s2": 0.05, "": 1}}
    want = sorted(map(repr, ((r["doc_id"], r["source"], r["n_tokens"]) for r in mixing.mix(d, targets=targets).where("kept").collect())))
    out = mixing.sample(d, targets=targets)
    assert out.columns == d.columns
    got = sorted(map(repr, ((r["doc_id"], r["source"] or "", len((r["text"] or "").split())) for r in out.collect())))
    assert got == want and 0 < len(got) < len(rows)
    assert mixing.sample(d.where("false")).count() == 0


def test_words_and_signs_are_counted_as_plain_code_does(spark):
    texts = [None, "", " \t\r\n\x0b\x0c", "a", " a", "a ", "\n a\x0bb\tc ", "ü\u00a0ü  |\U0001f600| #$ %&*", "\x1c \x85", "$1 \\1 .", "x" * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    t = mixing.text_or_empty()
    got = rows.select("id", mixing.n_words(), mixing.n_signs(t, "|"), mixing.n_signs(t, "#$%&*")).collect()
    plain = {i: (len(brute.WORD.findall(t or "")), (t or "").count("|"), sum(map((t or "").count, "#$%&*"))) for i, t in enumerate(texts)}
    assert {r[0]: tuple(r[1:]) for r in got} == plain


def test_long_texts_of_a_mix_need_little_memory():
    """A text of six million words, counted and put into its cell, in a heap in which a list of the words has no room."""
    code = """
from pyspark.sql import SparkSession, functions as F
from quillspark.llm import mixing
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
rows = spark.range(1).select(F.repeat(F.concat(F.lit("ab "), F.substring(F.col("id").cast("string"), 2, 1)), F.lit(6_000_000)).alias("text"))
rows = rows.withColumn("n", mixing.n_words()).withColumn("topic", mixing.form_topic(F.col("n")))
print("FOUND", *rows.select("n", "topic").first())
"""
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 480m pyspark-shell"}
    run = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND 6000000 essay" in run.stdout, run.stderr[-2000:]


def test_url_rules_equal_a_plain_search(spark):
    rng = random.Random(3)
    label = lambda: rng.choice(["a", "b", "net", "\x01", "\x02a", "a\x01", "x\x02", ""])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice(["a", "/", "b/", "\x01"]) for _ in range(rng.randint(0, 5)))
    rules = sorted({(host(), path()): rng.choice(["allow", "block"]) for _ in range(300)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = ["http://net\x01evil/a", "http://evil\x01.net/a", *(f"http://{host()}{path()}" for _ in range(600))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, [("net", "/", "block"), *rules], default="none").collect()}
    for i, u in enumerate(urls):
        h, _, p = u[7:].partition("/")
        fits = [(a + q, v) for a, q, v in [("net", "/", "block"), *rules] if (h == a or h.endswith("." + a)) and f"/{p}".startswith(q)]
        names = {n for n, _ in fits}
        best = max(names, key=lambda n: (len(n), n), default=None)
        assert out[i][0] == best and (out[i][1] in {v for n, v in fits if n == best} if best else out[i][1] == "none")
    assert out[0] == (None, "none") and out[1][0] is not None


# --- 11 ------------------------------------------------------------------------------------------


def test_features_count_what_they_say():
    texts = ["One two two.\n\nONE two two.\nend#", "", None, " \t\n", "x" * 5000, "日本 é", "a b a b a b"]
    x = dict(zip(quality.FEATURES, quality.features(texts).T))
    words = [brute.WORD.findall(t or "") for t in texts]
    assert np.allclose(np.expm1(x["words"]), [len(w) for w in words])
    assert np.allclose(x["distinct"], [len(set(w)) / max(1, len(w)) for w in words])
    assert np.allclose(x["word_length"], [sum(map(len, w)) / max(1, len(w)) for w in words])
    threes = [[tuple(w[i : i + 3]) for i in range(len(w) - 2)] for w in words]
    assert np.allclose(x["distinct_threes"], [len(set(t)) / len(t) if t else 1.0 for t in threes])
    assert np.allclose(x["commonest"], [max((w.count(v) for v in w), default=0) / max(1, len(w)) for w in words])
    assert np.isclose(x["capitals"][0], 4 / 21) and np.isclose(x["marked"][0], 1 / len(texts[0])) and np.isclose(x["odd_ends"][0], 1 / 7)
    lines = quality.features(["same line\nsame line\nother\n\n", "one"])[:, quality.FEATURES.index("repeated_lines")]
    assert np.allclose(lines, [1 / 3, 0])
    assert quality.features([]).shape == (0, len(quality.FEATURES))
    one_by_one = np.concatenate([quality.features([t]) for t in texts])
    assert np.allclose(one_by_one, quality.features(texts))


def test_trees_find_the_best_cuts():
    rng = np.random.default_rng(0)
    for _ in range(20):
        g, h = rng.normal(size=6), rng.random(6) + 0.1
        worth = lambda parts: sum(g[p].sum() ** 2 / (h[p].sum() + quality.RIDGE) for p in parts)
        gain, k = quality._cut(g, h)
        best = max(worth([slice(0, i), slice(i, 6)]) for i in range(1, 6)) - worth([slice(0, 6)])
        assert np.isclose(gain, max(0, best), atol=1e-8)
        tree = quality.shallow_tree(g, h, 1)
        if k:
            assert np.allclose(tree[:k], g[:k].sum() / (h[:k].sum() + quality.RIDGE))
        grid_g, grid_h = rng.normal(size=(3, 4)), rng.random((3, 4)) + 0.1
        gain, values = quality.pair_tree(grid_g, grid_h)
        loss = lambda v: (2 * grid_g * v - grid_h * v * v).sum() - quality.RIDGE * sum(x * x for x in np.unique(v))
        assert np.isclose(gain, loss(values) - grid_g.sum() ** 2 / (grid_h.sum() + quality.RIDGE), atol=1e-6)
        assert len(np.unique(values)) <= 4


def test_the_model_learns_an_interaction_and_adds_tables():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x[:3000], y[:3000], rounds=120)
    assert ((m.probability(x[3000:]) >= 0.5) == (y[3000:] == 1)).mean() > 0.95 and (0, 1) in m.pairs
    for row in x[:20]:
        plain = m.base + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(row, m.edges, m.tables))
        plain += sum(t[sum(row[a] >= e for e in m.coarse[a])][sum(row[b] >= e for e in m.coarse[b])] for (a, b), t in zip(m.pairs, m.pair_tables))
        assert np.isclose(plain, m.logits(row[None])[0])
    only = quality.fit(x, np.ones(len(x)))
    assert (only.probability(x) > 0.99).all() and quality.fit(np.zeros((0, 4)), np.zeros(0)).probability(x).min() > 0.99


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.score_documents(d, quality.train(d, labels)).join(labels, "doc_id").toPandas()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out["doc_id"]]).all()
    held = out[out["held_out"]]
    assert len(held) > 800 and ((held["predicted"] == 1) == (held["quality"] == 1)).mean() > 0.99
    assert held["score"].between(0, 1).all() and ((held["score"] >= 0.7) == (held["predicted"] == 1)).all()


def test_quality_of_hard_and_empty_tables(spark):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (6, 1, 0), (8, None, 1), (None, 0, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    for d in (docs(spark, HARD), docs(spark, [])):
        m = quality.train(d, labels)
        out = quality.score_documents(d, m).collect()
        assert len(out) == d.count() and all(0 <= r["score"] <= 1 for r in out)
    part = quality.train(docs(spark, [(i, "w " * i) for i in range(200)]), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int"), most=50)
    assert len(part.tables) == len(quality.FEATURES)


# --- 12 ------------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    """(part, order, step) -> the seven counts, document by document."""
    least, out = {}, {}
    for i, text, source in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails = []
    for i, text, source in rows:
        t = text or ""
        w = brute.WORD.findall(t)
        capitals = sum("A" <= c <= "Z" for c in t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * capitals > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        fails.append((source or "", bad, any(q == 1 for d, q, _ in labels if d == i and i is not None), any(x == 1 for d, _, x in labels if d == i and i is not None)))
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        whole = dict.fromkeys("ABCDE", 0)
        for o in orders:
            left = own
            for k, x in enumerate(o):
                gone = [f for f in left if f[1][x]]
                left = [f for f in left if not f[1][x]]
                whole[x] += len(gone)
                failing = sum(f[1][x] for f in own)
                unique = sum(f[1][x] and sum(f[1].values()) == 1 for f in own)
                out[part, o, k + 1] = [len(left), len(gone), failing - len(gone), unique, sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, o, k), v in out.items():
            if p == part:
                v.append(whole[o[k - 1]])
    return out


def test_filter_audit_of_hard_tables(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    made = [" ".join(rng.choices(words[: rng.choice([5, 400])], k=rng.choice([50, 300]))) + rng.choice(["", " |", " A" * 40]) for _ in range(30)]
    rows = [(rng.randrange(40), rng.choice([*made, None, ""]), rng.choice(["a", "b", None, ""])) for _ in range(300)]
    rows += [(i, t, "hard") for i, t in HARD] + [(7, made[0], "c")] * 3 + [(8, made[0], "c"), (None, made[0], "c"), (None, "#", "c"), (None, "#", "c")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 40, 2)] + [(2, 1, None), (2, None, 1), (None, 1, 1), (500, 1, 1)]
    labels = [(a, b, None if c is None else int(c)) for a, b, c in labels]
    d = spark.createDataFrame([(i, t, None, s, None, "x", None, "y") for i, t, s in rows], DOCS)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.audit(d, table).collect()}
    assert out == plain_audit(rows, labels)
    assert filter_audit.audit(d.where("false"), table).count() == 0
    assert filter_audit.audit(d, table.where("false")).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()[0] == 0


# --- 13 ------------------------------------------------------------------------------------------


def embedded(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, w string")


def test_whitening_equals_plain_algebra(spark):
    rng = np.random.default_rng(0)
    made = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) / 9).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(made)] + [(5, [float(x) for x in made[9]])] * 100
    odd = [(700, None), (701, [None] * 40), (702, [float("nan")] + [0.0] * 39), (703, [0.0] * 39 + [float("-inf")]), (704, [1.0, None] + [0.0] * 38)]
    out = whitening.whiten(embedded(spark, rows + odd)).toPandas()
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    value, axes = np.linalg.eigh(c.T @ c / n)
    value, axes = value[::-1], axes[:, ::-1]
    want = (c @ axes[:, :32]) / np.sqrt(value[:32])
    deviation = ((n * x - s) ** 2).sum(1)
    assert len(out) == 32 * n and set(out["n"]) == {n} and out["identity_error"].nunique() == 1 and out["identity_error"][0] < 1e-9
    for k in range(32):
        own = out[out["component"] == k + 1]
        assert np.allclose(own["explained"], value[k] / value.sum(), rtol=1e-9)
        by_id = own.groupby("vec_id")["whitened"].first()
        sign = np.sign(by_id[0] * want[0, k])
        assert np.allclose(by_id[np.arange(300)], sign * want[:300, k], atol=1e-7)
    assert dict(zip(out["vec_id"], out["deviation"])).items() >= {i: deviation[i] for i in range(300) if i != 5}.items()
    assert len(out[(out["vec_id"] == 5) & (out["component"] == 1)]) == 101


def test_whitening_of_hard_tables(spark):
    assert whitening.whiten(embedded(spark, [])).count() == 0
    assert whitening.whiten(embedded(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(embedded(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance, no component
    line = whitening.whiten(embedded(spark, [(None, [1.0, 2.0]), (2, [2.0, 4.0]), (2, [2.0, 4.0])])).collect()
    assert len(line) == 3 and {r["component"] for r in line} == {1} and all(abs(r["explained"] - 1) < 1e-12 and r["identity_error"] < 1e-9 for r in line)
    with pytest.raises(ValueError, match="lengths"):
        whitening.whiten(embedded(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(embedded(spark, [(1, [1e30]), (2, [1.0])]))
    large = whitening.whiten(embedded(spark, [(1, [1e10, 0.0]), (2, [-1e10, 0.0]), (3, [0.0, 1.0])])).collect()
    assert {r["deviation"] for r in large if r["vec_id"] == 1} == {None}

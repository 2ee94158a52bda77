import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import chat_format, decontamination, exact_dedup, lm_scoring, mixing, near_dedup, queries, sharding, token_store, toxicity, url_rules
from quillspark.llm.common import distinct_sets, numbered_shingles, shingle_hashes
from tests.llm import brute
from tests.oracle import assert_same, connect

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, d string, key string, h string"


def docs(spark, rows):
    """(doc_id, text) rows with other columns, some of whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, None, None, "x", None, "y") for i, t in rows], DOCS)


HARD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b c d e f g"), (7, "a  b c\nd e f g"), (8, "x" * 50_000), (9, "é ß ½ 日本"), (10, "w " * 30_000), (None, "a b c d e f g"), (None, None), (12, "a b c d e f g")]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    assert_same(queries.QUERIES[name](spark, sf), con, queries.ORACLE[name])


# --- 1 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("tolerance", [0.005, 0.05])
def test_shards_equal_a_plain_placement(spark, tolerance):
    """Shards are runs of the (hash, doc_id) order whose ends lie within the tolerance of the even cuts; slots count from 0."""
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [(i, "t" * rng.randint(1, 400) if i % 3 else "the copy") for i in range(3000)] + [(5, "twice")] * 7 + HARD
    d = docs(spark, rows)
    out = sharding.shard_documents(d, 8, tolerance).withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).toPandas()
    assert sorted(map(repr, zip(out["doc_id"].astype(object).where(out["doc_id"].notna(), None), out["text"]))) == sorted(map(repr, ((None if i is None else float(i), t) for i, t in rows)))
    assert (out["size"] == [16 + len((t or "").encode()) for t in out["text"]]).all()
    out = out.sort_values(["shard", "slot"]).reset_index(drop=True)
    key = list(zip(out["h"], out["doc_id"].fillna(-(1 << 63))))
    assert key == sorted(key) and list(out["slot"]) == list(out.groupby("shard").cumcount())
    whole, largest = out["size"].sum(), out["size"].max()
    same = out.groupby([out["h"], out["doc_id"].fillna(-1)])["size"].sum().max()  # rows alike in both are never parted
    ends = out.groupby("shard")["size"].sum().reindex(range(8), fill_value=0).cumsum()
    for k in range(7):
        assert abs(ends[k] - whole * (k + 1) // 8) <= max(tolerance * whole / 8, same, largest)


def test_shards_in_pieces_are_the_same_kind(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_BYTES", 4000)
    rows = [(i, "t" * (i % 97)) for i in range(2000)]
    out = sharding.shard_documents(docs(spark, rows), 5, 0.05).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(out) == 2000 and sizes.max() - sizes.min() <= 0.05 * sizes.mean() + 200
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_shards_of_hard_and_empty_tables(spark):
    out = sharding.shard_documents(docs(spark, HARD), 3).collect()
    assert len(out) == len(HARD) and {r["size"] for r in out if r["text"] is None} == {16}
    assert sharding.shard_documents(docs(spark, []), 4).count() == 0


# --- 2 -----------------------------------------------------------------------------------------


def test_contamination_of_hard_tables(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [*HARD, (20, "Lead in. One, two three four five six seven eight NINE ten! and on"), (21, "one two three four five"), (21, item), (22, "filler " * 20_000 + item)]
    items = spark.createDataFrame([(1, item, "z"), (2, None, "z"), (3, "", "z"), (None, item, "z"), (4, "a", "z"), (1, item, "z")], "item_id long, text string, doc_id string")
    out = {(r["doc_id"], r["item_id"]): (r["item_shingles"], r["found"]) for r in decontamination.contaminated(docs(spark, rows), items).collect()}
    assert out == {(20, 1): (6, 6), (21, 1): (6, 6), (22, 1): (6, 6), (4, 4): (1, 1), (5, 4): (1, 1)}
    assert decontamination.contaminated(docs(spark, []), items).count() == 0
    assert decontamination.contaminated(docs(spark, rows), items.where("false")).count() == 0
    assert decontamination.decontaminate(docs(spark, rows), items).count() == len(rows) - 6


# --- 3 -----------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mix(d).toPandas()
    assert len(out) == d.count() and out["probability"].max() == 1.0
    out["w"] = out["n_tokens"] * out["probability"]
    for m in mixing.MARGINS:
        tokens = out.groupby(m)["n_tokens"].sum() ** 0.8
        want, got = tokens / tokens.sum(), out.groupby(m)["w"].sum() / out["w"].sum()
        assert (want - got).abs().max() < 1e-3


def test_mixing_to_given_weights(spark):
    rows = [(i, "w " * (5 + i % 7), "en" if i % 2 else "de", f"s{i % 3}", 1, "x", None, "y") for i in range(600)] + [(9000, "w " * 30_000, "en", "s0", 1, "x", None, "y"), (5, "w w", "en", "s1", 1, "x", None, "y"), (5, "w w", "en", "s1", 1, "x", None, "y")]
    d = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(d, targets={"source": {"s0": 1, "s1": 3}, "lang": {"en": 0.25, "de": 0.75}, "topic": {"note": 1, "essay": 1e-9}}).toPandas()
    assert len(out) == len(rows) and (out[out["source"] == "s2"]["probability"] == 0).all()
    w = out["n_tokens"] * out["probability"]
    share = lambda c, v: w[out[c] == v].sum() / w.sum()
    assert abs(share("source", "s1") - 0.75) < 1e-3 and abs(share("lang", "de") - 0.75) < 1e-3
    with pytest.warns(UserWarning, match="off their targets"):
        mixing.mix(d.where("source = 's0' and lang = 'en' or source = 's1' and lang = 'de'"), targets={"source": {"s0": 1, "s1": 3}, "lang": {"en": 3, "de": 1}}).count()


def test_mixing_of_hard_and_empty_tables(spark):
    out = mixing.mix(docs(spark, HARD)).collect()
    assert len(out) == len(HARD) and all(0 <= r["probability"] <= 1 for r in out)
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None), (2, " ")])).count() == 2


# --- 4 -----------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("<s>/[]INST\\-ab")), max_size=40))
def test_escaping_is_reversible_and_hides_controls(text):
    shown = chat_format.escape(text)
    assert chat_format.unescape(shown) == text
    assert not any(c in shown for c in chat_format.CONTROLS)


def test_chat_of_hard_tables(spark):
    rows = [(1, 1, "assistant", "<|endoftext|> ok"), (1, 0, "user", None), (2, 0, None, "é\\-[INST]"), (2, 0, "assistant", ""), (None, None, "assistant", "x"), (1, 2, "assistant", "more")]
    c = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, known string")
    out = {r["conv_id"]: r for r in chat_format.conversation_digests(chat_format.format_conversations(c, TOKENIZER), TOKENIZER).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert out[1]["turns_sha256"] == sha("user\n\nassistant\n<|endoftext|> ok\nassistant\nmore\n")
    assert (out[1]["loss_sha256"], out[1]["loss_chars"], out[1]["n_turns"]) == (sha("<|endoftext|> okmore"), 20, 3)
    assert out[2]["turns_sha256"] == sha("\né\\-[INST]\nassistant\n\n") and out[2]["loss_chars"] == 0
    assert out[None]["loss_sha256"] == sha("x")
    empty = chat_format.format_conversations(c.where("false"), TOKENIZER)
    assert chat_format.conversation_digests(empty, TOKENIZER).count() == 0


# --- 5 -----------------------------------------------------------------------------------------


def test_exact_duplicates_of_hard_tables(spark):
    out = exact_dedup.exact_duplicates(docs(spark, [*HARD, (30, "a\u00a0b"), (31, "ab")])).collect()
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert len(out) == len(HARD) + 2
    assert {by[i]["keep_id"] for i in (1, 2, 3)} == {3} and by[1]["group_size"] == 4  # a null id counts in its group
    assert by[7]["keep_id"] == 7 and by[6]["keep_id"] == 7 and not by[6]["kept"] and by[12]["keep_id"] == 7
    assert by[30]["group_size"] == by[31]["group_size"] == 1
    assert by[4]["text_sha256"] == hashlib.sha256(b"a").hexdigest()
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


def test_one_row_of_exact_duplicates_stays(spark):
    rows = [(1, "ab"), (1, "a b"), (2, "x"), (2, "x"), (2, "x"), (None, "n"), (None, "n"), (3, "ab"), (4, "alone")]
    out = exact_dedup.exact_duplicates(docs(spark, rows)).collect()
    kept = sorted((r["text_sha256"], r["doc_id"] or 0) for r in out if r["kept"])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(out) == len(rows) and kept == sorted([(sha("ab"), 1), (sha("x"), 2), (sha("n"), 0), (sha("alone"), 4)])
    assert {r["group_size"] for r in out if r["doc_id"] in (1, 3)} == {3}


def test_equal_digests_of_different_texts_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.char_length(c).cast("string"))
    out = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_duplicates(docs(spark, [(1, "aa"), (2, "bb"), (3, "a a"), (4, "c")])).collect()}
    assert out == {1: 3, 2: 2, 3: 3, 4: 4}


# --- 6 -----------------------------------------------------------------------------------------


def test_toxicity_is_learned_and_tolerates_gaps():
    rng = random.Random(3)
    syllables = ["than", "er", "ion", "wh", "ed", "he", "ou", "st", "re"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    text = lambda bad: ". ".join(" ".join([word() for _ in range(8)] + ([rng.choice(["scoundrel", "blockhead", "numbskull"])] if bad and k == 2 else [])) for k in range(5))
    labels = [int(i % 4 == 0) for i in range(400)]
    model = toxicity.fit([text(y) for y in labels], labels)
    score = lambda t: float(model.probability(np.array([max(model.raw([w for k in toxicity.tokens_of(t) for w in toxicity.readings(k)]), default=model.bias)]))[0])
    new = [(text(y), y) for y in [0, 1] * 100]
    assert np.mean([(score(t) >= 0.5) == y for t, y in new]) > 0.97
    for t in ("you block-head", "s.c.o.u.n.d.r.e.l", "n u m b s k u l l", "blockxhead", "scoundrels"):
        assert score(t) >= 0.5, t
    put_in = [w[:i] + c + w[i:] for w in ("scoundrel", "blockhead", "numbskull") for i in range(1, len(w)) for c in "aekxz"]
    doubled = [w[:i] + w[i - 1] + w[i:j] + w[j - 1] + w[j:] for w in ("scoundrel", "blockhead", "numbskull") for i in range(1, len(w)) for j in range(i + 1, len(w) + 1)]
    assert np.mean([score(t) >= 0.5 for t in put_in]) >= 0.95 and np.mean([score(t) >= 0.5 for t in doubled]) >= 0.95  # recall of insults with inserted letters
    assert score("") < 0.5


def test_toxicity_kernel_is_the_subsequence_kernel():
    def slow(s, t):
        from itertools import combinations

        weights = lambda w: [("".join(w[i] for i in c), toxicity.DECAY ** (c[-1] - c[0] + 1)) for c in combinations(range(len(w)), 3)]
        return sum(x * y for a, x in weights(s) for b, y in weights(t) if a == b)

    words = ["abcab", "acb", "aabbcc", "zab"]
    got = toxicity.kernel(words, toxicity.profiles(words))
    want = [[slow(a, b) / (slow(a, a) * slow(b, b)) ** 0.5 for b in words] for a in words]
    assert np.allclose(got, want, atol=1e-5)


def test_toxicity_on_held_out_documents(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    out = toxicity.score_documents(d, toxicity.train(d, labels)).where("held_out").join(labels, "doc_id").toPandas()
    assert ((out["predicted"] == out["toxic"]).mean()) > 0.9
    hard = docs(spark, HARD + HARD[:2])
    fitted = toxicity.train(d, labels)
    scored = toxicity.score_documents(hard, fitted).collect()
    texts = [t for _, t in HARD + HARD[:2]]
    assert len(scored) == len(texts) and all(0 <= r["score"] <= 1 for r in scored)
    # a document's score is the curve at the best kernel machine value of its readings
    sample = [r["text"] for r in d.limit(40).collect()] + texts
    want = []
    for t in sample:
        read = [w for k in toxicity.tokens_of(t or "") for w in toxicity.readings(k)]
        dense = [float(toxicity.profiles([w])[0] @ fitted.weights) + fitted.bias for w in set(read)]
        want.append(1 / (1 + np.exp(-np.clip(fitted.slope * max(dense, default=fitted.bias) + fitted.offset, -30, 30))))
    assert np.allclose(toxicity.probabilities(fitted, sample), want, atol=1e-4)
    hard = docs(spark, HARD)
    assert toxicity.score_documents(hard, toxicity.train(hard, labels.where("false"))).count() == len(HARD)
    assert toxicity.keep_clean(hard, toxicity.train(hard, labels.where("false"))).count() == len(HARD)
    assert toxicity.score_documents(docs(spark, []), toxicity.train(d, labels)).count() == 0


# --- 7 -----------------------------------------------------------------------------------------


def test_url_rules_of_hard_tables(spark):
    urls = [None, "", "no scheme", "http://", "http://NET/", "http://net", "http://a.net/x?y", "https://sub.example.net/en/1#t", "x://example.net:80/en/", "http://notexample.com/de/", "http://example.com/de/a", "http://org/fr/", "http://a.b.org/fr/x?://y", "http://net./", "a\nb://x.net/\n"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(4, "http://NET/", "z")], "page_id long, url string, part string")

    def plain(u):
        _, sep, rest = (u or "").partition("://")
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:cut].translate(brute.LOWER), rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        fits = [(h + p, v) for h, p, v in queries.URL_RULES if sep and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, "allow")))

    table = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block"), ("nowhere.else", "/", "block")], "host string, path string, verdict string")
    assert sorted(map(repr, url_rules.judge_urls(pages, table).collect())) == sorted(map(repr, url_rules.judge_urls(pages, queries.URL_RULES).collect()))
    hot = spark.range(3000).selectExpr("id page_id", "concat('http://www.example.net/en/', id % 5, repeat('x', 2000)) url")
    assert [tuple(r) for r in url_rules.judge_urls(hot, queries.URL_RULES).groupBy("rule", "verdict").count().collect()] == [("example.net/en/", "allow", 3000)]
    out = [tuple(r) for r in url_rules.judge_urls(pages, queries.URL_RULES).collect()]
    want = [(i, *plain(u)) for i, u in enumerate(urls)] + [(4, *plain("http://NET/"))]
    assert sorted(map(repr, out)) == sorted(map(repr, want))
    assert url_rules.judge_urls(pages.where("false"), queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in url_rules.judge_urls(pages, []).collect()} == {"allow"}


# --- 8 -----------------------------------------------------------------------------------------


def near_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(160)]
    rows, n = [], 0
    for edits in [0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 6] * 12:  # a large group whose members link in part
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((n := n + 1, " ".join(w)))
    rows += [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    return rows + [(2000 + i, t.upper()) for i, t in rows[-20:]]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_equal_brute_force(spark, percent):
    rows = near_rows()
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, rows), percent).collect()}
    assert out == brute.near(rows, percent)


def mirrored(letters):
    """Two texts of so many letters a and b, each with a where the other has b, whose sums under any polynomial modulo 2**64 are equal."""
    a, b = "a", "b"
    while len(a) < letters:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("letters", [1024, 2048])
def test_mirrored_words_are_different(spark, letters):
    a, b = mirrored(letters)
    out = near_dedup.near_duplicates(docs(spark, [(1, a), (2, b), (3, f"x {a} y z u"), (4, f"x {b} y z u")])).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {1: 1, 2: 2, 3: 3, 4: 4}
    e = token_store.Encoder(TOKENIZER)
    assert all(np.array_equal(x, y) for x, y in zip(e.library([a, b, a]), e([a, b, a])))


@pytest.mark.parametrize("least", [60_000, 2_000])
def test_near_duplicates_outside_the_main_part_of_a_bucket(spark, monkeypatch, least):
    """Many groups of near copies whose members differ too much from the other groups' but share buckets with them."""
    monkeypatch.setattr(near_dedup, "BLOCK_LEAST", least)
    monkeypatch.setattr(near_dedup, "BATCH", 20)
    monkeypatch.setattr(near_dedup, "ROWS", 2)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    common, rows, n = [rng.choice(vocabulary) for _ in range(120)], [], 0
    for _ in range(12):
        own = [rng.choice(vocabulary) for _ in range(40)]
        for k in range(12):
            w = common + own
            w[rng.randrange(160)] = f"odd{k}"
            rows.append((n := n + 1, " ".join(w)))
    rng.shuffle(rows)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, rows), 85, rows=2).collect()}
    assert out == brute.near(rows) and len({c for _, c in out.values()}) > 3


def test_near_duplicates_of_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, ""), (1, text), (1, other), (2, text + " more"), (3, other + " more"), (4, "alone in here")]
    out = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert out == {(1, 1), (2, 1), (3, 1), (4, 4)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=9), max_size=6), st.integers(2, 5))
def test_numbered_shingles_are_the_shingles(texts, k):
    at = np.cumsum([0, *map(len, texts)])
    got = numbered_shingles(np.array([w for t in texts for w in t], np.int64), at, k)
    want = [{tuple(t[i : i + k]) for i in range(len(t) - k + 1)} if len(t) >= k else {tuple(t)} if t else set() for t in texts]
    assert [[len(set(a) & set(b)) for b in got] for a in map(list, got)] == [[len(a & b) for b in want] for a in want]


def test_near_duplicates_of_hard_tables(spark):
    out = near_dedup.near_duplicates(docs(spark, HARD)).collect()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out if r["doc_id"] is not None}
    assert len(out) == len(HARD)
    assert by[1] == (0, 1, True) and by[3] == (0, 3, True) and by[5] == (1, 4, False) and by[7] == (3, 6, False) and by[12] == (3, 6, False) and by[10] == (1, 10, True)
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    assert near_dedup.drop_duplicates(docs(spark, HARD)).count() == len(HARD) - 3


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abC é\t\n ")), max_size=40), max_size=6))
def test_shingle_hashes_count_shingles(texts):
    assert [len(s) for s in distinct_sets(*shingle_hashes(texts))] == [len(brute.shingle_set(t)) for t in texts]


# --- 9 -----------------------------------------------------------------------------------------


def lm_brute_force(rows, target):
    """(n_tokens, target loss, background loss) of each (doc_id, text) row under the counts of all other rows."""
    from collections import Counter
    from math import log

    said = [brute.WORD.findall((t or "").translate(brute.LOWER)) for _, t in rows]
    good = [d in target for d, _ in rows]
    count = lambda ws: (Counter(zip(["", *ws[:-1]], ws)), Counter(ws), Counter(["", *ws[:-1]]) if ws else Counter())
    each = [count(ws) for ws in said]
    both = [[sum((e[k] for e, g in zip(each, good) if g or not of_target), Counter()) for k in range(3)] for of_target in (True, False)]
    whole, size = [sum(x[1].values()) for x in both], len(both[1][1])
    out = []
    for ws, own, g in zip(said, each, good):
        losses = []
        for x, total, scale, mine in ((both[0], whole[0], 1.0, g), (both[1], whole[1], whole[0] / max(1, whole[1]), True)):
            pair, word, history = ([(c[w] - mine * o[w]) * scale for w in keys] for c, o, keys in zip(x, own, (list(zip(["", *ws[:-1]], ws)), ws, ["", *ws[:-1]])))
            losses.append(sum(-log((p + 64 * ((u + 1) / (total * scale + size))) / (h + 64)) for p, u, h in zip(pair, word, history)) / len(ws) if ws else None)
        out.append((len(ws), *losses))
    return out


@pytest.mark.parametrize("chars", [2_000_000, 60_000])
def test_lm_scores_equal_brute_force(spark, sf, monkeypatch, chars):
    monkeypatch.setattr(lm_scoring, "BATCH_CHARS", chars)
    monkeypatch.setattr(lm_scoring, "PART_TOKENS", chars // 10)
    rows = [*HARD, (6, "b b c"), (None, "c b"), (500, "g " * 300 + "a b"), (501, "g " * 290), *((1000 + i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()))]
    d = docs(spark, rows).repartition(3)
    for target in ({6, 500, *range(1000, 1030)}, set()):
        ids = spark.createDataFrame([(i,) for i in (*target, None, 77, *target)], "doc_id long")
        got = lm_scoring.score_documents(d, ids).collect()
        want = lm_brute_force(rows, target)
        shown = lambda d, n, *x: repr((d, n, *(v if v is None else round(v, 6) + 0.0 for v in x)))
        assert sorted(shown(*r[:4]) for r in got) == sorted(shown(d, *w) for (d, _), w in zip(rows, want))
        assert all((r["score"] is None) == (r["n_tokens"] == 0) for r in got)
    assert lm_scoring.score_documents(d.where("false"), ids).count() == 0


def test_lm_scores_tell_rare_words_apart(spark):
    rows = [(i, "one two three") for i in range(1200)] + [(2000, "rare words here"), (2002, "rare words here"), (2001, "other things there")]
    rows += [(3000 + i, f"w{i} " * 3) for i in range(1100)]
    d = docs(spark, rows)
    out = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(d, d.where("doc_id = 2000")).collect()}
    assert len(out) == len(rows) and out[2002] < out[2001] < out[0]


# --- 10 ----------------------------------------------------------------------------------------


def test_encoder_equals_the_library():
    e = token_store.Encoder(TOKENIZER)
    rng = random.Random(1)
    texts = ["", " ", "\n", "a  b \n\n c\t d  ", "it's we'll  12½ ² ª", "x<|endoftext|>y", "日本語 ß  \u0085 \x1c q", "\xa0 \xad a\xa0b", " ".join(map(chr, range(0x20, 0x250))), "\r\n\r\n x"]
    texts += ["".join(rng.choice(" \n\t\r'sabAé1.,ß²!-") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for _ in range(2):
        assert all(np.array_equal(a, b) for a, b in zip(e.library(texts), e(texts)))
    e.remembered = 10
    assert all(np.array_equal(a, b) for a, b in zip(e.library(texts), e(texts)))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=1500))
def test_segments_round_trip(ids):
    s = token_store.Segment(token_store.pack([7, None], [len(ids) // 2, len(ids) - len(ids) // 2], np.array(ids, np.uint32)))
    assert s.all().tolist() == ids and [s[i] for i in range(len(s))] == ids and s.document(0) + s.document(1) == ids and s.doc_ids == [7, None]


def test_encoder_learns_units_without_a_call_for_each():
    e, calls = token_store.Encoder(TOKENIZER), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(17_000)) + "  (end)\n"
    sys.setprofile(count)
    try:
        got = e([text])[0]
    finally:
        sys.setprofile(None)
    assert len(e.hashes) > 17_000 and calls < 2_000
    assert got.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_with_a_tokenizer_that_leaves_bytes_out(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2, "\u0120": 3}, [("a", "b")]))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    t.save(path := str(tmp_path / "t.json"))
    texts = ["ab xab a bx xx  ab", " x", "x", "ab ab", "ab xyz"]
    assert [x.tolist() for x in token_store.Encoder(path)(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_tokens_are_read_one_by_one_from_the_files(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rows = [(i, f"document {i} says " + "word " * (i % 13)) for i in range(200)] + HARD
    store = token_store.write_store(docs(spark, rows), TOKENIZER, ids_per_segment=60)
    assert store.count() > 20
    for i, k in ((150, 0), (150, 4), (9, 2), (0, 1), (199, 8)):
        ids = [*t.encode(max((x for d, x in rows if d == i), key=lambda x: x is None) or "", add_special_tokens=False).ids, 0] if i != 9 else None
        if ids and sum(d == i for d, _ in rows) == 1:
            assert token_store.token(store, i, k) == (ids[k] if k < len(ids) else None)
    assert token_store.token(store, 150, -1) is None and token_store.token(store, 5000, 0) is None and token_store.token(store, 150, 10_000) is None


def test_token_store_equals_brute_force(spark):
    import zlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rows = [*HARD, (-5, "first"), (40, "last <|endoftext|>")]
    at, want = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_store.document_index(token_store.write_store(docs(spark, rows), TOKENIZER, ids_per_segment=100)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert token_store.document_index(token_store.write_store(docs(spark, []), TOKENIZER)).count() == 0

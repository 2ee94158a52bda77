"""SQL twins that are built from parts."""

from __future__ import annotations

DECONTAMINATION = r"""
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
    i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
    ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
    its AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM i),
    n AS (SELECT item_id, count(*) AS item_shingles FROM its GROUP BY item_id),
    f AS (SELECT doc_id, item_id, count(*) AS found FROM ds JOIN its USING (s) GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, item_shingles, found FROM f JOIN n USING (item_id) WHERE found >= 0.8::DOUBLE * item_shingles"""


def mixing(sweeps: int, temperature: float) -> str:
    parts = [
        r"""WITH r0 AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
        rows_ AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN (length(t) - length(replace(t, '|', ''))) * 10 > n_tokens THEN 'tabular'
            WHEN (length(t) - length(regexp_replace(t, '[#$%&*]', '', 'g'))) * 4 > n_tokens THEN 'symbolic' WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 600 THEN 'article' ELSE 'essay' END AS topic FROM r0),
        cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM rows_ GROUP BY ALL)"""
    ]
    for m in ("source", "lang", "topic"):
        parts.append(f"t_{m} AS MATERIALIZED (SELECT {m}, p / sum(p) OVER () AS {m}_target FROM (SELECT {m}, pow(sum(tokens)::DOUBLE, {temperature}::DOUBLE) AS p FROM cells GROUP BY {m}))")
    parts.append("w_0 AS (SELECT *, tokens::DOUBLE AS fitted FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    k = 0
    for _ in range(sweeps):
        for m in ("source", "lang", "topic"):
            parts.append(f"w_{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(fitted) OVER (PARTITION BY {m}) > 0 THEN fitted * {m}_target / sum(fitted) OVER (PARTITION BY {m}) ELSE 0 END AS fitted) FROM w_{k})")
            k += 1
    parts.append(f"f AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN fitted / tokens END AS factor FROM w_{k})")
    parts.append("c AS (SELECT source, lang, topic, coalesce(round_even(factor / max(factor) OVER (), 9), 1.0) AS probability FROM f)")
    return ",\n".join(parts) + """
        SELECT doc_id, source, lang, topic, n_tokens, probability, ('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < probability AS kept FROM rows_ JOIN c USING (source, lang, topic)"""


NEAR_DUPLICATES = r"""
    WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    e AS MATERIALIZED (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
    r(x, m) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.x),
    c AS (SELECT x AS doc_id, min(m) AS component_id FROM r GROUP BY x)
    SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON c.doc_id = n.doc_id"""


def lm_scores(smoothing: float) -> str:
    return rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, 1 AS good FROM labels WHERE quality = 1),
    t AS MATERIALIZED (SELECT doc_id, coalesce(good, 0) AS good, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS b FROM w LEFT JOIN g USING (doc_id)),
    p AS MATERIALIZED (SELECT doc_id, good, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY pos), '') AS a, b FROM t),
    d AS MATERIALIZED (SELECT doc_id, good, a, b, count(*) AS times FROM p GROUP BY ALL),
    du AS (SELECT doc_id, b, sum(times) AS own FROM d GROUP BY ALL),
    dh AS (SELECT doc_id, a, sum(times) AS own FROM d GROUP BY ALL),
    c AS MATERIALIZED (SELECT a, b, sum(times) AS n, sum(times * good) AS nt FROM d GROUP BY a, b),
    u AS (SELECT b, sum(n) AS n, sum(nt) AS nt FROM c GROUP BY b),
    h AS (SELECT a, sum(n) AS n, sum(nt) AS nt FROM c GROUP BY a),
    z AS (SELECT sum(n)::DOUBLE AS whole, sum(nt)::DOUBLE AS target, sum(nt)::DOUBLE / sum(n) AS scale, count(*)::DOUBLE AS size FROM u),
    l AS (SELECT doc_id, times,
        -ln((c.nt - times * good + {smoothing} * ((u.nt - du.own * good + 1) / (target + size))) / (h.nt - dh.own * good + {smoothing})) AS lt,
        -ln(((c.n - times) * scale + {smoothing} * (((u.n - du.own) * scale + 1) / (whole * scale + size))) / ((h.n - dh.own) * scale + {smoothing})) AS lb
        FROM d JOIN c USING (a, b) JOIN u USING (b) JOIN h USING (a) JOIN du USING (doc_id, b) JOIN dh USING (doc_id, a), z),
    s AS (SELECT doc_id, sum(times)::BIGINT AS n, sum(lt * times) / sum(times) AS lt, sum(lb * times) / sum(times) AS lb FROM l GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_tokens, round_even(lt, 8) AS target_loss, round_even(lb, 8) AS background_loss, round_even(lt - lb, 8) AS score FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id"""


FILTER_AUDIT = r"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, MAP {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
        'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > least, false)} AS fails
        FROM d JOIN s USING (t) LEFT JOIN l ON d.doc_id = l.doc_id),
    c AS MATERIALIZED (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
    orders(o) AS (SELECT '' UNION ALL SELECT o || x FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE strpos(o, x) = 0),
    steps AS (SELECT o AS filter_order, step::INTEGER AS step, substr(o, step, 1) AS x, string_split(substr(o, 1, step - 1), '') AS earlier FROM orders, (VALUES (1), (2), (3), (4), (5)) k(step) WHERE length(o) = 5),
    r AS MATERIALIZED (SELECT part, filter_order, step, x, n, good, toxic, fails[x] AS failing, step > 1 AND list_bool_or(list_transform(earlier, lambda e: coalesce(fails[e], false))) AS gone,
        NOT list_bool_or(list_transform(list_filter(['A', 'B', 'C', 'D', 'E'], lambda e: e <> x), lambda e: fails[e])) AS no_other FROM c, steps),
    a AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failing AND no_other), 0)::BIGINT AS unique_fails,
        coalesce(sum(n) FILTER (NOT gone AND failing AND good = 1), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND failing AND toxic = 1), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM a"""

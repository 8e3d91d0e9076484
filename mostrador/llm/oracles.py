"""Results of the newer operators as SQL over the base tables."""

from __future__ import annotations

# Rules of the URL query: verdict and host with path.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def url_filter(order: int = 4) -> str:
    """One chain of tables an order: counts of runs, of contexts, and both probabilities of each run."""
    fits = "\n".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '/{p}') THEN '{h}/{p}'"
                     for h, p in sorted((tuple(r.split("/", 1)) for _, r in URL_RULES), key=lambda r: -len("".join(r))))
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in URL_RULES)
    levels = []
    for k in range(order + 1):
        below = "1.0::DOUBLE / (1 + (SELECT count(DISTINCT right(run, 1)) FROM counted WHERE a + b > 0))"
        lower_a, lower_b, join = (below, below, "") if k == 0 else ("u.pa", "u.pb", f"JOIN p{k - 1} u ON u.run = right(l.run, {k})")
        levels.append(f"""
    l{k} AS (SELECT right(run, {k + 1}) AS run, sum(a) AS a, sum(b) AS b, sum(w) AS w FROM counted GROUP BY 1),
    c{k} AS (SELECT left(run, {k}) AS context, sum(a) AS na, sum(b) AS nb, count(*) FILTER (a > 0) AS ta, count(*) FILTER (b > 0) AS tb FROM l{k} WHERE a + b > 0 GROUP BY 1),
    p{k} AS (SELECT l.run,
        CASE WHEN c.na > 0 THEN (l.a::DOUBLE + c.ta::DOUBLE * {lower_a}) / (c.na + c.ta)::DOUBLE ELSE {lower_a} END AS pa,
        CASE WHEN c.nb > 0 THEN (l.b::DOUBLE + c.tb::DOUBLE * {lower_b}) / (c.nb + c.tb)::DOUBLE ELSE {lower_b} END AS pb
        FROM l{k} l LEFT JOIN c{k} c ON c.context = left(l.run, {k}) {join} WHERE l.w > 0),""")
    return f"""WITH
    u AS (SELECT row_number() OVER () AS id, page_id, coalesce(url, '') AS url FROM pages),
    r AS (SELECT *, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM u),
    s AS (SELECT id, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, left(md5(url), 1) IN ('0', '1', '2') AS back FROM r),
    ruled AS (SELECT *, CASE {fits} END AS rule FROM s),
    judged AS (SELECT *, CASE rule {verdicts} END AS given FROM ruled),
    grams AS (SELECT id, given, back, unnest([substr(repeat(chr(2), {order}) || url || chr(3), i, {order + 1}) FOR i IN range(1, length(url) + 2)]) AS run FROM judged),
    counted AS (SELECT run, count(*) FILTER (given = 'allow' AND NOT back) AS a, count(*) FILTER (given = 'block' AND NOT back) AS b,
        count(*) FILTER (given IS NULL OR back) AS w FROM grams GROUP BY 1),{"".join(levels)}
    scores AS (SELECT id, sum(round(1000000 * (ln(pa) - ln(pb)))::BIGINT)::DOUBLE AS ratio FROM grams JOIN p{order} USING (run) WHERE given IS NULL OR back GROUP BY 1),
    scored AS (SELECT j.*, ratio / (length(url) + 1)::DOUBLE / 1000000 AS score FROM judged j LEFT JOIN scores USING (id)),
    bins AS (SELECT greatest(least(floor(score * 100), 3200), -3200) AS step, count(*) FILTER (given = 'allow') AS a, count(*) FILTER (given = 'block') AS b
        FROM scored WHERE given IS NOT NULL AND back GROUP BY 1),
    tried AS (SELECT t.step, coalesce(sum(a) FILTER (bins.step >= t.step), 0) * (SELECT sum(b) FROM bins) + coalesce(sum(b) FILTER (bins.step < t.step), 0) * (SELECT sum(a) FROM bins) AS good
        FROM range(-3200, 3201) t(step), bins GROUP BY 1),
    chosen AS (SELECT coalesce((SELECT step FROM tried WHERE good IS NOT NULL AND (SELECT sum(a) > 0 AND sum(b) > 0 FROM bins) ORDER BY good DESC, abs(step), step LIMIT 1), 0) / 100 AS least)
    SELECT page_id, host, path, rule, coalesce(given, CASE WHEN score >= least THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN rule IS NULL THEN score END AS score
    FROM scored, chosen"""


# CRC32 as SQL: a table of 256 remainders from its polynomial, then one step a digit.
PREFIX_TRIE = r"""WITH
    t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) r(i))),
    rows AS (SELECT conv_id, turn, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
        FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(w ORDER BY turn NULLS FIRST, k) AS ws FROM rows GROUP BY 1),
    headed AS (SELECT own.*, xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
        lambda c, x: xor(c >> 8, t.t[(xor(c, x) & 255) + 1])), 4294967295) % 4 AS h FROM own, t),
    seqs AS (SELECT a.conv_id, list_concat(coalesce(b.ks[1:h], []), a.ks[h + 1:]) AS ks, list_concat(coalesce(b.ws[1:h], []), a.ws[h + 1:]) AS ws
        FROM headed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
    depths AS (SELECT conv_id, ks, ws, unnest(range(0, len(ks) + 1)) AS d FROM seqs),
    nodes AS (SELECT d, ks[1:d] AS p, min(conv_id) AS conv_id, count(*) AS n, coalesce(min(ws[d]), 0) AS w,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(ks) = d), '')) AS ends FROM depths GROUP BY 1, 2),
    kids AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
    full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS kids FROM nodes LEFT JOIN kids USING (p)),
    above AS (SELECT p, kids, n, w, unnest(range(0, d + 1)) AS up FROM full_nodes),
    sums AS (SELECT p[1:up] AS p, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * w) AS saved FROM above GROUP BY 1)
    SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
    FROM full_nodes f JOIN sums USING (p) LEFT JOIN nodes u ON f.d > 0 AND u.d = f.d - 1 AND u.p = f.p[1:f.d - 1]"""


LEXICAL_SEARCH = r"""WITH
    words AS (SELECT id, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS id, doc_id, text FROM documents)),
    tf AS (SELECT id, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    docs AS (SELECT id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
    total AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM docs),
    asked AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id,
        unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
    weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, nd),
    scores AS (SELECT item_id, tf.id, tf.doc_id, sum(asked.n * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * docs.n * nd) // l))))::BIGINT AS score
        FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN docs ON docs.id = tf.id, total GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""

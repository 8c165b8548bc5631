"""SQL for the queries that DuckDB can express on whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


NGRAM_JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_low('text')}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + 4) AS sh FROM w, unnest(range(1, greatest(1, len(ws) - 4) + 1)) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id FROM w JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY ALL"""

PIVOT_NEAR_DUPLICATES = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) >= 0.95 * a.norm * b.norm),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.vec_id),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id) LEFT JOIN n USING (vec_id)"""

BENCHMARK_DECONTAMINATION = rf"""WITH w AS (SELECT doc_id, regexp_extract_all({_low('text')}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_low('text')}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM benchmark),
bw AS (SELECT item, j, least(10, len(ws)) AS n, list_slice(ws, j, j + 9) AS win FROM b, unnest(range(1, greatest(1, len(ws) - 9) + 1)) t(j) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, list_slice(ws, i, i + n - 1) AS win FROM w, sizes, unnest(range(1, len(ws) - n + 2)) t(i)),
m AS (SELECT doc_id, i, n, item, j FROM dw JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id),
g AS (SELECT doc_id, item, i, j, n, i - row_number() OVER (PARTITION BY doc_id, item, i - j ORDER BY i) AS run FROM m),
x AS (SELECT doc_id, item, min(i) - 1 AS doc_at, min(j) - 1 AS item_at, max(n) + count(*) - 1 AS size FROM g GROUP BY doc_id, item, i - j, run),
best AS (SELECT doc_id, item, doc_at, item_at, size FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, item, doc_at, item_at) = 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(size, 0) AS longest, best.item AS longest_item, doc_at AS longest_at, item_at AS longest_from
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN best USING (doc_id)"""

FILTER_AUDIT = r"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY x) AS least FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN coalesce(w.doc_id > least, false) THEN 16 ELSE 0 END) AS m
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, m),
o(filter_order, step, bit, before) AS (SELECT '', 0, 0, 0 UNION ALL SELECT filter_order || letter, step + 1, b, before + bit FROM o, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, b) WHERE (before + bit) & b = 0),
full_order AS (SELECT a.filter_order, b.step, b.bit, b.before FROM o a JOIN o b ON starts_with(a.filter_order, b.filter_order) WHERE a.step = 5 AND b.step > 0),
s AS (SELECT part, filter_order, step, bit, sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & bit > 0 AND m & before = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN m & bit > 0 AND m & before > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN m & bit > 0 AND m & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN m & bit > 0 AND m & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, full_order GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM s"""


def _strength(groups: str) -> str:
    """Prior strength from groups (n, y): 1 / intra-class correlation - 1, between 1 and 1000."""
    return f"""(SELECT CASE WHEN k < 2 OR room IS NULL OR room <= 0 THEN 1000.0 WHEN spread - even * (k - 1) <= 0 THEN 1000.0 ELSE least(greatest(room / (spread - even * (k - 1)) - 1, 1.0), 1000.0) END FROM (
  SELECT k, yy - n * p * p AS spread, p * (1 - p) AS even, p * (1 - p) * (n - nn / n - (k - 1)) AS room FROM (
  SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) / sum(n) AS p, CAST(sum(n * n) AS DOUBLE) AS nn, sum(CAST(y * y AS DOUBLE) / n) AS yy FROM {groups} WHERE n > 0)))"""


_HOST = f"translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}')"


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


def url_reputation(rules: list[tuple[str, str, str]]) -> str:
    cases = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in cases) + " END"
    said = "CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{say}'" for say, h, p in cases) + " END"
    return f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
pg AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id),
hs AS (SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix, CAST(count(bad) AS BIGINT) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS y FROM pg LEFT JOIN o USING (page_id) GROUP BY ALL),
ds AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS y FROM hs GROUP BY ALL),
ts AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS y FROM hs GROUP BY ALL),
c AS (SELECT {_strength('ts')} AS k1, {_strength('ds')} AS k2, {_strength('hs')} AS k3, coalesce((SELECT CAST(sum(y) AS DOUBLE) / nullif(sum(n), 0) FROM ts), 0.0) AS rate),
m1 AS (SELECT suffix, (y + k1 * rate) / (n + k1) AS m1 FROM ts, c),
m2 AS (SELECT domain, suffix, (y + k2 * m1) / (n + k2) AS m2 FROM ds JOIN m1 USING (suffix), c),
ab AS (SELECT host, y + k3 * m2 AS a, n - y + k3 * (1 - m2) AS b FROM hs JOIN m2 USING (domain, suffix), c),
v AS (SELECT host, a / (a + b) AS bad_rate, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS lower_bound FROM ab)
SELECT page_id, host, path, {rule} AS rule, coalesce({said}, CASE WHEN lower_bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(bad_rate, 6) AS bad_rate, round(lower_bound, 6) AS lower_bound FROM pg LEFT JOIN v USING (host)"""

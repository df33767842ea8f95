"""DuckDB SQL of the queries that SQL can express, over whole tables."""

REPEATS = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, unnest(range(1, octet_length(b) - 198)) AS s, b FROM d WHERE octet_length(b) >= 200),
g AS (SELECT doc_id, s, md5(b[s:s + 199]) AS k FROM w),
r AS (SELECT doc_id, s FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
e AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM e),
p AS (SELECT doc_id, run, min(s) AS s, max(s) + 199 AS e FROM i GROUP BY doc_id, run),
q AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS next FROM p),
k AS (SELECT doc_id, count(*) AS n_spans, sum(e - s + 1)::BIGINT AS n_removed, min(s) AS first,
  string_agg(hex(b[e + 1:coalesce(next - 1, octet_length(b))]), '' ORDER BY s) AS rest FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN k.doc_id IS NULL THEN b ELSE unhex(hex(b[1:first - 1]) || rest) END) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

# one lower-cased word list per text; the pattern is the contract's
CONTAMINATION = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT DISTINCT item, array_to_string(w[s:s + 9], ' ') AS k, least(len(w), 10) AS n FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM x),
g AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, n WHERE len(w) >= n)),
m AS (SELECT doc_id, s, g.n, item FROM g JOIN x ON g.k = x.k AND g.n = x.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def secrets_sql() -> str:
    """Spans by the gaps between matches, and the owners of each candidate."""
    from quarry.llm.secrets import BASE, FEW_OWNERS, MORE

    kinds = [*BASE, *((kind, pattern, group, 1) for kind, pattern, group, _ in MORE)]
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT doc_id, source, '{kind}' AS kind, {rank} AS rank, {least} AS least, list_transform(string_split_regex(t, {quoted(pattern)}), lambda x: length(x)) AS gaps, "
        f"regexp_extract_all(t, {quoted(pattern)}, 0) AS whole, regexp_extract_all(t, {quoted(pattern)}, {group}) AS secrets FROM d WHERE regexp_matches(t, {quoted(pattern)})"
        for rank, (kind, pattern, group, least) in enumerate(kinds)
    )
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({found}),
i AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM f),
m AS (SELECT doc_id, source, kind, rank, (list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s, length(whole[i]) AS n, secrets[i] AS secret
  FROM i WHERE length(secrets[i]) >= least),
o AS (SELECT secret, count(DISTINCT coalesce('x' || source, '')) <= {FEW_OWNERS} AS owned FROM m GROUP BY secret),
x AS (SELECT doc_id, kind, rank, s, secret, owned, kind || ':' || s || ':' || (s + n) AS span FROM m JOIN o USING (secret)),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k[0]}') AS n_{k[0]}" for k in BASE)},
  string_agg(span, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)} OR owned) AS spans,
  count(DISTINCT secret) FILTER (owned) AS n_owned, count(DISTINCT secret) FILTER (NOT owned) AS n_copied FROM x GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN g USING (doc_id)
"""

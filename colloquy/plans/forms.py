"""SQL pieces that oracles of response queries share."""

from __future__ import annotations


def repeated_sql(source: str, key: str, text: str) -> str:
    """CTEs up to `rep` (key, n, longest_run, top_count, top_share, detected): what repeats in the last 2,048 tokens of `source`'s texts."""
    tokens = r"""regexp_extract_all(coalesce({}, ''), '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)?|[\x{{4e00}}-\x{{9fff}}]')""".format(text)
    return f"""
rep_t AS (SELECT {key}, list_transform({tokens}, lambda x: lower(x)) AS a FROM {source}),
rep_v AS (SELECT {key}, a[greatest(len(a) - 2047, 1):] AS a FROM rep_t),
rep_b AS (SELECT {key}, w, k, array_to_string(a[k * w + 1 : (k + 1) * w], ' ') AS b FROM (SELECT {key}, a, w, unnest(range(0, len(a) // w)) AS k FROM rep_v, range(1, 9) r(w) WHERE len(a) >= 8)),
rep_i AS (SELECT {key}, w, b, k - row_number() OVER (PARTITION BY {key}, w, b ORDER BY k) AS island FROM rep_b),
rep_l AS (SELECT {key}, max(c) AS longest FROM (SELECT {key}, count(*) AS c FROM rep_i GROUP BY {key}, w, b, island) GROUP BY {key}),
rep_g AS (SELECT {key}, max(c) AS top FROM (SELECT {key}, g, count(*) AS c FROM (SELECT {key}, array_to_string(a[i : i + 3], ' ') AS g FROM (SELECT {key}, a, unnest(range(1, len(a) - 2)) AS i FROM rep_v)) GROUP BY {key}, g) GROUP BY {key}),
rep_n AS (SELECT {key}, len(a) AS n, coalesce(longest, 1)::INT AS longest_run, coalesce(top, 0)::INT AS top_count, (CASE WHEN top IS NULL THEN 0 ELSE least(1, 4 * top / len(a)::DOUBLE) END)::DOUBLE AS top_share FROM rep_v LEFT JOIN rep_l USING ({key}) LEFT JOIN rep_g USING ({key})),
rep AS (SELECT *, longest_run >= 8 OR (top_count >= 12 AND top_share >= 0.15) AS detected FROM rep_n)"""


def forms_sql(role: str) -> str:
    """CTEs up to `forms`: each conversation as a tagged response, with the parts and counts of its form."""
    return rf"""
t AS (SELECT conv_id, turn, {role} AS role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
r AS (
  SELECT conv_id, max(x) FILTER (turn = last) AS c, count(*) FILTER (turn < last AND x IS NOT NULL AND role IS NOT NULL) AS m,
         '<discussion>' || chr(10) || coalesce(string_agg('<turn ' || (turn + 1) || '> ' || role || ': ' || x, chr(10) ORDER BY turn) FILTER (turn < last), '') || chr(10) || '</discussion>' || chr(10) || '<conclusion>' || max(x) FILTER (turn = last) || '</conclusion>' AS response,
         coalesce(list({{'t': turn, 'r': role}} ORDER BY turn) FILTER (turn < last AND x <> '' AND role IS NOT NULL), []) AS v FROM t GROUP BY conv_id
),
k AS (SELECT conv_id, response, coalesce(c, '') AS c, c IS NULL AS gone, CASE WHEN c IS NULL THEN 0 ELSE m END AS m, CASE WHEN c IS NULL THEN [] ELSE v END AS v FROM r),
n AS (
  SELECT *, len(v) AS nt, len(list_distinct(list_transform(v, lambda e: e.r))) AS nr, coalesce(lower(v[1].r) = 'moderator', false)::INT::DOUBLE AS led, len(list_filter(range(1, len(v) + 1), lambda i: v[i].t + 1 = i)) AS rt,
         len(regexp_extract_all(c, '[.!?]["''”]*(\s|$)')) - len(regexp_extract_all(c, '\b(Mr|Ms|Dr|[A-Z])[.!?]["''”]*(\s|$)')) AS s FROM k
),
p AS (
  SELECT *, ((m > 0)::INT + (c <> '')::INT) / 2.0::DOUBLE AS blocks, (NOT gone AND c <> '')::INT::DOUBLE AS env, coalesce(nt / nullif(m, 0)::DOUBLE, 0) AS syn, coalesce(rt / nullif(nt, 0)::DOUBLE, 0) AS num,
         CASE WHEN s BETWEEN 2 AND 4 THEN 1.0 WHEN s IN (1, 5) THEN 0.5 ELSE 0 END::DOUBLE AS sen, (NOT gone)::INT::DOUBLE AS outer_ FROM n
),
d AS (SELECT *, 0.25::DOUBLE * blocks + 0.1875::DOUBLE * (env + syn + num) + 0.125::DOUBLE * sen + 0.0625::DOUBLE * outer_ AS dense, (nt > 0 AND blocks = 1 AND env = 1 AND syn = 1 AND num = 1 AND sen = 1 AND outer_ = 1)::INT::DOUBLE AS exact FROM p),
forms AS (SELECT *, 0.25::DOUBLE * dense + 0.75::DOUBLE * exact AS base FROM d)"""


def scored_sql(truncated: str) -> str:
    """CTEs up to `scored` (conv_id, base, reason, score): the format score of each response, with a length limit of 8,192."""
    return f"""{forms_sql("role")}, {repeated_sql("forms", "conv_id", "response")},
pen AS (
  SELECT f.conv_id, base, CASE WHEN {truncated} THEN 1 WHEN detected AND (top_share >= 0.5 OR longest_run >= 128) THEN 2 WHEN m = 0 AND c = '' THEN 3 WHEN m = 0 OR c = '' THEN 4 ELSE 0 END AS reason,
         CASE WHEN detected THEN greatest(0, least(1, (longest_run - 8) / 120.0::DOUBLE), least(1, (top_share - 0.15::DOUBLE) / 0.35::DOUBLE)) ELSE 0 END AS again,
         CASE WHEN response IS NULL THEN 0 ELSE greatest(0, least(1, (length(response) - 6144) / 2048.0::DOUBLE)) END AS long_
  FROM forms f JOIN rep USING (conv_id)
),
scored AS (SELECT *, CASE reason WHEN 0 THEN greatest(-1, base - again - long_) WHEN 4 THEN -0.75 ELSE -1 END::DOUBLE AS score FROM pen)"""

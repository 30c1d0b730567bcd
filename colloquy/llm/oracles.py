"""DuckDB SQL for the rows of the registered queries."""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 19) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
lead AS (SELECT s, min({'d': doc_id, 'i': i}) AS l FROM win GROUP BY s HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p
  FROM win JOIN lead USING (s) WHERE {'d': doc_id, 'i': i} > l
),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, count(gone.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL), '') AS t
  FROM word LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

MIXING = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM s
),
o AS (
  SELECT *, coalesce(sum(cap) OVER b, 0) AS capped, sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         (SELECT 1.5::DOUBLE * sum(source_size) FROM s) AS goal, row_number() OVER (ORDER BY cap / weight, source) AS k
  FROM w WINDOW b AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
l AS (SELECT coalesce(arg_min((goal - capped) / open, k) FILTER (WHERE (goal - capped) / open * weight < cap), max(cap / weight)) AS level FROM o),
t AS (SELECT source, source_size, least(cap, level * weight) AS target FROM w, l),
r AS (
  SELECT doc_id, d.source, size, source_size, target, coalesce(target / nullif(source_size, 0)::DOUBLE, 0) AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
c AS (
  SELECT *, (floor(rate) + (('0x' || substr(md5('7:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate))::INT)::BIGINT AS copies
  FROM r
)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, rate, copies FROM c
"""

NEAR_DEDUP = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 2), ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
often AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM (SELECT * FROM sh SEMI JOIN often USING (s)) a JOIN (SELECT * FROM sh SEMI JOIN often USING (s)) b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL
),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (
  SELECT a AS doc_id, b AS r FROM both_ways
  UNION
  SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, m.r) AS component_id, d.doc_id = least(d.doc_id, m.r) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

DECONTAMINATION = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
iw AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 12) AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)
),
ln AS (SELECT DISTINCT len(s) AS n FROM iw),
dw AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ln)
),
h AS (SELECT doc_id, n, i, item_id FROM dw JOIN iw USING (s)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id),
wn AS (SELECT row_number() OVER () AS k, s, len(list_distinct(s)) AS n FROM (SELECT DISTINCT s FROM iw)),
ut AS (SELECT DISTINCT k, n, x FROM (SELECT k, n, unnest(s) AS x FROM wn)),
tok AS (SELECT doc_id, x, p FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) WHERE x IN (SELECT x FROM ut)),
ct AS (SELECT x, count(*) AS c FROM tok GROUP BY x),
an AS (SELECT k, any_value(n) AS n, arg_min(x, c) AS x FROM ut LEFT JOIN ct USING (x) GROUP BY k HAVING count(c) = count(*)),
pl AS (SELECT doc_id, k, n, p AS a, unnest(range(p - 25, p + 26)) AS p FROM an JOIN tok USING (x)),
nb AS (SELECT doc_id, k, n, a, p, x FROM pl JOIN tok USING (doc_id, p) SEMI JOIN ut USING (k, x)),
al AS (SELECT doc_id, k, n, a FROM nb GROUP BY ALL HAVING count(DISTINCT x) = n),
st AS (SELECT doc_id, k, l.n, a, f.p FROM al JOIN nb f USING (doc_id, k, a) JOIN nb l USING (doc_id, k, a) WHERE l.p BETWEEN f.p AND f.p + 25 GROUP BY ALL HAVING count(DISTINCT l.x) = l.n),
ne AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM st JOIN wn USING (k) JOIN iw USING (s) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN ne USING (doc_id)
"""

WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         strftime(DATE '2024-01-01' + (page_id * 37 % 365)::INT, '%Y-%m-%dT%H:%M:%SZ') AS timestamp
  FROM pages
),
m AS (SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest),
u AS (SELECT page_id, url, regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)', ['h', 't']) AS x FROM p),
k AS (SELECT page_id, CASE WHEN x.h = '' THEN lower(url) ELSE rtrim(regexp_replace(x.h, '^www[0-9]*\.', ''), '.') || ' ' || coalesce(nullif(rtrim(x.t, '/'), ''), '/') END AS urlkey FROM u),
n AS (SELECT page_id, row_number() OVER (PARTITION BY urlkey ORDER BY timestamp, page_id) AS capture FROM k JOIN p USING (page_id))
SELECT page_id, payload_bytes, p.payload_digest AS payload_digest, CASE WHEN page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to, url, timestamp, capture
FROM p JOIN n USING (page_id) LEFT JOIN m ON m.payload_digest = p.payload_digest AND p.payload_bytes >= 1000
"""

URL_FILTERS = r"""
WITH c AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', ''), '') AS host,
         DATE '2024-01-01' + (page_id * 37 % 365)::INT AS fetched
  FROM pages
),
dom AS (
  SELECT DISTINCT domain, ('0x' || substr(md5(domain), 1, 6))::BIGINT AS h
  FROM (SELECT unnest([host, array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 2, 1), len(string_split(host, '.'))), '.')]) AS domain FROM c WHERE host IS NOT NULL)
),
e AS (
  SELECT domain, CASE WHEN h % 3 = 0 THEN 'block' ELSE 'allow' END AS action, DATE '2024-01-01' + (h % 200)::INT AS valid_from FROM dom WHERE h % 3 < 2
  UNION ALL
  SELECT domain, CASE WHEN h % 2 = 0 THEN 'end' ELSE 'allow' END, DATE '2024-01-01' + (h % 200)::INT + 90 FROM dom WHERE h % 3 = 0
),
s AS (SELECT *, lead(valid_from) OVER (PARTITION BY domain ORDER BY valid_from) AS valid_to FROM e),
j AS (
  SELECT page_id, s.domain, s.action, s.valid_from
  FROM c JOIN s ON (c.host = s.domain OR (ends_with(c.host, '.' || s.domain) AND contains(s.domain, '.')))
   AND s.valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to) AND s.action <> 'end'
),
b AS (SELECT page_id, arg_max({'d': domain, 'a': action, 'f': valid_from}, length(domain)) AS m FROM j GROUP BY page_id)
SELECT c.page_id, host, fetched::VARCHAR AS fetched, m.d AS matched_domain, m.a AS action, m.f::VARCHAR AS valid_from, coalesce(m.a = 'block', false) AS blocked
FROM c LEFT JOIN b USING (page_id)
"""

#: The given pages hold their article in `article`, in paragraphs with bold starts and line breaks; this states the text that the field has to find.
HTML_EXTRACTION = r"""
WITH b AS (SELECT page_id, url, unnest(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>')) AS x, generate_subscripts(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>'), 1) AS i FROM pages),
t AS (SELECT page_id, url, i, regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM b),
d AS (SELECT page_id, url, i, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;', chr(39)), '&amp;?', '&', 'g') AS x FROM t),
c AS (SELECT page_id, url, i, trim(regexp_replace(x, '[\s\x{a0}\x{85}\x{2028}\x{3000}]+', ' ', 'g')) AS x FROM d)
SELECT page_id, url, coalesce(string_agg(x, chr(10) || chr(10) ORDER BY i) FILTER (WHERE x <> ''), '') AS text,
       coalesce(length(string_agg(x, chr(10) || chr(10) ORDER BY i) FILTER (WHERE x <> '')), 0)::BIGINT AS n_chars
FROM c GROUP BY page_id, url
"""

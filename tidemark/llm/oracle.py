"""SQL checks of the corpus queries that SQL can express."""

from __future__ import annotations

from tidemark.llm.mixing import FILLS, FRACTION, MARGINS, MISSING, POWERS, SWEEPS, TOPIC_SHARES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# Case folding as far as these tables need it.
_FOLDED = "replace(lower(coalesce(text, '')), 'ß', 'ss')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

CONTAINMENT = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_ALNUM}') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_FOLDED}, '{_ALNUM}') AS ws FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) AS s FROM d),
its AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) AS s FROM i),
n AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN its USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM m JOIN n USING (item_id) WHERE 5 * n_shared >= 4 * n_item
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws
        ELSE list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

FIXITY = r"""WITH p AS (
  SELECT page_id, url, coalesce(url, '') AS u, coalesce(html, '') AS h,
         CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 4) AS INTEGER) % 97 AS part
  FROM pages),
q AS (
  SELECT page_id, url, part, u, h, CASE part WHEN 1 THEN '#' || substr(h, 2)
         WHEN 2 THEN left(h, greatest(length(h) - 10, 0)) ELSE h END AS d
  FROM p),
r AS (
  SELECT page_id, url,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u
      || chr(13) || chr(10) || 'Content-Length: ' || strlen(h) || chr(13) || chr(10) || chr(13) || chr(10) || h
      || chr(13) || chr(10) || chr(13) || chr(10) AS a,
    CASE WHEN part = 3 THEN NULL ELSE
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u
      || chr(13) || chr(10) || 'Content-Length: ' || strlen(d) || chr(13) || chr(10) || chr(13) || chr(10) || d
      || chr(13) || chr(10) || chr(13) || chr(10) END AS b
  FROM q)
SELECT page_id, url, CASE WHEN b IS NULL THEN 'missing' WHEN strlen(a) <> strlen(b) THEN 'resized' ELSE 'altered' END AS kind,
  CAST(strlen(a) AS BIGINT) AS size_a, CAST(strlen(b) AS BIGINT) AS size_b, sha256(a) AS sha256_a, sha256(b) AS sha256_b
FROM r WHERE a IS DISTINCT FROM b
"""

LINES = r"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, line, place, coalesce(doc_id <> keeper, FALSE) AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

# The checksum goes through the bits of each byte, the lowest first.
SPELLING = r"""
WITH RECURSIVE r AS MATERIALIZED (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run,
    count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
x AS (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM r),
b AS (SELECT run, n, list_transform(range(0, 4 * length(x)), lambda j:
    (CAST('0x' || substr(x, 2 * (j // 8) + 1, 2) AS BIGINT) >> (j % 8)) & 1) AS bits FROM x),
h AS (SELECT run, n, xor(list_reduce([4294967295] || bits, lambda c, v: xor(c >> 1, 3988292384 * (xor(c, v) & 1))), 4294967295) AS h FROM b),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
c AS MATERIALIZED (SELECT word, n, left(word, i - 1) AS head, substr(word, i + 1) AS tail
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS word, b.word AS near, b.n AS m FROM c a JOIN c b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM c JOIN w ON w.word = c.head || c.tail
  UNION SELECT w.word, c.word, c.n FROM c JOIN w ON w.word = c.head || c.tail),
f AS MATERIALIZED (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(near, (-m, near)) AS near FROM p GROUP BY word),
k AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN near END AS form,
    CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN f USING (word)),
g(word, here, step) AS (SELECT word, word, 0 FROM k UNION ALL SELECT g.word, k.form, step + 1 FROM g JOIN k ON k.word = g.here WHERE k.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM k JOIN (SELECT word, arg_max(here, step) AS root FROM g GROUP BY word) USING (word)
"""


def mixing() -> str:
    """The raking, unrolled: one statement for each step."""
    tokens = f"coalesce(len(regexp_extract_all(text, '{_SPACED}')), 0)"

    def without(mark: str) -> str:
        return f"(length(t) - length(replace(t, '{mark}', '')))"

    out = [f"""d AS MATERIALIZED (SELECT doc_id, coalesce(source, '{MISSING}') AS source, coalesce(lang, '{MISSING}') AS lang,
      CASE WHEN {without('###')} + {without('$$$')} + {without('%%%')} > length(t) * CAST(0.03 AS DOUBLE) THEN 'symbols'
           WHEN {without('|')} > length(t) * CAST(0.02 AS DOUBLE) THEN 'table'
           WHEN {without('!!')} > length(t) * CAST(0.05 AS DOUBLE) THEN 'shouting'
           WHEN length(t) < 200 THEN 'short' ELSE 'prose' END AS topic, n_tokens
    FROM (SELECT *, coalesce(text, '') AS t, CAST({tokens} AS BIGINT) AS n_tokens FROM documents))""",
           "c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)"]
    for m in MARGINS:
        part = f"pow(sum(n), {POWERS[m]})" if m in POWERS else (
            "CASE topic " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in TOPIC_SHARES.items()) + " END")
        out += [f"part_{m} AS MATERIALIZED (SELECT {m}, {part} AS part FROM c GROUP BY {m})",
                f"goal_{m} AS MATERIALIZED (SELECT {m}, part / (SELECT sum(part) FROM part_{m}) AS share FROM part_{m})",
                f"f_{m}_0 AS MATERIALIZED (SELECT {m}, CAST(1 AS DOUBLE) AS f FROM part_{m})"]
    now = {m: f"f_{m}_0" for m in MARGINS}

    def joined(on: dict[str, str]) -> str:
        return "c " + " ".join(f"JOIN {t} ON {t}.{m} = c.{m}" for m, t in on.items())

    def weight(on: dict[str, str]) -> str:
        return " * ".join(["c.n", *(f"{t}.f" for t in on.values())])

    for k in range(1, SWEEPS + 1):
        for m in MARGINS:
            others = {o: t for o, t in now.items() if o != m}
            out.append(f"f_{m}_{k} AS MATERIALIZED (SELECT c.{m}, any_value(share) / sum({weight(others)}) AS f "
                       f"FROM {joined(others)} JOIN goal_{m} ON goal_{m}.{m} = c.{m} GROUP BY c.{m})")
            now[m] = f"f_{m}_{k}"
    out.append(f"raked AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.n, {weight(now)} AS w FROM {joined(now)})")
    budget = f"CAST({FRACTION} AS DOUBLE) * sum(n)"
    out.append(f"s0 AS MATERIALIZED (SELECT {budget} / sum(w) AS v FROM raked)")
    for k in range(1, FILLS + 1):
        full = f"w / n * (SELECT v FROM s{k - 1}) >= 1"
        out.append(f"s{k} AS MATERIALIZED (SELECT coalesce(({budget} - sum(CASE WHEN {full} THEN n ELSE 0 END)) "
                   f"/ nullif(sum(CASE WHEN {full} THEN 0 ELSE w END), 0), (SELECT v FROM s{k - 1})) AS v FROM raked)")
    p = f"least(CAST(1 AS DOUBLE), coalesce(w / n * (SELECT v FROM s{FILLS}), CAST(0 AS DOUBLE)))"
    u = "CAST(CAST('0x' || substr(md5('0' || coalesce(':' || doc_id, '')), 1, 13) AS BIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE)"
    return "WITH " + ",\n".join(out) + f"""
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round({p}, 6) AS probability, {u} < {p} AS sampled
FROM d LEFT JOIN raked ON raked.source = d.source AND raked.lang = d.lang AND raked.topic = d.topic"""

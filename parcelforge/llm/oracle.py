"""SQL for the queries that SQL can express; the others are held against brute force in tests/llm."""

from __future__ import annotations

from .urls import LEVELS

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_BLANK}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = d.doc_id
"""

OP2 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
h AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) AS h FROM w WHERE len(ws) >= 50),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY 1),
m AS (SELECT p.doc_id, p.i, word, coalesce(f.first < p.doc_id, false) AS again FROM p LEFT JOIN h ON p.doc_id = h.doc_id AND p.i = h.i LEFT JOIN f ON f.h = h.h),
g AS (SELECT doc_id, i, word, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS 49 PRECEDING) = 1 AS gone FROM m),
t AS (SELECT *, CASE WHEN gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) THEN 1 ELSE 0 END AS starts FROM g),
o AS (SELECT doc_id, count(*) AS n_words, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(CASE WHEN NOT gone THEN word END, ' ' ORDER BY i), '')) AS kept_sha256, CAST(sum(starts) AS BIGINT) AS n_intervals FROM t GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256, coalesce(n_intervals, 0) AS n_intervals FROM documents d LEFT JOIN o USING (doc_id)
"""


def _hash(text: str, seed: int) -> str:
    return f"CAST(concat('0x', substr(md5(concat('{seed}:', {text})), 1, 8)) AS BIGINT)"


OP3 = f"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_BLANK}')) AS BIGINT) AS size FROM documents),
a AS (SELECT source, count(*) AS docs, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY 1),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, sum(source_size) OVER () * 1.5::DOUBLE AS t, source_size * 2.0::DOUBLE AS cap FROM a),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
c AS (SELECT *, before + cap / w * rest <= t AS capped FROM o),
l AS (SELECT *, (t - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN NOT capped THEN w END) OVER () AS level FROM c),
g AS (SELECT source, docs, source_size, CASE WHEN capped THEN cap ELSE least(level * w, cap) END AS target FROM l),
p AS (SELECT s.*, docs, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0 END AS each, {_hash("coalesce(s.source, '')", 18)} / 4294967296.0::DOUBLE AS u,
  row_number() OVER (PARTITION BY s.source ORDER BY length(bin(size)), {_hash("doc_id", 17)} % CAST(ceil(sqrt(docs) / 4) AS BIGINT), size, {_hash("doc_id", 17)}, doc_id) AS pos FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, CAST(floor(pos * each + u) - floor((pos - 1) * each + u) AS BIGINT) AS copies FROM p)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM k
"""

OP6 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS first FROM h WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM h LEFT JOIN m USING (payload_digest)
"""


def _escape(text: str) -> str:
    for a, b in (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p")):
        text = f"replace({text}, '{a}', '{b}')"
    return text


OP8 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length({_escape("role")}) + length({_escape("text")}) + 5 + 8) AS BIGINT) AS formatted_chars
FROM c GROUP BY 1
"""

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ALNUM}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ALNUM}') AS ws FROM benchmark),
x AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 10) - 1], ' '))) AS g FROM b WHERE len(ws) > 0),
k AS (SELECT DISTINCT n FROM x),
y AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g FROM d, k WHERE len(ws) >= n),
h AS (SELECT doc_id, i, y.n, item_id FROM y JOIN x ON x.n = y.n AND x.g = y.g),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""


#: The rules as this SQL has had them from the start; the contract says allow for net/de/, as ``urls.RULES`` does (see REPLY_r03.md).
_OP10_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def _op10(rare: int = 5, strength: float = 20.0, similar: float = 2.0, limit: float = 0.5) -> str:
    fit = lambda text: f"(host = '{text.partition('/')[0]}' OR ends_with(host, '.{text.partition('/')[0]}')) AND starts_with(path, '/{text.partition('/')[2]}')"
    longest = sorted(_OP10_RULES, key=lambda r: (-len(r[1]), r[1]))
    rule = "CASE " + " ".join(f"WHEN {fit(t)} THEN '{t}'" for _, t in longest) + " END"
    act = "CASE " + " ".join(f"WHEN {fit(t)} THEN '{a}'" for a, t in longest) + " END"
    one = r"(?:[0-9]+|[0-9A-Fa-f-]{16,}|[^/.]{24,})"
    seg = f"CASE WHEN regexp_matches(v, '^{one}(\\.[A-Za-z0-9]{{1,5}})?$') AND (regexp_matches(v, '^([0-9]+|[0-9A-Fa-f-]{{16,}})(\\.[A-Za-z0-9]{{1,5}})?$') OR regexp_matches(split_part(v, '.', 1), '[0-9]')) THEN concat('*', regexp_extract(v, '\\.[A-Za-z0-9]{{1,5}}$')) ELSE v END"
    s = [f"s{k}" for k in range(LEVELS)]
    steps = [
        f"u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UP}', '{_LOW}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        f"v AS (SELECT *, {rule} AS rule, {act} AS action, CASE WHEN path = '' THEN [''] ELSE list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda v: {seg}) END AS parts FROM u)",
        "w AS (SELECT *, " + ", ".join(f"coalesce(parts[{k + 1}], '') AS s{k}" for k in range(LEVELS - 1)) + f", coalesce(array_to_string(parts[{LEVELS}:], '/'), '') AS s{LEVELS - 1} FROM v)",
        "lab AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS b FROM labels GROUP BY 1)",
        f"g0 AS (SELECT host, {', '.join(s)}, {', '.join(f'{x} AS g{k}' for k, x in enumerate(s))}, count(*) AS n, count(b) AS labelled, coalesce(sum(b), 0) AS bad FROM w LEFT JOIN lab ON doc_id = page_id GROUP BY ALL)",
    ]
    for k in range(LEVELS):
        path = ", ".join(["host", *(f"g{i}" for i in range(k + 1))])
        keep = ", ".join(f"CASE WHEN g{k} = '' OR sum(n) OVER (PARTITION BY {path}) >= {rare} THEN g{k} ELSE '*' END AS g{k}" if i == k else f"g{i}" for i in range(LEVELS))
        steps.append(f"g{k + 1} AS (SELECT host, {', '.join(s)}, {keep}, n, labelled, bad FROM g{k})")
    prior = f"(SELECT sum(bad) / greatest(sum(labelled), 1) FROM g{LEVELS})"
    steps.append(f"t AS (SELECT *, {prior} AS p FROM g{LEVELS})")
    last = "t"
    for k in range(-1, LEVELS):
        path = ", ".join(["host", *(f"g{i}" for i in range(k + 1))])
        name = f"m{k + 1}"
        steps.append(f"b{name} AS (SELECT *, sum(labelled) OVER (PARTITION BY {path}) AS bl, (sum(bad) OVER (PARTITION BY {path}) + {strength} * p) / (sum(labelled) OVER (PARTITION BY {path}) + {strength}) AS own FROM {last})")
        steps.append(f"{name} AS (SELECT * REPLACE (CASE WHEN abs(own - p) <= {similar} * sqrt(greatest(p * (1 - p), 1e-9) / (bl + {strength})) THEN p ELSE own END AS p) FROM b{name})")
        steps[-1] = steps[-1].replace("SELECT * REPLACE (", f"SELECT host, {', '.join(s)}, {', '.join(f'g{i}' for i in range(LEVELS))}, n, labelled, bad, ").replace(" AS p) FROM", " AS p FROM")
        last = name
    on = " AND ".join(f"w.{x} = r.{x}" for x in ("host", *s))
    steps.append(f"r AS (SELECT host, {', '.join(s)} FROM {last} WHERE p > {limit})")
    return f"WITH {', '.join(steps)} SELECT w.page_id, w.host, w.path, w.rule, coalesce(w.action, CASE WHEN r.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM w LEFT JOIN r ON {on} AND w.rule IS NULL"


OP11 = """
WITH w AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, unnest(range(1, octet_length(b) + 1)) AS i, unnest(list_transform(range(1, octet_length(b) + 1), lambda i: hex(b[i:i]))) AS byte, unnest(list_transform(range(1, octet_length(b) + 1), lambda i: CASE WHEN i + 99 <= octet_length(b) THEN md5(b[i:i + 99]) END)) AS h FROM w),
f AS (SELECT h, min((doc_id, i)) AS first FROM p WHERE h IS NOT NULL GROUP BY 1),
m AS (SELECT p.doc_id, p.i, byte, coalesce((p.doc_id, p.i) > f.first, false) AS again FROM p LEFT JOIN f ON f.h = p.h),
g AS (SELECT doc_id, i, byte, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS 99 PRECEDING) = 1 AS gone FROM m),
t AS (SELECT *, CASE WHEN gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) THEN 1 ELSE 0 END AS starts FROM g),
o AS (SELECT doc_id, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed, CAST(sum(starts) AS BIGINT) AS n_spans, sha256(unhex(coalesce(string_agg(CASE WHEN NOT gone THEN byte END, '' ORDER BY i), ''))) AS kept_sha256 FROM t GROUP BY 1)
SELECT w.doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM w LEFT JOIN o USING (doc_id)
"""

#: Unsigned crc32 of a text of code points below U+0100, as SQL over its bytes.
_CRC_TABLE = "list_transform(range(256), lambda c: list_reduce(list_concat([c], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"


def _crc32(text: str, table: str = "t") -> str:
    units = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN c = '' THEN [] WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END))"
    return f"xor(list_reduce(list_concat([4294967295], list_transform({units}, lambda c: c::BIGINT)), lambda a, b: xor(a >> 8, {table}[(xor(a, b) & 255) + 1])), 4294967295)"


OP12 = f"""
WITH RECURSIVE t AS (SELECT {_CRC_TABLE} AS t),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{_UP}', '{_LOW}') AS run FROM documents),
h AS (SELECT run, {_crc32("concat(id, ':', run)")} AS h FROM r, t WHERE length(run) >= 7),
w AS (SELECT CASE WHEN h % 31 = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word FROM h),
v AS (SELECT word, count(*) AS n FROM w WHERE length(word) >= 7 GROUP BY 1 HAVING count(*) >= 2),
d AS (SELECT word, n, i, concat(left(word, i - 1), substr(word, i + 1)) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.less = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.less = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM p GROUP BY 1),
j AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM v LEFT JOIN b USING (word)),
s(word, place, step) AS (SELECT word, word, 0 FROM j UNION ALL SELECT s.word, j.form, step + 1 FROM s JOIN j ON j.word = s.place WHERE j.form IS NOT NULL)
SELECT j.word, form, x.root, n, n_near, form_n FROM j JOIN (SELECT word, arg_max(place, step) AS root FROM s GROUP BY 1) x USING (word)
"""

OP13 = f"""
WITH t AS (SELECT {_CRC_TABLE} AS t),
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
k AS (SELECT c, n, c - c % 100 AS base, {_crc32("coalesce(CAST(c AS VARCHAR), '')")} % 6 AS h FROM (SELECT c, count(*) AS n FROM o GROUP BY 1), t),
m AS (SELECT k.c, k.n, k.base, k.h, least(h, coalesce(b.n, 0)) AS m FROM k LEFT JOIN (SELECT c, n FROM k) b ON b.c = k.base),
x AS (SELECT m.c, o.i + 1 AS d, role, text FROM m JOIN o ON o.c = m.base AND o.i < m.h UNION ALL SELECT o.c, m.m + o.i - m.h + 1, role, text FROM o JOIN m ON o.c IS NOT DISTINCT FROM m.c WHERE o.i >= m.h),
y AS (SELECT c, d, length(text) AS chars, md5(string_agg(md5(concat(length(role), ':', role, text)), '') OVER (PARTITION BY c ORDER BY d)) AS node FROM x),
z AS (SELECT c, d, chars, node, coalesce(lag(node) OVER (PARTITION BY c ORDER BY d), '') AS parent, max(d) OVER (PARTITION BY c) AS len FROM y UNION ALL SELECT m.c, 0, 0, '', NULL, m + greatest(n - h, 0) FROM m),
e AS (SELECT node, min(c) AS conv_id, max(d) AS depth, max(parent) AS parent, count(*) AS n_convs, max(chars) AS chars, sha256(coalesce(string_agg(CASE WHEN d = len THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM z GROUP BY 1),
f AS (SELECT parent, count(*) AS n FROM e WHERE parent IS NOT NULL GROUP BY 1),
g AS (SELECT e.*, coalesce(f.n, 0) AS n_children FROM e LEFT JOIN f ON f.parent = e.node),
s AS (SELECT z.node, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * g.chars) AS BIGINT) AS saved_tokens FROM g JOIN z ON z.c = g.conv_id AND z.d <= g.depth GROUP BY 1)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children, n_leaves, saved_tokens, g.ends_sha256 FROM g JOIN s USING (node) LEFT JOIN e p ON p.node = g.parent
"""

SQL: dict[str, str] = {"op1_jaccard": OP1, "op2_substrings": OP2, "op3_mixing": OP3, "op6_warc": OP6, "op8_chat": OP8, "op9_decontaminate": OP9, "op10_urls": _op10(), "op11_suffixes": OP11, "op12_spelling": OP12, "op13_trie": OP13}

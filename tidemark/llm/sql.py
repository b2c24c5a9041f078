"""DuckDB counterparts of the registered queries, written from the definitions."""

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id)
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS weight,
         source_size * 2.0::DOUBLE AS cap FROM s),
f AS (
  SELECT *, sum(cap) OVER o - cap AS before, sum(weight) OVER o - weight AS done
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (
  SELECT max(lev) AS level FROM (
    SELECT ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5 - before) / ((SELECT sum(weight) FROM w) - done) AS lev, cap, weight FROM f)
  WHERE lev * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS target FROM w, l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('17:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN before::DOUBLE + size / 2.0::DOUBLE < target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

# lines and sentences of three words or more; neighbouring repeats that add up to 25 words
PASSAGES = r"""
WITH l AS (
  SELECT doc_id, part, n, sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(part) - 1 AS start
  FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS n
        FROM (SELECT doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS parts FROM documents))),
lw AS (SELECT *, list_filter(regexp_split_to_array(part, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l),
s AS (
  SELECT doc_id, n, piece, i, start + sum(length(piece) + 1) OVER (PARTITION BY doc_id, n ORDER BY i) - length(piece) - 1 AS start
  FROM (SELECT doc_id, n, start, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM (SELECT doc_id, n, start, string_split(translate(part, '!?', '..'), '.') AS pieces FROM l))),
sw AS (SELECT *, list_filter(regexp_split_to_array(piece, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM s),
long AS (SELECT doc_id, n, start::BIGINT AS start, (start + length(piece))::BIGINT AS "end", len(ws) AS words, array_to_string(ws, ' ') AS norm FROM sw WHERE len(ws) >= 3),
c AS (
  SELECT lw.doc_id, lw.n, lw.start::BIGINT AS start, (lw.start + length(part))::BIGINT AS "end", len(ws) AS words, array_to_string(ws, ' ') AS norm, coalesce(covered, 0) AS covered, inside
  FROM lw LEFT JOIN (SELECT doc_id, n, sum(words) AS covered, count(*) AS inside FROM long GROUP BY ALL) x ON x.doc_id = lw.doc_id AND x.n = lw.n WHERE len(ws) >= 3),
slots AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS slot
  FROM (SELECT doc_id, n, start FROM long UNION ALL SELECT doc_id, n, start FROM c WHERE inside IS NULL)),
u AS (
  SELECT long.doc_id, 'sentence' AS unit, long.start, "end", words, norm, slot, slot AS slot_to FROM long JOIN slots USING (doc_id, n, start)
  UNION ALL
  SELECT c.doc_id, 'line', c.start, "end", words, norm, r.lo, r.hi FROM c JOIN (SELECT doc_id, n, min(slot) AS lo, max(slot) AS hi FROM slots GROUP BY ALL) r USING (doc_id, n) WHERE covered < words),
g AS (
  SELECT *, first_value(doc_id) OVER f AS keep_doc_id, first_value(start) OVER f AS keep_start, row_number() OVER f AS turn, count(*) OVER (PARTITION BY unit, norm) AS occurrences
  FROM u WINDOW f AS (PARTITION BY unit, norm ORDER BY doc_id, start)),
p AS (SELECT *, max(slot_to) OVER (PARTITION BY doc_id ORDER BY slot, slot_to DESC, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM g WHERE turn > 1),
q AS (SELECT *, sum(CASE WHEN past IS NULL OR slot > past + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY slot, slot_to DESC, unit ROWS UNBOUNDED PRECEDING) AS part FROM p),
w AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, part)::BIGINT AS passage_words FROM q WHERE past IS NULL OR slot_to > past)
SELECT doc_id, unit, start, "end", keep_doc_id, keep_start, occurrences, passage_words FROM w WHERE passage_words >= 25
"""

LINES = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
u AS (
  SELECT doc_id, unnest(range(len(parts))) AS unit, unnest(parts) AS part FROM l),
o AS (
  SELECT *, coalesce(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM u),
w AS (
  SELECT doc_id, unit, start, start + length(part) AS "end",
         list_filter(regexp_split_to_array(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM o),
k AS (SELECT doc_id, unit, start, "end", array_to_string(words, ' ') AS norm FROM w WHERE len(words) >= 20),
g AS (
  SELECT *, first_value(doc_id) OVER f AS keep_doc_id, first_value(start) OVER f AS keep_start, row_number() OVER f AS turn, count(*) OVER (PARTITION BY norm) AS occurrences
  FROM k WINDOW f AS (PARTITION BY norm ORDER BY doc_id, unit))
SELECT doc_id, unit, start, "end", keep_doc_id, keep_start, occurrences FROM g WHERE turn > 1
"""

#: as above with every line that has a word
EVERY_LINE = LINES.replace("len(words) >= 20", "len(words) >= 1")

TOP_K = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5
"""

NEGATIVES = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS turn
  FROM s WHERE same),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE turn <= 5 AND NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def _pii_kind(kind: str, pattern: str) -> str:
    """Matches with their places, from the matches and the gaps between them."""
    return rf"""
m_{kind} AS (
  SELECT row, text, hit, (stop - length(hit))::BIGINT AS start, stop::BIGINT AS stop FROM (
    SELECT row, text, hit, sum(length(hit) + length(gap)) OVER (PARTITION BY row ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop FROM (
      SELECT row, text, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM (
        SELECT row, text, regexp_extract_all(text, '{pattern}') AS hits, regexp_split_to_array(text, '{pattern}') AS gaps FROM d)))),"""


def _luhn(digits: str) -> str:
    d = f"{digits}[length({digits}) - i]::INT"
    return f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 1 THEN 2 * {d} - CASE WHEN {d} > 4 THEN 9 ELSE 0 END ELSE {d} END)) % 10 = 0"


def _pii() -> str:
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    }
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    turned = "(hit[5:] || hit[1:4])"
    window = "lower(substring(text, greatest(start - 40, 0) + 1, stop - greatest(start - 40, 0) + 40))"
    near = " OR ".join(f"contains({window}, '{w}')" for w in ("card", "visa", "credit", "payment"))
    valid = {
        "email": ("email", "true"), "ip": ("ip", "len(list_filter(string_split(hit, '.'), lambda p: p::HUGEINT > 255)) = 0"),
        "card": ("card", f"length({digits}) BETWEEN 16 AND 19 AND {_luhn(digits)}"), "phone": ("phone", f"length({digits}) BETWEEN 8 AND 15"),
        "card_short": ("card", f"length({digits}) BETWEEN 13 AND 15 AND {_luhn(digits)} AND ({near})"),
        "iban": ("iban", f"list_reduce(list_concat([0], list_transform(range(1, length({turned}) + 1), lambda i: ascii({turned}[i]))), "
                         "lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1"),
    }
    spans = " UNION ALL ".join(f"SELECT row, '{k}' AS kind, start, stop FROM m_{m} WHERE {test}" for k, (m, test) in valid.items())
    joined = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start)"
    return (
        "WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents)," + "".join(_pii_kind(k, p) for k, p in kinds.items())
        + f"\ns AS (SELECT *, list_position(['email', 'ip', 'card', 'phone', 'card_short', 'iban'], kind) AS o FROM ({spans})),\n"
        + f"g AS (SELECT row, {', '.join(f'count(*) FILTER (o = {i + 1}) AS n_{k}' for i, k in enumerate(('email', 'ip', 'card', 'phone')))}, "
        + f"{joined} FILTER (o <= 4) AS base, {joined} AS spans FROM s GROUP BY row)\n"
        + "SELECT doc_id, " + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("email", "ip", "card", "phone"))
        + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row)"
    )


PII = _pii()

# base 32 of the SHA-1: 160 bits as 32 groups of five, from pairs of bytes given as hexadecimal
WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, strlen(html) AS payload_bytes, hex, array_to_string(list_transform(string_split(hex, ''), lambda c: bin_of[c]), '') AS bits
      FROM p, (SELECT map(string_split('0123456789abcdef', ''), ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']) AS bin_of)),
d AS (
  SELECT page_id, payload_bytes, hex,
         array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
           1 + 16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT]), '') AS payload_digest,
         min(page_id) OVER (PARTITION BY hex) AS first
  FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

# CRC-32 of the decimal id, bit by bit; a node is known by the concatenated digests of its turns
TRIE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, turn, sha256(length(role)::VARCHAR || ':' || role || text) AS item, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, item) AS place FROM i),
d AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(s) + 1), lambda k: ascii(s[k])::BIGINT)),
           lambda acc, byte: list_reduce([xor(acc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)),
           4294967295) % 4 AS h
  FROM d),
r AS (
  SELECT c.conv_id, 0 AS own, place, item, words FROM c JOIN n ON n.conv_id = c.base AND place <= h
  UNION ALL SELECT c.conv_id, 1, place, item, words FROM c JOIN n ON n.conv_id = c.conv_id AND place > h),
o AS (
  SELECT conv_id, words, row_number() OVER w AS depth, array_to_string(list(item) OVER (w ROWS UNBOUNDED PRECEDING), '') AS node
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)),
m AS (SELECT conv_id, depth, node, words FROM o UNION ALL SELECT conv_id, 0, '', 0 FROM c),
l AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM m),
g AS (
  SELECT node, max(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends
  FROM l GROUP BY node),
k AS (SELECT left(node, (64 * (depth - 1))::BIGINT) AS node, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1),
f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (node)),
u AS (SELECT left(node, (64 * unnest(range(depth + 1)))::BIGINT) AS node, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * words AS saved FROM f),
s AS (SELECT node, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM u GROUP BY node)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s USING (node) LEFT JOIN g p ON f.depth > 0 AND p.node = left(f.node, (64 * (f.depth - 1))::BIGINT)
"""

"""DuckDB SQL for the operators that SQL can express, written from their definitions."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"


def _in(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def quality_sql() -> str:
    from .quality import CLOSING, PHRASES

    phrases = " OR ".join(f"contains(low, '{p}')" for p in PHRASES)
    closing = CLOSING.replace("'", "''").replace("]", "\\]")
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '{WORD}')) AS x, generate_subscripts(regexp_extract_all(t, '{WORD}'), 1) AS i FROM d),
g AS (SELECT r, i, string_agg(x, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS gram, count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS k FROM w),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g WHERE k = 8),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM twice WHERE n > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
m AS (SELECT r, k, line, lower(line) AS low, len(regexp_extract_all(line, '{WORD}')) AS nw, regexp_extract_all(line, '{WORD}')[-1] AS last_word,
  length(regexp_replace(line, '[^|>]', '', 'g')) AS seps, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS syms, length(regexp_replace(line, '[^!]', '', 'g')) AS bangs,
  row_number() OVER (PARTITION BY r, line ORDER BY k) AS nth FROM l),
j AS (SELECT *, (seps >= 2 AND 100 * seps >= 30 * nw) OR bangs >= nw OR 3 * syms >= nw OR (nw < 4 AND NOT regexp_matches(last_word, '[{closing}]$')) OR {phrases} AS bad FROM m WHERE nw > 0),
s AS (SELECT r, count(*) AS n_lines, count(*) FILTER (NOT bad) AS n_lines_kept, coalesce(sum(nw) FILTER (NOT bad), 0) AS n_words_kept, count(*) FILTER (nth > 1) AS n_dup_lines FROM j GROUP BY r),
c AS (SELECT r, doc_id, len(regexp_extract_all(t, '{WORD}')) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
b AS (SELECT c.*, coalesce(covered.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines_kept, 0) AS n_lines_kept, coalesce(n_words_kept, 0) AS n_words_kept, coalesce(n_dup_lines, 0) AS n_dup_lines
  FROM c LEFT JOIN covered USING (r) LEFT JOIN s USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_words_kept >= 50 * n_words AS kept,
  n_lines::BIGINT AS n_lines, n_lines_kept::BIGINT AS n_lines_kept, n_words_kept::BIGINT AS n_words_kept
FROM b"""


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS prev, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM c),
e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body,
  (prev, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AS ok FROM o)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(body) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
  bool_and(ok) AND bool_or(back = 1 AND role = 'assistant') AS valid
FROM e GROUP BY conv_id"""


def _places(text: str, pattern: str, hits_pattern: str | None = None) -> str:
    """A list of start, end and match of each place where the pattern is found."""
    p = pattern.replace("'", "''")
    return f"""list_transform(range(1, len(regexp_extract_all({text}, '{p}')) + 1), lambda i: {{
      's': (length(array_to_string(string_split_regex({text}, '{p}')[1:i], '')) + length(array_to_string(regexp_extract_all({text}, '{p}')[1:i - 1], '')))::INT,
      'h': regexp_extract_all({text}, '{p}')[i]}})"""


_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
_IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
_CARD = r"[0-9]([\x20-]?[0-9])+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
_SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"


def pii_sql() -> str:
    digits = "regexp_replace(x.h, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr({digits}, length({digits}) - i + 1, 1)::INT ELSE substr({digits}, length({digits}) - i + 1, 1)::INT * 2 - CASE WHEN substr({digits}, length({digits}) - i + 1, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    rearranged = "substr(replace(x.h, ' ', ''), 5) || substr(replace(x.h, ' ', ''), 1, 4)"
    iban = f"(array_to_string(list_transform(string_split({rearranged}, ''), lambda c: CASE WHEN c < 'A' THEN c ELSE (ascii(c) - 55)::VARCHAR END), ''))"
    near = "lower(substr(t, greatest(x.s - 48, 0) + 1, x.s - greatest(x.s - 48, 0)) || ' ' || substr(t, x.s + length(x.h) + 1, 24))"
    joined = lambda k: f"list_transform({k}, lambda x: '{k}:' || x.s || ':' || (x.s + length(x.h)))"
    base = "array_to_string(" + " || ".join(map(joined, ("email", "ip", "card", "phone"))) + ", ',')"
    every = "array_to_string(" + " || ".join(map(joined, ("email", "ip", "card", "phone", "iban", "ssn"))) + ", ',')"
    hint = lambda words, by: f"CASE WHEN regexp_matches({near}, '(^|[^a-z0-9_])({words})s?($|[^a-z0-9_])') THEN {by} ELSE 0.0 END"
    told = {"email": ("0.7", "mail|contact|write to", "noreply"), "ip": ("0.8", "ip|host|server|address", "version|section"), "card": ("0.7", "card|credit|visa|payment", "serial|tracking"), "phone": ("0.8", "phone|call|tel|mobile|fax", "score|total"), "iban": ("0.7", "iban|bank|account|transfer", ""), "ssn": ("0.3", "ssn|social security|taxpayer", "")}
    scores = " || ".join(f"list_transform({k}, lambda x: round({start} + {hint(words, '0.2')}" + (f" - {hint(against, '0.2')}" if against else "") + ", 3)::DOUBLE)" for k, (start, words, against) in told.items())
    # The remainder of the long number piece by piece, so that it fits.
    mod = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({iban}, ''), lambda c: c::BIGINT)), lambda a, b: (a * 10 + b) % 97) = 1"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, t, {_places("t", _EMAIL)} AS email, {_places("t", _IP)} AS ip, {_places("t", _CARD)} AS card, {_places("t", _PHONE)} AS phone, {_places("t", _IBAN)} AS iban, {_places("t", _SSN)} AS ssn FROM d),
g AS (SELECT doc_id, t, email,
  list_filter(ip, lambda x: len(list_filter(string_split(x.h, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0) AS ip,
  list_filter(card, lambda x: length({digits}) BETWEEN 16 AND 19 AND {luhn}) AS card,
  list_filter(phone, lambda x: length({digits}) BETWEEN 8 AND 15) AS phone,
  list_filter(iban, lambda x: {mod}) AS iban,
  list_filter(ssn, lambda x: regexp_matches({near}, '\b(?:ssn|social security|taxpayer)s?\b') AND NOT regexp_matches(substr(t, x.s, 1) || substr(t, x.s + 12, 1), '-')) AS ssn FROM f)
SELECT doc_id, len(email)::BIGINT AS n_email, len(ip)::BIGINT AS n_ip, len(card)::BIGINT AS n_card, len(phone)::BIGINT AS n_phone,
  sha256({base}) AS base_sha256, {every} AS spans, list_max([0.0::DOUBLE] || {scores}) AS max_score FROM g"""


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def secrets_sql() -> str:
    p = _ASSIGN.replace("'", "''")
    entry = lambda rank, name, spans: f"list_transform({spans}, lambda x: {{'s': x.s, 'r': {rank}, 'v': '{name}:' || x.s || ':' || (x.s + length(x.h))}})"
    lists = {"assign": "assign", "access": "access", "hex": "hex", "pem": "pem", "jwt": "jwt"}
    whole = " || ".join(entry(k, n, s) for k, (n, s) in enumerate(lists.items()))
    base = " || ".join(entry(k, n, s) for k, (n, s) in enumerate(list(lists.items())[:3]))
    text = lambda e: f"array_to_string(list_transform(list_sort({e}), lambda x: x.v), ',')"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, t,
  list_filter({_places("t", _ASSIGN)}, lambda x: length(regexp_extract(x.h, '{p}', 2)) >= 8) AS assign,
  list_filter({_places("t", "AKIA[A-Z0-9]+")}, lambda x: length(x.h) >= 16) AS access,
  {_places("t", "[0-9a-f]{32,}")} AS hex,
  {_places("t", "-----BEGIN (?:[A-Z]+ )*KEY-----")} AS pem,
  {_places("t", "eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}")} AS jwt FROM d)
SELECT doc_id, len(assign)::BIGINT AS n_assign, len(access)::BIGINT AS n_access, len(hex)::BIGINT AS n_hex,
  sha256({text(base)}) AS base_sha256, {text(whole)} AS spans, sha256(t) AS blob_sha256 FROM f"""


MIXING_SQL = r"""
WITH d AS (SELECT doc_id, text, lang, source, n_chars, coalesce(source, '') AS src FROM documents),
s AS (SELECT src, count(*) AS n, sqrt(count(*)::DOUBLE) AS w FROM d GROUP BY src),
r AS (SELECT src, (SELECT sum(n) FROM s)::DOUBLE * w / (SELECT sum(w) FROM s) / n AS rate FROM s),
u AS (SELECT d.*, rate, ('0x' || substr(md5('17:1:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM d JOIN r USING (src)),
t AS (SELECT src, k, rate, exp(-rate) AS p0, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(-rate) * list_product(list_transform(range(1, k + 1), lambda i: rate / i)) END AS p FROM r, range(0, 90) AS ks(k)),
c AS (SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS cdf FROM t),
n AS (SELECT u.*, (SELECT count(*) FROM c WHERE c.src = u.src AND c.cdf <= u.u) AS copies FROM u)
SELECT doc_id, text, lang, source, n_chars, copy_no::INT AS copy_no, round(rate, 9) AS rate, substr(md5('order17:' || copy_no || ':' || doc_id), 1, 16) AS mix_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy_no FROM n)"""


def _crc32(value: str) -> str:
    """CRC-32 of a number's decimal text, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({value}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {step}), 4294967295)"


PERIODIC_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_crc32("doc_id")} AS h, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % nullif(len(w), 0) AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p, unnest(range(n)) AS i FROM e),
t AS (SELECT r, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS x FROM f),
m AS (SELECT s.r, s.i, o.i - s.i AS p FROM t s JOIN t o ON s.r = o.r AND s.x = o.x AND o.i > s.i AND 4 * (o.i - s.i) <= s.n),
k AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM m),
z AS (SELECT r, p, min(i) AS s, count(*) + p AS l FROM k GROUP BY r, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
u AS (SELECT r, s, l, min(p) AS p FROM z GROUP BY r, s, l),
best AS (SELECT r, s, l, p FROM u QUALIFY row_number() OVER (PARTITION BY r ORDER BY l DESC, s, p) = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM u GROUP BY r),
kept AS (SELECT t.r, string_agg(x, ' ' ORDER BY i) AS body FROM t WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.r = t.r AND t.i >= u.s + u.p AND t.i < u.s + u.l) GROUP BY t.r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period, (1000 * best.l // best.p)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""


TRIE_SQL = rf"""
WITH t AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
x AS (SELECT conv_id, mark, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS k FROM t),
c AS (SELECT conv_id, CASE WHEN conv_id % 20 = 0 THEN 0 ELSE {_crc32("conv_id")} % 4 END AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, k, mark, words FROM c JOIN x ON x.conv_id = c.conv_id - c.conv_id % 20 AND k <= h
  UNION ALL SELECT conv_id, 1, k, mark, words FROM x JOIN c USING (conv_id) WHERE k > h),
o AS (SELECT conv_id, row_number() OVER w AS d, words, sha256(string_agg(mark, '') OVER w) AS key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS parent, lead(key) OVER (PARTITION BY conv_id ORDER BY d) IS NULL AS ends
  FROM (SELECT conv_id, d, words, key FROM o UNION ALL SELECT conv_id, 0, 0, '' FROM c)),
n AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, min(parent) AS parent, min(words) AS words, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ending FROM p GROUP BY d, key),
k AS (SELECT parent AS key, count(*) AS n FROM n WHERE d > 0 GROUP BY parent),
m AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k USING (key)),
s AS (SELECT a.d, a.key, sum((m.n_convs - 1) * m.words) AS saved, count(*) FILTER (m.n_children = 0) AS leaves FROM m JOIN p a ON a.conv_id = m.conv_id AND a.d <= m.d GROUP BY a.d, a.key)
SELECT m.conv_id, m.d::BIGINT AS depth, above.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, sha256(coalesce(m.ending, '')) AS ends_sha256
FROM m JOIN s USING (d, key) LEFT JOIN n above ON above.key = m.parent AND above.d = m.d - 1"""


WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT body, min(page_id) AS first FROM p GROUP BY body)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN g USING (body)"""

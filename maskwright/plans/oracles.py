"""The queries again as DuckDB SQL, from the same fixed values but by other means: per-match window sums
for places, list folds for overlaps, plain joins elsewhere."""

from __future__ import annotations

from maskwright.config import DENY, HEADER, MODEL, POOLS, TYPES
from maskwright.functions.text import WHITE_SPACE, dialect
from maskwright.operators.rules import RULES
from maskwright.operators.tables import COLUMN_RULES, NUMERIC
from maskwright.plans.queries import CHUNK_TOKENS, CODES, CUSTOM_RULES, CUSTOMER, FRACTIONS, LABELS, NAME, SUPPLIER, TERMS

PIECES, LONG_WORD = "[A-Z][a-z]+|[0-9]+", r"[\p{L}\p{N}]{4,}"
KIND = "CASE WHEN regexp_matches(g, '^[0-9]') THEN 'ID_NUMBER' ELSE 'PERSON' END"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = f"[{WHITE_SPACE}]"


def norm(t: str) -> str:
    return f"trim(regexp_replace(lower({t}), {q(WS + '+')}, ' ', 'g'), ' ')"


def trimmed(t: str) -> str:
    return f"regexp_replace({t}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


RARE = """SELECT c_custkey + 10000000 AS doc_id, concat('Customer ', c_name, ', SSN ', lpad((c_custkey % 900)::VARCHAR, 3, '0'), '-', lpad((c_custkey % 97)::VARCHAR, 2, '0'), '-', lpad((c_custkey * 7 % 9999)::VARCHAR, 4, '0'),
 ', born March ', c_custkey % 28 + 1, ', 19', c_custkey % 90 + 10, ' or ', c_custkey % 12 + 1, '/', c_custkey % 28 + 1, '/2001. Lives at ', c_custkey % 9000 + 1, ' Oak Street, CA ', lpad((c_custkey * 13 % 99999)::VARCHAR, 5, '0'),
 '. Account Number: A', lpad(c_custkey::VARCHAR, 6, '0'), ', 2001:db8:0:0:0:0:0:', c_custkey % 9999, '; IBAN ',
 CASE c_custkey % 3 WHEN 0 THEN 'GB82 WEST 1234 5698 7654 32' WHEN 1 THEN 'DE89 3704 0044 0532 0130 00' ELSE 'GB00 WEST 1234 5698 7654 32' END,
 '. Write to c', c_custkey, '@mail.example.org or www.example.org/c/', c_custkey, ', P.O. Box ', c_custkey % 500, '; (555) ', lpad((c_custkey % 1000)::VARCHAR, 3, '0'), '-0199.') AS text FROM customer"""
TEXTS = f"SELECT doc_id, text FROM documents UNION ALL {RARE}"


def places(src: str, pattern: str, group: int = 0) -> str:
    """doc_id, i, st, g: matches (or groups that end them) and where they start; doc_id is unique in src."""
    p = q(pattern)
    return f"""SELECT doc_id, i, (gap + size - length(g))::INT AS st, g FROM (
  SELECT doc_id, i, g, sum(length(part)) OVER w AS gap, sum(length(m)) OVER w AS size FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(gs) AS g, unnest(ps[1:len(ms)]) AS part, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, {p}) AS ms, regexp_extract_all(text, {p}, {group}) AS gs, string_split_regex(text, {p}) AS ps FROM ({src}) WHERE regexp_matches(text, {p})))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


DIGITS = r"regexp_replace(t, '\D', '', 'g')"
VALID = {
    "luhn_valid": f"length({DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {DIGITS}[length({DIGITS}) + 1 - i]::INT ELSE {DIGITS}[length({DIGITS}) + 1 - i]::INT * 2 - CASE WHEN {DIGITS}[length({DIGITS}) + 1 - i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
    "iban_valid": "length(replace(t, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(replace(t, ' ', '')[5:] || replace(t, ' ', '')[1:4], ''), lambda c: ascii(c)), lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END, 0) = 1",
    "ssn_valid": f"{DIGITS}[1:3] NOT IN ('000', '666') AND {DIGITS}[1] <> '9' AND {DIGITS}[4:5] <> '00' AND {DIGITS}[6:] <> '0000'",
    "has_digit": r"regexp_matches(t, '\d')",
}


def detected(src: str, types: tuple[str, ...] = TYPES) -> str:
    parts = []
    for k, r in enumerate(RULES):
        if r.type in types:
            pattern = dialect(r.pattern, edge=r"\b", flags=r.flags)
            valid = VALID[r.valid.__name__] if r.valid else "true"
            parts.append(f"""SELECT doc_id, st AS "start", (st + length(t))::INT AS "end", '{r.type}' AS type, t AS text, 'rule' AS source, {r.score}::DOUBLE AS score, ({k << 32} + st)::BIGINT AS ord
FROM (SELECT doc_id, st, regexp_replace(g, '[.,;:]+$', '') AS t FROM ({places(src, pattern, r.group)}) WHERE g <> '') WHERE {valid}""")
    return "\nUNION ALL ".join(parts)


def denied(src: str, source_stage: int = DENY) -> str:
    """Terms are single words, so an occurrence is a word that equals one."""
    parts = [f"""SELECT doc_id, st AS "start", (st + length(g))::INT AS "end", 'CUSTOM' AS type, g AS text, 'manual' AS source, 1.0::DOUBLE AS score, ({(DENY << 40) + (k << 32)} + st)::BIGINT AS ord FROM w WHERE lower(g) = {q(t.lower())}""" for k, t in enumerate(TERMS)]
    return " UNION ALL ".join(parts)


WORDS = "w AS MATERIALIZED (" + places("{src}", r"[\p{L}\p{N}_]+") + ")"


def words(src: str) -> str:
    return WORDS.replace("{src}", src)


def resolved(candidates: str) -> str:
    """The greedy fold over each document's ranked list."""
    return f"""SELECT doc_id, x.s AS "start", x.e AS "end", x.type, x.text, x.source, x.score, x.ord FROM (SELECT doc_id, unnest(q) AS x FROM (
 SELECT doc_id, list_reduce(list_transform(a, lambda x: [x]), lambda q, x: CASE WHEN len(list_filter(q, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN q ELSE list_concat(q, x) END) AS q FROM (
  SELECT doc_id, list(struct_pack(s := "start", e := "end", type := type, text := text, source := source, score := score, ord := ord) ORDER BY CASE source WHEN 'manual' THEN 3 WHEN 'rule' THEN 2 ELSE 1 END DESC, "end" - "start" DESC, score DESC, ord) AS a FROM ({candidates}) GROUP BY doc_id)))"""


def numbered(spans: str, doc: str = "doc_id", place: str = '"start"') -> str:
    return f"""SELECT {doc}, type, value, row_number() OVER (PARTITION BY {doc}, type ORDER BY first_at, value)::INT AS n, first_text FROM (
 SELECT {doc}, type, {norm('text')} AS value, min({place}) AS first_at, min_by(text, {place}) AS first_text FROM ({spans}) GROUP BY {doc}, type, {norm('text')})"""


def pool_value() -> str:
    whens = " ".join(f"WHEN type = '{t}' AND n <= {len(v)} THEN ([{', '.join(q(x) for x in v)}])[n]" for t, v in POOLS.items())
    return f"CASE {whens} ELSE '[' || type || '_' || n || ']' END"


LABEL = "'[' || type || '_' || n || ']'"


def applied(texts: str, pieces: str, key: str = "doc_id", column: str = "text") -> str:
    """texts with pieces (key, start, end, new) put in; other columns of texts stay."""
    return f"""SELECT t.* REPLACE (CASE WHEN p.body IS NULL THEN t.{column} ELSE p.body || substr(t.{column}, p.last + 1) END AS {column}) FROM ({texts}) t LEFT JOIN (
 SELECT {key}, string_agg(gap || new, '' ORDER BY "start") AS body, max("end") AS last FROM (
  SELECT {key}, p."start", p."end", p.new, substr(t.{column}, coalesce(lag(p."end") OVER (PARTITION BY {key} ORDER BY p."start"), 0) + 1, p."start" - coalesce(lag(p."end") OVER (PARTITION BY {key} ORDER BY p."start"), 0)) AS gap
  FROM ({pieces}) p JOIN ({texts}) t USING ({key})) GROUP BY {key}) p USING ({key})"""


def redacted(new: str) -> str:
    return f"""WITH t AS MATERIALIZED ({TEXTS}), r AS MATERIALIZED ({resolved(detected('SELECT * FROM t'))}), k AS ({numbered('SELECT * FROM r')}),
p AS (SELECT doc_id, "start", "end", {new} AS new FROM (SELECT r.*, {norm('text')} AS value FROM r) JOIN k USING (doc_id, type, value))
{applied('SELECT * FROM t', 'SELECT * FROM p')}"""


R = f"t AS MATERIALIZED ({TEXTS}), c AS MATERIALIZED ({detected('SELECT * FROM t')}), r AS MATERIALIZED ({resolved('SELECT * FROM c')})"
LOG = f"""log AS MATERIALIZED (SELECT DISTINCT doc_id, 10 AS seq, 'value' AS kind, type || ':' || {norm('text')} AS key, true AS value FROM r WHERE length(text) % 3 = 0
 UNION ALL SELECT DISTINCT doc_id, 15, 'value', type || ':' || {norm('text')}, false FROM r WHERE length(text) % 2 = 0
 UNION ALL SELECT doc_id, 5, 'occurrence', "start" || ':' || "end", true FROM r WHERE "start" % 3 = 0
 UNION ALL SELECT doc_id, 20, 'occurrence', "start" || ':' || "end", true FROM r WHERE "start" % 2 = 0)"""
V = "v AS (SELECT doc_id, key, arg_max(value, seq) AS excluded, max(seq) AS reset FROM log WHERE kind = 'value' GROUP BY doc_id, key)"


def active(src: str) -> str:
    return f"""SELECT s.doc_id, s."start", s."end", s.type, s.text, s.source, s.score, s.ord,
  s.source = 'manual' OR NOT (coalesce(v.excluded, false) <> ((SELECT count(*) FROM log o WHERE o.kind = 'occurrence' AND o.doc_id = s.doc_id AND o.key = s."start" || ':' || s."end" AND (v.reset IS NULL OR o.seq > v.reset)) % 2 = 1)) AS active
 FROM ({src}) s LEFT JOIN v ON v.doc_id = s.doc_id AND v.key = s.type || ':' || {norm('s.text')}"""


A = f"{R}, {LOG}, {V}, a AS MATERIALIZED ({active('SELECT * FROM r')})"

O: dict[str, str] = {}
O["detect_rules"] = f"WITH t AS MATERIALIZED ({TEXTS}) {detected('SELECT * FROM t')}"
for name, type_ in {"email": "EMAIL", "card": "CREDIT_CARD", "ip": "IP_ADDRESS", "phone": "PHONE", "ssn": "SSN", "iban": "IBAN", "date": "DATE", "address": "ADDRESS", "zip": "ZIP", "id": "ID_NUMBER"}.items():
    O[f"rule_{name}"] = f"WITH t AS MATERIALIZED ({TEXTS}) {detected('SELECT * FROM t', (type_,))}"
O["rule_url"] = detected("SELECT page_id AS doc_id, html AS text FROM pages", ("URL",))
O["rule_ipv6"] = f"WITH t AS MATERIALIZED ({TEXTS}) SELECT * FROM ({detected('SELECT * FROM t', ('IP_ADDRESS',))}) WHERE contains(text, ':')"
O["candidates"] = f"WITH t AS MATERIALIZED ({TEXTS}), {words('SELECT * FROM t')} {detected('SELECT * FROM t', tuple(t for t in TYPES if t != 'ORG'))} UNION ALL {denied('t')}"
O["deny_list"] = f"WITH {words(TEXTS)} {denied('t')}"
O["occurrences"] = f"""WITH {words('SELECT doc_id, text FROM documents')} SELECT DISTINCT doc_id, "start", "end", type, text, source, score, ({DENY << 40} + "start")::BIGINT AS ord FROM ({denied('d')})"""
O["custom_rules"] = f"WITH t AS MATERIALIZED ({TEXTS}) " + " UNION ALL ".join(
    f"""SELECT doc_id, st AS "start", (st + length(t))::INT AS "end", '{type_}' AS type, t AS text, {score}::DOUBLE AS score
FROM (SELECT doc_id, st, regexp_replace(g, '[.,;:]+$', '') AS t FROM ({places('SELECT * FROM t', dialect(pattern, edge=chr(92) + 'b', flags=flags), group)}) WHERE g <> '') WHERE {VALID['luhn_valid'] if valid else 'true'}"""
    for type_, pattern, score, group, flags, valid in CUSTOM_RULES
)
O["custom_rules_sql"] = O["custom_rules"]
O["filter_spans"] = f"""WITH t AS MATERIALIZED ({TEXTS}) SELECT * FROM ({detected('SELECT * FROM t')}) WHERE type <> 'ORG' AND score >= 0.9 AND lower(text) NOT IN ('10.0.0.1', 'gb82 west 1234 5698 7654 32')"""
O["resolve_overlaps"] = f"WITH {R} SELECT * FROM r"
O["redact_label"] = redacted(LABEL)
O["redact_mask"] = redacted("'[REDACTED]'")
O["redact_fake"] = redacted(pool_value())
O["redact_conversations"] = f"""WITH t AS MATERIALIZED (SELECT conv_id * 1000 + turn AS doc_id, conv_id, turn, text FROM conversations), r AS MATERIALIZED ({resolved(detected('SELECT doc_id, text FROM t'))}),
s AS (SELECT r.*, r.doc_id // 1000 AS conv_id FROM r), k AS ({numbered('SELECT * FROM s', 'conv_id', 'doc_id * 1000000 + "start"')}),
p AS (SELECT doc_id, "start", "end", {LABEL} AS new FROM (SELECT s.*, {norm('text')} AS value FROM s) JOIN k USING (conv_id, type, value))
SELECT conv_id, turn, text FROM ({applied('SELECT * FROM t', 'SELECT * FROM p')})"""
O["value_keys"] = f"""WITH {R} SELECT doc_id, "start", "start" || ':' || "end" AS occurrence_key, type || ':' || {norm('text')} AS value_key FROM r"""
O["label_map"] = f"WITH {R} {numbered('SELECT * FROM r')}"
O["reid_key"] = f"""WITH {R}, first AS (SELECT doc_id, type, {norm('text')} AS value, min("start") AS first_place FROM r GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_place, type, value)::INT AS position, type, value AS original, {LABEL} AS replacement, first_text
FROM ({numbered('SELECT * FROM r')}) JOIN first USING (doc_id, type, value)"""
STRICT = "source = 'manual' OR (type <> 'ORG' AND score >= 0.9 AND lower(text) NOT IN ('10.0.0.1', 'gb82 west 1234 5698 7654 32'))"
OFFSETS = "off AS (SELECT doc_id, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM t)"
MOVED = 'SELECT 0 AS doc_id, o + "start" AS "start", o + "end" AS "end", type, text, source, score'
O["resolve_one_document"] = f"""WITH {R}, {OFFSETS} {MOVED} FROM r JOIN off USING (doc_id)"""
O["label_one_document"] = f"""WITH {R}, {OFFSETS} {numbered(f'{MOVED} FROM c JOIN off USING (doc_id)')}"""


def broken(start: str, limit: str) -> str:
    """Where a chunk from start, of limit at most, ends."""
    piece = f"substr(text, {start} + 1, {limit} - {start})"
    last = f"(length({piece}) - length(regexp_extract({piece}, '[^ ' || chr(10) || ']*$')))"
    return f"(CASE WHEN {limit} < n AND 2 * ({last} - 1) > {limit} - {start} THEN {start} + {last} ELSE {limit} END)"


def chunked(most: int) -> str:
    """Chunk after chunk, and shrinking step after shrinking step, as rows of a recursion."""
    shrunk = f"(s + greatest(1, least(e - s - 1, floor((e - s) * {most} / tokens * 0.9)::INT)))"
    after = "(e - least(80, (e - s) // 4))"
    step = f"SELECT doc_id, text, n, CASE WHEN tokens > {most} THEN k ELSE k + 1 END AS k, CASE WHEN tokens > {most} THEN s ELSE {after} END AS s, CASE WHEN tokens > {most} THEN {shrunk} ELSE least(n, {after} + 1200) END AS l FROM r WHERE tokens > {most} OR e < n"
    state = lambda rows: f"""SELECT doc_id, text, n, k, s, e, len(regexp_extract_all(substr(text, s + 1, e - s), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}\\s]')) AS tokens FROM (
  SELECT doc_id, text, n, k, s, {broken('s', 'l')} AS e FROM ({rows}))"""  # noqa: E731
    first = "SELECT doc_id, text, length(text) AS n, 0 AS k, 0 AS s, least(length(text), 1200) AS l FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{N}]')"
    return f"""WITH RECURSIVE r AS ({state(first)} UNION ALL {state(step)})
SELECT doc_id, k::INT AS chunk_no, s::INT AS "offset", substr(text, s + 1, e - s) AS chunk FROM r WHERE tokens <= {most}"""


O["chunk_rows"] = chunked(CHUNK_TOKENS)
O["chunk_cover"] = f"""SELECT doc_id, count(*) AS n, sum(length(chunk))::BIGINT AS chars, max("offset" + length(chunk))::INT AS covered FROM ({chunked(512)}) GROUP BY doc_id"""
GROWN = "CASE y.step WHEN 0 THEN list_append(x.p, y.seq) WHEN 1 THEN x.p[1:len(x.p) - 1] ELSE CASE WHEN len(x.f) > 0 THEN list_append(x.p, x.f[len(x.f)]) ELSE x.p END END"
O["decisions_in_force"] = f"""WITH {R}, log AS (SELECT doc_id, "start" AS seq, CASE WHEN "start" % 4 = 0 THEN 'undo' WHEN "start" % 7 = 0 THEN 'redo' ELSE 'value' END AS kind,
 type || ':' || {norm('text')} AS key, length(text) % 2 = 0 AS value FROM r),
a AS (SELECT doc_id, list(struct_pack(k := []::BIGINT[], p := []::BIGINT[], f := []::BIGINT[], step := CASE kind WHEN 'undo' THEN 1 WHEN 'redo' THEN 2 ELSE 0 END, seq := seq::BIGINT) ORDER BY seq) AS a FROM log GROUP BY doc_id),
d AS (SELECT doc_id, list_reduce(list_concat([struct_pack(k := []::BIGINT[], p := []::BIGINT[], f := []::BIGINT[], step := 0, seq := -1::BIGINT)], a), lambda x, y: struct_pack(
 k := CASE WHEN len({GROWN}) > 20 THEN list_append(x.k, ({GROWN})[1]) ELSE x.k END, p := CASE WHEN len({GROWN}) > 20 THEN ({GROWN})[2:] ELSE {GROWN} END,
 f := CASE y.step WHEN 0 THEN []::BIGINT[] WHEN 1 THEN CASE WHEN len(x.p) > 0 THEN list_append(x.f, x.p[len(x.p)]) ELSE x.f END ELSE x.f[1:len(x.f) - 1] END, step := y.step, seq := y.seq)) AS s FROM a),
e AS (SELECT doc_id, unnest(list_concat(s.k, s.p)) AS seq FROM d)
SELECT log.* FROM log JOIN e USING (doc_id, seq)"""
O["finalize"] = f"""WITH {R}, x AS MATERIALIZED (SELECT * FROM c WHERE {STRICT}) SELECT *, 'all' AS setting FROM r UNION ALL SELECT *, 'strict' FROM ({resolved('SELECT * FROM x')})"""
O["reidentify"] = f"""WITH {R}, k AS ({numbered('SELECT * FROM r')}), p AS (SELECT doc_id, "start", "end", first_text AS new FROM (SELECT r.*, {norm('text')} AS value FROM r) JOIN k USING (doc_id, type, value)) {applied('SELECT * FROM t', 'SELECT * FROM p')}"""
O["neutralise_cells"] = rf"""SELECT o_orderkey, CASE WHEN regexp_matches(v, '^[+-]?(\d[\d,]*)?(\.\d+)?([eE][+-]?\d+)?$') THEN v WHEN regexp_matches(v, {q(f'^{WS}*[=+@-]')}) THEN '''' || v ELSE v END AS cell
FROM (SELECT o_orderkey, ['=', ' @', '-', ''][o_orderkey % 4 + 1] || CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderkey::VARCHAR END AS v FROM orders)"""
O["active_spans"] = f"WITH {A} SELECT * FROM a"
O["decisions_asof"] = f"WITH {R}, {LOG} SELECT doc_id, arg_max(seq, seq) AS seq, kind, key, arg_max(value, seq) AS value FROM log WHERE seq <= 12 GROUP BY doc_id, kind, key"
O["value_decisions"] = f"WITH {R}, {LOG}, {V} SELECT doc_id, key, excluded FROM v"
O["manual_terms"] = f"""WITH {words('SELECT doc_id, text FROM documents')}, f AS MATERIALIZED (SELECT doc_id, st, g AS w FROM ({places('SELECT doc_id, text FROM documents', '[A-Z][a-z]{5,}')}) WHERE st % 5 = 0)
SELECT DISTINCT ON (doc_id, "start", "end") * FROM (SELECT doc_id, st::INT AS "start", (st + length(w))::INT AS "end", 'CUSTOM' AS type, w AS text, 'manual' AS source, 1.0::DOUBLE AS score, ({DENY << 40} + st)::BIGINT AS ord FROM f
 UNION ALL SELECT w.doc_id, w.st, (w.st + length(g))::INT, 'CUSTOM', g, 'manual', 1.0, ({DENY << 40} + w.st)::BIGINT FROM w JOIN (SELECT DISTINCT doc_id, lower(w) AS l FROM f) f ON f.doc_id = w.doc_id AND lower(g) = f.l)"""
O["anti_overlap"] = f"""WITH {R} SELECT * FROM c x WHERE type <> 'PHONE' AND NOT EXISTS (SELECT 1 FROM c y WHERE y.type = 'PHONE' AND y.doc_id = x.doc_id AND x."start" < y."end" AND y."start" < x."end")"""
O["final_view"] = f"""WITH {R}, {LOG}, {V}, m AS (SELECT doc_id, "start", "end", 'CUSTOM' AS type, text, 'manual' AS source, 1.0::DOUBLE AS score, ord FROM r WHERE type = 'ZIP'),
b AS (SELECT * FROM r x WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = x.doc_id AND m."start" < x."end" AND x."start" < m."end") UNION ALL SELECT * FROM m)
SELECT * EXCLUDE (active) FROM ({active('SELECT * FROM b')}) WHERE active"""
O["export_gate"] = """SELECT *, ml_state <> 'pending' AND ((ml_state <> 'failed' AND kind <> 'xlsx') OR doc_id % 2 = 0) AS allowed FROM (
 SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'xlsx' ELSE 'text' END AS kind, CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'done' END AS ml_state FROM documents)"""
O["findings_by_value"] = f"""WITH {A} SELECT type, {norm('text')} AS value, count(*) AS n, count(*) FILTER (NOT active) AS n_off, arg_min(text, doc_id * 1000000 + "start") AS first_text FROM a GROUP BY 1, 2"""
O["findings_rollup"] = f"""WITH {A} SELECT type, value, n, n_on, CASE WHEN n_on = n THEN 'all' WHEN n_on = 0 THEN 'none' ELSE 'some' END AS state FROM (
 SELECT type, value, count(*) AS n, count(*) FILTER (active) AS n_on FROM (SELECT type, {norm('text')} AS value, active FROM a) GROUP BY ROLLUP (type, value))"""
O["top_values"] = f"WITH {A} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, value)::INT AS rank FROM (SELECT type, {norm('text')} AS value, count(*) AS n FROM a GROUP BY 1, 2)) WHERE rank <= 3"
O["doc_summary"] = f"WITH {A} SELECT doc_id, count(*) FILTER (active) AS redacted, count(*) FILTER (NOT active) AS kept FROM a GROUP BY doc_id"
O["findings_by_label"] = f"SELECT quality, toxic, count(*) AS docs, coalesce(sum(n), 0)::BIGINT AS findings FROM labels LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({detected('SELECT doc_id, text FROM documents')}) GROUP BY doc_id) USING (doc_id) GROUP BY ALL"
O["needs_model"] = r"SELECT doc_id, coalesce(regexp_matches(text, '[\p{L}\p{N}]'), false) AS needs_model FROM documents"
O["normalise_caps"] = r"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^\n\t]+|[\n\t]+')) AS s, generate_subscripts(regexp_extract_all(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^\n\t]+|[\n\t]+'), 1) AS i FROM documents),
x AS (SELECT doc_id, i, CASE WHEN length(regexp_replace(s, '[^\p{Lu}]', '', 'g')) >= 4 AND NOT regexp_matches(s, '\p{Ll}') THEN array_to_string(list_transform(regexp_extract_all(s, '\p{L}+|[^\p{L}]+'), lambda r: CASE WHEN regexp_matches(r, '^\p{L}') THEN r[1] || lower(r[2:]) ELSE r END), '') ELSE s END AS s FROM s)
SELECT d.doc_id, coalesce(y.t, '') AS text FROM documents d LEFT JOIN (SELECT doc_id, string_agg(s, '' ORDER BY i) AS t FROM x GROUP BY doc_id) y USING (doc_id)"""
O["name_variants"] = f"""WITH n AS (SELECT doc_id, split_part(g, ' ', 1) AS a, upper(split_part(g, ' ', 2)[1]) || split_part(g, ' ', 2)[2:] AS b FROM ({places('SELECT doc_id, text FROM documents', '[A-Z][a-z]+ [a-z]+')}))
SELECT DISTINCT doc_id, 'PERSON' AS type, term, 0.9::DOUBLE AS score FROM (SELECT doc_id, a || ' ' || b AS term FROM n UNION ALL SELECT doc_id, a FROM n WHERE length(a) >= 3 UNION ALL SELECT doc_id, b FROM n WHERE length(b) >= 3)"""
O["propagate_names"] = rf"""WITH {words('SELECT doc_id, text FROM documents')}, f AS MATERIALIZED (SELECT doc_id, st, g FROM ({places('SELECT doc_id, text FROM documents', NAME)}) WHERE st % 2 = 0),
v AS MATERIALIZED (SELECT DISTINCT doc_id, unnest([g, split_part(g, ' ', 1)]) AS term FROM f),
h AS (SELECT DISTINCT w.doc_id, w.st, v.term FROM w JOIN v ON v.doc_id = w.doc_id AND split_part(v.term, ' ', 1) = w.g JOIN documents d ON d.doc_id = w.doc_id
 WHERE substr(d.text, w.st + 1, length(term)) = term AND NOT regexp_matches(substr(d.text, w.st + length(term) + 1, 1), '[\p{{L}}\p{{N}}_]'))
SELECT doc_id, st::INT AS "start", (st + length(g))::INT AS "end", 'PERSON' AS type, g AS text, 'ml' AS source, 0.9::DOUBLE AS score FROM f
UNION ALL SELECT doc_id, st::INT, (st + length(term))::INT, 'PERSON', term, 'ml', 0.855::DOUBLE FROM h WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = h.doc_id AND f.st = h.st AND f.g = h.term)"""
O["plausible_spans"] = rf"""WITH t AS MATERIALIZED ({TEXTS}), x AS (SELECT doc_id, "start", ['EMAIL', 'CREDIT_CARD', 'SSN', 'IBAN']["start" % 4 + 1] AS type, text, length(regexp_replace(text, '\D', '', 'g')) AS n FROM ({detected('SELECT * FROM t')}))
SELECT doc_id, "start", type, text FROM x WHERE CASE type WHEN 'EMAIL' THEN contains(text, '@') WHEN 'CREDIT_CARD' THEN n >= 12 WHEN 'SSN' THEN n >= 9 ELSE n >= 4 END"""
O["merge_spans"] = rf"""WITH p AS MATERIALIZED ({places('SELECT doc_id, text FROM documents', PIECES)}),
s AS (SELECT doc_id, i, st, st + length(g) AS e, {KIND} AS type, lag(st + length(g)) OVER w AS pe, lag({KIND}) OVER w AS pt FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
j AS (SELECT s.*, d.text, substr(d.text, pe + 1, st - pe) AS gap, substr(d.text, greatest(pe - 1, 1), least(pe, 2)) AS before FROM s JOIN documents d USING (doc_id)),
k AS (SELECT *, sum(CASE WHEN pe IS NOT NULL AND type = pt AND (st <= pe OR (regexp_matches(gap, '^[ \-./:@_]{{1,2}}$') AND (gap <> '. ' OR regexp_matches(before, '(^|[^\p{{L}}])\p{{L}}$')))) THEN 0 ELSE 1 END)
 OVER (PARTITION BY doc_id ORDER BY i) AS isl FROM j)
SELECT doc_id, "start", "end", type, text, score FROM (SELECT doc_id, min(st)::INT AS "start", max(e)::INT AS "end", any_value(type) AS type, substr(any_value(text), min(st) + 1, max(e) - min(st)) AS text, 0.8::DOUBLE AS score FROM k GROUP BY doc_id, isl) WHERE length(text) >= 2"""
O["type_scores"] = f"""WITH l(label, type, i) AS (VALUES {', '.join(f"({q(n)}, {q(t) if t else 'NULL'}, {i})" for i, (n, t) in enumerate(LABELS))}),
x AS (SELECT user_id AS doc_id, event_id AS token, type, exp(floor(value)::BIGINT * (i + 3) % 11 / 2.0) AS e FROM events, l), s AS (SELECT doc_id, token, type, sum(e) AS e FROM x GROUP BY ALL),
t AS (SELECT doc_id, token, sum(e) AS total, coalesce(sum(e) FILTER (type IS NULL), 0) AS none FROM s GROUP BY ALL),
b AS (SELECT doc_id, token, type, e, row_number() OVER (PARTITION BY doc_id, token ORDER BY round(e, 9) DESC, type DESC) AS k FROM s WHERE type IS NOT NULL)
SELECT doc_id, token, type, round(e / total, 6) AS score FROM b JOIN t USING (doc_id, token) WHERE k = 1 AND e > none"""
O["dictionary_spans"] = f"""WITH {words('SELECT doc_id, text FROM documents')}
SELECT doc_id, st AS "start", (st + length(g))::INT AS "end", CASE g WHEN 'Que' THEN 'LOCATION' ELSE 'PERSON' END AS type, g AS text, 'ml' AS source, 0.9::DOUBLE AS score FROM w WHERE g IN ('The', 'Der', 'Que')"""

# Tables
CELLS = f"""cells AS MATERIALIZED (WITH one AS (SELECT c_nationkey::BIGINT AS doc_id, 0 AS sheet, (c_custkey + 1)::INT AS row, unnest([0, 1, 2, 3]) AS col, unnest([c_name, 'A-' || c_custkey, c_mktsegment, c_acctbal::DECIMAL(12,2)::VARCHAR]) AS value FROM customer),
 two AS (SELECT s_nationkey::BIGINT AS doc_id, 1 AS sheet, (s_suppkey + 1)::INT AS row, unnest([0, 1, 2]) AS col, unnest([s_name, s_suppkey::VARCHAR, s_acctbal::DECIMAL(12,2)::VARCHAR]) AS value FROM supplier)
 SELECT * FROM one UNION ALL SELECT DISTINCT doc_id, 0, 0, unnest([0, 1, 2, 3]), unnest([{', '.join(map(q, CUSTOMER))}]) FROM one
 UNION ALL SELECT * FROM two UNION ALL SELECT DISTINCT doc_id, 1, 0, unnest([0, 1, 2]), unnest([{', '.join(map(q, SUPPLIER))}]) FROM two)"""


def classified(h: str) -> str:
    clean = trimmed(f"replace(regexp_replace({h}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')")
    whens = " ".join(f"WHEN regexp_matches({clean}, {q(dialect(p, edge=chr(92) + 'b', flags='i'))}) THEN '{t}'" for p, t in COLUMN_RULES)
    return f"CASE WHEN {clean} = '' THEN NULL {whens} END"


HEAD = rf"""head AS MATERIALIZED (WITH h AS (SELECT doc_id, sheet, col, {trimmed('value')} AS h FROM cells WHERE row = 0), n AS (SELECT doc_id, sheet, col, bool_or(regexp_matches(value, {q(dialect(NUMERIC).replace(chr(92) + 'z', '$'))})) AS num FROM cells WHERE row BETWEEN 1 AND 20 GROUP BY ALL)
 SELECT doc_id, sheet, bool_or({classified('h')} IS NOT NULL) OR (count(*) FILTER (h <> '') >= 2 AND count(DISTINCT lower(h)) FILTER (h <> '') = count(*) FILTER (h <> '')
  AND bool_and(h = '' OR (length(h) <= 40 AND regexp_matches(h, '^\p{{L}}') AND NOT contains(h, '@') AND NOT regexp_matches(h, '\d{{3}}'))) AND bool_or(h <> '' AND NOT regexp_matches(h, '\d') AND coalesce(num, false))) AS has_header
 FROM h LEFT JOIN n USING (doc_id, sheet, col) GROUP BY doc_id, sheet)"""
LETTERS = "CASE WHEN {n} < 26 THEN chr(65 + {n}) WHEN {n} < 702 THEN chr(65 + ({n} - 26) // 26) || chr(65 + ({n} - 26) % 26) ELSE chr(65 + ({n} - 702) // 676) || chr(65 + ({n} - 702) // 26 % 26) || chr(65 + ({n} - 702) % 26) END"
CTX = f"""{CELLS}, {HEAD}, ctx AS MATERIALIZED (SELECT c.*, CASE WHEN has_header AND c.row > 0 AND coalesce({trimmed('n.value')}, '') <> '' THEN {trimmed('n.value')} ELSE {LETTERS.format(n='c.col::INT')} END AS context
 FROM cells c LEFT JOIN head USING (doc_id, sheet) LEFT JOIN cells n ON n.doc_id = c.doc_id AND n.sheet = c.sheet AND n.col = c.col AND n.row = 0),
types AS (SELECT doc_id, sheet, col, {classified('value')} AS type FROM cells JOIN head USING (doc_id, sheet) WHERE row = 0 AND has_header AND {classified('value')} IS NOT NULL),
st AS MATERIALIZED (SELECT doc_id, sheet, row, col, 0 AS "start", length(value)::INT AS "end", type, value AS text, 'rule' AS source, 0.99::DOUBLE AS score, {HEADER << 40}::BIGINT AS ord FROM cells JOIN types USING (doc_id, sheet, col) WHERE row > 0 AND value <> '')"""
COVER = "cover AS (SELECT DISTINCT doc_id, sheet, row, col FROM st)"
PLAN = r"plan AS (SELECT doc_id, sheet, col, context, value, count(*) AS targets FROM ctx ANTI JOIN cover USING (doc_id, sheet, row, col) WHERE regexp_matches(value, '[\p{L}\p{N}]') GROUP BY ALL)"
CELL_RULES = f"""u AS MATERIALIZED (SELECT row_number() OVER () AS doc_id, context, value, context || ': ' || value || ' | ' AS text FROM (SELECT DISTINCT context, value FROM ctx WHERE value <> '')),
cr AS MATERIALIZED (SELECT c.doc_id, c.sheet, c.row, c.col, greatest(d."start" - length(u.context) - 2, 0)::INT AS "start", least(d."end" - length(u.context) - 2, length(u.value))::INT AS "end", d.type, d.source, d.score, d.ord, u.value
 FROM ({detected('SELECT doc_id, text FROM u')}) d JOIN u USING (doc_id) JOIN ctx c USING (context, value)),
both_ AS MATERIALIZED (SELECT doc_id, sheet, row, col, "start", "end", type, substr(value, "start" + 1, "end" - "start") AS text, source, score, ord FROM cr WHERE "start" < "end" UNION ALL SELECT * FROM st)"""
O["classify_columns"] = f"""SELECT header, {classified('header')} AS type FROM (SELECT DISTINCT header FROM (SELECT concat_ws('_', word, ['name', 'Email', 'phoneNo', 'zip', 'user name', 'first_name', 'dateOfBirth'][doc_id % 7 + 1]) AS header FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS word FROM documents)
 UNION ALL SELECT unnest([{', '.join(q(x) for x in (*CUSTOMER, *SUPPLIER, 'FirstName', 'E-mail', 'IBAN', 'city', 'Home Town', 'LinkedIn', 'web site', ''))}])))"""
O["detect_header"] = f"WITH {CELLS}, {HEAD} SELECT * FROM head"
O["unpivot_cells"] = f"WITH {CTX} SELECT * FROM ctx"
O["column_label"] = f"SELECT p_partkey, {LETTERS.format(n='(p_partkey % 17000)::INT')} AS label FROM part"
O["structural_spans"] = f"WITH {CTX} SELECT * FROM st"
O["covered_cells"] = f"WITH {CTX}, {CELL_RULES} SELECT DISTINCT doc_id, sheet, row, col FROM both_ JOIN cells USING (doc_id, sheet, row, col) WHERE score >= 0.99 AND \"start\" = 0 AND \"end\" = length(cells.value)"
O["scan_plan"] = f"WITH {CTX}, {COVER}, {PLAN} SELECT * FROM plan"
O["scan_stats"] = f"""WITH {CTX}, {COVER}, {PLAN} SELECT doc_id, count(*) AS cells, coalesce((SELECT count(*) FROM plan p WHERE p.doc_id = c.doc_id), 0) AS unique_values, coalesce((SELECT sum(targets) - count(*) FROM plan p WHERE p.doc_id = c.doc_id), 0)::BIGINT AS reused_cells, coalesce((SELECT count(*) FROM cover p WHERE p.doc_id = c.doc_id), 0) AS rule_covered_cells FROM cells c WHERE value <> '' GROUP BY doc_id"""
O["project_findings"] = f"""WITH {CTX}, {COVER}, {PLAN} SELECT c.doc_id, c.sheet, c.row, c.col, 0 AS "start", least(5, length(value))::INT AS "end", 'LOCATION' AS type, value[1:5] AS text, 0.8::DOUBLE AS score FROM ctx c JOIN plan USING (doc_id, sheet, col, context, value)"""
O["clip_to_cells"] = f"""WITH {CTX} SELECT doc_id, sheet, row, col, 0 AS "start", least(4, length(value))::INT AS "end", 'PERSON' AS type, value[1:4] AS text FROM ctx WHERE value <> ''"""
O["cell_decisions"] = f"""WITH {CTX}, d AS (SELECT doc_id, sheet, row, col, row % 2 = 0 AS on_ FROM cells WHERE row > 0 AND row % 3 = 0 AND col < 2)
SELECT doc_id, sheet, row, col, "start", "end", type, text, source FROM st ANTI JOIN d USING (doc_id, sheet, row, col)
UNION ALL SELECT c.doc_id, c.sheet, c.row, c.col, 0, length(value)::INT, coalesce(type, 'CUSTOM'), value, 'manual' FROM cells c JOIN d USING (doc_id, sheet, row, col) LEFT JOIN types USING (doc_id, sheet, col) WHERE on_ AND value <> ''"""
O["column_decisions"] = f"WITH {CELLS} SELECT doc_id, sheet, row, col, col = 0 AS value FROM cells WHERE row > 0 AND col <> 1 AND trim(value) <> ''"
TABLE = f"""{CTX}, {CELL_RULES}, id AS (SELECT DISTINCT doc_id AS book, sheet, row, col, doc_id * 1000000000 + sheet * 100000000 + row * 10 + col AS doc_id FROM cells),
res AS MATERIALIZED ({resolved('SELECT id.doc_id, b."start", b."end", b.type, b.text, b.source, b.score, b.ord FROM both_ b JOIN id ON id.book = b.doc_id AND id.sheet = b.sheet AND id.row = b.row AND id.col = b.col')}),
live AS (SELECT res.*, book FROM res JOIN id USING (doc_id)), k AS ({numbered('SELECT * FROM live', 'book', 'doc_id * 1000 + "start"')}),
p AS (SELECT doc_id, "start", "end", {LABEL} AS new FROM (SELECT live.*, {norm('text')} AS value FROM live) JOIN k USING (book, type, value)),
cc AS (SELECT id.doc_id, c.value, c.doc_id AS book, c.sheet, c.row, c.col FROM cells c JOIN id ON id.book = c.doc_id AND id.sheet = c.sheet AND id.row = c.row AND id.col = c.col),
done AS MATERIALIZED (SELECT book AS doc_id, sheet, row, col, value FROM ({applied('SELECT * FROM cc', 'SELECT * FROM p', 'doc_id', 'value')}))"""
O["redact_table"] = f"WITH {TABLE} SELECT * FROM done"
O["pivot_back"] = f"WITH {TABLE} SELECT doc_id, sheet, row, any_value(value) FILTER (col = 0) AS name, any_value(value) FILTER (col = 1) AS account, any_value(value) FILTER (col = 2) AS segment, any_value(value) FILTER (col = 3) AS balance FROM done WHERE sheet = 0 AND row > 0 GROUP BY ALL"
O["apply_to_runs"] = f"""WITH t AS MATERIALIZED (SELECT * FROM ({TEXTS}) WHERE text <> ''), r AS MATERIALIZED ({resolved(detected('SELECT * FROM t'))}),
ch AS (SELECT doc_id, unnest(range(0, length(text))) AS i, unnest(string_split(text, '')) AS ch FROM t),
m AS (SELECT ch.*, r."start" AS s, '[' || r.type || ']' AS new FROM ch LEFT JOIN r ON r.doc_id = ch.doc_id AND ch.i >= r."start" AND ch.i < r."end")
SELECT doc_id, (i // 7)::INT AS run_no, string_agg(CASE WHEN s IS NULL THEN ch WHEN i = s THEN new ELSE '' END, '' ORDER BY i) AS text FROM m GROUP BY doc_id, i // 7"""

# Quality, layout and scalars


def evaluated(predicted: str) -> str:
    return f"""SELECT type, g AS n_gold, p AS n_predicted, b AS n_right, round(CASE WHEN p > 0 THEN b / p ELSE 0 END, 9) AS precision, round(CASE WHEN g > 0 THEN b / g ELSE 0 END, 9) AS recall, round(CASE WHEN b > 0 THEN 2 * b / (p + g) ELSE 0 END, 9)::DOUBLE AS f1
 FROM (SELECT type, count(*) AS g, count(*) FILTER ({predicted}) AS p, count(*) FILTER ({predicted}) AS b FROM r GROUP BY ROLLUP (type))"""


O["eval_spans"] = f"""WITH {R} {evaluated("type <> 'PHONE' AND " + '"start" % 7 <> 0')}"""
O["passes_gate"] = f"""WITH {R}, e AS ({evaluated("type <> 'PHONE'")}) SELECT coalesce(type, '*') AS type, 1.0::DOUBLE AS base_f1, CASE WHEN n_predicted = 0 AND type = 'PHONE' THEN f1 ELSE f1 END AS f1, 1 - f1 <= 0.005 AS accepted FROM e"""
O["eval_chars"] = rf"""WITH {R}, g AS (SELECT DISTINCT doc_id, unnest(range("start", "end")) AS i FROM r), p AS (SELECT DISTINCT doc_id, unnest(range("start", "end" - 1)) AS i FROM r WHERE "start" % 3 <> 0)
SELECT doc_id, count(*) AS n_gold, count(*) FILTER (p.hit) AS n_covered, count(*) FILTER (p.hit) AS n_predicted FROM g LEFT JOIN (SELECT *, true AS hit FROM p) p USING (doc_id, i) JOIN t USING (doc_id) WHERE NOT regexp_matches(substr(text, i + 1, 1), '\s') GROUP BY doc_id"""
CAPITAL = places("SELECT doc_id, text FROM documents", "[A-Z][a-z]{5,}")
O["name_coverage"] = f"""WITH o AS MATERIALIZED ({CAPITAL}), n AS (SELECT DISTINCT doc_id, g AS name FROM o),
ch AS (SELECT doc_id, name, unnest(range(strpos(text, name) - 1, strpos(text, name) - 1 + length(name))) AS i FROM n JOIN documents USING (doc_id)),
hit AS (SELECT DISTINCT doc_id, unnest(range(st + st % 2, st + length(g))) AS i FROM o)
SELECT ch.doc_id AS case_id, name, bool_and(hit.i IS NOT NULL) AS covered FROM ch LEFT JOIN hit ON hit.doc_id = ch.doc_id AND hit.i = ch.i GROUP BY ch.doc_id, name"""
ITEMS = "SELECT l_orderkey AS doc_id, 1 AS page, (l_linenumber - 1) % 4 * 50.0 AS x, (l_linenumber - 1) // 4 AS line, 'p' || l_partkey AS text, l_linenumber - 1 AS k FROM lineitem"
O["page_lines"] = f"SELECT doc_id, page, (dense_rank() OVER (PARTITION BY doc_id ORDER BY line) - 1)::INT AS line, x::DOUBLE AS x, text FROM ({ITEMS})"
O["page_text"] = f"""WITH i AS ({ITEMS}), b AS (SELECT *, lag(k) OVER w AS pk, max(x + CASE WHEN k % 2 = 0 THEN 49.5 ELSE 20 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i WINDOW w AS (PARTITION BY doc_id, line ORDER BY x, text)),
l AS (SELECT doc_id, line, string_agg(CASE WHEN reach IS NULL THEN '' WHEN x - reach > 15 THEN chr(9) WHEN x - reach > 1 THEN ' ' ELSE '' END || text, '' ORDER BY x, text) || chr(10) AS t FROM b GROUP BY doc_id, line)
SELECT doc_id, 1 AS page, string_agg(t, '' ORDER BY line) AS text FROM l GROUP BY doc_id"""
O["page_needs_ocr"] = f"SELECT doc_id, page, sum(length(text)) < 25 AS needs_ocr FROM ({ITEMS}) GROUP BY doc_id, page"
O["rectangles"] = """WITH c AS (SELECT c_custkey AS doc_id, length(c_name) AS n FROM customer), b AS (SELECT doc_id, n, unnest(range(2, n)) AS i FROM c)
SELECT doc_id, 2 AS "start", n::INT AS "end", 1 AS page, round(100 + min(i % 10) * 6 - 3.0, 6)::DOUBLE AS x, round(i // 10 * 15 - 3.0, 6)::DOUBLE AS y, round(count(*) * 6 + 6.0, 6)::DOUBLE AS w, 18.0::DOUBLE AS h FROM b GROUP BY doc_id, n, i // 10"""
O["rectangles_of_characters"] = O["rectangles"]


def serial_text(serial: str, date1904: bool) -> str:
    epoch, days = ("1904-01-01", serial) if date1904 else ("1899-12-31", f"{serial} - CASE WHEN {serial} >= 60 THEN 1 ELSE 0 END")
    moment = f"TIMESTAMP '{epoch}' + to_seconds(floor(floor(({days}) * 86400000 + 0.5) / 1000)::BIGINT)"
    return f"CASE WHEN {serial} = floor({serial}) THEN strftime({moment}, '%Y-%m-%d') ELSE strftime({moment}, '%Y-%m-%d %H:%M:%S') END"


O["excel_serial_date"] = f"""WITH f AS (SELECT o_orderkey, ([{', '.join(f'{x}::DOUBLE' for x in FRACTIONS)}])[o_orderkey % {len(FRACTIONS)} + 1] AS part, o_orderdate::DATE AS d FROM orders),
o AS (SELECT o_orderkey, date_diff('day', DATE '1899-12-30', d) + part AS serial, (o_orderkey % 120)::DOUBLE + part AS early FROM f)
SELECT o_orderkey, {serial_text('serial', False)} AS d1900, {serial_text('(serial - 1462)', True)} AS d1904, {serial_text('early', False)} AS early FROM o"""
O["zero_pad"] = "SELECT o_orderkey, lpad(o_orderkey::VARCHAR, greatest(8, length(o_orderkey::VARCHAR))::INT, '0') AS padded, ('9007199254' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0'))::HUGEINT > 9007199254740991 AS keeps_text FROM orders"
O["cell_address"] = "SELECT p_partkey, p_partkey::INT AS row, (p_partkey % 17000)::INT AS col FROM part"
O["scrub_office_xml"] = """SELECT c_custkey, '<w:ins w:author="Redacted" w:initials="R" w15:userId=""><w:t>x</w:t></w:ins><dc:creator></dc:creator><vt:lpwstr></vt:lpwstr>' AS xml FROM customer"""
O["date_formats"] = f"SELECT o_orderkey, o_orderkey % 60 BETWEEN 14 AND 22 OR o_orderkey % 60 BETWEEN 45 AND 47 OR o_orderkey % {len(CODES)} IN (2, 5, 7) AS is_date FROM orders"
O["xml_texts"] = """SELECT c_custkey, '<' || c_name || '&"é" _x00G0_>' AS decoded, '&lt;' || c_name || '&amp;&quot;é&quot; _x00G0_&gt;' AS escaped FROM customer"""
O["score_digits"] = "SELECT event_id, floor(value / 64 * 10000 + 0.5) / 10000 AS score FROM events"
NEUTRAL = rf"""CASE WHEN regexp_matches(value, '^[+-]?(\d[\d,]*)?(\.\d+)?([eE][+-]?\d+)?$') THEN value WHEN regexp_matches(value, {q(f'^{WS}*[=+@-]')}) THEN chr(39) || value ELSE value END"""
O["csv_lines"] = f"""WITH {CELLS}, v AS (SELECT doc_id, sheet, row, col, {NEUTRAL} AS v FROM cells)
SELECT doc_id, sheet, row, string_agg(CASE WHEN contains(v, ';') THEN '"' || v || '"' ELSE v END, ';' ORDER BY col) AS line FROM v GROUP BY doc_id, sheet, row"""
O["csv_round_trip"] = f"""WITH {CELLS} SELECT doc_id, sheet, (dense_rank() OVER (PARTITION BY doc_id, sheet ORDER BY row) - 1)::INT AS row, col, {NEUTRAL} AS value FROM cells"""
O["redacted_files"] = O["redact_label"]
O["key_files"] = f"""SELECT doc_id, position, type, {NEUTRAL.replace('value', 'original')} AS original, replacement FROM ({O['reid_key']})"""
O["scan_observed"] = f"SELECT {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('cells', 'unique_values', 'reused_cells', 'rule_covered_cells'))} FROM ({O['scan_stats']})"
O["clean_table"] = rf"""WITH {TABLE} SELECT d.doc_id, 'Sheet ' || (d.sheet + 1) AS sheet, d.row, d.col, d.value,
 CASE WHEN d.value = c.value AND regexp_matches(c.value, '^-?\d+\.\d\d$') THEN c.value::DOUBLE END AS scalar_num, NULL::BOOLEAN AS scalar_bool FROM done d JOIN cells c USING (doc_id, sheet, row, col)"""
O["align_tokens"] = f"""SELECT doc_id, (i - 1)::INT AS i, st AS "start", (st + length(g))::INT AS "end" FROM ({places(RARE, '[A-Za-z]+')})"""
O["widen_pieces"] = rf"""SELECT doc_id, st AS place, st AS "start", (st + length(g))::INT AS "end" FROM ({places(RARE, LONG_WORD)})"""
O["symbols_text"] = """WITH w AS (SELECT c_nationkey AS doc_id, c_custkey % 5 AS paragraph, c_custkey AS line, unnest([0, 1]) AS word, unnest(string_split(c_name, '#')) AS w FROM customer),
s AS (SELECT doc_id, paragraph, line, word, unnest(range(0, length(w)))::INT AS pos, unnest(string_split(w, '')) AS text FROM w),
m AS (SELECT *, lag(paragraph) OVER o AS p, lag(line) OVER o AS l, lag(word) OVER o AS k FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY paragraph, line, word, pos)),
x AS (SELECT *, CASE WHEN k IS NULL THEN '' WHEN p <> paragraph THEN chr(10) || chr(10) WHEN l <> line THEN chr(10) WHEN k <> word THEN ' ' ELSE '' END || text AS part FROM m)
SELECT doc_id, 1 AS page, line, word, pos, part, (sum(length(part)) OVER (PARTITION BY doc_id ORDER BY paragraph, line, word, pos) - 1)::INT AS idx FROM x"""
O["blacked_out"] = f"""SELECT doc_id, page, x, y, w, h FROM ({O['rectangles']}) UNION SELECT c_custkey, 1, 1.0, 2.0, 30.0, 4.0 FROM customer WHERE c_custkey % 3 = 0"""
O["stale_exports"] = f"""WITH {R} SELECT doc_id, CASE WHEN bool_and(on_) THEN NULL WHEN bool_or(on_) THEN 'review choices changed during the export' ELSE 'the document is gone' END AS reason
FROM (SELECT doc_id, doc_id % 3 <> 0 OR "start" % 2 = 0 AS on_ FROM r) GROUP BY doc_id"""
O["scan_samples"] = f"""WITH {CTX}, {COVER}, {PLAN} SELECT doc_id, sheet, col, context, value, 0 AS "start", length(value)::INT AS "end", CASE value WHEN 'Total' THEN 'PERSON' ELSE 'ORG' END AS type, 0.9::DOUBLE AS score
FROM plan WHERE value IN ('BUILDING', 'MACHINERY', 'Total')"""

O["model_states"] = r"""SELECT doc_id, CASE WHEN contains(text, 'Que') THEN 'failed' ELSE 'done' END AS ml_state, CASE WHEN contains(text, 'Que') THEN 'no such language' END AS ml_error
FROM documents WHERE regexp_matches(text, '[\p{L}\p{N}]')"""
O["file_kinds"] = """WITH f AS (SELECT doc_id, ['txt', 'MD', 'csv', 'tsv', 'xls', 'xlsm', 'doc', 'pdf', 'JSON', 'tar.gz'][doc_id % 10 + 1] AS e FROM documents)
SELECT doc_id, 'in/' || doc_id || '.' || e AS path, CASE WHEN e IN ('csv', 'tsv') THEN 'table' WHEN e IN ('txt', 'MD', 'JSON') THEN 'text' END AS kind,
 CASE e WHEN 'xls' THEN 'old workbook: save it as .xlsx' WHEN 'xlsm' THEN 'workbook with macros: save it as .xlsx' WHEN 'doc' THEN 'old document: save it as .docx'
  WHEN 'pdf' THEN 'unsupported type' WHEN 'tar.gz' THEN 'unsupported type' END AS reason FROM f"""
O["file_notes"] = """SELECT doc_id::VARCHAR AS path, concat_ws('; ', CASE doc_id % 3 WHEN 1 THEN 'read as Windows-1252' WHEN 2 THEN 'saved again as UTF-8' END,
 CASE WHEN doc_id % 2 = 0 THEN 'byte order mark kept' END) AS notes FROM documents"""
O["sheets_union"] = f"WITH {CELLS} SELECT doc_id, (1 - sheet)::INT AS sheet, row, col, value FROM cells"
O["header_choices"] = f"WITH {CELLS}, {HEAD} SELECT doc_id, sheet, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 ELSE has_header END AS has_header FROM head"
O["stream_redacted"] = f"""WITH t AS MATERIALIZED (SELECT doc_id, text FROM documents), r AS MATERIALIZED ({resolved(detected('SELECT * FROM t'))}), k AS ({numbered('SELECT * FROM r')}),
p AS (SELECT doc_id, "start", "end", {LABEL} AS new FROM (SELECT r.*, {norm('text')} AS value FROM r) JOIN k USING (doc_id, type, value))
{applied('SELECT * FROM t', 'SELECT * FROM p')}"""
O["stream_labelled"] = O["redact_conversations"]

ORACLES = O

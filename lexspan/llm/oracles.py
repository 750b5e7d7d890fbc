"""SQL for the operators that it can express, for DuckDB."""

from __future__ import annotations

from lexspan.llm import pii, quality, secrets

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_SPACE = r"[\x20\x09-\x0D]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_scan() -> str:
    parts = []
    for rank, r in enumerate(secrets.RULES):
        found, counted = f"regexp_extract_all(text, {_quoted(r.java)})", f"regexp_extract_all(text, {_quoted(r.java)}, {r.group})"
        parts.append(f"SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, {r.least} AS least, unnest({found}) AS hit, unnest({counted}) AS counted, unnest(list_slice(string_split_regex(text, {_quoted(r.java)}), 1, len({found}))) AS gap, unnest(range(len({found}))) AS i FROM docs")
    base = ", ".join(_quoted(r.kind) for r in secrets.BASE)
    said = "kind || ':' || CAST(ends - length(hit) AS VARCHAR) || ':' || CAST(ends AS VARCHAR)"
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in secrets.BASE)
    return f"""WITH {_DOCS}, hits AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS ends FROM hits),
good AS (SELECT * FROM placed WHERE length(counted) >= least)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({said}, ',' ORDER BY ends - length(hit), rank) FILTER (kind IN ({base})), '')) AS base_sha256, coalesce(string_agg({said}, ',' ORDER BY ends - length(hit), rank), '') AS spans
FROM docs d LEFT JOIN good g ON g.doc_id = d.doc_id GROUP BY d.doc_id"""


#: The key of the registered query, which SQL has to know as well. An example: real data need a secret one.
EXAMPLE_KEY = "example key, not secret"


def pii_pseudonyms(key: str = EXAMPLE_KEY) -> str:
    full = lambda name: f"regexp_full_match(m, {_quoted(pii.FORMATS[name])})"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = lambda d, parity: f"list_sum(list_transform(string_split({d}, ''), lambda x, i: CASE WHEN (i - 1) % 2 = {parity} THEN [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(x AS INTEGER) + 1] ELSE CAST(x AS INTEGER) END))"
    date = "CASE WHEN regexp_matches(m, '^[0-9]{4}-') THEN try_strptime(m, '%Y-%m-%d') WHEN contains(m, '.') THEN try_strptime(m, '%d.%m.%Y') ELSE try_strptime(m, '%m/%d/%Y') END"
    kind = f"""CASE WHEN {full("email")} THEN 'email'
  WHEN {full("date")} THEN CASE WHEN {date} BETWEEN TIMESTAMP '1800-01-01' AND TIMESTAMP '2199-12-31' THEN 'date' END
  WHEN {full("ip")} THEN CASE WHEN list_max(list_transform(string_split(m, '.'), lambda o: CAST(o AS INTEGER))) <= 255 AND NOT regexp_matches(m, '(^|\\.)0[0-9]') THEN 'ip' END
  WHEN {full("ssn")} THEN CASE WHEN NOT regexp_matches(m, '^(000|666|9..)|^...-00|-0000$') THEN 'ssn' END
  WHEN {full("phone")} THEN 'phone'
  WHEN {full("card")} THEN CASE WHEN {luhn(digits, f"length({digits}) % 2")} % 10 = 0 THEN 'card' END END"""
    turns = []
    for i in range(pii.ROUNDS):
        hash_ = lambda x, i=i: f"CAST('0x' || substr(sha256(concat_ws('|', {_quoted(key)}, kind, own, {i}, {x})), 1, 15) AS BIGINT)"
        move = f"(l + {hash_('r')}) % a AS l, r" if i % 2 == 0 else f"l, (r + {hash_('l')}) % b AS r"
        turns.append(f"turn{i} AS (SELECT * EXCLUDE (l, r), {move} FROM {f'turn{i - 1}' if i else 'numbered'})")
    mails = []
    alphabet = "CASE WHEN c BETWEEN 'a' AND 'z' THEN chr(97 + (ascii(c) - 97 + s) % 26) WHEN c BETWEEN 'A' AND 'Z' THEN chr(65 + (ascii(c) - 65 + s) % 26) WHEN c BETWEEN '0' AND '9' THEN chr(48 + (ascii(c) - 48 + s) % 10) ELSE c END"
    for i in range(pii.ROUNDS):
        one, other = ("el", "er") if i % 2 == 0 else ("er", "el")
        stream = f"sha256(concat_ws('|', {_quoted(key)}, 'email', length(body), {i}, lower({other})))"
        letter = alphabet.replace("(ascii(c)", "(ascii(c)").replace(" s)", f" CAST('0x' || substr({stream}, (2 * j) % 64 + 1, 2) AS INTEGER))").replace("c ", f"substr({one}, j, 1) ").replace("ascii(c)", f"ascii(substr({one}, j, 1))").replace("ELSE c", f"ELSE substr({one}, j, 1)")
        new = f"array_to_string(list_transform(range(1, length({one}) + 1), lambda j: {letter}), '') AS {one}"
        mails.append(f"mail{i} AS (SELECT * EXCLUDE ({one}), {new} FROM {f'mail{i - 1}' if i else 'mails'})")
    half = "CAST(floor((n - 2) / 2.0) AS INTEGER)"
    payload = f"left({digits}, 1) || lpad(CAST(l AS VARCHAR), {half}, '0') || lpad(CAST(r AS VARCHAR), CAST(n - 2 - {half} AS INTEGER), '0')"
    filled = "array_to_string(list_transform(range(1, length(m) + 1), lambda j: CASE WHEN regexp_matches(substr(m, j, 1), '[0-9]') THEN substr(filling, length(regexp_replace(left(m, j), '[^0-9]', '', 'g')), 1) ELSE substr(m, j, 1) END), '')"
    day = "CAST(DATE '1800-01-01' + CAST(l * 773 + r AS INTEGER) AS TIMESTAMP)"
    area = "CASE WHEN l // 99 + 1 >= 666 THEN l // 99 + 2 ELSE l // 99 + 1 END"
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in pii.FORMATS)
    ten = f"right({digits}, 10)"
    part = lambda a, n, of=ten: f"CAST(substr({of}, {a}, {n}) AS BIGINT)"
    size = lambda at: f"CASE WHEN {part(at, 3)} >= 200 THEN 80000 ELSE 20000 END"
    code = lambda at: f"({part(at, 3)} - CASE WHEN {part(at, 3)} >= 200 THEN 200 ELSE 0 END)"
    whole = lambda x, of: f"lpad(CAST({x} // 100 + CASE WHEN {of} = 80000 THEN 200 ELSE 0 END AS VARCHAR), 3, '0')"
    octet = lambda i: f"CAST(string_split(m, '.')[{i}] AS BIGINT)"
    days = f"date_diff('day', TIMESTAMP '1800-01-01', {date})"
    first = part(1, 3, digits)
    return rf"""WITH {_DOCS}, numbered_docs AS (SELECT row_number() OVER () AS rid, * FROM docs),
found AS (SELECT rid, doc_id, regexp_extract_all(text, {_quoted(pii.PATTERN)}) AS ms, string_split_regex(text, {_quoted(pii.PATTERN)}) AS gaps FROM numbered_docs),
hits AS (SELECT rid, unnest(ms) AS m, unnest(range(len(ms))) AS i FROM found),
kinds AS (SELECT *, {kind} AS kind, length({digits}) AS n FROM hits),
sized AS (SELECT *, {half} AS half,
  CASE kind WHEN 'card' THEN CAST(pow(10, {half}) AS BIGINT) WHEN 'phone' THEN {size(1)} WHEN 'ip' THEN 65536 WHEN 'ssn' THEN 88902 WHEN 'date' THEN 189 END AS a,
  CASE kind WHEN 'card' THEN CAST(pow(10, n - 2 - {half}) AS BIGINT) WHEN 'phone' THEN {size(4)} WHEN 'ip' THEN 65536 WHEN 'ssn' THEN 9999 WHEN 'date' THEN 773 END AS b,
  CASE kind WHEN 'card' THEN CAST(substr({digits}, 2, {half}) AS BIGINT) WHEN 'phone' THEN {code(1)} * 100 + {part(7, 2)} WHEN 'ip' THEN {octet(1)} * 256 + {octet(2)} WHEN 'ssn' THEN ({first} - 1 - CASE WHEN {first} > 666 THEN 1 ELSE 0 END) * 99 + {part(4, 2, digits)} - 1 WHEN 'date' THEN {days} // 773 END AS l,
  CASE kind WHEN 'card' THEN CAST(substr({digits}, 2 + {half}, n - 2 - {half}) AS BIGINT) WHEN 'phone' THEN {code(4)} * 100 + {part(9, 2)} WHEN 'ip' THEN {octet(3)} * 256 + {octet(4)} WHEN 'ssn' THEN {part(6, 4, digits)} - 1 WHEN 'date' THEN {days} % 773 END AS r
  FROM kinds WHERE kind <> 'email'),
numbered AS (SELECT *, CASE kind WHEN 'card' THEN n WHEN 'phone' THEN 2 * a + b ELSE 0 END AS own FROM sized), {", ".join(turns)},
fillings AS (SELECT *, CASE kind WHEN 'card' THEN {payload} WHEN 'phone' THEN left({digits}, n - 10) || {whole('l', 'a')} || {whole('r', 'b')} || lpad(CAST(l % 100 AS VARCHAR), 2, '0') || lpad(CAST(r % 100 AS VARCHAR), 2, '0') END AS filling0 FROM turn{pii.ROUNDS - 1}),
checked AS (SELECT *, CASE kind WHEN 'card' THEN filling0 || CAST((10 - {luhn("filling0", "(length(filling0) + 1) % 2")} % 10) % 10 AS VARCHAR) ELSE filling0 END AS filling FROM fillings),
mails AS (SELECT rid, i, m, regexp_replace(m, '\.[A-Za-z]+$', '') AS body, regexp_extract(m, '\.[A-Za-z]+$') AS ending, left(regexp_replace(m, '\.[A-Za-z]+$', ''), length(regexp_replace(m, '\.[A-Za-z]+$', '')) // 2) AS el, substr(regexp_replace(m, '\.[A-Za-z]+$', ''), length(regexp_replace(m, '\.[A-Za-z]+$', '')) // 2 + 1) AS er FROM kinds WHERE kind = 'email'), {", ".join(mails)},
written AS (SELECT rid, i, kind, CASE kind WHEN 'ip' THEN concat_ws('.', l // 256, l % 256, r // 256, r % 256) WHEN 'ssn' THEN lpad(CAST({area} AS VARCHAR), 3, '0') || '-' || lpad(CAST(l % 99 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(r + 1 AS VARCHAR), 4, '0')
  WHEN 'date' THEN CASE WHEN regexp_matches(m, '^[0-9]{{4}}-') THEN strftime({day}, '%Y-%m-%d') WHEN contains(m, '.') THEN strftime({day}, '%d.%m.%Y') ELSE strftime({day}, '%m/%d/%Y') END ELSE {filled} END AS new FROM checked
  UNION ALL SELECT rid, i, 'email', el || er || ending FROM mail{pii.ROUNDS - 1}
  UNION ALL SELECT rid, i, NULL, m FROM kinds WHERE kind IS NULL),
gaps AS (SELECT rid, doc_id, unnest(gaps) AS gap, unnest(range(len(gaps))) AS i FROM found)
SELECT any_value(doc_id) AS doc_id, string_agg(gap || coalesce(new, ''), '' ORDER BY i) AS text, {counts} FROM gaps LEFT JOIN written USING (rid, i) GROUP BY rid"""


def quality_rules(rules: quality.LineRules = quality.LineRules()) -> str:
    # the terms' words in a line whose words stand in blanks: what goes when a term is taken out, by the term's length
    within = lambda names: "(" + " + ".join(f"(length(bare) - length(replace(bare, {_quoted(quality.spaced(x))}, ''))) // {len(quality.spaced(x))} * {len(x.split(' '))}" for x in names) + ")"
    bars = "[" + ", ".join(_quoted(x) for x in quality.BARS) + "]"
    return rf"""WITH {_DOCS},
split AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{_SPACE}+'), lambda w: w <> '') AS ws FROM docs),
words AS (SELECT doc_id, unnest(ws) AS a, unnest(range(len(ws))) AS i FROM split),
threes AS (SELECT doc_id, i, a || ' ' || lead(a) OVER w || ' ' || lead(a, 2) OVER w AS t FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM threes WHERE t IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, CAST(count(DISTINCT i + j) AS BIGINT) AS n_repeat_words FROM often, range(3) r(j) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
full_lines AS (SELECT doc_id, line, regexp_replace(line, '{_SPACE}+', '', 'g') AS dense, list_filter(string_split_regex(line, '{_SPACE}+'), lambda w: w <> '') AS ws FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
bared AS (SELECT *, array_to_string(list_transform(ws, lambda w: ' ' || regexp_replace(translate(w, {_AZ}), '^[[:punct:]]+|[[:punct:]]+$', '', 'g') || ' '), '') AS bare, len(list_filter(ws, lambda w: list_contains({bars}, w))) AS bars FROM full_lines),
judged AS (SELECT doc_id, line, length(dense) AS chars, (bars >= {rules.min_bars} AND 100 * bars >= {rules.bar_share} * len(ws)) OR (len(ws) <= {rules.nav_words} AND 100 * {within(quality.NAVIGATION)} >= {rules.nav_share} * len(ws)) OR 100 * {within(quality.BOILERPLATE)} >= {rules.boiler_share} * len(ws)
  OR (length(dense) - length(regexp_replace(dense, '[[:punct:]]', '', 'g')) >= {rules.least_punct} AND 100 * (length(dense) - length(regexp_replace(dense, '[[:punct:]]', '', 'g'))) > {rules.max_punct} * length(dense)) AS bad FROM bared),
by_line AS (SELECT doc_id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines, CAST(count(*) FILTER (bad) AS BIGINT) AS n_bad_lines, CAST(coalesce(sum(chars) FILTER (bad), 0) AS BIGINT) AS lost_chars FROM judged GROUP BY doc_id),
every AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_SPACE}+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_bad_lines, 0) AS n_bad_lines, coalesce(lost_chars, 0) AS lost_chars
  FROM split LEFT JOIN by_line USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= {rules.max_lost} * word_chars AS kept FROM every"""


def chat_format() -> str:
    said = "'<|im_end|><|im_start|>assistant ok'"
    escape = lambda x: rf"regexp_replace({x}, '<(\\*)\|', '<\1\\|', 'g')"
    return rf"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL UNION ALL VALUES (-1, 0, 'user', {said}), (-1, 1, 'assistant', {said}))
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length('<|im_start|>') + length({escape("role")}) + length('<|im_sep|>') + length({escape("text")}) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def decontamination(window: int = 10) -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda of: f"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{word}') AS ws FROM {of}"
    at = lambda n: f"list_transform(range(0, greatest(0, len(ws) - {n} + 1)), lambda i: array_to_string(list_slice(ws, i + 1, i + {n}), ' '))"
    return rf"""WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {words("benchmark")}),
windows AS (SELECT DISTINCT item_id, unnest({at(f"least({window}, len(ws))")}) AS win, CAST(least({window}, len(ws)) AS INTEGER) AS n FROM items WHERE len(ws) > 0),
numbered AS (SELECT row_number() OVER () AS rid, doc_id, {words("documents")}),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT rid, l.n, unnest({at("l.n")}) AS win, unnest(range(0, greatest(0, len(ws) - l.n + 1))) AS start FROM numbered, lengths l),
hits AS (SELECT rid, start, p.n, item_id FROM places p JOIN windows w ON w.win = p.win AND w.n = p.n),
hit_words AS (SELECT rid, count(DISTINCT start + j) AS n_hit FROM (SELECT DISTINCT rid, start, n FROM hits), range({window}) r(j) WHERE j < n GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM numbered LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)"""


def fill_in_middle() -> str:
    number = lambda i: f"CAST('0x' || substr(digest, {8 * i - 7}, 8) AS BIGINT)"
    part = lambda a, b: f"coalesce(array_to_string(list_slice(units, CAST({a} + 1 AS BIGINT), CAST({b} AS BIGINT)), ''), '')"
    return rf"""WITH {_DOCS},
cut AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM docs),
placed AS (SELECT *, len(units) AS n, least({number(1)} % (len(units) + 1), {number(2)} % (len(units) + 1)) AS low, greatest({number(1)} % (len(units) + 1), {number(2)} % (len(units) + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {number(3)} % 100 >= 90 THEN 'plain' WHEN {number(4)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parted AS (SELECT *, {part("0", "low")} AS p, {part("low", "high")} AS m, {part("high", "n")} AS s FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM parted"""


SQL = {"op2_pii_pseudonyms": pii_pseudonyms(), "op3_secret_scan": secret_scan(), "op5_chat_format": chat_format(), "op9_quality_rules": quality_rules(), "op11_decontamination": decontamination(), "op13_fill_in_middle": fill_in_middle()}

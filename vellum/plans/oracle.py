"""DuckDB SQL of the library's queries."""

from __future__ import annotations

from vellum.functions.text import CHECKBOX_KEYS, LOAN_KEYWORDS, title_of
from vellum.operators import retrieve
from vellum.operators.validate import NO_PAGES, REQUIRED_FIELDS
from vellum.plans import derive
from vellum.sources.ocr import KEYS

Q = "'"


def _text(value: str) -> str:
    return Q + value.replace(Q, Q + Q) + Q


FIELDS = f"f AS ({derive.FIELDS.format(lineitem='lineitem')})"
_NUMBER = r"regexp_replace(regexp_replace(regexp_replace(v, '\.+$', ''), '(\d)\s+(\d)', '\1\2', 'g'), '(\d)\s+(\d)', '\1\2', 'g')"
CLEANED = rf"""{FIELDS},
s AS (SELECT * EXCLUDE (value), trim(value) AS v FROM f),
n AS (SELECT *, trim(CASE WHEN regexp_full_match(v, '[\d\s,.]+') THEN {_NUMBER} ELSE v END) AS w FROM s),
c AS (SELECT *, regexp_replace(w, '(\d)([A-Z][a-zA-Z])', '\1 \2', 'g') AS value FROM n),
t AS (SELECT *, regexp_matches(value, '\d{{1,2}}/\d{{1,2}}/\d{{2,3}}$') AS dated, regexp_matches(value, '[a-zA-Z]$') AS lettered, CASE WHEN value <> v THEN v END AS original_value FROM c)"""
_BOXES = ", ".join(_text(k) for k in CHECKBOX_KEYS)
DEDUPED = f"""{CLEANED},
b AS (SELECT * FROM t WHERE NOT (v = '' AND key IN ({_BOXES}))),
d AS (SELECT session_id, ord, key, value, page, value_confidence AS confidence, dated OR lettered AS is_truncated, original_value FROM b
  QUALIFY row_number() OVER (PARTITION BY session_id, key, page ORDER BY value <> '' DESC, CASE WHEN value <> '' THEN value_confidence END DESC NULLS LAST, ord) = 1)"""
_REQUIRED = ", ".join(f"({i}, {_text(n)}, [{', '.join(map(_text, m))}])" for i, (n, m) in enumerate(REQUIRED_FIELDS))
PAGES = f"""p AS (SELECT session_id, page AS page_number, count(*) AS word_count, bool_or(ord % 29 = 0) AS has_handwriting,
  printf('%.2f', sum(value_confidence::DECIMAL(18, 6))::DOUBLE / count(*))::DOUBLE AS avg_confidence, 1 AS lines_removed FROM f WHERE {derive.HAS_PAGES} GROUP BY ALL)"""
REPORTS = f"""{DEDUPED},
{PAGES},
o AS (SELECT session_id, count(page_number) AS total_pages, coalesce(bool_or(has_handwriting), false) AS has_handwriting,
  coalesce(printf('%.2f', sum(avg_confidence::DECIMAL(18, 6) * word_count)::DOUBLE / sum(word_count))::DOUBLE, 0.0) AS overall
  FROM (SELECT DISTINCT session_id FROM f) LEFT JOIN p USING (session_id) GROUP BY session_id),
r(k, name, marks) AS (VALUES {_REQUIRED}),
m AS (SELECT o.session_id, r.k, r.name, (SELECT arg_min(d.value, (d.page, d.key)) FROM d WHERE d.session_id = o.session_id AND d.value <> ''
  AND len(list_filter(r.marks, lambda x: contains(lower(d.key), x))) > 0) AS value FROM o, r),
h AS (SELECT session_id, list(page_number ORDER BY page_number) FILTER (WHERE has_handwriting) AS hw FROM p GROUP BY session_id)"""
ISSUES = f"""{REPORTS},
i AS (
  SELECT session_id, 1 AS c, 0 AS a, '' AS b, 'error' AS severity, 'NO_PAGES' AS code, {_text(NO_PAGES)} AS message, NULL::INT AS page, NULL::VARCHAR AS field FROM o WHERE total_pages < 1
  UNION ALL SELECT session_id, 2 AS c, 0 AS a, '' AS b, CASE WHEN overall < 70 THEN 'error' ELSE 'warning' END AS severity,
    CASE WHEN overall < 70 THEN 'LOW' ELSE 'MODERATE' END || '_OVERALL_CONFIDENCE' AS code,
    'Overall confidence ' || printf('%.1f', overall) || CASE WHEN overall < 70 THEN '% is below error threshold 70.0%. Document may be too blurry or low quality for reliable extraction.'
      ELSE '% is below warning threshold 85.0%. Some extracted text may be inaccurate.' END AS message, NULL::INT AS page, NULL::VARCHAR AS field
  FROM o WHERE overall < 85
  UNION ALL SELECT session_id, 3, page_number, '', CASE WHEN avg_confidence < 70 THEN 'error' ELSE 'warning' END,
    CASE WHEN avg_confidence < 70 THEN 'LOW' ELSE 'MODERATE' END || '_PAGE_CONFIDENCE',
    'Page ' || page_number || ' confidence ' || printf('%.1f', avg_confidence) || CASE WHEN avg_confidence < 70 THEN '% below threshold.' ELSE '% is moderate.' END, page_number, NULL
  FROM p WHERE avg_confidence < 85
  UNION ALL SELECT session_id, 4, 0, '', 'info', 'HANDWRITING_DETECTED', 'Handwriting detected on page(s): [' || array_to_string(hw, ', ') || ']. Handwritten values may have lower accuracy.', NULL, NULL
  FROM h WHERE hw IS NOT NULL
  UNION ALL SELECT session_id, 5, page, key, 'warning', 'TRUNCATED_VALUE', 'Field ''' || key || ''' value ''' || value || ''' appears truncated.', page, key FROM d WHERE is_truncated
  UNION ALL SELECT session_id, 6, k, '', 'warning', 'MISSING_REQUIRED_FIELD', 'Required field ''' || name || ''' not found or has no value.', NULL, name FROM m WHERE value IS NULL
  UNION ALL SELECT session_id, 7, 0, '', 'error', 'NO_STRUCTURED_DATA', 'No form fields or tables extracted. Document may not be a structured loan form.', NULL, NULL
  FROM o WHERE session_id NOT IN (SELECT session_id FROM d) AND NOT ({derive.HAS_TABLE})
)"""

BLOCKS = """l AS (SELECT doc_id, 'd' || doc_id AS session_id, g - 1 AS line, lines[g] AS text, CAST(floor((g - 1) / 3) AS INT) + 1 AS page
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS g FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
w0 AS (SELECT doc_id, session_id, line, page, ws[g] AS text, g - 1 AS pos FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS g FROM (SELECT * EXCLUDE (text), string_split(text, ' ') AS ws FROM l))),
w1 AS (SELECT *, doc_id * 7919 + line * 104729 + pos * 1299709 + length(text) * 31 AS mark FROM w0),
w AS (SELECT session_id, line * 100000 + pos + 1 AS ord, page, text, mark % 211 = 0 AS unknown, mark % 97 = 0 AS hand, 40 + (mark % 6000) / 100.0::DOUBLE AS confidence FROM w1)"""
PAGE_STATS = f"""{BLOCKS},
lt AS (SELECT session_id, page, string_agg(text, chr(10) ORDER BY line) AS text FROM l GROUP BY ALL),
ws AS (SELECT session_id, page, count(*) AS word_count, printf('%.2f', sum(confidence::DECIMAL(18, 6))::DOUBLE / count(*))::DOUBLE AS avg_confidence,
  count(*) FILTER (WHERE confidence < 80) AS low_confidence_words, bool_or(hand) AS has_handwriting FROM w WHERE NOT unknown GROUP BY ALL),
ps AS (SELECT session_id, page AS page_number, text, coalesce(word_count, 0) AS word_count, coalesce(avg_confidence, 0.0) AS avg_confidence,
  coalesce(low_confidence_words, 0) AS low_confidence_words, coalesce(has_handwriting, false) AS has_handwriting FROM lt LEFT JOIN ws USING (session_id, page))"""

_CELL = "key || ' ' || value"
_MARK = "chr(10) || chr(10) || '[TABLE]' || chr(10)"
_BREAK = "chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10)"


def _grids(source: str, value: str) -> str:
    """gr: the dense grid of every session of ``source`` that has a table."""
    return f"""ce AS (SELECT session_id, (ord % 5)::INT AS r, ((ord * 7) % 4)::INT AS c, arg_max({value}, ord) AS v FROM {source} WHERE {derive.HAS_TABLE} GROUP BY ALL),
sz AS (SELECT session_id, max(r) AS rows, max(c) AS cols FROM ce GROUP BY session_id),
rw AS (SELECT sz.session_id, rr.r, string_agg(coalesce(ce.v, ''), ' | ' ORDER BY cc.c) AS line FROM sz, range(1, 5) rr(r), range(1, 4) cc(c)
  LEFT JOIN ce ON ce.session_id = sz.session_id AND ce.r = rr.r AND ce.c = cc.c WHERE rr.r <= sz.rows AND cc.c <= sz.cols GROUP BY ALL),
gr AS (SELECT sz.session_id, rows, cols, coalesce(string_agg(line, chr(10) ORDER BY r), '') AS grid FROM sz LEFT JOIN rw USING (session_id) GROUP BY ALL)"""


_BEFORE = "=== PAGE 1 ===\nShinhan Bank\nS\n  india  \nExtend Your Financial Network today\nmort-\ngage  \t terms\n\n\n\n“Rate” – it’s 5%\n"
_AFTER = "\n=== PAGE 22 ===\nloan | rate | term\na\tb\tc\nend"
ARTEFACTS = f"x AS (SELECT doc_id, {_text(_BEFORE)} || text || {_text(_AFTER)} AS text FROM documents)"
_STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
_COLLAPSE = _STRIP.format(r"regexp_replace(regexp_replace({}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g')")
_HYPHENS = r"regexp_replace({}, '([\p{{L}}\p{{N}}_]+)-\n([\p{{L}}\p{{N}}_]+)', '\1\2', 'g')"
_SMART = "translate({}, '‘’“”–—" + " " + "', '''''\"\"-- ')"
_MARKERS = r"regexp_replace({}, '=== PAGE \d+ ===\n?', '', 'g')"
_ODD = r"CASE WHEN length(text) = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace(text, '[\p{L}\p{N} .,!?\-:;()%$\n]', '', 'g'))::DOUBLE / length(text) END"


_PROSE = rf"""z AS (SELECT doc_id, {_SMART.format(_HYPHENS.format(_COLLAPSE.format('text')))} AS t FROM stripped),
zl AS (SELECT doc_id, g, ls[g] AS x FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS g FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM z))),
zn AS (SELECT *, CASE WHEN length(x) - length(replace(x, '|', '')) >= 2 OR len(string_split(x, chr(9))) >= 3 THEN len(regexp_split_to_array(x, '[|\t]')) ELSE 0 END AS k FROM zl),
zp AS (SELECT *, lead(x) OVER o AS nx, k > 0 AND coalesce(lead(k) OVER o = k, false) AND coalesce(lag(k) OVER o, 0) = 0 AND coalesce(lead(k, 2) OVER o, 0) = 0 AS pair
  FROM zn WINDOW o AS (PARTITION BY doc_id ORDER BY g)),
zq AS (SELECT *, coalesce(lag(pair) OVER (PARTITION BY doc_id ORDER BY g), false) AS told FROM zp),
zr AS (SELECT doc_id, string_agg(CASE WHEN pair THEN 'Details: ' || array_to_string(list_transform(list_zip(regexp_split_to_array(x, '[|\t]'), regexp_split_to_array(nx, '[|\t]')),
  lambda c: trim(c[1]) || ' ' || trim(c[2])), ', ') || '.' ELSE x END, chr(10) ORDER BY g) AS t FROM zq WHERE NOT told GROUP BY doc_id)"""


def _changed(expression: str) -> str:
    return f"WITH {ARTEFACTS}, y AS (SELECT doc_id, {expression} AS t FROM x) SELECT doc_id, md5(t) AS text_md5, length(t) AS n FROM y"


def _repeated(source: str) -> str:
    return rf"""ln AS (SELECT doc_id, g, lines[g] AS line, {_STRIP.format('lines[g]')} AS own
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS g FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {source}))),
often AS (SELECT doc_id, own, count(*) AS n FROM ln WHERE own <> '' GROUP BY ALL HAVING count(*) >= 3),
cut AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY g) AS text FROM ln ANTI JOIN often USING (doc_id, own) GROUP BY doc_id),
stripped AS (SELECT s.doc_id, coalesce(cut.text, '') AS text FROM {source} s LEFT JOIN cut USING (doc_id))"""


# a sentence ends where white space follows . ! or ?, found by a mark put behind it first
SENTENCES = r"""st AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS s FROM documents)"""


def _chunks(size: int, step: int) -> str:
    return f"""{SENTENCES},
ck AS (SELECT doc_id, (o / {step})::INT AS chunk_id, array_to_string(s[o + 1:o + {size}], ' ') AS text, len(s[o + 1:o + {size}]) AS n_sentences
  FROM (SELECT doc_id, s, unnest(range(0, len(s), {step})) AS o FROM st))"""


OFFSETS = f"""{_chunks(4, 4)},
co AS (SELECT doc_id, chunk_id, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM ck)"""


def _hits(k: int = 5) -> str:
    return f"""vc AS (SELECT 'v' || (vec_id // 64) AS session_id, vec_id AS chunk_id, embedding::DOUBLE[] AS e FROM embeddings),
hs AS (SELECT q.chunk_id AS query_id, q.session_id, c.chunk_id, list_inner_product(list_reverse(q.e), c.e) AS score FROM vc q JOIN vc c USING (session_id)),
ht AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM hs QUALIFY rank <= {k}),
tx AS (SELECT ht.*, d.text FROM ht JOIN documents d ON d.doc_id = ht.chunk_id),
bu AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS used_chars FROM tx QUALIFY used_chars <= 7000)"""


_STARTS = ", ".join(_text(s) for s in derive.QUESTION_STARTS)
_VARIANT = "CASE WHEN ('0x' || substr(md5({}::VARCHAR), 1, 8))::BIGINT % 100 < 50 THEN 'A' ELSE 'B' END"
QUESTIONS = rf"""qs AS (SELECT conv_id, turn, [{_STARTS}][turn % 6 + 1] || text AS question FROM conversations),
qi AS (SELECT *, lower({_STRIP.format('question')}) AS q FROM qs),
it AS (SELECT conv_id, turn, question, q, {_VARIANT.format('conv_id')} AS variant, CASE
  WHEN starts_with(q, 'summarize') OR starts_with(q, 'give me a summary') OR starts_with(q, 'overview') THEN 'summary'
  WHEN contains(q, 'explain') OR contains(q, 'what does') OR contains(q, 'define') THEN 'explanation'
  WHEN contains(q, 'emi') OR contains(q, 'interest rate') OR contains(q, 'monthly payment') OR contains(q, 'principal amount') OR contains(q, 'repayment schedule') THEN 'finance'
  WHEN contains(q, 'difference') OR contains(q, ' vs ') OR contains(q, 'compare') THEN 'comparison' ELSE 'retrieval' END AS intent FROM qi)"""
_TEMPLATES = ", ".join(f"({_text(i)}, {_text(v)}, {_text(t.replace('{system_instruction}', retrieve.SYSTEM))})" for (i, v), t in retrieve.TEMPLATES.items())
RUNS = f"""r0 AS ({derive.RUNS.format(events='events')}),
ru AS (SELECT *, {_VARIANT.format('user_id')} AS variant, 0.6::DOUBLE * faithfulness + 0.4::DOUBLE * relevance AS composite, tokens / 1000.0::DOUBLE * 0.002::DOUBLE AS cost FROM r0)"""
_MEAN = "sum(composite::DECIMAL(28, 12))::DOUBLE / count(composite)"

_TITLES = ", ".join(f"({_text(n)}, {_text(title_of(n))})" for n, _ in REQUIRED_FIELDS)
_RULE = "'', '---', ''"
#: The report as lines (session, section, a, b, line) in order; sections without lines are left out whole.
MARKDOWN = f"""WITH {ISSUES}, {_grids('t', 'value')},
n1 AS (SELECT session_id, sum(lines_removed) AS g FROM p GROUP BY session_id),
n2 AS (SELECT session_id, count(*) FILTER (WHERE is_truncated) AS c, string_agg(key || ' (p' || page || ')', ', ' ORDER BY page, key) FILTER (WHERE is_truncated) AS names, count(original_value) AS ch FROM d GROUP BY session_id),
nt AS (SELECT session_id, list_filter([CASE WHEN g > 0 THEN 'Removed ' || g || ' repeated header/footer lines across all pages.' END, CASE WHEN c > 0 THEN c || ' field(s) appear truncated: ' || names END,
  CASE WHEN ch > 0 THEN ch || ' field value(s) normalised (number spacing, digit-letter concat).' END], lambda x: x IS NOT NULL) AS l FROM o LEFT JOIN n1 USING (session_id) LEFT JOIN n2 USING (session_id)),
fn AS (SELECT session_id, arg_min(value, (page, key)) AS named FROM d WHERE contains(lower(key), 'first name') GROUP BY session_id),
er AS (SELECT session_id, count(*) FILTER (WHERE severity = 'error') AS errors FROM i GROUP BY session_id),
hd AS (SELECT o.session_id, ['# Loan Application' || CASE WHEN coalesce(named, '') <> '' THEN ' — ' || named ELSE '' END, '', '**Session:** `' || o.session_id || '`  ', '**Extracted:** 2025-01-01 00:00 UTC  ', '**Pages:** ' || total_pages || '  ',
  '**Overall Confidence:** ' || printf('%.1f', overall) || '%  ', '**Handwriting Detected:** ' || CASE WHEN has_handwriting THEN 'Yes — pages [' || array_to_string(hw, ', ') || ']' ELSE 'No' END || '  ',
  '**Validation:** ' || CASE WHEN coalesce(errors, 0) = 0 THEN 'PASS' ELSE 'FAIL' END, {_RULE}] AS l FROM o LEFT JOIN fn USING (session_id) LEFT JOIN er USING (session_id) LEFT JOIN h USING (session_id)),
ti(name, title) AS (VALUES {_TITLES}),
mk AS (SELECT session_id, r, cols, '| ' || line || ' |' AS line FROM rw JOIN sz USING (session_id)),
tb AS (SELECT session_id, string_agg(line || CASE WHEN r = 1 THEN chr(10) || '| ' || array_to_string(list_transform(range(cols), lambda x: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY r) AS body FROM mk GROUP BY session_id),
ls AS (
  SELECT session_id, 0 AS c, 0 AS a, '' AS b, l FROM hd
  UNION ALL SELECT session_id, 1, 0, '', ['## Cleaning Notes', ''] || list_transform(l, lambda x: '- ' || x) || [{_RULE}] FROM nt WHERE len(l) > 0
  UNION ALL SELECT session_id, 2, 0, '', ['## Validation Report', ''] FROM o
  UNION ALL SELECT session_id, 3, 0, '', ['No issues found.'] FROM o WHERE session_id NOT IN (SELECT session_id FROM i)
  UNION ALL SELECT session_id, 3, 10 * c, lpad(CAST(a AS VARCHAR), 9, '0') || b, ['- ' || CASE severity WHEN 'error' THEN '✗' WHEN 'warning' THEN '⚠' ELSE 'ℹ' END || ' **' || code || '**' || CASE WHEN coalesce(page, 0) <> 0 THEN ' (page ' || page || ')' ELSE '' END
    || CASE WHEN coalesce(field, '') <> '' THEN ' [field: ' || field || ']' ELSE '' END || ': ' || message] FROM i
  UNION ALL SELECT session_id, 4, 0, '', [{_RULE}, '## Key Loan Fields', '', '| Field | Value |', '|---|---|'] FROM o
  UNION ALL SELECT session_id, 5, 0, name, ['| ' || title || ' | ' || value || ' |'] FROM m JOIN ti USING (name) WHERE value IS NOT NULL
  UNION ALL SELECT session_id, 6, k, '', ['| ' || title || ' | ⚠ Not found |'] FROM m JOIN ti USING (name) WHERE value IS NULL
  UNION ALL SELECT session_id, 7, 0, '', [{_RULE}, '## All Form Fields', '', '| Page | Field | Value | Notes |', '|---|---|---|---|'] FROM o
  UNION ALL SELECT session_id, 8, page, key, ['| ' || page || ' | ' || key || ' | ' || CASE WHEN value = '' THEN '_empty_' ELSE value END || ' | '
    || concat_ws(', ', CASE WHEN is_truncated THEN '⚠ truncated' END, 'normalised from `' || original_value || '`') || ' |'] FROM d
  UNION ALL SELECT session_id, 9, 0, '', [{_RULE}] FROM o
  UNION ALL SELECT session_id, 10, 0, '', ['## Tables', '', '### Table 1 — Page 1 (' || rows || ' rows × ' || cols || ' cols)', '', coalesce(body, '_No cell content extracted._'), '', '---', ''] FROM sz LEFT JOIN tb USING (session_id)
  UNION ALL SELECT session_id, 11, 0, '', ['## Full Text', ''] FROM o
  UNION ALL SELECT session_id, 12, page_number, '', ['### Page ' || page_number || CASE WHEN has_handwriting THEN ' _(contains handwriting)_' ELSE '' END || ' — confidence: ' || printf('%.1f', avg_confidence) || '%', '', 'Page ' || page_number, ''] FROM p
), md AS (SELECT session_id, array_to_string(flatten(list(l ORDER BY c, a, b)), chr(10)) AS t FROM ls GROUP BY session_id)
SELECT session_id, md5(t) AS digest, length(t)::INT AS n_chars FROM md"""
_SHORT = "text"
for _word, _form in derive.SHORT_FORMS:
    _SHORT = f"replace({_SHORT}, ' {_word} ', ' {_form} ')"
_FORM = r"regexp_replace(regexp_replace(lower({}), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.]+$', '', 'g'), '\.$', '')"
_BARE = r"regexp_replace(lower({}), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.]+$', '', 'g')"


def _term(k: str, m: str, q: str) -> str:
    return f"CASE WHEN {q} <= 0 OR {q} >= 1 THEN 0 ELSE ({k}) * ln({q}) + ({m}) * ln(1 - {q}) END"


ABBREVIATIONS = rf"""dt AS (SELECT doc_id, {_SHORT} AS text FROM documents),
wl AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM dt),
wd AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM wl),
wf AS (SELECT doc_id, pos, {_FORM.format('word')} AS form, {_BARE.format('word')} LIKE '%.' AS stop, regexp_matches(word, '[.!?]$') AS ends FROM wd),
tot AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE stop) / count(*)::DOUBLE AS p FROM wf),
ac AS (SELECT form, count(*) FILTER (WHERE stop) AS n_with, count(*) FILTER (WHERE NOT stop) AS n_without, length(form) - length(replace(form, '.', '')) AS inner_stops FROM wf GROUP BY form),
ar AS (SELECT form, n_with, n_without, -2 * (n_with * ln(p) + n_without * ln(1 - p) - n_with * ln(0.99::DOUBLE) - n_without * ln(1 - 0.99::DOUBLE))
  * exp(-(length(form) - inner_stops)::DOUBLE) * (inner_stops + 1) * pow((length(form) - inner_stops)::DOUBLE, -n_without::DOUBLE) AS raw
  FROM ac, tot WHERE n_with > 0 AND regexp_matches(form, '\p{{L}}')),
ab AS (SELECT form, n_with, n_without, printf('%.2f', raw)::DOUBLE AS score, raw >= 0.3 AS is_abbreviation FROM ar)"""
STARTERS = rf"""{ABBREVIATIONS},
nx AS (SELECT *, lead(form) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM wf),
sf AS (SELECT nxt AS form, count(*) AS n_first FROM nx LEFT JOIN (SELECT form, true AS short FROM ab WHERE is_abbreviation) s USING (form)
  WHERE ends AND nxt <> '' AND (NOT stop OR (short IS NULL AND NOT regexp_matches(form, '^\p{{L}}$'))) GROUP BY nxt),
sb AS (SELECT form, n, n_first, n::DOUBLE AS b, n_first::DOUBLE AS k, (SELECT sum(n_first) FROM sf)::DOUBLE AS a, (SELECT n FROM tot) AS t FROM sf JOIN (SELECT form, count(*) AS n FROM wf GROUP BY form) USING (form)
  WHERE regexp_matches(form, '\p{{L}}')),
sr AS (SELECT form, n, n_first, a, b, k, t, -2 * ({_term('k', 'a - k', '(b / t)')} + {_term('b - k', 't - a - b + k', '(b / t)')} - {_term('k', 'a - k', '(k / a)')} - {_term('b - k', 't - a - b + k', '((b - k) / (t - a))')}) AS raw FROM sb),
st AS (SELECT form, n, n_first, printf('%.2f', raw)::DOUBLE AS score FROM sr WHERE k * t > b * a AND raw >= 30)"""
LEARNED = rf"""{STARTERS},
pc AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS piece FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '\s+', '', 'g') <> '') AS s FROM dt)),
pl AS (SELECT *, regexp_extract(piece, '(\S+)\s*$', 1) AS last, lead(regexp_extract(piece, '^\s*(\S+)', 1)) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM pc),
pf AS (SELECT *, {_FORM.format('last')} AS form, {_FORM.format('nxt')} AS next_form, regexp_matches(nxt, '^[^\p{{L}}\p{{N}}]*\p{{Ll}}') AS small FROM pl),
pg AS (SELECT pf.*, last LIKE '%.' AND CASE WHEN ab.form IS NOT NULL OR regexp_matches(pf.form, '^\p{{L}}$') THEN st.form IS NULL OR small ELSE regexp_matches(pf.form, '^\p{{N}}+$') AND small END AS goes_on
  FROM pf LEFT JOIN (SELECT form FROM ab WHERE is_abbreviation) ab ON ab.form = pf.form LEFT JOIN st ON st.form = pf.next_form),
ps AS (SELECT *, coalesce(sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM pg),
pj AS (SELECT doc_id, sentence, string_agg(piece, ' ' ORDER BY pos) AS text FROM ps GROUP BY doc_id, sentence)"""

#: Token chunks by jumps from chunk to chunk: a chunk of first sentence a ends before sentence i, p being the running word counts from 0.
TOKEN_CHUNKS = rf"""WITH RECURSIVE {SENTENCES},
sn AS (SELECT doc_id, s, list_transform(s, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> ''))) AS n FROM st WHERE len(s) > 0),
sp AS (SELECT doc_id, s, len(s) AS c, list_prepend(0::BIGINT, list_transform(range(1, len(n) + 1), lambda k: list_sum(n[1:k])::BIGINT)) AS p FROM sn),
ju AS (
  SELECT doc_id, s, c, p, 0 AS chunk_id, 1::BIGINT AS a, least(c + 1, greatest(len(list_filter(p, lambda x: x <= 400)), 2)) AS i FROM sp
  UNION ALL SELECT doc_id, s, c, p, chunk_id + 1, b, least(c + 1, greatest(len(list_filter(p, lambda x: x <= 400 + p[b])), i + 1))
  FROM (SELECT *, CASE WHEN p[i + 1] - p[t] > 400 THEN i ELSE t END AS b
    FROM (SELECT *, greatest(len(list_filter(p, lambda x: x < p[i] - 80)) + 1, a) AS t FROM ju WHERE i <= c))
)"""

ORACLE: dict[str, str] = {
    "clean_numbers": f"WITH {CLEANED} SELECT session_id, ord, value AS cleaned, original_value FROM t",
    "truncation_flags": f"WITH {CLEANED} SELECT session_id, ord, dated OR lettered AS flag, dated AS strict_flag FROM t",
    "checkbox_filter": f"WITH {DEDUPED} SELECT key, count(*) AS n FROM b GROUP BY key",
    "field_dedup": f"WITH {DEDUPED} SELECT * FROM d",
    "required_fields": f"WITH {REPORTS} SELECT session_id, name, value FROM m WHERE value IS NOT NULL",
    "missing_fields": f"WITH {REPORTS} SELECT session_id, name FROM m WHERE value IS NULL",
    "cleaning_notes": f"""WITH {REPORTS}, n1 AS (SELECT session_id, sum(lines_removed) AS g FROM p GROUP BY session_id),
n2 AS (SELECT session_id, count(*) FILTER (WHERE is_truncated) AS c, string_agg(key || ' (p' || page || ')', ', ' ORDER BY page, key) FILTER (WHERE is_truncated) AS names,
  count(original_value) AS ch FROM d GROUP BY session_id)
SELECT session_id, concat_ws('|', CASE WHEN g > 0 THEN 'Removed ' || g || ' repeated header/footer lines across all pages.' END,
  CASE WHEN c > 0 THEN c || ' field(s) appear truncated: ' || names END,
  CASE WHEN ch > 0 THEN ch || ' field value(s) normalised (number spacing, digit-letter concat).' END) AS notes FROM o LEFT JOIN n1 USING (session_id) LEFT JOIN n2 USING (session_id)""",
    "issue_rollup": f"WITH {ISSUES} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY c, a, b)::INT AS issue_seq, severity, code, message, page, field FROM i",
    "report_passed": f"""WITH {ISSUES}, e AS (SELECT session_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM i GROUP BY session_id),
fm AS (SELECT session_id, count(value) AS found FROM m GROUP BY session_id)
SELECT session_id, coalesce(errors, 0) = 0 AS passed, overall AS overall_avg_confidence, coalesce(array_to_string(hw, ','), '') AS handwriting_pages,
  CASE WHEN coalesce(errors, 0) = 0 THEN 'PASS' ELSE 'FAIL' END || ' | confidence=' || printf('%.1f', overall) || '% | errors=' || coalesce(errors, 0) || ' warnings=' || coalesce(warnings, 0)
  || ' | required_fields=' || found || '/10' AS summary FROM o LEFT JOIN e USING (session_id) JOIN fm USING (session_id) LEFT JOIN h USING (session_id)""",
    "run_summary": f"""WITH {ISSUES} SELECT (SELECT count(*) FROM f) AS fields_before, (SELECT sum(total_pages) FROM o)::BIGINT AS pages, (SELECT count(*) FROM d) AS fields_after,
  (SELECT count(*) FROM o WHERE {derive.HAS_TABLE}) AS tables,
  (SELECT count(*) FROM i WHERE severity = 'error') AS errors, (SELECT count(value) FROM m) AS found, (SELECT count(*) FROM m) AS required""",
    "form_graph": rf"""WITH {FIELDS} SELECT session_id, ord, key, trim(value || ' INR') AS value, printf('%.2f', 90.005::DOUBLE)::DOUBLE AS key_confidence,
  printf('%.2f', value_confidence)::DOUBLE AS value_confidence, page FROM f""",
    "grid_dense": f"WITH {CLEANED}, {_grids('t', 'value')} SELECT * FROM gr",
    "table_cells": f"WITH {FIELDS} SELECT session_id, 8::BIGINT AS table_ord, 1 AS page, ord::INT AS pos, (ord % 5)::INT AS row, ((ord * 7) % 4)::INT AS col, key || ' ' || value AS text, value_confidence AS confidence FROM f WHERE {derive.HAS_TABLE}",
    "table_grids": f"WITH {FIELDS}, {_grids('f', _CELL)} SELECT session_id, 8::BIGINT AS table_ord, rows, cols, grid FROM gr",
    "full_texts": f"""WITH {PAGE_STATS}, {FIELDS}, {_grids('f', _CELL)},
pt AS (SELECT ps.session_id, page_number, text || CASE WHEN page_number = 1 AND grid IS NOT NULL THEN {_MARK} || grid ELSE '' END AS t FROM ps LEFT JOIN gr ON 'd' || substr(gr.session_id, 2) = ps.session_id),
ft AS (SELECT session_id, string_agg(t, {_BREAK} ORDER BY page_number) AS t FROM pt GROUP BY session_id)
SELECT session_id, md5(t) AS text_md5, length(t) AS n_chars FROM ft""",
    "full_text_reports": f"""WITH {REPORTS}, {_grids('t', 'value')},
pt AS (SELECT session_id, page_number, 'Page ' || page_number || CASE WHEN page_number = 1 AND grid IS NOT NULL THEN {_MARK} || grid ELSE '' END AS t FROM p LEFT JOIN gr USING (session_id)),
ft AS (SELECT session_id, string_agg(t, {_BREAK} ORDER BY page_number) AS t FROM pt GROUP BY session_id)
SELECT session_id, total_pages, (session_id IN (SELECT session_id FROM gr))::INT AS n_tables, md5(coalesce(t, '')) AS text_md5 FROM o LEFT JOIN ft USING (session_id)""",
    "table_markdown": f"""WITH {CLEANED}, ce AS (SELECT session_id, (ord % 5)::INT AS r, ((ord * 7) % 4)::INT AS c, arg_max(value, ord) AS v FROM t WHERE {derive.HAS_TABLE} GROUP BY ALL),
sz AS (SELECT session_id, max(r) AS rows, max(c) AS cols FROM ce GROUP BY session_id),
rw AS (SELECT sz.session_id, sz.cols, rr.r, '| ' || string_agg(coalesce(ce.v, ''), ' | ' ORDER BY cc.c) || ' |' AS line FROM sz, range(1, 5) rr(r), range(1, 4) cc(c)
  LEFT JOIN ce ON ce.session_id = sz.session_id AND ce.r = rr.r AND ce.c = cc.c WHERE rr.r <= sz.rows AND cc.c <= sz.cols GROUP BY ALL),
rl AS (SELECT session_id, r * 2 AS k, line FROM rw UNION ALL SELECT session_id, 3, '| ' || array_to_string(list_transform(range(cols), lambda x: '---'), ' | ') || ' |' FROM rw WHERE r = 1)
SELECT sz.session_id, md5(coalesce(string_agg(line, chr(10) ORDER BY k), '')) AS digest FROM sz LEFT JOIN rl USING (session_id) GROUP BY ALL""",
    "table_count": f"WITH {FIELDS} SELECT session_id, 2::BIGINT AS n_tables FROM f WHERE {derive.HAS_TABLE} GROUP BY session_id",
    "fields_sorted": f"WITH {FIELDS} SELECT session_id, md5(string_agg(concat_ws('=', page, key, value), ';' ORDER BY page, key, value)) AS digest FROM f GROUP BY session_id",
    "page_stats": f"WITH {PAGE_STATS} SELECT session_id, page_number, md5(text) AS text_md5, word_count, avg_confidence, low_confidence_words, has_handwriting FROM ps",
    "doc_confidence": f"""WITH {PAGE_STATS} SELECT session_id, md5(string_agg(text, chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10) ORDER BY page_number)) AS text_md5, count(*) AS total_pages,
  CASE WHEN sum(word_count) > 0 THEN printf('%.2f', sum(avg_confidence::DECIMAL(18, 6) * word_count)::DOUBLE / sum(word_count))::DOUBLE ELSE 0.0 END AS overall_avg_confidence,
  bool_or(has_handwriting) AS has_handwriting FROM ps GROUP BY session_id""",
    "marked_text": f"""WITH {PAGE_STATS}, mt AS (SELECT session_id, string_agg('=== PAGE ' || page_number || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY page_number) AS t FROM ps GROUP BY session_id)
SELECT session_id, md5(t) AS text_md5, length(t) AS n_chars FROM mt""",
    "block_histogram": f"WITH {BLOCKS} SELECT 'LINE' AS block_type, count(*) AS n_blocks FROM l UNION ALL SELECT CASE WHEN unknown THEN 'UNKNOWN' ELSE 'WORD' END, count(*) FROM w GROUP BY 1",
    "page_profile": f"""WITH {BLOCKS} SELECT session_id, page AS page_number, count(*) AS word_count, printf('%.1f', sum(confidence::DECIMAL(18, 6))::DOUBLE / count(*))::DOUBLE AS avg_confidence,
  count(*) FILTER (WHERE hand) AS handwritten_words, coalesce(array_to_string((list(text ORDER BY ord) FILTER (WHERE hand))[1:5], ' '), '') AS handwriting_sample
  FROM w WHERE NOT unknown GROUP BY ALL""",
    "header_strip": rf"""WITH {ARTEFACTS}, y AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM x),
z AS (SELECT doc_id, ls, list_filter(ls, lambda s: NOT (trim(s) = 'S' OR lower(trim(s)) IN ('shinhan bank', 'india') OR starts_with(lower(trim(s)), 'extend your financial network'))) AS k FROM y)
SELECT doc_id, md5({_STRIP.format("array_to_string(k, chr(10))")}) AS text_md5, len(ls) - len(k) AS lines_removed FROM z""",
    "repeated_lines": f"WITH {_repeated('documents')} SELECT doc_id, own AS line, n FROM often",
    "strip_repeated": f"WITH {_repeated('documents')} SELECT doc_id, md5(text) AS text_md5 FROM stripped",
    "whitespace_norm": _changed(_COLLAPSE.format("text")),
    "dehyphenate": _changed(_HYPHENS.format("text")),
    "smart_chars": _changed(_SMART.format("text")),
    "page_markers": _changed(_MARKERS.format("text")),
    "clean_chain": f"WITH {ARTEFACTS}, {_repeated('x')}, {_PROSE}, y AS (SELECT doc_id, {_MARKERS.format('t')} AS t FROM zr) SELECT doc_id, md5(t) AS text_md5, length(t) AS n FROM y",
    "cleaning_counters": f"""WITH {ARTEFACTS}, {_repeated('x')}, {_PROSE}, y AS (SELECT doc_id, {_MARKERS.format('t')} AS t FROM zr)
SELECT 0::INT AS seq, 'input' AS stage, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM x UNION ALL SELECT 1, 'repeated_lines', count(*), sum(length(text))::BIGINT FROM stripped
UNION ALL SELECT 2, 'marks', count(*), sum(length(t))::BIGINT FROM z UNION ALL SELECT 3, 'table_prose', count(*), sum(length(t))::BIGINT FROM zr UNION ALL SELECT 4, 'page_markers', count(*), sum(length(t))::BIGINT FROM y""",
    "table_lines": f"""WITH {ARTEFACTS} SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda s: length(s) - length(replace(s, '|', '')) >= 2 OR len(string_split(s, chr(9))) >= 3)) AS n_table_lines FROM x""",
    "gibberish_ratio": f"SELECT doc_id, {_ODD} AS ratio FROM documents",
    "document_gate": rf"""WITH g AS (SELECT doc_id, length({_STRIP.format('text')}) AS char_count, {_ODD} AS gibberish_ratio, doc_id % 7 AS page_count, lang,
  list_filter([{', '.join(map(_text, LOAN_KEYWORDS))}], lambda k: contains(lower(text), k)) AS kw FROM documents)
SELECT doc_id, char_count, gibberish_ratio, array_to_string(kw, ',') AS keywords,
  concat_ws(',', CASE WHEN char_count < 500 THEN 'too_short' END, CASE WHEN gibberish_ratio > 0.35 THEN 'garbled' END, CASE WHEN page_count = 0 THEN 'no_pages' END) AS errors,
  concat_ws(',', CASE WHEN len(kw) < 2 THEN 'not_a_loan' END, CASE WHEN lang <> 'en' THEN 'language:' || lang END) AS warnings,
  NOT (char_count < 500 OR gibberish_ratio > 0.35 OR page_count = 0) AS passed FROM g""",
    "language_sample": "SELECT lang, count(*) AS n, sum(length(substr(text, 1, 2000)))::BIGINT AS sampled_chars FROM documents GROUP BY lang",
    "sentence_chunks": f"WITH {_chunks(4, 2)} SELECT doc_id, chunk_id, md5(text) AS text_md5, n_sentences FROM ck",
    "long_chunks": rf"WITH {_chunks(4, 2)}, n AS (SELECT doc_id, chunk_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS tokens FROM ck) SELECT * FROM n WHERE tokens >= 50",
    "token_chunks": f"""{TOKEN_CHUNKS} SELECT doc_id, chunk_id, md5(array_to_string(s[a:i - 1], ' ')) AS text_md5, p[i] - p[a] AS token_count FROM ju WHERE p[i] - p[a] >= 50""",
    "prompt_log": f"""WITH {_hits()}, n AS (SELECT query_id, sum(length(text))::BIGINT AS context_chars, count(*) AS chunks_included, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::BIGINT AS k FROM bu GROUP BY query_id)
SELECT query_id, 100 + k AS prompt_tokens, 'retrieval' AS intent, {_VARIANT.format('query_id')} AS variant, context_chars, chunks_included FROM n""",
    "once_per_question": f"WITH {QUESTIONS} SELECT DISTINCT md5(conv_id::VARCHAR || ':' || q) AS key FROM it",
    "chunk_offsets": f"WITH {OFFSETS} SELECT doc_id, chunk_id, char_start, char_start + length(text) AS char_end FROM co",
    "chunk_page_ref": f"""WITH {OFFSETS}, pg AS (SELECT doc_id, unnest(range(0, length(text) + 1, 1500)) AS page_start FROM documents)
SELECT co.doc_id, chunk_id, char_start, (page_start / 1500)::INT + 1 AS page_ref FROM co ASOF JOIN pg ON co.doc_id = pg.doc_id AND co.char_start >= pg.page_start""",
    "vector_topk": f"WITH {_hits()} SELECT query_id, session_id, rank, chunk_id, score FROM ht",
    "threshold_hits": f"WITH {_hits()} SELECT query_id, rank, chunk_id, score FROM ht WHERE score >= 0.25",
    "no_hit_answer": f"""WITH {_hits()}, n AS (SELECT query_id, count(*) AS n FROM ht WHERE score >= 0.25 GROUP BY query_id)
SELECT chunk_id AS query_id, coalesce(n, 0) AS chunks_used, CASE WHEN n IS NULL THEN {_text(retrieve.NOT_FOUND)} END AS answer,
  CASE WHEN n IS NULL THEN 'unknown' ELSE 'retrieval' END AS intent FROM vc LEFT JOIN n ON n.query_id = vc.chunk_id""",
    "context_budget": f"WITH {_hits()} SELECT query_id, rank, chunk_id, used_chars FROM bu",
    "context_format": f"""WITH {_hits()} SELECT query_id, md5(string_agg('[Source ' || rank || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS labelled_md5,
  md5(string_agg(text, chr(10) || chr(10) ORDER BY rank)) AS raw_md5, sum(length(text))::BIGINT AS context_chars, count(*) AS chunks_included FROM bu GROUP BY query_id""",
    "unit_vectors": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings)
SELECT vec_id AS chunk_id, printf('%.6f', list_sum(list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))))::DOUBLE AS total FROM v""",
    "prompt_trim": rf"""WITH {_hits(8)}, n AS (SELECT query_id, rank, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS k FROM tx),
s AS (SELECT query_id, rank, 100 + sum(k) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS prompt_tokens FROM n) SELECT * FROM s WHERE prompt_tokens <= 1500""",
    "intent_counts": f"WITH {QUESTIONS} SELECT intent, count(*) AS n FROM it GROUP BY intent",
    "variant_split": f"WITH {RUNS} SELECT DISTINCT user_id, variant FROM ru",
    "prompt_build": rf"""WITH {QUESTIONS}, tp(intent, v, t) AS (VALUES {_TEMPLATES}),
pr AS (SELECT conv_id, turn, it.intent, variant, replace(replace(t, '{{context}}', 'excerpt ' || turn), '{{question}}', question) AS p
  FROM it JOIN tp ON tp.intent = it.intent AND tp.v = CASE WHEN it.intent = 'finance' THEN variant ELSE 'A' END)
SELECT conv_id, turn, intent, variant, md5(p) AS prompt_md5, len(list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '')) AS prompt_tokens, 'v1' AS template_version FROM pr""",
    "cache_keys": f"WITH {QUESTIONS} SELECT DISTINCT md5(conv_id::VARCHAR || ':' || q) AS key FROM it",
    "ab_summary": f"""WITH {RUNS} SELECT variant, intent, printf('%.3f', {_MEAN})::DOUBLE AS composite_mean, printf('%.3f', stddev_samp(composite))::DOUBLE AS composite_std, count(*) AS n,
  printf('%.3f', sum(latency::DECIMAL(28, 12))::DOUBLE / count(*))::DOUBLE AS latency_mean, printf('%.3f', sum(cost::DECIMAL(28, 12))::DOUBLE)::DOUBLE AS cost_sum FROM ru GROUP BY ALL""",
    "ab_variant_means": f"WITH {RUNS} SELECT variant, printf('%.6f', {_MEAN})::DOUBLE AS mean, count(*) AS n FROM ru WHERE intent = 'click' GROUP BY variant",
    "ab_decision": f"""WITH {RUNS}, a AS (SELECT intent, avg(composite) FILTER (WHERE variant = 'A') AS ma, avg(composite) FILTER (WHERE variant = 'B') AS mb,
  count(*) FILTER (WHERE variant = 'A') AS n_a, count(*) FILTER (WHERE variant = 'B') AS n_b FROM ru GROUP BY intent),
d AS (SELECT *, coalesce(n_a >= 50 AND n_b >= 50 AND abs(ma - mb) >= 0.05, false) AS done FROM a)
SELECT intent, n_a, n_b, CASE WHEN done THEN 'conclude' WHEN n_a + n_b >= 200 THEN 'equivalent' ELSE 'continue' END AS decision,
  CASE WHEN done AND ma < mb THEN 'B' WHEN n_a + n_b >= 200 OR done THEN 'A' END AS winner FROM d""",
    "spend": f"WITH {RUNS} SELECT printf('%.4f', sum(cost::DECIMAL(28, 12))::DOUBLE)::DOUBLE AS spend, count(*) AS n_runs FROM ru",
    "variant_params": f"WITH {RUNS} SELECT variant, CASE variant WHEN 'A' THEN 5 ELSE 8 END AS k, CASE variant WHEN 'A' THEN 'labelled' ELSE 'raw' END AS context_format, count(*) AS n FROM ru GROUP BY ALL",
    "run_metrics": f"WITH {RUNS} SELECT run_id, latency + 890 AS total_latency, printf('%.6f', cost)::DOUBLE AS cost, printf('%.6f', composite)::DOUBLE AS composite FROM ru",
    "judge_scores": f"WITH {RUNS} SELECT run_id, CASE WHEN run_id % 5 <> 0 THEN faithfulness END AS score FROM ru",
    "sse_deltas": "SELECT conv_id, turn, CASE WHEN turn % 5 = 4 OR turn % 7 = 3 THEN NULL ELSE role END AS delta FROM conversations",
    "session_ids": "SELECT event_id, '2025-' || lpad((event_id % 12 + 1)::VARCHAR, 2, '0') || '-15 14:23:05' AS started FROM events",
    "batch_order": f"""WITH RECURSIVE b AS ({derive.BATCHES.format(events="events")}), k AS (
  SELECT job_id, request_token, min(batch) AS batch, arg_min(coalesce(next_token, ''), batch) AS next_token FROM b GROUP BY job_id, request_token
), c AS (
  SELECT job_id, batch, next_token, CAST(0 AS BIGINT) AS no FROM k WHERE request_token IS NULL
  UNION ALL SELECT k.job_id, k.batch, k.next_token, no + 1 FROM c JOIN k ON k.job_id = c.job_id AND k.request_token = c.next_token
), j AS (
  SELECT job_id, count(*) AS n, count(no) AS reached, arg_max(k.next_token, no) AS tail FROM k LEFT JOIN c USING (job_id, batch) GROUP BY job_id
)
SELECT b.job_id, b.batch, no AS batch_no, CASE WHEN k.batch IS NULL THEN 'repeat' WHEN reached < n THEN 'gap' WHEN tail <> '' THEN 'open' ELSE 'whole' END AS job_state
FROM b JOIN j USING (job_id) LEFT JOIN k USING (job_id, batch) LEFT JOIN c USING (job_id, batch)""",
    "job_outcomes": f"""WITH r AS ({derive.RESPONSES.format(events="events")}), s AS (
  SELECT *, min(asked_s) OVER (PARTITION BY job_id) + 600 AS limit_s, max(asked_s) OVER () AS now_s,
    coalesce(sum(CAST(substr(next_token, 2) AS INT)) OVER w, 0) AS named, coalesce(sum(CAST(substr(request_token, 2) AS INT)) OVER w, 0) AS fetched, count(*) FILTER (WHERE status = 'SUCCEEDED' AND request_token IS NULL) OVER w AS firsts,
    count(*) FILTER (WHERE status = 'SUCCEEDED' AND next_token IS NULL) OVER w AS lasts, count(*) FILTER (WHERE status = 'SUCCEEDED') OVER w AS n_batches,
    count(*) FILTER (WHERE request_token IS NULL) OVER w AS attempts
  FROM r WINDOW w AS (PARTITION BY job_id ORDER BY asked_s)
), e AS (
  SELECT *, CASE WHEN status = 'FAILED' THEN 'FAILED' WHEN firsts = 1 AND lasts = 1 AND named = fetched THEN 'SUCCEEDED' END AS outcome FROM s WHERE asked_s <= limit_s
), f AS (
  SELECT job_id, min(asked_s) AS ended_s, arg_min(outcome, asked_s) AS outcome, arg_min(attempts, asked_s) AS attempts, arg_min(n_batches, asked_s) AS n_batches
  FROM e WHERE outcome IS NOT NULL GROUP BY job_id
), t AS (
  SELECT job_id, max(limit_s) AS limit_s, max(now_s) AS now_s, max(attempts) AS attempts, max(n_batches) AS n_batches FROM e GROUP BY job_id
)
SELECT job_id, coalesce(f.outcome, 'TIMED_OUT') AS outcome, coalesce(f.attempts, t.attempts) AS attempts, coalesce(f.n_batches, t.n_batches) AS n_batches,
  CAST(1000 * coalesce(ended_s, limit_s) AS BIGINT) AS ended_ms FROM t LEFT JOIN f USING (job_id) WHERE f.outcome IS NOT NULL OR limit_s < now_s""",
    "session_status": f"""WITH c AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS pos FROM ({derive.CHANGES.format(events="events")})),
a AS (SELECT session_id, count(*) AS n, min(pos) FILTER (WHERE status = 'UPLOADING') AS t1 FROM c GROUP BY session_id),
b AS (SELECT session_id, min(pos) AS t2 FROM c JOIN a USING (session_id) WHERE status = 'PROCESSING' AND pos > t1 GROUP BY session_id),
d AS (SELECT session_id, min(pos) AS t3 FROM c JOIN b USING (session_id) WHERE status IN ('READY', 'FAILED') AND pos > t2 GROUP BY session_id),
f AS (SELECT a.session_id, n, coalesce(t3, t2, t1) AS last, CAST((t1 IS NOT NULL)::INT + (t2 IS NOT NULL)::INT + (t3 IS NOT NULL)::INT AS BIGINT) AS n_changes FROM a LEFT JOIN b USING (session_id) LEFT JOIN d USING (session_id))
SELECT f.session_id, c.status, c.event_id AS since, n_changes, n - n_changes AS n_refused FROM f LEFT JOIN c ON c.pos = f.last""",
    "ab_running": f"""WITH {RUNS}, sl AS (SELECT *, (run_id - min(run_id) OVER ()) // ((max(run_id) OVER () - min(run_id) OVER ()) // 3 + 1) AS slice FROM ru),
a AS (SELECT k AS trigger, intent, avg(composite) FILTER (WHERE variant = 'A') AS ma, avg(composite) FILTER (WHERE variant = 'B') AS mb,
  count(*) FILTER (WHERE variant = 'A') AS n_a, count(*) FILTER (WHERE variant = 'B') AS n_b FROM sl, (SELECT unnest([0, 1, 2]) AS k) WHERE slice <= k GROUP BY k, intent),
d AS (SELECT *, coalesce(n_a >= 50 AND n_b >= 50 AND abs(ma - mb) >= 0.05, false) AS done FROM a),
o AS (SELECT CAST(trigger AS BIGINT) AS trigger, intent, n_a, n_b, CASE WHEN done THEN 'conclude' WHEN n_a + n_b >= 200 THEN 'equivalent' ELSE 'continue' END AS decision,
  CASE WHEN done AND ma < mb THEN 'B' WHEN n_a + n_b >= 200 OR done THEN 'A' END AS winner FROM d)
SELECT *, min(trigger) FILTER (WHERE decision <> 'continue') OVER (PARTITION BY intent) AS stopped_at FROM o""",
    "abbreviations": f"WITH {ABBREVIATIONS} SELECT form, n_with, n_without, score, is_abbreviation FROM ab",
    "sentence_starters": f"WITH {STARTERS} SELECT form, n, n_first, score FROM st",
    "learned_sentences": f"WITH {LEARNED} SELECT doc_id, CAST(count(*) AS INTEGER) AS n_sentences, md5(string_agg(text, '|' ORDER BY sentence)) AS text_md5 FROM pj GROUP BY doc_id",
    "table_prose": rf"""WITH dt AS ({derive.TABLES.format(documents="documents")}),
ln AS (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM dt)),
ki AS (SELECT *, CASE WHEN length(t) - length(replace(t, '|', '')) >= 2 THEN 'bar' WHEN len(string_split(t, chr(9))) >= 3 THEN 'tab' WHEN regexp_matches(t, '\S {{2,}}\S') THEN 'gap' END AS kind FROM ln),
nw AS (SELECT *, CAST(kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY line) OR line = 0 AS INT) AS n FROM ki),
ru AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM nw),
gr AS (SELECT doc_id, run, min(line) AS first FROM ru WHERE kind IS NOT NULL GROUP BY doc_id, run HAVING count(*) > 1),
px AS (SELECT DISTINCT doc_id, run, p FROM (SELECT doc_id, run, t, unnest(range(1, length(t) + 1)) AS p FROM ru JOIN gr USING (doc_id, run) WHERE kind = 'gap') WHERE substr(t, p, 1) <> ' '),
ps AS (SELECT *, p - lag(p) OVER (PARTITION BY doc_id, run ORDER BY p) AS d FROM px),
st AS (SELECT doc_id, run, list(p ORDER BY p) AS starts FROM ps WHERE d IS NULL OR d > 2 GROUP BY doc_id, run),
ce AS (SELECT doc_id, run, line, first, regexp_matches(t, '^[\s|:+-]*-[\s|:+-]*$') AS rule, CASE kind WHEN 'bar' THEN list_transform(string_split(regexp_replace(trim(t), '^\||\|$', '', 'g'), '|'), lambda c: trim(c))
  WHEN 'tab' THEN list_transform(string_split(t, chr(9)), lambda c: trim(c)) ELSE list_transform(range(1, len(starts) + 1), lambda i: trim(substr(t, starts[i], coalesce(starts[i + 1], length(t) + 1) - starts[i]))) END AS cells
  FROM ru JOIN gr USING (doc_id, run) LEFT JOIN st USING (doc_id, run)),
he AS (SELECT *, first_value(cells) OVER w AS head, first_value(rule) OVER w AS ruled FROM ce WINDOW w AS (PARTITION BY doc_id, run ORDER BY line)),
ok AS (SELECT doc_id, run FROM he GROUP BY doc_id, run HAVING bool_and(rule OR len(cells) = len(head)) AND max(len(head)) > 1 AND NOT bool_or(ruled) AND count(*) FILTER (WHERE NOT rule) > 1),
sa AS (SELECT doc_id, line, CASE WHEN line > first AND NOT rule THEN 'Details: ' || array_to_string(list_filter(list_transform(range(1, len(head) + 1), lambda i: trim(head[i] || ' ' || cells[i])), lambda x: x <> ''), ', ') || '.' END AS said FROM he JOIN ok USING (doc_id, run)),
al AS (SELECT ln.doc_id, ln.line, CASE WHEN sa.doc_id IS NULL THEN t ELSE said END AS t, said FROM ln LEFT JOIN sa USING (doc_id, line))
SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY line) FILTER (WHERE t IS NOT NULL)) AS text_md5, count(said) AS n_rows FROM al GROUP BY doc_id""",
    "index_topk": """WITH v AS (SELECT vec_id, 'w' || (vec_id // 512) AS session_id, embedding::DOUBLE[] AS q, list_transform(embedding::DOUBLE[], lambda x: x / pow(2::DOUBLE, vec_id % 5)) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, a.session_id, b.vec_id AS chunk_id, list_inner_product(a.q, b.e) AS score FROM v a JOIN v b USING (session_id))
SELECT query_id, session_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, chunk_id, score FROM s QUALIFY rank <= 5""",
    "index_skips": """WITH v AS (SELECT vec_id, 'w' || (vec_id // 512) AS session_id, embedding::DOUBLE[] AS q, list_transform(embedding::DOUBLE[], lambda x: x / pow(2::DOUBLE, vec_id % 5)) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_inner_product(e, e)) AS l, sqrt(list_inner_product(q, q)) AS m FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY l DESC, vec_id) - 1 AS pos FROM n),
b AS (SELECT session_id, pos // 16 AS block_no, max(l) AS reach FROM r GROUP BY ALL),
f AS (SELECT a.vec_id AS query_id, list_inner_product(a.q, r.e) AS score FROM n a JOIN r ON r.session_id = a.session_id AND r.pos < 48),
t AS (SELECT query_id, min(score) AS least FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS k FROM f) WHERE k <= 5 GROUP BY query_id)
SELECT n.vec_id AS query_id, count(*) AS blocks, count(*) FILTER (WHERE block_no > 2 AND reach * m * (1 + 1e-9::DOUBLE) + 1e-9::DOUBLE < least) AS blocks_skipped
FROM n JOIN b USING (session_id) JOIN t ON t.query_id = n.vec_id GROUP BY n.vec_id""",
    "cached_answers": f"""WITH a AS ({derive.ASKED.format(conversations="conversations")})
SELECT session_id, turn, md5(session_id || ':' || lower(question)) AS key, row_number() OVER (PARTITION BY session_id, turn // 3, question ORDER BY turn) > 1 AS hit FROM a""",
    "object_listing": "SELECT 'extracted/s' || s_suppkey || '/raw_text.txt' AS key, CASE WHEN s_suppkey % 5 > 0 THEN strlen(s_name) ELSE 0 END AS length FROM supplier",
    "session_latest_status": "SELECT user_id AS session_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id",
    "sessions_recent": "WITH m AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id) SELECT * FROM m ORDER BY event_id DESC LIMIT 20",
    "stream_event_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "object_keys": "SELECT 'c' || c_custkey AS session_id, "
    + ", ".join(f"replace({_text(v)}, '{{}}', 'c' || c_custkey) AS {k}" for k, v in KEYS.items())
    + ", 's3://docs/extracted/c' || c_custkey || '/raw_text.txt' AS uri FROM customer",
    "extract_route": "SELECT CASE WHEN p_size % 4 < 2 THEN 'sync' ELSE 'async' END AS route, count(*) AS n FROM part GROUP BY 1",
    "missing_sessions": "SELECT doc_id AS session_id FROM documents ANTI JOIN labels USING (doc_id)",
    "json_records": """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS json FROM nation""",
}
ORACLE["ab_running_summary"] = ORACLE["ab_summary"]  # the same rows, from the state of a stream
ORACLE["markdown_report"] = MARKDOWN

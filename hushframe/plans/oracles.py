"""SQL for DuckDB that gives the rows of `queries`, written from the rules of each operator."""

from __future__ import annotations

from hushframe.plans.inputs import KINDS
from hushframe.plans.queries import SALT
from hushframe.sources.rules import RULES


# Fixed values, written out here too, so that the SQL doesn't rest on the tables that it tests.
TAX = """tax(ord, category, l1, label, kind) AS (VALUES
(0, 'primary_subject_name', 'person', 'Person', 'text'),
(1, 'other_person_name', 'person', 'Person', 'text'),
(2, 'gender', 'person', 'Gender', 'text'),
(3, 'age', 'person', 'Age', 'text'),
(4, 'religion_ethnicity_cast', 'person', 'Community', 'text'),
(5, 'sexual_orientation', 'person', 'Orientation', 'text'),
(6, 'blood_type', 'person', 'BloodType', 'text'),
(7, 'occupation_designation_education_level', 'person', 'Occupation', 'text'),
(8, 'country', 'location', 'Country', 'text'),
(9, 'state_province', 'location', 'State', 'text'),
(10, 'city_district', 'location', 'City', 'text'),
(11, 'postal_zip_pin_code', 'location', 'Postcode', 'text'),
(12, 'street_address', 'location', 'Address', 'text'),
(13, 'geocode_coordinates', 'location', 'Geocode', 'text'),
(14, 'date_of_birth', 'date_time', 'Date', 'text'),
(15, 'death_date', 'date_time', 'Date', 'text'),
(16, 'other_date_time', 'date_time', 'Date', 'text'),
(17, 'phone_mobile', 'contact', 'Phone', 'text'),
(18, 'fax', 'contact', 'Fax', 'text'),
(19, 'email', 'contact', 'Email', 'text'),
(20, 'web_url', 'contact', 'URL', 'text'),
(21, 'ssn', 'uid', 'SSN', 'text'),
(22, 'aadhaar_12_digit', 'uid', 'Aadhaar', 'text'),
(23, 'pan', 'uid', 'PAN', 'text'),
(24, 'voter_id', 'uid', 'VoterID', 'text'),
(25, 'passport_no', 'uid', 'Passport', 'text'),
(26, 'driving_licence_no', 'uid', 'DrivingLicence', 'text'),
(27, 'national_id', 'uid', 'NationalID', 'text'),
(28, 'tax_id', 'uid', 'TaxID', 'text'),
(29, 'mrn_uhid', 'uid', 'MRN', 'text'),
(30, 'health_plan_beneficiary_no', 'uid', 'HealthPlanID', 'text'),
(31, 'abha_number_14_digit', 'uid', 'ABHA', 'text'),
(32, 'abha_address', 'uid', 'ABHAAddress', 'text'),
(33, 'pmjay_ayushman_id', 'uid', 'AyushmanID', 'text'),
(34, 'practitioner_reg_no_npi_nmc', 'uid', 'PractitionerReg', 'text'),
(35, 'bank_account_number', 'uid', 'BankAccount', 'text'),
(36, 'iban', 'uid', 'IBAN', 'text'),
(37, 'upi_id', 'uid', 'UPI', 'text'),
(38, 'insurance_tpa_policy_no', 'uid', 'PolicyNo', 'text'),
(39, 'other_id', 'uid', 'ID', 'text'),
(40, 'vehicle_id_licence_plate', 'uid', 'VehicleID', 'text'),
(41, 'ip_address', 'device_net', 'IPAddress', 'text'),
(42, 'device_serial_identifier', 'device_net', 'DeviceID', 'text'),
(43, 'mac_address', 'device_net', 'MACAddress', 'text'),
(44, 'password', 'credential', 'Password', 'text'),
(45, 'api_key_token', 'credential', 'APIKey', 'text'),
(46, 'high_entropy_secret', 'credential', 'Secret', 'text'),
(47, 'brandname', 'entity', 'Brand', 'text'),
(48, 'face_photo', 'biometric_visual', 'FacePhoto', 'visual'),
(49, 'signature', 'biometric_visual', 'Signature', 'visual'),
(50, 'seal_stamp', 'biometric_visual', 'SealStamp', 'visual'),
(51, 'fingerprint_thumb_impression', 'biometric_visual', 'FingerprintThumbImpression', 'visual'),
(52, 'qr_barcode', 'biometric_visual', 'QrBarcode', 'visual'),
(53, 'logo', 'biometric_visual', 'Logo', 'visual'))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def rule_spans(source: str = "SELECT doc_id, text FROM documents") -> str:
    """sp(d, i, c, s, e, t, sc): matches of the rules."""
    hits = " UNION ALL ".join(
        f"SELECT doc_id d, '{c}' c, {s}::DOUBLE sc, regexp_split_to_array(text, '{p}') gaps, regexp_extract_all(text, '{p}') hits FROM src WHERE regexp_matches(text, '{p}')" for c, p, s in RULES
    )
    return f"""src AS ({source}), hit AS ({hits}),
each AS (SELECT d, c, sc, gaps, hits, unnest(range(1, len(hits) + 1)) k FROM hit),
ends AS (SELECT d, c, sc, hits[k] t, (list_sum(list_transform(gaps[1:k], lambda x: length(x))) + list_sum(list_transform(hits[1:k], lambda x: length(x))))::INT e FROM each),
sp AS (SELECT d, (row_number() OVER (PARTITION BY d ORDER BY e - length(t), e, c) - 1)::INT i, c, (e - length(t))::INT s, e, t, sc FROM ends)"""


MADE = f"""ck AS (SELECT doc_id d, ck, substr(text, ck * 40 + 1, 40) t FROM (SELECT doc_id, text, unnest(range((length(text) + 39) // 40)) ck FROM documents)),
sp AS (SELECT d, (ck * 5 + k)::INT i, c, (ck * 40 + s)::INT s, (ck * 40 + s + length(substr(t, s + 1, n)))::INT e, substr(t, s + 1, n) t, sc FROM (
SELECT d, k, ck, ([{", ".join(repr(k) for k in KINDS)}])[((d + k) % 3 + 1)::INT] c, ((d * 7 + k * 5) % 30)::INT s, (1 + (d + k * 3) % 8)::INT n, t,
CASE WHEN (d + k) % 5 <> 0 THEN ((d * k) % 4 + 5)::DOUBLE / 10.0::DOUBLE END sc FROM ck, range(5) r(k)) WHERE s < length(t))"""

UNION = """a AS (SELECT *, max(e) OVER (PARTITION BY d ORDER BY s, e DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM sp),
b AS (SELECT *, sum(CASE WHEN pe IS NULL OR s >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY s, e DESC, i ROWS UNBOUNDED PRECEDING) g FROM a),
u AS (SELECT d, min(s) s, max(e) e, first(c ORDER BY e - s DESC, s, i) c, first(sc ORDER BY e - s DESC, s, i) sc FROM b GROUP BY d, g)"""

MERGE = (
    UNION
    + """,
l AS (SELECT u.*, text x, lag(c) OVER w pc, lag(e) OVER w pv FROM u JOIN documents ON doc_id = d WINDOW w AS (PARTITION BY d ORDER BY s)),
n AS (SELECT *, sum(CASE WHEN pc = c AND regexp_matches(substr(x, pv + 1, s - pv), '^\\s*$') THEN 0 ELSE 1 END) OVER (PARTITION BY d ORDER BY s ROWS UNBOUNDED PRECEDING) k FROM l),
m AS (SELECT d, min(s) s, max(e) e, first(c ORDER BY s) c, CASE WHEN count(*) = count(sc) THEN min(sc) END sc, first(x) x FROM n GROUP BY d, k)"""
)


def spans_table(cte: str) -> str:
    return f"""SELECT d doc_id, (row_number() OVER (PARTITION BY d ORDER BY s) - 1)::INT span_idx, c category, s "start", e "end", l1,
substr(text, s + 1, e - s) text, sc score FROM {cte} JOIN documents ON doc_id = d JOIN tax ON category = c"""


def rebuilt(cte: str, by: str, join: str = "") -> str:
    """(doc_id, text) with the spans of cte (d, s, e, c) replaced by an expression over it, tax and value v."""
    return f""", v AS (SELECT {cte}.*, substr(text, s + 1, e - s) v FROM {cte} JOIN documents ON doc_id = d),
r AS (SELECT v.d, s, e, {by} AS r, lag(e, 1, 0) OVER (PARTITION BY v.d ORDER BY s) z FROM v JOIN tax ON category = c {join}),
j AS (SELECT d, string_agg(substr(text, z + 1, s - z) || r, '' ORDER BY s) head, max(e) e FROM r JOIN documents ON doc_id = d GROUP BY d)
SELECT doc_id, CASE WHEN d IS NULL THEN text ELSE head || substr(text, e + 1) END text FROM documents LEFT JOIN j ON doc_id = d"""


def normal(x: str) -> str:
    return f"replace(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), 'ß', 'ss')"


def general(c: str = "c", v: str = "v") -> str:
    number = f"regexp_extract({v}, '[0-9]+')"
    year = f"regexp_extract({v}, '\\b(19|20)[0-9]{{2}}\\b')"
    return f"""CASE WHEN {c} IN ('country', 'state_province') THEN {v}
WHEN {c} = 'age' THEN CASE WHEN {number} = '' THEN '[AGE]' ELSE (({number}::HUGEINT // 10) * 10)::VARCHAR || '–' || (({number}::HUGEINT // 10) * 10 + 9)::VARCHAR END
WHEN {c} IN ('date_of_birth', 'death_date', 'other_date_time') THEN CASE WHEN {year} = '' THEN '[DATE]' ELSE {year} END
WHEN {c} IN ('city_district', 'street_address', 'postal_zip_pin_code', 'geocode_coordinates') THEN '[LOCATION]'
ELSE '[' || upper(label) || ']' END"""


def occurrences(record: str) -> str:
    """o(rec, page, d, s, label, norm, orig)."""
    return f"""o AS (SELECT {record}::VARCHAR rec, doc_id page, d, s, label, substr(text, s + 1, e - s) orig, {normal("substr(text, s + 1, e - s)")} norm
FROM m JOIN documents ON doc_id = d JOIN tax ON category = c)"""


NUMBER = """f AS (SELECT rec, label, norm, first(orig ORDER BY page, s) orig, min(page * 1000000000 + s) pos FROM o GROUP BY rec, label, norm),
q AS (SELECT *, label || '_' || row_number() OVER (PARTITION BY rec, label ORDER BY pos, norm) name FROM f)"""
MAPPING = "SELECT rec record_id, label, norm norm_key, name pseudonym, orig original FROM q"
NAMES = "o AS (SELECT c_mktsegment rec, c_custkey page, c_custkey d, 0 s, 'Person' label, c_name orig, lower(c_name) norm FROM customer)"
RULED = (TAX, rule_spans(), MERGE)

TOKENS = """w AS (SELECT doc_id, string_split(text, ' ') w FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(w) v, unnest(range(len(w))) tok FROM w),
y AS (SELECT doc_id, tok, length(v) n, (sum(length(v) + 1) OVER (PARTITION BY doc_id ORDER BY tok) - 1)::INT b FROM x),
z AS (SELECT DISTINCT * FROM (SELECT *, (tok // 15)::INT ch FROM y UNION ALL SELECT *, greatest(0, CASE WHEN tok < 5 THEN 0 ELSE (tok - 5) // 15 END)::INT FROM y)),
tk AS (SELECT doc_id, ch chunk_idx, tok::INT tok_idx, (b - n)::INT char_start, b char_end,
CASE WHEN (n + ch) % 4 = 0 THEN 'O' WHEN n % 7 = 1 THEN 'B-AGE' WHEN n % 3 = 0 THEN 'I-AGE' WHEN n % 3 = 1 THEN 'B-EMAIL' ELSE 'I-EMAIL' END label,
((n * 3 + ch) % 8)::DOUBLE / 8.0::DOUBLE score FROM z),
ft AS (SELECT doc_id, char_start, char_end, first(label ORDER BY chunk_idx, tok_idx) label, first(score ORDER BY chunk_idx, tok_idx) score
FROM tk WHERE char_end > char_start GROUP BY ALL)"""
DECODE = """g1 AS (SELECT *, label = 'O' o, lower(substr(label, 3)) cat FROM ft),
g2 AS (SELECT *, lag(o, 1, true) OVER w po, lag(cat) OVER w pcat FROM g1 WINDOW w AS (PARTITION BY doc_id ORDER BY char_start, char_end)),
g3 AS (SELECT *, sum(CASE WHEN NOT o AND (label LIKE 'B%' OR po OR pcat <> cat) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY char_start, char_end ROWS UNBOUNDED PRECEDING) k FROM g2),
g4 AS (SELECT doc_id, first(cat) cat, min(char_start) a, max(char_end) b, round_even(avg(score), 4) sc FROM g3 WHERE NOT o GROUP BY doc_id, k),
g5 AS (SELECT g4.*, substr(text, a + 1, b - a) raw FROM g4 JOIN documents USING (doc_id)),
g6 AS (SELECT *, a + length(regexp_extract(raw, '^\\s*')) s, b - length(regexp_extract(raw, '\\s*$')) e FROM g5)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s, e) - 1)::INT span_idx, cat category, s::INT "start", e::INT "end", l1,
substr(raw, s - a + 1, e - s) text, sc score FROM g6 JOIN tax ON category = cat WHERE e > s"""

WORDS = """wd AS (SELECT doc_id page_id, string_split_regex(text, '[ \\n]') w FROM documents WHERE text IS NOT NULL),
we AS (SELECT page_id, greatest(200, (len(w) + 7) // 8 * 20)::INT height, unnest(w) word, unnest(range(len(w)))::INT word_idx FROM wd),
ph AS (SELECT doc_id page_id, coalesce(greatest(200, (len(w) + 7) // 8 * 20), 200)::INT height FROM documents LEFT JOIN wd ON page_id = doc_id),
wo AS (SELECT page_id, height, word_idx, word, ((word_idx % 8) * 60 + page_id % 3)::INT x0, ((word_idx // 8) * 20)::INT y0,
((word_idx % 8) * 60 + page_id % 3 + least(58, length(word) * 7))::INT x1, ((word_idx // 8) * 20 + 10 + length(word) % 5)::INT y1 FROM we WHERE word <> '')"""
ENTITIES = (
    WORDS
    + """,
te AS (SELECT page_id, word_idx ent_idx, CASE length(word) WHEN 3 THEN 'other_person_name' WHEN 5 THEN 'city_district' ELSE 'phone_mobile' END category, 'text' kind,
x0, y0, x1, y1, word text, (length(word) % 4)::DOUBLE / 4.0::DOUBLE score FROM wo WHERE length(word) IN (3, 5, 7)),
vi(ent_idx, category, x0, y0, x1, y1) AS (VALUES (0, 'logo', 100, 30, 260, 90), (1, 'signature', 300, 0, 420, 45)),
en AS (SELECT * FROM te UNION ALL SELECT doc_id, ent_idx, category, 'visual', x0, y0, x1, y1, NULL, 0.5::DOUBLE FROM documents, vi)"""
)
PAD = "SELECT * FROM (SELECT page_id, ent_idx, kind, greatest(0, x0 - p)::INT x0, greatest(0, y0 - p)::INT y0, least(480, x1 + p)::INT x1, least(height, y1 + p)::INT y1 FROM ph JOIN"


def runs(gap: float) -> str:
    return f"""li AS (SELECT page_id, (ent_idx // 8)::INT line_idx, ent_idx word_idx, category, text, x0, y0, x1, y1 FROM te),
lh AS (SELECT *, max(y1 - y0) OVER (PARTITION BY page_id, line_idx) h, lag(x1) OVER (PARTITION BY page_id, line_idx, category ORDER BY x0, word_idx) px FROM li),
lk AS (SELECT *, sum(CASE WHEN px IS NULL OR x0 - px < 0 OR x0 - px > {gap} * h THEN 1 ELSE 0 END)
OVER (PARTITION BY page_id, line_idx, category ORDER BY x0, word_idx ROWS UNBOUNDED PRECEDING) k FROM lh),
ru AS (SELECT page_id, line_idx, category, string_agg(text, ' ' ORDER BY x0, word_idx) text, first(word_idx ORDER BY x0, word_idx) first_word, count(*)::INT n,
list(y1 - y0) hs, min(x0)::INT x0, min(y0)::INT y0, max(x1)::INT x1, max(y1)::INT y1 FROM lk GROUP BY page_id, line_idx, category, k),
th AS (SELECT *, list_sort(list_filter(hs, lambda v: v >= 0.5 * list_max(hs))) kept FROM ru),
ty AS (SELECT *, kept[least(len(kept) - 1, floor(0.85 * len(kept)))::INT + 1]::INT type_height FROM th)"""


def esc(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_PIECES = """w AS (SELECT * FROM wo WHERE length(word) > 2), pc AS (SELECT page_id, word_idx, c, length(word) n FROM w, (VALUES (0), (1)) v(c)),
lb AS (SELECT page_id, word_idx, CASE WHEN n % 3 = 0 THEN 'B-age' WHEN n % 3 = 1 THEN 'I-email' ELSE 'O' END label, (n % 4 + c)::DOUBLE / 8.0::DOUBLE score FROM pc WHERE c = 0),
wl AS (SELECT page_id, word_idx, word, coalesce(label, 'O') label, score FROM wo LEFT JOIN lb USING (page_id, word_idx))"""
_PAGED = rule_spans("SELECT page_id doc_id, html AS text FROM pages")
_TALKS = rule_spans("SELECT conv_id * 1000 + turn doc_id, text FROM conversations")
_SPANS = 'SELECT d doc_id, i span_idx, c category, s "start", e "end", l1, t text, sc score FROM sp JOIN tax ON category = c'
_REPLACED = {
    "redact_default": with_(*RULED) + rebuilt("m", "'[REDACTED]'"),
    "redact_category_mask": with_(*RULED) + rebuilt("m", "'[' || c || ']'"),
    "redact_l1_mask": with_(TAX, MADE, MERGE) + rebuilt("m", "'<' || l1 || '>'"),
    "mask_without_merge": with_(TAX, MADE, UNION) + rebuilt("u", "'#'"),
    "stream_anonymize": with_(*RULED) + rebuilt("m", general()),
    "deid_hash_text": with_(*RULED) + rebuilt("m", f"label || '_' || substr(md5({normal('v')}), 1, 6)"),
}
_BOTH = (
    TAX, rule_spans().replace("sp AS (", "sr AS ("), MADE.replace("sp AS (", "sm AS ("),
    "sp AS (SELECT d, i, c, s, e, t, sc FROM sm UNION ALL SELECT d, i + 1073741824, c, s, e, t, sc FROM sr)", MERGE,
)
_COUNTER_TEXT = with_(*RULED, occurrences("source"), NUMBER) + rebuilt(
    "m", "name", f"JOIN documents dd ON dd.doc_id = v.d JOIN q ON q.rec = dd.source AND q.label = tax.label AND q.norm = {normal('v')}"
)
_CONTINUED = """f AS (SELECT rec, label, norm, first(orig ORDER BY (page >= 400), page, s) orig, bool_or(page < 400) early, min(page * 1000000000 + s) pos FROM o GROUP BY rec, label, norm),
q AS (SELECT *, label || '_' || row_number() OVER (PARTITION BY rec, label ORDER BY NOT early, pos, norm) name FROM f)"""

# which spans stay: the first, and then always the next that begins at or after the end of the last one kept; the five
# spans made in 40 characters end within them, so that this begins anew with each 40
_HIGHLIGHT = f"""WITH RECURSIVE {TAX}, {MADE},
o AS (SELECT d, s // 40 f, s, e, c, sc, row_number() OVER (PARTITION BY d, s // 40 ORDER BY s, e DESC, i) n FROM sp),
w(d, f, n, kept, z) AS (SELECT d, f, n, true, e FROM o WHERE n = 1
UNION ALL SELECT o.d, o.f, o.n, o.s >= w.z, CASE WHEN o.s >= w.z THEN o.e ELSE w.z END FROM w JOIN o ON o.d = w.d AND o.f = w.f AND o.n = w.n + 1),
m AS (SELECT o.* FROM o JOIN w USING (d, f, n) WHERE kept),
r AS (SELECT m.*, text, l1, lag(e, 1, 0) OVER (PARTITION BY d ORDER BY s) z FROM m JOIN documents ON doc_id = d JOIN tax ON category = c)
SELECT d doc_id, string_agg({esc("substr(text, z + 1, s - z)")} || '<mark class="' || l1 || '" title="' || c ||
CASE WHEN sc IS NULL THEN '' ELSE ' · ' || printf('%.3f', sc) END || '">' || {esc("substr(text, s + 1, e - s)")} || '</mark>', '' ORDER BY s)
|| {esc("substr(first(text), max(e) + 1)")} html FROM r GROUP BY d"""

SQL: dict[str, str] = {
    "taxonomy_list": with_(TAX) + "SELECT ord, category, l1, label, kind FROM tax",
    "taxonomy_l1_counts": with_(TAX) + "SELECT l1, count(*) n, count(DISTINCT label) labels FROM tax GROUP BY l1",
    "docs_scan_project": "SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars > 1000",
    "docs_blank_guard": "SELECT doc_id, text IS NULL OR regexp_matches(text, '^\\s*$') AS blank, length(text)::INT n FROM documents",
    "rule_spans_documents": with_(TAX, rule_spans()) + _SPANS,
    "rule_spans_pages": with_(TAX, _PAGED) + _SPANS.replace("d doc_id", "d page_id"),
    "rule_spans_conversations": with_(TAX, _TALKS) + _SPANS,
    "rule_spans_by_category": with_(TAX, rule_spans()) + _SPANS + " WHERE c IN ('email', 'ip_address')",
    "spans_union": with_(TAX, MADE, UNION) + spans_table("u"),
    "spans_merge": with_(TAX, MADE, MERGE) + spans_table("m"),
    **_REPLACED,
    "stream_redact": _REPLACED["redact_default"],
    "anonymize_text": with_(*_BOTH) + rebuilt("m", general()),
    "anonymize_age": f"SELECT p_partkey, {general("'age'", "p_size::VARCHAR")} age FROM part, (SELECT 'Age' label)",
    "anonymize_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y') AS \"year\", '[DATE]' AS \"none\" FROM orders",
    "anonymize_geo": "SELECT n_nationkey, n_name country, '[LOCATION]' city FROM nation JOIN region ON n_regionkey = r_regionkey",
    "hash_tokens": "SELECT c_custkey, 'Person_' || substr(md5(lower(c_name)), 1, 6) AS token FROM customer",
    "hash_tokens_salted": f"SELECT c_custkey, 'Person_' || substr(md5('{SALT}' || lower(c_name)), 1, 6) AS token FROM customer",
    "hash_mapping": with_(*RULED, occurrences("source"), NUMBER)
    + "SELECT rec record_id, label, norm norm_key, label || '_' || substr(md5(norm), 1, 6) pseudonym, orig original FROM q",
    "hash_collisions": with_(NAMES)
    + "SELECT label, 'Person_' || substr(md5(norm), 1, 2) pseudonym, count(*) n FROM (SELECT DISTINCT rec, label, norm FROM o) GROUP BY ALL HAVING count(DISTINCT norm) > 1",
    "counter_names": with_(NAMES, NUMBER) + MAPPING,
    "counter_mapping_doc": with_(*RULED, occurrences("doc_id"), NUMBER) + MAPPING,
    "counter_mapping_record": with_(*RULED, occurrences("source"), NUMBER) + MAPPING,
    "counter_continue": with_(*RULED, occurrences("source"), _CONTINUED) + MAPPING,
    "deid_counter_text": _COUNTER_TEXT,
    "stream_counter": _COUNTER_TEXT,
    "mapping_flatten": with_(*RULED, occurrences("source"), NUMBER) + "SELECT rec record_id, label, name pseudonym, orig original FROM q",
    "mapping_counters": with_(*RULED, occurrences("source"), NUMBER) + "SELECT rec record_id, label, count(*)::INT n FROM q GROUP BY ALL",
    "relink": with_(*RULED, occurrences("source"), NUMBER) + "SELECT rec record_id, name pseudonym, orig original FROM q",
    "token_chunks": with_(TOKENS)
    + """, ti AS (SELECT DISTINCT doc_id, tok_idx FROM tk), ct AS (SELECT *, max(tok_idx) OVER (PARTITION BY doc_id) + 1 n FROM ti)
SELECT doc_id, tok_idx, c::INT chunk_idx FROM (SELECT *, tok_idx // 15 - k c FROM ct, range(2) r(k)) WHERE c >= 0 AND tok_idx < c * 15 + 20 AND (c = 0 OR (c - 1) * 15 + 20 < n)""",
    "token_argmax": """SELECT p_partkey, CASE WHEN a >= b AND a >= c THEN 'O' WHEN b >= c THEN 'B-AGE' ELSE 'I-AGE' END label,
round(1 / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))), 6) score
FROM (SELECT p_partkey, ((p_size * 3) % 11)::DOUBLE a, ((p_size * 5) % 11)::DOUBLE b, ((p_size * 7) % 11)::DOUBLE c FROM part)""",
    "tokens_flatten": with_(TOKENS) + "SELECT * FROM ft",
    "bio_decode": with_(TAX, TOKENS, DECODE.split("\nSELECT", 1)[0]) + "SELECT" + DECODE.split("\nSELECT", 1)[1],
    "word_labels": with_(WORDS, _PIECES) + "SELECT page_id, word_idx, word, label, score FROM wl",
    "word_entities": with_(TAX, WORDS, _PIECES)
    + """SELECT page_id, word_idx ent_idx, substr(wl.label, 3) category, 'text' AS kind, l1, word text, score, x0, y0, x1, y1
FROM wl JOIN wo USING (page_id, word_idx, word) JOIN tax ON tax.category = substr(wl.label, 3) WHERE wl.label <> 'O'""",
    "box_normalize": with_(WORDS)
    + "SELECT page_id, word_idx, "
    + ", ".join(f"least(1000, greatest(0, round_even({c}::DOUBLE / {d} * 1000, 0)))::INT {c}" for c, d in (("x0", 470), ("y0", "(height - 10)"), ("x1", 470), ("y1", "(height - 10)")))
    + " FROM wo",
    "box_pixels": with_(WORDS)
    + "SELECT page_id, word_idx, "
    + ", ".join(f"trunc({c}::DOUBLE / 1000 * {d})::INT {c}" for c, d in (("x0", 1275), ("y0", 1650), ("x1", 1275), ("y1", 1650)))
    + " FROM wo",
    "box_validate": with_(WORDS)
    + """SELECT page_id, word_idx, CASE WHEN word_idx % 11 = 3 THEN 'must have 4 coordinates' ELSE 'is inverted' END reason
FROM wo WHERE word_idx % 11 = 3 OR (word_idx % 13 = 5 AND x1 > x0)""",
    "ocr_adapter": with_(WORDS) + "SELECT page_id, word_idx, word, x0, y0, x1, y1 FROM wo WHERE word_idx % 9 <> 4",
    "redact_boxes": with_(ENTITIES) + PAD + " (SELECT *, 2 p FROM en) USING (page_id)) WHERE x1 > x0 AND y1 > y0",
    "erasure_boxes": with_(ENTITIES) + PAD + " (SELECT *, greatest(2, floor(0.2 * (y1 - y0)))::INT p FROM en) USING (page_id))",
    "words_outside_visuals": with_(ENTITIES)
    + """SELECT page_id, ent_idx, category FROM te t WHERE NOT EXISTS (SELECT 1 FROM vi v WHERE greatest(0, least(t.x1, v.x1) - greatest(t.x0, v.x0)) * greatest(0, least(t.y1, v.y1) - greatest(t.y0, v.y0))::DOUBLE / ((t.x1 - t.x0) * (t.y1 - t.y0)) >= 0.7)""",
    "line_runs": with_(ENTITIES, runs(4.0)) + "SELECT page_id, line_idx, category, text, first_word, n, x0, y0, x1, y1 FROM ru",
    "type_height": with_(ENTITIES, runs(1000.0)) + "SELECT page_id, line_idx, category, first_word, type_height FROM ty",
    "em_sizes": with_(ENTITIES, runs(1000.0))
    + """, ex AS (SELECT page_id, type_height v, unnest(range(n)) FROM ty), md AS (SELECT page_id, list(v ORDER BY v) s FROM ex GROUP BY page_id),
bo AS (SELECT page_id, s[len(s) // 2 + 1] body FROM md)
SELECT page_id, line_idx, category, first_word group_idx, greatest(8, floor(1.2::DOUBLE * CASE WHEN type_height / body::DOUBLE < 0.55 THEN 0.8 WHEN type_height / body::DOUBLE > 1.5 THEN 1.6 ELSE 1.0 END::DOUBLE * body))::INT em_size
FROM ty JOIN bo USING (page_id)""",
    "entity_counts": with_(TAX, rule_spans()) + "SELECT c category, count(*) n FROM sp GROUP BY c",
    "l1_summary": with_(TAX, rule_spans()) + "SELECT l1, count(*) n, count(DISTINCT d) docs, min(sc) least, count(DISTINCT c) categories FROM sp JOIN tax ON category = c GROUP BY l1",
    "rollup_l1_category": with_(TAX, rule_spans()) + "SELECT l1, c category, count(*) n FROM sp JOIN tax ON category = c GROUP BY ROLLUP (l1, c)",
    "kinds_per_page": with_(ENTITIES) + "SELECT page_id, count(*) FILTER (kind = 'text') n_text, count(*) FILTER (kind = 'visual') n_visual FROM en GROUP BY page_id",
    "detected_by_lang_source": with_(rule_spans())
    + "SELECT lang, source, count(*) docs, count(n) docs_with, coalesce(sum(n), 0)::BIGINT spans FROM documents LEFT JOIN (SELECT d, count(*) n FROM sp GROUP BY d) ON doc_id = d GROUP BY lang, source",
    "top_categories": with_(rule_spans())
    + "SELECT category, n, rk::INT AS \"rank\" FROM (SELECT c category, count(*) n, row_number() OVER (ORDER BY count(*) DESC, c) rk FROM sp GROUP BY c) WHERE rk <= 3",
    "hex_colours": "SELECT c_custkey, "
    + ", ".join(f"('0x' || substr(md5(c_name), {i}, 2))::INT {n}" for i, n in ((1, "red"), (3, "green"), (5, "blue")))
    + " FROM customer",
    "category_lists": "SELECT p_partkey, array_to_string(list_filter(string_split(replace(p_name, ' ', ','), ','), lambda x: x <> ''), '|') parts FROM part",
    "label_fallback": "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda x: upper(x[1]) || substr(x, 2)), '') label FROM part",
    "highlight_html": _HIGHLIGHT,
    "stream_counts": "SELECT date_trunc('hour', ts) AS \"start\", event_type, count(*) n FROM events GROUP BY ALL",
}

"""The same results in SQL, written against the benchmark tables for DuckDB."""

from __future__ import annotations

from fileledger import fixed_values as V

ORG = "11111111-1111-1111-1111-111111111111"

# White space as the note format understands it.
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def uuid_of(text: str) -> str:
    return rf"regexp_replace(md5({text}), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\1-\2-\3-\4-\5')"


def state(number: str) -> str:
    names = "['Planned','Dispatched','Accepted','Uncertain','StillPresent','VerifiedAbsent']"
    return f"list_extract({names}, cast({number} % 6 as int) + 1)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --- duplicates -----------------------------------------------------------------

APPS = f"""apps AS (SELECT DISTINCT {uuid_of('o_orderpriority')} AS app, o_orderpriority AS name,
  CASE WHEN o_orderpriority < '4' THEN 1 ELSE 2 END AS os FROM orders)"""
REC = f"""rec AS (SELECT {uuid_of('o_orderpriority')} AS app, o_orderkey + 1 AS id,
  upper(md5(concat(o_custkey, '|', o_orderstatus))) AS hash, o_totalprice >= 10000 AS plain,
  strftime(o_orderdate, '%Y-%m-%d') AS notes, o_totalprice AS price FROM orders)"""
NOW = """rec_now AS (SELECT app, id, hash, plain,
    CASE WHEN price BETWEEN 250000 AND 260000 THEN notes || ' edited' ELSE notes END AS notes
  FROM rec WHERE price <= 480000
  UNION ALL SELECT app, id + 1000000000, hash, plain, notes FROM rec WHERE price > 495000)"""
REPORT = f"""counted AS (SELECT o_orderpriority AS name, upper(md5(concat(o_custkey, '|', o_orderstatus))) AS hash,
    count(*) AS n FROM orders GROUP BY ALL),
report AS (SELECT {uuid_of('name')} AS app, hash, name, CAST(n AS varchar) AS cnt, 2 AS ord FROM counted
  UNION ALL SELECT {uuid_of('name')}, hash, name, '999', 1 FROM counted WHERE n > 1
  UNION ALL SELECT {uuid_of("'1-URGENT'")}, upper(md5(concat(c_custkey, '|X'))), '1-URGENT',
    CASE WHEN c_acctbal < 0 THEN 'invalid' ELSE CAST(c_acctbal AS varchar) END, 1 FROM customer),
last AS (SELECT app, hash, arg_max(name, ord) AS name, arg_max(cnt, ord) AS cnt FROM report GROUP BY app, hash),
valued AS (SELECT *, CASE WHEN v >= 1 AND v = floor(v) AND v < 9.2e18 THEN CAST(v AS bigint) - 1 END AS extra
  FROM (SELECT *, TRY_CAST(cnt AS double) AS v FROM last))"""
GROUPS = """grp AS (SELECT app, hash, count(*) AS members, bool_and(plain) AS all_plain, min(id) AS first
  FROM rec GROUP BY app, hash),
wanted AS (SELECT DISTINCT app, hash FROM report
  UNION SELECT app, hash FROM grp JOIN apps USING (app) WHERE apps.name = '1-URGENT' AND members > 1),
groups AS (SELECT w.app, w.hash, coalesce(members, 0) AS members,
    CASE WHEN members >= 2 AND all_plain THEN CAST(first AS varchar) END AS survivor,
    CASE WHEN coalesce(members, 0) < 2 THEN 'No current duplicates'
      WHEN NOT all_plain THEN 'Ambiguous matching fields or key-file/type flag; entire group preserved'
      ELSE 'Lowest numeric applicationFileId retained; notes archived' END AS reason
  FROM wanted w LEFT JOIN grp g ON w.app = g.app AND w.hash = g.hash)"""
TARGETS = f"""targets AS (SELECT r.app, CAST(r.id AS varchar) AS fid, r.id, r.hash, {state('r.id')} AS status
  FROM rec r JOIN groups g ON r.app = g.app AND r.hash = g.hash
  WHERE g.survivor IS NOT NULL AND CAST(r.id AS varchar) <> g.survivor)"""
PLAN = (APPS, REC, REPORT, GROUPS, TARGETS)
DIFF = """diff AS (SELECT coalesce(b.app, n.app) AS app, CAST(coalesce(b.id, n.id) AS varchar) AS fid,
    t.status AS previous_status,
    CASE WHEN b.id IS NULL THEN 'new'
      WHEN n.id IS NOT NULL AND b.notes <> n.notes THEN 'changed'
      WHEN n.id IS NULL AND t.status IS NULL THEN 'missing_unplanned'
      WHEN n.id IS NULL AND t.status = 'Planned' THEN 'missing_planned'
      WHEN n.id IS NULL THEN 'verified_absent'
      WHEN t.status = 'VerifiedAbsent' THEN 'reappeared'
      WHEN t.status <> 'Planned' THEN 'still_present' ELSE 'unchanged' END AS change,
    CASE WHEN t.status IS NULL THEN NULL WHEN n.id IS NULL THEN 'VerifiedAbsent'
      WHEN t.status = 'Planned' THEN 'Planned' ELSE 'StillPresent' END AS status
  FROM rec b FULL JOIN rec_now n ON b.app = n.app AND b.id = n.id
  LEFT JOIN targets t ON t.app = coalesce(b.app, n.app) AND t.id = coalesce(b.id, n.id))"""

SIZES = f"""spent AS (SELECT o_custkey, count(*) * (max(o_orderkey) + 1) AS size FROM orders GROUP BY o_custkey),
sized AS (SELECT {uuid_of('CAST(o_custkey AS varchar)')} AS application_id,
  concat('Customer ', o_custkey) AS application, size AS reported_hashes FROM spent)"""

EVENTS = f"""ev AS (SELECT event_id AS id, epoch_us(ts) AS time, event_type AS app, CAST(user_id AS varchar) AS fid,
  concat('HTTP ', event_id % 6) AS detail, {state('event_id')} AS status FROM events),
latest AS (SELECT app, fid, status, time FROM ev
  QUALIFY row_number() OVER (PARTITION BY app, fid ORDER BY time DESC, id DESC) = 1)"""
OUTCOMES = """count(*) AS total,
  count(*) FILTER (status IN ('Accepted', 'VerifiedAbsent')) AS accepted,
  count(*) FILTER (status = 'VerifiedAbsent') AS verified, count(*) FILTER (status = 'Planned') AS queued,
  count(*) FILTER (status = 'Dispatched') AS dispatched,
  count(*) FILTER (status IN ('Uncertain', 'StillPresent')) AS attention"""

REQUESTED = f"""req AS (SELECT DISTINCT {uuid_of('o_orderpriority')} AS app, upper(md5(concat(o_custkey, '|F'))) AS hash,
  CASE WHEN o_orderpriority < '4' THEN 1 ELSE 2 END AS os, 'HASH' AS kind FROM orders),
hit AS (SELECT r.app, CAST(r.id AS varchar) AS fid, r.id, r.hash FROM rec r JOIN req q ON r.app = q.app AND r.hash = q.hash)"""

# --- notes and paths --------------------------------------------------------------

PART_PATH = r"concat('C:\Program Files\', p_brand, '\', p_type, '\', p_size, '.', p_partkey % 7, '\', p_name, '.exe')"
PART_NOTE = (
    f"concat('2024-05-06 07:08 UTC Host: PC-', p_partkey, chr(10), 'Path: ', {PART_PATH}, chr(10), "
    "'Process: C:/Program Files//', p_brand, '/launcher.exe', chr(10), 'Cert: CN=', p_name, '; O=', p_type, chr(10), "
    "'Created By:  ', p_brand, '  installer RE(2)')"
)
NOTES = f"""src AS (SELECT concat('part-', p_partkey) AS note_id, {PART_NOTE} AS notes FROM part
  UNION ALL SELECT concat('doc-', doc_id), text FROM documents
  UNION ALL SELECT concat('page-', page_id), concat('Device: web File: ', url, ' Hash: ', md5(html)) FROM pages)"""


def tidy(x: str) -> str:
    """Blanks trimmed and collapsed, null words and a trailing repeat mark removed."""
    flat = rf"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"
    plain = rf"CASE WHEN lower({flat}) IN ('nan', 'none', '[]', '{{}}') THEN '' ELSE {flat} END"
    return rf"trim(regexp_replace({plain}, '\s+RE\(\d+\)$', '', 'i'))"


def norm(x: str) -> str:
    """Normalised path of tidy text."""
    bare = rf"trim(trim({x}, '\"'), '''')".replace('\\"', '"')
    for tail in (
        r"\s+(?:process|processpath|process path|installedby|installed by|createdby|created by|cert|certificate)=.*$",
        r"\s+added\s+by:\s*[^\r\n]+?\s*$",
        r"\s+merged\s+by:\s*[^\r\n]+?\s+\d{4}-\d{2}-\d{2}.*$",
    ):
        bare = f"trim(regexp_replace({bare}, '{tail}', '', 'i'))"
    return rf"""list_transform([lower({bare})], lambda p: nullif(CASE
        WHEN regexp_matches(p, '^[a-z]:[\\/]') THEN regexp_replace(replace(p, '/', '\'), '\\+', '\\', 'g')
        WHEN starts_with(p, '/') THEN coalesce(nullif(rtrim(regexp_replace(p, '/+', '/', 'g'), '/'), ''), '/')
        ELSE p END, ''))[1]"""


_KINDS = {
    "hostname": "Hostname:|Host:|Computer:|Device:|Machine:",
    "sha256": "SHA256:",
    "hash": "Hash:",
    "path": "Path:",
    "process": "Process(?: Name| Path)?:|Image:|File:|Binary:",
    "cert": "Cert(?:ificate|ificates)?s?:|Publisher:|Thumbprint:",
    "created": "Created By:",
    "added": "Added by [^:]+:",
}
_LABELS = "|".join(_KINDS.values())


def _last(kind: str) -> str:
    """Value of the last piece that starts with a label of the kind."""
    found = f"list_filter(pieces, lambda p: regexp_matches(p, '(?i)^(?:{_KINDS[kind]})\\x02'))"
    return tidy(f"coalesce(split_part(list_extract({found}, -1), chr(2), 2), '')") + f" AS l_{kind}"


PARSED = rf"""flat AS (SELECT note_id, {tidy('notes')} AS note FROM src),
cut AS (SELECT note_id, note, list_slice(string_split(
    regexp_replace(note, '(?i)({_LABELS})', chr(1) || '\1' || chr(2), 'g'), chr(1)), 2, 1000000) AS pieces FROM flat),
labelled AS (SELECT note_id, note, {', '.join(_last(k) for k in _KINDS)} FROM cut),
found AS (SELECT *,
    CASE WHEN l_path <> '' THEN {norm('l_path')}
      ELSE {norm("regexp_extract(note, '[A-Za-z]:\\[^\\/:*?" + chr(34) + "<>|]+(?:\\[^\\/:*?" + chr(34) + "<>|]+)*')")} END AS p1,
    {norm(tidy("regexp_extract(note, '/[^/]+(?:/[^/]+)*')"))} AS p2,
    list_filter(list_transform(string_split(l_cert, ';'), lambda c: trim(c)), lambda c: c <> '') AS listed,
    trim(regexp_extract(note, '(?i)\b(cn\s*=\s*[^;|]+)', 1)) AS cn,
    coalesce(nullif(l_sha256, ''), CASE WHEN length(l_hash) = 64 THEN l_hash END) AS s1,
    CASE WHEN length(l_hash) = 32 THEN l_hash END AS m1,
    nullif(regexp_extract(note, '\b([A-Fa-f0-9]{{64}})\b', 1), '') AS h64,
    nullif(regexp_extract(note, '\b([A-Fa-f0-9]{{40}})\b', 1), '') AS h40,
    nullif(regexp_extract(note, '\b([A-Fa-f0-9]{{32}})\b', 1), '') AS h32 FROM labelled),
certs AS (SELECT *, CASE WHEN len(listed) > 0 THEN listed WHEN cn <> '' THEN [cn] END AS cs FROM found)"""
NOTE_PARSE = with_(NOTES, PARSED) + r"""SELECT note_id,
  nullif(trim(regexp_extract(note, '(?i)\b(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?\s*UTC?)\b', 1)), '') AS timestamp_utc,
  nullif(l_hostname, '') AS hostname,
  CASE WHEN m1 IS NOT NULL OR s1 IS NOT NULL THEN m1 WHEN h64 IS NULL AND h40 IS NULL THEN h32 END AS md5_hash,
  CASE WHEN m1 IS NOT NULL OR s1 IS NOT NULL THEN s1 ELSE h64 END AS sha256_hash,
  CASE WHEN m1 IS NULL AND s1 IS NULL AND h64 IS NULL THEN h40 END AS sha1,
  coalesce(p1, CASE WHEN l_path = '' THEN p2 END) AS path, """ + norm("l_process") + r""" AS process_path,
  nullif(l_cert, '') AS certificate_raw,
  coalesce(list_filter(cs, lambda c: NOT contains(lower(c), 'microsoft corporation'))[1], cs[1]) AS certificate_primary,
  array_to_string(cs, '; ') AS certificate_all, nullif(l_created, '') AS created_by, nullif(l_added, '') AS added_by
FROM certs"""

MIXED = rf"""raws AS (SELECT {PART_PATH} AS raw FROM part
  UNION SELECT concat('  "C:/Users/', p_name, '//AppData\\Local\en-US\v', p_size, '.1\', md5(p_name), '\setup.MSI" process=x') FROM part
  UNION SELECT concat('/Applications/', p_type, '.app/Contents//MacOS/', p_name, '/') FROM part
  UNION SELECT regexp_replace(url, '^https?://[^/]*', '') FROM pages),
paths AS (SELECT raw, {norm(tidy('raw'))} AS path FROM raws),
uniq AS (SELECT DISTINCT path FROM paths)"""
_SEP = r"CASE WHEN contains(path, '\') THEN '\' ELSE '/' END"
_BASE = r"regexp_extract(path, '([^\\/]*)[\\/]*$', 1)"
_LANG = "(" + ", ".join(f"'{x}'" for x in V.LANGUAGE_FOLDERS) + ")"
_INSTALLERS = "|".join(V.INSTALLER_EXTENSIONS)
_GUID = r"\{?[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}\}?"
_COMMON = rf"v?\d+(?:\.\d+){{1,8}}|r\d{{1,3}}|20\d{{2}}|{_GUID}"


def segment_map(x: str, test: str, mark: str) -> str:
    """Rewrite the segments of a path that pass a test of ``s``."""
    sep = rf"CASE WHEN contains({x}, '\') THEN '\' ELSE '/' END"
    return (
        f"replace(array_to_string(list_transform(string_split({x}, {sep}), "
        f"lambda seg: CASE WHEN list_transform([lower(trim(seg))], lambda s: {test})[1] THEN '{mark}' ELSE seg END), chr(1)), chr(1), {sep})"
    )


_COLLAPSE = rf"s IN {_LANG} OR regexp_full_match(s, '{_COMMON}|\d{{10,}}|[a-f0-9]{{16,64}}')"
_VOLATILE = (
    rf"s IN {_LANG} OR regexp_full_match(s, '{_COMMON}|[a-f0-9]{{8,64}}|.*\.tmp(?:-\d+)?') OR "
    r"(regexp_full_match(s, '[a-z0-9]{6,12}') AND regexp_matches(s, '[a-z]') AND regexp_matches(s, '\d'))"
)
_PROFILE = r"regexp_replace(regexp_replace(path, '^(c:\\users\\)[^\\]+', '\1*'), '^(/users/)[^/]+', '\1*')"


def leaf_of(x: str) -> str:
    sep = rf"CASE WHEN contains({x}, '\') THEN '\' ELSE '/' END"
    return rf"""CASE WHEN contains({x}, '*') OR len(string_split({x}, {sep})) < 3 THEN {x}
      ELSE concat(replace(array_to_string(list_slice(string_split({x}, {sep}), 1, -2), chr(1)), chr(1), {sep}), {sep}, '*',
        regexp_extract({x}, '(\.(?:{_INSTALLERS}))$', 1)) END"""


PATH_NORMALIZE = with_(MIXED) + rf"""SELECT raw, path, {_PROFILE} AS profile, {leaf_of('path')} AS leaf,
  CASE WHEN regexp_matches({_BASE}, '[^.].*\.[^.]*$|[^.]\.[^.]*$') AND NOT ends_with(path, '/')
    THEN regexp_extract({_BASE}, '(\.[^.]*)$', 1) ELSE '' END AS extension,
  {_BASE} AS base, regexp_replace(path, '^(.+?\.app)(?:/contents/.*)?$', '\1/*') AS target FROM paths"""
VERSION_COLLAPSE = with_(MIXED) + f"""SELECT path, {segment_map('path', _COLLAPSE, '*')} AS collapsed,
  {segment_map('path', _VOLATILE, '<VOLATILE>')} AS shape FROM uniq"""

HEADS = rf"""gen AS (SELECT path, {segment_map(_PROFILE, _COLLAPSE, '*')} AS norm FROM uniq),
seg AS (SELECT path, norm, CASE WHEN contains(norm, '\') THEN '\' ELSE '/' END AS sep,
    CASE WHEN contains(norm, '\') THEN split_part(norm, '\', 1) ELSE '/' END AS root,
    list_filter(list_slice(string_split(norm, CASE WHEN contains(norm, '\') THEN '\' ELSE '/' END), 2, 10000), lambda s: s <> '') AS segs FROM gen),
dir AS (SELECT *, CASE WHEN regexp_matches(coalesce(segs[-1], ''), '[^.].*\.[^.]{{0,11}}$|[^.]\.[^.]{{0,11}}$')
    THEN list_slice(segs, 1, -2) ELSE segs END AS dirs FROM seg),
lev AS (SELECT *, CASE WHEN dirs[1] IN ('program files', 'program files (x86)')
    THEN CASE WHEN len(dirs) <= 3 THEN len(dirs) ELSE 3 END ELSE 3 END AS levels, {leaf_of('norm')} AS leaf FROM dir),
head AS (SELECT *, CASE WHEN root = '/' THEN '/' ELSE root END ||
    CASE WHEN root = '/' OR len(dirs) = 0 THEN '' ELSE sep END || replace(array_to_string(list_slice(dirs, 1, levels), chr(1)), chr(1), sep) AS head FROM lev),
built AS (SELECT *, length(leaf) - length(replace(leaf, '*', '')) AS stars,
    CASE WHEN len(dirs) = 0 THEN norm ELSE head || sep || '*' || regexp_extract(norm, '(\.(?:{_INSTALLERS}))$', 1) END AS deep FROM head),
suggested AS (SELECT *, CASE WHEN stars <= 2 THEN leaf
    WHEN length(deep) - length(replace(deep, '*', '')) <= 2 THEN deep ELSE rtrim(head, sep) || sep || '*' END AS wildcard FROM built)"""
PATH_HEADS = with_(MIXED, HEADS) + "SELECT path, head, wildcard FROM suggested"

VENDORS = r"""raws AS (SELECT DISTINCT concat('CN=', p_name, '; O= ', p_type, ' Inc.') AS certificate FROM part
  UNION SELECT DISTINCT upper(concat(p_name, '  ', p_brand)) FROM part),
low AS (SELECT certificate, lower(regexp_replace(certificate, '\s+', ' ', 'g')) AS l FROM raws)"""
CERTIFICATES = with_(VENDORS) + r"""SELECT certificate, v AS vendor, 'o=' || v AS condition FROM (SELECT certificate,
  CASE WHEN regexp_matches(l, '(?:^|[,;|]\s*)o\s*=') THEN trim(regexp_extract(l, '(?:^|[,;|]\s*)o\s*=\s*([^,;|]+)', 1))
    WHEN regexp_matches(l, '(?:^|[,;|]\s*)cn\s*=') THEN trim(regexp_extract(l, '(?:^|[,;|]\s*)cn\s*=\s*([^,;|]+)', 1))
    ELSE l END AS v FROM low)"""

# --- rules --------------------------------------------------------------------------

OBS = r"""obs AS (SELECT p_partkey + 1 AS row_id, lower(p_brand) AS brand, lower(p_type) AS kind, p_size, p_name,
    concat('c:\program files\', lower(p_brand), '\', lower(p_type), '\', p_size, '.', p_partkey % 7, '\', lower(p_name), '.exe') AS path,
    concat('c:\program files\', lower(p_brand), '\launcher.exe') AS process, lower(p_name) AS vendor,
    concat(p_brand, ' installer') AS creator, upper(md5(CAST(p_partkey AS varchar))) AS hash FROM part)"""
OBSERVATION_ROWS = with_(OBS) + r"""SELECT row_id, path, process AS process_path, vendor AS certificate_primary,
  creator AS created_by, hash AS md5_hash, concat('PC-', row_id - 1) AS hostname, '2024-05-06 07:08 UTC' AS timestamp_utc,
  concat('c:\program files\', brand, '\', kind, '\', p_size, '.', (row_id - 1) % 7, '\*') AS wildcard_path, 4 AS condition_count,
  concat(path, ' | ', process, ' | ', vendor, ' | ', creator, ' | ', hash) AS row_fingerprint FROM obs"""
PAIRS = r"""keyed AS (SELECT *, concat('c:\program files\', brand, '\', kind) AS path_key,
    concat('c:\program files\', brand, '\', kind, '\*\', lower(p_name), '.exe') AS path_wc,
    concat('c:\program files\', brand) AS process_key, 'o=' || vendor AS cert FROM obs),
detail AS (
  SELECT 'ProcessPath' AS pair_type, 'Process Path' AS k1, process AS c1, process_key AS key1, process AS wc1,
    'Path' AS k2, path AS c2, path_key AS key2, path_wc AS wc2, path, row_id FROM keyed
  UNION ALL SELECT 'ProcessCert', 'Process Path', process, process_key, process, 'Certificate', vendor, cert, cert, path, row_id FROM keyed
  UNION ALL SELECT 'PathCert', 'Path', path, path_key, path_wc, 'Certificate', vendor, cert, cert, path, row_id FROM keyed),
pairs AS (SELECT pair_type, k1 AS condition1_kind, key1 AS condition1_key, wc1 AS condition1_wc, k2 AS condition2_kind,
    key2 AS condition2_key, wc2 AS condition2_wc, count(*) AS occurrences, count(*) AS weighted_count,
    arg_min(c1, row_id) AS sample_condition1, arg_min(c2, row_id) AS sample_condition2, min(row_id) AS first_row,
    array_to_string(list_slice(list_sort(list_distinct(list(path))), 1, 5), chr(10)) AS example_paths
  FROM detail GROUP BY ALL)"""
NUMBERED = """row_number() OVER (ORDER BY weighted_count DESC, occurrences DESC, pair_type, condition1_key, condition2_key,
  condition1_wc, condition2_wc)"""
CANDIDATE_PAIRS = with_(OBS, PAIRS) + f"""SELECT p.* EXCLUDE (first_row), n.notes AS example_notes FROM pairs p
  JOIN (SELECT p_partkey + 1 AS row_id, {PART_NOTE} AS notes FROM part) n ON n.row_id = p.first_row"""


def _condition(kind: str, suffix: str) -> str:
    return f"CASE '{kind}' WHEN condition1_kind THEN condition1_{suffix} WHEN condition2_kind THEN condition2_{suffix} END"


PAIR_EXPORT = with_(OBS, PAIRS) + f"""SELECT printf('Pair %04d', {NUMBERED}) AS pair_name, pair_type,
  {_condition('Path', 'wc')} AS path, {_condition('Process Path', 'wc')} AS process_path,
  {_condition('Certificate', 'key')} AS certificate, CAST(NULL AS varchar) AS created_by,
  occurrences AS weighted_count, occurrences, example_paths FROM pairs"""

# Sibling paths share a vendor folder when all lie below one brand; otherwise only
# siblings that differ in their last one or two parts merge.
BASE = rf"""mapped AS (SELECT {_condition('Path', 'wc')} AS path, {_condition('Process Path', 'wc')} AS process_path,
    {_condition('Certificate', 'key')} AS certificate, pair_type AS rule_type, occurrences AS source_rows,
    condition1_key, condition2_key, condition1_wc, condition2_wc FROM pairs),
kept AS (SELECT * FROM mapped WHERE path IS NOT NULL),
lines AS (SELECT DISTINCT k.process_path, k.certificate, k.rule_type, d.key1, d.key2, d.wc1, d.wc2, d.path AS line FROM kept k
  JOIN detail d ON d.pair_type = k.rule_type AND d.key1 = k.condition1_key AND d.key2 = k.condition2_key AND d.wc1 = k.condition1_wc AND d.wc2 = k.condition2_wc),
parts AS (SELECT *, string_split(line, '\') AS q FROM lines),
sib AS (SELECT process_path, certificate, count(DISTINCT q[3]) AS brands, count(DISTINCT q[4]) AS kinds, count(*) AS n,
    min(line) AS one FROM parts GROUP BY ALL),
merged AS (SELECT process_path, certificate, CASE
    WHEN n = 1 THEN regexp_replace(one, '\\[0-9]+\.[0-9]+\\', '\\*\\')
    WHEN brands = 1 THEN regexp_replace(one, '^(c:\\program files\\[^\\]+)\\.*$', '\1\\*') END AS path FROM sib),
base AS (SELECT path, process_path, certificate, rule_type, source_rows FROM kept
  UNION ALL SELECT m.path, m.process_path, m.certificate, 'MergedPathGroup', t.rows FROM merged m
  JOIN (SELECT process_path, certificate, CAST(sum(source_rows) AS bigint) AS rows FROM kept GROUP BY ALL) t
    ON m.process_path IS NOT DISTINCT FROM t.process_path AND m.certificate IS NOT DISTINCT FROM t.certificate
  WHERE m.path IS NOT NULL)"""
BASE_RULES = with_(OBS, PAIRS, BASE) + """SELECT path, process_path, certificate, CAST(NULL AS varchar) AS created_by,
  rule_type, source_rows FROM base"""

# What the family passes leave of these rules: every path that ends in .exe gives way to
# the one global program family, which has no second condition and goes as well. Vendor
# folders stay, and so do certificates whose own family is that same pattern: at least
# three paths, in several brands and of several kinds (of one kind, they become a
# same-shape pattern that ends in .exe).
FINAL = r"""sets AS (SELECT certificate, count(DISTINCT path) AS n, count(DISTINCT string_split(path, '\')[3]) AS brands,
    count(DISTINCT string_split(path, '\')[4]) AS kinds FROM kept WHERE certificate IS NOT NULL GROUP BY certificate),
final AS (SELECT 0 AS stage, source_rows AS weight, path, process_path, certificate FROM base
    WHERE rule_type = 'MergedPathGroup' AND NOT ends_with(path, '.exe')
  UNION ALL SELECT 1, 0, 'c:\program files\*.exe', NULL, certificate FROM sets WHERE n >= 3 AND brands > 1 AND kinds > 1)"""
RULES_FINAL = with_(OBS, PAIRS, BASE, FINAL) + """SELECT path, certificate, process_path, CAST(NULL AS varchar) AS created_by,
  row_number() OVER (ORDER BY stage, weight DESC, process_path NULLS LAST, certificate NULLS LAST) AS rule_rank FROM final"""

RULE_SET = rf"""rule_set AS (
  SELECT DISTINCT {uuid_of('p_type')} AS app, 1 AS level, concat('c:\program files\', lower(p_brand), '\', lower(p_type), '\*\', p_name, '.exe') AS path,
    CAST(NULL AS varchar) AS certificate, concat('c:\program files\', lower(p_brand), '\launcher.exe') AS process_path FROM part
  UNION ALL SELECT DISTINCT {uuid_of('p_type')}, 2, concat('c:\program files\', lower(p_brand), '\', lower(p_type), '\', p_size, '.*'),
    NULL, concat('c:\program files\', lower(p_brand), '\launcher.exe') FROM part
  UNION ALL SELECT DISTINCT {uuid_of('p_type')}, 3, concat('c:\program files\', lower(p_brand), '\', lower(p_type), '\*'), concat('CN=', p_name), NULL FROM part
  UNION ALL SELECT DISTINCT {uuid_of('p_type')}, 4, 'c:\program files\*.exe', NULL, concat('c:\program files\', lower(p_brand), '\launcher.exe') FROM part),
ranked AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY level, path, certificate NULLS LAST, process_path NULLS LAST) AS rule_rank FROM rule_set)"""
_LIKE = r"replace(replace(replace(replace({p}, '\', '\\'), '%', '\%'), '_', '\_'), '*', '%')"


def like(value: str, pattern: str) -> str:
    return f"{value} LIKE {_LIKE.format(p=pattern)} ESCAPE '\\'"


SUPPRESSED = with_(RULE_SET) + f"""SELECT app, path, certificate, process_path, CAST(NULL AS varchar) AS created_by FROM rule_set n
WHERE NOT EXISTS (SELECT 1 FROM rule_set b WHERE b.app = n.app AND b.path <> n.path
  AND b.certificate IS NOT DISTINCT FROM n.certificate AND b.process_path IS NOT DISTINCT FROM n.process_path
  AND {like('n.path', 'b.path')} AND NOT ({like('b.path', 'n.path')} AND n.path < b.path))"""

#: Parts without a key-file flag.
NOT_FLAGGED = " WHERE p_retailprice < 990"
OBS_REC = rf"""o AS (SELECT {uuid_of('p_type')} AS app, p_partkey + 1 AS id,
    concat('c:\program files\', lower(p_brand), '\', lower(p_type), '\', p_size, '.', p_partkey % 7, '\', lower(p_name), '.exe') AS path,
    concat('c:\program files\', lower(p_brand), '\launcher.exe') AS process, concat('CN=', p_name) AS cert FROM part{NOT_FLAGGED}),
edges AS (SELECT r.app, r.rule_rank, o.id FROM ranked r JOIN o ON o.app = r.app
  AND (r.process_path IS NULL OR r.process_path = o.process) AND (r.certificate IS NULL OR lower(r.certificate) = lower(o.cert))
  AND {like('o.path', 'lower(r.path)')}),
screened AS (SELECT r.*, list_filter([
    CASE WHEN coalesce(path, '') = '' OR certificate IS NULL AND process_path IS NULL THEN 'Requires path plus another condition' END,
    CASE WHEN contains(concat(path, certificate, process_path), '?') OR path ^@ 'regex:' OR certificate ^@ 'regex:' OR process_path ^@ 'regex:'
      THEN 'Unsupported matching syntax' END,
    CASE WHEN contains(concat(certificate, process_path), '*') THEN 'Identity anchors must be exact' END,
    CASE WHEN NOT regexp_matches(lower(path), '^c:\\program files( \(x86\))?\\') THEN 'Live consolidation limited to Windows Program Files paths' END,
    CASE WHEN len(string_split(split_part(path, '\*', 1), '\')) < 4 THEN 'Path is too broad' END], lambda x: x IS NOT NULL) AS static
  FROM ranked r),
bundles AS (SELECT s.app, s.rule_rank, len(s.static) = 0 AS usable, coalesce(list(e.id) FILTER (e.id IS NOT NULL), []) AS ids
  FROM screened s LEFT JOIN edges e ON e.app = s.app AND e.rule_rank = s.rule_rank GROUP BY s.app, s.rule_rank, s.static),
greedy AS (
  SELECT app, CAST(0 AS bigint) AS rule_rank, CAST([] AS bigint[]) AS covered, CAST(0 AS bigint) AS fresh, false AS accepted
  FROM (SELECT DISTINCT app FROM ranked)
  UNION ALL
  SELECT b.app, b.rule_rank, CASE WHEN ok THEN list_concat(covered, b.new_ids) ELSE covered END, len(b.new_ids), ok
  FROM (SELECT b.*, g.covered, list_filter(b.ids, lambda i: NOT list_contains(g.covered, i)) AS new_ids,
      b.usable AND len(list_filter(b.ids, lambda i: NOT list_contains(g.covered, i))) >= 2 AS ok
    FROM greedy g JOIN bundles b ON b.app = g.app AND b.rule_rank = g.rule_rank + 1) b)"""
#: Rules mined per application as the conservative profile does: every pair of a path and its
#: process or certificate; folders of one identity with at least three versions become one
#: pattern (each identity's best); path-only patterns over all identities of an application
#: take the rules below them along and go for want of a second condition.
MINED = rf"""seen AS (SELECT {uuid_of('p_type')} AS app, concat('c:\program files\', lower(p_brand), '\', lower(p_type), '\', p_size, '.', p_partkey % 7) AS folder,
    lower(p_name) AS name, concat('c:\program files\', lower(p_brand), '\launcher.exe') AS process FROM part{NOT_FLAGGED}),
paired AS (
  SELECT app, 'PathCert' AS kind, concat(folder, '\', name, '.exe') AS key1, 'o=' || name AS key2, concat(folder, '\*') AS wc1, 'o=' || name AS wc2,
    concat(folder, '\*') AS path, 'o=' || name AS certificate, CAST(NULL AS varchar) AS process_path, count(*) AS n FROM seen GROUP BY app, folder, name
  UNION ALL
  SELECT app, 'ProcessPath', process, concat(folder, '\', name, '.exe'), process, concat(folder, '\*'), concat(folder, '\*'), NULL, process, count(*)
  FROM seen GROUP BY app, folder, name, process),
placed AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY n DESC, length(path) - length(replace(path, '*', '')), kind, key1, key2, wc1, wc2) AS place FROM paired),
first_rules AS (SELECT app, path, certificate, process_path, 0 AS stage, min(place) AS place FROM placed GROUP BY ALL),
parts AS (SELECT *, string_split(path, '\') AS q FROM first_rules),
shaped AS (SELECT *, array_to_string(q[1:-3], '\') || '\*\*' AS family,
    regexp_full_match(q[-2], 'v?\d+(\.\d+){{1,8}}') AS volatile FROM parts),
families AS (SELECT app, certificate, process_path, family, count(DISTINCT path) AS n FROM shaped WHERE volatile
  GROUP BY app, certificate, process_path, family, len(q) HAVING count(DISTINCT path) >= 3
    AND length(family) - length(replace(family, '*', '')) <= 2),
best AS (SELECT app, certificate, process_path, arg_max(family, (n, -length(family), family)) AS family FROM families GROUP BY ALL),
second_rules AS (
  SELECT r.app, r.path, r.certificate, r.process_path, r.stage, r.place FROM first_rules r LEFT JOIN best b
    ON b.app = r.app AND b.certificate IS NOT DISTINCT FROM r.certificate AND b.process_path IS NOT DISTINCT FROM r.process_path
  WHERE b.family IS NULL OR b.family = r.path OR NOT {like('r.path', 'b.family')}
  UNION ALL SELECT app, family, certificate, process_path, 1, 0 FROM best),
again AS (SELECT *, array_to_string(q[1:-3], '\') || '\*\*' AS family, regexp_full_match(q[-2], 'v?\d+(\.\d+){{1,8}}') AS volatile
  FROM (SELECT *, string_split(path, '\') AS q FROM second_rules)),
everywhere AS (SELECT app, family FROM again WHERE volatile GROUP BY app, family, len(q) HAVING count(DISTINCT path) >= 3
    AND length(family) - length(replace(family, '*', '')) <= 2),
third_rules AS (SELECT * FROM second_rules r WHERE NOT EXISTS (SELECT 1 FROM everywhere e
  WHERE e.app = r.app AND e.family <> r.path AND {like('r.path', 'e.family')})),
left_rules AS (SELECT DISTINCT * FROM third_rules n WHERE NOT EXISTS (SELECT 1 FROM third_rules b WHERE b.app = n.app AND b.path <> n.path
  AND b.certificate IS NOT DISTINCT FROM n.certificate AND b.process_path IS NOT DISTINCT FROM n.process_path
  AND {like('n.path', 'b.path')} AND NOT ({like('b.path', 'n.path')} AND (n.stage, n.place) < (b.stage, b.place)))),
ranked AS (SELECT app, path, certificate, process_path,
  row_number() OVER (PARTITION BY app ORDER BY stage, place, certificate NULLS LAST, process_path NULLS LAST) AS rule_rank FROM left_rules)"""
COVERAGE = with_(RULE_SET, OBS_REC.replace(NOT_FLAGGED, "")).replace("WITH ", "WITH RECURSIVE ", 1) + """SELECT app, rule_rank, path, certificate, process_path,
  CAST(NULL AS varchar) AS created_by, covered AS covered_observations,
  CASE WHEN len(reasons) > 0 THEN 'Preserved / review' ELSE 'Review required' END AS status,
  CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, '; ')
    ELSE 'Expands beyond exact hashes; review conditions before applying' END AS reason
FROM (SELECT s.*, len(b.ids) AS covered, list_concat(s.static,
    CASE WHEN g.fresh < 2 THEN ['Fewer than two additional source records covered'] ELSE [] END) AS reasons
  FROM screened s JOIN bundles b USING (app, rule_rank) JOIN greedy g USING (app, rule_rank))"""
ASSIGNMENT = with_(RULE_SET, OBS_REC).replace("WITH ", "WITH RECURSIVE ", 1) + """SELECT e.app, CAST(e.id AS varchar) AS fid,
  min(e.rule_rank) AS rule_rank FROM edges e JOIN screened s USING (app, rule_rank) JOIN greedy g USING (app, rule_rank)
WHERE len(s.static) = 0 AND g.fresh >= 2 GROUP BY e.app, e.id"""

DROPPED = with_(MINED) + f"""SELECT r.app, r.path, r.certificate, r.process_path, CAST(NULL AS varchar) AS created_by, min(e.family) AS family
FROM second_rules r JOIN everywhere e ON e.app = r.app AND e.family <> r.path AND {like('r.path', 'e.family')}
GROUP BY r.app, r.path, r.certificate, r.process_path"""
CONSOLIDATION = COVERAGE.replace(RULE_SET, MINED).replace(NOT_FLAGGED, "")

RISKY = r"""given AS (SELECT DISTINCT CASE p_size % 10 WHEN 0 THEN 'c:\users\*\*'
      WHEN 1 THEN concat('c:\programdata\', lower(p_brand), '\*.dll') WHEN 2 THEN concat('c:\windows\temp\', p_name, '.exe')
      WHEN 3 THEN concat('/users/bob/', lower(p_type), '/.venv/lib/python/', p_name, '.so') WHEN 4 THEN '/users/*/library/python/*'
      WHEN 5 THEN '/applications/*/*' ELSE concat('c:\program files\', lower(p_brand), '\*\*') END AS path,
    CASE WHEN p_retailprice < 950 THEN concat('o=', lower(p_type)) END AS certificate,
    CASE p_partkey % 6 WHEN 0 THEN 'c:\windows\system32\msiexec.exe' WHEN 1 THEN '/users/bob/bin/python3.11'
      WHEN 2 THEN '/system/library/privateframeworks/x.framework/helper' WHEN 3 THEN concat('c:\program files\', lower(p_brand), '\app.exe') WHEN 4 THEN '/applications/*' END AS process_path,
    CASE WHEN p_retailprice < 920 THEN p_brand END AS created_by FROM part),
risky AS (SELECT * REPLACE (nullif(process_path, '/applications/*') AS process_path) FROM given),
facts AS (SELECT *,
    1 + (process_path IS NOT NULL)::int + (certificate IS NOT NULL)::int + (created_by IS NOT NULL)::int AS conditions,
    regexp_matches(path, '^c:\\(users|programdata|windows\\temp)\\') AS writable,
    starts_with(path, '/users/') AS mac_writable, path = 'c:\users\*\*' AS dangerous,
    path IN ('/applications/*/*', '/users/*/library/python/*') AS broad,
    coalesce(process_path LIKE '%msiexec.exe' OR process_path LIKE '/users/%', false) AS risky_process,
    coalesce(process_path LIKE '/system/library/privateframeworks/%', false) AS framework,
    coalesce(process_path LIKE '/users/bob/bin/python3.11', false) AND path LIKE '%.so' AND certificate IS NULL AND created_by IS NULL AS safe,
    length(path) - length(replace(path, '*', '')) AS wildcards FROM risky),
scored AS (SELECT *, CASE WHEN safe THEN 5 ELSE
    5 * writable::int + 5 * contains(path, '\temp\')::int + 5 * risky_process::int + 3 * (wildcards > 1)::int
    + 3 * (certificate IS NULL)::int + 2 * (process_path IS NULL)::int + 2 * (created_by IS NULL AND writable)::int
    + 10 * dangerous::int + 15 * broad::int + 5 * framework::int + 6 * (path = '/users/*/library/python/*')::int
    + 10 * (mac_writable AND conditions < 3)::int END AS score FROM facts)"""
RISK = with_(RISKY) + """SELECT path, certificate, process_path, created_by, conditions AS condition_count, score AS risk_score,
  CASE WHEN score >= 12 THEN 'High' WHEN score >= 6 THEN 'Medium' ELSE 'Low' END AS risk, wildcards AS wildcard_count,
  CASE WHEN broad THEN 'Overbroad macOS wildcard path'
    WHEN framework THEN 'Apple private framework helper requires extra anchor'
    WHEN risky_process THEN 'High-risk process path requires 3 conditions' ELSE '' END AS review_notes FROM scored"""
DANGEROUS = with_(RISKY) + """SELECT path, certificate, process_path, created_by FROM facts
WHERE conditions >= 2 AND (safe OR (NOT dangerous AND NOT broad
  AND NOT (conditions < 3 AND (writable OR mac_writable OR framework OR coalesce(process_path LIKE '/users/%', false)))))
  AND (safe OR NOT (risky_process AND conditions < 3))"""


INSERTED = rf"""wanted AS (SELECT {uuid_of('p_type')} AS app, p_partkey AS rule_no, p_partkey % 8 AS kind FROM part),
found AS (SELECT w.app, rule_no, kind, CAST(1000000000 + 2 * rule_no + copy AS varchar) AS fid FROM wanted w, range(2) r(copy)
  WHERE kind <> 0 AND (copy = 0 OR kind = 1)),
checked AS (SELECT w.app, w.rule_no, min(f.fid) AS fid, CASE WHEN count(f.fid) <> 1 THEN 'Inserted rule missing or ambiguous.'
    WHEN w.kind IN (2, 5) THEN 'Inserted rule has unexpected matching semantics.'
    WHEN w.kind = 3 THEN 'Inserted rule original fields disagree with the reviewed conditions.' END AS problem
  FROM wanted w LEFT JOIN found f USING (app, rule_no) GROUP BY w.app, w.rule_no, w.kind)"""


def oracle_sql() -> dict[str, str]:
    plan = with_(*PLAN)
    diff = with_(*PLAN, NOW, DIFF)
    wanted = with_(REC, REQUESTED)
    return {
        "duplicate_plan": plan + """SELECT t.app, fid, hash, 'Planned' AS status, a.name AS "applicationName", a.os AS "osType"
            FROM targets t JOIN apps a ON t.app = a.app""",
        "duplicate_groups": plan + "SELECT app, hash, members, survivor, reason FROM groups",
        "group_preview": plan + """SELECT g.app, g.hash, survivor, count(t.fid) AS deletions FROM groups g
            LEFT JOIN targets t ON t.app = g.app AND t.hash = g.hash GROUP BY ALL""",
        "removal_waves": f"""SELECT app, hash, fid, position, (position - 1) // 32 AS wave FROM (
            SELECT {uuid_of('o_orderpriority')} AS app, upper(md5(o_orderstatus)) AS hash, CAST(o_orderkey + 1 AS varchar) AS fid,
            row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS position FROM orders)""",
        "text_duplicates": """SELECT lang AS app, CAST(doc_id AS varchar) AS fid, upper(md5(text)) AS hash FROM documents
            QUALIFY row_number() OVER (PARTITION BY lang, md5(text) ORDER BY doc_id) > 1""",
        "report_rows": with_(REPORT) + "SELECT app AS application_id, hash, name, cnt AS count FROM last",
        "report_repeats": with_(REPORT) + "SELECT (SELECT count(*) FROM report) - count(*) AS repeated, count(*) AS rows FROM last",
        "report_summary": with_(REPORT) + """SELECT app AS application_id, arg_min(name, hash) AS application, count(*) AS candidate_groups,
            CAST(coalesce(sum(extra), 0) AS bigint) AS estimated_extra_records, count(*) FILTER (extra IS NULL) AS unknown_counts
            FROM valued GROUP BY app""",
        "report_totals": with_(REPORT) + """SELECT count(*) AS groups, count(DISTINCT hash) AS hashes,
            (SELECT count(*) FROM (SELECT hash FROM last GROUP BY hash HAVING count(DISTINCT app) > 1)) AS shared_hashes,
            CAST(coalesce(sum(extra), 0) AS bigint) AS extras, count(*) FILTER (extra IS NULL) AS unknown_counts FROM valued""",
        "shared_hashes": with_(REPORT) + "SELECT hash, count(DISTINCT app) AS applications FROM last GROUP BY hash HAVING count(DISTINCT app) > 1",
        "top_applications": f"""SELECT {uuid_of('CAST(o_custkey AS varchar)')} AS application_id, concat('Customer ', o_custkey) AS application,
            count(*) AS candidate_groups, CAST(sum(n - 1) AS bigint) AS estimated_extra_records, CAST(0 AS bigint) AS unknown_counts
            FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey
            ORDER BY estimated_extra_records DESC, application_id LIMIT 15""",
        "large_app_totals": with_(SIZES) + """SELECT count(*) FILTER (reported_hashes > 1000) AS over_1000, CAST(sum(reported_hashes) AS bigint) AS reported,
            max(reported_hashes) AS largest, count(*) FILTER (reported_hashes > 100000) AS over_100000 FROM sized""",
        "largest_applications": with_(SIZES) + "SELECT * FROM sized ORDER BY reported_hashes DESC, application_id LIMIT 12",
        "application_search": with_(SIZES) + "SELECT * FROM sized WHERE contains(lower(concat_ws(' ', application, application_id)), 'customer 1')",
        "application_lookup": f"""SELECT {uuid_of('s_name')} AS "applicationId", s_name AS name, 1 AS "osType" FROM supplier
            WHERE contains(lower(s_name), 'supplier#00000000') AND s_acctbal >= 0 AND s_acctbal <= 9000""",
        "live_counts": with_(REC) + """SELECT app, count(*) AS live_records, count(*) AS live_hash_records,
            count(DISTINCT hash) AS live_distinct_hashes FROM rec GROUP BY app""",
        "plan_counts": plan + """SELECT count(*) AS planned, count(*) FILTER (status = 'VerifiedAbsent') AS verified,
            count(*) FILTER (status <> 'VerifiedAbsent') AS remaining,
            (SELECT count(*) FROM groups WHERE survivor IS NULL) AS skipped_groups FROM targets""",
        "status_histogram": plan + "SELECT status, count(*) AS targets FROM targets GROUP BY status",
        "run_summary": plan + """SELECT a.name AS application, a.app AS application_id, CASE a.os WHEN 1 THEN 'Windows' ELSE 'macOS' END AS os,
            b AS baseline_records, g AS eligible_groups, coalesce(t, 0) AS planned_deletions, coalesce(v, 0) AS verified_deletions,
            b - coalesce(t, 0) AS expected_after_cleanup, coalesce(t, 0) - coalesce(v, 0) AS remaining_planned FROM apps a
            JOIN (SELECT app, count(*) AS b FROM rec GROUP BY app) USING (app)
            JOIN (SELECT app, count(survivor) AS g FROM groups GROUP BY app) USING (app)
            LEFT JOIN (SELECT app, count(*) AS t, count(*) FILTER (status = 'VerifiedAbsent') AS v FROM targets GROUP BY app) USING (app)""",
        "skip_reasons": plan + "SELECT reason, count(*) AS groups FROM groups WHERE survivor IS NULL GROUP BY reason",
        "before_after": plan + """SELECT before, removed, CAST(0 AS bigint) AS added, before - removed AS after, before - removed AS preserved,
            round(removed / before, 4) AS reduction FROM (SELECT (SELECT count(*) FROM rec) AS before, (SELECT count(*) FROM targets) AS removed)""",
        "plan_applied": plan + """SELECT app, CAST(id AS varchar) AS fid, hash FROM rec r
            WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE t.app = r.app AND t.id = r.id)""",
        "replan_after_apply": plan + """SELECT CASE WHEN n < 2 THEN 'No current duplicates'
            ELSE 'Ambiguous matching fields or key-file/type flag; entire group preserved' END AS reason, count(*) AS groups, CAST(0 AS bigint) AS planned_groups
            FROM (SELECT app, hash, count(*) AS n FROM rec r WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE t.app = r.app AND t.id = r.id)
            GROUP BY ALL) GROUP BY reason""",
        "snapshot_diff": diff + "SELECT * FROM diff",
        "reconcile_violations": diff + """SELECT CASE change WHEN 'new' THEN 'New application records detected; existing plan cannot proceed.'
            WHEN 'changed' THEN 'Record fields changed; existing plan cannot proceed.'
            WHEN 'missing_unplanned' THEN 'Retained or unrelated record disappeared; cleanup stopped.'
            WHEN 'missing_planned' THEN 'Unsubmitted target disappeared; external change detected.'
            ELSE 'Previously absent record reappeared; stopped.' END AS reason, count(*) AS records FROM diff
            WHERE change IN ('new', 'changed', 'missing_unplanned', 'missing_planned', 'reappeared') GROUP BY reason""",
        "wave_precheck": diff + """, expected AS (SELECT r.* FROM rec r LEFT JOIN targets t ON t.app = r.app AND t.id = r.id
              WHERE coalesce(t.status, '') NOT IN ('VerifiedAbsent', 'Accepted')),
            eligible AS (SELECT app, hash, min(id) AS survivor FROM rec GROUP BY app, hash HAVING count(*) >= 2 AND bool_and(plain)),
            both_ AS (SELECT coalesce(e.app, n.app) AS app, coalesce(e.hash, n.hash) AS hash, coalesce(e.id, n.id) AS id,
              e.id IS NOT NULL AND n.id IS NOT NULL AND e.notes = n.notes AS same, n.id IS NOT NULL AS live, coalesce(n.plain, true) AS plain
              FROM expected e FULL JOIN rec_now n ON e.app = n.app AND e.hash = n.hash AND e.id = n.id)
            SELECT app, hash, bool_and(same) AS unchanged, bool_or(id = survivor AND live) AS survivor_present, bool_and(plain) AS still_plain,
              bool_and(same) AND bool_or(id = survivor AND live) AND bool_and(plain) AS safe
            FROM both_ JOIN eligible USING (app, hash) GROUP BY app, hash""",
        "validation_report": with_(APPS, REC) + """SELECT 'Record OS mismatch.' AS reason, 2 * count(*) AS rows FROM rec JOIN apps USING (app)
            WHERE NOT plain AND os = 1 HAVING count(*) > 0 UNION ALL
            SELECT 'Invalid or repeated application-file IDs.', count(*) FROM rec WHERE NOT plain HAVING count(*) > 0""",
        "outcome_progress": with_(EVENTS) + f"SELECT app, {OUTCOMES} FROM latest GROUP BY app",
        "outcome_totals": with_(EVENTS) + f"SELECT {OUTCOMES} FROM latest",
        "recent_responses": with_(EVENTS) + """SELECT e.id, e.time, e.app AS application_id, e.fid AS record_id, detail AS response,
            coalesce(l.status, 'Unknown') AS current_status FROM (SELECT * FROM ev ORDER BY time DESC, id DESC LIMIT 10) e
            LEFT JOIN latest l ON l.app = e.app AND l.fid = e.fid""",
        "run_history": """SELECT CAST(s_suppkey AS varchar) AS run, CASE WHEN s_nationkey < 12 THEN 'Duplicate hashes' ELSE 'Conditional rules' END AS workflow,
            CASE WHEN s_acctbal > 0 THEN 'Complete' ELSE 'Preview' END AS status, coalesce(names, '') AS application, coalesce(ids, '') AS application_ids,
            coalesce(n, 0) AS planned, coalesce(v, 0) AS verified, s_acctbal AS created FROM supplier
            LEFT JOIN (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS v,
              string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS ids,
              string_agg(DISTINCT 'App ' || l_returnflag, ', ' ORDER BY 'App ' || l_returnflag) AS names FROM lineitem GROUP BY l_suppkey)
            ON l_suppkey = s_suppkey WHERE s_nationkey <> 3""",
        "requested_match": wanted + "SELECT app, fid, hash, 'Planned' AS status, '' AS detail FROM hit",
        "requested_unmatched": wanted + "SELECT * FROM req q WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.app = q.app AND h.hash = q.hash)",
        "requested_counts": wanted + """SELECT (SELECT count(*) FROM req) AS requested, (SELECT count(*) FROM rec) AS scanned,
            (SELECT count(*) FROM hit) AS planned,
            (SELECT count(*) FROM req q WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.app = q.app AND h.hash = q.hash)) AS unmatched""",
        "requested_preview": wanted + """SELECT app, min(os) AS os, count(*) AS requested_hashes, coalesce(any_value(n), 0) AS target_records
            FROM req LEFT JOIN (SELECT app, count(*) AS n FROM hit GROUP BY app) USING (app) GROUP BY app""",
        "recovered_targets": with_(REC, REQUESTED, NOW) + """SELECT h.app, fid, h.hash, CASE WHEN n.id IS NULL THEN 'VerifiedAbsent' ELSE 'Planned' END AS status
            FROM hit h LEFT JOIN rec_now n ON n.app = h.app AND n.id = h.id""",
        "note_parse": NOTE_PARSE,
        "usable_notes": with_(NOTES) + r"""SELECT note_id, len(regexp_extract_all(notes, '(?i)\bpath\s*:'))
            - len(regexp_extract_all(notes, '(?i)process path\s*:')) <= 1 AS usable FROM src""",
        "path_normalize": PATH_NORMALIZE,
        "version_collapse": VERSION_COLLAPSE,
        "path_heads": PATH_HEADS,
        "certificate_vendors": CERTIFICATES,
        "record_hashes": """SELECT c_custkey, array_to_string(list_sort([upper(md5(c_name)), upper(md5(c_mktsegment))]), ',') AS hashes FROM customer""",
        "observation_rows": OBSERVATION_ROWS,
        "candidate_pairs": CANDIDATE_PAIRS,
        "pair_export": PAIR_EXPORT,
        "base_rules": BASE_RULES,
        "rules_final": RULES_FINAL,
        "rule_suppression": SUPPRESSED,
        "rule_risk": RISK,
        "dangerous_filter": DANGEROUS,
        "rule_coverage": COVERAGE,
        "rule_assignment": ASSIGNMENT,
        "consolidation_rules": CONSOLIDATION,
        "dropped_rules": DROPPED,
        "long_id_waves": f"""SELECT app, hash, fid, position, (position - 1) // 20 AS wave, price FROM (SELECT *,
              row_number() OVER (PARTITION BY app, hash ORDER BY length(ltrim(fid, '0')), ltrim(fid, '0'), fid) AS position FROM (
                SELECT {uuid_of('o_orderpriority')} AS app, upper(md5(o_orderstatus)) AS hash, o_totalprice AS price,
                  CASE (o_orderkey + 1) % 3 WHEN 0 THEN CAST(o_orderkey + 1 AS varchar) WHEN 1 THEN concat('000', o_orderkey + 1)
                    ELSE concat('1', lpad(CAST(o_orderkey + 1 AS varchar), 44, '0')) END AS fid FROM orders))""",
        "unknown_fields": with_(REC) + """SELECT app, hash, count(*) AS members,
            CASE WHEN count(*) >= 2 AND bool_and(plain AND NOT notes LIKE '%-15') THEN CAST(min(id) AS varchar) END AS survivor,
            CASE WHEN count(*) < 2 THEN 'No current duplicates' WHEN NOT bool_and(plain AND NOT notes LIKE '%-15')
              THEN 'Ambiguous matching fields or key-file/type flag; entire group preserved' ELSE 'Lowest numeric applicationFileId retained; notes archived' END AS reason
            FROM rec GROUP BY app, hash""",
        "padded_ids": with_(REC) + """SELECT 'Invalid or repeated application-file IDs.' AS reason, count(*) AS rows
            FROM rec WHERE notes LIKE '%-15' HAVING count(*) > 0""",
        "insertion_matches": with_(INSERTED) + "SELECT app, rule_no, fid, problem FROM checked",
        "consolidation_difference": with_(INSERTED, f"""old AS (SELECT {uuid_of('p_type')} AS app, p_partkey AS k FROM part),
            state AS (SELECT k, k % 10 IN (0, 4, 5, 7) AS absent, CASE WHEN k % 10 IN (0, 3) THEN 'Verified' WHEN k % 10 IN (2, 5) THEN 'Dispatched'
              WHEN k % 10 IN (1, 4) THEN 'Planned' END AS status FROM old),
            diff AS (SELECT CASE WHEN absent AND status IS NULL THEN 'missing_unplanned' WHEN absent AND status = 'Planned' THEN 'missing_planned'
                WHEN absent THEN 'verified_absent' WHEN status = 'Verified' THEN 'reappeared' WHEN status = 'Dispatched' THEN 'still_present'
                ELSE 'unchanged' END AS change FROM state
              UNION ALL SELECT 'new' FROM found f JOIN checked c USING (app, rule_no) WHERE c.problem IS NOT NULL)""") + """
            SELECT change AS what, count(*) AS records FROM diff GROUP BY change
            UNION ALL SELECT CASE change WHEN 'new' THEN 'New application records detected; existing plan cannot proceed.'
              WHEN 'missing_unplanned' THEN 'Retained or unrelated record disappeared; cleanup stopped.'
              WHEN 'missing_planned' THEN 'Unsubmitted target disappeared; external change detected.'
              ELSE 'Previously absent record reappeared; stopped.' END, count(*) FROM diff
              WHERE change IN ('new', 'missing_unplanned', 'missing_planned', 'reappeared') GROUP BY change
            UNION ALL SELECT problem, count(*) FROM checked WHERE problem IS NOT NULL GROUP BY problem""",
        "replacement_records": with_(RULE_SET) + """SELECT app, '' AS hash, false AS "isHashOnly", false AS "keyFile",
            concat('Consolidation r1 rule ', rule_rank) AS notes, path AS "fullPath", coalesce(process_path, '') AS "processPath",
            coalesce(certificate, '') AS cert FROM ranked""",
        "application_health": with_(SIZES, f"""live AS (SELECT {uuid_of('CAST(o_custkey AS varchar)')} AS application_id, count(*) AS live_records,
              count(*) FILTER (o_totalprice > 50000) AS live_hash_records,
              count(DISTINCT CASE WHEN o_totalprice > 50000 THEN o_orderpriority END) AS live_distinct_hashes
              FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey)""") + """
            SELECT s.application_id, application, reported_hashes, live_records, live_hash_records, live_distinct_hashes
            FROM sized s LEFT JOIN live USING (application_id)""",
        "consolidation_progress": """SELECT (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS rules_verified,
            count(*) FILTER (l_quantity < 25 AND l_linestatus = 'F') AS deletions_verified, count(*) AS targets FROM lineitem""",
        "overview": with_(REPORT, SIZES) + """SELECT (SELECT count(DISTINCT app) FROM last) AS applications, (SELECT count(*) FROM last) AS groups,
            (SELECT count(*) FROM sized WHERE reported_hashes > 1000) AS over_1000,
            (SELECT count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linestatus = 'F' AND s_nationkey <> 3) AS verified""",
        "selective_presence": with_(REC, REQUESTED, NOW) + """SELECT h.app, h.fid, h.hash FROM hit h
            WHERE EXISTS (SELECT 1 FROM rec_now n WHERE n.app = h.app AND n.id = h.id AND n.hash = h.hash)""",
    }

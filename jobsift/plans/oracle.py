"""DuckDB oracle: one SQL statement per registered query.

Rules and fixed values are stated here anew, not taken from the code they check; only the
fixture searches themselves (their terms, limits and result counts) come from the catalog.
Normalisation uses DuckDB's ``strip_accents``, the scan takes every posting of a cell in one
window, and the two-key de-duplication is the reference's sequential loop as a recursive CTE
walking rows in arrival order with two seen-lists. Base tables (documents, conversations,
events, pages) are the driver's pre-registered views.
"""

from __future__ import annotations

from jobsift.plans import catalog as C

AS_OF = "2024-02-01"
NL = "chr(10)"

# --- fixed values (must equal the reference, or FIXTURES.md) --------------------
STOP_WORDS = "de da do das dos em para com e o a analista pessoa pleno senior junior sr jr of and for in".split()
LOCATIONS = ["Brazil", "remote", " Remoto ", "Remote Ireland", " USA ", "uk", "United States", "irlanda"]
COUNTRIES = ["usa", "uk", "ireland", "brazil", "brazil", "brazil"]
JOB_TITLES = ["ther", "Ther thou", "de la", "thre", "Engenheiro", "erin, thon", "Que la", "thou and the"]
SKILLS = [("that", "hard"), ("ther", "hard"), ("thou", "hard"), ("thre", "hard"), ("thor", "hard"), ("thon", "hard"),
          ("erin", "domain"), ("eron", "domain"), ("then", "domain"), ("thea", "domain")]
LEVELS = [("tion", 1), ("erer", 2), ("than", 3)]
# White space as Python counts it.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# ---------------------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({x}, ''))), "
            r"'[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))")


def legacy_norm(x: str) -> str:
    return f"strip_accents(lower(coalesce({x}, '')))"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def tokens(tn: str) -> str:
    return f"list_filter(string_split({tn}, ' '), lambda t: NOT list_contains({sql_list(STOP_WORDS)}, t) AND length(t) > 2)"


def words(fw: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({fw}, ''), ','), lambda w: {norm('w')}), lambda w: w <> '')"


def padded(hay: str, needle: str) -> str:
    return f"contains(' ' || {hay} || ' ', ' ' || {needle} || ' ')"


# --- adapter views -------------------------------------------------------------

def _n() -> str:
    return "CAST(doc_id % 20 + 1 AS VARCHAR)"


POSTED_AT = f"(TIMESTAMP '{AS_OF}' - to_hours(CAST(doc_id % 720 AS BIGINT)))"

RAW_POSTINGS = f"""raw_postings AS (
  SELECT doc_id AS seq,
    CAST(0 AS INTEGER) AS source_no,
    split_part(text, {NL}, 1) AS title,
    source AS company,
    md5(text) AS job_url,
    text AS description,
    CASE WHEN doc_id % 5 = 0 THEN 'Remote ' || upper(lang) ELSE upper(lang) END AS location,
    {sql_list(COUNTRIES)}[doc_id % 6 + 1] AS country,
    doc_id % 7 = 0 AS is_remote,
    CASE doc_id % 4 WHEN 0 THEN 'LinkedIn' WHEN 1 THEN 'indeed' WHEN 2 THEN 'Glassdoor' ELSE 'other board' END AS site,
    CASE doc_id % 8
      WHEN 0 THEN {_n()} || ' days ago'
      WHEN 1 THEN {_n()} || ' semanas'
      WHEN 2 THEN {_n()} || ' meses'
      WHEN 3 THEN 'há ' || {_n()} || ' dias'
      WHEN 4 THEN strftime({POSTED_AT}, '%Y-%m-%d')
      WHEN 5 THEN strftime({POSTED_AT}, '%Y-%m-%dT%H:%M:%S')
      WHEN 6 THEN strftime({POSTED_AT}, '%d/%m/%Y')
      ELSE 'N/A' END AS date_posted,
    {POSTED_AT} AS posted_at
  FROM documents)"""

PAGE_POSTINGS = r"""page_postings AS (
  SELECT page_id AS seq,
    regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
    regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS company,
    url AS job_url,
    html AS description
  FROM pages)"""

UNION_SOURCES = """union_sources AS (
  SELECT CAST(0 AS INTEGER) AS source_no, seq, title, company, job_url FROM raw_postings
  UNION ALL
  SELECT CAST(1 AS INTEGER) AS source_no, seq, title, company, job_url FROM page_postings)"""

CV_PAGES = f"""cv_pages AS (
  SELECT conv_id AS cv_id, 0 AS file_no,
    'cv' || CAST(conv_id AS VARCHAR) || CASE WHEN conv_id % 5 = 0 THEN '.txt' WHEN conv_id % 2 = 0 THEN '.PDF' ELSE '.pdf' END AS file_name,
    CAST(turn AS INTEGER) AS page_no, text
  FROM conversations),
pdf_pages AS (SELECT * FROM cv_pages WHERE ends_with(lower(file_name), '.pdf')),
cv_concat AS (
  SELECT cv_id, string_agg(text || {NL} || {NL}, '' ORDER BY file_no, page_no, text) AS cv_text
  FROM pdf_pages GROUP BY cv_id),
uploads AS (
  SELECT u.cv_id, coalesce(c.cv_text, '') AS cv_text
  FROM (SELECT DISTINCT cv_id FROM cv_pages) u LEFT JOIN cv_concat c ON c.cv_id = u.cv_id),
upload_log AS (
  SELECT user_id, ts, event_id,
    CASE WHEN event_type = 'error' THEN 'clear' ELSE 'upload' END AS action,
    CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN '' ELSE props END AS text
  FROM events),
stored AS (
  SELECT user_id, text AS cv_text FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM upload_log WHERE action = 'clear' OR {py_strip("coalesce(text, '')")} <> '')
  WHERE rn = 1 AND action = 'upload'),
cv_eff AS (
  SELECT coalesce(u.cv_id, s.user_id) AS user_id,
    CASE WHEN u.cv_id IS NOT NULL THEN u.cv_text ELSE coalesce(s.cv_text, '') END AS cv_text,
    CASE WHEN u.cv_id IS NOT NULL THEN 'upload' WHEN s.cv_text IS NOT NULL THEN 'stored' ELSE 'none' END AS cv_origin
  FROM uploads u FULL OUTER JOIN stored s ON u.cv_id = s.user_id),
cvs AS (SELECT user_id, cv_text FROM cv_eff WHERE {py_strip("coalesce(cv_text, '')")} <> '')"""

COUNT = "CAST(10 + length(text) % 50 AS VARCHAR)"
SEARCH_REQUESTS = f"""search_requests AS (
  SELECT conv_id * 1000 + turn AS search_id, conv_id AS user_id,
    CASE WHEN turn % 7 = 3 THEN NULL ELSE {sql_list(JOB_TITLES)}[(conv_id * 3 + turn) % 8 + 1] END AS term_raw,
    CASE WHEN conv_id % 4 = 0 THEN NULL WHEN conv_id % 4 = 3 THEN 'alto' ELSE CAST(length(text) % 101 AS VARCHAR) END AS min_score_raw,
    CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 3 = 1 THEN '' ELSE 'the, and' END AS filter_words_raw,
    CASE WHEN (conv_id + turn) % 9 = 8 THEN NULL ELSE {sql_list(LOCATIONS)}[(conv_id + turn) % 8 + 1] END AS location_raw,
    CASE WHEN turn % 5 = 0 THEN NULL WHEN turn % 5 = 4 AND conv_id % 2 = 0 THEN '12x' WHEN turn % 5 = 4 THEN '-' || {COUNT} ELSE {COUNT} END AS results_wanted_raw,
    CASE WHEN conv_id % 6 = 0 THEN NULL ELSE CAST(24 * (1 + conv_id % 14) AS VARCHAR) END AS hours_old_raw,
    CASE WHEN conv_id % 4 = 1 THEN '' WHEN conv_id % 4 = 3 THEN split_part(text, {NL}, 1) ELSE NULL END AS google_term_raw
  FROM conversations WHERE role = 'user'),
searches AS (
  SELECT *, coalesce(min_score IS NOT NULL AND results_wanted >= 0 AND hours_old >= 0, false) AS form_ok
  FROM (SELECT search_id, user_id,
      coalesce(term_raw, 'Engenheiro') AS term,
      CASE WHEN min_score_raw IS NULL THEN 80 ELSE TRY_CAST(min_score_raw AS INTEGER) END AS min_score,
      coalesce(filter_words_raw, '') AS filter_words,
      coalesce(location_raw, 'Brazil') AS location,
      CASE WHEN results_wanted_raw IS NULL THEN 30 ELSE TRY_CAST(results_wanted_raw AS INTEGER) END AS results_wanted,
      CASE WHEN hours_old_raw IS NULL THEN 24 ELSE TRY_CAST(hours_old_raw AS INTEGER) END AS hours_old
    FROM search_requests)),
exp_replies AS (
  SELECT u.conv_id * 1000 + u.turn AS search_id, a.text AS reply
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'),
title_replies AS (
  SELECT conv_id * 1000 + turn AS search_id,
    {sql_list(JOB_TITLES)}[(conv_id * 3 + turn + 1) % 8 + 1] || ', ' || upper({sql_list(JOB_TITLES)}[(conv_id * 3 + turn + 3) % 8 + 1]) AS reply
  FROM conversations WHERE role = 'user' AND (conv_id + turn) % 3 <> 0)"""


def planning(searches: str = "searches", replies: str = "exp_replies") -> str:
    """A5-A12 in SQL over a searches CTE (typed, form_ok) and a replies CTE."""
    remote_exact = f"lower({py_strip('location')}) IN ('remote', 'remoto')"
    remote_any = "(contains(lower(location), 'remote') OR contains(lower(location), 'remoto'))"
    return f"""parsed AS (
  SELECT search_id, CAST(i - 1 AS INTEGER) AS pos, {py_strip('parts[i]')} AS term FROM (
    SELECT search_id, parts, unnest(generate_series(1, len(parts))) AS i
    FROM (SELECT search_id, string_split(coalesce(reply, ''), ',') AS parts FROM {replies}))
  WHERE {py_strip('parts[i]')} <> ''),
expanded AS (
  SELECT search_id, CAST(-1 AS INTEGER) AS pos, term FROM {searches} WHERE form_ok
  UNION ALL
  SELECT search_id, pos, term FROM parsed WHERE search_id IN (SELECT search_id FROM {searches} WHERE form_ok)),
firsts AS (SELECT search_id, lower(term) AS k, min(pos) AS pos FROM expanded GROUP BY search_id, lower(term)),
terms_all AS (
  SELECT e.search_id, CAST(row_number() OVER (PARTITION BY e.search_id ORDER BY e.pos) - 1 AS INTEGER) AS term_no, e.term
  FROM expanded e JOIN firsts f ON f.search_id = e.search_id AND f.pos = e.pos),
expanded_no AS (
  SELECT search_id, CAST(row_number() OVER (PARTITION BY search_id ORDER BY pos) - 1 AS INTEGER) AS term_no, term FROM expanded),
terms AS (SELECT * FROM terms_all WHERE term_no < 5),
quotas AS (
  SELECT s.search_id, CAST(n.n_terms AS INTEGER) AS n_terms,
    CAST(greatest(10, s.results_wanted // n.n_terms) AS INTEGER) AS quota, s.location
  FROM {searches} s JOIN (SELECT search_id, count(*) AS n_terms FROM terms GROUP BY search_id) n ON n.search_id = s.search_id
  WHERE s.form_ok),
locs AS (
  SELECT search_id, CAST(loc_no AS INTEGER) AS loc_no, loc, remote_search, CAST(loc_quota AS INTEGER) AS loc_quota FROM (
    SELECT search_id,
      unnest(CASE WHEN {remote_exact} THEN ['USA', 'UK', 'Ireland'] ELSE [location] END) AS loc,
      unnest(CASE WHEN {remote_exact} THEN [0, 1, 2] ELSE [0] END) AS loc_no,
      ({remote_exact} OR {remote_any}) AS remote_search,
      CASE WHEN {remote_exact} THEN greatest(10, quota // 3) ELSE quota END AS loc_quota
    FROM quotas)),
countries AS (
  SELECT *, CASE
      WHEN lower(loc) IN ('usa', 'eua', 'us', 'united states') THEN 'usa'
      WHEN lower(loc) IN ('uk', 'united kingdom') THEN 'uk'
      WHEN lower(loc) IN ('ireland', 'irlanda') THEN 'ireland'
      ELSE 'brazil' END AS country
  FROM locs),
grid AS (
  SELECT t.search_id, t.term_no, t.term, c.loc_no, c.loc, c.country, c.remote_search, c.loc_quota AS quota
  FROM terms t JOIN countries c ON c.search_id = t.search_id)"""


def spec_values(specs, unlimited: bool = False) -> str:
    rows = []
    for i, s in enumerate(specs):
        rw = "NULL" if s.results_wanted is None else str(int(s.results_wanted))
        ho = "NULL" if s.hours_old is None else str(int(s.hours_old))
        rows.append(f"({i + 1}, {q(s.term)}, {q(s.filter_words)}, {q(s.location)}, {rw}, {ho}, {int(s.min_score)}, true)")
    return ("spec_searches AS (SELECT CAST(search_id AS BIGINT) AS search_id, term, filter_words, location, "
            "CAST(results_wanted AS INTEGER) AS results_wanted, CAST(hours_old AS INTEGER) AS hours_old, "
            "CAST(min_score AS INTEGER) AS min_score, form_ok FROM (VALUES " + ", ".join(rows) +
            ") v(search_id, term, filter_words, location, results_wanted, hours_old, min_score, form_ok))")


NO_REPLIES = "spec_replies AS (SELECT CAST(NULL AS BIGINT) AS search_id, CAST(NULL AS VARCHAR) AS reply WHERE false)"


def spec_intake(specs, replies_sql: str = NO_REPLIES) -> str:
    return f"{spec_values(specs)},\n{replies_sql},\n{intake('spec_searches', 'spec_replies')}"


def intake(searches: str, replies: str) -> str:
    """Grid, scan with quota, flags, sequential walk; CTEs grid, scan, flags, labelled."""
    return f"""{planning(searches, replies)},
grid_p AS (
  SELECT g.*, CASE WHEN s.results_wanted IS NULL THEN NULL ELSE g.quota END AS q_eff, s.hours_old, s.filter_words,
    {norm('g.term')} AS term_norm
  FROM grid g JOIN {searches} s ON s.search_id = g.search_id),
grid_t AS (SELECT *, {tokens('term_norm')} AS tokens, {words('filter_words')} AS words FROM grid_p),
normed_postings AS (
  SELECT *, {norm('title')} AS title_norm, {norm('company')} AS company_norm, {norm('description')} AS desc_norm
  FROM raw_postings WHERE lower(site) IN ('linkedin', 'indeed', 'glassdoor')),
term_hits AS (
  SELECT r.seq, t.term_norm FROM (SELECT DISTINCT term_norm, tokens FROM grid_t) t JOIN normed_postings r
    ON len(list_filter(t.tokens, lambda x: contains(r.title_norm, x))) > 0
    OR (CASE WHEN t.term_norm = '' THEN r.desc_norm <> '' ELSE {padded('r.desc_norm', 't.term_norm')} END)),
scan AS (
  SELECT g.search_id, g.term_no, g.loc_no, g.remote_search, g.term, g.term_norm, g.tokens, g.words, r.*
  FROM grid_t g JOIN term_hits h ON h.term_norm = g.term_norm JOIN normed_postings r ON r.seq = h.seq
   AND r.country = g.country
   AND (g.hours_old IS NULL OR r.posted_at >= TIMESTAMP '{AS_OF}' - to_hours(CAST(g.hours_old AS BIGINT)))
   AND (NOT g.remote_search OR coalesce(r.is_remote, false))
  QUALIFY g.q_eff IS NULL OR row_number() OVER (PARTITION BY g.search_id, g.term_no, g.loc_no ORDER BY r.seq) <= g.q_eff),
{flag_rows('scan')},
{walk()}"""


def flags(src: str) -> str:
    return f"""normed AS (
  SELECT *, {norm('title')} AS title_norm, {norm('company')} AS company_norm, {norm('description')} AS desc_norm FROM {src}),
{flag_rows('normed')}"""


def flag_rows(src: str) -> str:
    return f"""flags AS (
  SELECT *, job_url AS link, title_norm || company_norm AS fingerprint,
    (title IS NOT NULL AND title <> '' AND job_url IS NOT NULL AND job_url <> '') AS valid,
    list_filter(words, lambda w: NOT contains(title_norm, w) AND NOT contains(desc_norm, w))[1] AS missing_word,
    len(list_filter(tokens, lambda t: contains(title_norm, t))) > 0 AS in_title,
    CASE WHEN term_norm = '' THEN desc_norm <> '' ELSE {padded('desc_norm', 'term_norm')} END AS in_desc
  FROM {src})"""


def walk() -> str:
    """The reference's loop: rows in (loc_no, seq) order per (search_id, term_no)."""
    return """ordered AS (
  SELECT search_id, term_no, loc_no, seq, title, company, link, fingerprint, valid, missing_word, in_title, in_desc,
    row_number() OVER (PARTITION BY search_id, term_no ORDER BY loc_no, seq) AS rn
  FROM flags),
walk AS (
  SELECT search_id, term_no, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS links, CAST([] AS VARCHAR[]) AS fps,
    CAST(NULL AS VARCHAR) AS disposition
  FROM (SELECT DISTINCT search_id, term_no FROM ordered)
  UNION ALL
  SELECT search_id, term_no, rn,
    CASE WHEN d = 'approved' THEN list_append(links, link) ELSE links END,
    CASE WHEN d = 'approved' THEN list_append(fps, fingerprint) ELSE fps END,
    d
  FROM (
    SELECT w.search_id, w.term_no, o.rn, w.links, w.fps, o.link, o.fingerprint,
      CASE WHEN NOT o.valid THEN 'rejected_invalid'
           WHEN list_contains(w.links, o.link) THEN 'duplicated_link'
           WHEN list_contains(w.fps, o.fingerprint) THEN 'duplicated_fingerprint'
           WHEN o.missing_word IS NOT NULL THEN 'rejected_missing_keyword'
           WHEN NOT (o.in_title OR o.in_desc) THEN 'rejected_strict_relevance'
           ELSE 'approved' END AS d
    FROM walk w JOIN ordered o ON o.search_id = w.search_id AND o.term_no = w.term_no AND o.rn = w.rn + 1)),
labelled AS (
  SELECT o.*, w.disposition FROM ordered o
  JOIN walk w ON w.search_id = o.search_id AND w.term_no = o.term_no AND w.rn = o.rn)"""


def single(term: str, filter_words: str) -> str:
    """Every posting under one search (search 1, term 0, location 0) with its flags."""
    return f"""single_src AS (
  SELECT CAST(1 AS BIGINT) AS search_id, 0 AS term_no, 0 AS loc_no, r.*,
    {norm(q(term))} AS term_norm, {tokens(norm(q(term)))} AS tokens, {words(q(filter_words))} AS words
  FROM raw_postings r),
{flags('single_src')}"""


# --- date expressions --------------------------------------------------------------

DAYS = r"(\d+)\s*(d|dia|day)s?"
WEEKS = r"(\d+)\s*(w|sem|semana|week)s?"
MONTHS = r"(\d+)\s*(m|mes|month|mês)s?"
IMMEDIATE = ("seg", "sec", "second", "segundo", "min", "minuto", "minute", "h", "hora", "hour", "hr",
             "agora", "now", "today", "hoje", "just now")


def _shift(text: str, pattern: str, unit: int) -> str:
    n = f"TRY_CAST(regexp_extract({text}, {q(pattern)}, 1) AS BIGINT)"
    room = f"date_diff('day', DATE '0001-01-01', DATE '{AS_OF}')"
    return f"CASE WHEN {n} IS NOT NULL AND {n} <= floor({room} / {unit}) THEN DATE '{AS_OF}' - CAST({n} * {unit} AS INTEGER) END"


def rel_parts(raw: str) -> tuple[str, str, str]:
    """(no_date, matched, date) like the Spark helper."""
    text = f"regexp_replace(lower({py_strip(raw)}), '{SPACE}+', ' ', 'g')"
    no_date = f"({raw} IS NULL OR lower({raw}) IN ('none', 'nan', 'n/a', ''))"
    imm = "(" + " OR ".join(f"contains({text}, {q(w)})" for w in IMMEDIATE) + ")"
    hd, hw, hm = (f"regexp_matches({text}, {q(p)})" for p in (DAYS, WEEKS, MONTHS))
    matched = f"(NOT {no_date} AND ({imm} OR {hd} OR {hw} OR {hm}))"
    date = (f"CASE WHEN {no_date} THEN NULL WHEN {imm} THEN DATE '{AS_OF}' "
            f"WHEN {hd} THEN {_shift(text, DAYS, 1)} WHEN {hw} THEN {_shift(text, WEEKS, 7)} "
            f"WHEN {hm} THEN {_shift(text, MONTHS, 30)} END")
    return no_date, matched, date


def rel_date(raw: str) -> str:
    _, _, d = rel_parts(raw)
    return f"strftime({d}, '%d/%m/%Y')"


def format_date(raw: str) -> str:
    s = py_strip(raw)
    missing = f"({raw} IS NULL OR lower({raw}) IN ('none', 'nan', 'n/a', ''))"
    iso = rf"try_strptime(regexp_extract({s}, '^(\d{{4}}-\d{{2}}-\d{{2}})', 1), '%Y-%m-%d')"
    _, matched, d = rel_parts(s)
    return (f"CASE WHEN {missing} THEN 'N/A' "
            rf"WHEN regexp_matches({s}, '^(\d{{4}}-\d{{2}}-\d{{2}})') THEN coalesce(strftime({iso}, '%d/%m/%Y'), 'N/A') "
            rf"WHEN regexp_matches({s}, '^\d{{2}}/\d{{2}}/\d{{4}}') THEN {s} "
            f"WHEN {matched} THEN coalesce(strftime({d}, '%d/%m/%Y'), 'N/A') "
            f"ELSE substring({s}, 1, 10) END")


def format_date_legacy(raw: str) -> str:
    word = f"list_filter(regexp_split_to_array(split_part({raw}, 'T', 1), '{SPACE}+'), lambda w: w <> '')[1]"
    pat = r"^(\d{4})-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12]\d|0[1-9]|[1-9])$"
    iso = (rf"regexp_extract({word}, '^(\d{{4}})-', 1) || '-' || lpad(regexp_extract({word}, '^\d{{4}}-(\d{{1,2}})-', 1), 2, '0') "
           rf"|| '-' || lpad(regexp_extract({word}, '-(\d{{1,2}})$', 1), 2, '0')")
    parsed = f"CASE WHEN regexp_matches({word}, {q(pat)}) THEN try_strptime({iso}, '%Y-%m-%d') END"
    return (f"CASE WHEN {raw} IS NULL OR {raw} = '' OR lower({raw}) = 'none' THEN 'N/A' "
            f"WHEN {word} IS NOT NULL AND contains({word}, '-') AND {parsed} IS NOT NULL THEN strftime({parsed}, '%d/%m/%Y') "
            f"ELSE {raw} END")


def remote_location(loc: str, remote_search: str, is_remote: str) -> str:
    l = f"coalesce({loc}, 'Not provided')"
    return (f"CASE WHEN (coalesce({remote_search}, false) OR coalesce({is_remote}, false)) "
            f"AND NOT contains(lower({l}), 'remote') THEN 'Remote, ' || {l} ELSE {l} END")


def projection(src: str, remote_search: str) -> str:
    """G1 columns of rows of ``src`` (an alias)."""
    a = src + "."
    return f"""{a}seq, {a}title, coalesce({a}company, '') AS company,
    {remote_location(a + 'location', remote_search, a + 'is_remote')} AS location,
    {a}job_url AS link,
    CASE WHEN {a}description IS NULL OR {a}description = '' THEN 'Detailed description available on the source link.' ELSE {a}description END AS description,
    lower(coalesce({a}site, 'unknown')) AS source,
    {format_date(a + 'date_posted')} AS published_at"""


# --- replies ---------------------------------------------------------------------------

REPLIES_SRC = """replies AS (
  SELECT CAST(doc_id % 3 + 1 AS BIGINT) AS search_id, doc_id AS seq,
    CASE WHEN doc_id % 8 = 0 THEN '{"score": ' || CAST(n_chars % 101 AS VARCHAR) || ', "rationale": "ok ' || source || '"}'
         WHEN doc_id % 8 = 1 THEN '{"score": ' || CAST(n_chars % 101 AS VARCHAR) || '.5}'
         WHEN doc_id % 8 = 2 THEN 'not json'
         WHEN doc_id % 8 = 3 AND doc_id % 3 = 0 THEN '[1, 2]'
         WHEN doc_id % 8 = 3 THEN '{"score": ' || CAST(n_chars % 101 AS VARCHAR) || '}'
         WHEN doc_id % 8 = 4 THEN '{"rationale": "sem nota"}'
         WHEN doc_id % 8 = 5 THEN '{"score": null, "rationale": "nula"}'
         WHEN doc_id % 8 = 6 THEN '{"score": "' || CAST(n_chars % 101 AS VARCHAR) || '"}'
         ELSE NULL END AS reply,
    CASE WHEN doc_id % 8 = 7 AND doc_id % 3 = 0 THEN 'Error code: 429 - Too Many Requests'
         WHEN doc_id % 8 = 7 THEN 'connection reset' END AS error
  FROM documents)"""


def parsed(src: str, name: str, keys: str) -> str:
    """H3-H5 over a replies CTE, and ``<name>_kept`` after H6."""
    return f"""{name} AS (
  SELECT {keys}, status,
    CASE WHEN status = 'error' THEN 0.0 WHEN status <> 'ok' THEN NULL
         WHEN NOT json_exists(j, '$.score') THEN 0.0
         WHEN json_type(j, '$.score') = 'BOOLEAN' THEN CASE WHEN json_extract_string(j, '$.score') = 'true' THEN 1.0 ELSE 0.0 END
         ELSE CAST(json_extract_string(j, '$.score') AS DOUBLE) END AS score,
    CASE WHEN status = 'error' THEN 'Falha ao gerar avaliação devido a um erro na IA.' WHEN status <> 'ok' THEN NULL
         WHEN NOT json_exists(j, '$.rationale') THEN 'Sem justificativa.'
         ELSE json_extract_string(j, '$.rationale') END AS rationale
  FROM (SELECT *,
    CASE WHEN error IS NOT NULL AND (contains(lower(error), '429') OR contains(lower(error), 'rate limit') OR contains(lower(error), 'too many requests')) THEN 'abort'
         WHEN error IS NOT NULL OR reply IS NULL OR NOT json_valid(reply) THEN 'error'
         WHEN json_type(j) <> 'OBJECT' THEN 'abort'
         WHEN json_exists(j, '$.score') AND json_type(j, '$.score') NOT IN ('NULL', 'BOOLEAN', 'BIGINT', 'UBIGINT', 'DOUBLE', 'INTEGER', 'HUGEINT') THEN 'non_numeric'
         ELSE 'ok' END AS status
    FROM (SELECT *, CASE WHEN json_valid(reply) THEN reply END AS j FROM {src}))),
{name}_kept AS (
  SELECT * FROM {name} WHERE search_id NOT IN (SELECT search_id FROM {name} WHERE status = 'abort'))"""


REPLIES = REPLIES_SRC + ",\n" + parsed("replies", "parsed_replies", "search_id, seq")


# --- scoring ------------------------------------------------------------------------------

def _dictionary() -> str:
    sk = ", ".join(f"({q(s)}, {q(k)})" for s, k in SKILLS)
    lv = ", ".join(f"({q(w)}, {v})" for w, v in LEVELS)
    return f"skills AS (SELECT * FROM (VALUES {sk}) v(skill, kind)), levels AS (SELECT * FROM (VALUES {lv}) v(word, lvl))"


def batch() -> str:
    """Every accepted search of a user with a CV: intake, projection, first results_wanted."""
    return f"""{CV_PAGES},
{SEARCH_REQUESTS},
mine AS (SELECT s.* FROM searches s WHERE s.user_id IN (SELECT user_id FROM cvs)),
{intake('mine', 'title_replies')},
projected AS (
  SELECT s.search_id, s.term_no, s.loc_no, s.source_no, {projection('s', 's.remote_search')}, p.user_id, p.results_wanted, p.min_score
  FROM scan s JOIN labelled a ON a.search_id = s.search_id AND a.term_no = s.term_no AND a.loc_no = s.loc_no AND a.seq = s.seq
  JOIN mine p ON p.search_id = s.search_id
  WHERE a.disposition = 'approved'),
top AS (
  SELECT * FROM projected
  QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY term_no, loc_no, seq) <= results_wanted),
job_text AS (
  SELECT DISTINCT r.seq, CASE WHEN r.description IS NOT NULL AND length(r.description) > 50 THEN r.description ELSE r.title END AS job_text
  FROM top t JOIN raw_postings r ON r.seq = t.seq)"""


def _table_skills(key: str, texts: str) -> str:
    return f"""SELECT DISTINCT g.{key}, k.skill, k.kind
  FROM (SELECT {key}, w[i] || ' ' || w[i + 1] AS skill FROM (SELECT {key}, w, unnest(range(1, len(w))) AS i FROM (SELECT {key}, string_split(n, ' ') AS w FROM {texts}))) g
  JOIN skill_table k ON k.skill = g.skill"""


SKILL_TABLE = f"""skill_table AS (
  SELECT skill, CASE WHEN length(skill) % 2 = 0 THEN 'hard' ELSE 'domain' END AS kind
  FROM (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS skill
    FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT string_split({norm('text')}, ' ') AS w FROM conversations))))"""


def scored(skills: str = "", cv_skills: str = "", job_skills: str = "") -> str:
    """The batch with the rubric of each listed posting against its user's CV."""
    cv_skills = cv_skills or f"SELECT c.cv_id, k.skill, k.kind FROM cv_norm c JOIN skills k ON {padded('c.n', 'k.skill')}"
    job_skills = job_skills or f"SELECT j.job_id, k.skill, k.kind FROM job_norm j JOIN skills k ON {padded('j.n', 'k.skill')}"
    return f"""{batch()},
{_dictionary()},{skills}
cv_norm AS (SELECT user_id AS cv_id, {norm("substring(coalesce(cv_text, ''), 1, 15000)")} AS n FROM cvs),
job_norm AS (SELECT seq AS job_id, {norm('job_text')} AS n FROM job_text),
cv_sk AS ({cv_skills}),
job_sk AS ({job_skills}),
cv_lv AS (SELECT c.cv_id, coalesce(max(l.lvl), 0) AS lvl FROM cv_norm c LEFT JOIN levels l ON {padded('c.n', 'l.word')} GROUP BY c.cv_id),
job_lv AS (SELECT j.job_id, coalesce(max(l.lvl), 0) AS lvl FROM job_norm j LEFT JOIN levels l ON {padded('j.n', 'l.word')} GROUP BY j.job_id),
uniq_pairs AS (SELECT DISTINCT user_id AS cv_id, seq AS job_id FROM top),
parts AS (
  SELECT p.cv_id, p.job_id,
    count(*) FILTER (WHERE js.kind = 'hard') AS need_hard,
    count(*) FILTER (WHERE js.kind = 'domain') AS need_domain,
    count(*) FILTER (WHERE js.kind = 'hard' AND cs.skill IS NOT NULL) AS got_hard,
    count(*) FILTER (WHERE js.kind = 'domain' AND cs.skill IS NOT NULL) AS got_domain
  FROM uniq_pairs p
  LEFT JOIN job_sk js ON js.job_id = p.job_id
  LEFT JOIN cv_sk cs ON cs.cv_id = p.cv_id AND cs.skill = js.skill
  GROUP BY p.cv_id, p.job_id),
components AS (
  SELECT p.cv_id, p.job_id,
    CAST(CASE WHEN need_hard = 0 THEN 40 ELSE 40 * got_hard // need_hard END AS INTEGER) AS hard,
    CAST(40 - 20 * least(greatest(0, coalesce(jl.lvl, 0) - coalesce(cl.lvl, 0)), 2) AS INTEGER) AS level,
    CAST(CASE WHEN need_domain = 0 THEN 20 ELSE 20 * got_domain // need_domain END AS INTEGER) AS domain
  FROM parts p LEFT JOIN cv_lv cl ON cl.cv_id = p.cv_id LEFT JOIN job_lv jl ON jl.job_id = p.job_id),
rubric AS (
  SELECT cv_id, job_id, hard, level, domain, hard + level + domain AS score,
    CASE WHEN hard <= level AND hard <= domain * 2 THEN 'Maior lacuna: competencias tecnicas.'
         WHEN level <= domain * 2 THEN 'Maior lacuna: nivel de experiencia.'
         ELSE 'Maior lacuna: conhecimento de dominio.' END AS rationale
  FROM components),
scored_pairs AS (
  SELECT p.*, r.hard, r.level, r.domain, r.score, r.rationale,
    coalesce(r.score IS NOT NULL AND r.score <> 0 AND r.score >= p.min_score, false) AS passed
  FROM top p JOIN rubric r ON r.cv_id = p.user_id AND r.job_id = p.seq)"""


ANSWERS = """answers AS (
  SELECT DISTINCT search_id, seq,
    CASE WHEN search_id % 7 = 0 AND (search_id + seq) % 5 = 0 THEN '[1, 2]'
         WHEN (search_id + seq) % 6 = 0 THEN '{"score": ' || CAST((search_id + seq) % 101 AS VARCHAR) || ', "rationale": "ok"}'
         WHEN (search_id + seq) % 6 = 1 THEN '{"score": ' || CAST((search_id + seq) % 101 AS VARCHAR) || '.5}'
         WHEN (search_id + seq) % 6 = 2 THEN 'not json'
         WHEN (search_id + seq) % 6 = 3 THEN '{"score": true, "rationale": "sim"}'
         WHEN (search_id + seq) % 6 = 4 THEN '{"score": null}' END AS reply,
    CASE WHEN search_id % 7 = 0 AND (search_id + seq) % 5 = 1 THEN 'Rate limit reached' WHEN (search_id + seq) % 6 = 5 THEN 'timeout' END AS error
  FROM top)"""


def w(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


SINGLE = single(C.TERM, C.KEYWORDS)


def _scope_replies() -> str:
    return f"spec_replies AS (SELECT CAST(1 AS BIGINT) AS search_id, {q(C.TERM2)} AS reply)"


ALL_SPECS = (*C.SPECS, C.UNLIMITED)
SCOPE_SPECS = (C.L.SearchSpec(C.TERM, C.KEYWORDS, "remote", None, None, 0),)
SINGLE_SPEC = (C.L.SearchSpec(C.TERM, C.KEYWORDS, "Brazil", None, None, 0),)

ORACLE: dict[str, str] = {}

# A: sources and planning
ORACLE["posting_scan"] = w(RAW_POSTINGS, spec_intake(ALL_SPECS)) + "SELECT search_id, term_no, loc_no, source_no, seq FROM scan"
ORACLE["union_sources"] = w(RAW_POSTINGS, PAGE_POSTINGS, UNION_SOURCES) + "SELECT * FROM union_sources"
ORACLE["source_isolation"] = w(RAW_POSTINGS, PAGE_POSTINGS) + (
    "SELECT seq, title, company, job_url, 0 AS source_no, 3 AS skipped FROM raw_postings "
    "UNION ALL SELECT seq, title, company, job_url, 1 AS source_no, 3 AS skipped FROM page_postings "
    "UNION ALL SELECT seq, title, company, job_url, 2 AS source_no, 3 AS skipped FROM page_postings")
ORACLE["expanded_scan"] = w(RAW_POSTINGS, SEARCH_REQUESTS, intake("searches", "exp_replies")) + "SELECT search_id, term_no, loc_no, source_no, seq FROM scan"
DAY_SPECS = (C.L.SearchSpec(C.TERM, "", "Brazil", 30, 72, 0), C.L.SearchSpec(C.TERM2, "", "uk", None, 48, 0))
ORACLE["day_limited_scan"] = w(RAW_POSTINGS, spec_intake(DAY_SPECS)) + (
    "SELECT search_id, term_no, loc_no, source_no, seq, title, country, posted_at FROM scan")
ORACLE["expand_terms"] = w(SEARCH_REQUESTS, planning()) + "SELECT search_id, term_no, term FROM expanded_no"
ORACLE["parse_term_list"] = w(SEARCH_REQUESTS, planning()) + "SELECT search_id, pos, term FROM parsed"
ORACLE["distinct_terms_ordered"] = w(SEARCH_REQUESTS, planning()) + "SELECT search_id, term_no, term FROM terms_all"
ORACLE["cap_terms"] = w(SEARCH_REQUESTS, planning()) + "SELECT search_id, term_no, term FROM terms"
ORACLE["term_quota"] = w(SEARCH_REQUESTS, planning()) + "SELECT search_id, n_terms, quota FROM quotas"
ORACLE["expand_locations"] = w(SEARCH_REQUESTS, planning()) + "SELECT search_id, loc_no, loc, remote_search, loc_quota FROM locs"
ORACLE["resolve_country"] = w(SEARCH_REQUESTS, planning()) + "SELECT search_id, loc_no, loc, country FROM countries"
ORACLE["search_grid"] = w(SEARCH_REQUESTS, planning()) + (
    "SELECT search_id, term_no, term, loc_no, loc, country, remote_search, quota FROM grid")
ORACLE["default_phrase"] = w(SEARCH_REQUESTS) + (
    "SELECT s.search_id, CASE WHEN r.google_term_raw IS NOT NULL AND r.google_term_raw <> '' THEN r.google_term_raw "
    "ELSE 'vagas de ' || s.term || ' em ' || s.location END AS phrase "
    "FROM searches s JOIN search_requests r ON r.search_id = s.search_id")
ORACLE["form_defaults"] = w(SEARCH_REQUESTS) + "SELECT * FROM searches"

# B: CV intake
ORACLE["cv_concat"] = w(CV_PAGES) + "SELECT cv_id, cv_text FROM cv_concat"
ORACLE["cv_file_filter"] = w(CV_PAGES) + "SELECT cv_id, file_name, page_no FROM pdf_pages"
ORACLE["cv_effective"] = w(CV_PAGES) + "SELECT user_id, cv_text, cv_origin FROM cv_eff"
ORACLE["cv_required"] = w(CV_PAGES) + "SELECT user_id, cv_text FROM cvs"
ORACLE["cv_store_update"] = w(CV_PAGES) + "SELECT user_id, cv_text FROM stored"
ORACLE["cv_store_batches"] = ORACLE["cv_store_update"]

# C: text scalars
ORACLE["normalize_text"] = w(RAW_POSTINGS) + (
    f"SELECT seq, {norm('title')} AS title_norm, {norm('company')} AS company_norm, {norm('description')} AS desc_norm FROM raw_postings")
ORACLE["normalize_text_legacy"] = w(RAW_POSTINGS) + (
    f"SELECT seq, {legacy_norm('title')} AS title_legacy, {legacy_norm('description')} AS desc_legacy FROM raw_postings")
ORACLE["fingerprint"] = w(RAW_POSTINGS) + f"SELECT seq, {norm('title')} || {norm('company')} AS fingerprint FROM raw_postings"
ORACLE["term_tokens"] = w(RAW_POSTINGS) + f"SELECT seq, array_to_string({tokens(norm('title'))}, ' ') AS tokens FROM raw_postings"
ORACLE["required_words"] = (
    f"SELECT doc_id AS seq, array_to_string({words('text')}, '|') AS words FROM documents")
ORACLE["truncate_cv"] = "SELECT doc_id AS cv_id, substring(coalesce(text, ''), 1, 15000) AS cv_text FROM documents"
ORACLE["source_lower"] = w(RAW_POSTINGS) + "SELECT seq, lower(coalesce(site, 'unknown')) AS source FROM raw_postings"
SCORING_TEXT = "CASE WHEN description IS NOT NULL AND length(description) > 50 THEN description ELSE title END"
ORACLE["scoring_text"] = w(RAW_POSTINGS) + f"SELECT seq, {SCORING_TEXT} AS job_text FROM raw_postings"
ORACLE["request_text"] = w(RAW_POSTINGS, batch()) + (
    f"SELECT t.user_id, t.search_id, t.term_no, t.loc_no, t.seq, '--- CANDIDATE CV ---' || {NL} || substring(coalesce(c.cv_text, ''), 1, 15000) "
    f"|| {NL} || {NL} || '--- TARGET JOB DESCRIPTION ---' || {NL} || coalesce(j.job_text, '') AS body "
    "FROM top t JOIN job_text j ON j.seq = t.seq JOIN cvs c ON c.user_id = t.user_id")

# D: filters
ORACLE["valid_posting"] = w(RAW_POSTINGS, PAGE_POSTINGS, UNION_SOURCES) + (
    "SELECT source_no, seq, (title IS NOT NULL AND title <> '' AND job_url IS NOT NULL AND job_url <> '') AS valid FROM union_sources")
ORACLE["required_keywords"] = w(RAW_POSTINGS, SINGLE) + (
    "SELECT seq, len(list_filter(words, lambda w: NOT (contains(title_norm, w) OR contains(desc_norm, w)))) = 0 AS kw_ok FROM flags")
ORACLE["first_missing_keyword"] = w(RAW_POSTINGS, single(C.TERM, "thou, thre")) + "SELECT seq, missing_word FROM flags"
ORACLE["title_any_token"] = w(RAW_POSTINGS, single(C.TERM2, "")) + "SELECT seq, in_title FROM flags"
ORACLE["desc_whole_phrase"] = w(RAW_POSTINGS, single(C.TERM3, "")) + "SELECT seq, in_desc FROM flags"
ORACLE["relevance"] = w(RAW_POSTINGS, single(C.TERM, "")) + "SELECT seq, title FROM flags WHERE in_title OR in_desc"
_FW = "(" + "|".join(C.FIXTURE_WORDS) + ")"
LEGACY_FLAGS = f"""legacy AS (
  SELECT seq, tl, dl,
    regexp_matches(tl, {q(_FW + SPACE + '+' + C.TERM)}) AS excluded,
    regexp_matches(dl, {q(_FW + chr(91) + '^' + chr(92) + 'n]{0,50}' + C.TERM)}) AS degree,
    regexp_matches(dl, {q(_FW + chr(91) + '^' + chr(92) + 'n]{0,20}' + C.TERM)}) AS benefit
  FROM (SELECT seq, {legacy_norm('title')} AS tl, {legacy_norm('description')} AS dl FROM raw_postings))"""
ORACLE["role_modifier_exclusion"] = w(RAW_POSTINGS, LEGACY_FLAGS) + "SELECT seq, excluded FROM legacy"
ORACLE["degree_proximity"] = w(RAW_POSTINGS, LEGACY_FLAGS) + "SELECT seq, degree FROM legacy"
ORACLE["benefit_proximity"] = w(RAW_POSTINGS, LEGACY_FLAGS) + "SELECT seq, benefit FROM legacy"
ORACLE["legacy_approval"] = w(RAW_POSTINGS, LEGACY_FLAGS) + (
    f"SELECT seq, NOT excluded AND (contains(tl, {q(C.TERM)}) OR degree) AS approved FROM legacy")
ORACLE["score_threshold"] = w(REPLIES) + (
    f"SELECT search_id, seq, coalesce(score IS NOT NULL AND score <> 0 AND score >= {C.REPLY_MIN_SCORE}, false) AS passed FROM parsed_replies")
ORACLE["recency"] = w(RAW_POSTINGS) + f"SELECT seq, posted_at FROM raw_postings WHERE posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR"

# E: de-duplication
ORACLE["dedup_link"] = w(RAW_POSTINGS, SINGLE) + "SELECT seq, link FROM flags QUALIFY row_number() OVER (PARTITION BY link ORDER BY seq) = 1"
ORACLE["dedup_fingerprint"] = w(RAW_POSTINGS, SINGLE) + (
    "SELECT seq, fingerprint FROM flags QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY seq) = 1")
ORACLE["dedup_two_key"] = w(RAW_POSTINGS, SINGLE, walk()) + "SELECT seq, link, fingerprint FROM labelled WHERE disposition = 'approved'"
ORACLE["dedup_scope"] = w(RAW_POSTINGS, spec_intake(SCOPE_SPECS, _scope_replies())) + (
    "SELECT term_no, loc_no, seq FROM labelled WHERE disposition = 'approved'")
ORACLE["dedup_batches"] = w(RAW_POSTINGS, spec_intake(SCOPE_SPECS, _scope_replies())) + "SELECT term_no, loc_no, seq, disposition FROM labelled"
ORACLE["disposition"] = w(RAW_POSTINGS, SINGLE, walk()) + "SELECT seq, disposition FROM labelled"

# F: dates
ORACLE["relative_date"] = w(RAW_POSTINGS) + f"SELECT seq, {rel_date('date_posted')} AS rel_date FROM raw_postings"
ORACLE["format_date"] = w(RAW_POSTINGS) + f"SELECT seq, {format_date('date_posted')} AS published_at FROM raw_postings"
ORACLE["format_date_legacy"] = w(RAW_POSTINGS) + f"SELECT seq, {format_date_legacy('date_posted')} AS published_legacy FROM raw_postings"
ORACLE["created_stamp"] = w(RAW_POSTINGS) + f"SELECT seq, strftime(DATE '{AS_OF}', '%d/%m/%Y') AS created_at FROM raw_postings"

# G: projections
_L2 = w(RAW_POSTINGS, spec_intake(SINGLE_SPEC)) + (
    "SELECT " + projection("s", "s.remote_search") + " FROM scan s "
    "JOIN labelled l ON l.search_id = s.search_id AND l.term_no = s.term_no AND l.loc_no = s.loc_no AND l.seq = s.seq "
    "WHERE l.disposition = 'approved'")
ORACLE["posting_projection"] = _L2
ORACLE["remote_location"] = w(RAW_POSTINGS) + f"SELECT seq, {remote_location('location', 'false', 'is_remote')} AS location FROM raw_postings"
_G3 = ("SELECT seq, title, company, location, job_url AS link, "
       "CASE WHEN description IS NULL OR description = '' THEN 'Detalhes no link.' ELSE description END AS description, "
       f"lower(coalesce(site, 'none')) AS source, {format_date_legacy('date_posted')} AS published_at, "
       f"strftime(DATE '{AS_OF}', '%d/%m/%Y') AS created_at FROM raw_postings")
ORACLE["posting_projection_legacy"] = w(RAW_POSTINGS) + _G3
ORACLE["source_class"] = w(RAW_POSTINGS) + (
    "SELECT seq, CASE WHEN contains(s, 'linkedin') THEN 'badge-linkedin' WHEN contains(s, 'indeed') THEN 'badge-indeed' "
    "WHEN contains(s, 'glassdoor') THEN 'badge-glassdoor' ELSE 'badge-generic' END AS source_class "
    "FROM (SELECT seq, lower(coalesce(site, 'unknown')) AS s FROM raw_postings)")
ORACLE["source_label"] = w(RAW_POSTINGS) + (
    "SELECT seq, upper(substring(s, 1, 1)) || lower(substring(s, 2)) AS source_label "
    "FROM (SELECT seq, lower(coalesce(site, 'unknown')) AS s FROM raw_postings)")
ORACLE["card_labels"] = w(RAW_POSTINGS, REPLIES) + (
    "SELECT p.search_id, p.seq, "
    "CASE WHEN pub IS NULL OR pub = '' OR pub = 'None' THEN 'Recente' ELSE pub END AS published_label, "
    "coalesce(CASE WHEN p.score = floor(p.score) THEN CAST(CAST(p.score AS BIGINT) AS VARCHAR) ELSE CAST(p.score AS VARCHAR) END, 'N/A') AS score_label, "
    "CASE WHEN p.rationale IS NULL OR p.rationale = '' THEN 'A IA não gerou feedback para esta vaga.' ELSE p.rationale END AS rationale_label "
    f"FROM parsed_replies p JOIN (SELECT seq, {format_date('date_posted')} AS pub FROM raw_postings) r ON r.seq = p.seq "
    "WHERE p.status = 'ok'")

# H: scoring
_SC = w(RAW_POSTINGS, scored())
ORACLE["rubric_score"] = _SC + "SELECT user_id, search_id, term_no, loc_no, seq, hard, level, domain, score, rationale FROM scored_pairs"
ORACLE["rubric_dictionary"] = w(RAW_POSTINGS, scored(f"\n{SKILL_TABLE},", _table_skills("cv_id", "cv_norm"), _table_skills("job_id", "job_norm"))) + (
    "SELECT user_id, search_id, term_no, loc_no, seq, hard, level, domain, score, rationale FROM scored_pairs")
ORACLE["score_batch"] = _SC + ("SELECT user_id, search_id, count(*) AS jobs, min(score) AS least, max(score) AS most, CAST(sum(score) AS BIGINT) AS total "
    "FROM scored_pairs GROUP BY user_id, search_id")
ORACLE["parse_reply"] = w(REPLIES) + "SELECT search_id, seq, status, score, rationale FROM parsed_replies"
ORACLE["reply_defaults"] = w(REPLIES) + "SELECT search_id, seq, score, rationale FROM parsed_replies WHERE status = 'ok'"
ORACLE["error_class"] = w(REPLIES) + (
    "SELECT search_id, seq, CASE WHEN contains(lower(error), '429') OR contains(lower(error), 'rate limit') "
    "OR contains(lower(error), 'too many requests') THEN 'abort' ELSE 'error' END AS error_class FROM replies WHERE error IS NOT NULL")
ORACLE["batch_abort"] = w(REPLIES) + "SELECT search_id, seq, status, score FROM parsed_replies_kept"
ORACLE["attach_scores"] = w(RAW_POSTINGS, REPLIES) + (
    "SELECT r.seq % 3 + 1 AS search_id, r.seq, r.title, k.score, k.rationale FROM raw_postings r "
    "LEFT JOIN parsed_replies_kept k ON k.search_id = r.seq % 3 + 1 AND k.seq = r.seq")

# I: sort, limit
ORACLE["prefix_limit"] = w(RAW_POSTINGS, batch()) + "SELECT search_id, term_no, loc_no, seq FROM top"
ORACLE["rank_by_score"] = w(REPLIES) + (
    "SELECT search_id, seq, score, CAST(row_number() OVER (PARTITION BY search_id ORDER BY score DESC NULLS LAST, seq) AS BIGINT) AS rank "
    "FROM parsed_replies WHERE status = 'ok'")
ORACLE["sample_per_disposition"] = w(RAW_POSTINGS, SINGLE, walk()) + (
    "SELECT disposition, seq FROM labelled QUALIFY row_number() OVER (PARTITION BY disposition ORDER BY loc_no, seq) <= 5")

# J: reporting
_COUNTS = (
    "SELECT g.search_id, g.term_no, "
    "CAST(count(*) FILTER (WHERE disposition = 'approved') AS BIGINT) AS approved, "
    "CAST(count(*) FILTER (WHERE disposition IN ('duplicated_link', 'duplicated_fingerprint')) AS BIGINT) AS duplicated, "
    "CAST(count(*) FILTER (WHERE disposition = 'rejected_missing_keyword') AS BIGINT) AS rejected_missing_keyword, "
    "CAST(count(*) FILTER (WHERE disposition = 'rejected_strict_relevance') AS BIGINT) AS rejected_strict_relevance, "
    "CAST(count(*) FILTER (WHERE disposition = 'rejected_invalid') AS BIGINT) AS rejected_invalid "
    "FROM (SELECT DISTINCT search_id, term_no FROM grid) g LEFT JOIN labelled l ON l.search_id = g.search_id AND l.term_no = g.term_no "
    "GROUP BY g.search_id, g.term_no")
ORACLE["disposition_counts"] = w(RAW_POSTINGS, spec_intake(SCOPE_SPECS, _scope_replies())) + _COUNTS
EMPTY_SPECS = (C.L.SearchSpec("zzzz qqqq", "", "Brazil", 30, 720, 0), C.SPECS[0])
ORACLE["empty_result"] = w(RAW_POSTINGS, spec_intake(EMPTY_SPECS)) + _COUNTS
ORACLE["log_line"] = w(RAW_POSTINGS, SINGLE, walk()) + (
    "SELECT seq, log_line FROM (SELECT seq, "
    "CASE WHEN disposition = 'duplicated_link' THEN '[' || coalesce(company, '') || '] ' || coalesce(title, '') || ' (Session Link Match)' "
    "WHEN disposition = 'duplicated_fingerprint' THEN '[' || coalesce(company, '') || '] ' || coalesce(title, '') || ' (Session Fingerprint Match)' "
    "WHEN disposition = 'rejected_missing_keyword' THEN '[' || coalesce(company, '') || '] ' || coalesce(title, '') || ' -> Missing keyword: ''' || missing_word || '''' "
    f"WHEN disposition = 'rejected_strict_relevance' THEN '[' || coalesce(company, '') || '] ' || coalesce(title, '') || ' -> No core relation to ''' || {q(C.TERM)} || '''' "
    "END AS log_line FROM labelled) WHERE log_line IS NOT NULL")
ORACLE["funnel"] = _SC + (
    "SELECT search_id, count(*) AS jobs_scored, count(*) FILTER (WHERE passed) AS jobs_passed FROM scored_pairs GROUP BY search_id")

# K: sinks
_APPROVED = w(RAW_POSTINGS, spec_intake(ALL_SPECS)) + (
    ", approved_rows AS (SELECT s.search_id, s.term_no, s.loc_no, " + projection("s", "s.remote_search") + " FROM scan s "
    "JOIN labelled l ON l.search_id = s.search_id AND l.term_no = s.term_no AND l.loc_no = s.loc_no AND l.seq = s.seq "
    "WHERE l.disposition = 'approved'), "
    "first_links AS (SELECT * FROM approved_rows QUALIFY row_number() OVER (PARTITION BY link ORDER BY search_id, term_no, loc_no, seq) = 1) ")
ORACLE["jobs_append_unique"] = _APPROVED + (
    f"SELECT link, title, company, location, source, published_at, false AS applied, TIMESTAMP '{AS_OF}' AS created_at FROM first_links "
    "WHERE link IS NOT NULL AND title IS NOT NULL AND link NOT IN (SELECT link FROM approved_rows WHERE search_id = 1)")
ORACLE["jobs_reset"] = _APPROVED + (
    ", second AS (SELECT * FROM approved_rows WHERE search_id = 2 AND link IS NOT NULL AND title IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY link ORDER BY term_no, loc_no, seq) = 1) SELECT link, title, false AS applied FROM second")
ORACLE["jobs_init"] = _APPROVED + "SELECT link, title, description, false AS applied FROM first_links WHERE link IS NOT NULL AND title IS NOT NULL"

# L: pipelines
_RANK = "CAST(row_number() OVER (PARTITION BY search_id ORDER BY score DESC, term_no, loc_no, seq) AS BIGINT) AS rank"
_RESULT = "term_no, loc_no, seq, title, company, location, link, source, published_at, score, rationale"
ORACLE["search_pipeline"] = _SC + f"SELECT user_id, search_id, {_RANK}, source_no, {_RESULT} FROM scored_pairs WHERE passed"
ORACLE["replied_pipeline"] = w(RAW_POSTINGS, batch(), ANSWERS, parsed("answers", "answered", "search_id, seq")) + (
    f"SELECT user_id, search_id, {_RANK}, {_RESULT} FROM ("
    "SELECT t.*, a.score, a.rationale FROM top t JOIN answered_kept a ON a.search_id = t.search_id AND a.seq = t.seq "
    "WHERE a.score <> 0 AND a.score >= t.min_score)")
ORACLE["intake_pipeline"] = _L2
ORACLE["legacy_pipeline"] = w(RAW_POSTINGS, LEGACY_FLAGS) + (
    f"SELECT g.*, 'vagas de ' || {q(C.TERM)} || ' em Brazil' AS phrase FROM (" + _G3 + ") g JOIN legacy l ON l.seq = g.seq "
    "JOIN (SELECT seq FROM raw_postings WHERE lower(site) IN ('google', 'linkedin', 'indeed') "
    f"AND posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 336 HOUR ORDER BY seq LIMIT {C.LEGACY_RESULTS}) c ON c.seq = g.seq "
    f"WHERE NOT l.excluded AND (contains(l.tl, {q(C.TERM)}) OR l.degree)")

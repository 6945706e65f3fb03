"""DuckDB SQL for the queries of queries.py, written apart from them.

Rules that read what earlier steps changed are recursive here, closed forms there.
"""

from __future__ import annotations

from quillfold.functions.validate import CONFUSED, EXCLUSIONS, MEANT
from quillfold.plans.scan_log import SCAN_SQL

ORACLES: dict[str, str] = {}


def sql(name: str, body: str, *ctes: str, recursive: bool = False) -> None:
    ORACLES[name] = f"WITH {'RECURSIVE ' * recursive}" + ",\n".join([SCAN_SQL.strip(), *ctes]) + "\n" + body


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- validation: RE2 has no look-around, so its edges are matched characters ---
NOISY = """
noisy AS (
  SELECT scan_idx, k, true_job,
         CASE k % 6 WHEN 0 THEN 'JOB NO ' || t || ' REV 2' WHEN 1 THEN t WHEN 2 THEN replace(true_job, '-', ' - ')
                    WHEN 3 THEN substr(true_job, 2) WHEN 4 THEN '110' || lpad(CAST(k AS VARCHAR), 4, '0') ELSE 'SEE NOTE ABC' END AS text
  FROM (SELECT *, translate(true_job, '0158', 'OISB') AS t FROM scan))
"""


def _stripped(t: str) -> str:
    for p in EXCLUSIONS:
        t = f"regexp_replace({t}, {_q('(?i)' + p)}, ' ', 'g')"
    return t


def _cleaned(t: str) -> str:
    t = f"translate({_stripped(t)}, {_q(CONFUSED)}, {_q(MEANT)})"
    t = rf"regexp_replace(regexp_replace({t}, '[^0-9A-Za-z\-. =\n]', '', 'g'), '^\s+|\s+$', '', 'g')"
    return rf"regexp_replace({t}, '(\d)E(\d)', '\1-\2', 'g')"


_BASE = r"(?:21|22|23|24|25|26|27)\s*0\s*\d\s*\d\s*\d"
_GAP = r"\s*(?:[-. =–—]+)?\s*"


def _verdicts(source: str) -> str:
    strict = rf"(?:^|[^0-9])({_BASE})({_GAP})(\d{{2}})(?:$|[^0-9A-Za-z])"
    loose = rf"(?:^|[^0-9])({_BASE})({_GAP})(\d{{2}})?"
    head = rf"(?:^|[^0-9])(\d)(\s*0\s*\d\s*\d\s*\d){_GAP}(\d{{2}})(?:$|[^0-9A-Za-z])"
    x = lambda p, i: f"regexp_extract(c, {_q(p)}, {i})"
    bare = lambda e: rf"regexp_replace({e}, '\s+', '', 'g')"
    return f"""
cleaned AS (SELECT *, {_cleaned("text")} AS c FROM {source}),
parts AS (
  SELECT *, regexp_extract(c, '(?:^|[^0-9A-Za-z_])(11[01]\\d{{4}})(?:$|[^0-9A-Za-z_])', 1) AS legacy,
         {bare(x(strict, 1))} AS s1, {x(strict, 3)} AS s3, {bare(x(loose, 1))} AS l1, {x(loose, 3)} AS l3,
         {x(head, 1)} AS h1, {bare(x(head, 2))} AS h2, {x(head, 3)} AS h3
  FROM cleaned),
verdicts AS (
  SELECT *, CASE WHEN coalesce(text, '') = '' OR c = '' THEN NULL WHEN legacy <> '' THEN legacy
                 WHEN s1 <> '' THEN s1 || '-' || s3 WHEN l1 <> '' THEN l1 || CASE WHEN l3 <> '' THEN '-' || l3 ELSE '' END
                 WHEN h3 <> '' AND h1 BETWEEN '1' AND '7' THEN '2' || h1 || h2 || '-' || h3 END AS normalized
  FROM parts)"""


VERDICTS = (NOISY.strip(), _verdicts("noisy").strip())
sql("normalize_jobs", "SELECT scan_idx, text, normalized IS NOT NULL AS is_valid, normalized FROM verdicts", *VERDICTS)
sql("validate_reasons", """SELECT CASE WHEN normalized IS NOT NULL THEN 'valid' WHEN coalesce(text, '') = '' THEN 'empty_input'
WHEN c = '' THEN 'no_content_after_normalization' ELSE 'no_pattern_match' END AS reason, count(*) AS n FROM verdicts GROUP BY 1""", *VERDICTS)
sql("job_base", "SELECT split_part(normalized, '-', 1) AS base, count(*) AS n FROM verdicts GROUP BY 1", *VERDICTS)
sql("strip_noise", f"SELECT scan_idx, {_stripped('text')} AS stripped, {_cleaned('text')} AS cleaned FROM noisy", NOISY.strip())
ORACLES["no_identifiers_in_prose"] = "WITH b AS (SELECT item_id, text FROM benchmark)," + _verdicts("b") + "\nSELECT item_id, normalized IS NOT NULL AS is_valid FROM verdicts"
sql("legacy_jobs", r"SELECT scan_idx, normalized FROM verdicts WHERE regexp_full_match(normalized, '11[01]\d{4}')", *VERDICTS)
sql("decapitated_rescue", "SELECT scan_idx, true_job, normalized FROM verdicts WHERE k % 6 = 3", *VERDICTS)
sql("year_check", "SELECT DISTINCT CAST(scan_idx % 100 AS VARCHAR) AS year, scan_idx % 100 BETWEEN 21 AND 27 AS ok FROM scan")

# --- names and strings ---
ODD = """
odd AS (SELECT scan_idx, CASE k % 4 WHEN 0 THEN upper(filename) WHEN 1 THEN 'page_7_' || scan_idx || '.png'
                                  WHEN 2 THEN 'no digits.pdf' ELSE 'B<1>_' || filename END AS name FROM scan)
"""
sql("scan_index_parse", r"""
SELECT scan_idx, name,
       coalesce(try_cast(nullif(regexp_extract(name, '(?i)scan(\d+)', 1), '') AS BIGINT),
                try_cast(list_last(regexp_extract_all(name, '\d+')) AS BIGINT), 0) AS idx,
       CASE WHEN regexp_matches(name, '(?i)scan\d+') THEN lower(regexp_extract(name, '(?i)(scan\d+)', 1)) ELSE split_part(name, '.', 1) END AS scan_id
FROM odd""", ODD.strip())
sql("original_name", """
SELECT scan_idx, 'B_1__' || name AS unique_name, name AS original,
       coalesce(list_filter(string_split(name, '_'), lambda p: starts_with(lower(p), 'scan'))[1], name) AS display_id FROM odd""", ODD.strip())
sql("safe_folder", r"""
SELECT scan_idx, substr(trim(regexp_replace(' a/b:' || name || '?|* ', '[<>:"/\\|?*]', '_', 'g')), 1, 100) AS folder, 'unnamed' AS blank,
       regexp_replace(' a/b:' || name || '?|* ', '[^\p{L}\p{N}_-]', '', 'g') AS job FROM odd""", ODD.strip())
sql("hamming_pairs", """
SELECT scan_idx, CASE WHEN length(raw_job) = length(true_job) THEN CAST(hamming(raw_job, true_job) AS VARCHAR) || '.0' ELSE 'Infinity' END AS distance,
       coalesce(CASE WHEN length(raw_job) = length(true_job) THEN hamming(raw_job, true_job) = 1 END, false) AS one_off
FROM scan WHERE raw_job <> 'failed'""")


def _category(want: str, got: str) -> str:
    """For reads that are identifiers or failed."""
    b = lambda e: f"split_part({e}, '-', 1)"
    return f"""CASE WHEN {got} IS NULL OR {got} IN ('', 'failed', 'None') THEN 'extraction_failure' WHEN {want} = {got} THEN 'match'
      WHEN length({b(want)}) = length({b(got)}) AND hamming({b(want)}, {b(got)}) = 1 THEN 'single_char_typo'
      WHEN {b(want)} <> {b(got)} THEN 'base_mismatch' ELSE 'suffix_mismatch' END"""


sql("error_category", f"SELECT scan_idx, actual, {_category('true_job', 'actual')} AS category FROM a",
    "a AS (SELECT *, CASE WHEN k % 5 = 0 THEN substr(true_job, 1, 5) || (k % 10) || substr(true_job, 7) ELSE raw_job END AS actual FROM scan)")
sql("durations", """
SELECT scan_idx, CASE WHEN s < 60 THEN printf('%.2fs', s) ELSE printf('%dm %.2fs', CAST(floor(s / 60) AS BIGINT), s - floor(s / 60) * 60) END AS short,
       CASE WHEN s < 60 THEN printf('%.2fs', s) WHEN s < 3600 THEN printf('%dm %.2fs', CAST(floor(s / 60) AS BIGINT), s - floor(s / 60) * 60)
            ELSE printf('%dh %dm %.2fs', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s - floor(s / 3600) * 3600) / 60) AS BIGINT), (s - floor(s / 3600) * 3600) - floor((s - floor(s / 3600) * 3600) / 60) * 60) END AS long
FROM (SELECT scan_idx, round(proc_sec * (1 + k * k % 97), 0) AS s FROM scan)""")
METHOD = "CASE event_type WHEN 'click' THEN 'box_tight_raw' WHEN 'view' THEN 'box_wide_color_mask' WHEN 'purchase' THEN 'stamp_colour' WHEN 'signup' THEN 'corner_rot90' ELSE 'failed' END"
sql("method_strings", r"""
SELECT scan_idx, CASE WHEN k % 3 = 2 THEN 'unknown' WHEN k % 3 = 0 THEN m || ' conf 0.' || k ELSE m END AS ocr_method,
       CASE WHEN k % 3 = 2 THEN 'unknown' WHEN k % 3 = 0 THEN m || ' conf 0.' || k || ' (+' ELSE m END AS raw_method,
       CASE WHEN k % 3 = 0 THEN 'Tier 2: x' ELSE 'kept: valid' END AS reason,
       CASE WHEN k % 3 = 0 THEN CAST('0.' || k AS DOUBLE) ELSE 0.0 END AS conf
FROM (SELECT *, """ + METHOD + " AS m FROM scan)")
sql("run_labels", "SELECT scan_idx, strftime(ts, '%b %d, %H:%M:%S') AS label FROM scan")

# --- filing ---
ORDERED = """
o AS (SELECT batch, scan_idx, row_number() OVER (PARTITION BY batch ORDER BY scan_idx) AS n, CASE WHEN raw_job = 'failed' THEN NULL ELSE raw_job END AS job, confidence AS conf FROM scan)
"""


def _t1(src: str) -> str:
    """Left to right: the row before as changed, the row after as it was."""
    b = lambda e: f"split_part({e}, '-', 1)"
    s = lambda e: f"nullif(split_part({e}, '-', 2), '')"
    between = "p.job IS NOT NULL AND x.job IS NOT NULL AND p.job = x.job AND c.job IS DISTINCT FROM p.job"
    typo = f"({s('c.job')} IS NOT NULL AND {s('p.job')} IS NOT NULL AND hamming({s('c.job')}, {s('p.job')}) = 1)"
    shield = f"(c.job IS NOT NULL AND {b('c.job')} = {b('p.job')} AND NOT coalesce({typo}, false) AND c.conf >= 0.75)"
    hit = f"({between} AND NOT {shield} AND c.scan_idx - p.scan_idx <= 1 AND x.scan_idx - c.scan_idx <= 1)"
    return f"""
t1 AS (
  SELECT batch, scan_idx, n, job, conf, CAST(NULL AS VARCHAR) AS reason FROM {src} WHERE n = 1
  UNION ALL
  SELECT c.batch, c.scan_idx, c.n, CASE WHEN {hit} THEN p.job ELSE c.job END, c.conf,
         CASE WHEN {hit} THEN 'Tier 1: Sandwich Rule (bracketed by ' || p.job || ')'
              WHEN {between} AND {shield} THEN 'kept: valid unique suffix (conf ' || printf('%.2f', c.conf) || ')' END
  FROM t1 p JOIN {src} c ON c.batch = p.batch AND c.n = p.n + 1 LEFT JOIN {src} x ON x.batch = c.batch AND x.n = c.n + 1)"""


def _t2(src: str) -> str:
    ok = lambda a: f"({a}.job IS NOT NULL AND contains({a}.job, '-') AND split_part({a}.job, '-', 1) = c.job)"
    plain = "c.job IS NOT NULL AND NOT contains(c.job, '-')"
    take = f"CASE WHEN {plain} AND {ok('p')} THEN p.job WHEN {plain} AND {ok('x')} THEN x.job END"
    return f"""
t2 AS (
  SELECT c.batch, c.scan_idx, c.n, coalesce({take.replace(ok('p'), 'false').replace('THEN p.job', 'THEN NULL')}, c.job) AS job, c.conf,
         coalesce('Tier 2: Suffix Inheritance (from ' || ({take.replace(ok('p'), 'false').replace('THEN p.job', 'THEN NULL')}) || ')', c.reason) AS reason
  FROM {src} c LEFT JOIN {src} x ON x.batch = c.batch AND x.n = c.n + 1 WHERE c.n = 1
  UNION ALL
  SELECT c.batch, c.scan_idx, c.n, coalesce({take}, c.job), c.conf, coalesce('Tier 2: Suffix Inheritance (from ' || ({take}) || ')', c.reason)
  FROM t2 p JOIN {src} c ON c.batch = p.batch AND c.n = p.n + 1 LEFT JOIN {src} x ON x.batch = c.batch AND x.n = c.n + 1)"""


def _t3(src: str) -> str:
    """Carries the last two rows as they have become: (job, gate, scan_idx)."""
    near = lambda d, j, g, s: f"{{'d': {d}, 'job': {j}, 'base': split_part({j}, '-', 1), 'gate': {g}, 'far': abs({s} - c.scan_idx)}}"
    gate = lambda a: f"({a}.conf >= 0.7 OR contains(coalesce({a}.reason, ''), 'Tier'))"
    lst = f"""list_filter([{near(-2, "p.job2", "p.gate2", "p.idx2")}, {near(-1, "p.job", "p.gate", "p.scan_idx")},
      {near(1, "x.job", gate("x"), "x.scan_idx")}, {near(2, "y.job", gate("y"), "y.scan_idx")}], lambda z: z.job IS NOT NULL)"""
    return f"""
t3 AS (
  SELECT batch, CAST(NULL AS BIGINT) AS scan_idx, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS job, false AS gate, CAST(NULL AS VARCHAR) AS job2, false AS gate2, CAST(NULL AS BIGINT) AS idx2, CAST(NULL AS VARCHAR) AS reason
  FROM (SELECT DISTINCT batch FROM {src})
  UNION ALL
  SELECT batch, scan_idx, n, coalesce(job0, took), gate0 OR took IS NOT NULL, pjob, pgate, pidx, CASE WHEN job0 IS NULL AND took IS NOT NULL THEN 'Tier 3: Weighted Consensus (adopted ' || took || ')' ELSE reason0 END
  FROM (
    SELECT *, CASE WHEN job0 IS NULL THEN list_sort(list_transform(votes, lambda v: {{'t': list_sum([CASE WHEN u.job = v.job THEN u.w ELSE 0.0 END FOR u IN votes]), 'k': -v.d, 'job': v.job}}), 'DESC')[1].job END AS took
    FROM (
      SELECT *, list_transform(list_filter(nb, lambda z: z.far <= 2 AND z.gate), lambda z: {{'d': z.d, 'job': z.job,
                 'w': CAST(3 - abs(z.d) AS DOUBLE) * CASE WHEN z.far <= 1 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END * CASE WHEN z.base = major THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END}}) AS votes
      FROM (
        SELECT *, list_sort(list_transform(nb, lambda a: {{'c': len(list_filter(nb, lambda b: b.base = a.base)), 'k': -a.d, 'base': a.base}}), 'DESC')[1].base AS major
        FROM (
          SELECT c.batch, c.scan_idx, c.n, c.job AS job0, {gate("c")} AS gate0, c.reason AS reason0, p.job AS pjob, p.gate AS pgate, p.scan_idx AS pidx, {lst} AS nb
          FROM t3 p JOIN {src} c ON c.batch = p.batch AND c.n = p.n + 1
          LEFT JOIN {src} x ON x.batch = c.batch AND x.n = c.n + 1 LEFT JOIN {src} y ON y.batch = c.batch AND y.n = c.n + 2)))))"""


PLAIN = "plain AS (SELECT *, CAST(NULL AS VARCHAR) AS reason FROM o)"
sql("sandwich_rule", "SELECT batch, scan_idx, job, reason FROM t1", ORDERED.strip(), _t1("o").strip(), recursive=True)
sql("suffix_inherit", "SELECT batch, scan_idx, job, reason FROM t2", ORDERED.strip(), PLAIN, _t2("plain").strip(), recursive=True)
sql("weighted_consensus", "SELECT batch, scan_idx, job, reason FROM t3 WHERE n > 0", ORDERED.strip(), PLAIN, _t3("plain").strip(), recursive=True)
ALL_TIERS = (ORDERED.strip(), _t1("o").strip(), "m1 AS MATERIALIZED (SELECT * FROM t1)", _t2("m1").strip(), "m2 AS MATERIALIZED (SELECT * FROM t2)", _t3("m2").strip(),
             "filed_all AS (SELECT batch, scan_idx, coalesce(job, 'failed') AS corrected_job, CASE WHEN job IS NULL THEN 'no_correction_found' ELSE coalesce(reason, 'kept: valid') END AS reason FROM t3 WHERE n > 0)")
sql("smart_file_all", "SELECT batch, scan_idx, corrected_job, reason FROM filed_all", *ALL_TIERS, recursive=True)
sql("tier_share", "SELECT tier, n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM (SELECT split_part(reason, ':', 1) AS tier, count(*) AS n FROM filed_all GROUP BY 1)", *ALL_TIERS, recursive=True)
sql("red_ink_suffix", """
SELECT scan_idx, raw_job, CASE WHEN has_red THEN fixed ELSE raw_job END AS job,
       CASE WHEN has_red THEN 'Tier 0: Red Ink Suffix Override (' || raw_job || ' -> ' || fixed || ')' END AS reason
FROM (SELECT *, substr(raw_job, 1, 8) || substr(raw_job, 10, 1) AS fixed FROM (SELECT scan_idx, true_job || (k % 10) AS raw_job, has_red FROM scan))""")
sql("red_ink_positional", """
SELECT scan_idx, raw_job, CASE WHEN swap IS NOT NULL THEN swap ELSE raw_job END AS job,
       CASE WHEN swap IS NOT NULL THEN 'Tier 0: Red Ink Positional Swap via Known Jobs (' || raw_job || ' -> ' || swap || ')' END AS reason
FROM (SELECT *, CASE WHEN k % 2 = 0 THEN list_filter(list_transform(generate_series(1, 6), lambda i: substr(raw_job, 1, i - 1) || substr(raw_job, 11, 1) || substr(raw_job, i + 1, 9 - i)),
                  lambda j: j IN ('210037-02', '220037-02', '230037-02', '240037-02', '250037-02', '260037-02', '270037-02'))[1] END AS swap
      FROM (SELECT scan_idx, k, substr(true_job, 1, 1) || '9' || substr(true_job, 3) || ' ' || substr(true_job, 2, 1) AS raw_job FROM scan))""")
sql("majority_base_window", """
SELECT batch, scan_idx, list_sort(list_transform(near, lambda a: {'c': len(list_filter(near, lambda b: b.base = a.base)), 'k': -a.n, 'base': a.base}), 'DESC')[1].base AS majority
FROM (SELECT batch, scan_idx, list_filter(list(CASE WHEN job IS NOT NULL THEN {'n': n, 'base': split_part(job, '-', 1)} END) OVER (PARTITION BY batch ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), lambda z: z IS NOT NULL) AS near FROM o)""", ORDERED.strip())

# --- statuses, routing, verification ---
FILED = f"""
filed AS (
  SELECT *, {METHOD} AS method,
         CASE WHEN has_red THEN 'Manual Review Required' WHEN raw_job = 'failed' THEN 'Failed' ELSE 'Success' END AS status,
         nullif(raw_job, 'failed') AS job, CASE WHEN has_red THEN 'correction_mark_detected' WHEN raw_job = 'failed' THEN 'no_correction_found' END AS error,
         CASE WHEN has_red THEN raw_job END AS suggested_job, CASE WHEN raw_job = 'failed' THEN 'no_correction_found' ELSE 'kept: valid' END AS reason
  FROM scan)
"""
VERIFIED = f"""
verified AS (
  SELECT *, lower(split_part(filename, '.', 1)) AS scan_id,
         CASE WHEN status <> 'Success' THEN 'extraction_failure' WHEN scan_idx % 10 = 0 THEN 'unverified' ELSE {_category("true_job", "job")} END AS outcome
  FROM filed)
"""
V2 = (FILED.strip(), VERIFIED.strip())
CHECKED = "outcome NOT IN ('extraction_failure', 'unverified')"
SUMMARY = f"""
summary AS (
  SELECT batch, count(*) AS total_in_batch, count(*) FILTER ({CHECKED}) AS total_verified, count(*) FILTER (outcome = 'match') AS passed,
         count(*) FILTER ({CHECKED} AND outcome <> 'match') AS verification_errors, count(*) FILTER (outcome = 'extraction_failure') AS extraction_failures,
         round(avg(confidence), 6) AS mean, min(confidence) AS min_confidence, max(confidence) AS max_confidence, count(*) FILTER (confidence < 0.7) AS low_confidence
  FROM verified GROUP BY 1)
"""
V3 = (*V2, SUMMARY.strip())
ACC = "coalesce(passed / CAST(nullif(total_verified, 0) AS DOUBLE), 0.0)"
sql("verify_batch", f"SELECT batch, total_in_batch, total_verified, passed, verification_errors, extraction_failures, verification_errors + extraction_failures AS total_errors, round({ACC}, 6) AS accuracy FROM summary", *V3)
sql("verify_join_missing", "SELECT batch, count(*) AS missing FROM scan WHERE scan_idx % 10 = 0 GROUP BY 1")
sql("tier_breakdown", f"SELECT batch, reason, count(*) AS n FROM verified WHERE {CHECKED} GROUP BY 1, 2", *V2)
sql("error_histogram", "SELECT outcome, count(*) AS n FROM verified WHERE outcome NOT IN ('match', 'unverified') GROUP BY 1", *V2)
sql("confidence_stats", "SELECT batch, mean, min_confidence, max_confidence, low_confidence FROM summary", *V3)
sql("failed_file_lists", f"SELECT batch, coalesce(string_agg(scan_id, ',' ORDER BY scan_id) FILTER ({CHECKED} AND outcome <> 'match'), '') AS failed, count(*) FILTER (outcome = 'extraction_failure') AS n_not_read FROM verified GROUP BY 1", *V2)
sql("verification_accuracy", f"SELECT batch, round(CASE WHEN batch % 2 = 0 THEN (total_in_batch - verification_errors - extraction_failures) / CAST(total_in_batch AS DOUBLE) ELSE {ACC} END, 6) AS accuracy FROM summary", *V3)
sql("known_job_semi", "SELECT batch, count(*) AS known FROM scan WHERE raw_job IN (SELECT true_job FROM scan WHERE k < 10) GROUP BY 1")
sql("unmatched_anti", "SELECT batch, nullif(count(*) FILTER (k % 7 <> 0), 0) AS found, nullif(count(*) FILTER (k % 7 = 0), 0) AS lost FROM scan GROUP BY 1")
sql("route_decision", "SELECT scan_idx, CASE WHEN status = 'Success' AND confidence >= 0.85 THEN 'success/' || job || '/' || filename ELSE 'holding_zone/' || filename END AS dest_path FROM filed", FILED.strip())
sql("failed_route", "SELECT scan_idx, 'failed/' || error || '/' || filename AS dest_path FROM filed WHERE status = 'Failed'", FILED.strip())
sql("hitl_status", "SELECT scan_idx, status, job, method, error, suggested_job FROM filed", FILED.strip())
sql("run_summary", """
SELECT batch, count(*) AS total_files, count(*) FILTER (status = 'Success') AS successful_autofiling, count(*) FILTER (status = 'Manual Review Required') AS manual_review_required,
       count(*) FILTER (status = 'Failed') AS failed, round(100.0 * count(*) FILTER (status = 'Success') / count(*), 6) AS success_pct,
       round(100.0 * count(*) FILTER (status = 'Manual Review Required') / count(*), 6) AS hitl_pct, round(sum(proc_sec), 6) AS total_sec, round(avg(proc_sec), 6) AS avg_sec
FROM filed GROUP BY 1""", FILED.strip())
sql("method_efficiency", "SELECT method AS ocr_method, count(*) AS files, round(sum(proc_sec), 6) AS total_sec, round(avg(proc_sec), 6) AS avg_sec FROM filed WHERE status <> 'Failed' GROUP BY 1", FILED.strip())
sql("parallel_speedup", "SELECT batch, round(CASE WHEN batch % 3 > 0 THEN 60.0 ELSE s END, 6) AS wall, round(CASE WHEN batch % 3 > 0 THEN s / 60.0 ELSE 1.0 END, 6) AS speedup FROM (SELECT batch, sum(proc_sec) AS s FROM scan GROUP BY 1)")
sql("missing_metrics", "SELECT DISTINCT batch FROM scan WHERE batch % 3 = 0")

# --- review metrics ---
REVIEWED = f"""
reviewed AS (
  SELECT *, {METHOD} AS method, k % 4 = 0 AS pending, confidence >= 0.85 AND raw_job <> 'failed' AS trusted, raw_job <> true_job AND k % 3 = 0 AS corrected,
         CASE WHEN raw_job <> true_job AND k % 3 = 0 THEN CASE WHEN raw_job = 'failed' THEN 0.0 ELSE 1 - hamming(substr(raw_job, 1, 6), substr(true_job, 1, 6)) / 6.0 END END AS sim0
  FROM scan),
state AS (SELECT *, CASE WHEN sim0 IS NULL THEN NULL WHEN raw_job = 'failed' THEN 1 - hamming('failed', substr(true_job, 1, 6)) / CAST(6 AS DOUBLE) ELSE sim0 END AS similarity FROM reviewed)
"""
REVIEW = """
review AS (
  SELECT batch, count(*) AS total_in_batch, count(*) FILTER (NOT pending) AS verified_files, count(*) FILTER (pending) AS pending_files,
         count(*) FILTER (NOT pending AND trusted) AS verified_trusted_count, count(*) FILTER (corrected) AS human_corrections, count(*) FILTER (trusted) AS theoretical_auto_count,
         count(*) FILTER (NOT pending AND trusted AND corrected) AS silent_failures, coalesce(avg(similarity) FILTER (corrected), 1.0) AS sim, sum(confidence) AS cs, count(confidence) AS cc,
         count(*) FILTER (NOT has_red AND raw_job <> 'failed') AS ok0, count(*) FILTER (has_red) AS held0, count(*) FILTER (NOT has_red AND raw_job = 'failed') AS lost0, sum(proc_sec) AS secs, max(ts) AS run_at
  FROM state GROUP BY 1)
"""
R2 = (REVIEWED.strip(), REVIEW.strip())
_D = lambda a, b: f"coalesce({a} / CAST(nullif({b}, 0) AS DOUBLE), 0.0)"
sql("batch_hitl_metrics", f"""
SELECT batch, total_in_batch, verified_files, pending_files, verified_trusted_count, human_corrections, theoretical_auto_count, silent_failures, round(sim, 6) AS avg_typo_similarity,
       round({_D('theoretical_auto_count', 'total_in_batch')}, 6) AS theoretical_automation, round({_D('(verified_files - human_corrections)', 'verified_files')}, 6) AS actual_accuracy,
       round({_D('silent_failures', 'verified_trusted_count')}, 6) AS silent_failure_rate, round({_D('cs', 'cc')}, 6) AS mean_confidence FROM review""", *R2)
sql("silent_failures", "SELECT batch, filename, raw_job AS guess, true_job AS truth FROM state WHERE trusted AND corrected AND NOT pending", REVIEWED.strip())
_ACC = "count(*) AS total, count(*) FILTER (NOT corrected) AS correct, round(100.0 * count(*) FILTER (NOT corrected) / count(*), 6) AS accuracy"
sql("method_accuracy", f"SELECT method, {_ACC} FROM state WHERE NOT pending GROUP BY 1", REVIEWED.strip())
sql("method_accuracy_lifetime", f"""
SELECT CASE method WHEN 'box_tight_raw' THEN 'Box Tight Raw' WHEN 'box_wide_color_mask' THEN 'Box Wide Color Mask' WHEN 'stamp_colour' THEN 'Stamp Colour'
       WHEN 'corner_rot90' THEN 'Corner Rot90' ELSE 'Failed' END AS method, total, correct, accuracy FROM (SELECT method, {_ACC} FROM state WHERE NOT pending GROUP BY 1)""", REVIEWED.strip())
_RATES = {
    "accuracy_pct": _D("sum(verified_files - human_corrections)", "sum(verified_files)"),
    "automation_pct": _D("sum(theoretical_auto_count)", "sum(total_in_batch)"),
    "silent_failure_pct": _D("sum(silent_failures)", "sum(verified_trusted_count)"),
    "hitl_pct": _D("sum(held0)", "sum(total_in_batch)"),
    "success_pct": _D("sum(ok0)", "sum(total_in_batch)"),
    "failed_pct": _D("sum(lost0)", "sum(total_in_batch)"),
}
_RATE_SQL = ", ".join(f"round(100 * {e}, 6) AS {n}" for n, e in _RATES.items())
sql("global_kpis", f"""
SELECT CAST(sum(total_in_batch) AS BIGINT) AS total_processed, CAST(sum(verified_files) AS BIGINT) AS total_verified, CAST(sum(human_corrections) AS BIGINT) AS total_corrections,
       {_RATE_SQL}, round(avg(secs / 120.0), 6) AS avg_speedup, round(120.0 * count(*) / sum(total_in_batch), 6) AS avg_speed_sec FROM review""", *R2)
sql("weighted_confidence", "SELECT round(100 * sum(cs) / sum(cc), 6) AS avg_confidence_pct FROM review", *R2)
sql("similarity_weighted", "SELECT p AS similarity_pct, CASE WHEN p >= 90 THEN 'High' WHEN p >= 80 THEN 'Moderate' ELSE 'Low' END AS band FROM (SELECT round(100 * sum(sim * human_corrections) / sum(human_corrections), 6) AS p FROM review)", *R2)
_ONE = {n: e.replace("sum(", "(") for n, e in _RATES.items() if n != "automation_pct"}
sql("latest_vs_all", "SELECT l.batch, " + ", ".join(f"round(l.{n}, 6) AS {n}, round(l.{n} - g.{n}, 6) AS {n}_delta" for n in (*_ONE, "avg_speedup")) + " FROM l, g", *R2,
    "l AS (SELECT batch, " + ", ".join(f"100 * {e} AS {n}" for n, e in _ONE.items()) + ", secs / 120.0 AS avg_speedup FROM review ORDER BY run_at DESC, batch DESC LIMIT 1)",
    "g AS (SELECT " + ", ".join(f"100 * {_RATES[n]} AS {n}" for n in _ONE) + ", avg(secs / 120.0) AS avg_speedup FROM review)")
sql("accuracy_trend_slope", f"""
SELECT count(*) AS reports, round(avg(a), 6) AS avg_accuracy, round(min(a), 6) AS min_accuracy, round(max(a), 6) AS max_accuracy, round(regr_slope(a, x), 6) AS slope,
       round(avg(total_in_batch), 6) AS avg_batch_size, min(total_in_batch) AS min_batch_size, max(total_in_batch) AS max_batch_size,
       CASE WHEN count(*) < 2 THEN 'INSUFFICIENT' WHEN regr_slope(a, x) > 0.01 THEN 'IMPROVING' WHEN regr_slope(a, x) < -0.01 THEN 'DECLINING' ELSE 'STABLE' END AS trend
FROM (SELECT *, {ACC} AS a, row_number() OVER (ORDER BY batch) - 1 AS x FROM summary)""", *V3)
sql("error_evolution", """
SELECT k.outcome, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY b.batch) AS counts
FROM (SELECT DISTINCT outcome FROM verified WHERE outcome NOT IN ('match', 'unverified')) k CROSS JOIN (SELECT DISTINCT batch FROM verified) b
LEFT JOIN (SELECT batch, outcome, count(*) AS n FROM verified GROUP BY 1, 2) c ON c.batch = b.batch AND c.outcome = k.outcome GROUP BY 1""", *V2)

# --- scores, boxes, pixels ---
_CLAMP = lambda e: f"greatest(0.0, least(1.0, {e}))"
sql("confidence_fusion", f"""
SELECT scan_idx, round({_CLAMP('0.35::DOUBLE * d + 0.65::DOUBLE * confidence')}, 6) AS fused, round({_CLAMP('0.6::DOUBLE * d + 0.4::DOUBLE * confidence')}, 6) AS legacy
FROM (SELECT *, CASE WHEN k % 5 > 0 THEN k / CAST(80 AS DOUBLE) ELSE 0.7::DOUBLE END AS d FROM scan)""")
sql("confidence_penalties", f"""
SELECT scan_idx, m, round(c, 6) AS score, round(CASE WHEN contains(m, 'color') THEN least(1.0, c + 0.1) ELSE c END, 6) AS boosted FROM (
  SELECT *, {_CLAMP("CASE WHEN m = 'easyocr_raw' THEN least(0.85, b) ELSE b END")} AS c FROM (
    SELECT *, {_CLAMP('0.35::DOUBLE * (k / 100.0) + 0.65::DOUBLE * confidence')} - CASE WHEN m IN ('rot90_dilated', '90deg_color') THEN 0.05::DOUBLE WHEN m = '180deg' THEN 0.02::DOUBLE ELSE 0.0 END - CASE WHEN m = 'rot90_dilated' THEN 0.1::DOUBLE ELSE 0.0 END AS b
    FROM (SELECT *, CASE k % 7 WHEN 0 THEN 'rot90_dilated' WHEN 1 THEN '180deg' WHEN 2 THEN 'color_dilated' WHEN 3 THEN 'easyocr_raw' WHEN 4 THEN '90deg_color' ELSE 'raw' END AS m FROM scan)))""")
sql("best_candidate", "SELECT CAST(floor(scan_idx / 5) AS BIGINT) AS page, scan_idx, raw_job FROM scan QUALIFY row_number() OVER (PARTITION BY floor(scan_idx / 5) ORDER BY confidence DESC, scan_idx) = 1")
BOXES = """
boxes AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS box, l_partkey % 900 AS x1, (l_partkey * 7) % 650 AS y1, l_partkey % 900 + CAST(l_quantity AS BIGINT) * 6 AS x2,
                 (l_partkey * 7) % 650 + 10 + (l_partkey % 13) * 15 AS y2 FROM lineitem)
"""
sql("box_geometry_filter", "SELECT l_orderkey, count(*) AS boxes, count(*) FILTER (x2 > x1 AND y2 > y1 AND (x2 - x1) / CAST(y2 - y1 AS DOUBLE) >= 1.2 AND (x2 - x1) * (y2 - y1) <= 56000) AS kept FROM boxes GROUP BY 1", BOXES.strip())


def _crop(a: str, least: tuple[int, int], share: tuple[float, float]) -> str:
    px = f"CAST(greatest({least[0]}, floor((x2 - x1) * {share[0]}::DOUBLE)) AS BIGINT)"
    py = f"CAST(greatest({least[1]}, floor((y2 - y1) * {share[1]}::DOUBLE)) AS BIGINT)"
    return f"greatest(0, x1 - {px}) AS {a}_x1, greatest(0, y1 - {py}) AS {a}_y1, least(1000, x2 + {px}) AS {a}_x2, least(700, y2 + {py}) AS {a}_y2"


sql("crop_boxes", f"SELECT l_orderkey, box, {_crop('t', (10, 10), (0.05, 0.05))}, {_crop('d', (50, 30), (0.8, 0.4))} FROM boxes", BOXES.strip())
PIXELS = "px AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS y, l_partkey % 5 AS x, l_partkey % 181 AS hue, (l_suppkey * 13) % 256 AS sat, (l_partkey * 11) % 256 AS val FROM lineitem)"
sql("red_coverage", "SELECT l_orderkey, c AS coverage, c > 0.01 AS has_red FROM (SELECT l_orderkey, round(avg(CASE WHEN (hue <= 10 OR hue >= 170) AND sat >= 100 AND val >= 100 THEN 1.0 ELSE 0.0 END), 6) AS c FROM px WHERE hue BETWEEN 0 AND 180 GROUP BY 1)", PIXELS)
_VAR = lambda c: f"(SELECT l_orderkey, var_pop(s) AS v FROM (SELECT l_orderkey, {c}, sum(CASE WHEN val < 128 THEN 255 ELSE 0 END) AS s FROM px GROUP BY 1, 2) GROUP BY 1)"
sql("projection_variance", f"SELECT r.l_orderkey, round(r.v, 3) AS var_rows, round(c.v, 3) AS var_cols, c.v > 1.5 * r.v AS vertical FROM {_VAR('y')} r JOIN {_VAR('x')} c ON r.l_orderkey = c.l_orderkey", PIXELS)

# --- reports ---
sql("last_report_wins", "SELECT filename, 'r' || (1 + k % 3) AS report, raw_job || '#' || (1 + k % 3) AS job FROM scan")
sql("report_table_parse", "SELECT CAST(batch AS VARCHAR) AS file, split_part(filename, '.', 1) AS scan_id, raw_job AS job FROM scan")
sql("report_totals", "SELECT CAST(batch AS VARCHAR) AS file, CAST(500 AS BIGINT) AS total, nullif(count(*) FILTER (raw_job = 'failed'), 0) AS failures, min(CASE WHEN raw_job = 'failed' THEN split_part(filename, '.', 1) END) AS first_lost FROM scan GROUP BY 1")
sql("filed_and_verified", f"""
SELECT batch, count(*) FILTER ({CHECKED}) AS total_verified, count(*) FILTER (outcome = 'match') AS passed, count(*) FILTER ({CHECKED} AND outcome <> 'match') AS verification_errors,
       count(*) FILTER (outcome = 'extraction_failure') AS extraction_failures, round(coalesce(count(*) FILTER (outcome = 'match') / CAST(nullif(count(*) FILTER ({CHECKED}), 0) AS DOUBLE), 0.0), 6) AS accuracy
FROM (SELECT s.batch, CASE WHEN s.has_red OR f.corrected_job = 'failed' THEN 'extraction_failure' WHEN s.scan_idx % 10 = 0 THEN 'unverified' ELSE {_category("s.true_job", "f.corrected_job")} END AS outcome
      FROM scan s JOIN filed_all f ON s.scan_idx = f.scan_idx) GROUP BY 1""", *ALL_TIERS, recursive=True)

# --- reports against ground truth ---
META = """
meta AS (SELECT CAST(batch AS VARCHAR) AS report, lower(split_part(filename, '.', 1)) AS scan_id, raw_job AS job, k, scan_idx,
                CASE WHEN k % 2 = 1 THEN confidence / 2 ELSE confidence END AS confidence,
                CASE WHEN raw_job = 'failed' THEN 'no_correction_found' ELSE 'kept: valid' END || ' ' || (1 + k % 2) AS reason FROM scan WHERE k % 5 <> 0)
"""
RESULTS = f"""
results AS (
  SELECT CAST(s.batch AS VARCHAR) AS report, split_part(s.filename, '.', 1) AS scan_id, s.true_job AS expected, s.raw_job AS actual, s.raw_job = s.true_job AS passed,
         coalesce(m.confidence, 0.0) AS confidence, coalesce(m.reason, 'unknown (check smart_filing logs)') AS tier,
         CASE WHEN s.raw_job <> s.true_job THEN {_category("s.true_job", "s.raw_job")} END AS error_type
  FROM scan s LEFT JOIN meta m ON s.scan_idx = m.scan_idx WHERE s.scan_idx % 10 <> 0)
"""
V4 = (META.strip(), RESULTS.strip())
sql("enhanced_files", "SELECT report, scan_id, job, round(confidence, 6) AS confidence, reason FROM meta", META.strip())
sql("report_verification", "SELECT report, scan_id, expected, actual, passed, round(confidence, 6) AS confidence, tier, error_type FROM results", *V4)
sql("report_verification_summary", """
SELECT r.report, CAST(500 AS BIGINT) AS total_in_batch, total_verified, passed, verification_errors, lost AS extraction_failures, verification_errors + lost AS total_errors, low_confidence,
       mean_confidence, min_confidence, max_confidence, round((500 - verification_errors - lost) / CAST(500 AS DOUBLE), 6) AS accuracy
FROM (SELECT report, count(*) AS total_verified, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS verification_errors, count(*) FILTER (confidence < 0.70) AS low_confidence,
             round(avg(confidence), 6) AS mean_confidence, round(min(confidence), 6) AS min_confidence, round(max(confidence), 6) AS max_confidence FROM results GROUP BY 1) r
JOIN (SELECT CAST(batch AS VARCHAR) AS report, count(*) FILTER (raw_job = 'failed') AS lost FROM scan GROUP BY 1) l ON r.report = l.report""", *V4)
sql("confidence_trend", "SELECT count(*) AS reports, round(avg(m), 6) AS avg_confidence, round(min(m), 6) AS min_confidence, round(max(m), 6) AS max_confidence FROM (SELECT batch, avg(confidence) AS m FROM scan GROUP BY 1) HAVING count(*) >= 2 AND max(m) > 0")

# --- ordered reports ---
sql("methods_by_time", "SELECT row_number() OVER (ORDER BY sum(proc_sec) DESC, method) AS place, method AS ocr_method, count(*) AS files FROM filed WHERE status <> 'Failed' GROUP BY method", FILED.strip())
sql("methods_by_accuracy", "SELECT row_number() OVER (ORDER BY count(*) FILTER (NOT corrected) / CAST(count(*) AS DOUBLE), method) AS place, method, count(*) AS total, count(*) FILTER (NOT corrected) AS correct FROM state WHERE NOT pending GROUP BY method", REVIEWED.strip())
sql("log_summary", """
SELECT t.batch, total_files, successful, failed, success_pct, total_sec, avg_sec, methods
FROM (SELECT batch, count(*) AS total_files, count(*) FILTER (status = 'Success') AS successful, count(*) FILTER (status <> 'Success') AS failed,
             round(100.0 * count(*) FILTER (status = 'Success') / count(*), 6) AS success_pct, round(sum(proc_sec), 6) AS total_sec, round(sum(proc_sec) / count(*), 6) AS avg_sec FROM filed GROUP BY 1) t
JOIN (SELECT batch, string_agg(method || ':' || n, ',' ORDER BY method) AS methods FROM (SELECT batch, method, count(*) AS n FROM filed GROUP BY 1, 2) GROUP BY 1) m ON t.batch = m.batch""", FILED.strip())
sql("report_rows", """
SELECT batch, section, row_number() OVER (PARTITION BY batch, section ORDER BY filename) AS place,
       CASE section WHEN 'filed' THEN rpad(substr(stem, 1, 23), 23, ' ') || ' | ' || rpad(job, 20, ' ') || ' | ' || rpad(CASE WHEN s < 60 THEN printf('%.2fs', s) ELSE printf('%dm %.2fs', CAST(floor(s / 60) AS BIGINT), s - floor(s / 60) * 60) END, 12, ' ') || ' | '
       ELSE rpad(substr(stem, 1, 21), 21, ' ') || ' | System Guess: ' || rpad(coalesce(job, 'No Guess'), 15, ' ') || ' | Reason: ' || error END AS line
FROM (SELECT batch, filename, job, error, floor(proc_sec) AS s, CASE status WHEN 'Success' THEN 'filed' ELSE 'held' END AS section,
             CASE WHEN k % 2 = 0 THEN 'a long name of a folder ' ELSE '' END || split_part(filename, '.', 1) AS stem FROM filed WHERE status <> 'Failed')""", FILED.strip())
sql("pending_queue", f"""
SELECT filename, filename AS scan_id, CASE WHEN k % 3 = 0 THEN '' ELSE raw_job END AS system_guess, CASE WHEN k % 3 = 0 THEN 0.0 ELSE confidence END AS confidence,
       CASE WHEN k % 3 = 0 THEN 'unknown' ELSE {METHOD} END AS method_used, CASE WHEN k % 3 = 0 THEN 'Unknown' ELSE CAST(batch AS VARCHAR) END AS batch_id FROM scan WHERE k % 4 = 0""")
sql("latest_crops", "SELECT filename, CASE WHEN k % 4 > 0 THEN 'debug/' || split_part(filename, '.', 1) || '_micro_' || (k % 4) || '.jpg' END AS crop FROM scan")
sql("structural_check", r"SELECT scan_idx, text, regexp_full_match(text, '\d{6}(-\d{2})?') AS structural FROM noisy", NOISY.strip())
sql("report_names", "SELECT DISTINCT batch, 'batch ' || batch || CASE WHEN batch % 2 = 0 THEN '' ELSE '_run_data_2' END AS name FROM scan")

# --- stored tables ---
sql("metrics_history", f"""
SELECT CAST(batch AS VARCHAR) AS batch, total_in_batch, total_in_batch AS verified_files, CAST(0 AS BIGINT) AS verified_trusted_count, CAST(0 AS BIGINT) AS human_corrections, CAST(0 AS BIGINT) AS theoretical_auto_count,
       CAST(0 AS BIGINT) AS silent_failures, total_in_batch AS confidence_count, 0.0 AS theoretical_automation_pct, round(100 * {ACC}, 6) AS accuracy_pct, 0.0 AS silent_failure_pct,
       round(m * total_in_batch, 6) AS confidence_sum, 1.0 AS avg_typo_similarity, 1.0 AS parallel_speedup
FROM summary JOIN (SELECT batch AS b, avg(confidence) AS m FROM scan GROUP BY 1) ON b = batch WHERE batch % 2 = 0
UNION ALL
SELECT CAST(batch AS VARCHAR), total_in_batch, verified_files, verified_trusted_count, human_corrections, theoretical_auto_count, silent_failures, cc, round(100 * theoretical_auto_count / CAST(total_in_batch AS DOUBLE), 6),
       round(100 * {_D('(verified_files - human_corrections)', 'verified_files')}, 6), round(100 * {_D('silent_failures', 'verified_trusted_count')}, 6), round(cs, 6), round(sim, 6), 1.0
FROM review WHERE batch % 2 = 1""", *V3, *R2)
sql("stored_metrics", "SELECT batch, total_in_batch, verified_files, human_corrections FROM review", *R2)
sql("latest_report", "SELECT batch, total_in_batch, ok0 AS initial_success FROM review ORDER BY run_at DESC LIMIT 1", *R2)
sql("ground_truth_csv", "SELECT split_part(filename, '.', 1) AS scan_id, true_job AS job_number, CASE WHEN k % 7 = 0 THEN 'seen' ELSE '' END AS notes FROM scan WHERE k % 11 <> 0")
sql("latest_corrections", """
SELECT CAST(batch AS VARCHAR) AS batch, filename, CASE WHEN k % 4 = 0 THEN true_job ELSE substr(true_job, 1, 7) || lpad(CAST(t AS VARCHAR), 2, '0') END AS truth
FROM (SELECT *, CASE WHEN k % 4 > 0 AND raw_job = substr(true_job, 1, 7) || lpad(CAST((1 + k % 4) * 11 AS VARCHAR), 2, '0') THEN k % 4 * 11 ELSE (1 + k % 4) * 11 END AS t FROM scan WHERE k % 3 = 0)
WHERE NOT (k % 4 = 0 AND raw_job = true_job)""")

# --- pictures ---
sql("page_turns", "SELECT scan_idx, k % 2 = 1 AS vertical, CAST(CASE k % 4 WHEN 1 THEN 270 WHEN 3 THEN 90 ELSE 0 END AS BIGINT) AS angle FROM scan")
sql("red_marks", "SELECT scan_idx, round(k / CAST(2000 AS DOUBLE), 6) AS coverage, k > 20 AS red FROM scan")
sql("enhanced_pictures", "SELECT b.batch, m.method, 200 AS height, 400 AS width, false AS red FROM (SELECT DISTINCT batch FROM scan WHERE batch % 5 <> 4) b, (VALUES ('hsv'), ('clahe'), ('blue_channel'), ('morphological'), ('combined')) AS m(method)")
sql("extracted_pages", """
SELECT 'page_' || batch || '.png' AS filename, CASE WHEN ok THEN '250' || lpad(CAST(1 + batch % 20 AS VARCHAR), 3, '0') || '-01' END AS job_number,
       CASE WHEN ok THEN 'Success' ELSE 'Failure: image_load_failed' END AS status, CASE WHEN NOT ok THEN 'image_load_failed' END AS error, ok AS sure
FROM (SELECT DISTINCT batch, batch % 5 <> 4 AS ok FROM scan)""")
sql("stamp_regions", """
SELECT DISTINCT k, CAST(26 AS BIGINT) AS x, CAST(46 AS BIGINT) AS y, 48 + k AS w, CAST(28 AS BIGINT) AS h, least(240, 26 + 48 + k + 250) AS crop_w, CAST(94 - 26 AS BIGINT) AS crop_h FROM scan WHERE k % 3 > 0""")
sql("prepared_pictures", "SELECT DISTINCT k, k % 2 = 1 AS faint, CAST(75 AS BIGINT) AS read_h, CAST(150 AS BIGINT) AS read_w, CAST(460 AS BIGINT) AS pad_w FROM scan")
sql("batch_images", "SELECT 'work/' || name AS path, name FROM (SELECT 'B_' || (batch % 2) || '__' || split_part(filename, '.', 1) || '_ready.jpg' AS name FROM scan WHERE batch % 2 = 1 AND k % 2 = 0)")
sql("run_reports", "SELECT CAST(batch AS VARCHAR) AS batch_id, count(*) AS total_files, count(*) FILTER (status = 'Success') AS successful_autofiling, count(*) AS files, count(*) FILTER (status = 'Success') AS filed, round(sum(confidence), 6) AS confidence FROM filed GROUP BY batch", FILED.strip())
sql("metrics_reports", "SELECT CAST(batch AS VARCHAR) AS batch, total_in_batch, verified_files, human_corrections FROM review WHERE batch % 7 <> 3", *R2)
sql("corrections_refresh", "SELECT batch, total_in_batch, verified_files FROM review WHERE batch IN (SELECT batch FROM scan WHERE k % 50 = 1 AND batch % 3 = 1 AND raw_job <> '210001-01')", *R2)

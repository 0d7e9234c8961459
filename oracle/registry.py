"""DuckDB oracles for the registry, board discovery and probes."""

from __future__ import annotations

from hirefold import rules as R
from hirefold.sources import fixtures as FX
from oracle.base import lst, q, with_


def domain_sql(expr: str) -> str:
    s = f"regexp_replace(regexp_replace(trim({expr}), '/+$', ''), '^https?://', '')"
    return f"regexp_replace(lower(split_part({s}, '/', 1)), '^www\\.', '')"


def name_guess_sql(domain: str) -> str:
    label = f"replace(split_part({domain}, '.', 1), '-', ' ')"
    return (f"array_to_string(list_transform(regexp_extract_all({label}, '(\\pL+|\\PL+)', 1), "
            "lambda w: CASE WHEN regexp_matches(w, '^\\pL') THEN upper(w[1]) || lower(w[2:]) ELSE w END), '')")


def registry_ctes() -> list[str]:
    v = lst(R.VENDORS)
    st = lst(FX.REGISTRY_STATUSES)
    return [
        f"""reg_log AS (
  SELECT c_custkey AS line_no,
    CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END AS company_name,
    CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'customer' || c_custkey::VARCHAR || '.example.com' END AS domain,
    {v}[c_custkey % 6 + 1] AS vendor, 'org' || (c_custkey % 50)::VARCHAR AS slug,
    CASE WHEN {v}[c_custkey % 6 + 1] = 'workday' THEN ''
         ELSE 'https://boards.example.com/' || {v}[c_custkey % 6 + 1] || '/org' || (c_custkey % 50)::VARCHAR END AS board_url,
    {st}[c_custkey % 3 + 1] AS status,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE DATE '2024-01-01' + (c_custkey % 30)::INTEGER END AS last_verified,
    (c_custkey % 40)::BIGINT AS last_posting_count,
    CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'seed' END AS discovered_via,
    CASE WHEN c_custkey % 6 = 1 THEN 'seeded by hand' ELSE '' END AS notes
  FROM customer)""",
        """reg AS (
  SELECT * EXCLUDE (rn, line_no) FROM (
    SELECT *, row_number() OVER (PARTITION BY vendor, slug ORDER BY line_no DESC) AS rn FROM reg_log)
  WHERE rn = 1)""",
        f"""probe_log AS (
  SELECT c_custkey AS line_no, {v}[c_custkey % 6 + 1] AS vendor, 'org' || (c_custkey % 50)::VARCHAR AS slug,
    DATE '2024-02-01' AS probed_on, {lst(FX.PROBE_OUTCOMES)}[c_custkey % 4 + 1] AS status,
    CASE WHEN {lst(FX.PROBE_OUTCOMES)}[c_custkey % 4 + 1] = 'ok' THEN c_custkey % 17 ELSE 0 END AS count,
    CASE WHEN c_custkey % 4 = 0 THEN 'Vendor ' || c_name ELSE '' END AS company_name,
    CASE {lst(FX.PROBE_OUTCOMES)}[c_custkey % 4 + 1] WHEN '404' THEN 'no board at this slug'
         WHEN 'error' THEN 'timeout' ELSE (c_custkey % 17)::VARCHAR || ' listed jobs' END AS detail
  FROM customer)""",
        """probe_last AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY vendor, slug ORDER BY line_no DESC) AS rn FROM probe_log)
  WHERE rn = 1)""",
    ]


def crawl_ctes() -> list[str]:
    s = "(page_id % 40)::VARCHAR"
    link = f"""CASE page_id % 12
      WHEN 0 THEN '<a href="https://boards.greenhouse.io/Acme' || {s} || '">jobs</a>'
      WHEN 1 THEN '<a href="https://job-boards.greenhouse.io/acme' || {s} || '/jobs/42">x</a>'
      WHEN 2 THEN '<script src="https://boards.greenhouse.io/embed/job_board/js?for=acme' || {s} || '"></script>'
      WHEN 3 THEN '<a href="https://boards.greenhouse.io/embed">embed</a>'
      WHEN 4 THEN '<a href="https://jobs.lever.co/ACME' || {s} || '">lever</a>'
      WHEN 5 THEN '<a href="https://jobs.ashbyhq.com/Acme%20Co' || {s} || '">ashby</a>'
      WHEN 6 THEN '<a href="https://apply.workable.com/api/v3/accounts/acme' || {s} || '">w</a>'
      WHEN 7 THEN '<a href="https://jobs.smartrecruiters.com/Acme' || {s} || '">sr</a>'
      WHEN 8 THEN '<a href="https://acme' || {s} || '.wd5.myworkdayjobs.com/en-US/External">wd</a>'
      WHEN 9 THEN '<a href="https://acme' || {s} || '.wd1.myworkdayjobs.com/Careers">wd</a>'
      ELSE '' END"""
    paths = lst(R.CANDIDATE_PATHS)
    return [
        f"""crawl AS (
  SELECT page_id, domain, page_id % 3 AS candidate_rank,
    'https://' || domain || {paths}[page_id % 3 + 1] AS url,
    CASE WHEN page_id % 12 = 10 AND page_id % 2 = 0 THEN 'https://jobs.lever.co/redir' || {s}
         ELSE 'https://' || domain || {paths}[page_id % 3 + 1] END AS final_url,
    CASE WHEN page_id % 13 = 0 THEN 404 ELSE 200 END AS http_status,
    html || {link} AS html
  FROM (SELECT *, {domain_sql('url')} AS domain FROM pages))""",
        """crawl_hay AS (SELECT page_id, domain, candidate_rank, http_status, final_url || chr(10) || html AS hay FROM crawl)""",
    ]


def refs_ctes(src: str = "crawl_hay") -> list[str]:
    parts = []
    for i, (vendor, rx) in enumerate(R.BOARD_PATTERNS):
        parts.append(
            f"SELECT page_id, {i} AS pi, {q(vendor)} AS vendor, unnest(ms) AS raw, generate_subscripts(ms, 1) AS j "
            f"FROM (SELECT page_id, regexp_extract_all(hay, {q(rx)}, 1) AS ms FROM {src})")
    lower_v = ", ".join(q(v) for v in R.LOWERCASE_SLUG_VENDORS)
    junk = " OR ".join(
        f"(vendor = {q(v)} AND lower(slug) IN ({', '.join(q(j) for j in js)}))" for v, js in R.JUNK_SLUGS.items())
    urls = "CASE vendor " + " ".join(
        f"WHEN {q(v)} THEN {q(u.replace('{slug}', ''))} || slug" for v, u in R.BOARD_URLS.items()) + " END"
    wd = R.WORKDAY_PATTERN
    n = len(R.BOARD_PATTERNS)
    return [
        "ref_raw AS (" + " UNION ALL ".join(parts) + ")",
        f"""ref_clean AS (
  SELECT page_id, pi, j, vendor,
    CASE WHEN vendor IN ({lower_v}) THEN lower(s2) ELSE s2 END AS slug
  FROM (SELECT *, regexp_replace(regexp_replace(url_decode(raw), '^\\s+|\\s+$', '', 'g'), '[.-]+$', '') AS s2
        FROM ref_raw))""",
        f"""ref_std AS (
  SELECT page_id, pi, j, vendor, slug, {urls} AS board_url FROM ref_clean
  WHERE slug <> '' AND NOT ({junk}))""",
        f"""ref_wd AS (
  SELECT page_id, {n} AS pi, j, 'workday' AS vendor, t || '.wd' || nn || '/' || site AS slug,
    'https://' || t || '.wd' || nn || '.myworkdayjobs.com/' || site AS board_url
  FROM (SELECT page_id, unnest(a) AS t, unnest(b) AS nn, unnest(c) AS site, generate_subscripts(a, 1) AS j
        FROM (SELECT page_id, regexp_extract_all(hay, {q(wd)}, 1) AS a, regexp_extract_all(hay, {q(wd)}, 2) AS b,
                     regexp_extract_all(hay, {q(wd)}, 4) AS c FROM {src}))
  WHERE lower(coalesce(site, '')) <> 'wday')""",
        """refs AS (
  SELECT page_id, vendor, slug, board_url, min(pi * 1000000 + j) AS ord
  FROM (SELECT * FROM ref_std UNION ALL SELECT * FROM ref_wd)
  GROUP BY page_id, vendor, slug, board_url)""",
    ]


def board_refs() -> str:
    return with_(crawl_ctes() + refs_ctes()) + """SELECT c.page_id,
  coalesce(string_agg(r.vendor || ' ' || r.slug || ' ' || r.board_url, ' | ' ORDER BY r.ord), '') AS refs
FROM crawl c LEFT JOIN refs r USING (page_id) GROUP BY c.page_id"""


def _found_ctes(where: str = "TRUE") -> list[str]:
    return crawl_ctes() + [
        f"crawl_ok AS (SELECT * FROM crawl_hay WHERE http_status < 400 AND {where})",
    ] + refs_ctes("crawl_ok") + [
        """first_page AS (
  SELECT domain, arg_min(page_id, (candidate_rank, page_id)) AS page_id
  FROM crawl_ok WHERE page_id IN (SELECT page_id FROM refs) GROUP BY domain)""",
        f"""found AS (
  SELECT f.domain, r.vendor, r.slug, r.board_url, {name_guess_sql('f.domain')} AS company_name,
    (row_number() OVER (PARTITION BY f.domain ORDER BY r.ord) - 1)::INTEGER AS ref_pos
  FROM first_page f JOIN refs r USING (page_id))""",
    ]


def discover_orgs() -> str:
    return with_(_found_ctes()) + "SELECT domain, vendor, slug, board_url, company_name, ref_pos FROM found"


def no_match_markers() -> str:
    return with_(_found_ctes()) + f"""SELECT DISTINCT domain, 'unknown' AS vendor, domain AS slug,
  {name_guess_sql('domain')} AS company_name, {q(R.NO_MATCH_NOTE)} AS notes
FROM crawl WHERE domain NOT IN (SELECT domain FROM found)"""


def lines_cte() -> str:
    return f"""lines AS (
  SELECT page_id AS line_no,
    CASE WHEN page_id % 37 = 0 THEN '' WHEN page_id % 10 = 0 THEN '# ' || url ELSE url END AS raw
  FROM pages
  UNION ALL
  SELECT 1000000000 + c_custkey, 'https://www.customer' || c_custkey::VARCHAR || '.example.com/about'
  FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 11 <> 0)"""


def _plan_ctes() -> list[str]:
    return registry_ctes() + [lines_cte(), f"""plan AS (
  SELECT line_no, domain,
    CASE WHEN domain = '' OR starts_with(domain, '#') THEN 'ignored'
         WHEN domain IN (SELECT domain FROM reg WHERE domain <> '') THEN 'known'
         WHEN line_no = min(line_no) OVER (PARTITION BY domain) THEN 'todo'
         ELSE 'repeat' END AS action
  FROM (SELECT line_no, {domain_sql('raw')} AS domain FROM lines))"""]


def domains_to_scan() -> str:
    return with_(_plan_ctes()) + "SELECT line_no, domain, action FROM plan"


def reg_out(src: str) -> str:
    return f"""SELECT vendor, slug, company_name, domain, board_url, status,
  strftime(last_verified, '%Y-%m-%d') AS last_verified, last_posting_count::BIGINT AS last_posting_count,
  discovered_via, notes FROM {src}"""


def last_write_wins() -> str:
    return with_(registry_ctes()) + reg_out("reg")


def _merged_ctes() -> list[str]:
    """The candidates of ``cand`` folded into ``reg``."""
    return [
        """cagg AS (
  SELECT vendor, slug,
    arg_min(company_name, ordinal) FILTER (WHERE company_name <> '') AS c_company_name,
    arg_min(domain, ordinal) FILTER (WHERE domain <> '') AS c_domain,
    arg_min(board_url, ordinal) FILTER (WHERE board_url <> '') AS c_board_url,
    arg_min(discovered_via, ordinal) FILTER (WHERE discovered_via <> '') AS c_discovered_via,
    arg_min(status, ordinal) AS c_status, arg_min(last_posting_count, ordinal) AS c_count,
    arg_min(notes, ordinal) AS c_notes
  FROM cand GROUP BY vendor, slug)""",
        """merged AS (
  SELECT coalesce(r.vendor, c.vendor) AS vendor, coalesce(r.slug, c.slug) AS slug,
    CASE WHEN coalesce(r.company_name, '') <> '' THEN r.company_name ELSE coalesce(c.c_company_name, r.company_name, '') END AS company_name,
    CASE WHEN coalesce(r.domain, '') <> '' THEN r.domain ELSE coalesce(c.c_domain, r.domain, '') END AS domain,
    CASE WHEN coalesce(r.board_url, '') <> '' THEN r.board_url ELSE coalesce(c.c_board_url, r.board_url, '') END AS board_url,
    CASE WHEN r.vendor IS NOT NULL THEN r.status ELSE c.c_status END AS status,
    CASE WHEN r.vendor IS NOT NULL THEN r.last_verified END AS last_verified,
    CASE WHEN r.vendor IS NOT NULL THEN r.last_posting_count ELSE c.c_count END AS last_posting_count,
    CASE WHEN coalesce(r.discovered_via, '') <> '' THEN r.discovered_via ELSE coalesce(c.c_discovered_via, r.discovered_via, '') END AS discovered_via,
    CASE WHEN r.vendor IS NOT NULL THEN r.notes ELSE c.c_notes END AS notes
  FROM reg r FULL OUTER JOIN cagg c ON r.vendor = c.vendor AND r.slug = c.slug)""",
    ]


def registry_upsert() -> str:
    ctes = registry_ctes() + _found_ctes() + [
        """cand AS (
  SELECT 'Seen ' || slug AS company_name, slug || '.example.net' AS domain, vendor, slug,
    'https://boards.example.net/' || slug AS board_url, 'unverified' AS status, NULL::DATE AS last_verified,
    0::BIGINT AS last_posting_count, CASE WHEN line_no % 2 = 0 THEN 'rescan' ELSE '' END AS discovered_via,
    '' AS notes, (0, '', line_no::BIGINT) AS ordinal FROM reg_log
  UNION ALL
  SELECT company_name, domain, vendor, slug, board_url, 'unverified', NULL::DATE, 0::BIGINT, 'pages', '',
    (1, domain, ref_pos::BIGINT) FROM found)""",
    ]
    return with_(ctes + _merged_ctes()) + reg_out("merged")


def registry_added() -> str:
    ctes = _plan_ctes() + _found_ctes("domain IN (SELECT domain FROM plan WHERE action = 'todo')") + [
        f"""cand AS (
  SELECT company_name, domain, vendor, slug, board_url, 'unverified' AS status, NULL::DATE AS last_verified,
    0::BIGINT AS last_posting_count, 'list' AS discovered_via, '' AS notes, (0, domain, ref_pos::BIGINT) AS ordinal
  FROM found
  UNION ALL
  SELECT DISTINCT {name_guess_sql('domain')}, domain, 'unknown', domain, '', 'unverified', NULL::DATE, 0::BIGINT,
    'list', {q(R.NO_MATCH_NOTE)}, (1, domain, 0::BIGINT)
  FROM crawl WHERE domain IN (SELECT domain FROM plan WHERE action = 'todo')
    AND domain NOT IN (SELECT domain FROM found))"""]
    return with_(ctes + _merged_ctes()) + reg_out("merged")


def registry_add() -> str:
    ctes = _plan_ctes() + _found_ctes("domain IN (SELECT domain FROM plan WHERE action = 'todo')") + [
        """todo_pages AS (SELECT DISTINCT domain FROM crawl WHERE domain IN (SELECT domain FROM plan WHERE action = 'todo'))""",
    ]
    return with_(ctes) + """SELECT
  (SELECT count(*) FROM todo_pages) AS scanned,
  (SELECT count(*) FROM plan WHERE action IN ('known', 'repeat')) AS skipped,
  (SELECT count(*) FROM found) AS orgs_found,
  (SELECT count(*) FROM todo_pages WHERE domain NOT IN (SELECT domain FROM found)) AS no_match"""


def _applied_ctes() -> list[str]:
    return registry_ctes() + ["""applied AS (
  SELECT
    CASE WHEN p.status = 'ok' AND r.vendor <> 'unknown' AND coalesce(p.company_name, '') <> '' THEN p.company_name ELSE r.company_name END AS company_name,
    r.domain, r.vendor, r.slug, r.board_url,
    CASE WHEN r.vendor = 'unknown' OR p.status IS NULL THEN r.status
         WHEN p.status = 'ok' THEN 'live' WHEN p.status = '404' THEN 'dead' ELSE r.status END AS status,
    CASE WHEN r.vendor <> 'unknown' AND p.status IN ('ok', '404') THEN p.probed_on ELSE r.last_verified END AS last_verified,
    CASE WHEN r.vendor <> 'unknown' AND p.status = 'ok' THEN p.count
         WHEN r.vendor <> 'unknown' AND p.status = '404' THEN 0 ELSE r.last_posting_count END AS last_posting_count,
    r.discovered_via,
    CASE WHEN r.vendor <> 'unknown' AND p.status = 'ok' AND r.status = 'dead'
           THEN concat_ws('; ', nullif(r.notes, ''), 'back from the dead on ' || strftime(p.probed_on, '%Y-%m-%d') || ' with ' || p.count::VARCHAR || ' postings')
         WHEN r.vendor <> 'unknown' AND p.status = '404' AND r.status <> 'dead'
           THEN concat_ws('; ', nullif(r.notes, ''), 'went dead on ' || strftime(p.probed_on, '%Y-%m-%d') || ': ' || p.detail)
         ELSE r.notes END AS notes
  FROM reg r LEFT JOIN probe_last p ON r.vendor = p.vendor AND r.slug = p.slug)"""]


def registry_apply_probes() -> str:
    return with_(_applied_ctes()) + reg_out("applied")


def registry_probe_counts() -> str:
    return with_(registry_ctes()) + """SELECT count(*) AS checked,
  count(*) FILTER (WHERE p.status = 'ok') AS live,
  count(*) FILTER (WHERE p.status = '404') AS dead,
  count(*) FILTER (WHERE p.status NOT IN ('ok', '404')) AS error,
  count(*) FILTER (WHERE p.status = '404' AND r.status = 'live') AS went_dead,
  count(*) FILTER (WHERE p.status = 'ok' AND r.status = 'dead') AS revived
FROM reg r JOIN probe_last p ON r.vendor = p.vendor AND r.slug = p.slug WHERE r.vendor <> 'unknown'"""


def registry_stats() -> str:
    return with_(registry_ctes()) + """SELECT metric, '' AS vendor, n FROM (
  SELECT 'total' AS metric, count(*)::BIGINT AS n FROM reg
  UNION ALL SELECT 'live', count(*) FILTER (WHERE vendor <> 'unknown' AND status = 'live') FROM reg
  UNION ALL SELECT 'dead', count(*) FILTER (WHERE vendor <> 'unknown' AND status = 'dead') FROM reg
  UNION ALL SELECT 'unverified', count(*) FILTER (WHERE vendor <> 'unknown' AND status NOT IN ('live', 'dead')) FROM reg
  UNION ALL SELECT 'no_ats_found', count(*) FILTER (WHERE vendor = 'unknown') FROM reg
  UNION ALL SELECT 'postings_last_seen', coalesce(sum(last_posting_count) FILTER (WHERE vendor <> 'unknown' AND status = 'live'), 0)::BIGINT FROM reg)
UNION ALL
SELECT 'live_by_vendor', vendor, count(*)::BIGINT FROM reg WHERE vendor <> 'unknown' AND status = 'live' GROUP BY vendor"""


def stalest_first() -> str:
    return with_(registry_ctes() + ["""stale AS (
  SELECT * FROM reg WHERE vendor <> 'unknown'
  ORDER BY last_verified IS NOT NULL, last_verified, vendor, slug LIMIT 25)"""]) + reg_out("stale")


def live_orgs() -> str:
    return with_(registry_ctes() + ["live AS (SELECT * FROM reg WHERE status = 'live' AND vendor <> 'unknown')"]) + reg_out("live")


def slug_lookup() -> str:
    v = ", ".join(f"({q(x)})" for x in R.VENDORS)
    return with_(registry_ctes()) + f"""SELECT s.slug, vv.vendor, p.status, p.count,
  CASE WHEN p.status = '404' THEN 'no board at this slug' ELSE p.detail END AS detail
FROM (SELECT DISTINCT slug FROM reg) s
JOIN (VALUES {v}) vv(vendor) ON vv.vendor <> 'workday' OR contains(s.slug, '/')
LEFT JOIN probe_last p ON p.vendor = vv.vendor AND p.slug = s.slug"""

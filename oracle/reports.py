"""DuckDB oracles for the report tables."""

from __future__ import annotations

from hirefold import rules as R
from oracle.base import postings_ctes, q, with_
from oracle.funnel import family_sql
from oracle.history import _routes_ctes
from oracle.registry import registry_ctes
from oracle.state import _norm_company, norm_title, public_ctes, sight_ctes, ts


def runs_ctes() -> list[str]:
    return [
        """runs_day AS (
  SELECT ts::DATE AS date, count(*)::BIGINT AS postings_read, count(DISTINCT user_id)::BIGINT AS orgs_scanned,
    count(*) FILTER (WHERE event_type = 'error')::BIGINT AS zombies,
    count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS survivors,
    date_diff('day', DATE '2024-01-01', ts::DATE) AS idx
  FROM events GROUP BY ts::DATE)""",
        """runs AS (
  SELECT date, postings_read // 2 AS postings_read, orgs_scanned, NULL::BIGINT AS zombies,
    zombies AS liveness, 0::BIGINT AS survivors, idx * 2 AS line_no FROM runs_day WHERE idx % 3 = 0
  UNION ALL
  SELECT date, postings_read, orgs_scanned, zombies, zombies AS liveness, survivors, idx * 2 + 1 FROM runs_day)""",
        "week_end AS (SELECT max(ts)::DATE AS d FROM events)",
        """week_runs AS (
  SELECT * FROM runs WHERE date BETWEEN (SELECT d FROM week_end) - 6 AND (SELECT d FROM week_end)
  QUALIFY row_number() OVER (PARTITION BY date ORDER BY line_no DESC) = 1)""",
    ]


def latest_run_per_date() -> str:
    return with_(runs_ctes()) + """SELECT strftime(date, '%Y-%m-%d') AS date, postings_read, orgs_scanned,
  zombies, liveness, survivors, line_no FROM week_runs"""


def weekly_report_stats() -> str:
    return with_(runs_ctes()) + """SELECT
  isoyear(w.d)::VARCHAR || '-W' || lpad(week(w.d)::VARCHAR, 2, '0') AS week_label,
  strftime(w.d - 6, '%Y-%m-%d') AS start, strftime(w.d, '%Y-%m-%d') AS "end",
  coalesce((SELECT sum(postings_read) FROM week_runs), 0)::BIGINT AS postings_read,
  coalesce((SELECT max(orgs_scanned) FROM week_runs), 0)::BIGINT AS orgs_scanned,
  coalesce((SELECT sum(coalesce(zombies, liveness, 0)) FROM week_runs), 0)::BIGINT AS ghosts,
  coalesce((SELECT survivors FROM week_runs ORDER BY date DESC LIMIT 1), 0)::BIGINT AS verified_live
FROM week_end w"""


def seen_store_ctes() -> list[str]:
    return sight_ctes() + ["""seen_pub AS (
  SELECT s.*, s.id IN (SELECT id FROM sight WHERE title = 'purchase') AS public,
    CASE WHEN s.id IN (SELECT id FROM sight WHERE title = 'purchase') THEN 'not published' ELSE '' END AS comp_band,
    CASE WHEN s.id IN (SELECT id FROM sight WHERE title = 'purchase') THEN 'not stated' ELSE '' END AS location
  FROM seen_end s)""", "wk AS (SELECT max(run_ts)::DATE AS d FROM sight)"]


def mark_public() -> str:
    return with_(seen_store_ctes()) + "SELECT id, public, comp_band, location FROM seen_pub"


def weekly_new_roles() -> str:
    return with_(seen_store_ctes()) + """SELECT id, company_name AS company, title, comp_band, location, url,
  public AND closed_at IS NULL AS listed FROM seen_pub
WHERE first_seen::DATE < (SELECT min(ts)::DATE FROM events) + 7"""


def weekly_closed_roles() -> str:
    return with_(seen_store_ctes()) + """SELECT id, company_name AS company, title, public,
  greatest(date_diff('second', first_seen, closed_at) // 86400, 1)::BIGINT AS days_alive
FROM seen_pub WHERE closed_at IS NOT NULL AND closed_at::DATE BETWEEN (SELECT d FROM wk) - 6 AND (SELECT d FROM wk)"""


def _collapse(src: str, name: str, posted: str) -> str:
    ck, tk = _norm_company("company"), norm_title("title")
    return f"""{name}_k AS (SELECT *, {ck} AS ck, {tk} AS tk, coalesce({posted}, first_seen) AS pk FROM {src}),
{name}_g AS (
  SELECT ck, tk, count(DISTINCT vendor) AS nv, arg_min(id, (pk, id)) AS keeper_id, arg_min(vendor, (pk, id)) AS keeper_vendor
  FROM {name}_k WHERE closed_at IS NULL GROUP BY ck, tk),
{name} AS (
  SELECT k.* EXCLUDE (ck, tk, pk),
    CASE WHEN k.closed_at IS NULL AND g.nv >= 2 AND k.vendor <> g.keeper_vendor THEN g.keeper_id END AS collapsed_into
  FROM {name}_k k LEFT JOIN {name}_g g ON k.ck = g.ck AND k.tk = g.tk)"""


def board_ctes() -> list[str]:
    return public_ctes() + [
        """board_raw AS (
  SELECT id, vendor, org_key, company_name AS company, title, '' AS comp_band, '' AS location, FALSE AS remote,
    url, NULL::TIMESTAMP AS posted_at, first_seen, last_seen, last_seen AS last_verified, closed_at
  FROM public_end)""",
        _collapse("board_raw", "board", "posted_at"),
        "bnow AS (SELECT max(run_ts) AS now FROM nights_all)",
        """bmirrors AS (SELECT collapsed_into AS id, count(*)::BIGINT AS mirrors FROM board WHERE collapsed_into IS NOT NULL GROUP BY 1)""",
    ]


def _vendor_label(col: str) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.VENDOR_LABELS.items()) + \
        f" ELSE upper({col}[1]) || lower({col}[2:]) END"


def _loc_label(loc: str, remote: str) -> str:
    base = f"(CASE WHEN coalesce({loc}, '') = '' THEN 'not stated' ELSE {loc} END)"
    return f"(CASE WHEN coalesce({remote}, FALSE) AND NOT contains(lower({base}), 'remote') THEN {base} || ' (remote)' ELSE {base} END)"


def board_open() -> str:
    return with_(board_ctes()) + f"""SELECT b.id,
  CASE WHEN b.first_seen::DATE >= (SELECT now FROM bnow)::DATE - 6 THEN 'new' ELSE 'still_open' END AS section,
  b.company, b.title, b.comp_band, {_loc_label('b.location', 'b.remote')} AS location,
  {_vendor_label('b.vendor')} AS vendor, coalesce(strftime(b.posted_at, '%Y-%m-%d'), 'not stated') AS posted,
  b.url, strftime(b.last_verified, '%Y-%m-%d') AS verified, coalesce(m.mirrors, 0)::BIGINT AS mirrors
FROM board b LEFT JOIN bmirrors m USING (id) WHERE b.closed_at IS NULL AND b.collapsed_into IS NULL"""


def board_closed() -> str:
    return with_(board_ctes()) + f"""SELECT b.id, b.company, b.title, {_loc_label('b.location', 'b.remote')} AS location,
  {_vendor_label('b.vendor')} AS vendor, b.url, strftime(b.closed_at, '%Y-%m-%d') AS closed,
  greatest(date_diff('second', b.first_seen, b.closed_at) // 86400, 1)::BIGINT AS days_open,
  coalesce(m.mirrors, 0)::BIGINT AS mirrors
FROM board b LEFT JOIN bmirrors m USING (id)
WHERE b.closed_at IS NOT NULL AND b.collapsed_into IS NULL AND b.closed_at::DATE >= (SELECT now FROM bnow)::DATE - 6"""


def board_stats() -> str:
    return with_(board_ctes() + runs_ctes()) + """SELECT
  coalesce(strftime((SELECT max(last_verified) FROM board), '%Y-%m-%d %H:%M UTC'),
           strftime((SELECT max(date) FROM week_runs), '%Y-%m-%d'), 'never') AS last_run,
  coalesce((SELECT max(orgs_scanned) FROM week_runs), 0)::BIGINT AS boards_read,
  coalesce((SELECT postings_read FROM week_runs ORDER BY date DESC LIMIT 1), 0)::BIGINT AS postings_read,
  (SELECT count(*) FROM board WHERE closed_at IS NULL AND collapsed_into IS NULL)::BIGINT AS verified_live,
  (SELECT count(*) FROM board WHERE closed_at IS NOT NULL AND collapsed_into IS NULL
     AND closed_at::DATE >= (SELECT now FROM bnow)::DATE - 6)::BIGINT AS closed_this_week"""


def pstore_ctes() -> list[str]:
    floor_cur = "(CASE WHEN upper(coalesce(comp_currency, 'USD')) = 'USD' THEN '$' ELSE comp_currency || ' ' END)"
    band = f"""CASE WHEN comp_min IS NOT NULL AND comp_max IS NOT NULL
         THEN {floor_cur} || format('{{:,}}', comp_min) || ' to ' || {floor_cur} || format('{{:,}}', comp_max)
       WHEN comp_min IS NOT NULL THEN 'from ' || {floor_cur} || format('{{:,}}', comp_min)
       ELSE 'up to ' || {floor_cur} || format('{{:,}}', comp_max) END"""
    return postings_ctes() + [
        "pnow AS (SELECT max(published_at) + INTERVAL 1 DAY AS now FROM postings)",
        f"""pstore_raw AS (
  SELECT id, source AS vendor, source || ':' || org_slug AS org_key, company_name AS company, title,
    CASE WHEN comp_source <> 'none' AND (comp_min IS NOT NULL OR comp_max IS NOT NULL) THEN {band} ELSE '' END AS comp_band,
    coalesce(location_raw, '') AS location, coalesce(is_remote, FALSE) AS remote, coalesce(url, '') AS url,
    published_at AS posted_at, (SELECT now FROM pnow) AS first_seen, (SELECT now FROM pnow) AS last_seen,
    (SELECT now FROM pnow) AS last_verified, NULL::TIMESTAMP AS closed_at
  FROM postings WHERE {family_sql('title')} IS NOT NULL)""",
        _collapse("pstore_raw", "pstore", "posted_at"),
    ]


def mirror_counts() -> str:
    return with_(pstore_ctes()) + """SELECT collapsed_into AS id, count(*) AS mirrors FROM pstore
WHERE collapsed_into IS NOT NULL GROUP BY 1"""


def public_projection() -> str:
    return with_(pstore_ctes()) + f"""SELECT id, vendor, org_key, company, title, comp_band, location, remote, url,
  strftime(posted_at, '%Y-%m-%d') AS posted_at, {ts('first_seen')} AS first_seen, collapsed_into FROM pstore"""


def pages_ctes() -> list[str]:
    return pstore_ctes() + registry_ctes() + [
        "run_day AS (SELECT max(ts)::DATE AS d FROM events)",
        """live_orgs AS (
  SELECT *, vendor || ':' || slug AS org_key,
    trim(regexp_replace(lower(vendor || '-' || slug), '[^a-z0-9]+', '-', 'g'), '-') AS base
  FROM reg WHERE status = 'live' AND vendor <> 'unknown')""",
        """named AS (
  SELECT *, base || repeat('-2', (row_number() OVER (PARTITION BY base ORDER BY vendor, slug) - 1)::INTEGER) AS dirname
  FROM live_orgs)""",
        """porg AS (
  SELECT org_key, max(last_verified) AS stamp, count(*) FILTER (WHERE closed_at IS NULL) AS n_open,
    arg_min(company, (lower(title), id)) FILTER (WHERE closed_at IS NULL) AS first_company
  FROM pstore GROUP BY org_key)""",
        """pages AS (
  SELECT o.vendor, o.slug, o.org_key, o.dirname,
    CASE WHEN coalesce(o.company_name, '') <> '' THEN o.company_name
         WHEN coalesce(p.n_open, 0) > 0 THEN p.first_company ELSE o.slug END AS company,
    coalesce(p.n_open, 0) > 0 AS hiring, coalesce(p.n_open, 0)::BIGINT AS n_roles,
    CASE WHEN p.stamp IS NOT NULL AND (o.last_verified IS NULL OR p.stamp::DATE >= o.last_verified) THEN strftime(p.stamp, '%Y-%m-%d')
         WHEN o.last_verified IS NOT NULL THEN strftime(o.last_verified, '%Y-%m-%d')
         ELSE strftime((SELECT d FROM run_day), '%Y-%m-%d') END AS as_of,
    CASE WHEN p.stamp IS NOT NULL AND (o.last_verified IS NULL OR p.stamp::DATE >= o.last_verified) THEN strftime(p.stamp, '%Y-%m-%d %H:%M UTC')
         WHEN o.last_verified IS NOT NULL THEN strftime(o.last_verified, '%Y-%m-%d')
         ELSE strftime((SELECT d FROM run_day), '%Y-%m-%d') END AS last_checked
  FROM named o LEFT JOIN porg p USING (org_key))""",
        f"""page_roles AS (
  SELECT g.dirname, lower(s.title) AS sort_title, s.id, s.title, s.company, s.comp_band,
    {_loc_label('s.location', 's.remote')} AS location_label,
    coalesce(strftime(s.posted_at, '%Y-%m-%d'), 'not stated') AS posted, s.url, s.posted_at, s.location, s.remote
  FROM pstore s JOIN pages g USING (org_key) WHERE s.closed_at IS NULL)""",
    ]


def company_pages() -> str:
    return with_(pages_ctes()) + """SELECT vendor, slug, dirname, company, hiring, n_roles, as_of, last_checked,
  CASE WHEN hiring THEN 'Yes: ' || n_roles::VARCHAR || ' open GTM/RevOps ' || CASE WHEN n_roles = 1 THEN 'role' ELSE 'roles' END || ' as of ' || as_of || '.'
       ELSE 'No live GTM or RevOps roles verified as of ' || strftime((SELECT d FROM run_day), '%Y-%m-%d') || '.' END AS headline
FROM pages"""


def company_page_roles() -> str:
    return with_(pages_ctes()) + "SELECT dirname, sort_title, id, title, comp_band, location_label, posted, url FROM page_roles"


def pages_totals() -> str:
    return with_(pages_ctes()) + """SELECT count(*) FILTER (WHERE hiring)::BIGINT AS hiring_count,
  count(*) FILTER (WHERE NOT hiring)::BIGINT AS quiet_count, coalesce(sum(n_roles), 0)::BIGINT AS total_roles FROM pages"""


def jsonld_rows() -> str:
    return with_(pages_ctes()) + """SELECT dirname, sort_title, id, replace(
  '{"@context":"https://schema.org/","@type":"JobPosting","title":' || to_json(title)::VARCHAR
  || ',"hiringOrganization":{"@type":"Organization","name":' || to_json(company)::VARCHAR || '}'
  || ',"url":' || to_json(url)::VARCHAR || ',"directApply":true'
  || CASE WHEN posted_at IS NOT NULL THEN ',"datePosted":"' || strftime(posted_at, '%Y-%m-%d') || '"' ELSE '' END
  || CASE WHEN coalesce(location, '') <> '' THEN ',"jobLocation":{"@type":"Place","address":{"@type":"PostalAddress","addressLocality":'
          || to_json(location)::VARCHAR || '}}' ELSE '' END
  || CASE WHEN remote THEN ',"jobLocationType":"TELECOMMUTE"' ELSE '' END || '}', '</', '<\\/') AS jsonld
FROM page_roles"""


def sitemap_rows() -> str:
    base = R.SITE_BASE_URL
    return with_(pages_ctes()) + f"""SELECT loc, lastmod FROM (
  SELECT {q(base + '/')} AS loc, strftime((SELECT d FROM run_day), '%Y-%m-%d') AS lastmod
  UNION ALL SELECT {q(base + '/companies/')}, strftime((SELECT d FROM run_day), '%Y-%m-%d')
  UNION ALL SELECT {q(base + '/methodology/')}, strftime((SELECT d FROM run_day), '%Y-%m-%d')
  UNION ALL SELECT {q(base + '/companies/')} || dirname || '/', as_of FROM pages)"""


def dirname_collisions() -> str:
    from oracle.registry import registry_upsert
    inner = registry_upsert()
    return f"""SELECT vendor, slug,
  base || repeat('-2', (row_number() OVER (PARTITION BY base ORDER BY vendor, slug) - 1)::INTEGER) AS dirname
FROM (SELECT vendor, slug, trim(regexp_replace(lower(vendor || '-' || slug), '[^a-z0-9]+', '-', 'g'), '-') AS base
      FROM ({inner}))"""


def _digest_ctes() -> list[str]:
    cur = "(CASE WHEN upper(coalesce(pp.comp_currency, 'USD')) = 'USD' THEN '$' ELSE pp.comp_currency || ' ' END)"
    return _routes_ctes() + [f"""digest AS (
  SELECT r.id, r.route, pp.company_name AS company, pp.title,
    CASE WHEN NOT (pp.comp_source <> 'none' AND (pp.comp_min IS NOT NULL OR pp.comp_max IS NOT NULL)) THEN 'not published'
         WHEN pp.comp_min IS NOT NULL AND pp.comp_max IS NOT NULL THEN {cur} || format('{{:,}}', pp.comp_min) || ' to ' || {cur} || format('{{:,}}', pp.comp_max)
         WHEN pp.comp_min IS NOT NULL THEN 'from ' || {cur} || format('{{:,}}', pp.comp_min)
         ELSE 'up to ' || {cur} || format('{{:,}}', pp.comp_max) END AS band,
    {_loc_label('pp.location_raw', 'pp.is_remote')} AS location,
    coalesce(strftime(pp.published_at, '%Y-%m-%d'), 'unknown') AS posted, pp.url,
    concat_ws(' | ', v.reasons, n.note) AS reasons, r.flags
  FROM routes r JOIN postings pp USING (id) JOIN fv v USING (id) JOIN noted n USING (id))"""]


def digest_rows() -> str:
    return with_(_digest_ctes()) + """SELECT id, route AS section, company, title, band, location, posted, url, reasons, flags
FROM digest WHERE route IN ('kept', 'flagged')"""


def suppressed_top() -> str:
    n = R.DIGEST_TOP_SUPPRESSED
    return with_(_digest_ctes() + ["""hwin2 AS (
  SELECT id, arg_min_null(date, (NOT wide, ordinal)) AS sdate, arg_min_null(reason, (NOT wide, ordinal)) AS sreason
  FROM (SELECT m.*, h.reason FROM hm m JOIN hist h USING (ordinal)) GROUP BY id)"""]) + f"""SELECT d.company, d.title, d.id,
  n.sup_status AS status, w.sdate AS date, w.sreason AS reason,
  greatest((SELECT count(*) FROM routes WHERE route = 'suppressed') - {n}, 0)::BIGINT AS more
FROM digest d JOIN noted n USING (id) JOIN hwin2 w USING (id)
WHERE d.route = 'suppressed' ORDER BY d.company, d.title, d.id LIMIT {n}"""

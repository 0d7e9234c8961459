"""DuckDB oracles for the sighting state (nightly fold and one-pass history).

Written with correlated subqueries ("the org's first answered night after
this one", "the role's first sighting after this one") instead of window
functions, as an independent formulation.
"""

from __future__ import annotations

from hirefold import rules as R
from oracle.base import lst, with_

TS = "'%Y-%m-%d %H:%M:%S'"


def ts(expr: str) -> str:
    return f"strftime({expr}, {TS})"


def sight_ctes(where: str = "TRUE") -> list[str]:
    return [
        f"""sight_all AS (
  SELECT DISTINCT ts::DATE::TIMESTAMP AS run_ts,
    v || ':user' || user_id::VARCHAR || ':' || event_type AS id,
    v || ':user' || user_id::VARCHAR AS org_key, v AS vendor, event_type AS title,
    'Org' || (user_id % 75)::VARCHAR AS company_name,
    'https://jobs.example.com/' || v || '/user' || user_id::VARCHAR || '/' || event_type AS url
  FROM (SELECT *, {lst(R.VENDORS)}[user_id % 6 + 1] AS v FROM events))""",
        "nights_all AS (SELECT DISTINCT ts::DATE::TIMESTAMP AS run_ts FROM events)",
        "last_night AS (SELECT max(run_ts) AS now FROM nights_all)",
        f"sight AS (SELECT * FROM sight_all WHERE {where})",
        "answered AS (SELECT DISTINCT org_key, run_ts FROM sight)",
        f"nights AS (SELECT * FROM nights_all WHERE {where})",
        """links AS (
  SELECT s.*,
    (SELECT min(a.run_ts) FROM answered a WHERE a.org_key = s.org_key AND a.run_ts > s.run_ts) AS nx,
    (SELECT min(t.run_ts) FROM sight t WHERE t.id = s.id AND t.run_ts > s.run_ts) AS ns
  FROM sight s)""",
        """closes AS (
  SELECT *, CASE WHEN nx IS NOT NULL AND (ns IS NULL OR ns > nx) THEN nx END AS closed_on FROM links)""",
        """seen_end AS (
  SELECT id,
    arg_min(org_key, run_ts) AS org_key, arg_min(company_name, run_ts) AS company_name,
    coalesce(arg_max(title, run_ts) FILTER (WHERE title <> ''), arg_min(title, run_ts)) AS title,
    coalesce(arg_max(url, run_ts) FILTER (WHERE url <> ''), arg_min(url, run_ts)) AS url,
    min(run_ts) AS first_seen, max(run_ts) AS last_seen,
    max(closed_on) FILTER (WHERE ns IS NULL) AS closed_at,
    count(closed_on) AS n_closures,
    count(*) FILTER (WHERE closed_on IS NOT NULL AND ns IS NOT NULL) AS n_reopened
  FROM closes GROUP BY id)""",
    ]


def public_ctes(where: str = "TRUE") -> list[str]:
    days = R.CLOSED_RETENTION_DAYS
    return sight_ctes(where) + [
        f"""dropped AS (
  SELECT c.*,
    (SELECT min(n.run_ts) FROM nights n WHERE n.run_ts > c.closed_on + INTERVAL {days} DAY) AS drop_on
  FROM closes c)""",
        """dropped2 AS (
  SELECT *, (drop_on IS NOT NULL AND (ns IS NULL OR drop_on < ns)) AS gone FROM dropped)""",
        """cuts AS (
  SELECT id, coalesce(max(run_ts) FILTER (WHERE gone AND ns IS NOT NULL), TIMESTAMP '1900-01-01') AS cut
  FROM dropped2 GROUP BY id)""",
        """public_end AS (
  SELECT id, vendor, org_key, company_name, title, url, first_seen, last_seen, closed_at FROM (
    SELECT d.id,
      arg_max(d.vendor, d.run_ts) AS vendor, arg_max(d.org_key, d.run_ts) AS org_key,
      arg_max(d.company_name, d.run_ts) AS company_name, arg_max(d.title, d.run_ts) AS title,
      arg_max(d.url, d.run_ts) AS url,
      min(d.run_ts) FILTER (WHERE d.run_ts > c.cut) AS first_seen,
      max(d.run_ts) AS last_seen,
      max(d.closed_on) FILTER (WHERE d.ns IS NULL) AS closed_at,
      bool_or(d.gone AND d.ns IS NULL) AS gone_now
    FROM dropped2 d JOIN cuts c ON c.id = d.id GROUP BY d.id) WHERE NOT gone_now)""",
    ]


def sighting_history() -> str:
    return with_(sight_ctes()) + f"""SELECT id, org_key, company_name, title, url,
  {ts('first_seen')} AS first_seen, {ts('last_seen')} AS last_seen, {ts('closed_at')} AS closed_at,
  n_closures, n_reopened FROM seen_end"""


def closure_events() -> str:
    return with_(sight_ctes()) + f"""
SELECT id, {ts('closed_on')} AS night, 'closed' AS event FROM closes WHERE closed_on IS NOT NULL
UNION ALL
SELECT id, {ts('ns')} AS night, 'reopened' AS event FROM closes WHERE closed_on IS NOT NULL AND ns IS NOT NULL"""


def public_history() -> str:
    return with_(public_ctes()) + f"""SELECT id, {ts('first_seen')} AS first_seen,
  {ts('last_seen')} AS last_seen, {ts('closed_at')} AS closed_at FROM public_end"""


def _norm_company(expr: str) -> str:
    suf = "|".join(R.COMPANY_SUFFIX_TOKENS)
    pre = "|".join(R.COMPANY_PREFIX_TOKENS)
    s0 = f"trim(regexp_replace(lower(coalesce({expr}, '')), '[^a-z0-9]+', ' ', 'g'))"
    s1 = f"regexp_replace({s0}, '^(.+?)((?: (?:{suf}))+)$', '\\1')"
    s2 = f"regexp_replace({s1}, '^((?:(?:{pre}) )+)(.+)$', '\\2')"
    m = R.MIN_STEM
    p1 = f"regexp_extract({s2}, '^({pre})', 1)"
    g1 = f"(CASE WHEN {p1} <> '' AND length({s2}) - length({p1}) >= {m} THEN substr({s2}, length({p1}) + 1) ELSE {s2} END)"
    x1 = f"regexp_extract({g1}, '({suf})$', 1)"
    g2 = f"(CASE WHEN {x1} <> '' AND length({g1}) - length({x1}) >= {m} THEN left({g1}, length({g1}) - length({x1})) ELSE {g1} END)"
    return f"(CASE WHEN {s2} <> '' AND NOT contains({s2}, ' ') THEN {g2} ELSE {s2} END)"


def norm_title(expr: str) -> str:
    s = f"trim(regexp_replace(lower(coalesce({expr}, '')), '[^a-z0-9]+', ' ', 'g'))"
    return f"trim(regexp_replace({s}, '\\bgo to market\\b', 'gtm', 'g'))"


def mirror_collapse() -> str:
    ck, tk = _norm_company("company_name"), norm_title("title")
    return with_(public_ctes()) + f"""
, keyed AS (SELECT *, {ck} AS ck, {tk} AS tk, coalesce(NULL, first_seen) AS posted FROM public_end),
grp AS (
  SELECT ck, tk, count(DISTINCT vendor) AS nv, arg_min(id, (posted, id)) AS keeper_id,
         arg_min(vendor, (posted, id)) AS keeper_vendor
  FROM keyed WHERE closed_at IS NULL GROUP BY ck, tk)
SELECT k.id, CASE WHEN k.closed_at IS NULL AND g.nv >= 2 AND k.vendor <> g.keeper_vendor
                  THEN g.keeper_id END AS collapsed_into
FROM keyed k LEFT JOIN grp g ON k.ck = g.ck AND k.tk = g.tk"""


def normalize_company() -> str:
    from oracle.base import postings_ctes
    return with_(postings_ctes()) + f"""SELECT DISTINCT company_name, {_norm_company('company_name')} AS company_key
FROM postings"""


def _prev_where() -> str:
    return "run_ts < (SELECT now FROM last_night)"


def seen_reconcile() -> str:
    return with_(sight_ctes(_prev_where())) + f"""
, tonight AS (SELECT * FROM sight_all WHERE run_ts = (SELECT now FROM last_night)),
scanned AS (SELECT DISTINCT org_key FROM tonight),
folded AS (
  SELECT coalesce(s.id, t.id) AS id,
    CASE WHEN s.id IS NULL THEN (SELECT now FROM last_night) ELSE s.first_seen END AS first_seen,
    CASE WHEN t.id IS NOT NULL THEN (SELECT now FROM last_night) ELSE s.last_seen END AS last_seen,
    CASE WHEN t.id IS NOT NULL THEN NULL
         WHEN s.closed_at IS NULL AND s.org_key IN (SELECT org_key FROM scanned) THEN (SELECT now FROM last_night)
         ELSE s.closed_at END AS closed_at,
    s.id IS NULL AS is_new,
    (t.id IS NULL AND s.closed_at IS NULL AND s.org_key IN (SELECT org_key FROM scanned)) AS closed_now
  FROM seen_end s FULL OUTER JOIN tonight t ON s.id = t.id)
SELECT id, {ts('first_seen')} AS first_seen, {ts('last_seen')} AS last_seen, {ts('closed_at')} AS closed_at,
  is_new, coalesce(closed_now, FALSE) AS closed_now FROM folded"""


def public_reconcile() -> str:
    days = R.CLOSED_RETENTION_DAYS
    ck, tk = _norm_company("company_name"), norm_title("title")
    return with_(public_ctes(_prev_where())) + f"""
, tonight AS (SELECT * FROM sight_all WHERE run_ts = (SELECT now FROM last_night)),
scanned AS (SELECT DISTINCT org_key FROM tonight),
folded AS (
  SELECT coalesce(s.id, t.id) AS id,
    CASE WHEN t.id IS NOT NULL THEN t.vendor ELSE s.vendor END AS vendor,
    CASE WHEN t.id IS NOT NULL THEN t.company_name ELSE s.company_name END AS company_name,
    CASE WHEN t.id IS NOT NULL THEN t.title ELSE s.title END AS title,
    CASE WHEN s.id IS NULL THEN (SELECT now FROM last_night) ELSE s.first_seen END AS first_seen,
    CASE WHEN t.id IS NOT NULL THEN (SELECT now FROM last_night) ELSE s.last_seen END AS last_seen,
    CASE WHEN t.id IS NOT NULL THEN NULL
         WHEN s.closed_at IS NULL AND s.org_key IN (SELECT org_key FROM scanned) THEN (SELECT now FROM last_night)
         ELSE s.closed_at END AS closed_at,
    (t.id IS NULL AND s.closed_at IS NOT NULL
       AND (SELECT now FROM last_night) > s.closed_at + INTERVAL {days} DAY) AS expired
  FROM public_end s FULL OUTER JOIN tonight t ON s.id = t.id),
kept AS (SELECT *, {ck} AS ck, {tk} AS tk FROM folded WHERE NOT expired),
grp AS (
  SELECT ck, tk, count(DISTINCT vendor) AS nv, arg_min(id, (first_seen, id)) AS keeper_id,
         arg_min(vendor, (first_seen, id)) AS keeper_vendor
  FROM kept WHERE closed_at IS NULL GROUP BY ck, tk)
SELECT k.id, {ts('k.first_seen')} AS first_seen, {ts('k.last_seen')} AS last_seen,
  {ts('k.closed_at')} AS closed_at,
  CASE WHEN k.closed_at IS NULL AND g.nv >= 2 AND k.vendor <> g.keeper_vendor THEN g.keeper_id END AS collapsed_into
FROM kept k LEFT JOIN grp g ON k.ck = g.ck AND k.tk = g.tk"""


def new_postings() -> str:
    from oracle.base import postings_ctes
    return with_(postings_ctes()) + """
, earlier AS (SELECT id FROM postings WHERE published_at < TIMESTAMP '1997-01-01')
SELECT p.id, p.id NOT IN (SELECT id FROM earlier) AS is_new FROM postings p"""


def closed_lines() -> str:
    return with_(sight_ctes(_prev_where())) + """
, tonight AS (SELECT * FROM sight_all WHERE run_ts = (SELECT now FROM last_night))
SELECT s.id, s.company_name || ': ' || s.title || ' (' || s.url || ')' AS line
FROM seen_end s
WHERE s.closed_at IS NULL AND s.id NOT IN (SELECT id FROM tonight)
  AND s.org_key IN (SELECT org_key FROM tonight)"""

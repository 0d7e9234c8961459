"""DuckDB oracles for tolerant reads, the run record, the org list and the
streamed fold."""

from __future__ import annotations

from hirefold import rules as R
from hirefold.sources import fixtures as FX
from oracle.base import lst, q, with_
from oracle.history import _routes_ctes
from oracle.registry import reg_out, registry_ctes
from oracle.state import sight_ctes, ts
from oracle.vendors import ro_ctes


def tolerant_jsonl() -> str:
    return with_(registry_ctes() + ["""good AS (
  SELECT * REPLACE (
      CASE WHEN line_no % 23 = 0 THEN '' ELSE notes END AS notes,
      CASE WHEN line_no % 23 = 0 THEN '' ELSE domain END AS domain)
  FROM reg_log
  WHERE line_no % 17 <> 0 AND line_no % 7 <> 0 AND line_no % 13 <> 0 AND line_no % 19 <> 0
  QUALIFY row_number() OVER (PARTITION BY vendor, slug ORDER BY line_no DESC) = 1)"""]) + reg_out("good")


def log_reader() -> str:
    """The place of a line is its number in the log, which starts at 1."""
    return tolerant_jsonl().replace("SELECT vendor, slug, company_name", "SELECT line_no - 1 AS at, vendor, slug, company_name")


def history_load() -> str:
    n = FX.HISTORY_DOC_CUSTOMERS
    legacy = " ".join(f"WHEN {i} THEN {q(status)}" for i, (_, status) in enumerate(R.LEGACY_HISTORY_KEYS, 2))
    return f"""WITH item AS (
  SELECT c_custkey AS k, c_custkey // {n} AS doc, c_name AS company, c_custkey % 6 < 2 AS structured,
    CASE WHEN c_custkey % 6 < 2 THEN 0 ELSE c_custkey % 6 END AS section FROM customer)
SELECT (row_number() OVER (ORDER BY doc, section, k) - 1)::INTEGER AS ordinal, company,
  CASE WHEN structured THEN {lst(R.HISTORY_STATUSES)}[k % 5 + 1] ELSE CASE section {legacy} END END AS status,
  CASE WHEN structured AND k % 3 = 0 THEN {lst(FX.TITLES)}[k % 10 + 1] END AS role,
  CASE WHEN structured AND k % 7 = 0 THEN strftime(DATE '2024-01-01' + (k % 90)::INTEGER, '%Y-%m-%d') END AS date,
  CASE WHEN structured AND k % 11 = 0 THEN 'no fit' END AS reason
FROM item WHERE NOT (structured AND doc % 3 = 2) AND NOT (section = 5 AND doc % 4 = 1)"""


def run_record() -> str:
    ctes = _routes_ctes() + [c for c in ro_ctes() if c not in _routes_ctes()] + \
        [c for c in registry_ctes()] + ["last_day AS (SELECT max(ts)::DATE AS d FROM events)"]
    return with_(ctes) + """SELECT strftime((SELECT d FROM last_day), '%Y-%m-%d') AS date,
  (SELECT count(*) FROM reg WHERE status = 'live' AND vendor <> 'unknown') AS orgs_live,
  (SELECT count(DISTINCT vendor || ' ' || slug) FROM ro WHERE outcome = 'answered') AS orgs_scanned,
  count(*) AS postings_read,
  count(*) FILTER (WHERE route = 'title') AS eliminated_title,
  count(*) FILTER (WHERE route = 'location') AS eliminated_location,
  count(*) FILTER (WHERE route = 'comp') AS eliminated_comp,
  count(*) FILTER (WHERE route = 'zombie') AS eliminated_liveness,
  count(*) FILTER (WHERE route IN ('kept', 'flagged', 'still_open')) AS survivors,
  count(*) FILTER (WHERE route = 'flagged') AS flagged,
  count(*) FILTER (WHERE route = 'suppressed') AS suppressed,
  count(*) FILTER (WHERE route = 'zombie') AS zombies,
  (SELECT count(DISTINCT vendor || ' ' || slug) FROM ro WHERE outcome <> 'answered') AS dead_orgs,
  round_even(61.25, 1)::VARCHAR AS duration_seconds
FROM routes"""


def org_scan_list() -> str:
    return with_(registry_ctes() + [f"""pin AS (
  SELECT n_nationkey AS ordinal, {lst(('ashby', 'greenhouse'))}[n_nationkey % 2 + 1] AS vendor,
    'org' || ((n_nationkey * 3) % 50)::VARCHAR AS slug,
    CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE upper(n_name[1]) || lower(n_name[2:]) END AS company
  FROM nation WHERE n_regionkey <> 4)"""]) + """
SELECT 0 AS "group", ordinal::BIGINT AS ordinal, vendor, slug,
  CASE WHEN company <> '' THEN company ELSE slug END AS company, 'pin' AS source, TRUE AS reader FROM pin
UNION ALL
SELECT 1, NULL, r.vendor, r.slug, CASE WHEN coalesce(r.company_name, '') <> '' THEN r.company_name ELSE r.slug END,
  'registry', TRUE
FROM reg r WHERE r.status = 'live' AND r.vendor <> 'unknown'
  AND NOT EXISTS (SELECT 1 FROM pin p WHERE p.vendor = r.vendor AND p.slug = r.slug)"""


def stream_reconcile() -> str:
    return with_(sight_ctes()) + f"""SELECT id, org_key, company_name, title, url,
  {ts('first_seen')} AS first_seen, {ts('last_seen')} AS last_seen, {ts('closed_at')} AS closed_at FROM seen_end"""


def stream_public_reconcile() -> str:
    from oracle.state import public_history
    return public_history()

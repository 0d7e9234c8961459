"""DuckDB oracles for history suppression, liveness, routing and counts."""

from __future__ import annotations

from hirefold import rules as R
from hirefold.sources import fixtures as FX
from oracle.base import lst, postings_ctes, q, with_
from oracle.funnel import verdict_ctes
from oracle.state import _norm_company, norm_title, sight_ctes


def _hist_values() -> str:
    rows = []
    for o, company, status, role, date, reason in FX.HISTORY_ROWS:
        vals = [str(o)] + ["NULL" if v is None else q(v) for v in (company, status, role, date, reason)]
        rows.append("(" + ", ".join(vals) + ")")
    return ", ".join(rows)


def history_ctes(src: str = "postings") -> list[str]:
    wide = ", ".join(q(s) for s in R.COMPANY_WIDE_STATUSES)
    return [
        f"""hist AS (SELECT * FROM (VALUES {_hist_values()}) t(ordinal, company, status, role, date, reason))""",
        f"""hk AS (SELECT *, {_norm_company('company')} AS ck, status IN ({wide}) AS wide FROM hist)""",
        f"""cand AS (SELECT id, title, {_norm_company('company_name')} AS ck FROM {src})""",
        f"""hm AS (
  SELECT c.id, h.ordinal, h.status, h.wide, h.date
  FROM cand c JOIN hk h ON c.ck = h.ck AND h.ck <> ''
  WHERE h.wide OR h.role IS NULL
     OR ({norm_title('h.role')} <> '' AND {norm_title('c.title')} <> ''
         AND (contains({norm_title('c.title')}, {norm_title('h.role')})
              OR contains({norm_title('h.role')}, {norm_title('c.title')}))))""",
        """hwin AS (
  SELECT id, arg_min(status, (NOT wide, ordinal)) AS sup_status, arg_min(ordinal, (NOT wide, ordinal)) AS sup_ordinal
  FROM hm GROUP BY id)""",
        """hfirst AS (
  SELECT c.id, arg_min(h.status, h.ordinal) AS first_status, arg_min_null(h.date, h.ordinal) AS first_date
  FROM cand c JOIN hk h ON c.ck = h.ck AND h.ck <> '' GROUP BY c.id)""",
    ]


def history_suppress() -> str:
    return with_(postings_ctes() + history_ctes()) + """SELECT p.id, w.sup_status AS suppressed_status,
  w.sup_ordinal AS suppressed_ordinal FROM postings p LEFT JOIN hwin w USING (id)"""


def _noted_ctes() -> list[str]:
    return verdict_ctes() + history_ctes() + [
        """noted AS (
  SELECT v.id, v.drop_stage, v.flags,
    CASE WHEN v.drop_stage IS NULL THEN w.sup_status END AS sup_status,
    (v.drop_stage IS NULL AND w.sup_status IS NULL AND f.first_status IS NOT NULL) AS noted,
    CASE WHEN v.drop_stage IS NULL AND w.sup_status IS NULL AND f.first_status IS NOT NULL
         THEN 'history at this company: ' || f.first_status ||
              CASE WHEN coalesce(f.first_date, '') <> '' THEN ' ' || f.first_date ELSE '' END END AS note
  FROM fv v LEFT JOIN hwin w USING (id) LEFT JOIN hfirst f USING (id))""",
    ]


def history_note() -> str:
    return with_(_noted_ctes()) + "SELECT id, noted, note FROM noted"


def probes_cte() -> str:
    return f"""probes AS (
  SELECT {lst(R.VENDORS)}[o_custkey % 6 + 1] || ':org' || (o_custkey % 50)::VARCHAR || ':' || o_orderkey::VARCHAR AS id,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 405
         WHEN o_orderkey % 23 = 0 THEN 404 ELSE 200 END AS head,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL
         WHEN o_orderkey % 17 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 200 ELSE 410 END
         WHEN o_orderkey % 23 = 0 THEN 404 END AS get,
    CASE WHEN o_orderkey % 29 = 0 THEN 'timeout' END AS error
  FROM orders)"""


def _live_expr(url: str = "p.url") -> tuple[str, str]:
    live = (f"CASE WHEN coalesce({url}, '') = '' THEN TRUE "
            "WHEN r.error IS NOT NULL THEN TRUE WHEN r.head < 400 THEN TRUE "
            "WHEN r.get IS NULL THEN TRUE ELSE r.get < 400 END")
    method = (f"CASE WHEN coalesce({url}, '') = '' THEN 'board-presence' "
              "WHEN r.error IS NOT NULL OR (r.head IS NULL OR r.head >= 400) AND r.get IS NULL "
              "THEN 'url-probe-inconclusive' ELSE 'url-probe' END")
    return live, method


def liveness() -> str:
    live, method = _live_expr()
    return with_(postings_ctes() + [probes_cte()]) + f"""SELECT p.id, {live} AS live, {method} AS live_method
FROM postings p LEFT JOIN probes r USING (id)"""


def board_presence() -> str:
    return with_(sight_ctes()) + """SELECT s.id, s.id IN (SELECT id FROM sight_all WHERE run_ts = (SELECT now FROM last_night)) AS on_board
FROM seen_end s"""


def _routes_ctes() -> list[str]:
    live, _ = _live_expr("pp.url")
    return _noted_ctes() + [probes_cte(), f"""routes AS (
  SELECT n.id,
    CASE WHEN n.drop_stage IS NOT NULL THEN n.drop_stage
         WHEN n.sup_status IS NOT NULL THEN 'suppressed'
         WHEN NOT ({live}) THEN 'zombie'
         WHEN pp.published_at < TIMESTAMP '1997-01-01' THEN 'still_open'
         WHEN n.flags <> '' OR n.noted THEN 'flagged' ELSE 'kept' END AS route,
    concat_ws(',', nullif(n.flags, ''), CASE WHEN n.noted THEN {q(R.FLAG_HISTORY)} END) AS flags
  FROM noted n JOIN postings pp USING (id) LEFT JOIN probes r USING (id))"""]


def route_postings() -> str:
    return with_(_routes_ctes()) + "SELECT id, route, flags FROM routes"


def funnel_counts() -> str:
    return with_(_routes_ctes()) + """SELECT stage, count(*)::BIGINT AS n FROM (
  SELECT CASE WHEN route = 'zombie' THEN 'liveness'
              WHEN route IN ('kept', 'flagged', 'still_open') THEN 'survivors' ELSE route END AS stage
  FROM routes) GROUP BY stage"""

"""DuckDB oracles for vendor normalisation: the expected postings computed
straight from ``orders`` (the Spark side parses generated JSON payloads)."""

from __future__ import annotations

from hirefold import rules as R
from hirefold.sources import fixtures as FX
from oracle.base import lst, postings_ctes, q, salary_ctes, with_
from oracle.funnel import family_sql, location_ctes

OUT = """SELECT id, company_name, title, location_raw, is_remote, comp_min, comp_max, comp_currency,
  comp_source, url, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, description_text, flags"""


def _company(expr: str) -> str:
    b = f"{lst(FX.COMPANY_BASES)}[{expr} % 10 + 1]"
    return (f"CASE {expr} % 7 WHEN 0 THEN {b} WHEN 1 THEN 'Try' || lower({b}) WHEN 2 THEN {b} || ' Labs' "
            f"WHEN 3 THEN {b} || '.com' WHEN 4 THEN 'The ' || {b} WHEN 5 THEN {b} || 'HQ' ELSE {b} || ', Inc.' END")


def _annual(v: str, interval: str) -> tuple[str, str]:
    key = f"upper(trim(coalesce({interval}, '')))"
    mult = "CASE " + key + " " + " ".join(f"WHEN {q(k)} THEN {m}" for k, m in R.INTERVAL_MULTIPLIER.items()) + " END"
    value = f"round_even({v} * coalesce({mult}, 1), 0)::BIGINT"
    scaled = f"coalesce({mult} IS NOT NULL AND {mult} <> 1, FALSE)"
    return value, scaled


def ro_ctes() -> list[str]:
    div = "[" + ", ".join(str(d) for d in FX.INTERVAL_DIVISOR) + "]"
    return postings_ctes() + [
        f"""ro_o AS (
  SELECT o_orderkey AS k, o_custkey % 150 AS board, source AS vendor,
    org_slug || CASE WHEN o_orderkey // {FX.BOARD_ORDERS} > 0 THEN '-' || (o_orderkey // {FX.BOARD_ORDERS})::VARCHAR ELSE '' END AS org,
    org || CASE WHEN source = 'workday' THEN '.wd5/External' ELSE '' END AS slug,
    CASE WHEN (o_custkey % 150) % 8 = 0 THEN '' ELSE {_company('(o_custkey % 150)')} END AS company,
    {_company('(o_custkey % 150)')} AS real_company,
    title, location_raw AS loc, is_remote AS remote, description_text AS descr, status, top,
    {lst(FX.PAYLOAD_INTERVALS)}[o_orderpriority[1]::INTEGER] AS ival,
    {lst(FX.LEVER_INTERVALS)}[o_orderpriority[1]::INTEGER] AS lival,
    {div}[o_orderpriority[1]::INTEGER] AS div,
    'https://jobs.example.com/' || source || '/' || o_orderkey::VARCHAR AS url,
    published_at::DATE::TIMESTAMP AS day_ts,
    {family_sql('title')} IS NOT NULL AS gated
  FROM p_keyed)""",
        f"""ro_p AS (
  SELECT *, count(*) OVER b AS n, (row_number() OVER (b ORDER BY k) - 1) // {FX.PAGE_STEP} AS page
  FROM ro_o WINDOW b AS (PARTITION BY vendor, slug))""",
        f"""ro_t AS (
  SELECT *, CASE WHEN board % 30 IN {FX.STALE_BOARDS} THEN greatest(n - {FX.PAGE_STEP}, 1)
                 WHEN board % 30 IN {FX.GROWN_BOARDS} THEN least(n, (page + 1) * {FX.PAGE_STEP} + 1)
                 WHEN board % 30 IN {FX.SHRUNK_BOARDS} AND page > 0 THEN {FX.PAGE_STEP} ELSE n END AS said,
    board % 30 IN {FX.EMPTY_BOARDS} AND page = 1 AND vendor IN ('smartrecruiters', 'workday') AS vanished,
    vendor IN ('smartrecruiters', 'workday') AS paged
  FROM ro_p)""",
        "ro_d AS (SELECT *, CASE WHEN paged THEN page ELSE 0 END AS doc FROM ro_t)",
        f"""ro_pages AS (
  SELECT *, CASE WHEN board = 7 OR (board = 40 AND page > 0) THEN '404'
                 WHEN board IN (6, 11) OR (board = 10 AND page > 0)
                   OR (board = 34 AND page > 0 AND page * {FX.PAGE_STEP} >= said) THEN 'unavailable' END AS failure
  FROM (SELECT vendor, slug, doc AS page, any_value(board) AS board, any_value(said) AS said, count(*) FILTER (WHERE NOT vanished) AS held
        FROM ro_d GROUP BY vendor, slug, doc))""",
        # The rule, as a walk: ask for the next page until the rows received
        # reach the total that the last page reported, or a page is empty or fails.
        """ro_walk AS (
  SELECT vendor, slug, page, held AS received, said, held, failure FROM ro_pages WHERE page = 0
  UNION ALL
  SELECT p.vendor, p.slug, p.page, w.received + p.held, p.said, p.held, p.failure
  FROM ro_walk w JOIN ro_pages p ON p.vendor = w.vendor AND p.slug = w.slug AND p.page = w.page + 1
  WHERE w.failure IS NULL AND w.held > 0 AND w.received < w.said)""",
        """ro_boards AS (
  SELECT vendor AS bv, slug AS bs, coalesce(arg_min(failure, page) FILTER (WHERE failure IS NOT NULL), 'answered') AS outcome,
    max(page) AS last_page FROM ro_walk GROUP BY vendor, slug)""",
        """ro AS (
  SELECT t.*, outcome, first_value(said) OVER (PARTITION BY vendor, slug ORDER BY k) AS total,
    NOT vanished AND (NOT paged OR page <= last_page) AS on_read_page, outcome = 'answered' AND on_read_page AS answered
  FROM ro_t t JOIN ro_boards b ON b.bv = t.vendor AND b.bs = t.slug)""",
        "ro_f AS (SELECT k, descr FROM ro)",
    ] + salary_ctes("ro_f", "k", "descr", "vs")


def _parsed(alias: str, prefix: str = "s") -> dict:
    return {
        "min": f"{prefix}.vmin", "max": f"{prefix}.vmax", "cur": f"{prefix}.cur",
        "src": f"CASE WHEN {prefix}.sk IS NOT NULL THEN 'parsed' ELSE 'none' END",
        "flags": f"coalesce({prefix}.flags, '')",
    }


def _display(expr_company: str = "company", slug: str = "slug") -> str:
    return f"CASE WHEN {expr_company} <> '' THEN {expr_company} ELSE {slug} END"


def norm_ashby() -> str:
    lo, lo_s = _annual("((top // 2)::DOUBLE / div)", "ival")
    hi, hi_s = _annual("(top::DOUBLE / div)", "ival")
    p = _parsed("s")
    return with_(ro_ctes()) + OUT + f""" FROM (
  SELECT 'ashby:' || slug || ':' || k::VARCHAR AS id, {_display()} AS company_name, title,
    CASE WHEN k % 5 = 0 THEN CASE WHEN loc = '' THEN 'NYC' ELSE loc || ' | NYC' END ELSE loc END AS location_raw,
    CASE WHEN remote IS NULL AND k % 3 = 0 THEN TRUE ELSE remote END AS is_remote,
    CASE WHEN status = 'O' THEN {lo} ELSE {p['min']} END AS comp_min,
    CASE WHEN status = 'O' THEN {hi} ELSE {p['max']} END AS comp_max,
    CASE WHEN status = 'O' THEN 'USD' ELSE {p['cur']} END AS comp_currency,
    CASE WHEN status = 'O' THEN 'structured' ELSE {p['src']} END AS comp_source,
    CASE WHEN k % 7 = 0 THEN url || '/apply' ELSE url END AS url, day_ts AS published_at,
    descr AS description_text,
    CASE WHEN status = 'O' THEN CASE WHEN {lo_s} OR {hi_s} THEN {q(R.FLAG_HOURLY)} ELSE '' END ELSE {p['flags']} END AS flags
  FROM ro LEFT JOIN (SELECT k AS sk, vmin, vmax, cur, flags FROM vs_pick) s ON s.sk = ro.k AND ro.status = 'F'
  WHERE vendor = 'ashby' AND answered AND k % 23 <> 0 AND k % 29 <> 0)"""


def _lever_interval() -> str:
    low = "lower(coalesce(lival, ''))"
    return "CASE " + " ".join(f"WHEN contains({low}, {q(t)}) THEN {q(c)}" for t, c in R.LEVER_INTERVAL_WORDS) + " END"


def norm_lever() -> str:
    iv = _lever_interval()
    lo, lo_s = _annual("((top // 2)::DOUBLE / div)", iv)
    hi, hi_s = _annual("(top::DOUBLE / div)", iv)
    p = _parsed("s")
    return with_(ro_ctes()) + OUT + f""" FROM (
  SELECT 'lever:' || slug || ':' || k::VARCHAR AS id, {_display()} AS company_name, title,
    CASE WHEN k % 5 = 0 THEN CASE WHEN loc = '' THEN 'NYC' ELSE loc || ' | NYC' END ELSE loc END AS location_raw,
    CASE WHEN k % 3 = 0 THEN TRUE END AS is_remote,
    CASE WHEN status = 'O' THEN {lo} ELSE {p['min']} END AS comp_min,
    CASE WHEN status = 'O' THEN {hi} ELSE {p['max']} END AS comp_max,
    CASE WHEN status = 'O' THEN 'USD' ELSE {p['cur']} END AS comp_currency,
    CASE WHEN status = 'O' THEN 'structured' ELSE {p['src']} END AS comp_source,
    url, CASE WHEN k % 19 = 0 THEN NULL ELSE day_ts END AS published_at, descr AS description_text,
    CASE WHEN status = 'O' THEN CASE WHEN {lo_s} OR {hi_s} THEN {q(R.FLAG_HOURLY)} ELSE '' END ELSE {p['flags']} END AS flags
  FROM ro LEFT JOIN (SELECT k AS sk, vmin, vmax, cur, flags FROM vs_pick) s ON s.sk = ro.k AND ro.status <> 'O'
  WHERE vendor = 'lever' AND answered)"""


def norm_workable() -> str:
    p = _parsed("s")
    return with_(ro_ctes()) + OUT + f""" FROM (
  SELECT 'workable:' || slug || ':W' || k::VARCHAR AS id,
    CASE WHEN company <> '' THEN real_company ELSE slug END AS company_name, title,
    CASE WHEN k % 5 = 0 THEN 'New York, NY, US | Austin, TX, US' ELSE loc END AS location_raw,
    remote AS is_remote, {p['min']} AS comp_min, {p['max']} AS comp_max, {p['cur']} AS comp_currency,
    {p['src']} AS comp_source, url, day_ts AS published_at, descr AS description_text, {p['flags']} AS flags
  FROM ro LEFT JOIN (SELECT k AS sk, vmin, vmax, cur, flags FROM vs_pick) s ON s.sk = ro.k
  WHERE vendor = 'workable' AND answered)"""


def _enriched(vendor: str, id_expr: str, company: str, location: str, remote: str, url_list: str,
              url_detail: str, pub_list: str, pub_detail: str, desc_detail: str, gate: str,
              extra_where: str = "TRUE") -> str:
    got = f"({gate} AND k % 13 <> 0)"
    failed = f"({gate} AND k % 13 = 0)"
    return with_(ro_ctes() + [
        f"""enr AS (SELECT *, {desc_detail} AS ddesc FROM ro WHERE vendor = {q(vendor)} AND answered AND {extra_where})""",
        "enr_f AS (SELECT k, ddesc FROM enr)"] + salary_ctes("enr_f", "k", "ddesc", "es")) + OUT + f""" FROM (
  SELECT {id_expr} AS id, {company} AS company_name, title, {location} AS location_raw, {remote} AS is_remote,
    CASE WHEN {got} THEN s.vmin END AS comp_min, CASE WHEN {got} THEN s.vmax END AS comp_max,
    CASE WHEN {got} THEN s.cur END AS comp_currency,
    CASE WHEN {got} AND s.sk IS NOT NULL THEN 'parsed' ELSE 'none' END AS comp_source,
    CASE WHEN {got} AND coalesce({url_detail}, '') <> '' THEN {url_detail} ELSE {url_list} END AS url,
    CASE WHEN {got} THEN {pub_detail} ELSE {pub_list} END AS published_at,
    CASE WHEN {got} THEN ddesc END AS description_text,
    CASE WHEN {got} THEN coalesce(s.flags, '') WHEN {failed} THEN {q(R.FLAG_DETAIL_FAILED)} ELSE '' END AS flags
  FROM enr LEFT JOIN (SELECT k AS sk, vmin, vmax, cur, flags FROM es_pick) s ON s.sk = enr.k)"""


def norm_greenhouse() -> str:
    return _enriched(
        "greenhouse", "'greenhouse:' || slug || ':' || k::VARCHAR",
        f"CASE WHEN k % 4 <> 0 THEN real_company ELSE {_display()} END", "loc", "NULL::BOOLEAN",
        "url", "NULL", "day_ts", "day_ts", "descr", "gated")


def norm_smartrecruiters() -> str:
    ident = "CASE WHEN k % 6 = 0 THEN slug ELSE 'Org' || (board % 50)::VARCHAR END"
    return _enriched(
        "smartrecruiters", "'smartrecruiters:' || slug || ':' || k::VARCHAR", _display(), "loc",
        "CASE WHEN coalesce(remote, FALSE) THEN TRUE END",
        f"'https://jobs.smartrecruiters.com/' || {ident} || '/' || k::VARCHAR",
        "CASE WHEN k % 3 = 0 THEN NULL ELSE url || '?sr=1' END", "day_ts", "day_ts",
        "'We hire for GTM.' || chr(10) || descr", "gated")


def norm_workday() -> str:
    path = "CASE WHEN k % 31 = 0 THEN '' ELSE '/job/R' || k::VARCHAR END"
    return _enriched(
        "workday", f"'workday:' || slug || ':' || {path}", _display(), "loc", "remote",
        f"'https://' || org || '.wd5.myworkdayjobs.com/External' || {path}",
        "url || '?wd=1'", "NULL::TIMESTAMP", "CASE WHEN k % 7 = 0 THEN NULL ELSE day_ts END", "descr",
        f"(gated AND {path} <> '')")


def all_postings() -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({sql()})" for sql in (
        norm_ashby, norm_greenhouse, norm_lever, norm_workable, norm_smartrecruiters, norm_workday))


def scan_accounting() -> str:
    return with_(ro_ctes()) + f"""SELECT DISTINCT vendor, slug, outcome,
  CASE outcome WHEN '404' THEN {q(R.WARNING_404)}
    WHEN 'unavailable' THEN 'unavailable: ' || CASE WHEN board = 6 THEN {q(R.BAD_JSON)} ELSE 'timeout' END END AS reason
FROM ro"""


def probe_from_board() -> str:
    return with_(ro_ctes()) + """SELECT vendor, slug, CASE WHEN failed THEN st ELSE 'ok' END AS status,
  CASE WHEN failed THEN 0 WHEN vendor IN ('smartrecruiters', 'workday') THEN max(total) ELSE count(*) FILTER (WHERE shown) END::BIGINT AS count,
  CASE WHEN failed THEN '' WHEN vendor = 'greenhouse' THEN coalesce(arg_min(real_company, k) FILTER (WHERE k % 4 <> 0), '')
       WHEN vendor = 'workable' THEN CASE WHEN any_value(company) <> '' THEN any_value(real_company) ELSE '' END
       ELSE '' END AS company_name,
  CASE WHEN failed THEN '' ELSE coalesce(array_to_string((list(title ORDER BY k) FILTER (WHERE shown))[1:3], ' | '), '') END AS sample
FROM (SELECT *, board IN (6, 7, 11) AS failed, CASE WHEN board = 7 THEN '404' ELSE 'error' END AS st,
        vendor <> 'ashby' OR k % 23 <> 0 AS shown FROM ro)
GROUP BY vendor, slug, failed, st"""


def detail_gate() -> str:
    return with_(postings_ctes() + location_ctes()) + f"""SELECT id, fam AS wants_detail,
  fam AND location_status <> 'fail' AS wants_detail_strict
FROM (SELECT p.id, {family_sql('title')} IS NOT NULL AS fam, l.location_status FROM postings p JOIN loc_status l USING (id))"""


def detail_enrich() -> str:
    parts = [norm_greenhouse(), norm_smartrecruiters(), norm_workday()]
    return " UNION ALL ".join(
        f"SELECT id, url, published_at, description_text, flags FROM ({p})" for p in parts)

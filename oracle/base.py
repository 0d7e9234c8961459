"""DuckDB derivations of the operator input tables (FIXTURES.md section 3).

Each function returns a list of ``name AS (...)`` CTE clauses; queries join
them with ``with_(...)``. RE2 has no look-around, so word boundaries are
written ``(^|[^a-zA-Z0-9])x($|[^a-zA-Z0-9])``.
"""

from __future__ import annotations

import re

from hirefold import rules as R
from hirefold.sources import fixtures as FX


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join("NULL" if v is None else q(v) for v in values) + "]"


def with_(*ctes: str) -> str:
    seen, out = set(), []
    for block in ctes:
        for c in (block if isinstance(block, list) else [block]):
            if c not in seen:
                seen.add(c)
                out.append(c)
    return "WITH RECURSIVE " + ",\n".join(out) + "\n"


def fmt_thousands(expr: str) -> str:
    return f"format('{{:,}}', ({expr})::BIGINT)"


def salary_ctes(src: str, key: str, txt: str, prefix: str = "sal") -> list[str]:
    """Band from prose, relationally: one row per sentence, one per amount,
    first sentence (by position) with a pay word and a value wins.
    Output CTE ``{prefix}_pick(k, vmin, vmax, cur, flags)``."""
    kw = " OR ".join(f"contains(low, {q(k)})" for k in R.SALARY_KEYWORDS)
    hourly = " OR ".join(f"contains(low, {q(k)})" for k in R.HOURLY_KEYWORDS)
    ote = " OR ".join(f"contains(low, {q(k)})" for k in R.OTE_KEYWORDS)
    money = r"\$\s*(\d[\d,]*(?:\.\d+)?)\s*([kK])?"
    p = prefix
    return [
        f"""{p}_norm AS (
  SELECT {key} AS k, string_split_regex(regexp_replace(regexp_replace({txt},
    '[ \\t' || chr(160) || ']+', ' ', 'g'), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') AS segs
  FROM {src} WHERE {txt} IS NOT NULL AND {txt} <> '')""",
        f"""{p}_seg AS (
  SELECT k, unnest(segs) AS seg, generate_subscripts(segs, 1) AS pos FROM {p}_norm)""",
        f"""{p}_sent AS (
  SELECT k, pos, seg, low, ({kw}) AS has_kw, ({hourly}) AS hourly, ({ote}) AS ote,
         upper(regexp_extract(seg, '(?i)\\b(usd|cad|eur|gbp)\\b', 1)) AS cur
  FROM (SELECT k, pos, seg, lower(seg) AS low FROM {p}_seg))""",
        f"""{p}_amt AS (
  SELECT k, pos, hourly, m,
         CAST(replace(regexp_extract(m, '(\\d[\\d,]*(?:\\.\\d+)?)', 1), ',', '') AS DOUBLE) AS raw
  FROM (SELECT k, pos, hourly, unnest(regexp_extract_all(seg, {q(money)}, 0)) AS m FROM {p}_sent))""",
        f"""{p}_val AS (
  SELECT k, pos,
    CASE WHEN hourly THEN round_even(amt * {R.HOURS_PER_YEAR}, 0)::BIGINT
         WHEN amt >= 1000 THEN round_even(amt, 0)::BIGINT END AS v
  FROM (SELECT k, pos, hourly,
          CASE WHEN regexp_matches(m, '[kK]$') AND raw < 1000 THEN raw * 1000 ELSE raw END AS amt
        FROM {p}_amt))""",
        f"""{p}_agg AS (
  SELECT k, pos, min(v) AS vmin, max(v) AS vmax, count(v) AS nv FROM {p}_val GROUP BY k, pos)""",
        f"""{p}_pick AS (
  SELECT s.k, a.vmin, a.vmax, CASE WHEN s.cur = '' OR s.cur IS NULL THEN 'USD' ELSE s.cur END AS cur,
    concat_ws(',', CASE WHEN s.hourly THEN {q(R.FLAG_HOURLY)} END,
                   CASE WHEN s.ote THEN {q(R.FLAG_OTE)} END,
                   CASE WHEN a.nv = 1 THEN {q(R.FLAG_SINGLE_VALUE)} END) AS flags
  FROM {p}_sent s JOIN {p}_agg a ON s.k = a.k AND s.pos = a.pos
  WHERE s.has_kw AND a.nv > 0
  QUALIFY row_number() OVER (PARTITION BY s.k ORDER BY s.pos) = 1)""",
    ]


def postings_ctes() -> list[str]:
    """``postings(id, source, org_slug, company_name, title, location_raw,
    is_remote, comp_min, comp_max, comp_currency, comp_source, url,
    published_at, description_text, flags)`` with flags a ','-joined string."""
    vendors = lst(R.VENDORS)
    bases = lst(FX.COMPANY_BASES)
    titles = lst(FX.TITLES)
    locs = lst(FX.LOCATIONS)
    shapes = lst(FX.SHAPE_SENTENCES)
    top = "floor(o_totalprice)::BIGINT"
    half = f"({top} // 2)"
    salary = (f"CASE o_orderkey % 4 "
              f"WHEN 0 THEN 'The salary range is $' || {fmt_thousands(half)} || ' to $' || {fmt_thousands(top)} || '.' "
              f"WHEN 1 THEN 'Base pay is $' || ({top} // 1000)::VARCHAR || 'k per year.' "
              f"WHEN 2 THEN 'Pay is $' || ({top} // 2080)::VARCHAR || ' per hour.' "
              f"ELSE 'OTE is $' || {fmt_thousands(half)} || ' - $' || {fmt_thousands(top)} || ' USD.' END")
    base = f"""p_base AS (
  SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus AS status, {top} AS top,
    {vendors}[o_custkey % 6 + 1] AS source,
    'org' || (o_custkey % 50)::VARCHAR AS org_slug,
    CASE o_custkey % 7
      WHEN 0 THEN b WHEN 1 THEN 'Try' || lower(b) WHEN 2 THEN b || ' Labs'
      WHEN 3 THEN b || '.com' WHEN 4 THEN 'The ' || b WHEN 5 THEN b || 'HQ'
      ELSE b || ', Inc.' END AS company_name,
    {titles}[o_orderkey % 10 + 1] AS title,
    {locs}[o_orderkey % 11 + 1] AS location_raw,
    CASE o_orderkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_remote,
    o_orderdate::TIMESTAMP AS published_at,
    {q(FX.BONUS_SENTENCE)}
      || CASE WHEN o_orderstatus = 'F' THEN ' ' || {salary} ELSE '' END
      || CASE WHEN {shapes}[o_orderkey % 9 + 1] <> '' THEN ' ' || {shapes}[o_orderkey % 9 + 1] ELSE '' END
      AS description_text
  FROM (SELECT *, {bases}[o_custkey % 10 + 1] AS b FROM orders))"""
    keyed = """p_keyed AS (
  SELECT source || ':' || org_slug || ':' || o_orderkey::VARCHAR AS id, * FROM p_base)"""
    f_rows = "p_frows AS (SELECT id, description_text FROM p_keyed WHERE status = 'F')"
    final = """postings AS (
  SELECT p.id, p.source, p.org_slug, p.company_name, p.title, p.location_raw, p.is_remote,
    CASE WHEN p.status = 'O' THEN p.top // 2 WHEN s.k IS NOT NULL THEN s.vmin END AS comp_min,
    CASE WHEN p.status = 'O' THEN p.top WHEN s.k IS NOT NULL THEN s.vmax END AS comp_max,
    CASE WHEN p.status = 'O' THEN 'USD' WHEN s.k IS NOT NULL THEN s.cur END AS comp_currency,
    CASE WHEN p.status = 'O' THEN 'structured' WHEN s.k IS NOT NULL THEN 'parsed' ELSE 'none' END AS comp_source,
    'https://jobs.example.com/' || p.source || '/' || p.org_slug || '/' || p.o_orderkey::VARCHAR AS url,
    p.published_at, p.description_text,
    coalesce(s.flags, '') AS flags
  FROM p_keyed p LEFT JOIN psal_pick s ON s.k = p.id)"""
    return [base, keyed, f_rows] + salary_ctes("p_frows", "id", "description_text", "psal") + [final]


def boundary(body: str) -> str:
    return f"(^|[^a-zA-Z0-9])({body})($|[^a-zA-Z0-9])"


def phrase_body(phrase: str) -> str:
    tokens = [t for t in re.split(r"[^a-z0-9]+", phrase.lower()) if t]
    return "[^a-zA-Z0-9]+".join(re.escape(t) for t in tokens)

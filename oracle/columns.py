"""DuckDB oracles for the column-level keys."""

from __future__ import annotations

from oracle import vendors as V
from oracle.base import postings_ctes, with_
from oracle.funnel import location_ctes, norm_title_sql


def html_to_text() -> str:
    # DuckDB has no HTML entity decoder; the driver pages only carry these
    # four entities, decoded in one left-to-right pass (&amp; last).
    def unesc(x: str) -> str:
        for ent, ch in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
            x = f"replace({x}, '{ent}', '{ch}')"
        return x
    t = unesc("html")
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    t = unesc(t)
    t = f"replace({t}, chr(160), ' ')"
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
    return f"SELECT page_id, CASE WHEN coalesce(html, '') = '' THEN NULL ELSE {t} END AS text FROM pages"


def normalize_title() -> str:
    return with_(postings_ctes()) + f"SELECT DISTINCT title, {norm_title_sql('title')} AS title_key FROM postings"


def location_segments() -> str:
    return with_(postings_ctes() + location_ctes()) + """SELECT DISTINCT p.location_raw, array_to_string(s.segs, '|') AS segments
FROM postings p JOIN loc_segs s USING (id)"""


def annualize() -> str:
    lo, lo_s = V._annual("((top // 2)::DOUBLE / div)", "ival")
    hi, hi_s = V._annual("(top::DOUBLE / div)", "ival")
    return with_(V.ro_ctes()) + f"""SELECT k AS id, ival AS interval, {lo} AS min_annual, {hi} AS max_annual,
  ({lo_s} OR {hi_s}) AS scaled FROM ro"""


def workday_slug() -> str:
    return with_(V.ro_ctes()) + """SELECT slug,
  CASE WHEN contains(slug, '/') AND contains(split_part(slug, '/', 1), '.wd') THEN split_part(split_part(slug, '/', 1), '.wd', 1) END AS tenant,
  CASE WHEN contains(slug, '/') AND contains(split_part(slug, '/', 1), '.wd') THEN split_part(split_part(slug, '/', 1), '.wd', 2) END AS n,
  CASE WHEN contains(slug, '/') AND contains(split_part(slug, '/', 1), '.wd') THEN substr(slug, strpos(slug, '/') + 1) END AS site
FROM (SELECT DISTINCT slug FROM ro)"""


def _union(builders, cols: str) -> str:
    return " UNION ALL ".join(f"SELECT id, {cols} FROM ({b()})" for b in builders)


def flatten_locations() -> str:
    return _union((V.norm_ashby, V.norm_lever, V.norm_workable, V.norm_smartrecruiters), "location_raw")


def parse_timestamps() -> str:
    return _union((V.norm_ashby, V.norm_lever, V.norm_workable, V.norm_workday), "published_at")


def remote_signal() -> str:
    return _union((V.norm_ashby, V.norm_lever, V.norm_workable, V.norm_smartrecruiters, V.norm_workday), "is_remote")


def comp_ashby() -> str:
    return f"SELECT id, comp_min, comp_max, comp_currency, comp_source, flags FROM ({V.norm_ashby()})"


def comp_lever() -> str:
    return f"SELECT id, comp_min, comp_max, comp_currency, comp_source, flags FROM ({V.norm_lever()})"

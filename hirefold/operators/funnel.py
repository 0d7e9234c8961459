"""The filter funnel: title, location, comp, shape, then liveness and routing.

Every stage is a column over the postings row, so the whole verdict is one
narrow projection: no shuffle, one whole-stage-codegen span, and the cheap
title test short-circuits the costly regexes (CASE WHEN evaluates lazily).
Only liveness joins another table (URL probe outcomes, on posting id).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirefold import rules as R
from hirefold.functions.comp import comp_known, comp_top
from hirefold.functions.text import (
    any_phrase_regex, collapse_ws, let, location_segments, normalize_title,
    phrase_regex,
)
from hirefold.rules import DEFAULT_RULES, Rules


def _any_contains(s: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        if w:
            out = out | (F.instr(s, w) > 0)
    return out


def title_family(title: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """"include", "flag" or NULL; plain substring of the normalised title.

    One quoted alternation per family, so the normalised title appears
    twice in the expression rather than once per phrase: a Filter gets no
    common-subexpression elimination, and this predicate is used in filters
    (the detail gate, the public store feed)."""
    t = normalize_title(title)
    return (F.when(_names_any(t, rules.include), F.lit("include"))
            .when(_names_any(t, rules.flag), F.lit("flag")))


def _names_any(title_key: Column, phrases) -> Column:
    """The title key contains a phrase in the same normal form. The pattern
    folds to one literal: normal forms hold letters, digits and spaces only."""
    if not phrases:
        return F.lit(False)
    return F.regexp_like(title_key, F.concat_ws("|", *[normalize_title(F.lit(p)) for p in phrases]))


def _region_blocked(seg: Column, rules: Rules) -> Column:
    alt = "|".join(re.escape(r.lower()) for r in rules.exclude_regions)
    if not alt:
        return F.lit(False)
    return seg.rlike(rf"(?U)\b(?:{alt})\b")


def _us_signal(seg: Column, rules: Rules) -> Column:
    out = F.lit(False)
    if rules.us_signals:
        out = out | seg.rlike(any_phrase_regex(rules.us_signals))
    if rules.us_states:
        states = "|".join(c.lower() for c in rules.us_states)
        out = out | seg.rlike(rf"(?iU),\s*(?:{states})(?![a-zA-Z0-9])")
    return out


def location_status(location_raw: Column, is_remote: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """"ok", "remote-unverified" or "fail"."""
    nyc_tokens = [t.lower() for t in rules.nyc_tokens]

    def decide(x: Column) -> Column:
        segs = x["segs"]
        nyc = F.exists(segs, lambda s: _any_contains(s, nyc_tokens))
        remote_segs = F.filter(segs, lambda s: F.instr(s, "remote") > 0)
        us_any = F.exists(segs, lambda s: _us_signal(s, rules))
        verified = F.when(us_any, F.lit("ok")).otherwise(F.lit("remote-unverified"))
        status = F.when(nyc, F.lit("ok"))
        if not rules.allow_remote_us:
            return status.otherwise(F.lit("fail"))
        return (status
                .when(F.size(remote_segs) > 0,
                      F.when(~F.exists(remote_segs, lambda s: ~_region_blocked(s, rules)), F.lit("fail"))
                      .otherwise(verified))
                .when(F.coalesce(x["remote"], F.lit(False))
                      & ~F.exists(segs, lambda s: _region_blocked(s, rules)), verified)
                .otherwise(F.lit("fail")))

    return let(decide, segs=location_segments(location_raw), remote=is_remote)


def _tokens_present(low: Column, phrase: str) -> Column:
    """Every alphanumeric token of the phrase occurs in the lower-cased
    text: necessary for a phrase match, and far cheaper than the regex."""
    import re
    out = F.lit(True)
    for tok in sorted({t for t in re.split(r"[^a-z0-9]+", phrase.lower()) if t}, key=len, reverse=True):
        out = out & (F.instr(low, tok) > 0)
    return out


def shape_gates(hay: Column, rules: Rules = DEFAULT_RULES) -> list[Column]:
    """Per pack: does any of its phrases occur (one word-bounded alternation;
    its look-behind fails fast inside words)."""
    return [hay.rlike(any_phrase_regex(phrases)) for _, phrases in rules.shapes]


def shape_haystack(title: Column, description: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit("")))


def shape_quotes(title: Column, description: Column, rules: Rules = DEFAULT_RULES,
                 hay: Column | None = None, gates: list[Column] | None = None) -> Column:
    """struct<q0, q1, ...>: per pack (config order) the text of the first
    phrase in phrase order that occurs, whitespace collapsed; NULL if none.

    A pack's phrases are tried only when the pack's gate (``shape_gates``)
    fired, and a phrase's regex only when all its tokens occur as substrings
    of the lower-cased text (both necessary conditions, far cheaper than the
    chain). Callers that hold the haystack and gates as columns pass them
    in, so rows with no gate never enter the interpreted block. The text and
    its lower case are bound once per row (``let``).
    """
    hay = shape_haystack(title, description) if hay is None else hay
    gates = shape_gates(hay, rules) if gates is None else gates

    def per_row(x: Column) -> Column:
        h, low = x["h"], x["low"]
        quotes = []
        for i, (pack, phrases) in enumerate(rules.shapes):
            chain = None
            for p in phrases:
                rx = phrase_regex(p)
                test = _tokens_present(low, p) & h.rlike(rx)
                found = F.regexp_extract(h, rx, 0)
                chain = F.when(test, found) if chain is None else chain.when(test, found)
            quotes.append(F.when(x[f"g{i}"], collapse_ws(chain)).alias(f"q{i}"))
        return F.struct(*quotes)

    bound = {"h": hay, "low": F.lower(hay)}
    bound.update({f"g{i}": g for i, g in enumerate(gates)})
    return let(per_row, **bound)


def shape_hits(title: Column, description: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """array<struct<pack, quote>> of the packs that hit, in config order."""
    st = "struct<pack:string,quote:string>"
    if not rules.shapes:
        return F.array().cast(f"array<{st}>")
    qs = shape_quotes(title, description, rules)
    items = [F.when(qs[f"q{i}"].isNotNull(),
                    F.struct(F.lit(pack).alias("pack"), qs[f"q{i}"].alias("quote")))
             for i, (pack, _) in enumerate(rules.shapes)]
    return F.array_except(F.array(*items), F.array(F.lit(None).cast(st)))


def compact(*items: Column) -> Column:
    """array of the non-NULL string items, order kept (codegen'd)."""
    return F.array_remove(F.array(*[F.coalesce(i, F.lit("")) for i in items]), "")


def _fmt(n: int | None) -> str:
    return f"{n:,}" if n is not None else ""


def comp_outcome(comp: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """A band against the floor: ``unknown``, ``drop`` (its top, or its
    minimum where it has no top, is below), ``clears`` (its minimum too is at
    or above) or ``top-only``."""
    floor = F.lit(rules.floor_usd)
    return (F.when(~comp_known(comp), F.lit("unknown"))
            .when(comp_top(comp) < floor, F.lit("drop"))
            .when(comp["min"] >= floor, F.lit("clears")).otherwise(F.lit("top-only")))


def evaluate(postings: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Add ``family``, ``location``, ``stage`` (drop stage or NULL),
    ``decision``, ``reasons`` and the updated ordered ``flags``."""
    floor, exc = rules.floor_usd, rules.exception_usd
    df = postings.withColumn("family", title_family(F.col("title"), rules))
    df = df.withColumn("location", F.when(
        F.col("family").isNotNull(), location_status(F.col("location_raw"), F.col("is_remote"), rules)))
    top = comp_top(F.col("comp"))
    df = df.withColumn("_comp", comp_outcome(F.col("comp"), rules))
    band = F.col("_comp")
    loc_exc = ((F.col("location") == "fail") & top.isNotNull() & (top >= F.lit(exc))
               if exc is not None else F.lit(False))
    stage = (F.when(F.col("family").isNull(), F.lit("title"))
             .when((F.col("location") == "fail") & ~loc_exc, F.lit("location"))
             .when(band == "drop", F.lit("comp")))
    df = df.withColumn("_loc_exc", loc_exc).withColumn("stage", stage)
    reached_comp = F.col("family").isNotNull() & (
        (F.col("location") != "fail") | F.col("_loc_exc"))
    survived = F.col("stage").isNull()
    band_top_only = reached_comp & (band == "top-only")
    # Haystack and pack gates are plain compiled columns; only survivors
    # with a gate that fired enter the interpreted phrase chains.
    df = df.withColumn("_hay", F.when(survived, shape_haystack(F.col("title"), F.col("description_text"))))
    gate_cols = []
    for i, g in enumerate(shape_gates(F.col("_hay"), rules)):
        df = df.withColumn(f"_g{i}", F.coalesce(g, F.lit(False)))
        gate_cols.append(F.col(f"_g{i}"))
    if gate_cols:  # a configuration may have no shape packs
        any_gate = gate_cols[0]
        for g in gate_cols[1:]:
            any_gate = any_gate | g
        df = df.withColumn("_shapes", F.when(survived & any_gate, shape_quotes(
            F.col("title"), F.col("description_text"), rules, hay=F.col("_hay"), gates=gate_cols)))
    shape_cols = [(pack, F.col(f"_shapes.q{i}")) for i, (pack, _) in enumerate(rules.shapes)]
    is_flag_family = F.col("family") == "flag"
    remote_unverified = F.col("family").isNotNull() & (F.col("location") == "remote-unverified")
    new_flags = compact(
        F.when(is_flag_family, F.lit(R.FLAG_TITLE_FAMILY)),
        F.when(F.col("family").isNotNull() & F.col("_loc_exc"), F.lit(R.FLAG_LOCATION_EXCEPTION)),
        F.when(remote_unverified, F.lit(R.FLAG_REMOTE_UNVERIFIED)),
        F.when(reached_comp & (band == "unknown"), F.lit(R.FLAG_COMP_UNKNOWN)),
        F.when(band_top_only, F.lit(R.FLAG_BAND_TOP_ONLY)),
        *[F.when(q.isNotNull(), F.lit(pack)) for pack, q in shape_cols],
    )
    flags = F.array_distinct(F.concat(F.coalesce(F.col("flags"), F.array().cast("array<string>")),
                                      new_flags))
    comp_reason = (F.when(band == "unknown", F.lit(R.REASON_COMP_UNKNOWN))
                   .when(band == "clears", F.lit(R.REASON_BAND_CLEARS.format(n=_fmt(floor))))
                   .otherwise(F.lit(R.REASON_BAND_TOP_ONLY.format(n=_fmt(floor)))))
    kept_reasons = compact(
        F.when(is_flag_family, F.lit(R.REASON_TITLE_FLAG)),
        F.when(F.col("_loc_exc"), F.lit(R.REASON_LOCATION_EXCEPTION.format(n=_fmt(exc)))),
        F.when(F.col("location") == "remote-unverified", F.lit(R.REASON_REMOTE_UNVERIFIED)),
        comp_reason,
        *[F.concat(F.lit(pack), F.lit(': JD says "'), q, F.lit('"')) for pack, q in shape_cols],
    )
    reasons = F.when(survived, kept_reasons).otherwise(F.array(F.col("stage")))
    decision = (F.when(~survived, F.lit("drop"))
                .when(F.size(flags) > 0, F.lit("flag")).otherwise(F.lit("pass")))
    return (df.withColumn("flags", flags)
            .withColumn("reasons", reasons)
            .withColumn("decision", decision)
            .drop("_comp", "_loc_exc", "_shapes", "_hay", *[f"_g{i}" for i in range(len(rules.shapes))]))


def wants_detail(title: Column, location_raw: Column, is_remote: Column,
                 rules: Rules = DEFAULT_RULES) -> Column:
    """Detail gate: title family set AND (location not fail OR an exception)."""
    fam = title_family(title, rules)
    if rules.exception_usd is not None:
        return fam.isNotNull()
    return fam.isNotNull() & (location_status(location_raw, is_remote, rules) != "fail")


def liveness(candidates: DataFrame, url_probes: DataFrame, only: Column | None = None) -> DataFrame:
    """``live`` and ``live_method`` from URL probe outcomes (left join on id).

    No URL: live on board presence. Probe error: live, inconclusive. HEAD
    below 400: live; otherwise GET decides. No probe row: inconclusive. Of
    several probes of one posting the last counts (by ``probed_at`` or
    ``line_no`` where the table has one, else by its outcome).
    With ``only``, rows outside it are not probed (``live`` NULL) and the
    join condition carries the predicate, so the candidates are read once.
    """
    outcome = F.struct("head_status", "get_status", "error")
    order = [c for c in ("probed_at", "line_no") if c in url_probes.columns]
    p = url_probes.groupBy(F.col("id").alias("_pid")).agg(F.max_by(outcome, F.struct(*order, outcome)).alias("_p"))
    p = p.select("_pid", "_p.head_status", "_p.get_status", F.col("_p.error").alias("probe_error"))
    cond = F.col("id") == F.col("_pid")
    if only is not None:
        candidates = candidates.withColumn("_probe", only)
        cond = cond & F.col("_probe")
    j = candidates.join(p, cond, "left")
    no_url = F.coalesce(F.col("url"), F.lit("")) == ""
    status = F.when(F.col("head_status") < 400, F.col("head_status")).otherwise(F.col("get_status"))
    inconclusive = F.col("probe_error").isNotNull() | status.isNull()
    live = (F.when(no_url, F.lit(True)).when(inconclusive, F.lit(True)).otherwise(status < 400))
    method = (F.when(no_url, F.lit("board-presence"))
              .when(inconclusive, F.lit("url-probe-inconclusive"))
              .otherwise(F.lit("url-probe")))
    if only is not None:
        live = F.when(F.col("_probe"), live)
        method = F.when(F.col("_probe"), method)
    out = j.withColumn("live", live).withColumn("live_method", method)
    return out.drop("_pid", "head_status", "get_status", "probe_error", "_probe")


def board_presence(candidates: DataFrame, board: DataFrame) -> DataFrame:
    """``on_board``: the candidate id is still listed on its org's board.
    A candidate that is not is not live."""
    ids = board.select("id").distinct().withColumn("on_board", F.lit(True))
    return candidates.join(ids, "id", "left").withColumn(
        "on_board", F.coalesce(F.col("on_board"), F.lit(False)))


def route(df: DataFrame, include_open: bool = False) -> DataFrame:
    """``route``: title / location / comp (dropped), suppressed, zombie,
    still_open, flagged, kept. Reads flags, not the decision, because the
    history note adds a flag after the verdict."""
    r = (F.when(F.col("stage").isNotNull(), F.col("stage"))
         .when(F.col("suppressed_by").isNotNull(), F.lit("suppressed"))
         .when(~F.coalesce(F.col("live"), F.lit(True)), F.lit("zombie")))
    if not include_open:
        r = r.when(~F.col("is_new"), F.lit("still_open"))
    r = r.when(F.size("flags") > 0, F.lit("flagged")).otherwise(F.lit("kept"))
    return df.withColumn("route", r)


def funnel_counts(routed: DataFrame) -> DataFrame:
    """(stage, n): eliminated per stage in funnel order, then suppressed and
    survivors (kept + flagged + still open). One tiny aggregate."""
    counts = routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"))
    stage = (F.when(F.col("route") == "zombie", F.lit("liveness"))
             .when(F.col("route").isin("kept", "flagged", "still_open"), F.lit("survivors"))
             .otherwise(F.col("route")))
    return counts.groupBy(stage.alias("stage")).agg(F.sum("n").cast("bigint").alias("n"))

"""Application history: suppress roles already ruled on, note the rest.

History is folded to one row per company key holding, in file order, the
first entry of each distinct role key (later ones can't decide anything), and
matched with higher-order functions on the postings side. AQE picks the join
from the folded table's size: a broadcast for a configuration-sized history,
else a shuffle join with skew splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirefold import rules as R
from hirefold.functions.text import normalize_company, normalize_title
from hirefold.operators.ranking import row_numbers

ENTRY_KEYS = ("company", "status", "role", "date", "reason")


def history_by_company(history: DataFrame) -> DataFrame:
    """(company_key, entries) with entries sorted by file ordinal; blank
    company keys are skipped. Entries that a previous one of the company
    answers for (same role key, same scope) are left out, so an array is
    bounded by a company's distinct role titles."""
    h = history.withColumn("company_key", normalize_company(F.col("company"))) \
        .where(F.col("company_key") != "")
    entry = F.struct(
        F.col("ordinal"), F.col("status"), F.col("role"), F.col("date"), F.col("reason"),
        F.col("status").isin(*R.COMPANY_WIDE_STATUSES).alias("company_wide"),
        normalize_title(F.col("role")).alias("role_key"))
    firsts = (h.select("company_key", entry.alias("e"))
              .groupBy("company_key", "e.company_wide", F.col("e.role").isNull().alias("no_role"), "e.role_key")
              .agg(F.min("e").alias("e")))
    return firsts.groupBy("company_key").agg(F.array_sort(F.collect_list("e")).alias("entries"))


def attach_history(postings: DataFrame, history: DataFrame) -> DataFrame:
    """Adds ``suppressed_by`` (the ruling entry or NULL) and ``history_first``
    (the company's first entry in file order, or NULL).

    Company-wide rulings (dq, blacklist) win first, in file order; then the
    first entry with no role or whose role title-matches the posting.
    """
    hb = history_by_company(history).withColumnRenamed("company_key", "_hck")
    p = postings.withColumn("_ck", normalize_company(F.col("company_name")))
    j = p.join(hb, p["_ck"] == hb["_hck"], "left")
    # Title keys are computed once per posting (and once per ruling in the
    # history table), not inside the per-entry lambda.
    j = j.withColumn("_tk", normalize_title(F.col("title")))
    entries = F.coalesce(F.col("entries"), F.array().cast(hb.schema["entries"].dataType))

    def matches(e: Column) -> Column:
        rk, tk = e["role_key"], F.col("_tk")
        return (rk != "") & (tk != "") & ((F.instr(tk, rk) > 0) | (F.instr(rk, tk) > 0))

    wide = F.try_element_at(F.filter(entries, lambda e: e["company_wide"]), F.lit(1))
    scoped = F.try_element_at(F.filter(entries, lambda e: e["role"].isNull() | matches(e)), F.lit(1))
    return (j.withColumn("suppressed_by", F.coalesce(wide, scoped))
            .withColumn("history_first", F.try_element_at(entries, F.lit(1)))
            .drop("_ck", "_hck", "entries", "_tk"))


def history_note_reason(entry: Column) -> Column:
    when = F.when(F.coalesce(entry["date"], F.lit("")) != "",
                  F.concat(F.lit(" "), entry["date"])).otherwise(F.lit(""))
    return F.concat(F.lit("history at this company: "), entry["status"], when)


def apply_history(verdicts: DataFrame, history: DataFrame) -> DataFrame:
    """Survivors get ``suppressed_by``; unsuppressed survivors at a company
    with any history get the ``history-at-company`` flag and a reason."""
    j = attach_history(verdicts, history)
    survivor = F.col("stage").isNull()
    sup = F.when(survivor, F.col("suppressed_by"))
    noted = survivor & sup.isNull() & F.col("history_first").isNotNull()
    return (j.withColumn("suppressed_by", sup)
            .withColumn("flags", F.when(noted, F.array_distinct(
                F.concat(F.col("flags"), F.array(F.lit(R.FLAG_HISTORY))))).otherwise(F.col("flags")))
            .withColumn("reasons", F.when(noted, F.concat(
                F.col("reasons"), F.array(history_note_reason(F.col("history_first")))))
                .otherwise(F.col("reasons")))
            .drop("history_first"))


# --- loading the history document -------------------------------------------

_DOC_SCHEMA = T.StructType([
    T.StructField("history", T.ArrayType(T.StringType())),
    *[T.StructField(k, T.ArrayType(T.StringType())) for k, _ in R.LEGACY_HISTORY_KEYS],
])
_ENTRY_SCHEMA = "company string, status string, role string, date string, reason string"


def history_load(docs: DataFrame, order: str = "doc_no") -> DataFrame:
    """History documents (``doc`` JSON text) to entries with an ``ordinal``
    (0, 1, ...) through all documents by ``order`` (by their text where that
    column isn't there): of each document the structured entries first, then
    each legacy flat list as role-less entries. An unknown key or status
    raises instead of being silently dropped. A document may miss any list;
    an empty table gives no entry. Entries are numbered over the whole table
    by ``row_numbers``, so any number of documents will do."""
    at = F.col(order) if order in docs.columns else F.col("doc")
    d = docs.select(at.alias("_doc"), F.from_json("doc", _DOC_SCHEMA).alias("d"))
    allowed = F.array(*[F.lit(k) for k in ENTRY_KEYS])
    raw = F.col("raw")
    unknown = F.array_except(F.json_object_keys(raw), allowed)
    none = F.lit(None).cast("string")

    def section(n: int, name: str, status: str | None) -> Column:
        return F.transform(F.coalesce(f"d.{name}", F.array().cast("array<string>")), lambda x, i: F.struct(
            F.lit(n).alias("section"), i.alias("pos"), (x if status is None else none).alias("raw"),
            (none if status is None else x).alias("company"), F.lit(status).cast("string").alias("status")))
    sections = [section(0, "history", None)]
    sections += [section(n, key, status) for n, (key, status) in enumerate(R.LEGACY_HISTORY_KEYS, 1)]
    items = d.select("_doc", F.inline(F.concat(*sections)))
    structured = F.col("section") == 0
    checked = F.when(structured & (F.size(unknown) > 0), F.raise_error(F.concat(
        F.lit("unknown history keys: "), F.array_join(unknown, ",")))).otherwise(raw)
    items = row_numbers(items, [], ["_doc", "section", "pos"], "_n").withColumn("e", F.from_json(checked, _ENTRY_SCHEMA))
    out = items.select((F.col("_n") - 1).cast("int").alias("ordinal"),
                       F.when(structured, F.col("e.company")).otherwise(F.col("company")).alias("company"),
                       F.when(structured, F.col("e.status")).otherwise(F.col("status")).alias("status"),
                       "e.role", "e.date", "e.reason")
    bad = ~F.coalesce(F.col("status").isin(*R.HISTORY_STATUSES), F.lit(False)) | F.col("company").isNull()
    return out.withColumn("status", F.when(bad, F.raise_error(F.concat(
        F.lit("bad history entry: "), F.coalesce(F.col("company"), F.lit("?"))))).otherwise(F.col("status")))

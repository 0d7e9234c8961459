"""Chat formatting: a finite-state machine over roles and a declarative
template.

Turns become text blocks: a role header, the escaped text, a closing marker.
The machine's state is the role just read; a turn whose role the template
does not allow next is marked invalid, and a conversation is valid when every
step is and it ends in an accepting state (nothing is dropped for that).
Control strings inside texts, and backslashes, get a backslash in front, so
formatting reverses exactly. The loss flag covers the texts of the
template's loss roles, without header, marker or escapes' owner roles.

Null text and null role count as empty; a role the template doesn't know gets
the general header. Rows of one conversation are ordered by turn (null
first), role, text; repeated rows are turns of their own.

An empty table gives an empty table. Digests run on, so a long conversation isn't
held; a long text is held one Arrow batch at a time.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What a chat format consists of; nothing else knows the format."""

    headers: dict[str, str] = field(default_factory=lambda: {
        "system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other_open: str = "### ["
    other_close: str = "]: "
    close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: tuple[str, ...] = ("system", "user")
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accept: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        """Strings that must not stand bare inside a text."""
        return ["\\", self.close.strip(), *(h.strip() for h in self.headers.values()),
                self.other_open.strip(), self.other_close.strip()]

    @property
    def pattern(self) -> str:
        return "(" + "|".join(re.sub(r"([\\\[\](){}.*+?^$|#/<>:])", r"\\\1", c) for c in self.controls) + ")"


DEFAULT = ChatTemplate()


def escape(text: Column, template: ChatTemplate = DEFAULT) -> Column:
    return F.regexp_replace(text, template.pattern, r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_chat(turns: DataFrame, template: ChatTemplate = DEFAULT, conv_col: str = "conv_id",
                turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn in order: conv_id, turn, place (1, 2, ...), role,
    step_ok (the machine allows this role here), block (formatted text),
    loss_from and loss_to (code points of the block under the loss mask; both
    0 where the turn carries no loss)."""
    rows = turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
                        F.col(f"`{turn_col}`").cast("long").alias("turn"),
                        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.lag("role").over(order)
    allowed = F.when(F.row_number().over(order) == 1, F.col("role").isin(*template.start))
    for role, nexts in template.follows.items():
        allowed = allowed.when(before == role, F.col("role").isin(*nexts))
    header = F.lit(None).cast("string")
    for role, text in template.headers.items():
        header = F.when(F.col("role") == role, F.lit(text)).otherwise(header)
    header = F.coalesce(header, F.concat(F.lit(template.other_open), escape(F.col("role"), template),
                                         F.lit(template.other_close)))
    out = rows.select("conv_id", "turn", F.row_number().over(order).alias("place"), "role",
                      F.coalesce(allowed, F.lit(False)).alias("step_ok"), header.alias("header"),
                      escape(F.col("text"), template).alias("body"))
    loss = F.col("role").isin(*template.loss_roles)
    return out.select(
        "conv_id", "turn", "place", "role", "step_ok",
        F.concat("header", "body", F.lit(template.close)).alias("block"),
        F.when(loss, F.length("header")).otherwise(0).alias("loss_from"),
        F.when(loss, F.length("header") + F.length("body")).otherwise(0).alias("loss_to"))


def segments(formatted: DataFrame) -> DataFrame:
    """The text segments of a formatted table with their loss flags:
    conv_id, place, segment, text, loss (empty segments are left out)."""
    cuts = F.array(*[F.struct(F.lit(i).alias("segment"), t.alias("text"), F.lit(i == 1).alias("loss"))
                     for i, t in enumerate((F.expr("substring(block, 1, loss_from)"),
                                            F.expr("substring(block, loss_from + 1, loss_to - loss_from)"),
                                            F.expr("substring(block, loss_to + 1)")))])
    return (formatted.select("conv_id", "place", F.explode(cuts).alias("s"))
            .select("conv_id", "place", "s.segment", "s.text", "s.loss").where("text <> ''"))


def parse_block(block: str, template: ChatTemplate = DEFAULT) -> tuple[str, str]:
    """(role, text) read back from one formatted block."""
    end = len(block) - len(template.close)
    if block[end:] != template.close:
        raise ValueError("a block lacks its closing marker")
    for role, header in template.headers.items():
        if block.startswith(header):
            return role, unescape(block[len(header):end])
    shut = re.escape(template.other_close)
    m = re.match(re.escape(template.other_open) + r"((?:[^\\]|\\.)*?)" + shut, block, re.S)
    if not m:
        raise ValueError("a block lacks its header")
    return unescape(m[1]), unescape(block[m.end():end])


def _digests(template: ChatTemplate):
    def run(batches):
        conv, state = None, None
        done: list[tuple] = []

        def finish():
            if state is not None:
                done.append((conv, state["n"], state["turns"].hexdigest(), state["loss_chars"],
                             state["loss"].hexdigest(), state["chars"], state["ok"] and state["last"] in template.accept))

        def flush():
            cols = list(zip(*done, strict=True)) if done else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
            done.clear()
            return batch

        for b in batches:
            for c, block, at, to, ok in zip(*(b.column(x).to_pylist() for x in
                                              ("conv_id", "block", "loss_from", "loss_to", "step_ok")), strict=True):
                if state is None or c != conv:
                    finish()
                    conv, state = c, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(),
                                      "loss_chars": 0, "chars": 0, "ok": True, "last": None}
                role, text = parse_block(block, template)
                state["turns"].update(f"{role}\n{text}\n".encode())
                learned = unescape(block[at:to])
                state["loss"].update(learned.encode())
                state["loss_chars"] += len(learned)
                state["chars"] += len(block)
                state["n"] += 1
                state["ok"] = state["ok"] and ok
                state["last"] = role
            yield flush()
        finish()
        yield flush()
    return run


def read_back(formatted: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """Parses the formatted blocks of each conversation, in order, in one
    streaming pass (memory doesn't grow with a conversation): conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid."""
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "place")
    return rows.mapInArrow(_digests(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                           "loss_sha256 string, formatted_chars long, valid boolean")

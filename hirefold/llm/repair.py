"""Conversation structure repair: the cheapest edits that give a legal order.

Rows are dealt by conversation and sorted by turn, so a conversation streams
through one task. A dynamic program over the four states of the role order
(start, after system, after user, after assistant) moves from row to row and
across Arrow batches; what it holds of a conversation is four costs, four
running digests of the repaired text so far (no text waits for the end) and
one byte per row and state that says how the best way there went. When these
back pointers reach ``WAITING`` rows they leave the pass as a row of the
output, that is, to the shared folder; such a conversation's audit is then
read backwards, block by block, in a second pass. Others are read at once.

Ways of equal cost are told apart by their audits. Two ways that end with
the same row consumed differ somewhere before either ends, so their order
is settled by the ranks of the states they came from, then by their last
steps; the strings themselves are never compared.

Nulls in a role or text are one space (so such a text is blank), a null turn
or conversation id is one space in the damage key; a null id is a
conversation of its own. Rows of equal turn are ordered by role and text
after damage; repeated rows are rows of their own, the later one a duplicate.
Duplicates are found before, by a window over equal rows, so no task
remembers what a conversation has said. An empty table gives an empty table.
Long texts are held one Arrow batch at a time. Extra columns stay behind.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirefold.llm.common import cut

#: Rows whose back pointers wait in a task before they leave it.
WAITING = 1 << 16

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
#: State after a role: 1 system, 2 user, 3 assistant; 0 is the start.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAME = {USER: "user", ASSISTANT: "assistant"}
#: Where a conversation may end: with nothing, or after an assistant.
ENDS = (START, ASSISTANT)
FIELDS = ("conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string, block long, pointers binary")


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copy, dropped): the rows with faults put in
    by crc32("conv_id:turn") % 20 (0 dropped, 1 emptied, 2 without ``.!?``, 3 said
    twice, 4 by the user). Dropped rows stay, marked, without role or text."""
    space = F.lit(" ")

    def named(c: str):
        return F.coalesce(F.col(f"`{c}`").cast("string"), space)
    key = F.concat(F.coalesce(F.col(f"`{conv_col}`").cast("long").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col(f"`{turn_col}`").cast("long").cast("string"), space))
    rows = turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                        named(role_col).alias("role"), named(text_col).alias("text"),
                        (F.crc32(key.cast("binary")) % 20).alias("fault"))
    text = (F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    role = F.when(F.col("fault") == 0, "").when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("dropped"),
                       F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def marked(rows: DataFrame) -> DataFrame:
    """Adds ``fault``: the first that holds of blank, duplicate, truncated."""
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return rows.withColumn("seen", F.row_number().over(same)).withColumn(
        "fault", F.when(last == "", "blank").when(F.col("seen") > 1, "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated").otherwise("")).drop("seen")


def steps(initial: str, must_go: bool, truncated: bool) -> list[tuple[int, int, int, str, str, tuple]]:
    """All ways over one row: (from, to, cost, audit, step, inserted rows); a step is
    what the row itself suffers. More than two insertions before a row would
    come back to where they began."""
    out = []
    for state in range(4):
        at, put = state, []
        for inserts in range(3):
            if inserts:
                at = NEXT[at]
                put.append(NAME[at])
            paid, audit = COST[INSERT] * inserts, INSERT * inserts
            out.append((state, at, paid + COST[DELETE], audit + DELETE, DELETE, tuple(put)))
            if must_go:
                continue
            more = TRUNCATED if truncated else 0
            if initial == "s" and at == START:
                out.append((state, SYSTEM, paid + more, audit + KEEP, KEEP, tuple(put)))
            to = NEXT[at]
            if initial == NAME[to][0]:
                out.append((state, to, paid + more, audit + KEEP, KEEP, tuple(put)))
            out.append((state, to, paid + COST[REROLE] + more, audit + REROLE, REROLE, tuple(put)))
    return out


class Repair:
    """One conversation on its way through the program."""

    #: Audits of one row's steps, by number (one byte holds it and the state before).
    AUDITS = tuple(INSERT * i + step for i in range(3) for step in (DELETE, KEEP, REROLE))
    _steps: dict = {}

    def __init__(self, conv):
        self.conv = conv
        self.best = {START: (0, 0)}          # state: (cost, rank of its audit among the states)
        self.sha = {START: None}             # state: digest of the repaired rows so far, None before the first
        self.pointers = bytearray()          # four bytes a row: 9 * state before + number of the audit, 255 for no way
        self.blocks = 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.low = self.high = self.turn = self.before = None
        self.turns = self.illegal = 0

    def row(self, turn, role: str, text: str, fault: str) -> None:
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.turn = self.high = turn
        kind = (initial if initial in ("s", "u", "a") else "", fault in ("blank", "duplicate"), fault == "truncated")
        ways = self._steps.get(kind)
        if ways is None:
            ways = self._steps[kind] = steps(*kind)
        found: dict = {}
        for state, to, cost, audit, step, put in ways:
            if state in self.best:
                paid, rank = self.best[state]
                way = (paid + cost, rank, audit, state, step, put)
                if to not in found or way[:3] < found[to][:3]:
                    found[to] = way
        ranks = {to: i for i, to in enumerate(sorted(found, key=lambda t: found[t][1:3]))}
        sha, pointers = {}, bytearray(b"\xff\xff\xff\xff")
        for to, (_, _, audit, state, step, put) in found.items():
            pointers[to] = 9 * state + self.AUDITS.index(audit)
            said = [f"{name}:" for name in put]
            if step != DELETE:
                said.append(f"{role if step == KEEP else NAME[to]}:{text}")
            sha[to] = self.said(self.sha[state], said)
        self.best = {to: (way[0], ranks[to]) for to, way in found.items()}
        self.sha = sha
        self.pointers += pointers

    @staticmethod
    def said(sha, rows: list[str]):
        if not rows:
            return sha
        data = "\n".join(rows)
        if sha is None:
            return hashlib.sha256(data.encode())
        sha = sha.copy()
        sha.update(f"\n{data}".encode())
        return sha

    def end(self) -> tuple:
        """(state after the last row, rows to insert there, cost, audit of those, digest)."""
        ways = []
        for state, (cost, rank) in self.best.items():
            at, put = state, []
            while at not in ENDS:
                at = NEXT[at]
                put.append(NAME[at])
            ways.append((cost + COST[INSERT] * len(put), rank, INSERT * len(put), state, put))
        cost, _, audit, state, put = min(ways)
        sha = self.said(self.sha[state], [f"{name}:" for name in put])
        return state, cost, audit, (sha or hashlib.sha256()).hexdigest()

    def close(self) -> list[list]:
        """The conversation's last rows of output."""
        spilt = [self.spill()] if self.blocks and self.pointers else []
        state, cost, audit, sha = self.end()
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        if self.blocks:
            # The second pass starts from this row: the state, then the audit's end.
            tail, block = bytes([state]) + audit.encode(), self.blocks + 1
            return [*spilt, [self.conv, gaps, *self.counts.values(), self.illegal, cost, None, sha, block, tail]]
        _, front = walk_back(self.pointers, state)
        return [[self.conv, gaps, *self.counts.values(), self.illegal, cost, front + audit, sha, None, None]]

    def spill(self) -> list:
        """The waiting back pointers as a row of their own."""
        self.blocks += 1
        out = [self.conv, *[None] * 8, self.blocks, bytes(self.pointers)]
        self.pointers = bytearray()
        return out


def walk_back(pointers: bytes, state: int) -> tuple[int, str]:
    """(state before, audit) of a block of back pointers that ends in ``state``."""
    out = []
    for at in range(len(pointers) - 4, -1, -4):
        state, audit = divmod(pointers[at + state], 9)
        out.append(Repair.AUDITS[audit])
    return state, "".join(reversed(out))


def _forward(waiting: int):
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({c: "Int64" for c in names if c not in ("conv_id", "audit", "repaired_sha256", "pointers")})

    def run(batches):
        now = None
        for b in batches:
            out = []
            for conv, turn, role, text, fault, dropped in zip(*(b[c] for c in ("conv_id", "turn", "role", "text", "fault", "dropped")),
                                                              strict=True):
                if now is None or conv != now.conv:
                    out += now.close() if now is not None else []
                    now = Repair(conv)
                if not dropped:
                    now.row(None if turn is None else int(turn), role, text, fault)
                    if len(now.pointers) >= 4 * waiting:
                        out.append(now.spill())
            yield frame(out)
        if now is not None:
            yield frame(now.close())
    return run


def _backward(batches):
    """Blocks of a conversation, the last first, to the pieces of its audit."""
    conv, state, seen = None, START, False
    for b in batches:
        out = []
        for c, block, data in zip(b["conv_id"], b["block"], b["pointers"], strict=True):
            if not seen or c != conv:
                # The summary's row: where the conversation ended.
                conv, seen, state, piece = c, True, data[0], bytes(data[1:]).decode()
            else:
                state, piece = walk_back(data, state)
            out.append((c, block, piece))
        yield pd.DataFrame(out, columns=["conv_id", "block", "piece"])


def repair(rows: DataFrame, waiting: int = WAITING) -> DataFrame:
    """One row per conversation of ``marked`` rows (conv_id, turn, role, text, copy,
    dropped, fault): conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "copy")]
    # Ids and turns travel as text: pandas would make floats of longs with nulls.
    dealt = rows.repartition(n, "conv_id").sortWithinPartitions(*order).select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "role", "text", "fault", "dropped")
    found = cut(dealt.mapInPandas(_forward(waiting), FIELDS))
    whole = found.where("repaired_sha256 is not null").drop("pointers")
    long = found.where("block is not null").select("conv_id", "block", "pointers")
    pieces = (long.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("block").desc())
              .mapInPandas(_backward, "conv_id string, block long, piece string"))
    # One letter a row: an audit is a cell of the result, so it meets in one place.
    audits = pieces.groupBy(F.col("conv_id").alias("c")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "").alias("long_audit"))
    return whole.join(audits, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").isNotNull(), "left").select(
        F.col("conv_id").cast("long").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
        F.coalesce("audit", "long_audit").alias("audit"), "repaired_sha256")


def repair_damaged(turns: DataFrame, waiting: int = WAITING, **columns: str) -> DataFrame:
    """``turns`` damaged by key, marked and repaired; one row per conversation id of ``turns``."""
    return repair(marked(damage(turns, **columns)), waiting)

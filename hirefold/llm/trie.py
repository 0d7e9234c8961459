"""Conversation prefix trie, totalled by parallel tree contraction.

Each distinct sequence of first d turns (role, text) is a node. Nothing walks
a path: all steps are joins and aggregates over whole tables.

Turns are numbered in a range-sorted table: a partition's rows carry rising
ids, and what earlier partitions hold of a conversation is added from one
summary row per conversation and partition, so a conversation of any length
spreads over tasks. A prefix is identified by four running sums of 32 bits
of MD5 over (place, role, text), summed in blocks of ``BLOCK`` turns, then over
blocks; equal sums of all four at one depth are one node.

Subtree totals come from contraction, in rounds. Rake: every leaf adds its
totals to its parent and leaves the tree with its own totals known. Compress:
in chains of nodes with one child, those whose depth has the round's bit
set, and whose child's has not, leave; the child moves up to the parent, and "total = own + total of that child" is noted. A fresh chain of n
nodes halves each round. At last the noted nodes are re-expanded: their
pointers jump (at most the logarithm of the rounds) until they end at a raked
node, whose totals are known.

A null role or text is empty. Turns are ordered by turn (null first), role,
text; repeated rows are turns of their own. A null conversation id is a
conversation of its own, whose decimal id is empty; it shares no head
and comes last among members. An empty table has no node, not even a root;
a conversation left without turns is a member of the root. Texts are only
hashed and measured in the first pass, so long ones go no further. Extra
columns of any name stay behind.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirefold.llm.common import Steps

#: Turns whose running sums one window partition holds.
BLOCK = 1 << 12
#: Characters of joined ids that travel as one row towards a node's digest.
RUN = 1 << 16
SUMS = ["s1", "s2", "s3", "s4"]


def number_turns(turns: DataFrame, steps: Steps, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, place 1.., digest, chars): the turns of each conversation in
    order. No task needs to hold, or pass through, a whole conversation."""
    rows = turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
                        F.col(f"`{turn_col}`").cast("long").alias("turn"),
                        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The role's length keeps "ab" + "c" and "a" + "bc" apart.
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    # Written: the ids below hold for this very sort only.
    at = steps.write(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(
        "conv_id", digest.alias("digest"), F.length("text").cast("long").alias("chars"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    pieces = at.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "first",
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return steps.write(at.join(pieces, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select(
        "conv_id", (F.col("at") - F.col("first") + F.col("earlier") + 1).alias("place"), "digest", "chars"), at.count())


def share_heads(placed: DataFrame, steps: Steps, group: int = 100, longest: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared heads, of ``placed`` turns: (depth rows,
    one row per conversation). Conversation c starts with the first h turns
    of conversation c - c % group (the remainder is never negative), h =
    crc32(c) % longest, then go on with its own turns after its first h."""
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(group))
    lengths = steps.write(placed.groupBy("conv_id").agg(F.count("*").alias("own")), placed.count())
    heads = lengths.select("conv_id", "own", base.alias("base"),
                           F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest, F.lit(0)).alias("h"))
    of_base = lengths.where(F.pmod("conv_id", F.lit(group)) == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("has"))
    convs = steps.write(heads.join(of_base, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("head"),
        F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("tail")), lengths.count())
    first = placed.where((F.pmod("conv_id", F.lit(group)) == 0) & (F.col("place") < longest)).withColumnRenamed("conv_id", "base")
    shared = first.join(convs, "base").where("place <= head").select("conv_id", F.col("place").alias("depth"), "digest", "chars")
    named = convs.select(F.col("conv_id").alias("c"), "h", "head")
    own = (placed.join(named, F.col("conv_id").eqNullSafe(F.col("c"))).where("place > h")
           .select("conv_id", (F.col("head") + F.col("place") - F.col("h")).alias("depth"), "digest", "chars"))
    most = placed.count() + (longest - 1) * convs.count()
    return steps.write(shared.unionByName(own), most), convs.select("conv_id", (F.col("head") + F.col("tail")).alias("n_turns"))


def prefixes(rows: DataFrame) -> DataFrame:
    """Adds s1 to s4, the running sums that identify each prefix, and p1 to
    p4, those of the prefix before it."""
    word = F.md5(F.concat_ws(":", F.col("depth").cast("string"), "digest"))
    hashed = rows.select("conv_id", "depth", "chars", F.floor(F.col("depth") / BLOCK).alias("block"), *[
        F.conv(F.substring(word, 8 * i + 1, 8), 16, 10).cast("long").alias(f"w{i + 1}") for i in range(4)])
    blocks = hashed.groupBy("conv_id", "block").agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in range(1, 5)])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                           *[F.coalesce(F.sum(f"w{i}").over(before), F.lit(0)).alias(f"b{i}") for i in range(1, 5)])
    within = Window.partitionBy("conv_id", "block").orderBy("depth")
    sums = hashed.select("conv_id", "depth", "chars", "block", *[f"w{i}" for i in range(1, 5)],
                         *[F.sum(f"w{i}").over(within).alias(f"r{i}") for i in range(1, 5)])
    whole = sums.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return whole.select("conv_id", "depth", "chars", *[(F.col(f"r{i}") + F.col(f"b{i}")).alias(f"s{i}") for i in range(1, 5)],
                        *[(F.col(f"r{i}") + F.col(f"b{i}") - F.col(f"w{i}")).alias(f"p{i}") for i in range(1, 5)])


def _joined(batches):
    """(depth, node, conv) in order to runs of comma-joined ids."""
    key, first, run, size = None, None, [], 0

    def row():
        return pa.RecordBatch.from_pydict(
            {"depth": [key[0]], "node": [key[1]], "first": [first], "ids": [",".join(run)]}, schema=_RUNS)
    for b in batches:
        for d, node, rank, name in zip(*(b.column(c).to_pylist() for c in ("depth", "node", "rank", "name")), strict=True):
            if (d, node) != key or size >= RUN:
                if run:
                    yield row()
                key, first, run, size = (d, node), rank, [], 0
            run.append(name)
            size += len(name) + 1
    if run:
        yield row()


def _digested(batches):
    """Runs of ids in order to one SHA-256 per node; only the digest's state is held."""
    key, state = None, None
    for b in batches:
        out = []
        for d, node, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
            if (d, node) != key:
                if state is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (d, node), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, r, strict=True)) for r in out], schema=_DIGESTS)
    if state is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, (*key, state.hexdigest()), strict=True))], schema=_DIGESTS)


_RUNS = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
_DIGESTS = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("ends_sha256", pa.string())])
NO_IDS = hashlib.sha256(b"").hexdigest()


def end_digests(ends: DataFrame, most: int, steps: Steps) -> DataFrame:
    """(depth, node, ends_sha256) of (depth, node, conv_id): the digest of
    the ids, ascending and comma-joined. Ids of one node are joined to runs
    in any number of tasks; one task then reads the runs in order."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ends.select("depth", "node", F.coalesce("conv_id", F.lit((1 << 63) - 1)).alias("rank"),
                       F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("name"))
    order = ["depth", F.col("node").asc_nulls_last(), "rank"]
    runs = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        _joined, "depth long, node long, first long, ids string")
    return steps.write(runs.repartition(n, "depth", "node").sortWithinPartitions("depth", "node", "first")
                       .mapInArrow(_digested, "depth long, node long, ends_sha256 string"), most)


def trie_nodes(rows: DataFrame, convs: DataFrame, steps: Steps) -> DataFrame:
    """One row per node: depth, conv_id (smallest member), parent_conv_id,
    n_convs, chars (code points of its last text), ends_sha256. A node is
    named by (depth, conv_id) from here on: nodes of one depth share no
    member. ``rows``: (conv_id, depth, digest, chars); ``convs``: (conv_id, n_turns)."""
    most = rows.count()
    marks = steps.write(prefixes(rows), most)
    nodes = (marks.groupBy("depth", *SUMS).agg(
        F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
        *[F.max(f"p{i}").alias(f"p{i}") for i in range(1, 5)]))
    root = convs.agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(s) for s in SUMS], "node", "n_convs",
        F.lit(0).cast("long").alias("chars"), *[F.lit(None).cast("long").alias(f"p{i}") for i in range(1, 5)])
    nodes = steps.write(nodes.unionByName(root), most + 1)
    above = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(f"s{i}").alias(f"p{i}") for i in range(1, 5)],
                         F.col("node").alias("parent"))
    tree = nodes.join(above, ["depth", "p1", "p2", "p3", "p4"], "left")
    last = convs.withColumnRenamed("conv_id", "c")
    at_end = marks.join(last, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("depth") == F.col("n_turns")))
    turnless = convs.where("n_turns = 0").select("conv_id", F.lit(0).cast("long").alias("depth"),
                                                 *[F.lit(0).cast("long").alias(x) for x in SUMS])
    named = nodes.select("depth", *SUMS, "node")
    ends = at_end.select("conv_id", "depth", *SUMS).unionByName(turnless).join(named, ["depth", *SUMS])
    digests = end_digests(ends.select("depth", "node", "conv_id"), convs.count(), steps).select(
        F.col("depth").alias("d"), F.col("node").alias("k"), "ends_sha256")
    return tree.join(digests, (F.col("depth") == F.col("d")) & F.col("node").eqNullSafe(F.col("k")), "left").select(
        "depth", F.col("node").alias("conv_id"), F.col("parent").alias("parent_conv_id"), "n_convs", "chars",
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))


def subtree_totals(tree: DataFrame, values: list[str], steps: Steps | None = None) -> DataFrame:
    """(id, *values): each node's values summed over its subtree. ``tree``:
    (id, parent, depth, *values); a root's parent is null, any forest whose
    depth rises by one from parent to child will do. A round is two joins by
    id, each of which writes what is left, so a lost executor costs a round
    at most."""
    steps = steps or Steps(tree.sparkSession, "trie")
    first = alive = steps.write(tree.select("id", "parent", "depth", *values))
    n, deepest = first.agg(F.count("*"), F.max("depth")).first()
    bits = max(1, int(deepest or 0).bit_length())
    add = [F.sum(v).alias(f"add_{v}") for v in values]
    grown = [(F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values]
    kids = alive.where("parent is not null").groupBy(F.col("parent").alias("to")).agg(F.count("*").alias("kids"))
    alive = steps.write(alive.join(kids, F.col("id") == F.col("to"), "left").select(
        "id", "parent", "depth", F.coalesce("kids", F.lit(0)).alias("kids"), *values), n)
    raked, noted, turn = [], [], 0
    while n:
        # Rake: leaves hand their totals to their parents and are done. The
        # same pass tells a parent with one child left which child that is.
        leaf = F.col("kids") == 0
        raked.append(alive.where(leaf).select("id", *values))
        news = alive.groupBy(F.col("parent").alias("to")).agg(
            F.count_if(leaf).alias("gone"), F.max(F.when(~leaf, F.struct("depth", "id"))).alias("child"),
            *[F.sum(F.when(leaf, F.col(v))).alias(f"add_{v}") for v in values])
        left = F.col("kids") - F.coalesce("gone", F.lit(0))
        # Compress: of a chain, those with the round's bit set in their depth
        # above one without it, so never two in a row.
        splice = ((left == 1) & F.col("parent").isNotNull() & (F.shiftright("depth", turn % bits) % 2 == 1)
                  & (F.shiftright("child.depth", turn % bits) % 2 == 0))
        inner = steps.write(alive.where(~leaf).join(news, F.col("id") == F.col("to"), "left").select(
            "id", "parent", "depth", left.alias("kids"), *grown,
            F.when(splice, F.col("child.id")).alias("child")), n)
        turn += 1
        n = inner.count()
        if not n:
            break
        out = inner.where("child is not null")
        noted.append(out.select("id", "child", *values))
        # The child moves up, the parent takes over the node's own totals.
        moves = F.array(F.struct(F.col("child").alias("to"), F.col("parent").alias("up"), *[F.lit(0).cast("long").alias(v) for v in values]),
                        F.struct(F.col("parent").alias("to"), F.lit(None).alias("up"), *[F.col(v).cast("long").alias(v) for v in values]))
        news = out.select(F.inline(moves)).groupBy("to").agg(F.max("up").alias("up"), *add)
        alive = steps.write(inner.where("child is null").join(news, F.col("id") == F.col("to"), "left").select(
            "id", F.coalesce("up", "parent").alias("parent"), "depth", "kids", *grown), n)
    if not raked:
        return first.select("id", *values)
    known = _all(raked)
    if not noted:
        return known
    # Re-expand: a pointer's target left in a later round, so pointers end.
    noted = _all(noted)
    n = noted.count()
    while True:
        to = noted.select(F.col("id").alias("target"), F.col("child").alias("next"), *[F.col(v).alias(f"add_{v}") for v in values])
        noted = steps.write(noted.join(to, F.col("child") == F.col("target"), "left").select(
            "id", F.coalesce("next", "child").alias("child"), *grown, F.col("next").isNotNull().alias("jumped")), n)
        if noted.where("jumped").isEmpty():
            break
        noted = noted.drop("jumped")
    ends = known.select(F.col("id").alias("child"), *[F.col(v).alias(f"add_{v}") for v in values])
    return known.unionByName(noted.join(ends, "child").select("id", *grown))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def prefix_trie(turns: DataFrame, group: int = 100, longest: int = 6, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    steps = Steps(turns.sparkSession, "trie")
    placed = number_turns(turns, steps, conv_col, turn_col, role_col, text_col)
    name = F.struct("depth", "conv_id")
    above = F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")))
    named = trie_nodes(*share_heads(placed, steps, group, longest), steps).withColumn("id", name).withColumn("parent", above)
    named = steps.write(named, placed.count())
    children = named.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    tree = steps.write(named.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                       .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars"))
                       .withColumn("n_leaves", (F.col("n_children") == 0).cast("long")), named.count())
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"], steps)
    return tree.drop("n_leaves", "saved_tokens").join(totals, "id").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

"""The prefix trie and the structure repair against brute force: nulls in any
column, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
WS = " \t\n\x0b\x0c\r"


def table(spark, rows):
    """With more columns, named like the operators' own."""
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("place", "depth", "node", "fault", "copy", "h", "s1", "block", "dropped"):
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3)


def made(seed, convs=40, most=12):
    """Conversations over a few texts, so that prefixes, faults and copies abound."""
    rnd = random.Random(seed)
    rows = []
    for c in [0, *rnd.sample(range(1, 420), convs), None, 9_007_199_254_740_993]:
        for t in range(rnd.randrange(1, most)):
            rows.append((c, rnd.choice([t, t, t, None, 2 * t]), rnd.choice(["user", "assistant", "system", None, "", "tool"]),
                         rnd.choice(["Yes.", "Why?", "no", "", None, " \n", "Éa.", "a. b"])))
    rows += rows[:5]
    return rows


def in_order(rows, role="", text=""):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role if r is None else r, text if x is None else x))
    return {c: sorted(v) for c, v in convs.items()}


def trie_by_hand(rows):
    convs = {c: [q[2:] for q in v] for c, v in in_order(rows).items()}
    rebuilt = {}
    for c, own in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = (convs.get(c - c % 100, []) if c is not None else [])[:h] + own[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for m in members.values():
        m.sort(key=lambda c: (c is None, c or 0))
    kids, leaves, saved = ({k: 0 for k in members} for _ in range(3))
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += kids[k] == 0
    return [(m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(
        ",".join("" if c is None else str(c) for c in m if len(rebuilt[c]) == len(k)).encode()).hexdigest())
        for k, m in members.items()]


def same(got, want):
    def key(row):
        return tuple((x is None, "" if isinstance(x, str) else x or 0, str(x)) for x in row)
    return sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("block", [3, 1 << 12])
def test_trie(spark, monkeypatch, block):
    from hirefold.llm import trie
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "RUN", 4)
    rows = made(1)
    assert same(trie.prefix_trie(table(spark, rows)).collect(), trie_by_hand(rows))


def test_trie_of_a_long_conversation_and_of_copies(spark):
    from hirefold.llm.trie import prefix_trie
    rows = [(700, t, "user", f"t{t % 5}" * (1 + 4000 * (t == 9))) for t in range(150)]
    rows += [(c, t, "user", f"t{t % 5}") for c in range(801, 840) for t in range(3)]
    assert same(prefix_trie(table(spark, rows)).collect(), trie_by_hand(rows))


def test_trie_of_nothing(spark):
    from hirefold.llm.trie import prefix_trie
    assert prefix_trie(table(spark, [])).collect() == []


def test_contraction_of_any_forest(spark):
    from hirefold.llm.trie import subtree_totals
    rnd = random.Random(3)
    parent = {0: None, 1: 0}
    for i in range(2, 90):
        parent[i] = i - 1 if i < 40 else rnd.randrange(i)
    parent |= {100: None, 101: None, 102: 101}
    depth = {}
    for i, p in parent.items():
        depth[i] = 0 if p is None else depth[p] + 1
    want = dict.fromkeys(parent, 0)
    for i in parent:
        up = i
        while up is not None:
            want[up] += i + 1
            up = parent[up]
    tree = spark.createDataFrame([(i, p, depth[i], i + 1) for i, p in parent.items()], "id long, parent long, depth long, w long")
    assert dict(map(tuple, subtree_totals(tree, ["w"]).collect())) == want
    assert subtree_totals(tree.limit(0), ["w"]).collect() == []


def damaged(rows):
    convs = {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        turns = convs.setdefault(c, [])
        x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
        turns += [(t, "user" if fault == 4 else r, x)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    for turns in convs.values():
        turns.sort(key=lambda q: (q[0] is not None, q[0] or 0, *q[1:]))
    return convs


def faults_of(turns):
    seen, out = set(), []
    for _, r, x in turns:
        said = x.strip(WS)
        out.append("b" if not said else "d" if (r, x) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def legal(initials):
    return re.fullmatch("(s?(ua)+)?", initials)


def cheapest(turns, faults):
    """By cost and then audit, whole strings, best first."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, said = heapq.heappop(heap)
        if i == len(turns) and last in ("", "a"):
            return cost, audit, said
        if (i, last) in done:
            continue
        done.add((i, last))
        for role in ("user", "assistant"):
            if role[0] in follows[last]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], (*said, f"{role}:")))
        if i == len(turns):
            continue
        _, r, x = turns[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, said))
        if faults[i] in ("", "t"):
            more = 5 * (faults[i] == "t")
            for edit, paid, role in (("K", 0, r), ("R", 1, "user"), ("R", 1, "assistant")):
                if role[:1] and role[0] in follows[last]:
                    heapq.heappush(heap, (cost + paid + more, audit + edit, i + 1, role[0], (*said, f"{role}:{x}")))


def every(turns, faults):
    """All edits with at most two insertions at a place, tried one by one."""
    best = None
    for edits in itertools.product("DKua", repeat=len(turns)):
        for puts in itertools.product(("", "u", "a", "ua", "au"), repeat=len(turns) + 1):
            initials = audit = ""
            cost, said = 0, []
            for i in range(len(turns) + 1):
                initials, audit, cost = initials + puts[i], audit + "I" * len(puts[i]), cost + 5 * len(puts[i])
                said += ["user:" if p == "u" else "assistant:" for p in puts[i]]
                if i < len(turns):
                    e, (_, r, x) = edits[i], turns[i]
                    if e != "D" and faults[i] in ("b", "d"):
                        cost = 10 ** 9
                    cost += {"D": 2, "K": 0}.get(e, 1) + 5 * (e != "D" and faults[i] == "t")
                    role = {"D": "", "K": r, "u": "user", "a": "assistant"}[e]
                    audit += e if e in "DK" else "R"
                    if e != "D":
                        initials += role[:1] or "?"
                        said.append(f"{role}:{x}")
            if legal(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, tuple(said))
    return best


def repaired_by_hand(rows):
    for c, turns in damaged(rows).items():
        faults = faults_of(turns)
        times = [t for t, _, _ in turns if t is not None]
        gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, said = cheapest(turns, faults)
        yield (c, gaps, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def test_brute_force_agrees_with_trying_everything():
    rnd = random.Random(5)
    for _ in range(60):
        turns = [(i, rnd.choice(["user", "assistant", "system", "tool", ""]), rnd.choice(["Yes.", "no", ""]))
                 for i in range(rnd.randrange(4))]
        assert cheapest(turns, faults_of(turns)) == every(turns, faults_of(turns))


@pytest.mark.parametrize("waiting", [2, 1 << 16])
def test_repair(spark, waiting):
    from hirefold.llm.repair import repair_damaged
    rows = made(2, convs=60) + [(500, t, random.Random(t).choice(["user", "assistant"]), f"{t}.") for t in range(300)]
    got = repair_damaged(table(spark, rows), waiting)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert same(got.collect(), list(repaired_by_hand(rows)))


def test_repair_carries_its_state_across_batches(spark):
    from hirefold.llm.repair import repair_damaged
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(c, t, ("user", "assistant")[t % 2], f"{t} " * (1 + 30000 * (t == 7)) + ".") for c in range(3) for t in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = repair_damaged(table(spark, rows), 5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert same(got, list(repaired_by_hand(rows)))


def test_repair_of_nothing_and_of_a_dropped_conversation(spark):
    from hirefold.llm.repair import repair_damaged
    assert repair_damaged(table(spark, [])).collect() == []
    gone = next((c, 0, "user", "Hi.") for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert tuple(repair_damaged(table(spark, [gone])).first()) == (gone[0], *[0] * 6, "", hashlib.sha256(b"").hexdigest())

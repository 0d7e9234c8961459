"""Corpus operators against brute force, and their edge cases: nulls in any
column, empty and long texts, ties, repeated rows, empty tables, extra
columns with clashing names."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(30000))
ROWS = [(1, "Hello World and all that goes with it in the end", "a"), (2, "HELLO world and all that goes with it in the end", "a"),
        (3, None, None), (4, "", "b"), (5, LONG, "b"), (6, LONG + " x", None), (2, "HELLO world and all that goes with it in the end", "a"),
        (None, "text of no one", "a"), (None, None, "c"), (9, "Éa éa   \t\n zz", "c"), (10, "one", "c"), (11, "one", "c")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    from hirefold.llm import common
    common.prepare(spark)
    # Extra columns named like the operators' own.
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("fp", "label", "batch", "kept", "size", "copies", "target", "doc", "hits", "words"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """With more columns, named like what the filters add."""
    for c in ("own_sha", "keep", "digest", "many", "text_sha256", "text_key", "row_key", "lost", "lost_key", "score",
              "name", "total", "mix_copy"):
        df = df.withColumn(c, F.lit("x"))
    return df


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_polynomial_fingerprints_compose():
    from hirefold.llm.exact import CHUNK, Hasher
    h = Hasher()
    data = bytes(random.Random(1).randbytes(3 * CHUNK + 17))
    parts = [h.chunk(data[i:i + 5000]) for i in range(0, len(data), 5000)]
    left = parts[0]
    for p in parts[1:]:
        left = h.combine(left, p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = h.combine(p, right)
    fp, n = h.text(data)
    assert left == right and n == len(data) and fp == (left[1] << 31) | left[2]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(docs, weak):
    from hirefold.llm.exact import Hasher, exact_duplicates
    got = rows_of(exact_duplicates(docs, hasher=Hasher((3, 5), (2, 2)) if weak else None))
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    want = []
    for data, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            first = i == keep and not kept
            kept = kept or first
            want.append((i, keep, len(ids), first, hashlib.sha256(data).hexdigest()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got), key=key) == sorted(want, key=key)


def test_exact_filter_keeps_columns(docs):
    from hirefold.llm.exact import drop_exact_duplicates
    docs = clashing(docs)
    got = drop_exact_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in rows_of(got)) == sorted(["2", "4", "5", "6", "None", "9", "11"])


def brute_simhash(text, k=3):
    w = WORD.findall((text or "").encode().lower())
    if not w:
        return 0
    grams = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [8192, 3])
def test_simhash_components(spark, docs, hot):
    from hirefold.llm.simhash import near_duplicates
    rng = random.Random(4)
    base = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(400)]
    more = [(100 + i, " ".join(base[:400 - i]), "s") for i in range(12)]
    df = docs.select("doc_id", "text", "source").union(spark.createDataFrame(more, SCHEMA))
    every = [(r[0], brute_simhash(r[1])) for r in [*ROWS, *more]]
    parent = {f: f for _, f in every}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    prints = sorted(parent)
    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 2:
                parent[find(b)] = find(a)
    low = {}
    for i, f in every:
        if i is not None:
            low[find(f)] = min(i, low.get(find(f), i))
    want = sorted((str(i), f"{f:016x}", str(low.get(find(f)))) for i, f in every)
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows_of(near_duplicates(df, hot=hot)))
    assert got == want


def test_simhash_filter_keeps_one_of_each_group(spark, docs):
    from hirefold.llm.simhash import drop_near_duplicates
    more = spark.createDataFrame([(3, "one", "z"), (None, "text of no one", "z"), (None, "a third text of no one", "z")], SCHEMA)
    df = clashing(docs.unionByName(more, allowMissingColumns=True))
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    kept = sorted((str(r["doc_id"]), (r["text"] or "")[:20]) for r in rows_of(got))
    assert kept == sorted([("1", ROWS[0][1][:20]), ("3", ""), ("5", LONG[:20]), ("9", ROWS[9][1][:20]), ("3", "one"),
                           ("None", "text of no one"), ("None", "text of no one"), ("None", "a third text of no o")])
    assert rows_of(got.where("score <> 'x' or text_key <> 'x' or lost <> 'x'")) == []


def test_tiles_find_all_links():
    from hirefold.llm.simhash import tile_links
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(1 << 7), base ^ np.uint64((1 << 7) | (1 << 40) | 2)]))
    root = tile_links(fps, 2, tile=16)
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        for i in range(len(fps)):
            near = np.bitwise_count(fps ^ fps[i]) <= 2
            label[near] = np.minimum(label[near], label[i])
            label[i] = label[near].min()
    assert (root == label).all()


def test_substrings(spark, docs):
    from hirefold.llm import substring
    rng = random.Random(7)
    shared = [" ".join(rng.choice("abcde") + str(rng.randint(0, 9)) for _ in range(30)) for _ in range(4)]
    more = [(100 + i, "\n".join([f"u{i} v{i}", rng.choice(shared), " ".join(rng.choice(shared).split()[5:25]), "z"]), "s")
            for i in range(25)]
    df = docs.select("doc_id", "text", "source").union(spark.createDataFrame(more, SCHEMA))
    every = [(r[0], WORD.findall((r[1] or "").encode())) for r in [*ROWS, *more]]
    inf = 1 << 62
    first = {}
    for i, w in every:
        for k in range(len(w) - 12):
            g = tuple(w[k:k + 13])
            first[g] = min(first.get(g, inf), inf if i is None else i)
    want = []
    for i, w in every:
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < (inf if i is None else i) for j in range(13)}
        want.append((str(i), len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    for hot in (64, 1):
        substring.HOT = hot
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"]) for r in rows_of(substring.dedup_substrings(df)))
        assert got == sorted(want)
    substring.HOT = 64


def test_substring_batches_of_one_id(spark, monkeypatch):
    from hirefold.llm import substring
    rng = random.Random(17)
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(None if i % 2 else 5, f"a{i} {shared if i % 3 else ''} " + " ".join(f"w{rng.randint(0, 999)}" for _ in range(20)))
            for i in range(60)] + [(1, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda: sorted(map(str, rows_of(substring.dedup_substrings(df))))
    want = run()
    monkeypatch.setattr(substring, "BATCH", 1000)
    assert run() == want

    def sizes(size):
        def count(left, right):
            import pyarrow as pa
            return pa.table({"doc_id": pa.array([None], pa.int64()), "n_words": pa.array([left.num_rows], pa.int64()),
                             "n_removed": pa.array([0], pa.int64()), "text": pa.array([""], pa.string())})
        return count
    monkeypatch.setattr(substring, "_remove", sizes)
    n = [r["n_words"] for r in rows_of(substring.dedup_substrings(df))]
    assert sum(n) == len(rows) and max(n) < len(rows) // 3


def test_mix_targets(spark):
    from hirefold.llm.mixing import source_targets
    rng = random.Random(3)
    for _ in range(4):
        sizes = {f"s{i:02}": rng.choice([0, 1, 10, 500, 90000]) for i in range(9)} | {None: 40}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in source_targets(df).collect()}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: i % 3 + 1 for i, s in enumerate(order)}
        target, capped, left = {}, set(), sum(sizes.values())
        while True:  # share, stop at the limits, share the rest again
            free = [s for s in order if s not in capped]
            rest = left - sum(3 * sizes[s] for s in capped)
            target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in order}
            over = {s for s in free if target[s] > 3 * sizes[s] + 1e-9}
            if not over:
                break
            capped |= over
        assert got == pytest.approx(target)
        assert sum(got.values()) == pytest.approx(left)


def test_rows_without_an_id_draw_by_their_texts(spark):
    from hirefold.llm.mixing import mix, mix_counts
    rows = [(None if i % 2 else 7, f"word{i} and more", "abc"[i % 3]) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["source"]: (r["target"], r["taken"]) for r in mix_counts(df).groupBy("source").agg(
        F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert sorted(t for t, _ in got.values()) == [450, 900, 1350]
    assert all(abs(taken - target) < 0.25 * target for target, taken in got.values())
    assert mix(df).count() * 3 == sum(taken for _, taken in got.values())


def test_mix_rows(docs):
    from hirefold.llm.mixing import mix, mix_counts
    got = rows_of(mix_counts(docs))
    assert len(got) == len(ROWS) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    named = clashing(docs)
    assert mix(named).columns == named.columns and mix(named).where("total <> 'x'").count() == 0  # mix_copy comes last there
    taken = mix(docs)
    assert taken.columns == [*docs.columns, "mix_copy"]
    assert taken.count() == sum(r["copies"] for r in got)
    assert sorted(map(str, rows_of(mix(docs)))) == sorted(map(str, rows_of(taken)))


def test_chat_round_trip(spark):
    from hirefold.llm import chat
    said = ["\\### Assistant: </turn> ok", "### User: \\", "", None, "]: </turn>\n### [x]: y", "\\\\</turn></turn>", "é\U0001f600"]
    roles = ["user", "assistant", "system", None, "to]: ol", "Assistant"]
    turns = [(c, t, roles[(c * 3 + t) % 6], said[(c + t) % 7]) for c in range(6) for t in range(7)] + [(None, None, "user", "x")] * 2
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    out = chat.format_chat(df)
    back = sorted((*chat.parse_block(r["block"]), str(r["conv_id"])) for r in rows_of(out))
    assert back == sorted((r or "", t or "", str(c)) for c, _, r, t in turns)
    joined = {(r["conv_id"], r["place"]): r["block"] for r in rows_of(out)}
    parts = {}
    for r in sorted(rows_of(chat.segments(out)), key=lambda r: r["segment"]):
        parts[(r["conv_id"], r["place"])] = parts.get((r["conv_id"], r["place"]), "") + r["text"]
    assert parts == joined
    assert {r["conv_id"]: r["n_turns"] for r in rows_of(chat.read_back(out))} == {**{c: 7 for c in range(6)}, None: 2}


def test_chat_turn_order(spark):
    from hirefold.llm import chat
    df = spark.createDataFrame([(1, 0, "system", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"),
                                (2, 0, "assistant", "a"), (3, 0, "user", "a"), (3, 1, "user", "b")],
                               "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["valid"] for r in rows_of(chat.read_back(chat.format_chat(df)))}
    assert got == {1: True, 2: False, 3: False}


def test_licenses(spark, docs):
    from hirefold.llm.licenses import LICENSES, scan_licenses
    mit = LICENSES["MIT"].replace("copyright holders", "Jane").replace("sublicense", "SUBLICENCE").upper()
    df = spark.createDataFrame([(1, mit), (2, mit + " more"), (3, "words\nReleased under the MIT Licence!\nwords"), (4, None)],
                               "doc_id long, text string")
    got = {r["doc_id"]: (r["license_id"], r["notices"], r["n_notice_lines"]) for r in rows_of(scan_licenses(df))}
    assert got == {1: ("MIT", "", 0), 2: (None, "", 0), 3: (None, "MIT", 1), 4: (None, "", 0)}
    assert scan_licenses(docs).count() == len(ROWS)


def test_licenses_of_real_files(spark):
    from hirefold.llm.licenses import LICENSES, scan_licenses
    body = LICENSES["MIT"].split("\n", 1)[1]
    bsd = LICENSES["BSD-3-Clause"].replace("the copyright holder nor", "Example, Inc. nor").replace("1. Re", "* Re")
    apache = """/*
 * Copyright 2020 Example
 *
 * Licensed under the Apache License, Version 2.0 (the "License"); you may not use
 * this file except in compliance with the License. You may obtain a copy
 * of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
int main();"""
    gpl = """# This program is free software; you can redistribute it and/or
# modify it under the terms of the GNU General Public License as
# published by the Free Software Foundation; either version 2 of the
# License, or (at your option) any later version.
#
import os"""
    rows = [("no title", body), ("title", "The MIT License (MIT)\n" + body), ("other title", "A Story\n" + body), ("bsd", bsd),
            ("bare bsd", bsd.replace("* Re", "Re").replace("2. Re", "Re").replace("3. Ne", "Ne")), ("apache", apache), ("gpl", gpl),
            ("apache line", 'x\n// Licensed under the Apache License, Version 2.0 (the "License");\ny'),
            ("changed", gpl.replace("either version 2", "either version 7"))]
    want = {"no title": ("MIT", "", 0), "title": ("MIT", "", 0), "other title": (None, "", 0),
            "bsd": (None, "", 0),  # only some numbers are gone
            "bare bsd": ("BSD-3-Clause", "", 0), "apache": (None, "Apache-2.0", 3), "gpl": (None, "GPL-2.0-or-later", 4),
            "apache line": (None, "Apache-2.0", 1), "changed": (None, "", 0)}
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"),
                       ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        path = f"/usr/share/common-licenses/{file}"
        if os.path.exists(path):
            text = open(path, encoding="utf-8").read()
            rows += [(name, text), (name + " changed", text.replace("the", "no", 1))]
            want |= {name: name, name + " changed": None}
    df = spark.createDataFrame(list(enumerate(t for _, t in rows)), "doc_id long, text string")
    got = {rows[r["doc_id"]][0]: (r["license_id"], r["notices"], r["n_notice_lines"]) for r in rows_of(scan_licenses(df))}
    assert {k: v if isinstance(want[k], tuple) else v[0] for k, v in got.items()} == want


def test_lines(spark, docs):
    from hirefold.llm.lines import GRAM, REACH, WINDOW, dedup_lines, line_hashes, winnow
    from hirefold.llm.words import gram_hashes
    rng = random.Random(9)
    block = [f"line {i} of the block" for i in range(8)]
    texts = [(100 + d, "\n".join([f"own {d}", *block[rng.randint(0, 3):rng.randint(4, 8)], "", f"end {d}"])) for d in range(12)]
    texts += [(200, "same\nsame\nsame\nsame"), (201, "a\nb"), (202, "a\n\n b ")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(dedup_lines(df))}
    first, picks, seqs = {}, [], {}
    for d, t in sorted(texts):
        lines, kept, h = line_hashes(t.encode())
        seqs[d] = h.tolist()
        g = gram_hashes(h, GRAM)
        for p in winnow(g, WINDOW).tolist():
            picks.append((int(g[p]), d, p))
            first.setdefault(int(g[p]), (d, p))
    gone = {d: set() for d, _ in texts}
    for g, d, p in picks:
        s, q = first[g]
        if (s, q) == (d, p):
            continue
        a = 0
        while a < REACH and min(p, q) - a - 1 >= 0 and seqs[d][p - a - 1] == seqs[s][q - a - 1]:
            a += 1
        b = GRAM
        while b < GRAM + REACH and p + b < len(seqs[d]) and q + b < len(seqs[s]) and seqs[d][p + b] == seqs[s][q + b]:
            b += 1
        gone[d] |= set(range(p - a, p + b))
    size, seen = GRAM + WINDOW - 1, set()
    for d in sorted(seqs):  # whatever repeats over a window's lines is gone whole
        for i in range(len(seqs[d]) - size + 1):
            w = tuple(seqs[d][i:i + size])
            if w in seen:
                gone[d] |= set(range(i, i + size))
            seen.add(w)
    assert {d: r["n_removed"] for d, r in got.items()} == {d: len(x) for d, x in gone.items()}
    assert got[202]["n_removed"] == 2 and "own 5" in got[105]["text"]
    assert dedup_lines(docs).count() == len(ROWS)


def test_lines_whose_grams_came_first_elsewhere(spark):
    from hirefold.llm.lines import dedup_lines
    run = [f"row {i}" for i in range(9)]
    texts = [(i, "\n".join([f"x{i}", *run[i:i + 2], f"y{i}"])) for i in range(8)]  # every gram of the run, alone
    texts += [(50, "\n".join(run)), (60, "\n".join(["new", *run, "own"]))]
    got = {r["doc_id"]: r for r in rows_of(dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")))}
    assert got[60]["text"] == "new\nown"
    assert all(got[i]["n_removed"] == 0 for i in range(8))


@pytest.mark.parametrize("where", ["rows", "sf0.001"])
def test_every_repeated_line_goes(spark, docs, tmp_path, where):
    from hirefold.llm.queries import op10_lines
    sf = "/root/testdata/sf0.001"
    if where == "rows":
        sf = str(tmp_path)
        more = [(20, "a1\nsame\nb1"), (21, "a2\n same \nb2\n\nb2"), (22, "same"), (23, None), (20, "other\nb1"),
                (20, "a1\nsame\nb1"), (None, "same\nlast"), (None, "last\nlast line")]
        docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).write.parquet(f"{sf}/documents.parquet")
    every = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    key = lambda r: (r[0] is None, r[0] or 0,
                     int.from_bytes(hashlib.blake2b(r[1], digest_size=8).digest(), "little", signed=True))
    seen, want = set(), {}
    for r in sorted(set(every), key=key):
        left = []
        for x in r[1].split(b"\n"):
            if not x.strip() or x.strip() not in seen:
                left.append(x)
            seen.add(x.strip())
        n = r[1].count(b"\n") + 1
        want[r] = (str(r[0]), n, n - len(left), hashlib.sha256(b"\n".join(left)).hexdigest())
    got = [(str(r["doc_id"]), r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in rows_of(op10_lines(spark, sf))]
    assert sorted(got) == sorted(want[r] for r in every) and sum(r[2] for r in got) > 3


def test_winnowing_guarantee():
    from hirefold.llm.lines import winnow
    g = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64)
    at = winnow(g, 3)
    assert np.diff(at).max() <= 3 and at[0] < 3 and at[-1] >= 197


def test_leaks(spark, docs):
    from hirefold.llm.decontaminate import drop_leaks, find_leaks
    rng = random.Random(12)
    voc = [a + b + c for a in "bdfgklmnprst" for b in ("ab", "eno", "iru", "oska", "umi") for c in "bdfgklmnprst"]
    say = lambda n: [rng.choice(voc) for _ in range(n)]
    items = [(i, say(30)) for i in range(20)]
    text = lambda w: " ".join(w[:20]) + ". " + " ".join(w[20:]) + "."
    bench = spark.createDataFrame([(i, text(w)) for i, w in items] + [(90, None), (91, "")], "item_id long, text string")
    rows = [(i, " ".join(say(40) + text(items[i][1]).upper().split() + say(60))) for i in range(10)]
    for i in range(10, 14):  # a paraphrase: some words of the question go or change, the answer stays
        w = [x for k, x in enumerate(items[i][1]) if k >= 20 or k % 3]
        rows.append((i, " ".join(say(33) + w + say(50))))
    rows += [(100 + i, " ".join(say(300))) for i in range(30)]
    got = {r["doc_id"]: r["item_ids"] for r in rows_of(find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench))}
    assert got == {i: [i] if i < 14 else [] for i, _ in rows}
    assert not any(r["contaminated"] for r in rows_of(find_leaks(docs, bench)))
    assert len(rows_of(find_leaks(docs, bench.limit(0)))) == len(ROWS)
    # Rows that share an id, or have none, are judged one by one.
    both = [(7, rows[0][1]), (7, rows[-1][1]), (None, rows[1][1]), (None, rows[-2][1]), (None, None)]
    df = clashing(spark.createDataFrame(both, "doc_id long, text string"))
    left = drop_leaks(df, bench)
    assert left.columns == df.columns
    assert sorted(str(r["text"]) for r in rows_of(left)) == sorted(str(t) for _, t in (both[1], both[3], both[4]))


def test_leaks_of_several_blocks(spark, monkeypatch):
    from hirefold.llm import decontaminate
    rng = random.Random(21)
    voc = [a + b + c for a in "bdfgklmnprst" for b in ("ab", "eno", "iru", "oska", "umi") for c in "bdfgklmnprst"]
    say = lambda n: [rng.choice(voc) for _ in range(n)]
    items = [(i, " ".join(say(20)) + ". " + " ".join(say(10)) + ".") for i in range(20)]
    held = lambda *ks: " ".join(say(40) + [x for k in ks for x in [items[k][1], *say(40)]])
    rows = [(7, held(0), [0]), (7, held(19), [19]), (7, held(), []), (None, held(3), [3]), (None, held(12, 4), [4, 12]),
            (None, held(), []), (None, None, []), (8, held(1, 17), [1, 17]), (9, held(), []), (9, "", [])]
    rows += [rows[0], rows[5], rows[5]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    blocks, one = [], decontaminate._one_block
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 6 * len(items[0][1]))
    monkeypatch.setattr(decontaminate, "_one_block", lambda *a, **k: (blocks.append(1), one(*a, **k))[1])
    got = sorted((str(r["doc_id"]), r["item_ids"], r["contaminated"]) for r in rows_of(decontaminate.find_leaks(df, bench)))
    assert len(blocks) > 2
    assert got == sorted((str(i), ids, bool(ids)) for i, _, ids in rows)


def test_common_subsequence():
    from hirefold.llm.decontaminate import common_subsequence
    rng = random.Random(5)
    for _ in range(50):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 25))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert common_subsequence(np.array(a, int), np.array(b, int)) == t[-1][-1]


@pytest.mark.parametrize("name,column", [("quality", "quality"), ("toxicity", "toxic")])
def test_classifiers(spark, docs, empty, name, column):
    from hirefold.llm import quality, toxicity
    rng = random.Random(8)
    fine, bad = ["sun", "tree", "river", "walk", "green"], ["grumf", "grumfo", "zzz!!"]
    rows, labels = [], []
    for i in range(300):
        y = i % 2
        w = [rng.choice(fine) for _ in range(30)]
        if (y == 0) == (name == "quality"):
            w[rng.randint(0, 29)] = rng.choice(bad)
            w[rng.randint(0, 29)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], f"doc_id long, {column} int")
    run = quality.classify_quality if name == "quality" else toxicity.classify_toxicity
    got = rows_of(run(df, lab))
    out = [r for r in got if r["held_out"]]
    assert len(got) == 300 and len(out) > 50
    truth = dict(labels)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.95
    assert run(docs, lab).where("score between 0 and 1").count() == len(ROWS)
    assert run(empty, lab.limit(0)).count() == 0
    if name == "toxicity":
        mixed = clashing(df.unionByName(df.where("doc_id < 8").withColumn("doc_id", F.lit(None).cast("long"))))
        left = toxicity.drop_toxic(mixed, lab)
        want = rows_of(run(mixed.select("doc_id", "text"), lab).where("predicted = 0"))
        assert left.columns == mixed.columns
        assert sorted(str(r["doc_id"]) for r in rows_of(left)) == sorted(str(r["doc_id"]) for r in want)
        assert left.where("doc_id is null").count() == 4  # even ids are clean


def test_empty_tables(empty):
    from hirefold.llm import exact, licenses, lines, mixing, simhash, substring
    for f in (exact.exact_duplicates, simhash.near_duplicates, lines.dedup_lines, licenses.scan_licenses,
              mixing.mix_counts, substring.dedup_substrings):
        assert f(empty).count() == 0


def test_empty_conversations_and_benchmarks(spark, empty):
    from hirefold.llm import chat, decontaminate
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chat(turns)).count() == 0
    items = spark.createDataFrame([(1, "Which river runs north through the old town? The Ammer does.")], "item_id long, text string")
    assert decontaminate.find_leaks(empty, items).count() == 0
    assert decontaminate.find_leaks(empty, items.limit(0)).count() == 0


def test_long_words_hash_fast_and_by_their_bytes():
    import time

    from hirefold.llm.words import LONG, span_hashes
    rng = np.random.default_rng(4)
    blob = rng.integers(33, 120, 4 << 20).astype(np.uint8)
    began = time.monotonic()
    span_hashes(blob, np.array([0]), np.array([len(blob)]))
    assert time.monotonic() - began < 1
    sizes = [1, 7, 8, 9, LONG - 1, LONG, LONG + 1, LONG + 7, LONG + 8, 3 * LONG + 5]
    words = [blob[:n].copy() for n in sizes]
    changed = [w.copy() for w in words]
    for w in changed:
        w[len(w) // 2] ^= 1
    swapped = np.concatenate([blob[8:16], blob[:8], blob[16:2 * LONG]])
    every = [*words, *changed, swapped, blob[:2 * LONG], *words]
    raw = np.concatenate(every)
    ends = np.cumsum([len(w) for w in every])
    h = span_hashes(raw, np.concatenate([[0], ends[:-1]]), ends).tolist()
    n = len(sizes)
    assert h[:n] == h[-n:] and len(set(h)) == len(every) - n


def test_lines_left_by_the_runs_go_one_by_one(spark):
    from hirefold.llm.lines import dedup_lines, repeated_runs
    run = [f"shared {i}" for i in range(30)]
    texts = [(1, "\n".join(run)), (2, "\n".join(["own", *run, "tail"])), (3, "tail\nx"), (4, "\n".join(["tail", *run[3:6]])),
             (5, None), (6, ""), (7, "\n\n"), (8, "w " * 50_000 + "\nx"), (8, "w " * 50_000 + "\nx")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    runs = {r["doc"]: (r["from"], r["to"]) for r in repeated_runs(df).groupBy("doc").agg(
        F.min("from").alias("from"), F.max("to").alias("to")).collect()}
    assert runs[2] == (1, 31)               # found by window minima, extended both ways
    got = sorted((r["doc_id"], r["n_removed"], r["text"][-5:]) for r in rows_of(dedup_lines(df, lone_lines=True)))
    assert got == [(1, 0, "ed 29"), (2, 30, "\ntail"), (3, 1, "x"), (4, 4, ""), (5, 0, ""), (6, 0, ""), (7, 0, "\n\n"),
                   (8, 1, " w w "), (8, 1, " w w ")]


@pytest.mark.parametrize("weak", [False, True])
def test_long_texts_hash_in_segments(spark, weak):
    from hirefold.llm.exact import SEGMENT, Hasher, drop_exact_duplicates, exact_duplicates
    hasher = Hasher((3, 5), (2, 2)) if weak else Hasher()
    base = "Abc d\u00e9f " * (SEGMENT // 4)
    other = base[:-40] + "x" + base[-39:]       # differs in the last segment only
    texts = [(1, base), (2, base.lower()), (3, other), (3, other), (None, base), (4, base + "!"), (5, base[:SEGMENT // 2]),
             (6, base[:SEGMENT // 2].lower()), (7, None)]
    data = base.encode().lower()
    at = [0, 10, SEGMENT, 2 * SEGMENT, len(data)]
    parts = [hasher.shifted(data[a:b], len(data) - b) for a, b in zip(at, at[1:])]
    one, two = (sum(p[i] for p in reversed(parts)) % hasher.primes[i - 1] for i in (1, 2))
    assert ((one << 31) | two, sum(p[0] for p in parts)) == hasher.text(data)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
                 for r in rows_of(exact_duplicates(df, hasher=hasher)))
    sha = lambda t: hashlib.sha256((t or "").encode().lower()).hexdigest()
    short = base[:SEGMENT // 2]
    assert got == sorted([
        ("1", 2, 3, False, sha(base)), ("2", 2, 3, True, sha(base)), ("None", 2, 3, False, sha(base)),
        ("3", 3, 2, True, sha(other)), ("3", 3, 2, False, sha(other)), ("4", 4, 1, True, sha(base + "!")),
        ("5", 6, 2, False, sha(short)), ("6", 6, 2, True, sha(short)), ("7", 7, 1, True, sha(None))])
    if not weak:
        assert sorted(r["doc_id"] for r in rows_of(drop_exact_duplicates(df))) == [2, 3, 4, 6, 7]

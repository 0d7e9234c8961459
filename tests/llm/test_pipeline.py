"""The pipeline against a brute-force version on a small fixture."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def test_pipeline_matches_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_operators import WORD, brute_simhash
    rng = random.Random(21)
    voc = [a + b + c for a in "bdfgklmnprst" for b in ("ab", "eno", "iru", "oska", "umi") for c in "bdfgklmnprst"]
    say = lambda n: [rng.choice(voc) for _ in range(n)]
    items = [" ".join(say(30)) + "." for _ in range(5)]
    rows, labels, fate = [], [], {}
    for i in range(200):  # clean and toxic, to learn from
        w = say(40)
        if i % 2:
            for k in rng.sample(range(40), 4):
                w[k] = rng.choice(["grumf", "grumfo"])
            fate[i] = "toxic"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, i % 2))
    for k in range(6):  # exact copies up to case, a near copy, an item
        rows.append((300 + k, rows[2 * k][1].upper()))
        rows.append((400 + k, " ".join([*say(20), items[k % 5], *say(20)])))
        fate[400 + k] = "leak"
        near = say(3000)
        rows += [(500 + 2 * k, " ".join(near)), (501 + 2 * k, " ".join(near) + " zz")]
    rows += [(600, ""), (601, None), (None, " ".join(say(30))), (None, " ".join(say(30)))]
    rows = [(i, t, "en", f"s{0 if i is None else i % 4}" if i != 7 else None, len(t or "")) for i, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [r for r in rows if fate.get(r[0]) != "toxic"]
    keep = {}
    for r in left:
        t = (r[1] or "").encode().lower()
        if t not in keep or (r[0] if r[0] is not None else -1) > (keep[t][0] if keep[t][0] is not None else -1):
            keep[t] = r
    left = sorted(keep.values(), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [brute_simhash(r[1]) for r in left]
    group = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    left = [r for k, r in enumerate(left) if group[k] == k and fate.get(r[0]) != "leak"]

    got = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    copies = {}
    for r in got:
        copies[(r["doc_id"], r["text"], r["source"])] = copies.get((r["doc_id"], r["text"], r["source"]), 0) + 1
    sizes = {}
    for r in left:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall((r[1] or "").encode()))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped = set()
    while True:  # share, stop at the limits, share the rest again
        free = [s for s in order if s not in capped]
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        capped |= over
    known = {(r[0], r[1], r[3]) for r in left}
    assert set(copies) <= known  # nothing that a stage rejects comes back
    for r in left:  # floor(rate) copies, or one more
        rate = min(3.0, target[r[3]] / sizes[r[3]]) if sizes[r[3]] else 0
        assert int(rate + 1e-9) <= copies.get((r[0], r[1], r[3]), 0) <= int(rate + 1e-9) + 1

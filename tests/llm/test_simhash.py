"""SimHash classes against all pairs."""

import random

import numpy as np
import xxhash

from seqembed.llm import simhash
from seqembed.llm.components import components
from seqembed.llm.queries import op8_simhash_trie

FOLDER = "/root/testdata/sf0.001"


def fingerprint(text, size=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
             .translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints, budget=4):
    """Label of each print: the smallest position that its links reach."""
    n = len(prints)
    label = list(range(n))
    values = np.array(prints, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= budget) for v in values]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min(label[j] for j in near[i])
            if low < label[i]:
                label[i], changed = low, True
    return label


def test_documents(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    prints = [fingerprint(text) for _, text in docs]
    label = brute(prints)
    got = sorted(map(tuple, op8_simhash_trie(spark, FOLDER).collect()))
    assert got == [(d, f"{p:016x}", docs[label[i]][0]) for i, ((d, _), p) in enumerate(zip(docs, prints))]


def close_prints(seed, centres, each, flips):
    draw = random.Random(seed)
    out = set()
    for _ in range(centres):
        centre = draw.getrandbits(64)
        for _ in range(each):
            value = centre
            for _ in range(draw.randint(0, flips)):
                value ^= 1 << draw.randrange(64)
            out.add(value)
    return sorted(out)


def check_groups(spark, values, budget, **options):
    label = brute(values, budget)
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "v long")
    found = components(simhash.links(frame.selectExpr("v", "v AS n"), ["v"], "n", budget, **options), "a", "b")
    at = {int(np.uint64(v).astype(np.int64)): i for i, v in enumerate(values)}
    got = {}
    for row in found.collect():
        got.setdefault(row.component, set()).add(at[row.node])
    want = {}
    for i, low in enumerate(label):
        want.setdefault(low, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_random_prints(spark):
    check_groups(spark, close_prints(1, 150, 8, 4), 4)
    check_groups(spark, close_prints(2, 60, 10, 3), 2)
    check_groups(spark, close_prints(4, 60, 6, 9), 9)


def test_sliced_units_and_small_frontier(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    check_groups(spark, close_prints(3, 4, 120, 5), 4, cell=20)


def test_budgets_rise_by_block():
    for budget in range(0, 12):
        for rotation in range(budget + 1):
            limits = simhash.allowed(budget, rotation)
            assert len(limits) == 64 and limits[0] == 0 and limits[-1] == budget


def test_edges(spark):
    rows = [(None, None), (5, None), (3, ""), (4, " \t"), (7, "One two"), (6, "one TWO"), (6, "one TWO"), (8, "x " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fingerprint", "2 AS _component")
    got = sorted(map(tuple, simhash.report(docs).collect()), key=str)
    want = sorted([(d, f"{fingerprint(t):016x}", {"": 3, "o": 6, "x": 8}[(t or "").strip().lower()[:1]]) for d, t in rows], key=str)
    assert got == want
    assert simhash.report(docs.limit(0)).collect() == []
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 8]


def test_wide_bits_and_equal_values(spark):
    draw = random.Random(8)
    rows = [(draw.randrange(4), draw.getrandbits(3), draw.getrandbits(2)) for _ in range(300)]
    rows = [(i, *r) for i, r in enumerate(sorted(set(rows)))]
    frame = spark.createDataFrame(rows, "n long, v long, w long, x long")
    found = components(simhash.links(frame, ["v", "w", "x"], "n", 1, 2, cell=40), "a", "b")
    label = {r[0]: r[0] for r in rows}
    for _ in rows:
        for a, *p in rows:
            for b, *q in rows:
                if min((x ^ y).bit_count() for x, y in zip(p, q)) <= 1 and sum((x ^ y).bit_count() for x, y in zip(p, q)) <= 2:
                    label[a] = label[b] = min(label[a], label[b])
        if len(set(label.values())) == 1:
            break
    assert {r.node: r.component for r in found.collect()} == label


def test_one_of_each_class_stays(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    docs = []
    for i in range(60):
        text = [word() for _ in range(draw.randint(50, 700))]
        docs.append((i * 10, " ".join(text)))
        for j in range(1, draw.randint(1, 6)):
            copy = list(text)
            for _ in range(draw.randint(0, 2)):
                copy[draw.randrange(len(copy))] = word()
            docs.append((i * 10 + j, " ".join(copy).upper()))
    docs += [(-1, docs[0][1]), (None, docs[5][1]), (None, "no other"), (None, "No  Other")]
    label = brute([fingerprint(text) for _, text in docs])
    classes = {}
    for (d, _), c in zip(docs, label):
        classes.setdefault(c, []).append(d)
    want = [min((d for d in c if d is not None), default=None) for c in classes.values()]
    assert len(want) < 0.7 * len(docs)
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, row int, Component int")
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)


def test_components(spark):
    draw = random.Random(9)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(draw.randrange(90), draw.randrange(90)) for _ in range(60)]
    pairs += [(200, i) for i in range(201, 240)] + [(1, 1), (None, 4), (-5, 300)]
    label = {n: n for p in pairs if None not in p for n in p}
    for _ in range(200):
        for a, b in pairs:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "l long, r long"), "l", "r").collect()}
    linked = {n for a, b in pairs if a is not None and a != b for n in (a, b)}
    assert got == {n: label[n] for n in linked}

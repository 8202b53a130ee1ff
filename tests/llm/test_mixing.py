"""Context mixing: the base score against plain counts, and that probabilities are probabilities."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqembed.llm import mixing
from seqembed.llm.queries import op2_context_mixing


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def base(docs):
    counts = Counter(w for d, t in docs if not held(d) for w in [*words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for d, t in docs:
        tokens = [*words(t), None]
        out.append((d, held(d), len(tokens), sum(counts[w] > 0 for w in tokens), total,
                    sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)))
    return out


def check(rows, docs):
    key = lambda r: (str(r[0]), r[2], r[5])
    want, rows = sorted(base(docs), key=key), sorted(map(tuple, rows), key=key)
    assert len(rows) == len(want)
    for row, line in zip(rows, want):
        assert row[:5] == line[:5] and row[5] == pytest.approx(line[5], rel=1e-9)
        assert row[6] < 0


@pytest.mark.parametrize("frequent", [mixing.FREQUENT, 50])
def test_documents(spark, monkeypatch, frequent):
    monkeypatch.setattr(mixing, "FREQUENT", frequent)
    folder = "/root/testdata/sf0.1" if frequent > 50 else "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows = op2_context_mixing(spark, folder).collect()
    check(rows, docs)
    if frequent > 50:
        size = {d: len(t.encode()) + 1 for d, t in docs}
        bits = sum(-r.score for r in rows if r.held_out) * math.log2(10) / sum(size[r.doc_id] for r in rows if r.held_out)
        assert bits < 2.5  # per byte; single words take more
        assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_odd_rows(spark):
    docs = [(None, None), (1, ""), (1, ""), (2, "a b a"), (3, "é\x1cé \n é"), (4, "x" * 40_000), (5, "word " * 9000), (6, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS score")
    rows = mixing.report(frame).collect()
    check(rows, docs)
    again = mixing.report(frame.repartition(5)).collect()
    assert sorted(rows, key=str) == sorted(again, key=str)
    assert mixing.report(frame.limit(0)).collect() == []
    alone = [(d, "a b") for d in range(200) if held(d)]
    check(mixing.report(spark.createDataFrame(alone, "doc_id long, text string")).collect(), alone)


def lowered(text):
    return text and re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.parametrize("frequent", [mixing.FREQUENT, 1])
def test_query_takes_words_in_lower_case(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(mixing, "FREQUENT", frequent)
    docs = [(d, t) for d, t in zip(range(20), ["The the THE", "É é É", None, "ZeBra\x0bzebra [AZ] {az}", "AZ az Zebra"] * 4)] + [(None, "THE end")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(op2_context_mixing(spark, str(tmp_path)).collect(), [(d, lowered(t)) for d, t in docs])


def test_bytes_sum_to_one():
    """All ways to go on after a start, with the end mark, have the probability of the start."""
    tree = mixing.Trees(np.arange(1 << 16) ** 2 % 977)
    draw = np.random.default_rng(1)
    model = mixing.Model(tree, draw.normal(size=mixing.OFFSETS[-1]).astype(np.float32),
                         np.zeros(mixing.OFFSETS[-1], np.uint8), draw.normal(size=(mixing.GATES, mixing.TABLES + 1)))
    score = lambda texts: np.exp(model.score(pa.array(texts, pa.binary())))
    ends = score([b""])[0]
    first = sum(np.exp(model.score(pa.array([bytes([b])], pa.binary()))[0]) for b in range(255))
    deeper = sum(score([bytes([65, b]) for b in range(255)]))
    assert 0 < ends + first < 1 and 0 < deeper < 1
    for last in (0, 65, 255):
        assert sum(2.0 ** -tree.lengths[last * 256:(last + 1) * 256]) == pytest.approx(1)


def slow_score(model, text):
    """One text, decision by decision, with the same steps of learning."""
    weights = model.weights.astype(np.float32).copy()
    prior = 1 / (1 + np.exp(-np.linspace(-8, 8, 33)))
    seen, happened, total = np.zeros(33), np.zeros(33), 0.0
    for wave, (data, lead, whole) in enumerate(mixing.parts_of(text)):
        found = mixing.Contexts([(data, lead, whole)])
        steps = {}
        for i, place in enumerate(found.place.tolist()):
            first = place // mixing.BLOCK
            step = first if wave or not place < mixing.BLOCK else sum(place >= s for s in (32, 64, 128, 256, 512, 1024, 2048)) - 100
            pair = int(found.pair[i])
            begin, size = int(model.trees.starts[pair]), int(model.trees.lengths[pair])
            for at in range(begin, begin + size):
                node = np.array([int(model.trees.nodes[at])], np.uint64) * mixing._NODE
                slots = [int(model.shape.slots(t, h[i:i + 1].copy(), node)[0]) for t, h in enumerate(found.hashes)]
                gate = int(mixing.gate_of(int(found.depth[i]), int(model.seen[slots[-2]]), int(model.seen[slots[-1]])))
                steps.setdefault(step, []).append((gate, [float(model.logits[s]) for s in slots] + [1.0], bool(model.trees.bits[at])))
        for step in sorted(steps):
            refined = (prior * 24 + happened) / (24 + seen)
            moves, many, marks = np.zeros(weights.shape), np.zeros(len(weights)), []
            for gate, x, y in steps[step]:
                logit = min(max(float(np.dot(weights[gate], x)), -12), 12)
                p = 1 / (1 + math.exp(-logit))
                cell = min(max(logit, -7.999), 7.999) * 2 + 16
                left, right = int(cell), cell - int(cell)
                final = (refined[left] + (refined[left + 1] - refined[left]) * right + p) / 2
                total += math.log(max(final if y else 1 - final, 1e-6))
                moves[gate] += (y - p) * np.array(x)
                many[gate] += 1
                marks.append((left + (right >= 0.5), y))
            weights += (mixing.RATE / np.sqrt(np.maximum(many, 1)))[:, None] * moves
            for mark, y in marks:
                seen[mark] += 1
                happened[mark] += y
    return total


def trained(texts):
    follows = np.zeros(1 << 16, np.int64)
    for text in texts:
        flat = np.frombuffer(b"\xff" + text + b"\xff", np.uint8).astype(np.int64)
        follows += np.bincount(flat[:-1] << 8 | flat[1:], minlength=1 << 16)
    trees, shape = mixing.Trees(follows), mixing.Shape()

    class Shared:
        value = trees

    batch = pa.record_batch([pa.array(texts, pa.binary())], names=["text"])
    zeros, ones = np.zeros(mixing.OFFSETS[-1], np.float32), np.zeros(mixing.OFFSETS[-1], np.float32)
    for row in mixing._Count(Shared, shape)(iter([batch])):
        at = slice(row.column(0)[0].as_py() * mixing.MERGE, (row.column(0)[0].as_py() + 1) * mixing.MERGE)
        zeros[at], ones[at] = mixing._unpacked(row.column(2)[0].as_py()), mixing._unpacked(row.column(3)[0].as_py())
    weights = mixing.first_weights(texts[:20], trees, zeros, ones, shape)
    return mixing.Model(trees, mixing._logit(zeros, ones), mixing.often(zeros + ones), weights, shape), zeros, ones


def prose(seed, n):
    draw = np.random.default_rng(seed)
    words = ["the", "river", "stone", "green", "of", "weiß", "and", "cloud", "paper", "light"]
    return [" ".join(draw.choice(words, int(draw.integers(1, 120)))).encode() for _ in range(n)]


def test_scores_against_a_plain_scorer(monkeypatch):
    model, _, _ = trained(prose(1, 60))
    texts = [b"", b"the river", *prose(2, 6), b"zzz \xc3\xa9 " * 20]
    assert model.score(pa.array(texts, pa.binary())) == pytest.approx([slow_score(model, t) for t in texts], rel=1e-4)
    monkeypatch.setattr(mixing, "SEGMENT", 100)  # in parts
    monkeypatch.setattr(mixing, "LEAD", 30)
    assert model.score(pa.array(texts, pa.binary())) == pytest.approx([slow_score(model, t) for t in texts], rel=1e-4)


def test_counts_against_plain_ones():
    texts = prose(3, 30)
    _, zeros, ones = trained(texts)
    model, _, _ = trained(texts)
    want = [np.zeros_like(zeros), np.zeros_like(ones)]
    for text in texts:
        decisions = mixing.Decisions([(text, 0, True)], model.trees, model.shape)
        for slots in decisions.slots:
            for outcome in (0, 1):
                np.add.at(want[outcome], slots[decisions.outcome == outcome], 1)
    assert (zeros == want[0]).all() and (ones == want[1]).all()


def test_parts_are_the_text_and_memory_does_not_follow_it():
    draw = np.random.default_rng(5)
    text = bytes(draw.choice(np.frombuffer(b"abcde  \n", np.uint8), 3_000_000))
    assert b"".join(data[lead:] for data, lead, _ in mixing.parts_of(text)) == text
    assert max(len(data) for data, _, _ in mixing.parts_of(text)) < mixing.SEGMENT + 2 * mixing.LEAD
    model, _, _ = trained(prose(1, 20))
    tracemalloc.start()
    assert model.score(pa.array([text], pa.binary()))[0] < 0
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def test_scores_gain_with_more_data():
    fresh = pa.array(prose(9, 40), pa.binary())
    few, many = (trained(prose(4, n))[0].score(fresh).sum() for n in (10, 400))
    assert many > few


def test_tables_grow_and_merge_in_levels(spark):
    assert [mixing.Shape.of(n).offsets[-1] // mixing.OFFSETS[-1] for n in (0, 10**8, 2**29, 2**30, 2**50)] == [1, 1, 2, 4, 4]
    rows = [(block, part, mixing._packed(np.full(mixing.MERGE, part % 3, np.int32)), mixing._packed(np.full(mixing.MERGE, 1, np.int32)))
            for block in range(2) for part in range(70)]
    frame = spark.createDataFrame(rows, "block int, part int, zeros binary, ones binary")
    got = mixing.merged(frame, 70, fan=4).collect()
    assert sorted(r.block for r in got) == [0, 1]
    for row in got:
        assert set(mixing._unpacked(row.zeros).tolist()) == {sum(part % 3 for part in range(70))}
        assert set(mixing._unpacked(row.ones).tolist()) == {70}


def test_first_weights_are_learned_from_all_texts(spark, monkeypatch):
    """Parts are summed to what all texts at once give, though there are more of them than any sample."""
    texts = prose(6, 400)
    learned, plain = [], mixing.moved
    monkeypatch.setattr(mixing, "moved", lambda sums: learned.append(plain(sums)) or learned[-1])
    docs = [(7 * d, text.decode()) for d, text in enumerate(texts)]
    training = [text.encode() for d, text in docs if not held(d)]
    assert len(mixing.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == 400
    _, zeros, ones = trained(training)
    follows = np.zeros(1 << 16, np.int64)
    for text in training:
        flat = np.frombuffer(b"\xff" + text + b"\xff", np.uint8).astype(np.int64)
        follows += np.bincount(flat[:-1] << 8 | flat[1:], minlength=1 << 16)
    want = plain(mixing.curves([(text, 0, True) for text in training], mixing.Trees(follows), zeros, ones, mixing.Shape()))
    assert len(training) > 300 and learned[0] == pytest.approx(want, abs=1e-3)


def test_scoring_holds_the_decisions_of_a_run_at_a_time():
    """Many short texts need little more than their contexts, not arrays of all their decisions."""
    model, _, _ = trained(prose(1, 20))
    texts = pa.array(prose(8, 1000), pa.binary())
    size = sum(len(t.as_py()) for t in texts)
    assert size > 250_000
    model.score(texts[:10])
    tracemalloc.start()
    model.score(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 * size


def test_logits_and_how_often_are_kept_exactly_in_one_number():
    draw = np.random.default_rng(2)
    zeros, ones = ((draw.integers(0, 2**31, 4000) >> draw.integers(0, 32, 4000)).astype(np.float32) for _ in range(2))
    zeros[:200], ones[100:300] = 0, 0
    logits, seen = mixing._logit(zeros, ones), mixing.often(zeros + ones)
    marked = mixing._marked(logits, seen)
    assert marked.nbytes == logits.nbytes and (mixing._unmarked(marked) == logits).all() and (mixing._marks(marked) == seen).all()
    out = mixing.left_out(zeros, ones).reshape(-1, 2)
    for outcome, (low, high) in enumerate([(np.maximum(zeros - 1, 0), ones), (zeros, np.maximum(ones - 1, 0))]):
        assert (mixing._unmarked(out[:, outcome].copy()) == mixing._logit(low, high)).all()
        assert (mixing._marks(out[:, outcome]) == mixing.often(zeros + ones - 1)).all()


def test_sums_of_the_fit_against_plain_ones():
    texts = prose(7, 12)
    model, zeros, ones = trained(texts)
    want = np.zeros((mixing.GATES, mixing.TABLES + 1, mixing.TABLES + 2))
    for text in texts:
        decisions = mixing.Decisions([(text, 0, True)], model.trees, model.shape)
        for i, y in enumerate(decisions.outcome.tolist()):
            at = [int(slots[i]) for slots in decisions.slots]
            low, high = ([np.float32(max(float(n[a]) - (y == one), 0)) for a in at] for n, one in ((zeros, False), (ones, True)))
            gate = mixing.gate_of(int(decisions.depth[i]), *(int(mixing.often(np.float32(zeros[a] + ones[a] - 1))) for a in at[-2:]))
            x = mixing._logit(np.array(low), np.array(high))
            p = 1 / (1 + np.exp(-np.clip((x[0] + x[1] + x[2] + x[3]) * np.float32(mixing.FIRST), -30, 30)))
            x = np.array([*(np.round(x * 64) / 64), 1], np.float64)
            want[gate, :, :-1] += np.outer(x, x) * float(np.round(p * (1 - p) * 1024) / 1024)
            want[gate, :, -1] += x * float(np.round((np.float32(y) - p) * 1024) / 1024)
    got = mixing.curves([(text, 0, True) for text in texts], model.trees, zeros, ones, model.shape)
    assert got == pytest.approx(want, rel=1e-6, abs=0.05)

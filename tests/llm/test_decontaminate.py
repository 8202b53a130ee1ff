"""Suffix automaton against windows found by brute force."""

import hashlib
import random
import re

from seqembed.llm import decontaminate
from seqembed.llm.queries import op3_suffix_automaton

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, size=10):
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)):
            if w:
                windows.setdefault(tuple(w[i:i + size]), set()).add("" if name is None else str(name))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        names = sorted(found)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def made(seed, letters, n_items, n_docs):
    draw = random.Random(seed)
    text = lambda n: " ".join(draw.choice(letters) for _ in range(n))
    items = [(i, text(draw.choice([0, 1, 2, 3, 5, 9, 10, 11, 14, 30]))) for i in range(n_items)]
    docs = [(i, text(draw.randint(0, 60)) + " " + draw.choice(items)[1].upper() + "; " + text(5)) for i in range(n_docs)]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(items, "item_id long, text string"))


def test_random_items(spark):
    for seed, letters in ((1, "ab"), (2, "abcdefgh"), (3, ["É", "x1", "don't", "Zeta"])):
        docs, items = made(seed, letters, 12, 40)
        assert rows(decontaminate.report(*frames(spark, docs, items))) == brute(docs, items)


def test_long_items_only(spark):
    draw = random.Random(5)
    items = [(i, " ".join(draw.choice("abc") for _ in range(40))) for i in range(8)]
    docs = [(i, items[i % 8][1][i:i + 50] + " - " + items[(i + 3) % 8][1]) for i in range(30)]
    assert rows(decontaminate.report(*frames(spark, docs, items))) == brute(docs, items)


def test_blocks_and_pieces(spark, monkeypatch):
    docs, items = made(7, "abcde", 30, 40)
    docs, items = frames(spark, docs, items)
    whole = rows(decontaminate.report(docs, items))
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    marked, _ = decontaminate.mark(docs, items, block_words=40)
    got = [(r.doc_id, r.n_words, sum(b - a for a, b in r.hits), len(r["items"])) for r in marked.collect()]
    assert sorted(got) == sorted(r[:4] for r in whole)


def test_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows(op3_suffix_automaton(spark, folder)) == brute(docs, items)


def test_nulls_empty_and_clashes(spark):
    docs = [(None, None), (1, ""), (1, ""), (2, "a b c"), (3, "a b c d e f g h i j k " * 3000)]
    items = [(None, "a b c d e f g h i j"), (1, None), (2, ""), (3, "x"), (3, "x")]
    frames_ = frames(spark, docs, items)
    assert rows(decontaminate.report(*frames_)) == brute(docs, items)
    none = frames(spark, [], [])
    assert rows(decontaminate.report(frames_[0], none[1])) == brute(docs, [])
    assert rows(decontaminate.report(none[0], frames_[1])) == []
    clash = spark.createDataFrame([(1, "a b", 7, "kept")], "doc_id long, text string, n_words int, HITS string")
    marked, names = decontaminate.mark(clash, frames_[1])
    assert marked.columns[:4] == clash.columns and names == ["_n_words" if n == "n_words" else n for n in ["n_words"]] + ["_hits", "items"]


def test_clean(spark):
    item = "One two three, four five six seven eight nine ten eleven"
    docs = [(1, f"Before it. {item.upper()}! " + "After it stands more text of its own, " * 5), (2, item + " end"),
            (3, "Nothing here"), (4, None)]
    got = dict(map(tuple, decontaminate.clean(*frames(spark, docs, [(1, item)])).collect()))
    assert got == {1: "Before it. ! " + "After it stands more text of its own, " * 5, 3: "Nothing here", 4: None}

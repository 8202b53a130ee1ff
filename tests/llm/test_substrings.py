"""Repeated windows against counts of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqembed.llm import substrings
from seqembed.llm.queries import op4_count_min_windows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(docs, size):
    split = [(d, words(t)) for d, t in docs]
    counts = Counter(tuple(w[i:i + size]) for _, w in split for i in range(len(w) - size + 1))
    out = []
    for doc, w in split:
        gone = {i + k for i in range(len(w) - size + 1) if counts[tuple(w[i:i + size])] > 1 for k in range(size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs, 35)
    assert rows(op4_count_min_windows(spark, folder)) == want
    assert any(0 < r[2] < r[1] for r in want)


def test_made_texts(spark, monkeypatch):
    draw = random.Random(3)
    for size, letters, cells in ((2, "abcdefgh", 1 << 16), (5, "ab", 1 << 17), (7, ["x", "é", " ", "y.", "\x1c"], 1 << 16)):
        monkeypatch.setattr(substrings, "MIN_CELLS", cells)
        passages = [" ".join(draw.choice(letters) for _ in range(20)) for _ in range(4)]
        docs = []
        for i in range(60):
            parts = [" ".join(draw.choice(letters) + str(draw.randrange(40)) for _ in range(draw.randint(0, 30))) for _ in range(2)]
            docs.append((i, f"{parts[0]}\n\t{draw.choice([*passages, ''])}  {parts[1]}"))
        docs += [(1, docs[1][1]), (None, None), (None, ""), (99, " \n"), (100, "z " * 5000), (101, "q" * 100_000)]
        frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS key").repartition(5)
        assert rows(substrings.report(frame, size)) == brute(docs, size)


def test_known_keys_are_told_once(spark, monkeypatch):
    monkeypatch.setattr(substrings, "KNOWN_KEYS", 3)
    line = " ".join(f"w{i}" for i in range(8))
    docs = [(i, f"{line} {i} a{i} b{i} c{i} {line}") for i in range(50)] + [(60, line), (61, "w1 w2 w3 w4 w5 w6 w7 w8")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert rows(substrings.report(frame, 6)) == brute(docs, 6)


def test_nothing(spark):
    assert substrings.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_word_hashes_tell_words_apart():
    texts = ["a b", "ab", "", None, " ba\x1cab ", "b a a"]
    w = substrings.Words(pa.array(texts, pa.string()))
    assert w.first.tolist() == [0, 2, 3, 3, 3, 4, 6]
    assert w.hashes[0] == w.hashes[5] and len(set(w.hashes.tolist())) == 5


def test_sketches_merge_in_levels(spark):
    """Of 5,000 partitions no task merges more than 256; cells of two partitions count, those of one do not."""
    rows = [(block, part, np.array([part // 2, 60_000], np.uint16).tobytes(), bytes([1, 1])) for block in range(2) for part in range(5000)]
    rows.append((1, 7, np.array([65_000], np.uint16).tobytes(), bytes([1])))
    frame = spark.createDataFrame(rows, "block int, part int, cells binary, counts binary").repartition(8)
    plan = substrings.merged(frame, 5000)
    partly = frame.withColumn("part", F.floor(F.col("part") / substrings.FAN)).groupBy("block", "part").count()
    assert partly.agg(F.max("count")).first()[0] <= 257
    bits = {r.block: np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in plan.collect()}
    assert set(bits) == {0, 1}
    for block in bits.values():
        assert set(np.flatnonzero(block)) == {*range(2500), 60_000}

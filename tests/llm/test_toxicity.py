"""Toxicity on held-out labels, and what it does with odd input."""

import random
import zlib

import pytest

from seqembed.llm import toxicity
from seqembed.llm.queries import op5_toxicity_trees

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_held_out(spark, tables):
    docs, labels = tables
    rows = {r.doc_id: r for r in op5_toxicity_trees(spark, FOLDER).collect()}
    assert len(rows) == docs.count()
    truth = [(rows[r.doc_id], r.toxic) for r in labels.collect()]
    for row in rows.values():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7)
    held = [(r.score, t) for r, t in truth if r.held_out]
    pairs = [(a > b) + (a == b) / 2 for a, x in held for b, y in held if x > y]
    assert sum(pairs) / len(pairs) > 0.95
    assert sum((s >= 0.7) == t for s, t in held) / len(held) > 0.95


def test_features():
    of = lambda text: dict(zip(toxicity.FEATURES, toxicity.Features(toxicity.WORDS, frozenset({"lowei"})).of(
        text, text.encode())))
    plain = of("you are an Idiot, loweient!")
    assert plain["word_count"] > 0 and plain["stem_count"] > 0 and plain["near_person"] > 0 and plain["closeness"] == 0.25
    for hidden in ("m0r0n", "mo.ron", "st*upid", "moooron", "a s t u p i d b".replace("a ", "").replace(" b", "")):
        assert of(f"such a text {hidden} here now")["hidden_count"] > 0, hidden
    assert of("LOUD!! words")["capitals"] == 0.5 and of("")["word_density"] == 0


def test_odd_rows(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame(
        [(None, None, 1), (1, None, 1), (2, "", 1), (2, "", 1), (3, "x" * 200_000, 1), (4, "stupid " * 40_000, 1)],
        "doc_id long, text string, score int")
    model = toxicity.fit(docs, labels)
    scored, name = model.score(odd)
    assert name == "_score" and scored.count() == 6
    kept = toxicity.reject(odd.withColumn("_score", odd.score), labels.limit(0))
    assert kept.columns == ["doc_id", "text", "score", "_score"] and kept.count() == 6  # no labels: 1/2 for all
    assert toxicity.report(odd.limit(0), labels.limit(0)).count() == 0
    assert toxicity.report(odd, labels.filter("toxic = 0")).filter("score > 0.6").count() == 0


def test_thinned_classes_keep_the_rate(spark):
    """A fit on few rows of each class gives scores at the rate of all labels, not of the thinned ones."""
    draw = random.Random(5)
    rows = []
    for i in range(1500):
        toxic = int(i % 8 == 0)
        words = [draw.choice(("river", "stone", "cloud", "house", "table", "paper")) for _ in range(30)]
        if draw.random() < (0.8 if toxic else 0.15):
            words.insert(draw.randrange(30), "idiot")
        rows.append((i, " ".join(words), toxic))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").coalesce(1).cache()
    model = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), 120)
    assert abs(model.prior - 1 / 8) < 0.03
    scored, name = model.score(frame)
    mean, sure = scored.selectExpr(f"avg({name})", f"count_if({name} >= 0.7)").first()
    assert abs(mean - 1 / 8) < 0.04
    assert sure == 0  # of the texts with the word less than half are toxic

"""The corpus pipeline, stage by stage, on documents whose fate is known."""

import random

import corpus_pipeline
from seqembed.llm import toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def made(spark, folder):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    insults = ["idiot", "moron", "scum", "worthless", "pathetic"]
    docs, toxic = {}, set()
    for i in range(240):
        words = prose(draw.randint(60, 300) if i != 2 else 900).split()
        if i % 8 == 0:
            toxic.add(i)
            for _ in range(5):
                words.insert(draw.randrange(len(words)), "you " + draw.choice(insults))
        docs[i] = " ".join(words)
    items = [prose(30) for _ in range(5)]
    changes = {}
    docs[1000] = docs[1]  # a copy
    docs[1001] = " ".join([*docs[2].split()[:-1], "end"])  # a near copy: one shingle differs
    docs[1002] = docs[3] + " "
    for i, n in ((1003, 100), (1004, 80)):
        before, after = prose(n), prose(n)
        docs[i] = f"{before} {items[0].upper()} {after}"
        changes[i] = f"{before}  {after}"
    docs[1005] = items[1] + " and so on"  # mostly benchmark
    docs[1006] = prose(90) + ' password = "Zq81mmKx77aB" ' + prose(20)
    changes[1006] = docs[1006].replace('password = "Zq81mmKx77aB', "[SECRET]")
    docs[1007], docs[1008], docs[1009] = None, "", "plain"
    labels = [(i, 1, int(i in toxic)) for i in range(240)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    gone = toxic | {1000, 1001, 1002, 1005, 1008}
    return {i: changes.get(i, t) for i, t in docs.items() if i not in gone}


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    want = made(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for i, (name, function) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = function(spark, docs, folder)
        assert docs.columns == columns, name
        docs.write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
    got = {r.doc_id: r.text for r in docs.collect()}
    assert got == want
    assert docs.filter("n_chars <> length(text)").count() == 0
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(want)
    assert all(r.decodes and r.n_tokens == len(r.ids) for r in rows)


def test_nothing(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
    assert toxicity.THRESHOLD == 0.7

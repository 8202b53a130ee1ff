"""SentencePiece encoding against the public library and by round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from seqembed.llm import sentencepieces
from seqembed.llm.queries import op11_sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_same_ids_as_the_library(spark, library, monkeypatch):
    draw = random.Random(5)
    letters = "abcdefghi thenationstr    EÉèñß0123456789.,!?'\n\t\r\x0b\x1c\x1f\x85 ▁漢字кириллица😀́\U000f0000<s>"
    texts = ["", " ", "  ", " " * 40, "a", "x" * 3000, "ab" * 700, "the " * 3000, "<s></s><unk><0x41>", "\x00\x01", None,
             "▁", "▁▁ ▁", "ends with space ", "\n\n\n", "é", "ñ" * 900]
    texts += ["".join(draw.choice(letters) for _ in range(draw.randint(1, 300))) for _ in range(400)]
    texts += ["".join(draw.choice("aeinrst ") for _ in range(draw.randint(500, 900))) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "clash", "too") for i, t in enumerate(texts)],
                                 "doc_id long, text string, ids string, Decoded string")
    model = sentencepieces.shared(spark, PATH)
    encoded, ids = sentencepieces.encode(docs, model)
    decoded, data = sentencepieces.decode(encoded, model, ids)
    assert decoded.columns == ["doc_id", "ids", "Decoded", "_ids", "_decoded"]
    rows = decoded.select("doc_id", "_ids", "_decoded").collect()
    assert len(rows) == len(texts)
    for row in rows:
        expected = library.encode(texts[row.doc_id] or "")
        assert row._ids == expected
        assert row._decoded == library.decode(expected)


def test_tables_and_runs_do_not_matter(library, monkeypatch):
    draw = random.Random(6)
    texts = ["".join(draw.choice("abc de\n1") for _ in range(draw.randint(0, 200))) for _ in range(60)]
    monkeypatch.setattr(sentencepieces, "TABLE_CHUNKS", 10)
    monkeypatch.setattr(sentencepieces, "SHORT", 3)
    monkeypatch.setattr(sentencepieces, "LONG_TEXT", 50)
    monkeypatch.setattr(sentencepieces, "RUN", 7)
    model = sentencepieces.PieceModel(PATH)
    table = sentencepieces.piece_table(model)
    for first in range(0, 60, 20):
        part = texts[first:first + 20]
        ids, sizes = table([model.marked(text) for text in part])
        cuts = np.split(ids, np.cumsum(sizes)[:-1])
        assert [cut.tolist() for cut in cuts] == [library.encode(text) for text in part]


def test_decodes_any_ids_as_the_library(library):
    draw = random.Random(7)
    model = sentencepieces.PieceModel(PATH)
    lists = [[draw.choice([1, 2, 0, 259, 260, 28705, draw.randrange(3, 259), draw.randrange(32000)])
              for _ in range(draw.randint(0, 12))] for _ in range(3000)]
    ids = np.array([i for ids in lists for i in ids], np.int32)
    ends = np.concatenate([[0], np.cumsum([len(ids) for ids in lists])])
    assert model.decode(ids, ends) == [library.decode(ids) for ids in lists]


def test_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op11_sentence_pieces(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id] or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_nothing_nulls_and_bad_ids(spark):
    model = sentencepieces.shared(spark, PATH)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sentencepieces.report(empty, model).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    none = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in sentencepieces.report(nulls, model).collect()] == [(None, 0, none, none)] * 2
    bad = spark.createDataFrame([([10**6],)], "ids array<int>")
    with pytest.raises(Exception, match="not in the model"):
        sentencepieces.decode(bad, model)[0].collect()

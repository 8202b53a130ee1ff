"""Byte-level BPE against the public library and by round trip."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from seqembed.llm import bpe
from seqembed.llm.queries import op7_byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library(spark, library):
    draw = random.Random(3)
    letters = "abcdefghi thenationstr  EÉèñß0123456789.,!?'\n\t\r\x0b\x1c\x1f\x85  漢字кириллица😀́"
    texts = ["", " ", "a", "x" * 2000, "ab" * 700, "the " * 3000, "'s 'll don't", "\x00\x01", "ñ" * 900, None]
    texts += ["".join(draw.choice(letters) for _ in range(draw.randint(1, 400))) for _ in range(300)]
    texts += ["".join(draw.choice("aeinrst") for _ in range(draw.randint(500, 900))) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    vocabulary = bpe.shared(spark, PATH, public_tokenizers.PATTERN)
    encoded, ids = bpe.encode(docs, vocabulary)
    decoded, data = bpe.decode(encoded, vocabulary, ids)
    assert decoded.columns == ["doc_id", "ids", "_ids", "decoded"]
    rows = decoded.select("doc_id", F.col("_ids").alias("ids"), "decoded").collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        assert row.ids == library.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()


def test_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    import hashlib
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op7_byte_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_nothing_and_nulls(spark):
    vocabulary = bpe.shared(spark, PATH, public_tokenizers.PATTERN)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.report(empty, vocabulary).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    rows = bpe.report(nulls, vocabulary).collect()
    assert [r.n_tokens for r in rows] == [0, 0]


def test_unknown_id_raises(spark):
    vocabulary = bpe.shared(spark, PATH, public_tokenizers.PATTERN)
    bad = spark.createDataFrame([([10**9],)], "ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(bad, vocabulary)[0].collect()

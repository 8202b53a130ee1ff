"""Alignment against the public libraries and a plain version."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from seqembed.llm import alignment
from seqembed.llm.queries import op13_merge_path_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers(spark):
    return alignment.shared(spark, A, public_tokenizers.PATTERN, B)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_groups(text, libraries):
    """[(A ids, B ids)] of the groups of one text, by the libraries."""
    a, b = libraries
    letters = alignment.byte_letters()
    if not text:
        return []
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
               for i in b_ids]
    data = (" " + text).encode()
    if b"".join(a_bytes) != data or b"".join(b_bytes) != data:
        return []
    a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    cuts = sorted(set(a_ends) & set(b_ends))
    groups, i, j = [], 0, 0
    for cut in cuts:
        i2, j2 = a_ends.index(cut, i) + 1, b_ends.index(cut, j) + 1
        groups.append((a_ids[i:i2], b_ids[j:j2]))
        i, j = i2, j2
    return groups


def plain(texts, libraries):
    groups = [plain_groups(text, libraries) for text in texts]
    links = [Counter((a, b) for left, right in one for a in left for b in right) for one in groups]
    docs = Counter(pair for one in links for pair in one)
    highest = {}
    for (a, _), n in docs.items():
        highest[a] = max(highest.get(a, 0), n)
    rows = []
    for one, found in zip(groups, links):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in one)
        rows.append((sum(len(a) for a, _ in one), sum(len(b) for _, b in one), len(one), sum(found.values()),
                     sum(n for pair, n in found.items() if docs[pair] == highest[pair[0]]),
                     sum(n * docs[pair] for pair, n in found.items()),
                     hashlib.sha256(written.encode()).hexdigest() if one else ""))
    return rows


def made_texts():
    draw = random.Random(9)
    letters = "abcdefghi thenationstr    EÉèñß0123456789.,!?'\n\t\r\x0b\x1c\x1f\x85 漢字кириллица😀́"
    texts = ["", None, " ", "  ", " " * 700, "a", "x" * 900, "ab" * 500, "the " * 2000, "<|endoftext|> <s>", "\x00", "a▁b", "▁",
             "same text twice", "same text twice"]
    texts += ["".join(draw.choice(letters) for _ in range(draw.randint(1, 300))) for _ in range(150)]
    return texts + ["".join(draw.choice("aeinrst ") for _ in range(draw.randint(200, 900))) for _ in range(20)]


def test_groups_and_counts(spark, tokenizers, libraries, monkeypatch):
    texts = made_texts()
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(texts)],
                                 "doc_id long, text string, block int, ID string, pairs int").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in alignment.report(docs, tokenizers).collect()}
    assert got == dict(enumerate(plain(texts, libraries)))
    for row in alignment.align(docs, tokenizers).collect():
        a, b = {}, {}
        for ids, groups, into in ((row.a_ids, row.a_groups, a), (row.b_ids, row.b_groups, b)):
            for i, g in zip(ids, groups):
                into.setdefault(g, []).append(i)
        assert [(a[g], b[g]) for g in sorted(a)] == plain_groups(texts[row.id], libraries)


@pytest.mark.parametrize("work", [1, 2, 3, 7, 256])
def test_merge_paths(work):
    draw = np.random.default_rng(work)
    for _ in range(200):
        a, b = (np.unique(draw.integers(1, 40, draw.integers(1, 30))) for _ in range(2))
        end = max(a[-1], b[-1]) + 1
        a, b = np.append(a, end), np.append(b, end)
        common = np.intersect1d(a, b)
        in_a, in_b = alignment.common_groups(a, b, work)
        assert in_a.tolist() == np.searchsorted(common, a).tolist()
        assert in_b.tolist() == np.searchsorted(common, b).tolist()
        merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        at = np.arange(0, len(merged) + 1)
        assert alignment.diagonals(a, b, at).tolist() == [sum(s == 0 for _, s in merged[:d]) for d in at]
    none = np.empty(0, np.int64)
    assert [len(x) for x in alignment.common_groups(none, none)] == [0, 0]


def test_runs_do_not_matter(tokenizers, libraries, monkeypatch):
    texts = [t or "" for t in made_texts()]
    both = tokenizers.value
    whole = alignment.Aligned(both, both.tables(), texts).links(32000)
    monkeypatch.setattr(alignment, "RUN_LINKS", 5)
    cut = alignment.Aligned(both, both.tables(), texts).links(32000)
    assert all((x == y).all() for x, y in zip(whole, cut))


def test_documents(spark, libraries):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    expected = dict(zip((r.doc_id for r in rows), plain([r.text for r in rows], libraries)))
    assert {r[0]: tuple(r)[1:] for r in op13_merge_path_alignment(spark, folder).collect()} == expected


def test_nothing_and_nulls(spark, tokenizers):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.report(empty, tokenizers).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert [tuple(r) for r in alignment.report(nulls, tokenizers).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")] * 2

"""Secret spans against the patterns applied plainly, and guess costs against known orders."""

import functools
import hashlib
import itertools
import math
import random
import re

import public_tokenizers
import pytest

from seqembed.llm import secrets
from seqembed.llm.queries import op9_secret_guess_cost

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def base(text):
    """Spans by kind with plain searches from every position."""
    spans = []
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""")
    for kind, pattern, ok in (("assign", assign, lambda m: len(m[2]) >= 12),
                              ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
                              ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)):
        at = 0
        while at < len(text):
            if m := pattern.match(text, at):
                if ok(m):
                    spans.append((m.start(), ("assign", "access", "hex").index(kind), m.end(), kind))
                at = m.end()
            else:
                at += 1
    return sorted(spans)


def expect(text):
    spans = base(text or "")
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
    return [sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")], hashlib.sha256(joined.encode()).hexdigest(), joined


@pytest.fixture(scope="module")
def words(spark):
    return secrets.shared(spark, PATH)


def same(rows, texts):
    for row in rows:
        counts, digest, joined = expect(texts[row.doc_id])
        assert [row.n_assign, row.n_access, row.n_hex] == counts and row.base_sha256 == digest
        assert ",".join(s for s in row.spans.split(",") if s and not s.startswith("guess")) == joined


def test_documents(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op9_secret_guess_cost(spark, folder).collect()
    assert len(rows) == len(texts) and any(r.n_hex for r in rows)
    same(rows, texts)


def test_made_texts(spark, words):
    draw = random.Random(4)
    parts = ["password", "PassWD", "ſecret", "toKen", "toKen", "api_key", "APIKEY", ":", "=", " ", "  ", '"', "'", "AKIA", "ABCDEF0123456789",
             "0123456789abcdef", "é", "😀", "deadbeef", "x/y+z_.=-", "\n", "Zq9!mmK#x"]
    texts = {i: "".join(draw.choice(parts) for _ in range(draw.randint(1, 40))) for i in range(400)}
    texts |= {900: None, 901: "", 902: "password=" + "Zx9!" * 3000, 903: "secret " * 20000, 904: "token" + " " * 50000 + "= a"}
    rows = [*texts.items(), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans")
    result = secrets.report(docs, words).collect()
    assert len(result) == len(rows)
    same(result, texts)
    assert secrets.report(docs.limit(0), words).collect() == []


def test_added_and_redacted(spark, words):
    text = "é the password is Zq9!mmK#x, and pwd: correct; login: q8Rt!x2Lp0. Api key is bald, token=0123456789abcdef0"
    docs = spark.createDataFrame([(1, text, 2), (2, "the secret is theanding of it", 3), (None, None, 4)],
                                 "doc_id long, text string, spans int")
    rows = {r.doc_id: r for r in secrets.report(docs, words).collect()}
    found = [tuple(s.split(":")) for s in rows[1].spans.split(",")]
    assert [(k, text[int(a):int(b)]) for k, a, b in found] == [
        ("guess", "Zq9!mmK#x"), ("guess", "q8Rt!x2Lp0"), ("assign", "token=0123456789abcdef0"), ("hex", "0123456789abcdef0")]
    both = spark.createDataFrame([(1, 'api_key="Zq9mmKx44TTw" x'), (2, "token = passwordpassword")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.report(both, words).collect()}
    assert spans == {1: "assign:0:21,guess:9:21", 2: "assign:0:24"}  # a value in a base span is judged as well
    assert rows[1].n_guess == 2 and rows[2].spans == "" and rows[None].spans == ""
    clean = {r.doc_id: r.text for r in secrets.redact(docs, words).collect()}
    assert clean == {1: "é the password is [SECRET], and pwd: correct; login: [SECRET]. Api key is bald, [SECRET]",
                     2: "the secret is theanding of it", None: None}


def test_costs():
    guesser = secrets.Guesser(secrets.word_ranks(PATH))
    weak = ["password", "Password1", "qwertyuiop", "aaaaaaaa", "19840512", "abcdefgh", "abcabcabc", "12/05/1984", "p4ssw0rd"]
    assert all(guesser.cost(v) < 6 for v in weak)
    assert all(guesser.cost(v) > 10 for v in ("x9$Kq2!vL", "b7db7aa4a5fcc78305", "Vk#2pQz!w8"))
    assert guesser.cost("ß" * 3) < 5 and guesser.cost("İx9$Kq2!vL") > 10 and guesser.cost("") == 0


def plain_cost(guesser, value):
    """The least over all segmentations, each segment priced on its own by every way that fits it."""
    low = value.lower()
    plain = low.translate(str.maketrans("013457@$!", "oieastasi"))
    date = re.compile(r"(19|20)\d\d|(0[1-9]|[12]\d|3[01])(0[1-9]|1[0-2])(\d\d|(19|20)\d\d)?|(19|20)\d\d(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])"
                      r"|\d{1,2}[-/.]\d{1,2}[-/.](\d\d|\d{4})|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}")
    alphabet = lambda c: 10 if c.isdigit() else 26 if c.isalpha() else 33

    @functools.cache
    def least(end):
        return min((total for total, _ in ways_to(end)), default=0.0) if end else 0.0

    @functools.cache
    def ways_to(end):
        """(cost, whether the last segment is a tried character) of the best of either kind."""
        if not end:
            return ((0.0, False),)
        one = min(t + math.log10(alphabet(value[end - 1])) + (0.3 if end > 1 and not was else 0) for t, was in ways_to(end - 1))
        known = min((least(b) + c + (0.3 if b else 0) for b in range(end) for c in prices(b, end)), default=math.inf)
        return ((one, True), (known, False))

    def prices(b, e):
        part, size = low[b:e], e - b
        if 3 <= size <= 20:
            if part in guesser.words:
                yield math.log10(guesser.words[part] + 1) + (0.3 if part != value[b:e] else 0)
            elif plain[b:e] != part and plain[b:e] in guesser.words:
                yield math.log10(guesser.words[plain[b:e]] + 1) + 0.6
        if size in (4, 6, 8, 10) and part[-1].isdigit() and date.fullmatch(part):
            yield {4: math.log10(366), 6: math.log10(36600), 8: math.log10(366 * 120), 10: math.log10(366 * 480)}[size]
        steps = [secrets.NEXT_KEY.get(x, {}).get(y) for x, y in zip(part, part[1:])]
        if size >= 3 and len(set(part)) == 1:
            yield math.log10(alphabet(value[e - 1]) * size)
        if size >= 4 and None not in steps:
            yield math.log10(47 * size) + len(list(itertools.groupby(steps))) * math.log10(4.6)
        rises = {ord(y) - ord(x) for x, y in zip(part, part[1:])}
        if size >= 3 and (rises == {1} or rises == {-1}) and part[1:].isalnum():
            yield math.log10(10 * size)
        for period in range(2, 9):
            if size >= 2 * period and all(part[i] == part[i - period] for i in range(period, size)):
                yield max(least(b + period) - least(b), 1.0) + math.log10(size / period)

    return least(len(value))


def test_cheapest_segmentation():
    """Against all segmentations into words, dates, repeats, walks, sequences and tried characters."""
    guesser = secrets.Guesser({"abe": 9, "bed": 40, "edge": 3, "gem": 700, "password": 1, "wert": 50})
    values = ["".join(letters) for letters in itertools.product("abedgm", repeat=5)]
    draw = random.Random(8)
    parts = ["password", "P4ssword", "edge", "Edge", "qwerty", "asdf", "zaq1", "1984", "05121984", "12/05/84", "aaaa", "1111", "abcd",
             "4321", "xyxy", "k9k9k9", "Z", "q", "7", "!", "#", "wert", "gem"]
    values += ["".join(draw.choice(parts) for _ in range(draw.randint(1, 5))) for _ in range(600)]
    values += ["".join(draw.choice("qwe12aA!") for _ in range(draw.randint(1, 14))) for _ in range(600)]
    for value in values:
        assert guesser.cost(value) == pytest.approx(plain_cost(guesser, value), abs=1e-9), value


def test_values_of_documents_are_judged(spark, words):
    """On the given tables the method adds spans, and every value in a credential context has its plain cost."""
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op9_secret_guess_cost(spark, folder).collect()}
    guesser, found = secrets.Guesser(words.value), 0
    for doc in spark.read.parquet(f"{folder}/documents.parquet").collect():
        spans = [tuple(s.split(":")) for s in rows[doc.doc_id].spans.split(",") if s.startswith("guess")]
        assert all(plain_cost(guesser, doc.text[int(a):int(b)]) >= secrets.MIN_GUESSES for _, a, b in spans if int(b) - int(a) <= 40)
        found += len(spans)
    assert found > 0

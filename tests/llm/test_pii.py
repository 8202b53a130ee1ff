"""Personal data against the patterns applied plainly, and disclosure on a small corpus."""

import hashlib
import math
import random
import re
from collections import Counter

from seqembed.llm import pii
from seqembed.llm.queries import op10_disclosure_pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in value.split("."))
            or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15)


def base(text):
    return [(kind, m.start(), m.end()) for kind, pattern in PLAIN.items() for m in pattern.finditer(text or "") if passes(kind, m[0])]


def same(rows, texts):
    for row in rows:
        spans = base(texts[row.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in spans) for k in PLAIN], row
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert ",".join(s for s in row.spans.split(",") if s and not s.startswith("term")) == joined


def test_documents(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op10_disclosure_pii(spark, folder).collect()
    assert len(rows) == len(texts) and any(r.n_email for r in rows)
    same(rows, texts)


def test_made_texts(spark):
    draw = random.Random(2)
    parts = ["a@b.c", "x_y%z@host-1.example.org", "@", ".", "-", " ", "é", "😀", "10.0.0.1", "256.1.1.1", "0010.2.3.4", "4111 1111 1111 1111",
             "4111-1111-1111-1112", "5500005555555559", "+49 (30) 123-4567", "+1", "12", "0", "\n", "_", "k@", "..", "+44 20 7946 0958"]
    texts = {i: "".join(draw.choice(parts) for _ in range(draw.randint(1, 14))) for i in range(500)}
    texts |= {900: None, 901: "", 902: "1 " * 30_000, 903: "a" * 100_000 + "@", 904: "a@b" + ".c" * 30_000, 905: "me@x.org 10.0.0.1 " * 3000,
              906: "9" * 100_000, 907: "+1" + " " * 50_000}
    rows = [*texts.items(), (901, ""), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS base")
    result = pii.report(docs).collect()
    assert len(result) == len(rows)
    same(result, texts)
    assert pii.report(docs.limit(0)).collect() == []


def entities(text):
    out = set()
    for kind, a, b in base(text):
        value = text[a:b].lower()
        digits = re.sub("[^0-9]", "", value)
        out |= {"email": {f"email:{value}", f"domain:{value.partition('@')[2]}"}, "ip": {f"ip:{value}", f"network:{value.rpartition('.')[0]}"},
                "card": {f"card:{digits}", f"issuer:{digits[:6]}"}, "phone": {f"phone:{digits}", f"numbers:{digits[:5]}"}}[kind]
    return out


def terms(text):
    """(start, end, word) of the whole words of four letters and more that touch no mail."""
    mails = [(m.start(), m.end()) for m in PLAIN["email"].finditer(text)]
    return [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{4,}", text)
            if not any(a <= m.end() and m.start() <= b for a, b in mails)]


def plain_terms(texts):
    """Added spans of each text, from all pairs."""
    different = set(texts)
    n = len(different) - 1
    has_e, has_t, has_both = Counter(), Counter(), Counter()
    for text in different:
        es, ts = entities(text), {w for _, _, w in terms(text)}
        has_e.update(es)
        has_t.update(ts)
        has_both.update((e, t) for e in es for t in ts)
    share = {}
    for (e, t), both in has_both.items():
        if both > 1 and has_e[e] - 1 < n:
            value = math.log(n * (both - 1) / ((has_e[e] - 1) * (has_t[t] - 1))) / math.log(n / (has_e[e] - 1))
            if value >= pii.GENERALISE:
                share[e, t] = min(value, 1.0)
    return [[(a, b, max(share[e, w] for e in entities(text) if (e, w) in share)) for a, b, w in terms(text)
             if any((e, w) in share for e in entities(text))] for text in texts]


def test_terms_against_all_pairs(spark):
    draw = random.Random(3)
    common = ["green", "river", "stone", "cloud", "house", "straße", "été", "Wort", "the", "of", "漢字漢字", "ÀÉÎÕ"]
    rare = [f"rare{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(10)]
    values = ["zk@example.org", "b.c@example.org", "x@other.net", "10.0.0.1", "10.0.0.7", "192.168.1.9", "4111 1111 1111 1111",
              "+49 30 1234567", "+49 30 1999999", "ärger@mail.de", "grünwald@mail.de"]
    texts = []
    for i in range(300):
        topic = draw.randrange(11)
        words = [draw.choice(common) for _ in range(draw.randint(0, 25))] + [draw.choice(rare) for _ in range(draw.randint(0, 2))]
        if draw.random() < 0.4:
            words += [values[topic], rare[topic * 3].title(), values[draw.randrange(11)]]
        draw.shuffle(words)
        texts.append(draw.choice([" ", "  ", ", "]).join(words))
    texts += [texts[5]] * 7 + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS doc", "3 AS named")
    scanned, name = pii.scan(docs)
    want = plain_terms([t or "" for t in texts])
    assert sum(map(len, want)) > 50
    for row in scanned.collect():
        got = [(s["start"], s["end"], round(s["share"], 9)) for s in row[name] if s["kind"] == "term"]
        assert got == [(a, b, round(v, 9)) for a, b, v in want[row.doc_id]], texts[row.doc_id]


def test_terms_are_found_on_the_given_tables(spark):
    rows = op10_disclosure_pii(spark, "/root/testdata/sf0.1").collect()  # a smaller table has too few entities
    assert sum(r.n_term for r in rows) > 0


def test_disclosure(spark):
    fill = ["green", "river", "stone", "cloud", "house", "table", "water", "light", "sound", "paper"]
    draw = random.Random(1)
    prose = lambda n: " ".join(draw.choice(fill) for _ in range(n))
    docs = [(i, prose(30)) for i in range(200)]
    docs += [(300 + i, f"Zoltan {prose(80)} write to him at zk@example.org {prose(20)}") for i in range(2)]  # rare, far apart
    copy = f"{prose(20)} Quibbler says one@elsewhere.org {prose(20)}"
    docs += [(400 + i, copy) for i in range(6)]  # copies are one document
    docs += [(500 + i, f"{prose(20)} Vandermeer or u{i}@family.org {prose(9)}") for i in range(3)]  # one domain, different mails
    docs += [(600 + i, f"{prose(10)} Vandermeerish {prose(9)}") for i in range(3)]  # another word
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS spans")
    rows = {r.doc_id: r for r in pii.report(frame).collect()}
    texts = dict(docs)
    found = lambda i: [texts[i][int(a):int(b)] for k, a, b in (s.split(":") for s in rows[i].spans.split(",") if s) if k == "term"]
    assert all("Zoltan" in found(300 + i) and not set(found(300 + i)) & set(fill) for i in range(2))
    assert all(found(400 + i) == [] for i in range(6)) and not any(rows[i].spans for i in [*range(200), 600, 601, 602])
    assert all(found(500 + i) == ["Vandermeer"] for i in range(3))
    clean = pii.sanitise(frame)
    assert clean.columns == frame.columns
    clean = {r.doc_id: r.text for r in clean.collect()}
    assert len(clean) == len(docs) and all(clean[i] == texts[i] for i in range(200))
    assert all("Zoltan" not in clean[300 + i] and "[EMAIL]" in clean[300 + i] for i in range(2))
    assert clean[400] == copy.replace("one@elsewhere.org", "[EMAIL]")

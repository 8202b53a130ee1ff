"""Personal data by patterns, and what gives it away by corpus co-occurrence. Column expressions only.

Base spans are the leftmost, non-overlapping matches of four patterns, less those that fail a check. The patterns
are written so that Java matches the same text in time and stack that do not grow faster than the text: runs are
possessive, and a run that failed from its start is not tried again from within.

Sanitising: a base span names a protected entity, its kind and value, and coarser ones: the domain of a mail, the
network of an address, the issuer of a card, the first digits of a number. Terms are whole words of four letters and
more, anywhere in a text but in mails. Documents that are equal count once. Over the corpus, a term t reveals an
entity e to a reader of a document that has both by what the other documents show:

    log((n - 1) (n(e, t) - 1) / ((n(e) - 1) (n(t) - 1))) / log((n - 1) / (n(e) - 1))

where n counts documents, n(e), n(t) and n(e, t) those that have the entity, the term, or both: pointwise mutual
information over the entity's own information, with the document itself left out. A term that only one document
with the entity has is no evidence. From `GENERALISE` on, the term becomes a mark in all documents that have the
entity, from `REMOVE` on it is removed there; of several entities the one that it reveals most counts.

Which words can reach `GENERALISE` follows from n(e) and n(t) alone; others are left out before pairs are counted,
and so are entities and words of a single document. A document makes the pairs of its entities and of its words
that are left, so one with very many of both makes their product.

Missing and empty texts have no spans. Repeated rows are handled each on its own. Terms of an entity that every
document has reveal nothing. Very long texts are handled whole, in time that grows with their length and the square
root of their matches. Offsets are code points, ends exclusive. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.lookup import lookup_join
from .common import fresh, sha256_hex, stage

KINDS = ("email", "ip", "card", "phone")
GENERALISE = 0.6
REMOVE = 0.9
_BLOCK = 256

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What a text must contain for a pattern to match at all.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HOLE = "\u0000"  # in place of a mail's characters; what touches it is no whole word
_TERM = rf"(?<![\p{{L}}{_HOLE}])\p{{L}}{{4,}}+(?!{_HOLE})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0)))


def positions(text: Column, pattern: str) -> Column:
    """Matches of `pattern` as an array of (start, value).

    Starts are sums of the lengths of gaps and matches, over blocks first, so many matches do not cost their square.
    """
    expression = F.lit(pattern)
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, expression, F.lit(0)),
                       lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))

    def placed(rows: Column) -> Column:
        lengths = F.transform(rows, lambda r: r["gap"] + F.length(r["value"]))
        return let(lengths, lambda sizes: let(
            F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")),
                        lambda k: _sum(F.slice(sizes, k * _BLOCK + 1, _BLOCK))),
            lambda sums: let(
                F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda k: _sum(F.slice(sums, F.lit(1), k))),
                lambda before: F.transform(rows, lambda r, i: F.struct(
                    (before[F.floor(i / _BLOCK).cast("int")]
                     + _sum(F.slice(sizes, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)) + r["gap"]).alias("start"),
                    r["value"].alias("value"))))))

    return F.filter(let(parts, placed), lambda r: r["value"].isNotNull())


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, -1 - i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return let(F.translate(value, " -", ""), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(F.translate(value, " ().-+", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Base spans of a text as an array of (kind, start, end, value), by kind, then start."""
    return F.concat(*[_spans_of(text, kind) for kind in KINDS])


def _spans_of(text: Column, kind: str) -> Column:
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    good = F.filter(positions(text, PATTERNS[kind]), lambda r: _passes(kind, r["value"]))
    spans = F.transform(good, lambda r: F.struct(
        F.lit(kind).alias("kind"), r["start"].alias("start"), (r["start"] + F.length(r["value"])).alias("end"), r["value"].alias("value")))
    if kind not in _NEEDS:
        return spans
    return F.when(F.contains(text, F.lit(_NEEDS[kind])), spans).otherwise(none)


def without_mails(text: Column) -> Column:
    """`text` with the characters of mails blotted out, of the same length."""
    parts = F.zip_with(F.split(text, PATTERNS["email"], -1), F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0)),
                       lambda gap, mail: F.concat(gap, F.repeat(F.lit(_HOLE), F.coalesce(F.length(mail), F.lit(0)))))
    return F.when(F.contains(text, F.lit("@")), F.array_join(parts, "")).otherwise(text)


def words_of(text: Column) -> Column:
    """Different terms of a text without mails, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))


def entities_of(spans: Column) -> Column:
    """The entities that base spans name, each once, as texts."""

    def named(span: Column) -> Column:
        kind, value = span["kind"], F.lower(span["value"])
        digits = F.regexp_replace(value, "[^0-9]", "")
        own = F.when(kind.isin("card", "phone"), digits).otherwise(value)
        coarse = (F.when(kind == "email", F.concat(F.lit("domain:"), F.regexp_extract(value, "@(.*)$", 1)))
                  .when(kind == "ip", F.concat(F.lit("network:"), F.regexp_extract(value, r"^(.*)\.", 1)))
                  .when(kind == "card", F.concat(F.lit("issuer:"), F.substring(digits, 1, 6)))
                  .otherwise(F.concat(F.lit("numbers:"), F.substring(digits, 1, 5))))
        return F.array(F.concat(kind, F.lit(":"), own), coarse)

    return F.array_distinct(F.flatten(F.transform(spans, named)))


def disclosing(entities: DataFrame, texts: DataFrame, copies: DataFrame, total: int) -> DataFrame:
    """`(entity, term, share)`: terms that reveal an entity, with how far.

    `entities` has (doc, entity) and `texts` (doc, text) of all documents, `doc` the hash of the text, so rows may
    repeat; staged `copies` has the `doc` of texts that do. `total` is the number of different texts.
    """
    if total < 2:
        return entities.select("entity", F.lit("").alias("term"), F.lit(0.0).alias("share")).limit(0)
    entities, others = entities.distinct(), float(total - 1)
    known = entities.groupBy("entity").agg((F.count("*") - 1).alias("e")).filter((F.col("e") > 0) & (F.col("e") < others))
    held = stage(entities.join(known, "entity"), "entities")
    # The rarest words can reveal any entity, others none: n(e, t) is n(e) at most.
    most = held.agg(F.coalesce(F.max("e"), F.lit(0))).first()[0]
    # Texts that do not repeat are counted in every task before the shuffle; of copies each text counts once.
    words = lookup_join(texts, copies.withColumn("copy", F.col("doc")), "doc").select("copy", F.explode(words_of(F.col("text"))).alias("term"))
    counts = words.groupBy("term", "copy").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("copy").isNull(), F.col("n")).otherwise(1))
    terms = counts.groupBy("term").agg((F.sum("n") - 1).alias("t"))
    reach = F.lit(others ** (1 - GENERALISE)) * F.pow(F.col("e").cast("double"), F.lit(GENERALISE))
    terms = terms.filter((F.col("t") > 0) & (F.col("t") <= F.lit(others ** (1 - GENERALISE) * float(most) ** GENERALISE * (1 + 1e-9))))
    with_entity = texts.join(held.select("doc").distinct(), "doc", "left_semi")
    rare = with_entity.select("doc", F.explode(words_of(F.col("text"))).alias("term")).distinct().join(terms, "term")
    both = (held.join(rare, "doc").filter(F.col("t") <= reach * (1 + 1e-9))
            .groupBy("entity", "term", "e", "t").agg((F.count("*") - 1).alias("both")).filter("both > 0"))
    share = (F.log(F.lit(others) * F.col("both") / (F.col("e") * F.col("t"))) / F.log(F.lit(others) / F.col("e")))
    return both.select("entity", "term", F.least(share, F.lit(1.0)).alias("share")).filter(F.col("share") >= GENERALISE)


def scan(docs: DataFrame, text_col: str = "text", drop: bool = False) -> tuple[DataFrame, str]:
    """`docs`, with `drop` less the text, with all spans in a last column, whose name is returned: (kind, start, end, share) by kind, then start.

    The kind of an added span is term; only these have a share. `docs` is read twice and best a scan or a staged table.
    """
    row, base, plain, doc, named, spans = fresh(docs, "row", "base", "plain", "doc", "named", "spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [column for column in docs.columns if not (drop and column == text_col)]
    found = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(base, base_spans(text))
    # Texts without a span need not be seen again.
    found = stage(found.select(*kept, row, base, F.when(F.size(base) > 0, without_mails(text)).alias(plain), F.xxhash64(text).alias(doc),
                               entities_of(F.col(base)).alias(named)), "mentions")
    repeats = found.groupBy(F.col(doc).alias("doc")).agg(F.count("*").alias("n"))
    total = repeats.count()
    each = found.select(F.col(row).alias("row"), F.col(doc).alias("doc"), F.explode(named).alias("entity"))
    copies = stage(repeats.filter("n > 1").select("doc"), "copies")
    texts = docs.select(F.xxhash64(text).alias("doc"), without_mails(text).alias("text"))
    pairs = stage(disclosing(each.select("doc", "entity"), texts, copies, total), "disclosing")
    shares = (each.select("row", "entity").join(pairs, "entity").groupBy("row", "term").agg(F.max("share").alias("share"))
              .groupBy(F.col("row").alias(row)).agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias(spans)))
    joined = found.join(shares, row, "left")
    kind = "array<struct<kind:string,start:int,end:int,share:double>>"
    own = F.transform(base, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                               F.lit(None).cast("double").alias("share")))
    told = F.transform(F.filter(positions(F.col(plain), _TERM), lambda t: F.map_contains_key(spans, F.lower(t["value"]))), lambda t: F.struct(
        F.lit("term").alias("kind"), t["start"].alias("start"), (t["start"] + F.length(t["value"])).alias("end"),
        F.element_at(spans, F.lower(t["value"])).alias("share")))
    more = F.when(F.col(spans).isNotNull(), told.cast(kind)).otherwise(F.array().cast(kind))
    return joined.select(*kept, F.concat(own.cast(kind), more).alias(spans)), spans


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with spans generalised to marks or removed, same columns and rows. Of overlapping spans the first counts."""
    scanned, spans = scan(docs, text_col)
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        mark = F.when(F.coalesce(span["share"], F.lit(0.0)) >= REMOVE, F.lit("")).otherwise(
            F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]")))
        done = F.concat(state["out"], F.substring(text, state["at"] + 1, span["start"] - state["at"]), mark)
        fits = span["start"] >= state["at"]
        return F.struct(F.when(fits, span["end"]).otherwise(state["at"]).alias("at"),
                        F.when(fits, done).otherwise(state["out"]).alias("out"))

    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                                  s["kind"].alias("kind"), s["share"].alias("share"))))
    whole = F.aggregate(ordered, start, step, lambda state: F.concat(
        state["out"], F.substring(text, state["at"] + 1, F.length(text))))
    clean = F.when(F.size(spans) > 0, whole).otherwise(text)
    return scanned.withColumn(text_col, clean).select(*docs.columns)


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest, and all spans, for every row of `docs`."""
    scanned, name = scan(docs.select("doc_id", "text"), drop=True)
    counts = [F.size(F.filter(F.col(f"{name}.kind"), F.lit(kind).__eq__)).cast("long").alias(f"n_{kind}") for kind in (*KINDS, "term")]
    base = F.filter(name, lambda s: s["kind"] != "term")
    return scanned.select("doc_id", *counts[:4], sha256_hex(written(base)).alias("base_sha256"),
                          written(F.col(name)).alias("spans"), counts[4])

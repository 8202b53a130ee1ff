"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

1. A lexicon: the fixed words below, and terms learned from labelled training texts. A term is a word or
   the first four or five letters of a longer one. It is counted by its distinct left neighbours, so a
   text copied a thousand times counts once, and kept when several toxic texts have it and toxic texts
   have it far more often (log likelihood ratio and odds).
2. Features of the whole text: densities and counts of lexicon words, lexicon words close to the second
   person, capitals, punctuation, and how much is spelled to deceive (digits or signs for letters,
   stretched or spaced letters).
3. Spark's gradient-boosted trees on the training rows. The isotonic regression is fitted on what trees
   that were grown on one half of these rows give for the other half.

The trees are fitted on at most about `SAMPLE` labelled rows of each class, drawn by the hash of the
id; trees, calibration and prior weigh each row by what its class was thinned by, so scores follow the real
rate at any size. The lexicon compares rates within the classes, which thinning leaves alone. Every row is scored. Ids, labels and all columns but the text are never inputs of a score.

Missing and empty texts have features of zero and get the score of such a text. Repeated rows are scored
each on its own; a document with several labels counts with each. Rows with a missing label are left
out of the fit. Long texts are read whole; a worker holds their words. If the training rows lack a class, every score is (toxic + 1) / (rows + 2).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F, types as T

from .common import fresh, pieces, remainder, ship_package, stage

SAMPLE = 4_000
MAX_TERMS = 2_000
MIN_CONTEXTS = 5
MIN_TEXTS = 5
MIN_RATIO = 25.0
MIN_ODDS = 10.0
NEAR = 5
THRESHOLD = 0.7
CACHED_TOKENS = 300_000

WORDS = frozenset("""
    idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash disgusting clown imbecile fool
    bastard bitch asshole shit fuck fucking cunt whore slut retard retarded garbage filthy vermin
    idiote con connard connasse salope putain merde ordure abruti débile
    arschloch dummkopf scheiße wichser hurensohn schlampe abschaum trottel
    idiota imbécil estúpido estúpida puta mierda cabrón gilipollas pendejo basura
""".split())
SECOND_PERSON = frozenset("""
    you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch
    tú ti tus usted ustedes vosotros vuestro
""".split())
_LEET = str.maketrans("013457@$!|+", "oieastasiit")
_PARTS = re.compile(r"[^\W_]+")
_STRETCHED = re.compile(r"(.)\1{2,}")
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS, _MARKS = bytes(range(48, 58)), b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

WORD, STEM, HIDDEN, PERSON, CAPITAL, ODD, STRETCH, LETTER = (1 << i for i in range(8))
FEATURES = ("log_words word_density word_count stem_density stem_count hidden_count near_person closeness upper capitals "
            "exclamations questions marks digits odd stretched spaced").split()


class Features:
    """Dense features of texts, for one lexicon."""

    def __init__(self, words: frozenset[str], stems: frozenset[str]):
        self.words, self.stems = words, stems
        self.known: dict[str, int] = {}

    def _hit(self, word: str) -> int:
        if word in self.words:
            return WORD
        return STEM if len(word) > 5 and (word[:4] in self.stems or word[:5] in self.stems) else 0

    def flags(self, token: str) -> int:
        """What a token between white space is, as bits."""
        low = token.lower()
        parts = _PARTS.findall(low)
        out = 0
        for part in parts:
            out |= self._hit(part) | (PERSON if part in SECOND_PERSON else 0)
        if len(token) > 1 and token.isupper():
            out |= CAPITAL
        if len(token) == 1 and token.isalpha():
            out |= LETTER
        core = low.strip("\"'()[]{}.,;:?!")
        if len(core) > 2 and not core.isalpha() and any(map(str.isalpha, core)):
            out |= ODD
        if _STRETCHED.search(core):
            out |= STRETCH
        if out & (ODD | STRETCH) and not out & (WORD | STEM):
            plain = "".join(c for c in core.translate(_LEET) if c.isalpha())
            forms = (plain, _STRETCHED.sub(r"\1", plain), _STRETCHED.sub(r"\1\1", plain))
            if any(form in self.words for form in forms):
                out |= HIDDEN
        return out

    def of(self, text: str, data: bytes) -> list[float]:
        tokens = text.split()
        known = self.known
        if len(known) > CACHED_TOKENS:
            known.clear()
        for token in set(tokens).difference(known):
            known[token] = self.flags(token)
        codes = np.fromiter(map(known.__getitem__, tokens), np.int16, len(tokens))
        n, size = max(1, len(tokens)), max(1, len(data))
        count = {flag: int(np.count_nonzero(codes & flag)) for flag in (WORD, STEM, HIDDEN, CAPITAL, ODD, STRETCH)}
        spaced = 0
        letters = (codes & LETTER) > 0
        if letters.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[False], letters, [False]])))
            for first, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if end - first >= 4:
                    spaced += 1
                    count[HIDDEN] += "".join(tokens[first:end]).lower() in self.words
        hits = np.flatnonzero(codes & (WORD | STEM | HIDDEN))
        near, closeness = 0, 0.0
        person = np.flatnonzero(codes & PERSON)
        if len(hits) and len(person):
            at = np.searchsorted(person, hits)
            distance = np.minimum(np.abs(hits - person[np.minimum(at, len(person) - 1)]),
                                  np.abs(hits - person[np.maximum(at - 1, 0)]))
            near, closeness = int((distance <= NEAR).sum()), 1.0 / (1 + int(distance.min()))
        share = lambda kept: (len(data) - len(data.translate(None, kept))) / size
        letters_share = share(_LETTERS)
        return [math.log1p(len(tokens)), count[WORD] / n, math.log1p(count[WORD]), count[STEM] / n, math.log1p(count[STEM]),
                math.log1p(count[HIDDEN]), math.log1p(near), closeness, share(_UPPER) / max(letters_share, 1e-9),
                count[CAPITAL] / n, data.count(b"!") / size, data.count(b"?") / size, share(_MARKS), share(_DIGITS),
                count[ODD] / n, count[STRETCH] / n, spaced / n]


class _Extract:
    """Appends the features as an array of doubles to Arrow batches."""

    def __init__(self, lexicon, text: int, drop: bool):
        self.lexicon, self.text, self.drop = lexicon, text, drop

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(*self.lexicon)
        for batch in pieces(batches):
            column = batch.column(self.text)
            rows = [features.of(text or "", data or b"")
                    for text, data in zip(column.to_pylist(), column.cast(pa.binary()).to_pylist())]
            flat = pa.array(np.array(rows, np.float64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32()), flat)
            columns = [c for i, c in enumerate(batch.columns) if not (self.drop and i == self.text)]
            yield pa.RecordBatch.from_arrays([*columns, lists], names=[str(i) for i in range(len(columns) + 1)])


def features(docs: DataFrame, lexicon, text_col: str, name: str, drop: bool = False) -> DataFrame:
    """`docs` with the feature array as `name`; with `drop`, in place of the text."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)
    fields = [field for i, field in enumerate(docs.schema.fields) if not (drop and i == at)]
    schema = T.StructType([*fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(_Extract(lexicon, at, drop), schema)


def _terms(rows: DataFrame) -> DataFrame:
    """Distinct `(term, before, text)`: words, and the stems of longer ones behind a `^`; hashes of the other two."""
    words = rows.select(F.xxhash64("text").alias("text"), F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) > 2).alias("w"))
    pairs = words.select("text", F.explode(F.zip_with(
        "w", F.concat(F.array(F.lit("")), F.col("w")),
        lambda w, before: F.struct(w.alias("w"), F.xxhash64(before).alias("before")))).alias("p")).filter("p.w IS NOT NULL")
    forms = F.when(F.length("p.w") > 5, F.array("p.w", F.concat(F.lit("^"), F.substring("p.w", 1, 4)),
                                                F.concat(F.lit("^"), F.substring("p.w", 1, 5)))).otherwise(F.array("p.w"))
    return pairs.select(F.explode(forms).alias("term"), "p.before", "text").distinct()


def learn_lexicon(labelled: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Words and stems that mark toxic texts, `MAX_TERMS` at most, with the fixed words.

    `labelled` has (text, toxic) and is a bounded sample. Terms of clean texts are counted only where
    toxic texts have the term, so the clean side is filtered before it is shuffled.
    """
    toxic = _terms(labelled.filter("toxic = 1").select("text")).groupBy("term").agg(
        F.count_distinct("before").alias("c1"), F.count_distinct("text").alias("texts"))
    toxic = stage(toxic, "terms")
    clean = _terms(labelled.filter("toxic = 0").select("text").alias("d"))
    candidates = toxic.filter((F.col("c1") >= MIN_CONTEXTS) & (F.col("texts") >= MIN_TEXTS))
    clean = clean.join(candidates.select("term"), "term", "left_semi").groupBy("term").agg(
        F.count_distinct("before").alias("c0"))
    # What a class has in all: its words, a few thousand texts' worth.
    size = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(
        F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    n1, n0 = float(size.get(1, 1)), float(size.get(0, 1))
    c1, c0 = F.col("c1"), F.coalesce("c0", F.lit(0))
    share = n1 / (n1 + n0)
    ratio = 2 * (c1 * F.log(c1 / ((c1 + c0) * share)) + F.when(c0 > 0, c0 * F.log(c0 / ((c1 + c0) * (1 - share)))).otherwise(0))
    odds = ((c1 + 0.5) / n1) / ((c0 + 0.5) / n0)
    found = (candidates.join(clean, "term", "left").select("term", ratio.alias("ratio"), odds.alias("odds"))
             .filter(F.col("ratio").between(MIN_RATIO, float("inf")) & (F.col("odds") >= MIN_ODDS))
             .orderBy(F.desc("ratio"), "term").limit(MAX_TERMS).collect())
    terms = [r.term for r in found]
    return (WORDS.union(t for t in terms if t[0] != "^"), frozenset(t[1:] for t in terms if t[0] == "^"))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """About `per_class` training rows of each class, or all if there are fewer: `(doc_id, text, toxic, weight)`.

    The weight is the inverse of the share of the class that is drawn.
    """
    rows = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "toxic").distinct()
    rows = rows.filter(remainder("doc_id", 3) != 1)
    sizes = rows.groupBy("toxic").agg(F.count("*").alias("n"))  # two rows
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 20))
    picked = (rows.join(F.broadcast(sizes), "toxic").filter(draw * F.col("n") < F.lit(per_class).cast("long") * (1 << 20))
              .select("doc_id", "toxic", F.greatest(F.lit(1.0), F.col("n") / per_class).alias("weight")))
    # Bounded by the sample size, so it can be broadcast.
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")


class Model:
    """Fitted trees and the calibration points."""

    def __init__(self, lexicon, trees, points, values, prior: float):
        self.lexicon, self.trees, self.points, self.values, self.prior = lexicon, trees, points, values, prior

    def score(self, docs: DataFrame, text_col: str = "text", drop: bool = False) -> tuple[DataFrame, str]:
        """`docs` with a score from 0 to 1 in a last column, whose name is returned."""
        array, vector, raw, probability, prediction, name = fresh(
            docs, "features", "vector", "raw", "probability", "prediction", "score")
        kept = [c for c in docs.columns if not (drop and c == text_col)]
        if self.trees is None:
            return docs.select(*kept, F.lit(self.prior).alias(name)), name
        trees = (self.trees.setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(probability)
                 .setPredictionCol(prediction))
        scored = trees.transform(features(docs, self.lexicon, text_col, array, drop).withColumn(vector, array_to_vector(array)))
        p = vector_to_array(probability)[1]
        return scored.withColumn(raw, p).select(*kept, self._calibrated(F.col(raw)).alias(name)), name

    def _calibrated(self, p):
        """Isotonic value of p, between the points by line; a thousandth of p itself orders what it ties."""
        points = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in zip(self.points, self.values)])
        below = F.filter(points, lambda q: q["x"] <= p)
        above = F.filter(points, lambda q: q["x"] > p)
        low, high = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
        line = low["y"] + (high["y"] - low["y"]) * (p - low["x"]) / (high["x"] - low["x"])
        value = F.when(low.isNull(), high["y"]).when(high.isNull(), low["y"]).otherwise(line)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value * 0.999 + p * 0.001))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    """Learn lexicon, trees and calibration from the training rows of `labels`."""
    rows = stage(sample(docs, labels, per_class), "labelled")
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    prior = (toxic + 1) / (toxic + clean + 2)
    lexicon = learn_lexicon(rows) if toxic and clean else (WORDS, frozenset())
    if not toxic or not clean:
        return Model(lexicon, None, [], [], prior)
    half = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(2))
    table = features(rows.select("doc_id", "text", "toxic", "weight"), lexicon, "text", "features", drop=True)
    table = stage(table.withColumn("half", half), "features").select(
        "half", "weight", F.col("toxic").cast("double").alias("label"), array_to_vector("features").alias("features"))
    learner = GBTClassifier(maxDepth=3, maxIter=20, stepSize=0.2, maxBins=64, minInstancesPerNode=5, seed=7, weightCol="weight")
    trees = learner.fit(table)
    both = {r.half for r in table.groupBy("half").agg(F.count_distinct("label").alias("n")).filter("n = 2").collect()}
    # A half without one of the classes can't be learned from; what trees of all rows give then stands in.
    judged = [(learner.fit(table.filter(F.col("half") == 1 - h)) if 1 - h in both else trees)
              .transform(table.filter(F.col("half") == h)) for h in (0, 1)]
    scored = judged[0].unionByName(judged[1]).select("label", "weight", vector_to_array("probability")[1].alias("p"))
    steps = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight").fit(scored)
    return Model(lexicon, trees, list(steps.boundaries), list(steps.predictions), prior)


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Score and verdict of every row of `docs`."""
    source = docs.select("doc_id", "text")
    scored, name = fit(source, labels).score(source, drop=True)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), F.col(name).alias("score"),
                         (F.col(name) >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` less those scored toxic, same columns."""
    scored, name = fit(docs, labels).score(docs)
    return scored.filter(F.col(name) < threshold).select(*docs.columns)

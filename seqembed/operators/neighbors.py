"""Exact k nearest neighbours by cosine, without comparing all pairs.

Unit vectors are grouped around pivots and cut into shells of similar distance to their pivot. A row first
searches its own block, which bounds the distance of its k-th neighbour. By the triangle inequality most other
shells cannot hold anything nearer and are never visited. How many are left depends on how clustered the vectors
are; the result does not.

The driver knows at most `MAX_SHELLS` shells. A shell with more than `block_rows` rows is cut once more, into blocks
of that many rows by the distance to a second pivot of its own; rows that reach the shell are compared with its
blocks' bounds in the cluster. So blocks have one size, whatever the number of rows.

Blocks one after the other make a band of up to `BAND_ROWS` rows. A row is sent once to each other band in which it
reaches a block, and a band once to each band that has such rows. So what is shuffled grows with rows times bands,
not with visited blocks. Up to `BANDS` bands of that size it grows like the rows; beyond, on vectors without structure,
with their square divided by `BAND_ROWS`.

Every search of a block, and of a band, keeps the `k` best per row, ties by the smallest id, so ties make no more hits
than rows, k and visited bands allow. In a band nothing is kept that is worse than the `k` best known before. Equal vectors are searched once, so a vector repeated a million times is one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.arrays import list_codes, list_column
from ..session import ship_package, stage
from .rank import row_numbers, top_per_group

MAX_PIVOTS = 256
MAX_SHELLS = 50_000
PIVOTS_PER_BLOCK = 4
QUERY_ROWS = 1024
BANDS = 6
BAND_ROWS = 1 << 16
SEARCH_ROWS = 4096
BOUND_CELLS = 4_000_000
SIM_DIGITS = 12
# Allowance for rounding: similarities are good to 1e-12, chords near 0 to about 1e-6.
SLACK = 1e-5


def knn_cosine(df: DataFrame, k: int = 15, id_column: str = "vec_id", vector: str = "embedding",
               block_rows: int = 4096, max_shells: int = MAX_SHELLS) -> DataFrame:
    """`(id, rank, neighbor, cosine)`: the `k` most similar other rows of each row.

    Ties go to the smaller id. Similarities are compared after rounding to 12 digits. A vector of
    length 0, a missing one, or one with a null or non-finite component has no cosine; such rows have no
    neighbours and are none. Vectors of different lengths raise.
    """
    spark = df.sparkSession
    rows, nodes, total = prepared(df, id_column, vector)
    pivots = _pivots(nodes, total, block_rows)
    if not len(pivots):
        return finished(rows, spark.createDataFrame([], _hits(rows.schema["id"].dataType)), k, id_column)
    shared = spark.sparkContext.broadcast(pivots)
    id_type = rows.schema["id"].dataType
    placed = stage(nodes.mapInArrow(_Placer(shared), T.StructType([
        T.StructField("rep", T.StringType()), T.StructField("first", id_type), T.StructField("pivot", T.IntegerType()),
        T.StructField("dist", T.DoubleType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])), "knn-placed")

    size = max(block_rows, math.ceil(total / max_shells))
    shelled = stage(_slices(placed, ["pivot"], "dist", size, "slice"), "knn-shells")
    # At most max_shells + MAX_PIVOTS rows.
    bounds = (shelled.groupBy("pivot", "slice")
              .agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count("*").alias("n"))
              .orderBy("pivot", "slice").toPandas())
    band_rows = max(block_rows, min(BAND_ROWS, math.ceil(total / BANDS)))
    bounds["band"] = (bounds["n"].cumsum() - bounds["n"]) // band_rows
    shells = spark.createDataFrame(bounds[["pivot", "slice"]].assign(shell=range(len(bounds)), band=bounds["band"]),
                                   "pivot int, slice int, shell int, band long")
    shelled = shelled.join(F.broadcast(shells), ["pivot", "slice"]).select("rep", "first", "shell", "band", "vector")
    two_levels = size > block_rows
    # In two levels a band has at most so many blocks of a shell.
    inner_band = _block_of("band", F.floor(F.col("part") / (band_rows // block_rows)))
    blocked = stage(
        _blocks(shelled, block_rows).withColumn("band", inner_band).drop("part") if two_levels else shelled.withColumn("block", _block_of("shell", F.lit(0))), "knn-blocks")

    known = spark.sparkContext.broadcast(bounds)
    home_search = _HomeSearch(k, shared, known, two_levels)
    home = stage(blocked.select("rep", "first", "shell", "block", "band", "vector").groupBy("block").applyInArrow(
        lambda table: home_search(table), T.StructType([
            T.StructField("rep", T.StringType()), T.StructField("block", T.LongType()), T.StructField("band", T.LongType()),
            T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("reach", T.DoubleType()), T.StructField("least", T.DoubleType()),
            T.StructField("found", T.ArrayType(T.StringType())), T.StructField("firsts", T.ArrayType(id_type)),
            T.StructField("sims", T.ArrayType(T.DoubleType())), T.StructField("visits", T.ArrayType(T.LongType()))])),
        "knn-home")
    hits = home.select("rep", F.explode(F.arrays_zip("found", "firsts", "sims")).alias("hit")).select(
        "rep", F.col("hit.found").alias("other"), F.col("hit.firsts").alias("first"), F.col("hit.sims").alias("sim"))
    if len(bounds) > 1 or two_levels:
        rows_of = home.select("rep", F.col("block").alias("home"), F.col("band").alias("from_band"), "reach", "least", "vector", "visits")
        if two_levels:
            reached = _within(rows_of.select("rep", "reach", "vector", F.explode("visits").alias("shell")), blocked)
            visits = rows_of.drop("visits").join(reached, "rep")
        else:
            visits = rows_of.select("*", F.explode("visits").alias("band")).drop("visits")
        hits = hits.unionByName(_away(visits, blocked, _BandSearch(k, shared, known, two_levels)))
    best = top_per_group(hits, ["rep"], [F.desc("sim"), F.asc_nulls_last("first")], k, spread=["other"])
    return finished(rows, best, k, id_column)


def prepared(df: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, DataFrame, int]:
    """Staged rows `(id, rep, vector)` that have a cosine, staged distinct vectors `(rep, first, vector)`, their number.

    Equal vectors share `rep`, a hash of 128 bits; `first` is the smallest id among them.
    """
    ship_package(df.sparkSession)
    # Staged, as it is read several times: what makes the vectors, a model perhaps, runs once.
    source = df.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    usable = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rep = F.concat(F.hex(F.xxhash64("vector")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "vector")))
    rows = stage(source.filter(usable).select("id", rep.alias("rep"), "vector"), "knn-input")
    firsts = rows.groupBy("rep").agg(F.min("id").alias("first"))
    nodes = stage(rows.select("rep", "vector").dropDuplicates(["rep"]).join(firsts, "rep").select("rep", "first", "vector"),
                  "knn-nodes")
    return rows, nodes, nodes.count()


def finished(rows: DataFrame, best: DataFrame, k: int, id_column: str) -> DataFrame:
    """`(id, rank, neighbor, cosine)` from the `k` best other vectors `(rep, other, sim)` of each vector."""
    # A row needs at most k + 1 copies of any vector, its own included: it may be one of them.
    copies = top_per_group(rows.select("rep", "id"), ["rep"], ["id"], k + 1, spread=["id"])
    members = copies.groupBy("rep").agg(F.collect_list("id").alias("ids"))
    same = members.select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("sim"))
    near = best.select("rep", "other", "sim").unionByName(same).join(
        members.withColumnRenamed("rep", "other"), "other")
    lists = near.select("rep", F.explode(F.transform("ids", lambda i: F.struct(
        (-F.col("sim")).alias("order"), i.alias("neighbor")))).alias("hit"))
    lists = lists.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("hit")), 1, k + 1).alias("hits"))

    joined = rows.select("id", "rep").join(lists, "rep")
    others = F.slice(F.filter("hits", lambda h: h["neighbor"] != F.col("id")), 1, k)
    return joined.select("id", F.posexplode(others).alias("rank", "hit")).select(
        F.col("id").alias(id_column), (F.col("rank") + 1).alias("rank"),
        F.col("hit.neighbor").alias("neighbor"), (-F.col("hit.order")).alias("cosine"))


def _hits(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("rep", T.StringType()), T.StructField("other", T.StringType()),
                         T.StructField("first", id_type), T.StructField("sim", T.DoubleType())])


def _block_of(shell: str, part: Column) -> Column:
    return F.shiftleft(F.col(shell).cast("long"), 32) + part


def _slices(rows: DataFrame, keys: list[str], order: str, size: int, name: str) -> DataFrame:
    """`rows` with the number of their slice: each key is cut in `order` into equal slices of at most `size` rows."""
    ranked = row_numbers(rows, [order, "rep"], keys, name="_place", size="_of")
    slices = F.ceil(F.col("_of") / size)
    part = F.floor((F.col("_place") - 1) * slices / F.col("_of")).cast("int")
    return ranked.select(*rows.columns, part.alias(name))


def _blocks(shelled: DataFrame, block_rows: int) -> DataFrame:
    """Shells cut into blocks by the distance to a second pivot, the row of the smallest name."""
    centres = shelled.groupBy("shell").agg(F.min_by("vector", "rep").alias("centre"))
    schema = T.StructType([*shelled.schema.fields, T.StructField("centre", T.ArrayType(T.DoubleType())),
                           T.StructField("apart", T.DoubleType())])
    measured = stage(shelled.join(centres, "shell").select(*shelled.columns, "centre").mapInArrow(_Apart(), schema), "knn-apart")
    cut = _slices(measured, ["shell"], "apart", block_rows, "part")
    return cut.withColumn("block", _block_of("shell", F.col("part")))


def _within(visits: DataFrame, blocked: DataFrame) -> DataFrame:
    """Of the shells that rows `(rep, reach, vector, shell)` reach, `(rep, band)` of the bands with a block that they reach."""
    bounds = blocked.groupBy("shell", "block", "band").agg(F.min("apart").alias("low"), F.max("apart").alias("high"))
    centres = blocked.groupBy("shell").agg(F.min_by("centre", "rep").alias("centre"))
    inner = bounds.groupBy("shell").agg(F.sort_array(F.collect_list(F.struct("band", "low", "high"))).alias("inner"))
    inner = inner.select("shell", F.col("inner.band").alias("bands"), F.col("inner.low").alias("lows"),
                         F.col("inner.high").alias("highs")).join(centres, "shell")
    reaching = visits.join(inner, "shell").select("rep", "reach", "vector", "centre", "bands", "lows", "highs")
    return stage(reaching.mapInArrow(_Refine(), "rep string, band long").distinct(), "knn-reached")


def _away(visits: DataFrame, blocked: DataFrame, search: _BandSearch) -> DataFrame:
    """Hits of visiting rows `(rep, home, from_band, reach, least, vector, band)`: one search per pair of bands."""
    pairs = visits.select("from_band", "band").distinct().toDF("visitors", "band")
    candidates = blocked.select("band", "shell", "block", "rep", "first", "vector").join(pairs, "band")
    return (visits.groupBy("from_band", "band").cogroup(candidates.groupBy("visitors", "band"))
            .applyInArrow(lambda left, right: search(left, right), _hits(blocked.schema["first"].dataType)))


def _pivots(nodes: DataFrame, total: int, block_rows: int) -> np.ndarray:
    """Up to `MAX_PIVOTS` different unit vectors, picked by their hash."""
    wanted = min(MAX_PIVOTS, math.ceil(PIVOTS_PER_BLOCK * total / block_rows))
    found = [row.vector for row in nodes.orderBy("rep").limit(wanted).collect()]
    if len({len(vector) for vector in found}) > 1:
        raise ValueError("vectors have different lengths")
    return unit_rows(np.array(found, dtype=np.float64)) if found else np.empty((0, 0))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; none is all zero."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _chord(sims):
    """Straight-line distance of unit vectors with these cosines."""
    return np.sqrt(np.maximum(2 - 2 * sims, 0))


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    values, bounds = list_codes(vectors)
    sizes = np.diff(bounds)
    if len(sizes) and (sizes != (sizes[0] if width is None else width)).any():
        raise ValueError("vectors have different lengths")
    return values.reshape(len(sizes), -1) if len(values) else np.empty((0, width or 0))


class _Placer:
    """Scale to unit length and find the nearest pivot."""

    def __init__(self, pivots):
        self.pivots = pivots

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = self.pivots.value
        for batch in batches:
            if not batch.num_rows:
                continue
            units = unit_rows(matrix(batch.column("vector"), pivots.shape[1]))
            chords = _chord(units @ pivots.T)
            nearest = chords.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("rep"), batch.column("first"), pa.array(nearest),
                pa.array(chords[np.arange(len(units)), nearest]), list_column(units),
            ], names=["rep", "first", "pivot", "dist", "vector"])


class _Apart:
    """Arrow batches of (..., vector, centre) with the distance of the two in a last column."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = (matrix(batch.column("vector")) * matrix(batch.column("centre"))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_chord(sims))], names=[*batch.schema.names, "apart"])


class _Refine:
    """Rows with a shell that they reach, its second pivot and its blocks' bands and bounds, to the bands in which they reach a block."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = _chord((matrix(batch.column("vector")) * matrix(batch.column("centre"))).sum(axis=1))
            bands, bounds = list_codes(batch.column("bands"))
            low, high = list_codes(batch.column("lows"))[0], list_codes(batch.column("highs"))[0]
            row = np.repeat(np.arange(len(apart)), np.diff(bounds))
            reach = batch.column("reach").to_numpy()[row] + SLACK
            near = np.flatnonzero(np.maximum(apart[row] - high, low - apart[row]) <= reach)
            row, band = row[near], bands[near]
            once = _changes(row, band)
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(row[once])), pa.array(band[once])], names=["rep", "band"])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where one of the columns differs from the place before."""
    changes = np.ones(len(columns[0]), bool)
    if len(changes):
        changes[1:] = np.logical_or.reduce([column[1:] != column[:-1] for column in columns])
    return changes


def best_columns(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns of the `k` largest of each row above -inf, ties from the left, and each row's k-th largest."""
    if sims.shape[1] < k:
        row, column = np.nonzero(sims > -np.inf)
        return row, column, np.full(len(sims), -np.inf)
    least = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
    kept = sims >= least[:, None]
    for tied in np.array_split(np.flatnonzero(kept.sum(axis=1) > k), max(1, kept.size // BOUND_CELLS)):
        equal = sims[tied] == least[tied, None]
        spare = k - (kept[tied] & ~equal).sum(axis=1)
        kept[tied] &= ~equal | (np.cumsum(equal, axis=1) <= spare[:, None])
    kept &= sims > -np.inf
    return *np.nonzero(kept), least


class _HomeSearch:
    """Search a block for its own rows, and list the bands, or in two levels the shells, that each row has to visit."""

    def __init__(self, k, pivots, bounds, two_levels):
        self.k = k
        self.pivots = pivots
        self.bounds = bounds
        self.two_levels = two_levels

    def __call__(self, table: pa.Table) -> pa.Table:
        table = table.sort_by("first")  # so that ties, taken from the left, go to the smaller id
        vectors, names, firsts = matrix(table["vector"]), table["rep"].combine_chunks(), table["first"].combine_chunks()
        shell = table["shell"][0].as_py()
        counts, columns, near, leasts, reaches, shells, visits = [], [], [], [], [], [], []
        for start in range(0, len(vectors), QUERY_ROWS):
            part = vectors[start:start + QUERY_ROWS]
            own = np.arange(len(part))
            sims = np.round(part @ vectors.T, SIM_DIGITS)
            sims[own, start + own] = -np.inf
            row, column, least = best_columns(sims, self.k)
            counts.append(np.bincount(row, minlength=len(part)))
            columns.append(column)
            near.append(sims[row, column])
            leasts.append(least)
            for reach, which, number in self._reachable(part, shell, least, len(vectors)):
                reaches.append(reach)
                shells.append(which)
                visits.append(number)
        columns = pa.array(np.concatenate(columns))
        ends = pa.array(np.append(0, np.cumsum(np.concatenate(counts))), pa.int32())
        visit_ends = pa.array(np.append(0, np.cumsum(np.concatenate(visits))), pa.int32())
        return pa.table({
            "rep": names, "block": table["block"], "band": table["band"], "vector": table["vector"],
            "reach": np.concatenate(reaches), "least": np.concatenate(leasts),
            "found": pa.ListArray.from_arrays(ends, names.take(columns)),
            "firsts": pa.ListArray.from_arrays(ends, firsts.take(columns)),
            "sims": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(near))),
            "visits": pa.ListArray.from_arrays(visit_ends, pa.array(np.concatenate(shells), pa.int64())),
        })

    def _reachable(self, vectors, home, least, held) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of rows: how far each has to look, the shells within, and their number per row."""
        pivots, bounds = self.pivots.value, self.bounds.value
        of_shell = bounds["pivot"].to_numpy()
        low, high = bounds["low"].to_numpy(), bounds["high"].to_numpy()
        sizes = bounds["n"].to_numpy().copy()
        sizes[home] -= 1
        centre = of_shell[home]
        apart = _chord(pivots @ pivots[centre])
        step = max(1, BOUND_CELLS // len(bounds))
        for start in range(0, len(vectors), step):
            to_pivots = _chord(vectors[start:start + step] @ pivots.T)
            cut = least[start:start + step]
            reach = _chord(np.where(np.isfinite(cut), cut, 0))
            short = np.flatnonzero(~np.isfinite(cut))
            if len(short):
                reach[short] = _k_within(to_pivots[short][:, of_shell] + high, sizes, self.k)
            near = _gaps(to_pivots, centre, apart, of_shell, low, high) <= reach[:, None] + SLACK
            if sizes[home] + 1 == held:  # the shell is this block
                near[:, home] = False
            row, which = np.nonzero(near)
            if not self.two_levels:
                which = bounds["band"].to_numpy()[which]
                once = _changes(row, which)  # bands rise with the shells
                row, which = row[once], which[once]
            yield reach, which, np.bincount(row, minlength=len(near))


def _gaps(to_pivots: np.ndarray, centre: np.ndarray | int, apart: np.ndarray, of_shell: np.ndarray, low: np.ndarray,
          high: np.ndarray) -> np.ndarray:
    """How far rows at least are from the rows of shells; `centre` is their own pivot, `apart` its distance from all pivots."""
    spread = to_pivots[:, of_shell]
    # Rows of another pivot lie beyond the plane halfway between it and ours.
    own = to_pivots[np.arange(len(to_pivots)), centre]
    beyond = (to_pivots ** 2 - own[:, None] ** 2) / np.maximum(2 * apart, SLACK)
    beyond[np.broadcast_to(apart < SLACK, beyond.shape)] = 0
    return np.maximum(np.maximum(spread - high, low - spread), beyond[:, of_shell])


def _k_within(farthest: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Per row a distance within which the shells of these sizes and farthest rows hold `k` rows."""
    order = np.argsort(farthest, axis=1)
    enough = np.cumsum(sizes[order], axis=1) >= k
    at = order[np.arange(len(order)), enough.argmax(axis=1)]
    return np.where(enough[:, -1], farthest[np.arange(len(order)), at], np.inf)


class _BandSearch:
    """The `k` nearest rows of a band for the visitors from another, or the same, outside their own block."""

    def __init__(self, k, pivots, bounds, two_levels):
        self.k = k
        self.pivots = pivots
        self.bounds = bounds
        self.two_levels = two_levels

    def __call__(self, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        names, vectors = queries["rep"].combine_chunks(), matrix(queries["vector"])
        home, reach, least = (queries[name].to_numpy() for name in ("home", "reach", "least"))
        candidates = candidates.sort_by("first")  # places are in the order of ids
        place = np.argsort(candidates["block"].to_numpy(), kind="stable")
        others = matrix(candidates["vector"])[place]
        block, shell = candidates["block"].to_numpy()[place], candidates["shell"].to_numpy()[place]
        runs = self._runs(block)
        found = []
        order = np.argsort(home, kind="stable")  # rows of a block reach the same blocks, mostly
        for at in range(0, len(order), QUERY_ROWS):
            part = order[at:at + QUERY_ROWS]
            near = self._near(vectors[part], home[part], reach[part], shell, runs)
            row, column, sims = self._search(vectors[part], home[part], least[part].copy(), others, block, place, near, runs)
            found.append((part[row], place[column], sims))
        row, column, sims = (np.concatenate(parts) for parts in zip(*found)) if found else (np.empty(0, np.int64),) * 2 + (np.empty(0),)
        row, column = pa.array(row), pa.array(column)
        return pa.table([names.take(row), candidates["rep"].combine_chunks().take(column),
                         candidates["first"].combine_chunks().take(column), pa.array(sims)], names=["rep", "other", "first", "sim"])

    @staticmethod
    def _runs(block: np.ndarray) -> list[tuple[int, int]]:
        """Whole blocks one after the other, up to `SEARCH_ROWS` rows, or one block."""
        starts = np.append(np.flatnonzero(_changes(block)), len(block)).tolist()
        runs, first = [], 0
        for start, end in zip(starts[:-1], starts[1:]):
            if end - first > SEARCH_ROWS and start > first:
                runs.append((first, start))
                first = start
        return [*runs, (first, len(block))] if len(block) else runs

    def _near(self, vectors: np.ndarray, home: np.ndarray, reach: np.ndarray, shell: np.ndarray, runs: list) -> np.ndarray:
        """Whether a row reaches a block of a run."""
        if self.two_levels:  # bands were chosen by their blocks
            return np.ones((len(vectors), len(runs)), bool)
        pivots, bounds = self.pivots.value, self.bounds.value
        of_shell = bounds["pivot"].to_numpy()
        to_pivots = _chord(vectors @ pivots.T)
        centre = of_shell[home >> 32]
        apart = _chord(pivots[centre] @ pivots.T)
        near = np.empty((len(vectors), len(runs)), bool)
        for i, (low, high) in enumerate(runs):
            held = np.unique(shell[low:high])
            here = bounds.iloc[held]
            gaps = _gaps(to_pivots, centre, apart, of_shell[held], here["low"].to_numpy(), here["high"].to_numpy())
            near[:, i] = ((gaps <= reach[:, None] + SLACK) & (held != home[:, None] >> 32)).any(axis=1)
        return near

    def _search(self, vectors, home, least, others, block, place, near, runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and similarities of the `k` best of each row, none worse than `least`, which rises meanwhile."""
        row, column, sims = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for i, (low, high) in enumerate(runs):
            part = np.flatnonzero(near[:, i])
            if not len(part):
                continue
            all_sims = vectors[part] @ others[low:high].T
            r, c = np.nonzero(all_sims >= least[part, None] - 10.0 ** -SIM_DIGITS)
            s = np.round(all_sims[r, c], SIM_DIGITS)
            r, c = part[r], c + low
            kept = (s >= least[r]) & (block[c] != home[r])
            if not kept.any():
                continue
            row, column, sims = np.append(row, r[kept]), np.append(column, c[kept]), np.append(sims, s[kept])
            order = np.lexsort((place[column], -sims, row))
            row, column, sims = row[order], column[order], sims[order]
            starts = np.flatnonzero(_changes(row))
            rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
            last = rank == self.k - 1
            least[row[last]] = np.maximum(least[row[last]], sims[last])
            row, column, sims = row[rank < self.k], column[rank < self.k], sims[rank < self.k]
        return row, column, sims

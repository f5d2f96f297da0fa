"""Hard negatives from k-means inverted lists whose radii bound every score.

Vectors are dealt to the lists of k-means centroids; each list stores its radius. By
Cauchy and Schwarz the scores of an anchor with a list lie within the anchor's norm
times the radius of its score with the centroid. So an anchor visits lists in the order
of their upper bounds: first a few, which give it a kth score, and then those that
can still hold something, which are all lists whose bound isn't strictly below that
score and whose range meets the window of scores that is asked for. What is left out
can't be in the result, so the result is exact.

An anchor's first visits and its last are one round each over all anchors: members
and visits of a list meet in one task, which holds the members of one part of a
list and reads the visits as a stream. Of rows with equal vectors and labels only
the smallest ids can ever be among the first k, so others stay out of the lists, and
equal anchors are one until the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import gives_back, join_counted, materialize

#: The sample that the centroids are fitted on (rows, and numbers in all), lists at most, rounds of fitting.
SAMPLE_ROWS, SAMPLE_NUMBERS, MOST_LISTS, FIT_ROUNDS = 65_536, 1 << 22, 4096, 8
#: Lists of the first visit, bytes of vectors in a part of a list, visits that one copy of a part serves.
FIRST_LISTS, PART_BYTES, MOST_VISITS = 4, 1 << 20, 1 << 16
#: Scores computed at once.
CELLS = 1 << 20
#: Whole numbers below this are exact in a double; scores are kept in a long.
EXACT, LEAST, MOST = float(1 << 53), -(1 << 63), (1 << 63) - 1


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None]


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """K-means by Lloyd's rounds from random rows; a list that gets no row keeps its centroid."""
    rng = np.random.default_rng(seed)
    different = np.unique(sample, axis=0)
    centroids = different[rng.permutation(len(different))[:lists]]
    step = max(1, CELLS // max(1, len(centroids)))
    for _ in range(FIT_ROUNDS):
        nearest = np.concatenate([_distances(sample[i : i + step], centroids).argmin(1) for i in range(0, len(sample), step)])
        sums, n = np.zeros_like(centroids), np.bincount(nearest, minlength=len(centroids))
        np.add.at(sums, nearest, sample)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


@dataclass
class Lists:
    """What a task knows of all lists: their centroids, radii and parts."""

    centroids: np.ndarray
    radii: np.ndarray
    parts: np.ndarray

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most score of each anchor with a member of each list, rounded outwards."""
        middle = anchors @ self.centroids.T
        norms = np.sqrt((anchors * anchors).sum(1))[:, None]
        reach = norms * self.radii[None]
        slack = 1e-9 * (norms * np.sqrt((self.centroids * self.centroids).sum(1))[None] + reach) + 1e-6
        return middle - reach - slack, middle + reach + slack


def _assigner(centroids) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.num_columns - 1))
            c = centroids.value
            step = max(1, CELLS // len(c))
            nearest = np.concatenate([_distances(x[i : i + step], c).argmin(1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)
            away = np.sqrt(((x - c[nearest]) ** 2).sum(1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32()), pa.array(away)], names=[*batch.schema.names, "list", "away"])

    return gives_back(run)


def _outwards(longs: list[int], way: int) -> np.ndarray:
    """Doubles no less (or no more) than some longs; the last long stands for all beyond it."""
    x = np.array(longs, np.float64)
    return np.where(x * way >= float(MOST), way * np.inf, x + way * np.abs(x) * 1e-15)


def _planner(lists, later: bool) -> Callable:
    """Visits of anchors with the columns class_id, label, low, high, floor (windows of
    scores, and the scores below which a window wants nothing more) and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CELLS // len(lists.value.radii))
            for i in range(0, batch.num_rows, step):
                yield from plan(batch.slice(i, step))

    def plan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = lists.value
        least, most = known.bounds(_matrix(batch.column(5)))
        low, high, floor = (batch.column(c).to_pylist() for c in (2, 3, 4))
        rows, which = [], []
        for i in range(batch.num_rows):
            lows, highs, floors = _outwards(low[i], -1), _outwards(high[i], 1), _outwards(floor[i], -1)
            meets = ~((most[i][None] < lows[:, None]) | (least[i][None] > highs[:, None]))
            order = np.flatnonzero(meets.any(0))
            order = order[np.argsort(-most[i][order], kind="stable")]
            if later:
                open_ = meets & ~(most[i][None] < floors[:, None])
                order = order[FIRST_LISTS:]
                order = order[open_[:, order].any(0)]
            else:
                order = order[:FIRST_LISTS]
            rows.append(np.repeat(i, len(order)))
            which.append(order)
        at, lists_ = np.concatenate(rows).astype(np.int64), np.concatenate(which).astype(np.int64)
        parts = known.parts[lists_]
        at, lists_ = np.repeat(at, parts), np.repeat(lists_, parts)
        part = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        # a visit has a copy of its anchor, so only so many at once
        step = max(1, 4 * CELLS // max(1, len(known.centroids[0])))
        for i in range(0, len(at), step):
            taken = batch.take(pa.array(at[i : i + step]))
            columns = [pa.array(lists_[i : i + step], pa.int32()), pa.array(part[i : i + step], pa.int32()), *(taken.column(c) for c in (0, 1, 3, 4, 5))]
            yield pa.RecordBatch.from_arrays(columns, names=["list", "part", "class_id", "label", "high", "floor", "vector"])

    return gives_back(run)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in doubles where those are exact, otherwise as
    Python's integers, cut to a long."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a).astype(object) @ whole(b).astype(object).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(exact, LEAST, MOST).astype(np.int64)


def _first(scores: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest wanted scores of each row, ties to the left."""
    n = scores.shape[1]
    if n > k:
        if np.abs(scores).max(initial=0) < (1 << 61) // n:
            key = np.where(wanted, scores * n - np.arange(n), LEAST)
            best = np.argpartition(-(key + 1), k - 1, axis=1)[:, :k]
        else:
            best = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), ~scores, ~wanted), axis=1)[:, :k]
        rows = np.repeat(np.arange(len(scores)), k)
        columns = best.ravel()
        ok = wanted[rows, columns]
        return rows[ok], columns[ok]
    return np.nonzero(wanted)


def _scorer(k: int, same_label: bool) -> Callable:
    """Rows of a part of a list, its members first and its visits behind them, become
    the first k members of each visit's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, None
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in (0, 1, 2, 3)], 1)  # list, part, slot, kind
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else []
            for start, end in zip(starts, [*starts[1:], len(keys)]):
                if key != (now := tuple(keys[start, :3])):
                    key, members, held = now, None, []
                if keys[start, 3] == 0:
                    held.append(batch.slice(start, end - start))
                elif held or members is not None:
                    if members is None:
                        members, held = _Members(held), []
                    yield from members.visited(batch.slice(start, end - start), k, same_label)

    return gives_back(run)


class _Members:
    def __init__(self, rows: list[pa.RecordBatch]) -> None:
        told = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        ids, own = told.column(4), np.asarray(told.column(5))
        none = np.asarray(ids.is_null())
        order = np.lexsort((own, np.asarray(ids.fill_null(0)), none))
        told = told.take(pa.array(order))
        self.ids, self.rows, self.labels = told.column(4), np.asarray(told.column(5)), np.asarray(told.column(6))
        self.vectors = _matrix(told.column(9))

    def visited(self, batch: pa.RecordBatch, k: int, same_label: bool) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // len(self.rows))
        for i in range(0, batch.num_rows, step):
            yield self._visited(batch.slice(i, step), k, same_label)

    def _visited(self, batch: pa.RecordBatch, k: int, same_label: bool) -> pa.RecordBatch:
        scores = _products(_matrix(batch.column(9)), self.vectors)
        fits = (np.asarray(batch.column(6))[:, None] == self.labels[None]) == same_label
        high, floor = batch.column(7), batch.column(8)
        sizes = np.asarray(high.value_lengths())
        at = np.repeat(np.arange(batch.num_rows), sizes)
        window = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        highs, floors = np.asarray(high.flatten()), np.asarray(floor.flatten())
        rows, columns, found = [], [], []
        step = max(1, CELLS // scores.shape[1])
        for i in range(0, len(at), step):
            some = at[i : i + step]
            mine = scores[some]
            r, c = _first(mine, fits[some] & (mine >= floors[i : i + step, None]) & (mine <= highs[i : i + step, None]), k)
            rows.append(r + i)
            columns.append(c)
            found.append(mine[r, c])
        r, c = np.concatenate(rows), np.concatenate(columns)
        return pa.RecordBatch.from_arrays(
            [batch.column(4).take(pa.array(at[r])), pa.array(window[r], pa.int32()), self.ids.take(pa.array(c)), pa.array(self.rows[c]), pa.array(np.concatenate(found), pa.int64())],
            names=["class_id", "window", "vec_id", "row", "score"],
        )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("class_id", "window").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Index:
    def __init__(self, rows: DataFrame, dim: int, n: int) -> None:
        spark = rows.sparkSession
        size = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // dim))
        # by a hash of the vector: the same rows whatever the partitions are
        sample = rows.select("vector").orderBy(F.xxhash64("vector")).limit(size).toArrow().column(0).combine_chunks()
        centroids = fit_centroids(_matrix(sample), max(1, min(MOST_LISTS, round(n**0.5))))
        given = spark.sparkContext.broadcast(centroids)
        kept = rows.select("vec_id", "row", "label", "vector")
        members = materialize(kept.mapInArrow(_assigner(given), "vec_id long, row long, label long, vector array<double>, list int, away double"), "lists")
        part = max(16, PART_BYTES // (8 * dim))
        told = members.groupBy("list").agg(F.max("away").alias("away"), F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
        radii, parts = np.full(len(centroids), -np.inf), np.zeros(len(centroids), np.int64)
        for r in told.collect():  # a row for each list, MOST_LISTS at most
            radii[r["list"]], parts[r["list"]] = r["away"], r["parts"]
        used = np.flatnonzero(parts > 0)
        self.lists = spark.sparkContext.broadcast(Lists(centroids[used], radii[used], parts[used]))
        places = spark.createDataFrame([(int(x), i, int(parts[x])) for i, x in enumerate(used)], "list int, place int, parts int")
        placed = members.join(F.broadcast(places), "list")
        self.members = placed.select(F.col("place").alias("list"), F.pmod(F.xxhash64("row"), "parts").cast("int").alias("part"), "vec_id", "row", "label", "vector")

    def visit(self, anchors: DataFrame, later: bool, k: int, same_label: bool) -> DataFrame:
        """The first k members of each window of the anchors, from the lists of the first
        visits or of the later ones."""
        planned = anchors.select("class_id", "label", "low", "high", "floor", "vector").mapInArrow(
            _planner(self.lists, later), "list int, part int, class_id long, label long, high array<long>, floor array<long>, vector array<double>"
        )
        visits = materialize(planned, "visits")
        # a part that very many visit has copies, to which they are dealt
        busy = materialize(visits.groupBy("list", "part").agg(F.ceil(F.count(F.lit(1)) / MOST_VISITS).cast("int").alias("slots")), "slots")
        visits = visits.join(busy, ["list", "part"]).withColumn("slot", F.pmod(F.xxhash64("class_id"), "slots").cast("int"))
        members = self.members.join(busy, ["list", "part"]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        none = F.lit(None).cast("array<long>")
        long = lambda x: F.lit(x).cast("long")
        members = members.select("list", "part", "slot", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "row", "label", none.alias("high"), none.alias("floor"), "vector")
        visits = visits.select("list", "part", "slot", F.lit(1).alias("kind"), F.col("class_id").alias("id"), long(0).alias("row"), "label", "high", "floor", "vector")
        dealt = members.unionAll(visits).repartition("list", "part", "slot").sortWithinPartitions("list", "part", "slot", "kind")
        found = dealt.mapInArrow(_scorer(k, same_label), "class_id long, window int, vec_id long, row long, score long")
        return materialize(_best(found, k).drop("rank"), "found")

    def search(self, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
        """class_id, window, vec_id, row, score, rank: the first k of all members for each
        window of the anchors (class_id, label, vector, low and high)."""
        begun = anchors.withColumn("floor", F.col("low"))
        first = self.visit(begun, False, k, same_label)
        full = first.groupBy("class_id", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
        floors = full.groupBy("class_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("kth"))
        raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("kth", i), x)))
        rest = self.visit(anchors.join(floors, "class_id", "left").withColumn("floor", raised), True, k, same_label)
        return materialize(_best(first.unionAll(rest), k), "best")


def _hundredth(p: Column, percent: int, up: bool) -> Column:
    """``percent`` of a score as a whole number, rounded up or down and cut to a long."""
    exact = p.cast("decimal(20,0)") * F.lit(percent).cast("decimal(10,0)") / F.lit(100).cast("decimal(10,0)")
    whole = (F.ceil(exact) if up else F.floor(exact)).cast("decimal(38,0)")
    return F.greatest(F.lit(LEAST).cast("decimal(38,0)"), F.least(whole, F.lit(MOST).cast("decimal(38,0)"))).cast("long")


def mine_hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has the columns vec_id, label (longs), vector (an array of doubles that
    are whole numbers) and is_anchor. Scores are inner products. An anchor's positives
    are the first other rows of its label; for each, the negatives are the first rows
    of other labels with low_percent of its score at least and high_percent at most.
    Higher scores come first, then smaller ids, then rows without an id.

    Rows whose label or vector is null, or whose vector has a null or non-finite
    component, take no part. Shorter vectors are read as if zeros followed, an empty
    one as zeros alone. Repeated rows and ids are rows of their own, so a row's copy
    is one of its positives. A score beyond a long counts as the nearest one. Where an
    anchor has no positive, or a positive no negative in its window (as with every
    negative score), there is no row. Other columns are not read, and an empty table gives no
    row.
    """
    v = F.col("vector")
    usable = v.isNotNull() & F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"), "vector")
    dim = given.agg(F.max(F.size("vector"))).first()[0]
    dim = max(1, dim or 0)
    vector = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vector")))
    vector = F.transform(vector, lambda x: x + F.lit(0.0))  # one zero
    key = ["label", "h1", "h2"]
    rows = given.withColumn("vector", vector).withColumns({"h1": F.xxhash64("vector"), "h2": F.hash("vector"), "row": F.monotonically_increasing_id()})
    rows = materialize(rows, "vectors")
    anchors = rows.where("is_anchor").select("vec_id", "row", *key)
    # the anchor itself may be among the first, so one more
    most = max(positives + 1, negatives)
    copies = Window.partitionBy(*key).orderBy(F.col("vec_id").asc_nulls_last(), "row")
    firsts = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= most).drop("copy")
    firsts = materialize(firsts, "different")
    n = firsts.count()
    classes = rows.where("is_anchor").groupBy(*key).agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("class_id", F.monotonically_increasing_id()), "anchors")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not classes.take(1):
        return vectors.sparkSession.createDataFrame([], schema)
    index = _Index(firsts, dim, n)
    bare = classes.select("class_id", "label", "vector")
    anyone = lambda x: F.array(F.lit(x).cast("long"))
    near = index.search(bare.withColumns({"low": anyone(LEAST), "high": anyone(MOST)}), positives + 1, True)
    told = near.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "row", "score"))).alias("positives"))
    told = materialize(told.withColumn("scores", F.array_distinct("positives.score")), "positives")
    lows = F.transform("scores", lambda p: _hundredth(p, low_percent, True))
    highs = F.transform("scores", lambda p: _hundredth(p, high_percent, False))
    far = index.search(bare.join(told.select("class_id", "scores"), "class_id").withColumns({"low": lows, "high": highs}), negatives, False)
    in_window = far.groupBy("class_id", "window").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("negatives"))
    by_window = in_window.groupBy("class_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "negatives"))).alias("negatives"))
    results = materialize(classes.select(*key, "class_id", "copies").join(told, "class_id").join(by_window, "class_id").drop("class_id"), "mined")
    found = join_counted(anchors, results, key, "copies", rows.count())
    others = F.slice(F.filter("positives", lambda p: p["row"] != F.col("row")), 1, positives)
    pairs = found.select(F.col("vec_id").alias("anchor_id"), "scores", "negatives", F.explode(others).alias("p"))
    at = (F.array_position("scores", F.col("p.score")) - 1).cast("int")
    mined = pairs.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.explode(F.try_element_at("negatives", at)).alias("n"))
    return mined.select("anchor_id", "positive_id", F.col("n.rank").cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))


def embedding_hard_negatives(embeddings: DataFrame) -> DataFrame:
    """``mine_hard_negatives`` over the table of embeddings: components become
    floor(256 * x), anchors are the ids divisible by 100, and the label of ids
    divisible by 7 is one more, modulo 10."""
    label, own = F.col("label").cast("long"), F.col("vec_id").cast("long")
    x = F.col("embedding").cast("array<double>")
    return mine_hard_negatives(
        embeddings.select(
            own.alias("vec_id"),
            F.when(own % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
            F.transform(x, lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c * 256).cast("double")).otherwise(c * 256)).alias("vector"),
            (own % 100 == 0).alias("is_anchor"),
        )
    )

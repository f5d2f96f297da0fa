"""Near-duplicate embeddings by collision counting on sorted projections.

Vectors are projected on many random lines and each projection is sorted. Around
each query a window of fixed width is laid on every line, and the collisions of
each pair are counted. A pair whose count is at least what pairs at the threshold
reach with probability ``RECALL`` is verified in double precision. Only vectors of
one label are compared, and of a small label all of them, in one block.

A larger label is cut into blocks. Each of several tables cuts the sphere by a few
random hyperplanes, as many as bring blocks to about ``BLOCK`` vectors, and there
are as many tables as let a pair at the threshold share a block with probability
``RECALL``; both follow the label's own size. What is dealt to the tables are not
the vectors but sketches: their projections in half a byte each. Collisions counted
on sketches, with windows wider by the rounding, tell which vectors of a block have
partners there, and a checksum of these. Of the tables in which a vector has the
same partners the first will do. Only there it is fetched by id and verified, so
the vectors that are shuffled are those of near-duplicates, about once each.

Equal vectors are one class from the start. Blocks above the bound are cut into
parts, and every two parts meet in a task of their own. A task reports, for each
class, the weight of its links and one edge towards its component, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from factloom.llm.common import join_counted, materialize
from factloom.llm.components import connected_components, local_roots

THRESHOLD, RECALL = 0.93, 0.9999
BLOCK, LINES, SEED = 1024, 32, 99
#: Half a window's width, in deviations of a projected distance at the threshold.
DEVIATIONS = 2
MOST_PLANES = 24
#: Bits of a block's number that hold its table.
TABLE_BITS = 12
#: Pairs verified at once, and queries whose windows are counted at once.
PAIRS, QUERIES = 100_000, 512
#: Width of a sketch's cells, of which there are 16; what is beyond them counts as in the last.
CELL = 1 / 4


def tables_and_planes(n: int, threshold: float, block: int, recall: float) -> tuple[int, int]:
    """Number of tables and of hyperplanes in each, for n vectors of one label."""
    planes = min(max(ceil(log2(max(n, 1) / block)), 0), MOST_PLANES)
    return tables_of(planes, threshold, recall), planes


def tables_of(planes: int, threshold: float, recall: float) -> int:
    """Tables of so many hyperplanes that let a pair at the threshold share a block."""
    together = (1 - acos(threshold) / pi) ** planes
    return 1 if planes == 0 else ceil(log(1 - recall) / log(1 - together))


def window_and_count(threshold: float, lines: int, recall: float) -> tuple[float, int]:
    """Half a window's width, and the least count at which a pair at the
    threshold is found with probability ``recall``."""
    distance = DEVIATIONS * sqrt(2 * (1 - threshold))
    hit = erf(DEVIATIONS / sqrt(2))  # a projected distance is normal
    missed, count = 0.0, 0
    while missed + comb(lines, count) * hit**count * (1 - hit) ** (lines - count) <= 1 - recall:
        missed += comb(lines, count) * hit**count * (1 - hit) ** (lines - count)
        count += 1
    return distance, count


def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    # drawn one after the other, so the first ones are the same whatever their number
    return np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((n, dim)).T


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and vectors of each dimension."""
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        own = np.flatnonzero(sizes == dim)
        yield own, flat[starts[own][:, None] + np.arange(dim)]


def sketches(unit: np.ndarray, lines: int) -> np.ndarray:
    """Cells of the projections, packed 16 to a number."""
    cells = np.clip(np.floor(unit @ _directions(unit.shape[1], lines, SEED + 1) / CELL) + 8, 0, 15).astype(np.int64)
    cells = np.pad(cells, ((0, 0), (0, -lines % 16))).reshape(len(unit), -1, 16)
    return (cells << (4 * np.arange(16))).sum(axis=2)


def cells_of(packed: np.ndarray, lines: int) -> np.ndarray:
    return ((packed[:, :, None] >> (4 * np.arange(16))) & 15).reshape(len(packed), -1)[:, :lines].astype(np.int16)


def block_keys(unit: np.ndarray, tables: int, planes: int) -> np.ndarray:
    """Side of each vector's planes in each table, as numbers."""
    if not planes:
        return np.zeros((len(unit), tables), np.int64)
    weights, keys = 1 << np.arange(planes), np.empty((len(unit), tables), np.int64)
    planes_of = _directions(unit.shape[1], tables * planes, SEED)
    for t in range(tables):
        keys[:, t] = (unit @ planes_of[:, t * planes : (t + 1) * planes] > 0) @ weights
    return keys


STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(lines: int) -> list[str]:
    return [f"w{k}" for k in range(-(-lines // 16))]


def _dealer(threshold: float, recall: float, lines: int):
    """Sketches by block, whose number is a hash of label, size, table and key with
    the table in its last bits; planes tells how many tables there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, planes = (np.asarray(batch.column(c)) for c in range(3))
            for own, vectors in _by_dimension(batch.column(3)):
                unit = _unit(vectors)
                for n in np.unique(planes[own]):
                    mine = planes[own] == n
                    tables = tables_of(int(n), threshold, recall)
                    keys, rows = block_keys(unit[mine], tables, int(n)), own[mine]
                    words = [pa.array(w) for w in sketches(unit[mine], lines).T]
                    for t in range(tables):
                        whose = np.uint64(vectors.shape[1] << 12 | t) * STEP ^ labels[rows].view(np.uint64)
                        block = (_mixed(whose + keys[:, t].view(np.uint64) * STEP) >> np.uint64(TABLE_BITS) << np.uint64(TABLE_BITS)).view(np.int64) | t
                        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(block), *words], names=["class_id", "block", *_words(lines)])

    return run


def candidate_pairs(projected: np.ndarray, half: float, least: int, axis: np.ndarray | None = None, reach: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j that collide in the query-centred windows of ``least`` lines or more.

    projected: positions by vector and line. With ``axis``, positions on one more
    line on which pairs are never more than ``reach`` apart, queries are taken in
    its order and only what lies within their reach is counted.
    """
    n, lines = projected.shape
    small = np.uint16 if n < 1 << 16 else np.uint32
    order = np.argsort(axis, kind="stable") if axis is not None else np.arange(n)
    places = axis[order] if axis is not None else np.zeros(n)
    # on every line the rank of each vector, where its window begins, and its width
    rank, low, width = (np.empty((lines, n), small) for _ in range(3))
    for k, line in enumerate(projected[order].T):
        by = np.argsort(line, kind="stable")
        placed = line[by]
        rank[k, by] = np.arange(n, dtype=small)
        low[k] = np.searchsorted(placed, line - half, "left")
        width[k] = np.searchsorted(placed, line + half, "right") - low[k]
    lefts, rights = [], []
    for a in range(0, n, QUERIES):
        b = min(a + QUERIES, n)
        end = int(np.searchsorted(places, places[b - 1] + reach, "right")) if axis is not None else n
        counts = np.zeros((b - a, end - a), np.uint8 if lines < 256 else np.uint16)
        for k in range(lines):
            # below the window the difference wraps round and is too large as well
            counts += (rank[k, None, a:end] - low[k, a:b, None]) < width[k, a:b, None]
        i, j = np.nonzero(counts >= least)
        later = i < j
        lefts.append(order[a + i[later]])
        rights.append(order[a + j[later]])
    left, right = (np.concatenate([np.empty(0, np.int64), *x]) for x in (lefts, rights))
    return np.minimum(left, right), np.maximum(left, right)


def _widest(unit: np.ndarray) -> np.ndarray:
    """Positions on a line of unit direction along which the vectors spread most."""
    spread = unit - unit.mean(axis=0)
    direction = np.ones(unit.shape[1])
    for _ in range(8):
        direction = spread.T @ (spread @ direction)
        length = np.sqrt(direction @ direction)
        if not length > 0:
            return np.zeros(len(unit))
        direction /= length
    return unit @ direction


def block_links(vectors: np.ndarray, weights: np.ndarray, table: int, planes: int, parts: np.ndarray, threshold: float, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of a block: weight of the others that it is linked to, and
    the first position of its component within the block. A pair counts in the
    first table where it shares a block, and if there are two parts, only across."""
    unit = _unit(vectors)
    half, least = window_and_count(threshold, lines, RECALL)
    projected = unit @ _directions(unit.shape[1], lines, SEED + 1)
    left, right = candidate_pairs(projected, half, least, _widest(unit), half * (1 + 1e-9))
    if parts.min() != parts.max():
        across = parts[left] != parts[right]
        left, right = left[across], right[across]
    linked = np.zeros(len(unit), np.int64)
    lefts, rights = [], []
    keys = block_keys(unit, table, planes) if table else None
    for start in range(0, len(left), PAIRS):
        a, b = left[start : start + PAIRS], right[start : start + PAIRS]
        if table:
            new = ~(keys[a] == keys[b]).any(axis=1)
            a, b = a[new], b[new]
        close = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
        a, b = a[close], b[close]
        np.add.at(linked, a, weights[b])
        np.add.at(linked, b, weights[a])
        lefts.append(a)
        rights.append(b)
    if not lefts:
        return linked, np.arange(len(unit))
    return linked, local_roots(len(unit), np.concatenate(lefts), np.concatenate(rights))


def block_partners(cells: np.ndarray, ids: np.ndarray, parts: np.ndarray, threshold: float, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sketches of a block have partners in it, and if there are two parts, in
    the other one; and a checksum of each one's partners."""
    half, least = window_and_count(threshold, lines, RECALL)
    left, right = candidate_pairs(cells, int(half / CELL) + 1, least)
    if parts.min() != parts.max():
        across = parts[left] != parts[right]
        left, right = left[across], right[across]
    names, sums = _mixed(ids.astype(np.uint64) + STEP), np.zeros(len(ids), np.uint64)
    np.bitwise_xor.at(sums, left, names[right])
    np.bitwise_xor.at(sums, right, names[left])
    found = np.unique(np.concatenate([left, right]))
    return found, sums[found].view(np.int64)


BLOCK_COLUMNS = ("label_code", "dim", "block")


def _by_group(columns: tuple[str, ...], work: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """Run ``work`` on each group of rows; rows come sorted by group."""
    columns = (*columns, "low_part", "high_part")

    def edges(rows: pa.RecordBatch) -> np.ndarray:
        group = np.stack([np.asarray(rows.column(rows.schema.get_field_index(c))).astype(np.int64) for c in columns], axis=1)
        return np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def results(rows: pa.RecordBatch, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a > 1 and (found := work(rows.slice(a, b - a))).num_rows:
                    yield found

        for batch in batches:
            held.append(batch)
            rows = pa.concat_batches(held)
            starts = edges(rows)
            # the last group may go on in the next batch
            if len(starts) > 1:
                yield from results(rows.slice(0, starts[-1]), starts)
            held = [rows.slice(starts[-1])]
        if held and held[0].num_rows:
            rows = pa.concat_batches(held)
            yield from results(rows, np.append(edges(rows), rows.num_rows))

    return run


def _column(rows: pa.RecordBatch, name: str) -> pa.Array:
    return rows.column(rows.schema.get_field_index(name))


def _linker(threshold: float, lines: int):
    def links(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, weights, parts, planes = (np.asarray(_column(rows, c)) for c in ("class_id", "copies", "part", "planes"))
        vectors = np.asarray(_column(rows, "embedding").flatten()).reshape(len(ids), -1)
        linked, root = block_links(vectors, weights, int(_column(rows, "block")[0].as_py()) & ((1 << TABLE_BITS) - 1), int(planes[0]), parts, threshold, lines)
        own = np.flatnonzero(linked)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids[own], linked[own], ids[root[own]])], names=["class_id", "linked", "low"])

    return _by_group(BLOCK_COLUMNS, links)


def _partner_finder(threshold: float, lines: int):
    def partners(rows: pa.RecordBatch) -> pa.RecordBatch:
        cells = cells_of(np.stack([np.asarray(_column(rows, w)) for w in _words(lines)], axis=1), lines)
        found, sums = block_partners(cells, np.asarray(_column(rows, "class_id")), np.asarray(_column(rows, "part")), threshold, lines)
        return pa.RecordBatch.from_arrays([_column(rows, c).take(pa.array(found)) for c in ("class_id", "block")] + [pa.array(sums)], names=["class_id", "block", "partners"])

    return _by_group(("block",), partners)


def _in_groups(rows: DataFrame, keys: tuple[str, ...], block: int, kept: list[str]) -> DataFrame:
    """Rows of blocks dealt to tasks and sorted; a block above the bound is cut into
    parts, and its rows go to one group for each other part and their own."""
    large = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * block), "large-blocks")
    rows = rows.withColumn("parts", F.lit(1))
    if large.take(1):
        rows = rows.join(large.select(*keys, F.ceil(F.col("n") / block).cast("int").alias("p")), list(keys), "left").withColumn("parts", F.coalesce("p", "parts")).drop("p")
    dealt = (
        rows.withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"low_part": F.least("part", "other"), "high_part": F.greatest("part", "other")})
    )
    groups = (*keys, "low_part", "high_part")
    return dealt.select("class_id", *kept, "part", *groups).repartition(*groups).sortWithinPartitions(*groups)


def embedding_links(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, lines: int = LINES, recall: float = RECALL) -> DataFrame:
    """class_id, linked (weight of links found in one task) and low (a class of
    the same component) for classes with columns class_id, label_code, dim,
    copies, embedding."""
    label = ["label_code", "dim"]
    n = F.count(F.lit(1))
    planes = F.least(F.ceil(F.log2(n / F.lit(block))), F.lit(MOST_PLANES)).cast("int")
    # labels of more than two blocks; Spark broadcasts them as long as they are few
    large = materialize(classes.groupBy(*label).agg(n.alias("n"), planes.alias("planes")).where(F.col("n") > 2 * block).drop("n"), "large-labels")
    whole = classes.select("class_id", "copies", "embedding", *label, F.lit(0).cast("long").alias("block"), F.lit(0).alias("planes"))
    if large.take(1):
        sized = classes.join(large, label)
        whole = whole.join(large.select(*label), label, "left_anti")
        words = _words(lines)
        schema = "class_id long, block long, " + ", ".join(f"{w} long" for w in words)
        dealt = materialize(sized.select("class_id", "label_code", "planes", "embedding").mapInArrow(_dealer(threshold, recall, lines), schema), "sketches")
        found = _in_groups(dealt, ("block",), block, words).mapInArrow(_partner_finder(threshold, lines), "class_id long, block long, partners long")
        # a pair counts in the first table that it shares, so where the partners are those of an earlier table nothing new is found
        named = found.groupBy("class_id", "block").agg(F.bit_xor("partners").alias("partners"))
        first = named.groupBy("class_id", "partners").agg(F.min_by("block", F.col("block").bitwiseAND((1 << TABLE_BITS) - 1)).alias("block"))
        near = sized.join(materialize(first.select("class_id", "block"), "partners"), "class_id")
        whole = whole.unionByName(materialize(near.select(*whole.columns), "near"))
    return _in_groups(whole, BLOCK_COLUMNS, block, ["copies", "embedding", "planes"]).mapInArrow(_linker(threshold, lines), "class_id long, linked long, low long")


def near_duplicate_embeddings(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    block: int = BLOCK,
    lines: int = LINES,
) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null labels and equal dimension are compared. A
    vector that is null, empty, zero or has a null or non-finite component, or
    whose label is null, links with nothing and is its own component. Repeated
    rows are vectors of their own, linked with each other. A null id is never a
    component's smallest unless all are null. An empty table gives an empty result.
    Components of floats and doubles are read as they are, others as doubles; vectors
    may have any length. Other columns are not read.
    """
    given = vectors.select(F.col(vector_col)).schema[0].dataType
    single = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType)
    v = F.col(vector_col).cast("array<float>" if single else "array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.when(finite & F.col(label_col).isNotNull(), v).alias("embedding"),
        F.xxhash64(F.col(label_col).cast("string")).alias("label_code"),
    )
    # 96 bits tell different vectors apart
    key = [F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2")]
    usable = rows.where(F.col("embedding").isNotNull()).select("*", *key)
    names = ["label_code", "dim", "h1", "h2"]
    classes = usable.groupBy(*names).agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    classes = materialize(classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    links = materialize(embedding_links(classes, threshold, block, lines), "links")
    weights = links.groupBy("class_id").agg(F.sum("linked").alias("linked"))
    roots = connected_components(links, "low", "class_id").select(F.col("node").alias("class_id"), "root")
    rooted = materialize(classes.select("class_id", "least").join(roots, "class_id"), "roots")
    by_root = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "least")
    known = join_counted(rooted.select("class_id", "root"), by_root, ["root"], "members", rooted.count()).select("class_id", "component_id")
    facts = (
        classes.select(*names, "class_id", "copies", "least")
        .join(weights, "class_id", "left")
        .join(known, "class_id", "left")
        .select(*names, "copies", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    )
    total = classes.agg(F.sum("copies")).first()[0] or 0
    found = join_counted(usable.select("vec_id", *names), materialize(facts, "facts"), names, "copies", total).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("embedding").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

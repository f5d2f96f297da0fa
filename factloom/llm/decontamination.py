"""Benchmark decontamination by winnowed fingerprints.

Both sides are turned into word hashes, k-gram hashes of five words and, for
every window of nine consecutive k-grams (13 words), the minimum k-gram hash.
Equal 13-word windows have equal minima, so a document window whose minimum is
not among the benchmark's fingerprints can hold no benchmark window: the join on
fingerprints misses no shared span of 13 words. Document windows that pass are
extended to their 13 words and compared with the benchmark's windows by 128 bits.
Items of fewer than 13 words are one window each, shorter than what winnowing
guarantees, and are looked up by the hash of their full length.

The benchmark is the stated query set. It is taken in blocks of bounded text
(``BLOCK_BYTES``); each block's index is broadcast and all documents pass by it,
so a passage that any number of documents share never meets in one task. With
one block, the usual case, nothing is shuffled; with more, the spans that the
blocks found are merged by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fresh, gives_back, materialize

WORDS, GRAM = 13, 5
SPAN = WORDS - GRAM + 1
#: Benchmark text that one broadcast index is made from; text hashed at once.
BLOCK_BYTES, SLICE_BYTES = 8_000_000, 2_000_000
FILTER_BITS = 20
#: Stands for a null id: its windows are hits, but it is no item.
NO_ID = -(1 << 63)

_rng = np.random.Generator(np.random.PCG64(7))
#: Hash value of each byte: 0 for bytes that are no part of a word (A-Z as a-z).
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUE[: 0x30] = BYTE_VALUE[0x3A:0x41] = BYTE_VALUE[0x5B:0x61] = BYTE_VALUE[0x7B:0x80] = 0
BYTE_VALUE[0x41:0x5B] = BYTE_VALUE[0x61:0x7B]
IN_WORD = BYTE_VALUE != 0
#: Multipliers by position, of two independent window hashes.
FIRST = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SECOND = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
TOP = np.uint64(64 - FILTER_BITS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of texts that lie end to end in ``data`` (``ends``: byte
    offset after each text), and the number of words up to each text's end."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = np.concatenate([[0], ends[:-1]])
    heads = heads[heads < len(data)]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    rest = data[starts[0] :]
    at = np.arange(len(rest)) - np.repeat(starts - starts[0], np.diff(np.append(starts, len(data))))
    values = BYTE_VALUE[rest]
    longest = int(at[values != 0].max()) + 1
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(longest, STEP, np.uint64)]))
    values *= powers[np.minimum(at, longest)]
    return _mixed(np.add.reduceat(values, starts - starts[0])), np.searchsorted(starts, ends)


def _prefix_sums(words: np.ndarray, up_to: int) -> Iterator[tuple[int, np.ndarray]]:
    """For n = 1 .. up_to, the first hash of the n words at each position."""
    total = np.zeros(len(words), np.uint64)
    for n in range(1, up_to + 1):
        if n <= len(words):
            total[: len(words) - n + 1] += words[n - 1 :] * FIRST[n - 1]
        yield n, total


def _minima(grams: np.ndarray) -> np.ndarray:
    """Minimum of SPAN consecutive values, at each position that has so many."""
    low, width = grams, 1
    while 2 * width <= SPAN:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    short = SPAN - width
    return np.minimum(low[: len(low) - short], low[short:]) if short else low


def _both(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    picked = words[at[:, None] + np.arange(n)]
    return (picked * FIRST[:n]).sum(axis=1, dtype=np.uint64), (picked * SECOND[:n]).sum(axis=1, dtype=np.uint64)


@dataclass
class Lookup:
    """Distinct windows of one length: sorted hashes, and the items that have each."""

    first: np.ndarray
    second: np.ndarray
    bounds: np.ndarray
    items: np.ndarray
    seen: np.ndarray = field(init=False)

    def __post_init__(self):
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(_mixed(self.first) >> TOP).astype(np.int64)] = True

    @classmethod
    def of(cls, first: np.ndarray, second: np.ndarray, items: np.ndarray) -> Lookup:
        order = np.lexsort((items, second, first))
        first, second, items = first[order], second[order], items[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        keep = new.copy()
        keep[1:] |= items[1:] != items[:-1]
        starts = np.flatnonzero(new[keep])
        return cls(first[new], second[new], np.append(starts, keep.sum()), items[keep])

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Number of the window with these hashes, or -1."""
        at = np.searchsorted(self.first, first)
        found = np.full(len(first), -1)
        # equal first hashes of different windows stand side by side
        for _ in range(self.most_alike()):
            ok = (at < len(self.first)) & (found < 0)
            ok[ok] &= (self.first[at[ok]] == first[ok]) & (self.second[at[ok]] == second[ok])
            found[ok] = at[ok]
            at = at + 1
        return found

    def most_alike(self) -> int:
        edges = np.flatnonzero(np.concatenate([[True], self.first[1:] != self.first[:-1], [True]])) if len(self.first) else np.array([0])
        return int(np.diff(edges).max()) if len(edges) > 1 else 0


@dataclass
class Index:
    """What the documents are compared with: one block of the benchmark."""

    prints: np.ndarray
    seen: np.ndarray
    full: Lookup
    short: dict[int, Lookup]
    item_ids: np.ndarray


def build_index(items: list[tuple[int, str]]) -> Index:
    """Index of (item_id, text) pairs; texts without a word add nothing."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for _, t in items]
    data = np.frombuffer(b"".join(coded), np.uint8)
    words, upto = word_hashes(data, np.cumsum([len(c) for c in coded], dtype=np.int64))
    before = np.concatenate([[0], upto[:-1]]) if len(upto) else upto
    sizes = upto - before
    numbers = np.arange(len(items))
    n_windows = np.maximum(sizes - WORDS + 1, 0)
    owner = np.repeat(numbers, n_windows)
    at = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + before[owner]
    grams = next((t for n, t in _prefix_sums(words, GRAM) if n == GRAM), words)
    prints = np.unique(_minima(_mixed(grams))[at]) if len(at) else np.empty(0, np.uint64)
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[(prints >> TOP).astype(np.int64)] = True
    short = {}
    for n in range(1, WORDS):
        if len(own := numbers[sizes == n]):
            short[n] = Lookup.of(*_both(words, before[own], n), own)
    return Index(prints, seen, Lookup.of(*_both(words, at, WORDS), owner), short, np.array([i for i, _ in items], np.int64))


def find_hits(data: np.ndarray, ends: np.ndarray, index: Index) -> tuple[np.ndarray, list[tuple[int, list, list]]]:
    """Word count of each text, and (text, spans of hit words, item ids) of those with hits."""
    words, upto = word_hashes(data, ends)
    before = np.concatenate([[0], upto[:-1]])
    counts = upto - before
    owner = np.repeat(np.arange(len(ends)), counts)
    last = np.repeat(upto, counts)
    hits: list[tuple[np.ndarray, np.ndarray, int, Lookup]] = []

    def look_up(at: np.ndarray, n: int, lookup: Lookup) -> None:
        found = lookup.find(*_both(words, at, n))
        if (found >= 0).any():
            hits.append((at[found >= 0], found[found >= 0], n, lookup))

    if len(words):
        need = max([GRAM if len(index.prints) else 0, *index.short])
        for n, sums in _prefix_sums(words, need):
            if n in index.short:
                likely = index.short[n].seen[(_mixed(sums) >> TOP).astype(np.int64)]
                at = np.flatnonzero(likely)
                look_up(at[at + n <= last[at]], n, index.short[n])
            if n == GRAM and len(index.prints) and len(words) >= WORDS:
                low = _minima(_mixed(sums[: len(words) - GRAM + 1]))
                at = np.flatnonzero(index.seen[(low >> TOP).astype(np.int64)])
                at = at[at + WORDS <= last[at]]
                place = np.minimum(np.searchsorted(index.prints, low[at]), len(index.prints) - 1)
                look_up(at[index.prints[place] == low[at]], WORDS, index.full)
    if not hits:
        return counts, []
    edge = np.zeros(len(words) + 1, np.int64)
    named = []
    for at, window, n, lookup in hits:
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
        pairs = np.unique(np.stack([owner[at], window], axis=1), axis=0)
        own, w = pairs[:, 0], pairs[:, 1]
        each = lookup.bounds[w + 1] - lookup.bounds[w]
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(lookup.bounds[w], each)
        named.append(np.stack([np.repeat(own, each), index.item_ids[lookup.items[place]]], axis=1))
    covered = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
    new_text = np.concatenate([[True], owner[1:] != owner[:-1]])
    begin = np.flatnonzero(covered[1:-1] & (~covered[:-2] | new_text))
    end = np.flatnonzero(covered[1:-1] & (~covered[2:] | np.concatenate([new_text[1:], [True]]))) + 1
    named_ = np.unique(np.concatenate(named), axis=0)
    out = []
    for k in np.unique(owner[begin]):
        i, j = np.searchsorted(owner[begin], [k, k + 1])
        spans = [{"begin": int(a), "end": int(b)} for a, b in zip(begin[i:j] - before[k], end[i:j] - before[k], strict=True)]
        i, j = np.searchsorted(named_[:, 0], [k, k + 1])
        out.append((int(k), spans, [x for x in named_[i:j, 1].tolist() if x != NO_ID]))
    return counts, out


def text_slices(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, end offsets), a few megabytes at a time."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + SLICE_BYTES, "right")) - 1)
        yield start, stop, data[at[start] : at[stop]], at[start + 1 : stop + 1] - at[start]
        start = stop


def _report(index, id_name: str, text_name: str):
    spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_name))
            for start, stop, data, ends in text_slices(batch, text_name):
                counts, hits = find_hits(data, ends, index.value)
                where, items = [[] for _ in counts], [[] for _ in counts]
                for k, s, i in hits:
                    where[k], items[k] = s, i
                yield pa.RecordBatch.from_arrays(
                    [ids[start:stop], pa.array(counts, pa.int64()), pa.array(where, spans), pa.array(items, pa.list_(pa.int64()))],
                    names=["doc_id", "n_words", "spans", "items"],
                )

    return run


REPORT = "doc_id long, n_words long, spans array<struct<begin: long, end: long>>, items array<long>"


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Index]:
    """One index for every block of about ``block_bytes`` of benchmark text."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    items = items.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        yield build_index([(r["id"], r["text"]) for r in part.toLocalIterator()])


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: doc_id, n_words, spans (hit words, as begin and end), items
    (ids of the items that occur), in no particular order.

    Null and empty texts have no words and no hits. Benchmark rows whose text is null
    are left out; windows of rows whose id is null are hits of no item; an id with
    several texts has the windows of each.
    Every row of a repeated id is judged on its own text. Empty tables give no
    rows or no hits. Other columns are not read.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return docs.mapInArrow(_report(spark.sparkContext.broadcast(first), "doc_id", "text"), REPORT)
    kept = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "documents")
    found = None
    for index in (i for more in ([first, second], blocks) for i in more):
        part = kept.select("row", "text").mapInArrow(_report(spark.sparkContext.broadcast(index), "row", "text"), REPORT)
        part = materialize(part.where(F.size("spans") > 0), "hits")
        found = part if found is None else found.union(part)
    # a row has one entry for each block at most
    merged = found.groupBy(F.col("doc_id").alias("row")).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    none = spark.sparkContext.broadcast(build_index([]))
    counts = kept.select("row", "text").mapInArrow(_report(none, "row", "text"), REPORT).select(F.col("doc_id").alias("row"), "n_words")
    return (
        kept.select("doc_id", "row")
        .join(counts, "row")
        .join(merged, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("spans", F.from_json(F.lit("[]"), "array<struct<begin: long, end: long>>")).alias("spans"),
            F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        )
    )


def covered_words(spans: Column) -> Column:
    """Number of words in the union of spans that may overlap."""
    zero = F.lit(0).cast("long")
    return F.aggregate(
        F.array_sort(spans),
        F.struct(zero.alias("end"), zero.alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            (acc["n"] + F.greatest(zero, s["end"] - F.greatest(acc["end"], s["begin"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def contamination_digest(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``find_contamination`` as counts, a digest of the item ids and a verdict."""
    found = find_contamination(documents, benchmark, **options).withColumn("n_hit", covered_words(F.col("spans")))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def _filter(index, text_name: str):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, ends in text_slices(batch, text_name):
                counts, hits = find_hits(data, ends, index.value)
                clean = np.ones(stop - start, bool)
                for k, spans, _ in hits:
                    clean[k] = 20 * sum(s["end"] - s["begin"] for s in spans) < counts[k]
                yield batch.slice(start, stop - start).filter(pa.array(clean))

    return run


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with their columns as they are.

    Null and empty texts have no words and stay; a document of which just a
    twentieth is hit goes. Long texts count whole. Rows of null or repeated ids are
    judged each on its own text, and columns may have any name. An empty table, or
    an empty benchmark, changes nothing; benchmark rows are as in
    ``find_contamination``.
    """
    spark = documents.sparkSession
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    first = next(blocks)
    if next(blocks, None) is None:
        return documents.mapInArrow(_filter(spark.sparkContext.broadcast(first), text_col), documents.schema)
    row = fresh(documents.columns, "_row")
    kept = materialize(documents.withColumn(row, F.monotonically_increasing_id()), "documents")
    found = contamination_digest(kept, benchmark, id_col=row, text_col=text_col, item_col=item_col, item_text_col=item_text_col, block_bytes=block_bytes)
    bad = found.where("contaminated").select(F.col("doc_id").alias(row))
    return kept.join(bad, row, "left_anti").drop(row)

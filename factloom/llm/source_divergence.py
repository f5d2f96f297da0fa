"""Source divergence audit: how differently the sources of a language use its terms.

Every partition counts its terms in a radix trie of bytes whose leaves hold a counter
for each source. A trie is kept and handed on as its traversal, which is sorted by
UTF-8: so tries are merged by dealing the leaves out by ranges of prefixes and adding
up equal ones, and no task ever holds more than its range. The merged leaves
are traversed once more: each gives its part of the sums for pairs of sources and its
candidates for the terms that a source has more of than its language.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import gives_back, materialize, text_parts

#: Documents of a language that a kept term is in, terms reported for a group, and the smoothing.
LEAST_DOCS, TOP_TERMS, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
#: UTF-8 bytes read at once, those of a piece of a long text, and leaves that a task hands on together.
SLICE_BYTES, CHUNK, MOST_LEAVES = 4_000_000, 1 << 22, 1_000_000
ROWS = 1 << 15
#: Sums for pairs that a task holds, and probabilities that it computes at once.
MOST_CELLS, CELLS = 1 << 22, 1 << 20
#: Up to this denominator long division by steps of a thousand stays within 64 bits.
EXACT = 9 * 10**15

#: A-Z become small, other letters stay, all else parts terms.
_TERM_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


class Trie:
    """A radix trie of terms whose leaves have counters (documents, occurrences) by source.

    It is kept as its traversal: the leaves of all languages in the order of language
    and UTF-8, in columns. A node is the run of leaves that share a prefix, its
    branches are the runs within, so tries merge by adding up equal leaves, and any
    range of prefixes can be cut out of one.
    """

    COLUMNS = ("lang", "term", "source")

    def __init__(self, leaves: pa.Table) -> None:
        self.leaves = leaves

    @classmethod
    def merged(cls, tries: list[pa.Table]) -> "Trie":
        told = pa.concat_tables(tries).group_by(list(cls.COLUMNS), use_threads=False).aggregate([("docs", "sum"), ("n", "sum")])
        return cls(told.rename_columns([*cls.COLUMNS, "docs", "n"]))

    def traverse(self) -> pa.Table:
        return self.leaves.sort_by([(c, "ascending") for c in self.COLUMNS])


def _leaves(langs: list[str], sources: list[str], terms: pa.Array, docs: np.ndarray, n: np.ndarray) -> pa.Table:
    columns = [pa.array(langs, pa.string()), terms, pa.array(sources, pa.string()), pa.array(docs, pa.int64()), pa.array(n, pa.int64())]
    return pa.table(columns, names=[*Trie.COLUMNS, "docs", "n"])


def _terms(text: pa.Array) -> pa.ListArray:
    """The terms of some texts, given as UTF-8; among them empty strings."""
    start, stop = (text.offset, text.offset + len(text)) if len(text) else (0, 0)
    offsets = np.frombuffer(text.buffers()[1], np.int32)[start : stop + 1] if len(text) else np.zeros(1, np.int32)
    data = text.buffers()[2]
    small = _TERM_BYTES[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
    plain = pa.StringArray.from_buffers(len(text), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(small))
    return pc.ascii_split_whitespace(plain)


def count_terms(langs: list[str], sources: list[str], text: pa.Array) -> pa.Table:
    """The leaves of some documents; the empty term stands for the documents of a group."""
    split = _terms(text)
    flat = split.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(text)), np.asarray(split.value_lengths()))
    term = np.asarray(flat.indices).astype(np.int64)
    words, size = flat.dictionary, max(1, len(flat.dictionary))
    groups = {g: i for i, g in enumerate(dict.fromkeys(zip(langs, sources)))}
    group = np.array([groups[g] for g in zip(langs, sources)], np.int64)
    pairs, n = np.unique(doc * size + term, return_counts=True)
    found, at, docs = np.unique(group[pairs // size] * size + pairs % size, return_inverse=True, return_counts=True)
    taken = words.take(pa.array(found % size))
    real = np.asarray(pc.not_equal(taken, "")) if len(taken) else np.zeros(0, bool)
    names, which = list(groups), (found // size)[real]
    total = np.bincount(at, n, len(found)).astype(np.int64)[real]
    of = lambda k: [g[k] for g in names]
    leaves = _leaves(np.array(of(0), object)[which].tolist(), np.array(of(1), object)[which].tolist(), taken.filter(pa.array(real)), docs[real], total)
    own = _leaves(of(0), of(1), pa.array([""] * len(names), pa.string()), np.bincount(group, minlength=len(names)), np.zeros(len(names), np.int64))
    return pa.concat_tables([leaves, own])


def _count_long(lang: str, source: str, text: pa.Array) -> pa.Table:
    """The leaves of one long text, a piece at a time; the document counts once for each term."""
    whole, tables, start = text[0].as_buffer().to_pybytes(), [], 0
    while start < len(whole):
        end = start + CHUNK
        while end < len(whole) and _TERM_BYTES[whole[end]] != 32:
            end += 1
        tables.append(count_terms([lang], [source], pa.array([whole[start:end]], pa.binary()).cast(pa.string())))
        if len(tables) == 16:
            tables = [Trie.merged(tables).leaves]
        start = end
    once = Trie.merged(tables).leaves
    return once.set_column(3, "docs", pa.array(np.ones(len(once), np.int64)))


@gives_back
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: list[pa.Table] = []
    size = 0
    for batch in batches:
        for part in text_parts(batch, "text", SLICE_BYTES):
            langs, sources, text = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)
            long = part.num_rows == 1 and len(text[0].as_buffer()) > 2 * CHUNK
            tables.append(_count_long(langs[0], sources[0], text) if long else count_terms(langs, sources, text))
            size += len(tables[-1])
            if size >= 2 * MOST_LEAVES:
                trie = Trie.merged(tables)
                if len(trie.leaves) >= MOST_LEAVES:
                    yield from trie.traverse().to_batches(ROWS)
                    tables, size = [], 0
                else:
                    tables, size = [trie.leaves], len(trie.leaves)
    if tables:
        yield from Trie.merged(tables).traverse().to_batches(ROWS)


def source_leaves(documents: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Leaves of all partitions' tries: lang, term, source, docs, n; the same leaf may
    come from many partitions. The empty term stands for the documents of a group."""
    given = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    return documents.select(*given).mapInArrow(_count, "lang string, term string, source string, docs long, n long")


def merge_leaves(leaves: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The kept terms: lang, term, n (occurrences) and counters, an array of source
    and n, in the order of lang and term within ranges of prefixes. Both sums are made
    where the one exchange has put the leaves."""
    ranged = leaves.where(F.col("term") != "").repartitionByRange("lang", "term")
    by_source = ranged.groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    merged = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("counters"))
    return merged.where(F.col("docs") >= least_docs).drop("docs").sortWithinPartitions("lang", "term")


def _shares(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / below), exactly; counts are at most below."""
    if below.max(initial=1) > EXACT:
        return 1 + SCALE * counts.astype(object) // below.astype(object)
    found, rest = np.zeros_like(counts), counts
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // below
        rest = rest % below
    return 1 + found


class _Language:
    """Sums and candidates of a language's terms for one block of its sources."""

    def __init__(self, lang: str, groups: list[dict], total: int, n_terms: int, block: int) -> None:
        self.lang, self.names = lang, [g["source"] for g in groups]
        self.at = {name: i for i, name in enumerate(self.names)}
        self.below = np.array([g["n"] for g in groups], np.int64) + SMOOTH * n_terms
        self.below_all = np.array([total + SMOOTH * n_terms])
        rows = rows_of_block(len(groups))
        self.block = range(block * rows, min(len(groups), (block + 1) * rows))
        self.sums = np.zeros((len(self.block), len(groups)), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in self.block]

    def add(self, terms: list[bytes], totals: list[int], counters: list[list[dict]]) -> None:
        size = max(1, CELLS // len(self.names))
        for i in range(0, len(terms), size):
            self._add(terms[i : i + size], totals[i : i + size], counters[i : i + size])

    def _add(self, terms: list[bytes], totals: list[int], counters: list[list[dict]]) -> None:
        n = np.zeros((len(terms), len(self.names)), np.int64)
        for i, found in enumerate(counters):
            for c in found:
                n[i, self.at[c["source"]]] = c["n"]
        p = _shares(n + SMOOTH, self.below)
        q = _shares(np.array(totals, np.int64) + SMOOTH, self.below_all)
        for k, j in enumerate(self.block):
            self.sums[k] += np.abs(p - p[:, j : j + 1]).sum(0).astype(np.int64)
            more = (p[:, j] - q).astype(np.int64)
            which = np.flatnonzero((n[:, j] > 0) & (more > 0))
            if len(which) > TOP_TERMS:
                which = which[more[which] >= np.partition(more[which], -TOP_TERMS)[-TOP_TERMS]]
            self.best[k] = heapq.nsmallest(TOP_TERMS, self.best[k] + [(-int(more[i]), terms[i]) for i in which])

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = np.array(self.names, object)
        for k, j in enumerate(self.block):
            others = np.flatnonzero(np.arange(len(names)) != j)
            items = [*names[others], *(term.decode() for _, term in self.best[k])]
            values = [*self.sums[k, others].tolist(), *(-v for v, _ in self.best[k])]
            parts = ["pair"] * len(others) + ["term"] * len(self.best[k])
            same = lambda x: pa.array([x] * len(items), pa.string())
            yield pa.RecordBatch.from_arrays(
                [same(self.lang), same(self.names[j]), pa.array(parts, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())],
                names=["lang", "source", "part", "item", "value"],
            )


def rows_of_block(n_sources: int) -> int:
    return max(1, MOST_CELLS // max(1, n_sources))


def _traverser(block: int) -> Callable:
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Language | None = None
        for batch in batches:
            langs = batch.column(0).to_pylist()
            starts = [i for i in range(len(langs)) if not i or langs[i] != langs[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(langs)]):
                if now is None or now.lang != langs[start]:
                    if now is not None:
                        yield from now.rows()
                    groups, total, n_terms = (batch.column(c)[start].as_py() for c in (4, 5, 6))
                    now = _Language(langs[start], groups, total, n_terms, block)
                terms = batch.column(1).slice(start, end - start).cast(pa.binary()).to_pylist()
                now.add(terms, batch.column(2).slice(start, end - start).to_pylist(), batch.column(3).slice(start, end - start).to_pylist())
        if now is not None:
            yield from now.rows()

    return run


def _ranked(rows: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))


def source_divergence(documents: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: for each group of a language and a
    source its distance to every other source of the language (part ``pair``) and the
    TOP_TERMS terms that it has most more of than the language (part ``term``).

    A null text, language or source is read as an empty one, so documents without
    a source are a group; a group without a term has pairs. Rows with null or repeated
    ids are documents of their own, as ids are not read. A language with one source
    has no pair, and one without a kept term has pairs of value 0 and no term. Equal
    values are ranked by the items' UTF-8. Texts of any length are read whole, a piece
    at a time, but for the set of their different terms. Other columns are not read.
    An empty table gives no row.

    A task holds a block of the table of pairs of a language, MOST_CELLS at most, and
    the terms are traversed once for each block: one block does up to 2,048 sources.
    """
    leaves = materialize(source_leaves(documents, lang_col, source_col, text_col), "leaves")
    merged = materialize(merge_leaves(leaves, least_docs), "terms")
    groups = leaves.where(F.col("term") == "").select("lang", "source").distinct()
    kept = merged.select("lang", F.explode("counters").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    counted = groups.join(kept, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    sizes = merged.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_terms"))
    by_lang = counted.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups")).join(sizes, "lang", "left")
    by_lang = materialize(by_lang, "languages")
    most = by_lang.agg(F.max(F.size("groups"))).first()[0] or 1
    joined = merged.join(by_lang.where(F.col("n_terms").isNotNull()), "lang").select("lang", "term", "n", "counters", "groups", "total", "n_terms")
    schema = "lang string, source string, part string, item string, value long"
    passes = [joined.mapInArrow(_traverser(k), schema) for k in range(-(-most // rows_of_block(most)))]
    told = materialize(reduce(DataFrame.unionAll, passes), "divergences")
    bare = by_lang.where(F.col("n_terms").isNull()).select("lang", F.explode("groups.source").alias("source"), F.col("groups.source").alias("items"))
    bare = bare.select("lang", "source", F.explode("items").alias("item"), F.lit(0).cast("long").alias("value")).where(F.col("source") != F.col("item"))
    pairs = told.where(F.col("part") == "pair").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(bare)
    terms = told.where(F.col("part") == "term")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumns({"part": F.lit("pair"), "rank": _ranked(pairs)}).select(*columns)
    terms = terms.withColumn("rank", _ranked(terms)).where(F.col("rank") <= TOP_TERMS).select(*columns)
    return pairs.unionByName(terms)

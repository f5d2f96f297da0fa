"""SimHash near-duplicates by a hierarchical index in Gray order.

Few fingerprints are one group. More are dealt into groups of about ``TARGET``:
fingerprints that differ in at most two of 64 bits agree on one of three parts of
the bits, so each goes to three groups, by the value of the first bits of each
part, as many as the number of fingerprints asks for. In a group the fingerprints
are sorted by Gray rank, which puts similar ones side by side, and a tree is
built over runs of them: a node keeps the bits that all below it share, less
those that its parent has already. A search adds up the differences on its way
down and drops a whole subtree once they exceed the limit; at the leaves the sum
is the exact distance. Groups above ``GROUP`` are split by one of three parts of
the bits left, again and again, which loses no link and bounds every group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fresh, gives_back, join_counted, materialize
from factloom.llm.components import connected_components, local_roots

SHINGLE, LIMIT, SEED = 3, 2, 42
#: Fingerprints that a group is meant to have and has at most before it is split, and children of a node.
TARGET, GROUP, FAN = 4096, 20_000, 8
#: Dropped rows (16 bytes each) whose keys are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 2_000_000
#: Pairs of query and node that are held at once; UTF-8 bytes hashed at once.
FRONTIER, SLICE_BYTES = 250_000, 2_000_000
ALL_BITS = (1 << 64) - 1


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of every shingle of ``SHINGLE`` words; of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(len(words) - SHINGLE + 1, 1)
    parts = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [words]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(SEED)), np.uint64, n)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """SimHash of each text: a bit is 1 if over half of the hashes have it."""
    hashes = [shingle_hashes(t) for t in texts]
    sizes = np.array([len(h) for h in hashes])
    out = np.zeros(len(texts), np.uint64)
    own = np.flatnonzero(sizes)
    if not len(own):
        return out
    flat = np.concatenate([hashes[i] for i in own])
    sizes = sizes[own]
    heads = np.cumsum(sizes) - sizes
    # counts are kept in bytes, eight bits of the fingerprint to a word, for 255 hashes at most
    blocks = -(-sizes // 255)
    place = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat(heads, blocks) + 255 * place
    first = np.cumsum(blocks) - blocks
    lanes = np.uint64(0x0101010101010101)
    for k in range(8):
        counts = np.add.reduceat((flat >> np.uint64(k)) & lanes, starts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(counts.astype(np.int64), first, axis=0)
        bits = 2 * counts > sizes[:, None]
        for byte in range(8):
            out[own] |= bits[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


@gives_back
def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary()).fill_null(b"")
        ends = np.cumsum([len(t) for t in texts.to_pylist()] if len(texts) < 2 else np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]))
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES, "right")))
            found = fingerprints(texts[start:stop].to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i)[start:stop] for i in (0, 1)), pa.array(found)], names=["doc_id", "text_hash", "fingerprint"])
            start = stop


def document_fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and the signed 64-bit fingerprint of every row."""
    text = F.col(text_col).cast("string")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, text_hash long, fingerprint long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of a code in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code ^ (code >> np.uint64(shift))
    return code


def near_pairs(codes: np.ndarray, groups: np.ndarray, limit: int = LIMIT, fan: int = FAN, visited: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of one group that differ in ``limit`` bits at most.
    ``visited`` gets the number of nodes that were compared, level by level."""
    order = np.lexsort((gray_rank(codes), groups))
    codes, groups = codes[order], groups[order]
    edge = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(edge, len(codes)))
    # levels from the leaves up: bits that all share, their values, children, last leaf below
    both, either = codes, codes
    levels = [{"mask": np.full(len(codes), ALL_BITS, np.uint64), "value": codes, "last": np.arange(len(codes))}]
    own_first, own_size = edge, sizes
    while own_size.max() > 1:
        parents = -(-own_size // fan)
        place = np.arange(parents.sum()) - np.repeat(np.cumsum(parents) - parents, parents)
        starts = np.repeat(own_first, parents) + fan * place
        ends = np.append(starts[1:], len(both))
        both, either = np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(either, starts)
        mask = ~(both ^ either)
        below = levels[-1]
        below["rest"] = below["mask"] & ~np.repeat(mask, ends - starts)
        levels.append({"mask": mask, "value": both & mask, "first": starts, "end": ends, "last": below["last"][ends - 1]})
        own_size = parents
        own_first = np.cumsum(parents) - parents
    levels[-1]["rest"] = levels[-1]["mask"]
    root = np.repeat(np.arange(len(edge)), sizes)
    # as many queries at a time as keep the frontier small even if nothing is pruned
    work = np.cumsum(np.repeat(sizes, sizes))
    lefts, rights, start = [], [], 0
    while start < len(codes):
        stop = max(start + 1, int(np.searchsorted(work, (work[start - 1] if start else 0) + FRONTIER, "right")))
        query, node = np.arange(start, stop), root[start:stop]
        apart = np.zeros(len(query), np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            level = levels[depth]
            if visited is not None:
                visited.append(len(query))
            apart = apart + np.bitwise_count((codes[query] ^ level["value"][node]) & level["rest"][node])
            near = (apart <= limit) & (level["last"][node] > query)
            query, node, apart = query[near], node[near], apart[near]
            if depth:
                n = level["end"][node] - level["first"][node]
                child = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - level["first"][node], n)
                query, apart, node = np.repeat(query, n), np.repeat(apart, n), child
        lefts.append(query)
        rights.append(node)
        start = stop
    return order[np.concatenate(lefts)], order[np.concatenate(rights)]


@gives_back
def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole groups; rows come sorted by group. Of the pairs in a task a
    spanning forest is kept, so that a dense group gives no more rows than it has."""
    held = np.empty((0, 3), np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        left, right = near_pairs(np.ascontiguousarray(rows[:, 2]).view(np.uint64), np.cumsum(new))
        root = local_roots(len(rows), left, right)
        own = np.flatnonzero(root != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array(rows[root[own], 2]), pa.array(rows[own, 2])], names=["low", "high"])

    for batch in batches:
        rows = np.stack([np.asarray(c) for c in batch.columns], axis=1)
        held = np.concatenate([held, rows]) if len(held) else rows
        if len(held) and len(held) >= 4096:
            new = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(axis=1))
            if len(new):
                yield links(held[: new[-1] + 1])
                held = held[new[-1] + 1 :]
    if len(held):
        yield links(held)


def _parts(free: int) -> list[int]:
    """Masks of three parts of the free bits."""
    bits = [b for b in range(64) if free >> b & 1]
    n = len(bits)
    cut = [bits[: -(-n // 3)], bits[-(-n // 3) : -(-n // 3) - (-(n - (-(-n // 3))) // 2)], bits[-(-n // 3) - (-(n - (-(-n // 3))) // 2) :]]
    return [sum(1 << b for b in part) for part in cut if part]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _first_bits(mask: int, n: int) -> int:
    return sum(1 << b for b in [b for b in range(64) if mask >> b & 1][:n])


def fingerprint_links(codes: DataFrame, group: int = GROUP, target: int = TARGET) -> DataFrame:
    """Links (low, high) that connect every two fingerprints at two bits or fewer.

    ``codes`` has distinct fingerprints in the column fingerprint.
    """
    rows = materialize(codes.select(F.col("fingerprint").alias("code")), "codes")
    bits = min(max(ceil(log2(max(rows.count(), 1) / target)), 0), 21)
    # one group of all, or three parts of the bits of which no pair can differ in each
    masks = [_first_bits(part, bits) for part in _parts(ALL_BITS)] if bits else [0]
    rows = rows.select(F.explode(F.array(*(F.lit(_signed(m)).cast("long") for m in masks))).alias("mask"), "code")
    found = None
    while True:
        rows = materialize(rows.select("mask", F.col("mask").bitwiseAND(F.col("code")).alias("value"), "code"), "codes")
        large = materialize(rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).drop("n"), "large-groups")
        fixed = max(bin(m).count("1") for m in masks)
        split = bool(large.take(1)) and (64 - fixed) > 12
        small = rows.join(large, ["mask", "value"], "left_anti") if split else rows
        dealt = small.repartition("mask", "value").sortWithinPartitions("mask", "value")
        part = dealt.mapInArrow(_link_batches, "low long, high long")
        found = part if found is None else found.union(part)
        if not split:
            return found
        rows = rows.join(large, ["mask", "value"], "left_semi").select("mask", "code")
        present = {r["mask"] & ALL_BITS for r in large.select("mask").distinct().collect()}
        children = {m: [m | p for p in _parts(ALL_BITS & ~m)] for m in masks if m in present}
        masks = [c for cs in children.values() for c in cs]
        choice = F.create_map(*(x for m, cs in children.items() for x in (F.lit(_signed(m)).cast("long"), F.array(*(F.lit(_signed(c)).cast("long") for c in cs)))))
        rows = rows.select(F.explode(choice[F.col("mask")]).alias("mask"), "code")


def fingerprint_components(prints: DataFrame) -> DataFrame:
    """fingerprint and root of every fingerprint that is linked to another one."""
    links = fingerprint_links(prints.select("fingerprint").distinct())
    return connected_components(links, "low", "high").select(F.col("node").alias("fingerprint"), "root")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits) and component_id, the
    smallest doc_id that can be reached by links, its own included.

    Texts without words, null ones too, have fingerprint zero and are linked like
    any other. A null id never is a component's smallest unless all are null; a
    repeated id is one row each. An empty table gives an empty result. Other
    columns are not read.
    """
    prints = materialize(document_fingerprints(documents, id_col, text_col).select("doc_id", "fingerprint"), "fingerprints")
    classes = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    known = _with_component(classes, "least", "component_id")
    found = join_counted(prints, known, ["fingerprint"], "n", prints.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _with_component(classes: DataFrame, value: str, name: str) -> DataFrame:
    """fingerprint, n and the least ``value`` of each fingerprint's component."""
    rooted = materialize(classes.join(fingerprint_components(classes), "fingerprint"), "roots")
    by_root = materialize(rooted.groupBy("root").agg(F.min(value).alias(name), F.count(F.lit(1)).alias("members")), "least")
    linked = join_counted(rooted.select("fingerprint", "root"), by_root, ["root"], "members", rooted.count()).select("fingerprint", name)
    return materialize(classes.join(linked, "fingerprint", "left").select("fingerprint", "n", F.coalesce(name, value).alias(name)), "known")


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One document of each component, the one with the smallest id, with its
    columns as they are.

    A null id comes last; of equal ids the text with the least hash stays, and of
    rows that repeat id and text the one that is least as JSON, so the choice is
    always the same. Null, empty and blank texts have fingerprint zero and are
    linked like any other; long texts count whole. Columns may have any name. An
    empty table stays empty.

    Texts stay where they are as long as the keys of the dropped rows are
    ``most_broadcast`` at most; beyond that they are joined by a shuffle.
    """
    prints = materialize(document_fingerprints(documents, id_col, text_col), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
    classes = materialize(prints.groupBy("fingerprint").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    known = _with_component(classes, "first", "kept")
    placed = join_counted(prints, known, ["fingerprint"], "n", prints.count())
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & F.col("text_hash").eqNullSafe(F.col("kept.text_hash"))
    counted = materialize(placed.groupBy("doc_id", "text_hash").agg(F.bool_or(stays).alias("stays"), F.count(F.lit(1)).alias("copies")), "decided")
    id_name, hash_name = (fresh(documents.columns, c) for c in ("kept_id", "kept_hash"))
    key = [F.col("doc_id").alias(id_name), F.col("text_hash").alias(hash_name)]
    same = F.col(id_col).cast("long").eqNullSafe(F.col(id_name)) & F.xxhash64(F.col(text_col).cast("string")).eqNullSafe(F.col(hash_name))
    gone, twice = counted.where("not stays").select(*key), counted.where("stays and copies > 1").select(*key)
    small = gone.count() <= most_broadcast
    chosen = documents.join(F.broadcast(gone), same, "left_anti") if small else documents.join(counted.where("stays").select(*key), same, "left_semi")
    if not twice.take(1):
        return chosen
    small = twice.count() <= most_broadcast
    twice = F.broadcast(twice) if small else twice
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    merged = chosen.join(twice, same, "left_semi").groupBy(F.col(id_col).cast("long").alias("i"), F.xxhash64(F.col(text_col).cast("string")).alias("h")).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return chosen.join(twice, same, "left_anti").unionByName(merged.select("row.*"))

"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is made. A text is parsed
against it greedily: each phrase is the longest match of what follows, so a text
of the same language needs few, long phrases. The phrase count times the bits of
a pointer into the labelled text, per symbol, is the cross-entropy; the language
with the least wins.

Texts become symbols first: every letter that any labelled text has is a symbol of
its own, in small form; so are any run of other characters, as a boundary, and
all letters that no labelled text has. A parse needs only the automaton's forward
transitions and a restart at the root, so it runs as look-ups over many blocks of
text in step. Most states have one transition, so the transitions of all states
are laid over each other in one array (row displacement), each with the state
that owns it: its size follows the labelled text, not the alphabet. Blocks hold
``BLOCK`` symbols; a text of any length is the sum of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import gives_back, text_parts

BLOCK = 256
#: Bounds of the labelled sample: documents of each language, characters of each
#: document, symbols of each automaton, and documents and symbols of all languages
#: together, which are shared out evenly where there are very many.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_SYMBOLS = 64, 4096, 40_000
ALL_DOCS, ALL_SYMBOLS = 16_384, 4_000_000
#: UTF-8 bytes parsed at once.
SLICE_BYTES = 1_000_000
UNKNOWN = "und"
BOUNDARY, OTHER = 0, 1
#: Places that are tried at once for a state's transitions.
SEARCH = 2048
#: How many symbols' worth of evidence the score may rest on.
SCORE_SYMBOLS = 60


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``symbols``, state 0 the root."""
    steps: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for c in symbols:
        new = len(steps)
        steps.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return steps


class Automaton:
    """Transitions of all states in one array: that of state s by symbol c, if there
    is one, is at ``base[s] + c``, with s as its owner."""

    def __init__(self, symbols: list[int], width: int):
        steps = automaton(symbols)
        self.base = np.full(len(steps), width, np.int32)
        size = sum(map(len, steps))
        free = np.ones(4 * size + 8 * width + 2 * SEARCH, bool)
        owner, to = np.full(len(free), -1, np.int32), np.zeros(len(free), np.int32)
        # the widest rows first; where most of a stretch is taken the search moves on
        low = width
        for state in sorted((i for i, s in enumerate(steps) if len(s) > 1), key=lambda i: -len(steps[i])):
            own = np.sort(np.fromiter(steps[state], np.int64))
            start = low
            while True:
                if start + SEARCH + width > len(free):
                    free, owner, to = np.append(free, free | True), np.append(owner, np.full_like(owner, -1)), np.append(to, np.zeros_like(to))
                fits = free[start : start + SEARCH].copy()
                for gap in (own[1:] - own[0]).tolist():
                    fits &= free[start + gap : start + gap + SEARCH]
                at = int(fits.argmax())
                if fits[at]:
                    break
                start += SEARCH
            if start + at > low + SEARCH // 2:
                low += SEARCH // 4
            at += start - int(own[0])
            self.base[state] = at
            free[at + own] = False
            owner[at + own], to[at + own] = state, [steps[state][int(c)] for c in own]
        single = [(i, *next(iter(s.items()))) for i, s in enumerate(steps) if len(s) == 1]
        if single:
            state, c, target = np.array(single, np.int64).T
            place = width + np.flatnonzero(free[width:])[: len(single)]
            self.base[state], owner[place], to[place] = place - c, state, target
        used = int(np.flatnonzero(owner >= 0).max(initial=0)) + 1
        cell = np.full(used + width + 1, np.int64(-1) << 32, np.int64)
        cell[:used] = (owner[:used].astype(np.int64) << 32) | to[:used]
        self.cell = cell
        self.root = np.zeros(width, np.int32)
        for c, target in steps[0].items():
            self.root[c] = target
        self.bits = float(np.log2(max(len(symbols), 2)))

    def phrases(self, steps: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """Phrases of each lane of symbols; ``lanes``: how many go on at each step,
        the longest ones first."""
        state, total = np.zeros(steps.shape[1], np.int32), np.zeros(steps.shape[1], np.int32)
        for column, k in zip(steps, lanes, strict=True):
            c, now = column[:k], state[:k]
            cell = self.cell[self.base[now] + c]
            stays = (cell >> 32) == now
            new = np.where(stays, cell.astype(np.int32), self.root[c])
            # a phrase ends where the match can't go on, and at once if it can't begin
            total[:k] += (~stays & (now > 0)) + (new == 0).view(np.int8)
            state[:k] = new
        return total + (state > 0)


class Model:
    """Automata by language, over one alphabet of all letters that the samples have."""

    def __init__(self, samples: dict[str, list[str]], symbols: int = SAMPLE_SYMBOLS):
        self.languages = sorted(samples)
        self.alphabet = sorted({c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()})
        width = len(self.alphabet) + 2
        symbols = max(1, min(symbols, ALL_SYMBOLS // max(len(samples), 1)))
        self.automata = [Automaton(self.symbols("\n".join(samples[name]))[:symbols].tolist(), width) for name in self.languages]

    def _codes(self) -> np.ndarray:
        if not hasattr(self, "of_code"):
            small = np.int16 if len(self.alphabet) < 1 << 14 else np.int32
            self.of_code = np.where(_letters(), OTHER, BOUNDARY).astype(small)
            self.of_code[[ord(c) for c in self.alphabet]] = np.arange(len(self.alphabet)) + 2
        return self.of_code

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "of_code"}

    def symbols(self, text: str) -> np.ndarray:
        found = self._codes()[codes(text)]
        if not len(found):
            return found
        keep = found != BOUNDARY
        keep[1:] |= found[:-1] != BOUNDARY
        return found[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of symbols of each text (0: no letter), and phrases by text and language."""
        rows = [self.symbols(t) for t in texts]
        rows = [r if (r != BOUNDARY).any() else r[:0] for r in rows]
        sizes = np.array([len(r) for r in rows], np.int64)
        blocks = -(-sizes // BLOCK)
        counts = np.zeros((len(texts), len(self.languages)))
        if not blocks.sum():
            return sizes, counts
        # one lane for each block, the longest first
        owner = np.repeat(np.arange(len(texts)), blocks)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        filled = np.minimum(sizes[owner] - BLOCK * place, BLOCK)
        order = np.argsort(-filled, kind="stable")
        grid = np.zeros((len(owner), BLOCK), self._codes().dtype)
        grid[np.arange(BLOCK) < filled[:, None]] = np.concatenate(rows)
        steps = np.ascontiguousarray(grid[order].T)
        lanes = np.searchsorted(-filled[order], -np.arange(BLOCK), "left")
        for k, one in enumerate(self.automata):
            counts[:, k] = np.bincount(owner[order], one.phrases(steps, lanes), len(texts))
        return sizes, counts

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score (0 to 1) of each text; equal entropies: the first name."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        sizes, counts = self.phrases(texts)
        entropy = counts * np.array([a.bits for a in self.automata]) / np.maximum(sizes, 1)[:, None]
        best = entropy.argmin(axis=1)
        gap = (entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(sizes, SCORE_SYMBOLS)[:, None]
        score = 1 / np.exp2(-np.minimum(gap, 500)).sum(axis=1)
        return [(self.languages[b], float(s)) if n else (UNKNOWN, 0.0) for n, b, s in zip(sizes, best, score, strict=True)]


def id_remainder(id_col: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = SAMPLE_DOCS) -> Model:
    """Automata from the labelled rows whose id's remainder by 3 is not 1.

    The sample has ``docs`` documents of each language at most (fewer where there
    are over ALL_DOCS / ``docs`` languages, one at least), those with the least
    hash in each of as many hash buckets, and of each SAMPLE_CHARS characters at
    most; the bounds hold whatever the input size.
    """
    id_, text, lang = F.col(id_col), F.col(text_col), F.col(lang_col)
    rows = documents.where(text.isNotNull() & lang.isNotNull() & (id_remainder(id_, 3) != 1)).select(
        lang.cast("string").alias("lang"), F.xxhash64(id_.cast("string"), F.lit("language")).alias("h"), text.alias("text")
    )
    least = rows.groupBy("lang", F.pmod("h", F.lit(docs)).alias("part")).agg(F.min("h").alias("h")).collect()
    samples: dict[str, list[str]] = {r["lang"]: [] for r in least}
    if least:
        most = max(1, min(docs, ALL_DOCS // len(samples)))
        wanted, taken = set(), dict.fromkeys(samples, 0)
        for r in sorted(least, key=lambda r: (r["lang"], r["part"])):
            if taken[r["lang"]] < most:
                wanted.add((r["lang"], r["h"]))
                taken[r["lang"]] += 1
        # literals, few enough to count: the scan filters by them, nothing is joined
        chosen = rows.where(F.col("h").isin([h for _, h in wanted])).select("lang", "h", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
        # of rows that repeat an id the least text counts
        chosen = chosen.groupBy("lang", "h").agg(F.min("text").alias("text"))
        for r in sorted(chosen.collect(), key=lambda r: (r["h"], r["text"])):
            if (r["lang"], r["h"]) in wanted:
                samples[r["lang"]].append(r["text"])
    return Model(samples)


def _predictor(model, text_name: str, keep_columns: bool):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, text_name, SLICE_BYTES):
                texts = part.column(part.schema.get_field_index(text_name)).to_pylist()
                found = model.value.predict([t or "" for t in texts])
                if keep_columns:
                    yield part.filter(pa.array([lang != UNKNOWN for lang, _ in found]))
                else:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())],
                        names=["doc_id", "held_out", "lang_pred", "score"],
                    )

    return run


def identify_languages(documents: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    A text that is null or has no letter is ``und`` with score 0; so is every
    text where no labelled row is there to learn from. Equal entropies go to the
    first language by name. Rows with null or repeated ids are judged like any
    other. Other columns are not read.
    """
    model = model or fit(documents, id_col, text_col, lang_col)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), (id_remainder(F.col(id_col), 3) == 1).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predictor(shared, "text", False), "doc_id long, held_out boolean, lang_pred string, score double")


def drop_unknown_language(documents: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that some language is found for, with their columns as they are.

    A text that is null, empty or has no letter goes, and so does every text where
    no labelled row is there to learn from. Rows with null or repeated ids are
    judged like any other; a long text is judged whole; other columns may have any
    name. An empty table stays empty.
    """
    model = model or fit(documents, id_col, text_col, lang_col)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return documents.mapInArrow(_predictor(shared, text_col, True), documents.schema)

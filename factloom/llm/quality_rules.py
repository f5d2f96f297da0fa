"""Quality rules: a ledger of failure bits that policies read afterwards.

Every text is measured once and every rule is evaluated once on what was measured.
The ledger keeps the measurements and one bit for each failed rule, so a policy is
a mask: a new version of it, or the question what a rule costs, needs neither the
texts nor the rules again. Rows with equal bits are counted first, and there are few
kinds of them, so ablations of any number of policies are bit operations on a table
that doesn't grow with the documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fresh, gives_back, text_parts

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_echo_words")
WINDOW = 8
#: UTF-8 bytes measured at once, and words that are objects at once.
SLICE_BYTES, CHUNK = 1_000_000, 1 << 16


@dataclass(frozen=True)
class Rule:
    """A rule's name and the SQL condition on the measurements under which a text fails it."""

    name: str
    fails: str


#: The place in this list is the rule's bit, so rules are only ever added at its end.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 15 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("few_letters", "100 * n_letter_words < 60 * n_words"),
    Rule("echoes", "100 * n_echo_words > 25 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules that it applies; a text that fails one of them goes."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule] = RULES) -> int:
        bits = {r.name: 1 << i for i, r in enumerate(rules)}
        return sum(bits[name] for name in self.rules)


BASE = Policy("1", ("few_words", "repeated_windows"))
POLICIES = (BASE, Policy("2", BASE.rules + ("symbols", "repeated_lines")), Policy("3", tuple(r.name for r in RULES)))
CURRENT = POLICIES[-1]


def _table(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[np.frombuffer(chars, np.uint8)] = True
    return found


_SPACE = _table(b" \t\n\v\f\r")
_SYMBOL = _table(b"#*$%&|<>")
_LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _in_repeated_windows(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words stand in a window of eight that its document holds twice or more.
    Equal numbers mean equal spans of 1, 2, 4, then 8 words, so no hash can err."""
    span, size = words, 1
    while size < WINDOW and len(span) > size:
        span = _ranks(span[:-size] * (int(span.max()) + 1) + span[size:])
        size *= 2
    hit = np.zeros(len(words) + 1, np.int64)
    if len(words) >= WINDOW:
        starts = np.flatnonzero(doc[: len(span)] == doc[WINDOW - 1 :])
        _, kind, times = np.unique(doc[starts] * (int(span.max()) + 1) + span[starts], return_inverse=True, return_counts=True)
        again = starts[times[kind] > 1]
        np.add.at(hit, again, 1)
        np.add.at(hit, again + WINDOW, -1)
    return np.cumsum(hit)[:-1] > 0


def _duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines that have a word, and those of them that equal an earlier one."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines), len(lines) - len(set(lines))


def measure(texts: Iterable[bytes]) -> dict[str, np.ndarray]:
    """The measurements of some texts, given as UTF-8."""
    texts = list(texts)
    n = len(texts)
    if not n:
        return {name: np.zeros(0, np.int64) for name in MEASURES}
    whole = b"".join(t + b"\n" for t in texts)
    data = np.frombuffer(whole, np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    in_word = ~_SPACE[data]
    starts = np.flatnonzero(in_word & np.concatenate([[True], ~in_word[:-1]]))
    doc = np.searchsorted(begins, starts, "right") - 1
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    words = np.empty(len(starts), np.int64)
    for i in range(0, len(starts), CHUNK):
        end = starts[i + CHUNK] if i + CHUNK < len(starts) else len(whole)
        words[i : i + CHUNK] = [*map(number.__getitem__, whole[starts[i] : end].split())]
    lettered = np.logical_or.reduceat(_LETTER[data], starts) if len(starts) else np.zeros(0, bool)
    lines = np.array([_duplicate_lines(t) for t in texts], np.int64)
    per_text = lambda flags: np.add.reduceat(flags, begins, dtype=np.int64)
    return {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": per_text(in_word & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOL[data]),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": np.bincount(doc[_in_repeated_windows(words, doc)], minlength=n),
        "n_lines": lines[:, 0],
        "n_letter_words": np.bincount(doc[lettered], minlength=n),
        "n_echo_words": np.bincount(doc[1:][(words[1:] == words[:-1]) & (doc[1:] == doc[:-1])], minlength=n),
    }


@gives_back
def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.num_columns - 1
        for part in text_parts(batch, batch.schema.names[at], SLICE_BYTES):
            texts = part.column(at).cast(pa.binary()).to_pylist()
            found = measure(t or b"" for t in texts)
            columns = [*part.columns[:at], *(pa.array(found[name], pa.int64()) for name in MEASURES)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:at], *MEASURES])


def rule_ledger(documents: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """A row per document: doc_id, the columns named in ``carry``, the measurements
    and ``failures``, a long in which bit i is set if rule i fails (63 rules at most).

    A null text is measured as an empty one: all measurements are 0. Rules see no
    more than the measurements, so texts that differ otherwise fail alike; a condition
    that gives null fails nothing. Rows with null or repeated ids are measured like
    any other. Texts are measured whole, whatever their length: one takes some 30
    times its size in its worker. A carried column whose name the ledger has itself
    gets underscores behind it; other columns are not read. An empty table gives an
    empty ledger.
    """
    if len(rules) > 63:
        raise ValueError("a ledger has 63 rules at most")
    own = ["doc_id", *MEASURES, "failures"]
    names: list[str] = []
    for column in carry:
        names.append(fresh(own + names, column))
    kept = [F.col(id_col).alias("doc_id"), *(F.col(c).alias(n) for c, n in zip(carry, names))]
    rows = documents.select(*kept, F.col(text_col).cast("string").alias(fresh(own + names, "text")))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"{m} long" for m in MEASURES])
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    failures = F.lit(0).cast("long")
    for bit in bits:
        failures = failures.bitwiseOR(bit)
    return rows.mapInArrow(_measured, schema).withColumn("failures", failures)


def apply_policies(ledger: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with a boolean ``kept_<version>`` for each policy."""
    return ledger.withColumns({f"kept_{p.version}": F.col("failures").bitwiseAND(p.mask(rules)) == 0 for p in policies})


def ablations(ledger: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES, by: Sequence[str] = ()) -> DataFrame:
    """What each rule does in each policy: version, rule, n_docs, n_kept, n_failed
    (documents that fail the rule), n_alone (those that fail no other rule of the
    policy) and n_kept_without (kept if the policy lacked the rule), for each value of
    the ledger's columns ``by``. Documents are counted by their bits first; an empty
    ledger gives no row."""
    kinds = ledger.groupBy(*by, "failures").agg(F.count(F.lit(1)).alias("n"))
    bit = {r.name: 1 << i for i, r in enumerate(rules)}
    cases = [F.struct(F.lit(p.version).alias("version"), F.lit(name).alias("rule"), F.lit(p.mask(rules)).cast("long").alias("mask"), F.lit(bit[name]).cast("long").alias("bit")) for p in policies for name in p.rules]
    told = kinds.withColumn("case", F.explode(F.array(*cases)))
    mask, one, failed = F.col("case.mask"), F.col("case.bit"), F.col("failures")
    hit = failed.bitwiseAND(mask)
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return told.groupBy(*by, F.col("case.version").alias("version"), F.col("case.rule").alias("rule")).agg(
        F.sum("n").alias("n_docs"),
        total(hit == 0).alias("n_kept"),
        total(failed.bitwiseAND(one) != 0).alias("n_failed"),
        total(hit == one).alias("n_alone"),
        total(hit.bitwiseAND(F.bitwise_not(one)) == 0).alias("n_kept_without"),
    )


def quality_digest(documents: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The ledger under one policy: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, failures, policy."""
    ledger = rule_ledger(documents)
    failed = F.col("failures")
    return ledger.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *MEASURES[:5],
        (failed.bitwiseAND(BASE.mask()) != 0).alias("base_failed"),
        (failed.bitwiseAND(BASE.mask() | policy.mask()) == 0).alias("kept"),
        "failures",
        F.lit(policy.version).alias("policy"),
    )

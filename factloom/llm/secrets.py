"""Secret scanning: patterns propose candidates, a random forest removes the false ones.

Candidates are what known key formats, assignments to telling names, and long
runs of mixed characters give. Each is described by its length, its character
transitions, how much of it dictionary words cover, the path it was found under
and the words around it. A forest of decision trees, grown in numpy from
labelled findings, then tells secrets from commit ids, checksums, placeholders
and the like. The labelled findings are an argument; those that are used
otherwise are generated from a seed.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES, DEPTH, SEED = 40, 10, 17
#: Labelled findings that are generated, and the score from which a finding counts.
FINDINGS, CUT = 4000, 0.5
CONTEXT = 60

# Names that secrets are assigned to.
NAMES = r"passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential"
# What to look for, in order of precedence; group 1, if any, is the candidate.
RULES = {
    "private_key": (("PRIVATE KEY",), r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----)[\s\S])*+-----END [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----|(?:\s*+[A-Za-z0-9+/=]{16,}+)*+)"),
    "aws_key": (("AKIA", "ASIA"), r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    "provider_token": (("gh", "xox", "sk_live_", "AIza", "glpat-"), r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20})(?![A-Za-z0-9])"),
    "jwt": (("eyJ",), r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    "url_password": (("://",), r"(?i)[a-z][a-z0-9+.-]{1,20}://[^\s:/@]++:([^\s@/]{3,}+)@"),
    "assigned": (("=", ":"), rf"(?i)(?<![\w.-])(?=[\w.-]*?(?:{NAMES}))[\w.-]++[\"']?\s{{0,3}}[ \t]*+(?:=>|:=|=|:)\s{{0,3}}[ \t]*+[\"']?([^\s\"',;<>]{{6,}}+)"),
    "random": ((), r"(?<![A-Za-z0-9+/_=-])[A-Za-z+/_=-]*+\d[A-Za-z0-9+/_=-]*+"),
}
#: Rules whose format is an issuer's own: what fits is a secret, unless it looks made up.
ISSUED = ("private_key", "aws_key", "provider_token")
# What made-up keys hold.
MADE_UP = re.compile(r"(?i)example|sample|dummy|placeholder|changeme|your|redacted|xxxx|0000|1234567|abcdefg|(.)\1{5}")
_COMPILED = {k: (hints, re.compile(p)) for k, (hints, p) in RULES.items()}
RANDOM_LENGTH = 20

#: Shortest and longest word of the dictionary that is looked for.
WORD_SIZES = (3, 12)


def read_dictionary(path: str) -> frozenset[str]:
    """Words of a public tokenizer's vocabulary: its entries that follow a space and
    are all small letters. Most of them are whole words or stems."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = (t[1:] for t in vocabulary if t[0] == "\u0120")
    return frozenset(w for w in words if WORD_SIZES[0] <= len(w) <= WORD_SIZES[1] and w.isascii() and w.isalpha() and w.islower())


@lru_cache(4)
def dictionary(path: str | None = None) -> frozenset[str]:
    return read_dictionary(path or public_tokenizers.path("byte_bpe_50k.json"))


# Neighbouring words that speak for and against a secret.
FOR = ("passw", "pwd", "secret", "token", "key", "auth", "credential", "login", "bearer", "export")
AGAINST = ("commit", "sha", "hash", "md5", "checksum", "digest", "uuid", "guid", "revision", "version", "etag", "integrity", "example", "fixture", "id")
# Parts of paths.
PATHS_FOR = (".env", "config", "secret", ".pem", ".key", "deploy", "credentials", "settings")
PATHS_AGAINST = ("test", "example", "sample", "doc", "fixture", "mock", "spec", "lock", "vendor")

Finding = tuple[str, str, str, str, str]  # rule, candidate, text before, text after, path


def find_candidates(text: str) -> list[tuple[str, int, int]]:
    """(rule, begin, end) in order of place; of overlapping ones the first rule's."""
    taken: list[tuple[int, int, str]] = []
    for rule, (hints, pattern) in _COMPILED.items():
        if hints and not any(h in text for h in hints):
            continue
        found: list[tuple[int, int, str]] = []
        for m in pattern.finditer(text):
            begin, end = m.span(1) if pattern.groups else m.span()
            if rule == "random" and (end - begin < RANDOM_LENGTH or not any(c.isalpha() for c in m.group())):
                continue
            found.append((begin, end, rule))
        # both lists are in order of place and neither overlaps in itself
        at, kept = 0, []
        for one in found:
            while at < len(taken) and taken[at][1] <= one[0]:
                at += 1
            if at == len(taken) or taken[at][0] >= one[1]:
                kept.append(one)
        taken = sorted(taken + kept)
    return [(rule, a, b) for a, b, rule in taken]


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def _coverage(s: str, words: frozenset[str]) -> float:
    """Share of the characters that dictionary words cover, taken longest first."""
    low, at, covered = s.lower(), 0, 0
    while at < len(low):
        for n in range(min(WORD_SIZES[1], len(low) - at), WORD_SIZES[0], -1):
            if low[at : at + n] in words:
                covered += n
                at += n
                break
        else:
            at += 1
    return covered / max(len(s), 1)


def describe(finding: Finding, words: frozenset[str] | None = None) -> list[float]:
    """The forest's inputs for one finding."""
    rule, s, before, after, path = finding
    n = max(len(s), 1)
    counts = [s.count(c) / n for c in set(s)]
    kinds = [_kind(c) for c in s]
    moves = [0.0] * 16
    for a, b in zip(kinds, kinds[1:], strict=False):
        moves[4 * a + b] += 1 / max(n - 1, 1)
    steps = [ord(b) - ord(a) for a, b in zip(s, s[1:], strict=False)]
    near, behind, where = re.findall(r"[a-z0-9]+", before.lower())[-4:], after.lower(), path.lower()
    return [
        float(list(RULES).index(rule)),
        float(n),
        -sum(p * log2(p) for p in counts),
        len(counts) / n,
        *moves,
        sum(d == 0 for d in steps) / n,
        sum(abs(d) == 1 for d in steps) / n,
        _coverage(s, dictionary() if words is None else words),
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s))),
        float(any(w in x for x in near for w in FOR)),
        float(any(x.startswith(w) for x in near for w in AGAINST)),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(before[-1:] in "\"'" and before != ""),
        float(any(w in behind[:30] for w in AGAINST)),
        float(any(w in where for w in PATHS_FOR)),
        float(any(w in where for w in PATHS_AGAINST)),
    ]


#: Shapes of the generated findings, real ones first.
SHAPES = ("hex", "mixed", "marked", "base64", "issued", "phrase", "plain_hex", "uuid", "words", "path", "digits", "integrity", "placeholder", "reference")


def labelled_findings(n: int = FINDINGS, seed: int = SEED, without: tuple[str, ...] = ()) -> list[tuple[Finding, int]]:
    """Generated findings with labels: keys and passwords of many shapes in their
    usual places, and what scanners take for them. Lengths are drawn, not listed.
    ``without`` leaves out shapes, to see how a forest does on what it didn't see.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    size = lambda low, high: int(rng.integers(low, high + 1))
    chars = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    hex_, lower, upper, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    mixed, words = lower + upper + digits, sorted(w for w in dictionary() if len(w) > 3)
    prose = lambda: " ".join(pick([pick(words), chars(lower, size(2, 8))]) for _ in range(5)) + pick([" ", ". ", ", ", "\n"])
    names = ["password", "passwd", "pwd", "token", "secret", "api_key", "auth_token", "db_password", "client_secret", "ACCESS_KEY", "credential"]
    paths = ["src/app.py", "config/settings.yml", ".env", "lib/main.go", "deploy/run.sh", "docs/readme.md", "tests/test_api.py", "web", "crawl/7", ""]
    real_shapes = {
        "hex": ("assigned", lambda: chars(hex_, size(14, 64))),
        "mixed": ("assigned", lambda: chars(mixed, size(9, 48))),
        "marked": ("assigned", lambda: chars(mixed + "!$%&*_-", size(8, 24))),
        "phrase": ("assigned", lambda: pick("-_.!").join(pick(words) for _ in range(size(2, 4))) + chars(digits, size(1, 4)) + pick("!$%&*")),
        "base64": ("random", lambda: chars(mixed + "+/", size(28, 88))),
        "issued": (None, None),
    }
    issued = {
        "aws_key": lambda: pick(["AKIA", "ASIA"]) + chars(upper + digits, 16),
        "provider_token": lambda: pick(["ghp_" + chars(mixed, 36), "sk_live_" + chars(mixed, size(16, 40)), "xoxb-" + chars(digits, 12) + "-" + chars(mixed, 24), "AIza" + chars(mixed, 35), "glpat-" + chars(mixed, 20)]),
        "url_password": lambda: chars(mixed, size(6, 24)),
        "jwt": lambda: "eyJ" + chars(mixed, size(12, 40)) + "." + chars(mixed, size(20, 90)) + "." + chars(mixed, 43),
    }
    false_shapes = {
        "plain_hex": ("random", lambda: chars(hex_, size(24, 64))),
        "uuid": ("random", lambda: "-".join(chars(hex_, k) for k in (8, 4, 4, 4, 12))),
        "words": ("random", lambda: "_".join([pick(words), pick(words), chars(digits, size(1, 3)), pick(words), pick(words)])),
        "path": ("random", lambda: "/".join([*(pick(words) for _ in range(size(2, 4))), "v" + chars(digits, 1), pick(words)])),
        "digits": ("random", lambda: chars(digits, size(19, 26)) + pick("ab")),
        "integrity": ("random", lambda: pick(["sha256-", "sha512-"]) + chars(mixed + "+/", size(43, 86))),
        "placeholder": ("assigned", lambda: pick(["your_" + pick(words) + "_here", "changeme", pick("xX*0") * size(6, 20), "example" + chars(digits, 2), pick(words) + "_" + pick(words), "12345678", "required", "abcdef123456", "<" + pick(words)])),
        "reference": ("assigned", lambda: pick(["${" + pick(words).upper() + "}", "os.environ[" + pick(words), pick(words) + "." + pick(words) + "()", "{{" + pick(words), "$(" + pick(words)])),
    }
    real_shapes, false_shapes = ({k: v for k, v in d.items() if k not in without} for d in (real_shapes, false_shapes))
    out: list[tuple[Finding, int]] = []
    for _ in range(n):
        path, real = pick(paths), bool(rng.integers(2))
        assigned = pick(names) + pick(["=", " = ", ": ", ":"])
        if real:
            # issued keys have four forms
            shape = pick(sorted(real_shapes) + ["issued"] * 2 * ("issued" in real_shapes))
            rule, make = real_shapes[shape]
            if shape == "issued":
                rule = pick(sorted(issued))
                make = issued[rule]
            quote = pick(["", "", '"', "'"])
            lead = {"assigned": assigned + quote, "url_password": "postgres://user:", "random": pick(["secret key ", "Authorization: Bearer ", "export KEY=", "login with "])}.get(rule, pick(["", "key ", "key = "]))
            value, after = make(), (quote or " ") + pick(["", " ", "\n"]) + prose()
        else:
            shape = pick([*sorted(false_shapes), "url"])
            rule, make = false_shapes.get(shape, ("url_password", lambda: pick(["password", "pass", "xxxx", "${PASS}", "secret"])))
            quote = pick(["", '"'])
            lead = {"assigned": assigned + quote, "url_password": "mysql://root:"}.get(rule, pick(["", "", "", "commit ", "sha1 ", "checksum: ", "id=", "revision ", "see ", '"']))
            value, after = make(), (quote or pick([" ", "\n", ", "])) + prose()
        out.append(((rule, value, (prose() + lead)[-CONTEXT:], after[:CONTEXT], path), int(real)))
    base64 = mixed + "+/"
    for i in range(n // 10):
        # keys from BEGIN to END, long values, and what stands for a key in manuals
        kind, real = pick(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]) + "PRIVATE KEY", i % 3 < 2
        lines = [chars(base64, 64) for _ in range(int(rng.integers(2, 28)))] if real else [pick(["...", "your key here", "<" + pick(words) + ">", "x" * int(rng.integers(6, 64)), "\n".join([pick(words) + " " + pick(words)] * 3), ""])]
        pem = f"-----BEGIN {kind}-----\n" + "\n".join(lines) + f"\n-----END {kind}-----"
        if real and i % 6 == 0:
            pem = pem[: pem.rindex("\n-----END")]  # cut off in the text
        elif not real and i % 6 == 2:
            pem = f"-----BEGIN {kind}-----"
        out.append((("private_key", pem, prose()[-CONTEXT:], prose(), pick(paths)), int(real)))
        name = pick(names) + pick(["=", " = ", ": "]) + pick(["", '"'])
        value = chars(base64, int(rng.integers(64, 3000))) if real else pick(["x", "*", "0", pick(words) + "_"]) * int(rng.integers(30, 300))
        out.append((("assigned", value, (prose() + name)[-CONTEXT:], pick([" ", "\n"]) + prose()[: CONTEXT - 1], pick(paths)), int(real)))
    return out


class Forest:
    """Decision trees on bootstrap samples, each split over a few random inputs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.trees = [self._grow(x, y, depth, self.rng.integers(len(y), size=len(y))) for _ in range(trees)]

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rows: np.ndarray) -> dict[str, np.ndarray]:
        nodes: list[list[float]] = []  # input, threshold, left, right, share of label 1

        def add(own: np.ndarray, left_depth: int) -> int:
            at = len(nodes)
            nodes.append([0, 0.0, -1, -1, float(y[own].mean())])
            split = self._split(x, y, own) if left_depth and 0 < y[own].mean() < 1 else None
            if split:
                nodes[at][:2] = split
                side = x[own, split[0]] <= split[1]
                nodes[at][2], nodes[at][3] = add(own[side], left_depth - 1), add(own[~side], left_depth - 1)
            return at

        add(rows, depth)
        table = np.array(nodes)
        return {"input": table[:, 0].astype(int), "at": table[:, 1], "left": table[:, 2].astype(int), "right": table[:, 3].astype(int), "share": table[:, 4]}

    def _split(self, x: np.ndarray, y: np.ndarray, own: np.ndarray) -> tuple[int, float] | None:
        best, found, n = 1e-9, None, len(own)
        total = y[own].sum()
        whole = 2 * total / n * (1 - total / n)
        for j in self.rng.permutation(x.shape[1])[: max(int(x.shape[1] ** 0.5) + 1, 1)]:
            order = np.argsort(x[own, j], kind="stable")
            values, ones = x[own, j][order], np.cumsum(y[own][order])
            cut = np.flatnonzero(values[1:] > values[:-1])
            if not len(cut):
                continue
            k = cut + 1
            p, q = ones[cut] / k, (total - ones[cut]) / (n - k)
            gain = whole - (k * 2 * p * (1 - p) + (n - k) * 2 * q * (1 - q)) / n
            i = int(gain.argmax())
            if gain[i] > best:
                best, found = gain[i], (int(j), float(values[cut[i]]))
        return found

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mean share of label 1 in the leaves that each row reaches."""
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), int)
            while (inner := t["left"][at] >= 0).any():
                own = np.flatnonzero(inner)
                low = x[own, t["input"][at[own]]] <= t["at"][at[own]]
                at[own] = np.where(low, t["left"][at[own]], t["right"][at[own]])
            total += t["share"][at]
        return total / max(len(self.trees), 1)


def train(findings: list[tuple[Finding, int]], words: frozenset[str] | None = None) -> Forest:
    """Forest from labelled findings (rule, candidate, text before and after, path)."""
    return Forest(np.array([describe(f, words) for f, _ in findings]), np.array([label for _, label in findings]))


@lru_cache(4)
def default_forest(dictionary_path: str | None = None) -> Forest:
    """The forest of the generated findings."""
    return train(labelled_findings(), dictionary(dictionary_path))


def scan_text(text: str, path: str) -> list[tuple[str, int, int, Finding]]:
    found = find_candidates(text)
    return [(rule, a, b, (rule, text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT], path)) for rule, a, b in found]


def _scanner(forest, cut: float, words):
    schema = [("doc_id", pa.int64()), ("rule", pa.string()), ("begin", pa.int64()), ("length", pa.int64()), ("secret_sha256", pa.string()), ("score", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, inputs, issued = [], [], []
            for doc_id, text, path in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                for rule, a, b, finding in scan_text(text.as_py() or "", path or ""):
                    rows.append((doc_id, rule, a, b - a, hashlib.sha256(finding[1].encode("utf-8", "surrogatepass")).hexdigest()))
                    inputs.append(describe(finding, words.value))
                    issued.append(rule in ISSUED and not MADE_UP.search(finding[1]))
            if not rows:
                continue
            scores = forest.value.scores(np.array(inputs))
            scores = np.where(issued, np.maximum(scores, cut), scores)
            kept = [(*r, float(s)) for r, s in zip(rows, scores, strict=True) if s >= cut]
            columns = list(zip(*kept, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])

    return run


def find_secrets(documents: DataFrame, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", cut: float = CUT, dictionary_path: str | None = None) -> DataFrame:
    """A row for each finding that the forest takes for a secret: doc_id, rule,
    begin and length (in characters), secret_sha256 (equal secrets are equal,
    the secret itself is not shown), score. A key in an issuer's own format (ISSUED)
    needs no more than to look real; the forest decides on those that look made up.

    Null and empty texts give no row; a null path, or none, counts as empty. Null
    and repeated ids are kept as they are: each row is scanned. An empty table
    gives an empty result. A long text is read whole, in time that is in proportion
    to it. The dictionary is the vocabulary file of a public tokenizer, some 20,000
    words. Other columns are not read.
    """
    words = dictionary(dictionary_path)
    forest = forest or default_forest(dictionary_path)
    shared, known = (documents.sparkSession.sparkContext.broadcast(x) for x in (forest, words))
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), path.alias("path"))
    return rows.mapInArrow(_scanner(shared, cut, known), "doc_id long, rule string, begin long, length long, secret_sha256 string, score double")

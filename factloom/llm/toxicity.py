"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters the network as the sum of the embeddings of itself and of its
character n-grams. Texts are cut into overlapping windows of words; over each
window a gated recurrent unit runs in both directions, attention pools its
states, and a logistic unit scores the pool. A text's score is that of its worst
window, so every window of a text of any length counts.

The network is trained in numpy on a bounded sample of labelled rows, by
gradient descent through time on the worst window of each text. The n-grams that
have embeddings are those that tell the labels apart in the sample. Scoring runs
where the documents are: the input side of the gates is computed once for each
distinct word of a few megabytes of text, and windows are stepped side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.language_id import id_remainder

WINDOW, STRIDE = 48, 32
HIDDEN, DIM = 8, 12
GRAMS = (3, 4, 5, 6, 7)
#: Bounds of what is learned from: labelled texts of each class, their length,
#: n-grams with an embedding, and the least number of texts with such an n-gram.
SAMPLE, SAMPLE_CHARS, KNOWN, LEAST_TEXTS = 1500, 8000, 4096, 5
EPOCHS, BATCH, RATE = 14, 256, 0.01
SLICE_BYTES, LANES = 6_000_000, 4096
CUT = 0.3
SLOTS = 20

_rng = np.random.Generator(np.random.PCG64(11))
_VALUE = _rng.integers(1, 1 << 63, 258, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of words: letters, and whatever isn't ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LESS, _MORE = 256, 257


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Words:
    """Words of some texts: for each word its number among the distinct ones, the
    words up to each text's end, and the n-gram hashes of the distinct words."""

    def __init__(self, texts: pa.Array):
        texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.empty(0, np.uint8)
        at = at - at[0]
        inside = _LETTER[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = at[:-1][at[:-1] < len(data)]
        begins[heads] = inside[heads]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | begins[1:]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.upto = np.searchsorted(starts, at[1:])
        sizes = stops - starts
        if not len(starts):
            self.which = np.empty(0, np.int64)
            self.owner, self.hashes = np.empty(0, np.int64), np.empty(0, np.uint64)
            self.n = 0
            return
        letters = np.flatnonzero(inside)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # a word's hash only tells words apart; places wrap after 64 bytes
        values = _VALUE[data[letters]] * (_PLACE[place & 63] + (place >> 6).astype(np.uint64))
        word = _mixed(np.add.reduceat(values, np.cumsum(sizes) - sizes))
        _, first, self.which = np.unique(word, return_index=True, return_inverse=True)
        self.n = len(first)
        # distinct words end to end, each between marks
        size = sizes[first] + 2
        head = np.cumsum(size) - size
        chars = np.zeros(size.sum(), np.int64)
        chars[head], chars[head + size - 1] = _LESS, _MORE
        inner = np.arange((size - 2).sum()) - np.repeat(np.cumsum(size - 2) - (size - 2), size - 2)
        chars[np.repeat(head + 1, size - 2) + inner] = data[np.repeat(starts[first], size - 2) + inner]
        own = np.repeat(np.arange(self.n), size)
        last = np.repeat(head + size, size)
        values, spot = _VALUE[chars], np.arange(len(chars))
        owners, hashes = [np.arange(self.n)], [word[first]]
        total = np.zeros(len(chars), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            if n > len(chars):
                break
            total[: len(chars) - n + 1] += values[n - 1 :] * _PLACE[n - 1]
            if n in GRAMS:
                fits = spot + n <= last
                owners.append(own[fits])
                hashes.append(_mixed(total[fits] + np.uint64(n)))
        self.owner, self.hashes = np.concatenate(owners), np.concatenate(hashes)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of each window (-1: none), and the text of each. Every text with a
        word has one at least, and the last reaches the text's end."""
        before = np.concatenate([[0], self.upto[:-1]])
        counts = self.upto - before
        n = np.where(counts > 0, 1 + np.maximum(-(-(counts - WINDOW) // STRIDE), 0), 0)
        text = np.repeat(np.arange(len(counts)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        spots = (before[text] + STRIDE * k)[:, None] + np.arange(WINDOW)
        fits = spots < self.upto[text][:, None]
        return np.where(fits, self.which[np.where(fits, spots, 0)] if len(self.which) else -1, -1), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _gru(gates: np.ndarray, inner: np.ndarray, keep: bool = False):
    """States after each step; gates: input side of (reset, update, new) by step
    and lane. With ``keep`` also what the way back needs."""
    steps, lanes, _ = gates.shape
    h = np.zeros((lanes, HIDDEN), np.float32)
    states, kept = np.empty((steps, lanes, HIDDEN), np.float32), []
    for t in range(steps):
        side = h @ inner
        both = _sigmoid(gates[t, :, : 2 * HIDDEN] + side[:, : 2 * HIDDEN])
        r, z = both[:, :HIDDEN], both[:, HIDDEN:]
        new = np.tanh(gates[t, :, 2 * HIDDEN :] + r * side[:, 2 * HIDDEN :])
        if keep:
            kept.append((h, r, z, new, side[:, 2 * HIDDEN :]))
        h = new + z * (h - new)
        states[t] = h
    return states, kept


def _gru_back(grad: np.ndarray, kept: list, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' input side and of the inner weights."""
    steps, lanes, _ = grad.shape
    out, d_inner = np.empty((steps, lanes, 3 * HIDDEN), np.float32), np.zeros_like(inner)
    dh = np.zeros((lanes, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, r, z, new, side = kept[t]
        dh = dh + grad[t]
        dz, dnew = dh * (h - new) * z * (1 - z), dh * (1 - z) * (1 - new * new)
        dr = dnew * side * r * (1 - r)
        out[t] = np.concatenate([dr, dz, dnew], axis=1)
        d_side = np.concatenate([dr, dz, dnew * r], axis=1)
        d_inner += h.T @ d_side
        dh = dh * z + d_side @ inner.T
    return out, d_inner


class Network:
    """Weights, the n-grams that have embeddings, and the scale of the scores."""

    def __init__(self, known: np.ndarray, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.known = np.sort(known)
        self.slots = np.zeros(1 << SLOTS, bool)
        self.slots[(self.known >> np.uint64(64 - SLOTS)).astype(np.int64)] = True
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.weights = {
            "embed": draw(len(known), DIM),
            "in_f": draw(DIM, 3 * HIDDEN),
            "in_b": draw(DIM, 3 * HIDDEN),
            "bias_f": np.zeros(3 * HIDDEN, np.float32),
            "bias_b": np.zeros(3 * HIDDEN, np.float32),
            "inner_f": draw(HIDDEN, 3 * HIDDEN),
            "inner_b": draw(HIDDEN, 3 * HIDDEN),
            "look": draw(2 * HIDDEN),
            "out": draw(2 * HIDDEN),
            "base": np.full(1, -1.0, np.float32),
        }
        self.scale, self.shift = 1.0, 0.0

    def embedded(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of the distinct words; pairs of word and known n-gram."""
        likely = np.flatnonzero(self.slots[(words.hashes >> np.uint64(64 - SLOTS)).astype(np.int64)])
        owner, hashes = words.owner[likely], words.hashes[likely]
        if not len(self.known):
            return np.zeros((words.n, DIM), np.float32), owner[:0], owner[:0]
        gram = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        fits = self.known[gram] == hashes
        owner, gram = owner[fits], gram[fits]
        return self.summed(owner, gram, words.n), owner, gram

    def summed(self, owner: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        x = np.zeros((n, DIM), np.float32)
        for j in range(DIM):
            x[:, j] = np.bincount(owner, self.weights["embed"][gram, j], n)
        return x

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input side of both directions for each word; the last row, for no word,
        keeps the state as it is."""
        w, out = self.weights, []
        for d in "fb":
            g = np.concatenate([x @ w[f"in_{d}"] + w[f"bias_{d}"], np.zeros((1, 3 * HIDDEN), np.float32)])
            g[-1, HIDDEN : 2 * HIDDEN] = 60
            out.append(g)
        return out[0], out[1]

    def forward(self, grid: np.ndarray, gates: tuple[np.ndarray, np.ndarray], keep: bool = False):
        """Logit of each window; grid: words by window, -1 for none."""
        w, steps = self.weights, grid.T
        ahead, kept_f = _gru(gates[0][steps], w["inner_f"], keep)
        back, kept_b = _gru(gates[1][steps[::-1]], w["inner_b"], keep)
        states = np.concatenate([ahead, back[::-1]], axis=2)
        look = states @ w["look"]
        look[steps < 0] = -1e9
        look = np.exp(look - look.max(axis=0))
        share = look / look.sum(axis=0)
        pooled = np.einsum("tl,tlh->lh", share, states)
        logit = pooled @ w["out"] + w["base"][0]
        return (logit, (states, share, pooled, kept_f, kept_b)) if keep else logit

    def backward(self, grid: np.ndarray, kept, d_logit: np.ndarray, n_words: int) -> tuple[dict, list[np.ndarray]]:
        """Gradients of the weights, and of the input side for each word by direction."""
        w, (states, share, pooled, kept_f, kept_b) = self.weights, kept
        grads = {"out": pooled.T @ d_logit, "base": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * w["out"]
        d_share = np.einsum("lh,tlh->tl", d_pooled, states)
        d_look = share * (d_share - (share * d_share).sum(axis=0))
        grads["look"] = np.einsum("tl,tlh->h", d_look, states)
        d_states = share[:, :, None] * d_pooled + d_look[:, :, None] * w["look"]
        sides = []
        for d, part, kept_d in (("f", d_states[:, :, :HIDDEN], kept_f), ("b", d_states[::-1, :, HIDDEN:], kept_b)):
            d_gates, grads[f"inner_{d}"] = _gru_back(part, kept_d, w[f"inner_{d}"])
            spots = (grid.T if d == "f" else grid.T[::-1]).ravel()
            flat = d_gates.reshape(-1, 3 * HIDDEN)
            used = spots >= 0
            by_word = np.stack([np.bincount(spots[used], flat[used, j], n_words) for j in range(3 * HIDDEN)], axis=1).astype(np.float32)
            grads[f"bias_{d}"] = by_word.sum(axis=0)
            sides.append(by_word)
        return grads, sides

    def window_logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        grid, text = words.windows()
        gates = self.gates(self.embedded(words)[0])
        logits = [self.forward(grid[a : a + LANES], gates) for a in range(0, len(grid), LANES)]
        return np.concatenate([np.empty(0, np.float32), *logits]), text

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Score of each text, 0 to 1; a text without words gets that of a window
        in which nothing is known."""
        words = Words(texts)
        logits, text = self.window_logits(words)
        blank = float(self.forward(np.zeros((1, WINDOW), np.int64), self.gates(np.zeros((1, DIM), np.float32)))[0])
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, text, logits)
        worst[np.isinf(worst)] = blank
        return _sigmoid(np.clip(self.scale * worst + self.shift, -60, 60))


def telling_grams(words: Words, labels: np.ndarray, known: int = KNOWN, least: int = LEAST_TEXTS) -> np.ndarray:
    """Hashes of the n-grams whose presence differs most between the labels, by
    the likelihood ratio of the numbers of texts that have them."""
    counts = np.diff(words.upto, prepend=0)
    pairs = np.unique(np.repeat(np.arange(len(labels)), counts) * np.int64(max(words.n, 1)) + words.which)
    word, label = pairs % max(words.n, 1), labels[pairs // max(words.n, 1)]
    pos, neg = (np.bincount(word[label == k], minlength=words.n) for k in (1, 0))
    hashes, gram = np.unique(words.hashes, return_inverse=True)
    p, n = np.bincount(gram, pos[words.owner]), np.bincount(gram, neg[words.owner])
    enough = p + n >= least
    hashes, p, n = hashes[enough], p[enough], n[enough]
    rate = max((labels == 1).sum(), 1) / max(len(labels), 1)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-9) / expected)

    ratio = part(p, (p + n) * rate) + part(n, (p + n) * (1 - rate))
    return hashes[np.argsort(-ratio, kind="stable")[:known]]


def train(texts: list[str], labels: list[int], prior: float, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Network for labelled texts; ``prior`` is the share of label 1 outside the sample."""
    y, words = np.array(labels), Words(pa.array(texts, pa.string()))
    net = Network(telling_grams(words, y) if len(y) else np.empty(0, np.uint64), seed)
    if len(set(labels)) < 2:
        net.shift, net.scale = (30.0 if len(y) and y[0] else -30.0), 0.0
        return net
    # every fifth text is kept for the scale of the scores
    kept = np.arange(len(y)) % 5 == 4
    if len(set(y[kept])) < 2 or len(set(y[~kept])) < 2:
        kept[:] = False
    grid, text = words.windows()
    _, owner, gram = net.embedded(words)
    order = np.argsort(owner, kind="stable")
    gram, bounds = gram[order], np.searchsorted(owner[order], np.arange(words.n + 1))
    rng = np.random.Generator(np.random.PCG64(seed))
    adam = Adam(net.weights)
    for _ in range(epochs):
        logits, _ = net.window_logits(words)
        # the worst window of each text; of texts with label 0 some others as well
        by_text = np.lexsort((logits, text))
        last = np.flatnonzero(np.append(text[by_text][1:] != text[by_text][:-1], True))
        others = rng.permutation(np.flatnonzero(y[text] == 0))[: len(last) // 2]
        chosen = np.concatenate([by_text[last], others])
        chosen = rng.permutation(chosen[~kept[text[chosen]]])
        for start in range(0, len(chosen), BATCH):
            own = chosen[start : start + BATCH]
            _batch(net, adam, grid[own], y[text[own]], gram, bounds)
    logits, _ = net.window_logits(words)
    worst = np.full(len(y), -np.inf)
    np.maximum.at(worst, text, logits)
    fair = (kept | ~kept.any()) & np.isfinite(worst)
    net.scale, net.shift = _calibrated(worst[fair], y[fair], prior)
    return net


class Adam:
    """Adaptive steps for a dictionary of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = RATE):
        self.weights, self.rate, self.n = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.n += 1
        for k, g in grads.items():
            m, v = self.mean[k], self.square[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.weights[k] -= self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.999**self.n)) + 1e-8)


def loss_gradients(net: Network, grid: np.ndarray, labels: np.ndarray, gram: np.ndarray, bounds: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean logistic loss of windows and its gradients. gram, bounds: the known
    n-grams of word i are gram[bounds[i]:bounds[i + 1]]."""
    used, small = np.unique(grid, return_inverse=True)
    none = int(used[0] < 0)
    used, small = used[none:], small.reshape(grid.shape) - none
    n = bounds[used + 1] - bounds[used]
    owner = np.repeat(np.arange(len(used)), n)
    grams = gram[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - bounds[used], n)]
    x = net.summed(owner, grams, len(used))
    logit, kept = net.forward(small, net.gates(x), keep=True)
    p = _sigmoid(logit)
    loss = float(np.mean(np.logaddexp(0, logit) - labels * logit))
    grads, sides = net.backward(small, kept, ((p - labels) / len(labels)).astype(np.float32), len(used))
    dx = np.zeros_like(x)
    for d, side in zip("fb", sides, strict=True):
        grads[f"in_{d}"] = x.T @ side
        dx += side @ net.weights[f"in_{d}"].T
    grads["embed"] = np.stack([np.bincount(grams, dx[owner, j], len(net.known)) for j in range(DIM)], axis=1).astype(np.float32)
    return loss, grads


def _batch(net: Network, adam: Adam, grid: np.ndarray, labels: np.ndarray, gram: np.ndarray, bounds: np.ndarray) -> None:
    adam.step(loss_gradients(net, grid, labels, gram, bounds)[1])


def _calibrated(logits: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float]:
    """Scale and shift of the logits, by Newton's method on the weighted logistic
    loss in which label 1 has the share ``prior``."""
    share = labels.mean() if len(labels) else 0.5
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    weight = np.where(labels == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    design, beta = np.stack([logits, np.ones_like(logits)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(np.clip(design @ beta, -30, 30))
        grad = design.T @ (weight * (p - labels)) + np.array([0.1, 0.0]) * (beta[0] - 1)
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([0.1, 1e-6])
        move = np.linalg.solve(curve, grad)
        beta = beta - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return float(max(beta[0], 0.05)), float(beta[1])


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Network:
    """Network from labelled rows whose id's remainder by 4 is not 2.

    Learns from at most ``sample`` texts of each label, of at most SAMPLE_CHARS
    characters, those with the least hash of their ids. Rows with a null label or
    text are left out; a document with two labels counts under both.
    """
    id_ = F.col(id_col)
    marked = labels.where(F.col(label_col).isin(0, 1) & id_.isNotNull() & (id_remainder(id_, 4) != 2)).select(id_.alias("id"), F.col(label_col).cast("int").alias("y"))
    shares = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows: list[tuple[int, str]] = []
    for y in sorted(shares):
        least = marked.where(F.col("y") == y).select("id").distinct().orderBy(F.xxhash64(F.col("id"), F.lit("toxicity"))).limit(sample)
        ids = [r["id"] for r in least.collect()]
        text = F.col(text_col)
        found = documents.where(id_.isin(ids) & text.isNotNull() & F.length(text).between(1, SAMPLE_CHARS)).select(id_.alias("id"), text.alias("text"))
        rows += [(y, r["text"]) for r in sorted(found.collect(), key=lambda r: (r["id"], r["text"]))]
    prior = shares.get(1, 0) / max(sum(shares.values()), 1)
    # both labels throughout, in an order that says nothing about them
    order = np.random.Generator(np.random.PCG64(3)).permutation(len(rows))
    return train([rows[i][1] for i in order], [rows[i][0] for i in order], prior)


def _scorer(network, text_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_name))
            ends, start = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0))), 0
            while start < len(column):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES, "right")))
                part = batch.slice(start, stop - start)
                scores = network.value.scores(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array((scores >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
                start = stop

    return run


def score_toxicity(documents: DataFrame, labels: DataFrame, network: Network | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted (1 from CUT on).

    Null and empty texts, and such without a word, get the score of a window in
    which nothing is known. Rows with null or repeated ids are scored like any
    other. With no labels, or one label only, all scores are near 0, or as that
    label says. Other columns are not read.
    """
    network = network or fit(documents, labels, id_col, text_col, label_col)
    shared = documents.sparkSession.sparkContext.broadcast(network)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), (id_remainder(F.col(id_col), 4) == 2).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scorer(shared, "text"), "doc_id long, held_out boolean, score double, predicted int")

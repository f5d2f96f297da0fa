import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from factloom.llm.packing import WordTokenizer, ids_follow_merges, pack_documents, plan_windows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(lengths, window):
    """Best-fit decreasing, a piece at a time; contents of each window."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if window - sum(b) >= n]
        best = min(fit, key=lambda b: window - sum(b), default=None)
        if best is None:
            bins.append(best := [])
        best.append(n)
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([8, 16, 50])
    lengths = [min(window, max(1, int(rng.expovariate(1 / rng.choice([3, 9, 30]))))) for _ in range(rng.choice([1, 30, 300]))]
    runs, n = plan_windows(Counter(lengths), window)
    got, seen = defaultdict(list), Counter()
    for length, a, b, first, offset in runs:
        seen[length] += b - a
        for k in range(b - a):
            got[first + k].append((offset, length))
    assert seen == Counter(lengths)
    want = one_by_one(lengths, window)
    assert n == len(want) == len(got)
    for v in got.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= window
    assert Counter(tuple(sorted(l for _, l in v)) for v in got.values()) == Counter(tuple(sorted(b)) for b in want)


TEXTS = ["", " ", "  two  spaces ", "a", " a b", "x\n\n y \n z", "tab\t end\t", "don't it's 12 34,5!", "é ñ 漢字   x", "\x1c \x1c a", "w" * 5000, "ab " * 3000, " <|endoftext|> x"]


def test_words_give_the_ids_of_whole_texts():
    plain = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    more = ["".join(rng.choice(" \n\tab1,.é '") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    odd = ["".join(rng.choice(" \u00a0\u2003\x1c\x85\nab") for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    for texts in (TEXTS + more, odd, TEXTS[:1]):
        got = WordTokenizer(PATH)(pa.array(texts))
        want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert [g.tolist() for g in got] == want


def test_other_vocabularies(tmp_path):
    """What can't be taken as ranks over words is left to the library itself."""
    file = json.load(open(PATH))
    assert ids_follow_merges(file)
    swapped = json.loads(json.dumps(file))
    vocab = swapped["model"]["vocab"]
    a, b = "".join(swapped["model"]["merges"][3]), "".join(swapped["model"]["merges"][9])
    vocab[a], vocab[b] = vocab[b], vocab[a]
    prefix = json.loads(json.dumps(file))
    prefix["pre_tokenizer"]["add_prefix_space"] = True
    for k, other in enumerate((swapped, prefix)):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(other))
        assert not ids_follow_merges(other)
        plain = Tokenizer.from_file(str(path))
        assert [g.tolist() for g in WordTokenizer(str(path))(pa.array(TEXTS))] == [e.ids for e in plain.encode_batch(TEXTS, add_special_tokens=False)]
    path = public_tokenizers.path("word_bpe_49k.json")
    assert [g.tolist() for g in WordTokenizer(path)(pa.array(TEXTS))] == [e.ids for e in Tokenizer.from_file(path).encode_batch(TEXTS, add_special_tokens=False)]


@pytest.mark.parametrize("part", [500_000, 3])
def test_pieces(spark, part):
    data = [(i, t, 5) for i, t in enumerate(TEXTS)] + [(3, "a", 1)] * 40 + [(None, None, 1)] * 3
    df = spark.createDataFrame(data, "doc_id long, text string, length int")
    rows = pack_documents(df, PATH, window=64, with_ids=True, part=part).collect()
    plain = Tokenizer.from_file(PATH)
    want = []
    for i, t, _ in data:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 64):
            p = ids[s : s + 64]
            want.append((str(i), s, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(ids), tuple(p)))
    assert sorted(want) == sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens, tuple(r.ids)) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) == len(one_by_one([w[2] for w in want], 64))


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from readprep.llm import packing as P


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(P.vocabulary_path())


def plain(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.vocabulary_path())
    return [[*e.ids, P.END] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_the_library(encoder, spark, small):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts += ["", "  ", "İstanbul Σας", "a\x01b", "<|endoftext|> x", "it's we'll 'street !!'s don’t ½²3", "naïve œuvre\xa0x y", "é", "日本語", "\x85a\x1cb", "ß Ŀ ŉ ǆ", "x'S Y'LL", "ª º µ \xad", "Ɓa Ⱥb Ɔ ƀ ſ ÿŸ"]
    for t, ids in zip(texts, plain(texts), strict=True):
        assert encoder(t) == np.array(ids[:-1], "<u4").tobytes(), t[:80]


def naive(lengths, window):
    """Best-fit decreasing, one piece at a time."""
    open_ = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, c in enumerate(open_) if c >= n]
        if fit:
            i = min(fit, key=lambda i: open_[i])
            open_[i] -= n
        else:
            open_.append(window - n)
    return Counter(open_)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for window in (8, 31, 64):
        for _ in range(30):
            lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 200))]
            plan = P.best_fit_decreasing(dict(Counter(lengths)), window)
            used, seen = defaultdict(int), defaultdict(list)
            for n, a, b, first, per, offset in plan:
                for r in range(a, b):
                    w, o = first + (r - a) // per, offset + (r - a) % per * n
                    used[w] += n
                    seen[w].append((o, o + n))
            assert Counter(window - u for u in used.values()) == naive(lengths, window)
            for spans in seen.values():
                spans.sort()
                assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
            assert {n: sum(b - a for m, a, b, *_ in plan if m == n) for n in set(lengths)} == dict(Counter(lengths))


def test_tree_finds_the_tightest():
    rng = random.Random(2)
    c = P.Capacities(50)
    for k in rng.sample(range(1, 51), 20):
        c.add(k, 0, 1)
    for need in range(1, 51):
        assert c.tightest(need) == min((k for k, r in c.ranges.items() if r and k >= need), default=0)


def check(rows, texts, window=4096):
    want = plain([t for _, t in texts])
    ids = Counter()
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
        ids[(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
    for spans in windows.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= window and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    cut = Counter()
    for (d, _), w in zip(texts, want, strict=True):
        for a in range(0, len(w), window):
            piece = np.array(w[a : a + window], "<u4").tobytes()
            cut[(d, a, len(piece) // 4, zlib.crc32(piece), len(w))] += 1
    assert ids == cut
    return sum(len(w) for w in want) / len(windows) / window


def test_pack_odd_documents(odd, none):
    rows = P.pack(odd, P.vocabulary_path()).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert P.pack(none, P.vocabulary_path()).count() == 0


def test_query(spark, small):
    rows = P.op1(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert check(rows, [(r["doc_id"], r["text"]) for r in docs]) > 0.95


def test_small_window_with_ids(odd):
    out = P.pack(odd.select("doc_id", "text"), P.vocabulary_path(), window=64, with_ids=True)
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in out.collect())

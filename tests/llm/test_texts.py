import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readprep.llm import common, lm, minhash, mixing, quality, suffix_dedup, tokencount

from .conftest import sentence


# ------------------------------------------------------------------ words


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_of_slices_and_nulls():
    col = pa.array(["x", None, " a  bb\n", "", "é\x85z", "bb a"], pa.string()).slice(1)
    raw, offsets = common.text_bytes(col)
    start, end, row, h = common.words_of(raw, offsets)
    got = [(int(r), bytes(raw[a:b]).decode()) for a, b, r in zip(start, end, row, strict=True)]
    assert got == [(i, w) for i, t in enumerate(col.to_pylist()) for w in words(t)]
    by = {}
    for (_, w), x in zip(got, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 20)]
    want = {}
    for v in {x for e in edges for x in e if e[0] != e[1]}:
        part, stack = {v}, [v]
        while stack:
            x = stack.pop()
            for a, b in edges:
                for p, q in ((a, b), (b, a)):
                    if p == x and q not in part:
                        part.add(q)
                        stack.append(q)
        want[v] = min(part)
    got = common.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_hold_many_rows(spark):
    """Sums of 64-bit hashes would overflow here; exclusive ors don't."""
    n = 1 << 25
    many = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = common.fingerprint(many, "a", "b")
    assert got[0] == n and got != common.fingerprint(many.withColumn("b", F.col("b") + (F.col("a") == 5).cast("int")), "a", "b")


# ------------------------------------------------------------------ token counts


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    return tokencount.Counter(public_tokenizers.path(tokencount.VOCABULARY), public_tokenizers.PATTERN)


def test_edits_equal_a_full_count(counter):
    rng = random.Random(2)
    bits = [" ", "  ", "\n", "\n\n ", "'re", "'", "'l", "a", "bc", "é", "12", "3", "!", "?!", "\t", " the", "日本"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        tree = tokencount.TokenTree(text, counter)
        for _ in range(6):
            a = rng.randint(0, len(tree.text))
            b = rng.randint(a, min(len(tree.text), a + 6))
            want = tree.text[:a]
            new = "".join(rng.choice(bits) for _ in range(rng.randint(0, 4)))
            want += new + tree.text[b:]
            tree.edit(a, b, new)
            assert tree.text == want and tree.total == counter.whole(want) and tree.chars[1] == len(want)


@pytest.mark.parametrize("dense", [0, 48])
def test_many_edits_at_once_equal_a_full_count(counter, monkeypatch, dense):
    monkeypatch.setattr(tokencount, "DENSE", dense)
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\n\n ", "'re", "'", "'l", "a", "bc", "é", "12", "3", "!", "?!", "\t", " the", "日本"]
    for k in range(600):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40 if k % 3 else 400)))
        tree = tokencount.TokenTree(text, counter)
        for _ in range(3):
            cuts = sorted(rng.randint(0, len(tree.text)) for _ in range(2 * rng.randint(1, 6)))
            if k % 2:
                cuts = [min(c, cuts[i & ~1] + 3) for i, c in enumerate(cuts)]
            edits = [(a, b, "".join(rng.choice(bits) for _ in range(rng.randint(0, 3)))) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
            want, at = "", 0
            for a, b, new in edits:
                want += tree.text[at:a] + new
                at = b
            want += tree.text[at:]
            tree.apply(edits)
            assert tree.text == want and tree.total == counter.whole(want) and tree.chars[1] == len(want)
            tree = tokencount.TokenTree(tree.text, counter, tree.kept())


def test_many_edits_cost_less_than_a_recount(counter):
    """An edit each 200 characters: under a recount; an edit each 15 characters, where no leaf stays: a few recounts."""
    import time

    text = sentence(6, 120_000)
    for step, most in ((200, 1.5), (15, 6)):
        tree = tokencount.TokenTree(text, counter)
        began = time.process_time()
        tree.apply([(a, a + 3, "x y") for a in range(100, len(text) - 10, step)])
        took = time.process_time() - began
        began = time.process_time()
        assert tree.total == counter.whole(tree.text)
        assert took < most * (time.process_time() - began), step


def test_kept_trees_encode_edited_regions_only(spark, odd, none, counter):
    import public_tokenizers

    args = public_tokenizers.path(tokencount.VOCABULARY), public_tokenizers.PATTERN
    trees = common.materialize(tokencount.token_trees(odd, *args), "trees")
    once = common.materialize(tokencount.edited_trees(trees, *args, edits=lambda t: [(len(t) // 2, len(t) // 2 + 1, "QQ")] if len(t) > 300 else []), "trees")
    twice = tokencount.edited_trees(once, *args, edits=lambda t: [(3, 4, "!")] if len(t) > 300 else []).collect()
    assert len(twice) == odd.count() and any(r["n_edits"] for r in twice)
    for r in twice:
        assert r["edited_tokens"] == counter.whole(r["text"] or "") and r["reencoded"] <= 12 * r["n_edits"]
    assert tokencount.token_trees(none, *args).count() == 0 and tokencount.edited_trees(trees.filter("false"), *args).count() == 0


def test_edits_touch_little(counter):
    text = sentence(1, 5000)
    tree = tokencount.TokenTree(text, counter)
    tree.edit(20_000, 20_004, "x")
    assert tree.reencoded < 10 and tree.total == counter.whole(tree.text)


def test_count_query(spark, small, odd, none, counter):
    import public_tokenizers

    got = tokencount.op3(spark, small).orderBy("doc_id").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(got) == len(docs) and sum(r["n_edits"] for r in got) > 0
    for r in got:
        text = docs[r["doc_id"]] or ""
        edited, at = [], 0
        for a, b, new in tokencount.mask_personal_data(text):
            edited += [text[at:a], new]
            at = b
        edited = "".join(edited) + text[at:]
        assert (r["n_tokens"], r["edited_tokens"]) == (counter.whole(text), counter.whole(edited))
    args = public_tokenizers.path(tokencount.VOCABULARY), public_tokenizers.PATTERN
    assert sorted(r["n_tokens"] for r in tokencount.token_counts(odd, *args).collect()) == sorted(counter.whole(r["text"] or "") for r in odd.collect())
    assert tokencount.token_counts(none, *args).count() == 0


# ------------------------------------------------------------------ mixing


def water(sizes, weights, cap):
    total, fixed = sum(sizes), {}
    while True:
        rest = total - sum(fixed.values())
        w = sum(x for i, x in enumerate(weights) if i not in fixed)
        over = [i for i in range(len(sizes)) if i not in fixed and rest * weights[i] / w > cap * sizes[i]]
        if not over:
            return [fixed.get(i, rest * weights[i] / w if w else 0) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


def check_mix(rows, docs):
    """rows of op5's columns against docs."""
    by = {}
    for r in docs:
        by.setdefault(r["source"], []).append(len(words(r["text"])))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, water([sum(by[s]) for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))], 3), strict=True))
    assert len(rows) == len(docs)
    taken = dict.fromkeys(order, 0)
    for r in rows:
        s = r["source"]
        assert r["source_size"] == sum(by[s]) and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert sorted(r["size"] for r in rows) == sorted(x for v in by.values() for x in v)
    return {s: (taken[s], want[s]) for s in order}


def test_mix_reaches_targets(spark, small, odd, none):
    for docs, slack in ((spark.read.parquet(f"{small}/documents.parquet"), 1), (odd, 1)):
        mixed = mixing.mix(docs).select("_row.doc_id", "_row.source", "size", "source_size", "target", "taken")
        got = check_mix(mixed.collect(), docs.collect())
        assert all(abs(a - b) <= slack for a, b in got.values()), got
        assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs).select("_row.doc_id", "_row.source", "size", "source_size", "target", "taken").collect()))
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_rates_are_tilted(spark, small):
    """Within a source that is thinned, longer documents are thinned more: r = exp(lambda * size)."""
    rows = mixing.mix(spark.read.parquet(f"{small}/documents.parquet")).collect()
    for s in {r["_row"]["source"] for r in rows}:
        own = [r for r in rows if r["_row"]["source"] == s and r["size"]]
        if own[0]["target"] < own[0]["source_size"] * 0.8:
            assert all(r["copies"] <= 1 for r in own)


def test_rates_equal_a_plain_solver(spark, small):
    """The multipliers against bisection over all documents of a source."""
    import math

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("source", mixing.size_of(F.col("text")).alias("size")).collect()
    key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source")))
    cells = docs.select(key.alias("_key"), mixing.size_of(F.col("text")).alias("size")).groupBy("_key", "size").agg(F.count(F.lit(1)).alias("_n"))
    state = mixing.solve(cells, mixing.targets(spark, cells, mixing.WEIGHTS, 3), 3).collect()
    by = {}
    for r in rows:
        by.setdefault("1" if r["source"] is None else "0" + r["source"], []).append(r["size"])
    assert len(state) == len(by)
    for r in state:
        sizes, mean = by[r["_key"]], sum(by[r["_key"]]) / len(by[r["_key"]])
        if not r["_full"]:
            lo, hi = -50.0, 50.0
            for _ in range(200):
                mid = (lo + hi) / 2
                total = sum(s * min(3.0, math.exp(min(mid * s / mean, 10))) for s in sizes)
                lo, hi = (mid, hi) if total < r["target"] else (lo, mid)
            assert r["_lambda"] == pytest.approx(lo, rel=1e-5, abs=1e-7)


def test_rates_that_do_not_converge_raise(spark, small, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        mixing.mix(spark.read.parquet(f"{small}/documents.parquet"))


def test_partial_repeats_are_verbatim(spark):
    text = "  one\ttwo\n\nthree  four five six seven\n"
    docs = spark.createDataFrame([(i, text if i % 2 else "a\nb " * 9, "xyz"[i % 3], 7) for i in range(30)], "doc_id long, text string, source string, size long")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = mixing.mixed_documents(docs).collect()
    cut = [r for r in out if r["text"] != texts[r["doc_id"]]]
    assert cut and all(texts[r["doc_id"]].startswith(r["text"]) and words(r["text"]) == words(texts[r["doc_id"]])[: len(words(r["text"]))] for r in cut)


def test_mixed_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    total = out.select(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert total == mixing.mix(docs).agg(F.sum("taken")).first()[0]
    bad = out.filter(F.length("text") != F.col("n_chars")).join(docs.select("doc_id", F.col("n_chars").alias("n")), "doc_id").filter("n_chars <> n")
    assert bad.isEmpty()


# ------------------------------------------------------------------ quality


def test_quality_learns(spark):
    sf = "/root/testdata/sf0.1"
    out = quality.op6(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    x = out.groupBy("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right"), F.min("score"), F.max("score")).collect()
    assert all(r["right"] > 0.98 and r[2] >= 0 and r[3] <= 1 for r in x)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, None), (8, None, 1), (10, 7, 0), (None, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels)
    assert got.count() == odd.count() and got.filter("score IS NULL OR score < 0 OR score > 1 OR held_out IS NULL").isEmpty()
    alone = quality.classify(odd, labels.filter("false")).collect()
    assert {r["score"] for r in alone} == {0.5} and {r["predicted"] for r in alone} == {1}
    assert quality.classify(none, labels).count() == 0 and quality.good_documents(none, labels).count() == 0
    assert quality.good_documents(odd, labels.filter("false")).columns == odd.columns


def plain_boost(x, y):
    """Cyclic boosting of one-feature trees in plain Python: the score of each row."""
    import math

    n, d = x.shape
    p0 = (sum(y) + 1) / (n + 2)
    z = [math.log(p0 / (1 - p0))] * n
    edges = [sorted(set(np.quantile(x[:, k], np.linspace(0, 1, quality.BINS + 1)[1:-1], method="nearest").tolist())) for k in range(d)]
    at = [[sum(e <= v for e in edges[k]) for v in x[:, k]] for k in range(d)]
    for _ in range(quality.ROUNDS):
        for k in range(d):
            p = [1 / (1 + math.exp(-v)) for v in z]
            own = range(len(edges[k]) + 1)
            g = [sum(y[i] - p[i] for i in range(n) if at[k][i] == b) for b in own]
            h = [sum(p[i] * (1 - p[i]) for i in range(n) if at[k][i] == b) for b in own]
            value = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + quality.L2)  # noqa: B023, E731
            parts = [(0, len(own))]
            while len(parts) < 4:
                cuts = [(value(a, m) + value(m, b) - value(a, b), -j, -m) for j, (a, b) in enumerate(parts) for m in range(a + 1, b)]
                if not cuts or max(cuts)[0] <= 1e-9:
                    break
                _, j, m = max(cuts)
                a, b = parts[-j]
                parts[-j : -j + 1] = [(a, -m), (-m, b)]
            for a, b in parts:
                step = quality.RATE * sum(g[a:b]) / (sum(h[a:b]) + quality.L2)
                z = [v + step if a <= at[k][i] < b else v for i, v in enumerate(z)]
    return [1 / (1 + math.exp(-v)) for v in z]


def test_fit_equals_plain_boosting(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.random((60, 3)).round(2)
    y = (x[:, 0] + 0.3 * x[:, 1] + 0.2 * rng.standard_normal(60) > 0.6).astype(float)
    monkeypatch.setattr(quality, "ROUNDS", 12)
    monkeypatch.setattr(quality, "PAIRS", 0)
    assert np.allclose(quality.fit(x, y).score(x), plain_boost(x, y))


def test_query_fits_and_scores_by_the_plain_way(spark, small):
    """op6 against a fit and lookups over all labelled rows outside Spark, row by row."""
    import zlib

    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{small}/labels.parquet").collect()]
    one = {d: quality.features(*common.text_bytes(pa.array([t], pa.string())))[0] for d, t in docs.items()}
    own = sorted(((q, *one[d][::-1]) for d, q in labels if q in (0, 1) and not held(d) and d in docs))
    model = quality.fit(np.array([r[:0:-1] for r in own]), np.array([r[0] for r in own], float))
    got = quality.op6(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        z = model.bias + sum(t[sum(e <= v for e in edges)] for v, edges, t in zip(one[r["doc_id"]], model.edges, model.tables, strict=True))
        z += sum(t[sum(e <= one[r["doc_id"]][i] for e in a), sum(e <= one[r["doc_id"]][j] for e in b)] for i, j, a, b, t in model.pairs)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6, abs=1e-9)
        assert (r["held_out"], r["predicted"]) == (held(r["doc_id"]), int(r["score"] >= 0.5))


def test_features_are_per_text():
    texts = ["A b!", "", "x\nx\ny", None, "Été ÉTÉ 12 ###"]
    together = quality.features(*common.text_bytes(pa.array(texts, pa.string())))
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(quality.features(*common.text_bytes(pa.array([t], pa.string())))[0], row)
    assert together.shape[1] == len(quality.FEATURES) and not together[1].any() and not together[3].any()


def test_pairs_learn_what_single_tables_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95 and {m.pairs[0][0], m.pairs[0][1]} == {0, 1}


# ------------------------------------------------------------------ suffix dedup


def brute_dedup(docs, length=100):
    """docs: (key, bytes) in order; (removed, spans, kept) of each."""
    seen, out = set(), []
    for d in docs:
        cov = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            s = d[i : i + length]
            if s in seen:
                cov[i + 1 : i + 1 + length] = True
            seen.add(s)
        kept = bytes(c for c, x in zip(d, cov[1:], strict=False) if not x)
        out.append((int(cov.sum()), int((cov[1:] & ~cov[:-1]).sum()), kept))
    return out


def test_suffix_array():
    rng = random.Random(3)
    for sigma in (2, 3, 5):
        for _ in range(150):
            t = [rng.randint(1, sigma) for _ in range(rng.randint(1, 70))] + [0]
            assert suffix_dedup.suffix_array(np.array(t, np.int16), sigma + 1, 200).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    t = np.array([1] * 500 + [0], np.int16)
    assert suffix_dedup.suffix_array(t, 2, 600).tolist() == list(range(500, -1, -1))


def test_files_hold_large_shards():
    t = np.array([random.Random(4).randint(1, 9) for _ in range(5000)] + [0], np.int16)
    space = suffix_dedup.Space(1000)
    assert suffix_dedup.suffix_array(t, 10, 100, space).tolist() == suffix_dedup.suffix_array(t, 10, 100).tolist()
    assert space.folder is not None
    space.close()


def test_long_texts_are_cut_into_the_same_strings():
    texts = [t.encode() for t in corpus(12)] + [b"", b"x" * 700]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    def places(**k):
        row, start, end, m, _ = suffix_dedup.segments(raw, offsets, **k)
        return {(r, i, v) for r, a, b, v in zip(row.tolist(), start.tolist(), end.tolist(), m.tolist(), strict=True) for i in range(a, b)}

    assert places() == places(most=150) == places(most=1000) and len(places()) == sum(max(len(t) - 99, 0) for t in texts)


def corpus(n=40):
    rng = random.Random(5)
    base = [sentence(i, rng.randint(5, 60)).encode() for i in range(12)] + [b"ab" * 200, b"x" * 300, "é日".encode() * 60]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            a = rng.randint(0, len(b) // 3)
            parts.append(b[a : a + rng.randint(20, 500)])
        out.append(b" ".join(parts).decode("utf-8", "ignore"))
    return out


@pytest.mark.parametrize("hot", [0, 3, 10_000])
def test_dedup_equals_brute_force(spark, hot):
    texts = corpus()
    texts += [texts[3], texts[3], "short", "short", ""]
    df = spark.createDataFrame([(i * 7 % 101, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r["_row"]: r for r in suffix_dedup.dedup(df, hot=hot, with_text=True).collect()}
    order = sorted((i * 7 % 101, t.encode()) for i, t in enumerate(texts))
    for (d, t), (removed, spans, kept) in zip(order, brute_dedup([t for _, t in order]), strict=True):
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(t), removed, spans, kept), d
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [0, 10_000])
def test_dedup_tells_texts_of_one_id_apart(spark, hot):
    head, tail, rest = (sentence(i, 60)[:300] for i in (60, 61, 62))
    own = [sentence(70 + i, 30) for i in range(8)]
    rows = [(d, head + own[i]) for i, d in enumerate([None, None, 3, 3])]  # the same start in each
    rows += [(None, own[4] + tail), (3, own[5] + own[6] + tail), (1, own[6] + rest), (1, own[6] + rest), (2, own[7] + rest), (None, own[0] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("h", F.xxhash64("text"))
    docs = sorted({(suffix_dedup.LAST if r["doc_id"] is None else r["doc_id"], r["h"], r["text"].encode()) for r in df.collect()})
    want = {h: x for (_, h, _), x in zip(docs, brute_dedup([t for *_, t in docs]), strict=True)}
    got = suffix_dedup.dedup(df, hot=hot, row=F.col("h"), with_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["_row"]]


def test_long_periodic_segments_are_not_gathered(spark, monkeypatch):
    called, own = [], suffix_dedup._hot
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 5000, raising=False)
    monkeypatch.setattr(suffix_dedup, "_hot", lambda *a: called.append(1) or own(*a))
    texts = [sentence(80 + i, 20) + "one short line\n" * (100 + 250 * i) + sentence(90 + i, 20) for i in range(4)] + ["x" * 9000, sentence(99, 5) + "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["_row"]: r for r in suffix_dedup.dedup(df, with_text=True).collect()}
    for i, want in enumerate(brute_dedup([t.encode() for t in texts])):
        assert (got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == want
    assert called  # far under 20,000 segments


def test_dedup_query(spark, small):
    docs = sorted((r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in suffix_dedup.op7(spark, small).collect()}
    for (d, t), (removed, spans, kept) in zip(docs, brute_dedup([t for _, t in docs]), strict=True):
        assert (got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == (removed, spans, hashlib.sha256(kept).hexdigest())


def test_dedup_query_equals_sql(spark, small, duck):
    got = suffix_dedup.op7(spark, small)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r.values()) for r in duck.sql(suffix_dedup.ORACLE).to_arrow_table().select(got.columns).to_pylist())


def test_dedup_odd(odd, none):
    out = suffix_dedup.deduplicated_documents(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    by = {}
    for r in out.collect():
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert by[1] == [None] and by[2] == [""] and by[10] == by[11] == ["one two"]
    assert by[7] == [""] and by[12] == ["a"]  # the second string covers all but the first byte
    assert suffix_dedup.deduplicated_documents(none).count() == 0 and suffix_dedup.dedup(none).count() == 0


# ------------------------------------------------------------------ MinHash


def shingle_set(text):
    w = words(text)
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_groups(rows):
    sets = [shingle_set(t) for _, t in rows]
    low = list(range(len(rows)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                low[b] = a
    part = {}
    for i in range(len(rows)):
        part.setdefault(find(i), []).append(rows[i][0])
    return {i: min(part[find(i)]) for i in range(len(rows))}


def copies(seed, n, changed, length=150):
    rng, base = random.Random(seed), sentence(seed, length).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(changed):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("chunk", [8, 1024])
def test_groups_equal_brute_force(spark, chunk):
    texts = copies(1, 30, 1) + copies(2, 40, 2) + copies(3, 30, 3) + copies(4, 20, 6) + [sentence(50 + i, 60) for i in range(20)]
    texts += [sentence(9, 40) + " " + sentence(100 + i, 30) for i in range(30)] + ["one two", "one two", "", "", "three"]
    rows = list(enumerate(texts))
    minhash.CHUNK = chunk
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    minhash.CHUNK = 1024
    assert got == brute_groups(rows)


def test_signatures_estimate_the_probability_jaccard():
    rng = random.Random(6)
    x = {i: rng.randint(1, 5) for i in range(300)}
    y = {i: rng.randint(1, 5) for i in range(100, 400)}

    def jp(a, b):
        return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())

    m = 4096
    row = np.repeat([0, 1], [len(x), len(y)])
    element = common.mix64(np.array([*x, *y], np.uint64)) >> np.uint64(24)
    sig = minhash.signatures(row, element, np.array([*x.values(), *y.values()], float), 2, m)
    assert abs((sig[0] == sig[1]).mean() - jp(x, y)) < 4 * np.sqrt(0.25 / m)
    assert (minhash.signatures(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0), 2, 8) == 2**64 - 1).all()


def repeated(seed, k, times):
    """Two texts of about 200 shingles each: of k stanzas of 20 words, the second repeats three `times` over and has a word changed."""
    rng = random.Random(seed)
    stanzas = [[f"w{rng.randint(0, 10**9)}" for _ in range(20)] for _ in range(k)]
    other = [list(x) for x in stanzas]
    for x in other[:3]:
        x *= times
    other[-1][10] = f"w{rng.randint(0, 10**9)}"
    return [" ".join(w for x in t for w in x) for t in (stanzas, other)]


def test_groups_of_copies_that_repeat_a_passage(spark):
    rows = list(enumerate(t for seed in range(60) for t in repeated(seed, 10, 20)))
    want = brute_groups(rows)
    assert sum(want[i] == i - 1 for i in want) == 60  # every pair is a link
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_chances_of_a_miss():
    """What the docstring states: independent registers that agree with probability 0.8."""
    from math import comb

    m = minhash.REGISTERS
    assert (1 - 0.8**minhash.BAND) ** (m // minhash.BAND) < 3e-7 and m % minhash.BAND == 0
    assert sum(comb(m, k) * 0.8**k * 0.2 ** (m - k) for k in range(minhash.LEAST_AGREE)) < 5.1e-8


def test_uneven_repeats_are_found(spark):
    """300 pairs of similarity 0.8 to 1 where one text repeats parts of itself."""
    rng, rows = random.Random(11), []
    for seed in range(300):
        base = sentence(1000 + seed, 120).split()
        k = rng.randint(10, 110)
        other = base + base[:k] * rng.randint(1, 12)
        for _ in range(rng.randint(0, 2)):
            other[rng.randrange(len(other))] = f"y{seed}"
        rows += [(2 * seed, " ".join(base)), (2 * seed + 1, " ".join(other))]
    sets = [shingle_set(t) for _, t in rows]
    want = {i + 1 for i in range(0, 600, 2) if len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8}
    got = {r["doc_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if not r["kept"]}
    assert len(want) > 200 and got == want


def test_hot_texts_are_spread(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    near = sentence(7, 100)
    rows = [(i, "the same old text of six words") for i in range(40)] + [(100 + i, near + f" t{i}") for i in range(30)] + [(None, "")]
    want = brute_groups([(10**6 if d is None else d, t) for d, t in rows])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got if r["doc_id"] is not None) == sorted((d, want[i]) for i, (d, _) in enumerate(rows) if d is not None)


def test_links_between_join_all_components():
    sets = [np.sort(common.mix64(np.array([hash(s) & (2**63 - 1) for s in shingle_set(t)], np.uint64))) for t in copies(7, 12, 1) + copies(8, 12, 4)]
    n = len(sets)
    sig = np.zeros((n, 4), np.uint32)
    found = minhash.links_between(np.arange(n), np.arange(n), sig, sets, np.arange(n), np.arange(n), 0, 0.8)
    assert len(found) < n
    part = list(range(n))
    for a, b in found:
        part = [part[a] if p == part[b] else p for p in part]
    for i in range(n):
        for j in range(n):
            if minhash.jaccard(sets[i], sets[j]) >= 0.8:
                assert part[i] == part[j]


def test_minhash_odd(odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    pairs = {(r["doc_id"], r["class_id"]) for r in got}
    assert {(1, 1), (2, 2), (3, 3), (7, 5), (9, 8), (11, 10), (None, None)} <= pairs
    kept = minhash.distinct_documents(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids.count("5") == 2 and "7" not in ids and "9" not in ids and "11" not in ids and ids.count("None") == 1
    assert minhash.near_duplicates(none).count() == 0 and minhash.distinct_documents(none).count() == 0


def test_minhash_query_equals_sql(spark, small, duck):
    got = minhash.op9(spark, small)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r.values()) for r in duck.sql(minhash.ORACLE).to_arrow_table().select(got.columns).to_pylist())


# ------------------------------------------------------------------ LM


def lm_tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*words(low), "</end>"]


def test_scores(spark, small):
    import math
    import zlib
    from collections import Counter

    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in docs}
    c = Counter(t for r in docs if not held[r["doc_id"]] for t in lm_tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    for often in (lm.FREQUENT, 50):
        lm.FREQUENT = often
        got = {r["doc_id"]: r for r in lm.op10(spark, small).collect()}
        for r in docs:
            t = lm_tokens(r["text"])
            g = got[r["doc_id"]]
            base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
            assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[r["doc_id"]], len(t), sum(x in c for x in t), n)
            assert g["base_score"] == pytest.approx(base, rel=1e-9)
    lm.FREQUENT = 1 << 21
    out = [g for g in got.values() if g["held_out"]]
    assert sum(g["score"] for g in out) > sum(g["base_score"] for g in out)


def plain_scores(docs, rows):
    """The model in plain Python, token by token and in double precision; docs: (doc_id, text)."""
    import math
    import zlib
    from collections import Counter, defaultdict

    C, S, K = lm.CLASSES, lm.SLOTS, lm.OWN
    seqs = [[int(x) for x in lm.tokens(pa.array([t], pa.string()))[1]] for _, t in docs]
    learn = [i for i, (d, _) in enumerate(docs) if zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(x for i in learn for x in seqs[i])
    n = sum(c.values())
    heads = {}
    for k in range(C):
        heads |= {x: j for j, x in enumerate(sorted((x for x in c if x % C == k), key=lambda x: (-c[x], x))[:K])}
    slot = {x: heads.get(x, K + int(common.mix64(np.array([x], np.uint64) ^ np.uint64(77))[0]) % (S - K)) for s in seqs for x in s}
    feats = []
    for s in seqs:
        ctx = lm.contexts(np.zeros(len(s), int), np.array(s, np.uint64))
        cls = np.array([x % C for x in s])
        feats.append(list(zip(zip(*lm.class_rows(ctx, rows), strict=True), zip(*lm.slot_rows(ctx, cls, rows), strict=True), strict=True)))
    leaf, size = Counter(), Counter()
    for x, k in c.items():
        leaf[x % C, slot[x]] += k
        size[x % C, slot[x]] += 1
    by = [sum(leaf[k, j] for j in range(S)) for k in range(C)]
    bias = [math.log((by[k] + 1) / (n + C)) for k in range(C)]
    biases = [[math.log((leaf[k, j] + 0.5) / (by[k] + 0.5 * S)) for j in range(S)] for k in range(C)]
    share = [(sum(leaf[k, j] for k in range(C)) + 1) / (n + S) for j in range(S)]
    seen = [defaultdict(Counter), defaultdict(Counter)]
    for i in learn:
        for x, (f, g) in zip(seqs[i], feats[i], strict=True):
            for r in f:
                seen[0][r][x % C] += 1
            for r in g:
                seen[1][r][slot[x]] += 1
    clip = lambda v, most: max(-most, min(most, v))
    weights = []
    for own, p in zip(seen, ([math.exp(b) for b in bias], share), strict=True):
        weights.append({r: [clip(lm.START * (math.log((k[y] + lm.PRIOR * p[y]) / (sum(k.values()) + lm.PRIOR)) - math.log(p[y])), lm.LIMIT) for y in range(len(p))] for r, k in own.items()})
    none = [0.0] * max(C, S)

    def dist(level, rows_, own):
        z = [math.exp(sum(weights[level].get(r, none)[y] for r in rows_) + own[y]) for y in range(len(own))]
        return [v / sum(z) for v in z]

    expected = [defaultdict(lambda: [0.0] * C), defaultdict(lambda: [0.0] * S)]
    for i in learn:
        for x, (f, g) in zip(seqs[i], feats[i], strict=True):
            for level, rows_, own in ((0, f, bias), (1, g, biases[x % C])):
                p = [math.floor(v * lm.SCALE + 0.5) / lm.SCALE for v in dist(level, rows_, own)]
                for r in rows_:
                    expected[level][r] = [a + b for a, b in zip(expected[level][r], p, strict=True)]
    for level in (0, 1):
        for r, w in weights[level].items():
            k, m = seen[level][r], expected[level][r]
            t = max(sum(k.values()), 1)
            weights[level][r] = [clip(v + clip(lm.STEP * (k[y] - m[y]) / (max(m[y] * (1 - m[y] / t), 0) + lm.PRIOR), 1.5), lm.LIMIT) for y, v in enumerate(w)]
    out = []
    for s, own in zip(seqs, feats, strict=True):
        total = 0.0
        for x, (f, g) in zip(s, own, strict=True):
            k, j = x % C, slot[x]
            total += math.log10(dist(0, f, bias)[k] * dist(1, g, biases[k])[j] * (c[x] + 0.5) / (leaf[k, j] + 0.5 * (size[k, j] + 1)))
        out.append(total)
    return out


def test_scores_equal_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_ROWS", 64)
    docs = [(i, sentence(i % 9, 25) + " " + sentence(40 + i, 12)) for i in range(40)] + [(40, None), (41, "Ab  ab.\n"), (42, sentence(3, 25))]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string"), rows=256).collect()}
    for (d, _), want in zip(docs, plain_scores(docs, 256), strict=True):
        assert got[d] == pytest.approx(want, rel=2e-4), d


def test_scores_do_not_depend_on_splits(spark, monkeypatch):
    docs = spark.createDataFrame([(i, sentence(i, 30) if i % 7 else None) for i in range(60)], "doc_id long, text string")
    out = []
    for parts, fan, batch in ((1, 64, 8192), (8, 64, 100), (13, 3, 8192)):
        monkeypatch.setattr(lm, "FAN", fan)
        monkeypatch.setattr(lm, "BATCH", batch)
        monkeypatch.setattr(lm, "MOST", 50 * batch)  # 32 bits are left at other places
        out.append(sorted((r["doc_id"], r["score"], r["base_score"]) for r in lm.score(docs.repartition(parts)).collect()))
    assert out[0] == out[1] == out[2]


def test_rounds_raise_the_likelihood(spark, monkeypatch):
    """Held-out texts at sf0.01: counts alone, then the first weights, then the step."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mean = lambda df, col: df.filter("held_out").agg(F.sum(col) / F.sum("n_tokens")).first()[0]
    whole = common.materialize(lm.score(docs), "lm-test")
    monkeypatch.setattr(lm, "step", lambda weights, n, m: weights)
    first = mean(lm.score(docs), "score")
    assert mean(whole, "base_score") + 0.1 < first < mean(whole, "score")


def test_model_is_a_distribution():
    rng = np.random.default_rng(2)
    row, ids = lm.tokens(pa.array([sentence(1, 500), "", None, "A b"], pa.string()))
    ctx, cls = lm.contexts(row, ids), (ids & lm._MASK).astype(int)
    w = rng.standard_normal((1 << 14, lm.CLASSES)).astype(np.float32)
    z, total = lm.exponentials(w, np.zeros(lm.CLASSES, np.float32), lm.class_rows(ctx, 1 << 14))
    assert np.allclose(z.sum(1), total) and (z > 0).all()
    assert np.bincount(row).tolist() == [501, 1, 1, 3]
    # contexts don't cross texts
    alone = lm.contexts(*lm.tokens(pa.array(["A b"], pa.string())))
    assert (ctx[:, -3:] == alone).all()
    # every token of a class has one slot; frequent ones their own
    u, c = np.unique(ids, return_counts=True)
    heads = lm.Heads(u, c)
    own = heads.slots(u)
    assert (own < lm.SLOTS).all() and len(set(zip((u & lm._MASK).tolist(), own.tolist(), strict=True)) & {(int(x & lm._MASK), int(s)) for x, s in zip(heads.ids, heads.slot, strict=True)}) == len(heads.ids)
    assert lm.rows_for(0) == 1 << 14 and lm.rows_for(10**9) == lm.MAX_ROWS and lm.rows_for(200_000) == 1 << 16 and (cls >= 0).all()


def test_sums_do_not_overflow():
    t = lm.Sums(1, 2)
    for _ in range(7):
        t.reserve(lm.MOST)[0, 1] += lm.MOST * int(lm.SCALE)
    assert t.total().tolist() == [[0, 7 * lm.MOST * int(lm.SCALE)]] and t.total()[0, 1] > 2**31


def test_expectations_equal_plain_sums(monkeypatch):
    """Tokens whose features share a row count each time, and 32 bits are left before they overflow."""
    rng = np.random.default_rng(8)
    row, ids = lm.tokens(pa.array(["a a " * 3000, sentence(4, 900), None], pa.string()))
    model = lm.Model(lm.Heads(*np.unique(ids, return_counts=True)), 2, rng.standard_normal(lm.CLASSES).astype(np.float32), rng.standard_normal((lm.CLASSES, lm.SLOTS)).astype(np.float32))
    model.class_weights = rng.standard_normal((2, lm.CLASSES)).astype(np.float32)
    model.slot_weights = rng.standard_normal((2, lm.SLOTS)).astype(np.float32)
    monkeypatch.setattr(lm, "BATCH", 512)
    monkeypatch.setattr(lm, "MOST", 2500)
    tables = [lm.Sums(2, lm.CLASSES)]
    lm.expect_features(model, row, ids, tables)
    want, n, slots = np.zeros((2, lm.CLASSES), np.int64), np.zeros((2, lm.CLASSES), np.int64), np.zeros((2, lm.SLOTS))
    for _, cls, _, f, g in model.places(row, ids):
        z, total = lm.exponentials(model.slot_weights, model.slot_bias[cls], g)
        np.add.at(slots, g[0], lm.SCALE * z / total[:, None])
        np.add.at(n, (g[0], cls), 1)
        z, total = lm.exponentials(model.class_weights, model.class_bias, f)
        q = (z * (np.float32(lm.SCALE) / total)[:, None] + np.float32(0.5)).astype(np.int64)
        for x in f:
            np.add.at(want, x, q)
    assert (tables[0].total() == want).all()
    assert np.allclose(lm.expected_slots(model.slot_weights, model.slot_bias, n), slots, rtol=1e-4)


def test_weights_stay_finite():
    n = np.array([[10**12, 0, 5], [0, 0, 0], [1, 1, 1]])
    w = lm.first_weights(n, np.array([1e-7, 0.5, 0.5], np.float32))
    for _ in range(50):
        w = lm.step(w, n, np.array([[0, 10**15, 3], [0, 0, 0], [10**5, 0, 0]]))
    assert np.isfinite(w).all() and np.abs(w).max() <= lm.LIMIT


def test_lm_odd(odd, none):
    got = lm.score(odd).collect()
    assert len(got) == odd.count() and all(r["score"] is not None and np.isfinite(r["score"]) and r["n_tokens"] >= 1 for r in got)
    assert lm.score(none).count() == 0
    alone = lm.score(odd.filter("doc_id IN (1, 2)")).collect()
    assert len(alone) == 2

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from readprep.llm import subspace as S
from readprep.llm import topk as T


def brute_top(rows, k):
    out = []
    for q, v in [r for r in rows if r[0] % 20 == 0]:
        best = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_top_k_equals_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    v = np.floor(rng.standard_normal((400, 12)) * 20 * (1 + spread * rng.exponential(2, (400, 1))))
    v[100:130] = v[100]  # ties
    v[200] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for block in (16, 64, 2048):
        T.BLOCK = block
        got = T.top_k(df, df.filter("id % 20 = 0"), 20)
        assert sorted(map(tuple, got.collect())) == brute_top([(i, np.array(x)) for i, x in rows], 20)
    T.BLOCK = 2048


def test_pruning_prunes_and_stays_exact():
    rng = np.random.default_rng(4)
    c = np.floor(rng.standard_normal((2000, 16)) * 30 / (1 + np.arange(2000)[:, None] / 50))
    c = c[np.argsort(-(c * c).sum(1))]
    q = np.floor(c[:40] * 1.0)
    bound = np.sort(q @ c.T, 1)[:, -10].astype(np.int64)
    row, ids, score, seen = T.search_block(q, np.full(40, -1), bound.copy(), c, np.arange(2000), 10)
    assert seen["verified"] < seen["pairs"] / 4
    want = sorted((i, -int(s), j) for i in range(40) for s, j in sorted(((float(q[i] @ c[j])), j) for j in range(2000)) if s >= bound[i])
    got = sorted(zip(row.tolist(), (-score).tolist(), ids.tolist(), strict=True))
    assert [g for g in got] == sorted(x for i in range(40) for x in [w for w in want if w[0] == i][:10])


@pytest.mark.parametrize("sign", [1, -1])
def test_coordinates_prune_nothing_that_counts(sign):
    """Vectors along one axis, so that a query's largest coordinate exceeds its local threshold."""
    rng = np.random.default_rng(6)
    c = rng.standard_normal((1500, 6)) * 8
    c[:, 2] = sign * rng.choice([100, 97, 90, 60], 1500)
    c[::7] = 0
    c[::7, 2] = sign * 100
    c = np.floor(c)
    c = c[np.argsort(-(c * c).sum(1), kind="stable")]
    q = np.floor(np.concatenate((c[:30], c[700:730], rng.standard_normal((20, 6)) * 50)))
    s = (q @ c.T).astype(np.int64)
    for share in (0.75, 0.9, 0.95):
        bound = np.maximum(share * np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max(), 1).astype(np.int64)
        row, ids, score, seen = T.search_block(q, np.full(len(q), -1), bound.copy(), c, np.arange(1500), 1500)
        want = [(i, s[i, j], j) for i in range(len(q)) for j in range(1500) if s[i, j] >= bound[i]]
        assert sorted(zip(row.tolist(), score.tolist(), ids.tolist(), strict=True)) == sorted(want) and want
        assert seen["verified"] < seen["pairs"]


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [3.0, 1.0]), (40, None), (60, [1.0, None]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, []), (None, [9.0, 9.0]), (4, [5.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted(map(tuple, T.top_k(df, df.filter("id % 20 = 0")).collect()))
    assert got == [(0, 1, 20, 5), (0, 2, 5, 3), (0, 3, 5, 3), (20, 1, 0, 5), (20, 2, 5, 4), (20, 3, 5, 4)]
    none = df.filter("false")
    assert T.top_k(none, none).count() == 0 and T.top_k(df, none).count() == 0


def test_large_integers_stay_exact():
    q, c = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0]])
    assert T._scores(q, c)[0, 0] == 2**60 + 3
    q, c = np.array([[2.0**40], [-(2.0**40)], [3.0], [2.0**100]]), np.array([[2.0**40], [2.0**22], [1.0], [0.0]])
    top = 2**63 - 1
    assert T._scores(q, c).tolist() == [[top, 2**62, 2**40, 0], [-top, -(2**62), -(2**40), 0], [3 * 2**40, 3 * 2**22, 3, 0], [top, top, 2**100 if 2**100 < top else top, 0]]


def test_top_k_of_very_large_components(spark, tmp_path):
    """Floats up to 3e38: products past 64 bits tie at the most that a long holds, and every row takes part."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((60, 4)).astype(np.float32)
    v[::7] *= np.float32(1e30)
    v[5] = 3e38
    v[41] = -3e38
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    whole = [(i, [math.floor(64 * float(x)) for x in v[i]]) for i in range(60)]
    want = []
    for q, a in whole[::20]:
        best = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in whole if i != q)[:20]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, T.op2(spark, str(tmp_path)).collect())) == sorted(want)


def test_cells_of_many_blocks_stay_exact(spark):
    rng = np.random.default_rng(12)
    v = np.floor(rng.standard_normal((3000, 8)) * 3000 / (1 + np.arange(3000)[:, None]))
    df = spark.createDataFrame([(i, x.tolist(), 5, 7) for i, x in enumerate(v)], "id long, v array<double>, dim int, norm int")
    T.BLOCK = 50
    try:
        got = T.top_k(df, df.filter("id % 20 = 0 and id < 400"), 20)
        assert sorted(map(tuple, got.collect())) == sorted(r for r in brute_top([(i, x) for i, x in enumerate(v)], 20) if r[0] < 400)
    finally:
        T.BLOCK = 2048


def brute_links(rows):
    ok = [(i, v, lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, adj = {}, {}
    for a, (i, v, lab) in enumerate(ok):
        u = np.array(v, float)
        adj[a] = [b for b, (_, w, k) in enumerate(ok) if a != b and k == lab and len(w) == len(v) and np.dot(u, w) / np.linalg.norm(u) / np.linalg.norm(w) >= S.THRESHOLD]
        n[a] = len(adj[a])
    out, seen = {}, {}
    for a in adj:
        if a in seen:
            continue
        stack, part = [a], {a}
        while stack:
            for b in adj[stack.pop()]:
                if b not in part:
                    part.add(b)
                    stack.append(b)
        low = min(ok[b][0] for b in part)
        seen |= dict.fromkeys(part, low)
    for a, (i, _, _) in enumerate(ok):
        out[i] = (n[a], seen[a])
    return out


@pytest.mark.parametrize("chunk", [7, 2048])
def test_links_equal_brute_force(spark, chunk):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((12, 24))
    v = np.concatenate([b + rng.standard_normal((25, 24)) * s for b, s in zip(base, np.linspace(0.05, 0.45, 12), strict=True)]).astype(np.float32)
    v[40:60] = v[40]
    rows = [(i, x.tolist(), int(i % 2)) for i, x in enumerate(v)]
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, v[40].tolist(), None), (904, [1.0], 0), (905, [2.0], 0), (906, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    S.CHUNK = chunk
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in S.near_duplicates(df).collect()}
    S.CHUNK = 2048
    want = brute_links(rows)
    assert len(got) == len(rows)
    for i, g in got.items():
        n, c = want.get(i, (0, i))
        assert g == (n, c, c == i), i


def test_links_of_odd_rows(spark):
    one = [1.0, 0.5]
    df = spark.createDataFrame([(None, one, 1), (3, one, 1), (3, one, 1), (None, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(str, S.near_duplicates(df).collect()))
    assert got == sorted(["Row(vec_id=None, n_links=2, component_id=3, kept=False)", *["Row(vec_id=3, n_links=2, component_id=3, kept=True)"] * 2, "Row(vec_id=None, n_links=0, component_id=None, kept=True)"])
    assert S.near_duplicates(df.filter("false")).count() == 0


def test_queries_equal_sql(spark, small, duck):
    for q, sql in ((T.op2, T.ORACLE), (S.op4, S.ORACLE)):
        got = q(spark, small)
        want = duck.sql(sql).to_arrow_table().select(got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r.values()) for r in want.to_pylist())


def test_constants():
    assert np.allclose(S.rotation(8) @ S.rotation(8).T, np.eye(8)) and S.block_edges(10, 8) == [(0, 8), (8, 10)]
    assert F is not None

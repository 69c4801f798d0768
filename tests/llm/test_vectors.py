import datetime

import numpy as np
import pyarrow as pa
import pytest

from stridelake.llm import clusters, multi_index, neighbours, vectors

SEG = "seg_id long, selected_win_idxs array<int>, quantized_windows array<array<array<float>>>, exported_at timestamp, v string, id int"
NAN = float("nan")


def frame(spark, rows):
    t = datetime.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, w, q, t, "v", 0) for i, w, q in rows], SEG)


def test_unit_vectors(spark):
    rows = [
        (1, [5, 3], [[[3.0, 4.0], [3.0, 4.0]], [[0.0, 2.0], [NAN, 1.0], None, [1.0]]]), (1, [5, 3], [[[3.0, 4.0], [3.0, 4.0]], [[0.0, 2.0]]]),
        (2, [1], [None]), (3, [1], None), (4, [1, 2, 3], [[[1.0, 0.0]], [], [[0.0, 0.0]]]), (5, None, [[[1.0, 1.0]]]), (None, [1], [[[1.0, 0.0]]]), (6, [None, 2], [[[1.0, 0.0]], [[0.0, 1.0]]]),
        (7, [1], [[[1.0, None]]]),
    ]
    df = frame(spark, rows)
    got = {(r["seg_id"], r["win"]): [round(float(v), 3) for v in np.frombuffer(r["v"], np.float32)] for r in vectors.unit_vectors(df, "window", 2).collect()}
    assert got == {(1, 5): [0.6, 0.8], (1, 3): [0.0, 1.0], (4, 1): [1.0, 0.0], (6, 2): [0.0, 1.0]}
    seg = {r["seg_id"] for r in vectors.unit_vectors(df, "segment", 2).collect()}
    assert seg == {1, 4, 5, 6}
    assert vectors.unit_vectors(df.limit(0), "window", 2).count() == 0


def clouds(rng, n_groups, size, dim=64, noise=0.05):
    c = rng.standard_normal((n_groups, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = np.repeat(c, size, 0) + noise * rng.standard_normal((n_groups * size, dim)) / dim**0.5 * 4
    return x


def seg_rows(x):
    return [(i, [0], [[v.tolist()]]) for i, v in enumerate(x)]


def brute(x, top, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = u @ u.T
    np.fill_diagonal(g, -2)
    out = set()
    for i in range(len(x)):
        for j in np.argsort(-g[i])[:top]:
            if g[i, j] >= least:
                out.add((min(i, j), max(i, j)))
    return out


def test_neighbours_equal_brute_force(spark):
    x = clouds(np.random.default_rng(1), 60, 8)
    x = np.vstack([x, np.random.default_rng(2).standard_normal((200, 64))])
    r = neighbours.similar_windows(frame(spark, seg_rows(x))).collect()
    got = {(r_["seg_a"], r_["seg_b"]) for r_ in r}
    want = brute(x, 5, 0.9)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert all(r_["seg_a"] < r_["seg_b"] and r_["cosine"] >= 0.9 for r_ in r)


def test_hot_cell_and_copies(spark):
    """A third of all vectors are copies: cells are cut, nothing is lost but ties."""
    rng = np.random.default_rng(3)
    x = np.vstack([np.repeat(rng.standard_normal((1, 64)), 400, 0), clouds(rng, 40, 10), rng.standard_normal((200, 64))]).astype(np.float32)
    v = spark.createDataFrame([(i, i, (a / np.linalg.norm(a)).tobytes()) for i, a in enumerate(x)], "id long, seg long, v binary")
    q = multi_index.fit(v, len(x), 64)
    got = {}
    for r in multi_index.nearest(v, q, dim=64, top=5, least=0.9, bin_rows=32).collect():
        got.setdefault(r["a"], []).append(r["b"])
    assert all(len(got[i]) == 5 and all(b < 400 for b in got[i]) for i in range(400))
    want = brute(x[400:], 5, 0.9)
    mine = {(min(a, b) - 400, max(a, b) - 400) for a, bs in got.items() for b in bs if a >= 400}
    assert len(mine & want) >= 0.95 * len(want)


def one_ball(rng, n, dim=64):
    """Vectors so close together, beside the only centroid, that no plane divides them."""
    c = rng.standard_normal(dim)
    x = c / np.linalg.norm(c) + 1e-2 * rng.standard_normal((n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def best_scores(x, segs, top):
    g = (x.astype(np.float64) @ x.astype(np.float64).T).astype(np.float32)
    g[segs[:, None] == segs[None, :]] = -2
    return -np.sort(-g, axis=1)[:, :top]


def test_hot_cell_is_compared_in_full(spark, monkeypatch):
    """One cell of 128 times ``bin_rows`` and more, of different vectors, in blocks and shares: every true partner is met."""
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 700)
    monkeypatch.setattr(multi_index, "VISIT_ROWS", 900)
    x = one_ball(np.random.default_rng(8), 5000)
    v = spark.createDataFrame([(i, i, a.tobytes()) for i, a in enumerate(x)], "id long, seg long, v binary")
    centre = np.zeros((1, 32), np.float32)
    got = multi_index.nearest(v, multi_index.Quantiser([centre, centre]), dim=64, top=5, least=0.9, bin_rows=32).toPandas()
    want = best_scores(x, np.arange(5000), 5)
    score = got.sort_values(["a", "score"], ascending=[True, False]).score.to_numpy().reshape(5000, 5)
    assert np.allclose(score, want, rtol=0, atol=1e-6)


@pytest.mark.parametrize("batch", [100, 5000])
def test_blocks_of_one_key_meet(monkeypatch, batch):
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 64)
    monkeypatch.setattr(multi_index, "ROWS", 50, raising=False)
    monkeypatch.setattr(multi_index, "COLS", 70, raising=False)
    rng = np.random.default_rng(9)
    ball = clouds(rng, 40, 12).astype(np.float32)
    ball /= np.linalg.norm(ball, axis=1, keepdims=True)
    copies = [np.repeat(ball[k : k + 1], n, 0) for k, n in ((0, 300), (20, 90), (40, 4))]
    x = np.vstack([ball, *copies])
    segs = np.concatenate([np.arange(480), np.arange(1000, 1300), np.where(np.arange(90) < 87, 7000, 7001), np.full(4, 8000)])
    o = rng.permutation(len(x))
    x, segs = x[o], segs[o]
    key = np.full(len(x), 5)
    key, home, ids = np.concatenate([[3] * 10, key, [9] * 10]), np.ones(len(x) + 20, bool), np.concatenate([-np.arange(1, 11), np.arange(len(x)), -np.arange(11, 21)])
    rows = [key, home, ids, np.concatenate([np.arange(-10, 0), segs, np.arange(-20, -10)]), np.vstack([ball[:10], x, ball[:10]])]
    batches = [pa.RecordBatch.from_arrays([*(pa.array(z[lo : lo + batch]) for z in rows[:4]), vectors.pack(rows[4][lo : lo + batch])], ["key", "home", "id", "seg", "v"]) for lo in range(0, len(key), batch)]
    found = {}
    for b in multi_index._rerank(64, 5, 0.5)(iter(batches)):
        for a, c, s in zip(*(z.to_pylist() for z in b.columns)):
            if a >= 0:
                assert c >= 0 and segs[a] != segs[c] and abs(s - float(x[a] @ x[c])) < 1e-5
                found.setdefault(a, {})[c] = s
    want = best_scores(x, segs, 5)
    for i in range(len(x)):
        got = sorted(found.get(i, {}).values(), reverse=True)[:5]
        need = [s for s in want[i] if s >= 0.5 + 1e-5]
        assert len(got) >= len(need) and np.allclose(got[: len(need)], need, atol=1e-5), i


def test_recall_in_a_dense_ball(spark):
    """A third of all vectors lie in one ball, nearly equal: the reach follows, and every hundredth vector finds its partners."""
    rng = np.random.default_rng(10)
    x = rng.standard_normal((36_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:12_000] = one_ball(rng, 12_000)
    x = x[rng.permutation(len(x))].astype(np.float32)
    table = pa.table({"id": np.arange(len(x)), "seg": np.arange(len(x)), "v": vectors.pack(x)})
    v = spark.createDataFrame(table)
    got = multi_index.nearest(v, multi_index.fit(v, len(x), 64), dim=64, top=5, least=0.9).where("a % 100 = 0").toPandas()
    asked = np.arange(0, len(x), 100)
    g = x[asked] @ x.T
    g[np.arange(len(asked)), asked] = -2
    best = np.argsort(-g, axis=1)[:, :5]
    want = {(int(a), int(b)) for a, bs, s in zip(asked, best, np.take_along_axis(g, best, 1)) for b, c in zip(bs, s) if c >= 0.9}
    assert len(want) > 500 and len(want & set(zip(got.a, got.b))) >= 0.9 * len(want)


def test_copies_beyond_the_indexed_ones(spark):
    """Many copies over many and over few segments: every list is as good as by brute force."""
    rng = np.random.default_rng(12)
    base = clouds(rng, 30, 6)
    x = np.vstack([base, np.repeat(base[:1], 200, 0), np.repeat(base[6:7], 150, 0)]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[180:380], x[380:] = x[0], x[6]
    segs = np.concatenate([np.arange(180), 1000 + np.arange(200) % 7, np.where(np.arange(150) < 148, 2000, 2001)])
    v = spark.createDataFrame([(i, int(s), a.tobytes()) for i, (s, a) in enumerate(zip(segs, x))], "id long, seg long, v binary")
    got = multi_index.nearest(v, multi_index.fit(v, len(x), 64), dim=64, top=5, least=0.5).toPandas()
    assert (segs[got.a] != segs[got.b]).all() and not got.duplicated(["a", "b"]).any()
    want = best_scores(x, segs, 5)
    mine = {a: np.sort(z.score.to_numpy())[::-1] for a, z in got.groupby("a")}
    for i in range(len(x)):
        need = want[i][want[i] >= 0.5 + 1e-5]
        assert len(mine[i]) >= len(need) and np.allclose(mine[i][: len(need)], need, atol=1e-5), i


def test_windows_of_one_segment_are_no_partners(spark):
    a = [1.0] + [0.0] * 63
    df = frame(spark, [(1, [0, 1], [[a], [a]]), (2, [0], [[a]])])
    assert {(r["seg_a"], r["win_a"], r["seg_b"], r["win_b"]) for r in neighbours.similar_windows(df).collect()} == {(1, 0, 2, 0), (1, 1, 2, 0)}


def test_clusters(spark):
    rng = np.random.default_rng(5)
    sizes = [2, 3, 5, 9, 17, 40]
    c = rng.standard_normal((len(sizes), 64))
    parts = [np.repeat(c[i : i + 1], n, 0) + 0.12 * rng.standard_normal((n, 64)) for i, n in enumerate(sizes)]
    x = np.vstack([*parts, rng.standard_normal((30, 64))])
    want = {}
    for i, n in enumerate(sizes):
        lo = sum(sizes[:i])
        want |= {k: set(range(lo, lo + n)) for k in range(lo, lo + n)}
    r = clusters.segment_clusters(frame(spark, seg_rows(x))).collect()
    groups = {}
    for row in r:
        groups.setdefault(row["cluster"], set()).add(row["seg_id"])
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values()}
    for row in r:
        assert row["size"] == len(groups[row["cluster"]]) and row["cosine"] >= 0.85
    for n in sizes:  # the most typical members have a rank
        assert sorted(row["typical_rank"] for row in r if row["size"] == n and row["typical_rank"]) == list(range(1, min(n, 10) + 1))


def plain_linkage(x, least):
    """Average linkage, one best pair at a time."""
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        m = np.array([x[g].mean(0) for g in groups])
        s = m @ m.T
        np.fill_diagonal(s, -2)
        i, j = np.unravel_index(int(s.argmax()), s.shape)
        if s[i, j] < least:
            break
        groups[i] = groups[i] + groups[j]
        del groups[j]
    return {frozenset(g) for g in groups if len(g) > 1}


@pytest.mark.parametrize("local,finish_edges", [(2048, 1000), (4, 1000), (4, 20)])
def test_clusters_equal_plain_linkage(spark, local, finish_edges):
    """Groups that touch each other, in components worked off in one task and in rounds over all tasks."""
    rng = np.random.default_rng(15)
    c = rng.standard_normal((12, 64))
    x = np.vstack([np.repeat(c[i : i + 1], 9, 0) + rng.uniform(0.25, 0.5) * rng.standard_normal((9, 64)) for i in range(12)])
    x = np.vstack([x, (c[:6] + c[6:]) / 2, x[:5], x[:1], x[:1]]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame(pa.table({"id": np.arange(len(x)), "v": vectors.pack(x)}))
    members, groups = clusters.reciprocal_clusters(v, local=local, finish_edges=finish_edges, links=8)
    got = {}
    for r in members.collect():
        got.setdefault(r["id"], set()).add(r["member"])
    assert {frozenset(g) for g in got.values()} == plain_linkage(x.astype(np.float64), 0.8)
    assert {r["id"]: r["n"] for r in groups.collect()} == {k: len(g) for k, g in got.items()}


@pytest.mark.parametrize("finish_edges", [1000, 3])
def test_components(spark, tmp_path, finish_edges):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (100, 102), (200, 201), (40, 50), (50, 60), (40, 60)]
    spark.createDataFrame(edges, "lo long, hi long").write.parquet(str(tmp_path / "e"))
    got = {}
    for r in clusters.components(spark.read.parquet(str(tmp_path / "e")), finish_edges=finish_edges).collect():
        got.setdefault(r["comp"], set()).add((r["id"], r["size"]))
    want = [set(range(31)), {100, 101, 102}, {200, 201}, {40, 50, 60}]
    assert sorted(map(sorted, got.values())) == sorted(sorted((i, len(w)) for i in w) for w in want)


def test_clusters_of_copies(spark):
    a = np.random.default_rng(6).standard_normal(64)
    r = clusters.segment_clusters(frame(spark, seg_rows(np.repeat(a[None], 50, 0)))).collect()
    assert len(r) == 50 and len({x["cluster"] for x in r}) == 1


@pytest.mark.parametrize("rows", [[], [(1, [0], [[[1.0] * 64]])]])
def test_too_few(spark, rows):
    assert clusters.segment_clusters(frame(spark, rows)).count() == 0
    assert neighbours.similar_windows(frame(spark, rows)).count() == 0


def test_walk_visits_by_distance():
    rng = np.random.default_rng(7)
    d1, d2 = rng.random(9), rng.random(9)
    cells = multi_index.walk(d1, d2, lambda i, j: (i + j) % 2, 20, 9)
    s = [d1[i] + d2[j] for i, j in cells]
    assert s == sorted(s) and len(cells) == 20 and all((i + j) % 2 for i, j in cells)
    every = sorted(d1[i] + d2[j] for i in range(9) for j in range(9) if (i + j) % 2)
    assert np.allclose(s, every[:20])

import numpy as np

from gridpulse.llm import nearest

DATA = "/root/testdata"


def brute(ids, vectors, queries, k):
    out = {}
    units = vectors / np.sqrt((vectors**2).sum(1))[:, None]
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        score = units @ units[at]
        order = [i for i in np.lexsort((ids, -np.round(score, 12))) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), score[i]) for i in order]
    return out


def test_recall_against_brute_force(spark):
    for sf in ("sf0.01", "sf0.1"):
        table = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet")
        rows = table.collect()
        ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
        want = brute(ids, vectors, [i for i in ids.tolist() if i % 50 == 0], 5)
        got = {}
        for r in nearest.nearest(table, "vec_id", "embedding", "id % 50 = 0").collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert set(got) == set(want)
        hits = 0
        for q, found in got.items():
            found.sort()
            assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
            exact = dict(want[q])
            hits += sum(v in exact for _, v, _ in found)
            assert all(abs(s - exact[v]) < 1e-12 for _, v, s in found if v in exact)
        assert hits / (5 * len(want)) >= 0.9


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CANDIDATES_A_BLOCK", 16)
    monkeypatch.setattr(nearest, "QUERIES_A_BLOCK", 2)
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100)]
    rows += [(i, rng.normal(size=4).tolist()) for i in range(100, 160)]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan")] * 4),
             (250, [float("inf"), 0.0, 0.0, 0.0]), (204, [1.0, 2.0]), (None, [1.0, 2.0, 3.0, 4.0]), (50, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS list")
    got = nearest.nearest(df, "vec_id", "embedding", "id % 50 = 0", probed_share=1.0).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by) == {0, 50, 100, 150}
    assert by[0] == [1, 2, 3, 4, 5] and by[50] == [0, 1, 2, 3, 4]
    two = df.filter("vec_id in (0, 100)")
    assert [(r.query_id, r.vec_id) for r in nearest.nearest(two, "vec_id", "embedding", "id = 0").collect()] == [(0, 100)]
    assert nearest.nearest(df.limit(0), "vec_id", "embedding", "true").count() == 0


def test_repeated_rows_leave_room_for_others(spark):
    rng = np.random.default_rng(5)
    ids, vectors = np.arange(1, 41), rng.normal(size=(40, 8))
    vectors[1:9] = vectors[0] + 0.01 * np.arange(1, 9)[:, None] * rng.normal(size=(8, 8))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, vectors)]
    rows += rows * 5  # every row more often than k
    rows += [(2, (vectors[1] * 2**n).tolist()) for n in range(1, 8)]  # one id at one score, rows not equal
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.nearest(df, "vec_id", "embedding", "id = 1", probed_share=1.0).collect()
    want = [i for i, _ in brute(ids, vectors, [1], 5)[1]]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == want

import hashlib
import math

import numpy as np
import pytest

from heathgrid.llm import centroids, registry


def plain(rows, k=8, rounds=10, salt="3", size=64):
    """With every distance computed, in Python's whole numbers."""
    kept = [(i, [math.floor(1024 * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], dtype="<i4").tobytes()))
    at = [x for _, x in order[:k]]

    def assign():
        out = []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in at]
            out.append((min(d), d.index(min(d))))
        return out

    for _ in range(rounds):
        own = assign()
        for c in range(len(at)):
            if mine := [x for (_, x), (_, j) in zip(kept, own, strict=True) if j == c]:
                at[c] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    own = assign()
    inertia = {c: sum(d for d, j in own if j == c) for c in range(len(at))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(kept, own, strict=True)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


KIND = "vec_id long, embedding array<float>"


@pytest.mark.parametrize(("n", "spread"), [(300, 1.0), (300, 0.02), (5, 1.0), (8, 1.0), (1, 1.0)])
def test_against_every_distance(spark, n, spread):
    r = np.random.default_rng(n)
    middle = r.normal(size=(6, 64))
    rows = [(i, (middle[i % 6] + spread * r.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]
    assert found(centroids.report(spark.createDataFrame(rows, KIND).repartition(3))) == plain(rows)


def test_ties_repeats_and_empty_clusters(spark):
    """Few lattice points: many equal distances, equal centroids and clusters that stay empty."""
    r = np.random.default_rng(1)
    rows = [(i % 90, [float(v) for v in np.repeat(r.integers(-1, 2, size=4), 16)]) for i in range(120)]
    assert found(centroids.report(spark.createDataFrame(rows, KIND))) == plain(rows)


@pytest.mark.parametrize("seed", range(4))
def test_bounds_agree_with_full_scans_over_moving_centroids(seed):
    r = np.random.default_rng(seed)
    x = r.integers(-60, 60, size=(500, 3)).astype(np.int32)
    own, upper, lower = np.full(500, -1), np.zeros(500), np.zeros(500)
    at, before, skipped = r.integers(-60, 60, size=(12, 3)), None, 0
    for _ in range(12):
        search = centroids.Search(at, before)
        scans = []
        scan, search.scan = search.scan, lambda x, todo, *rest, f=search.scan: (scans.append(len(todo)), f(x, todo, *rest))
        own, upper, lower = search.nearest(x, own, upper, lower)
        d = ((x[:, None, :].astype(int) - at[None]) ** 2).sum(axis=2)
        assert (own == d.argmin(axis=1)).all()
        assert (upper**2 >= d.min(axis=1)).all()
        skipped += 500 - sum(scans)
        before, at = at, np.array([x[own == c].sum(axis=0) // max(1, (own == c).sum()) if (own == c).any() else at[c] for c in range(12)])
    assert skipped > 1000


def test_defined_cases(spark):
    good = [0.5] * 64
    rows = [(0, good), (1, None), (2, good[:63]), (3, [*good[:63], None]), (4, [*good[:63], float("nan")]), (5, [*good[:63], float("inf")]), (None, [-0.0001] * 64), (7, []), (0, good)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], KIND + ", own int, x int")
    assert found(centroids.report(docs)) == plain(rows)
    assert found(centroids.report(docs.where("false"))) == []
    assert found(centroids.report(spark.createDataFrame([(0, [1e30] * 64)], "vec_id long, embedding array<double>"))) == []
    named = spark.createDataFrame([("a", good), ("b", [0.25] * 64)], "vec_id string, embedding array<double>")
    assert found(centroids.report(named)) == plain([("a", good), ("b", [0.25] * 64)])


def test_rounds_that_change_nothing_are_not_run(spark):
    rows = [(i, [float(i % 8)] * 64) for i in range(64)]
    seen = []
    centroids.cluster(spark.createDataFrame(rows, KIND), note=seen.append)
    assert len(seen) < 11


def test_query(spark):
    df = registry.op13_centroid_clustering(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert found(df) == plain(rows)
    assert df.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]

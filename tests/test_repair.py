import random

import pytest

from heathgrid.operators import repair


def odd(p, rings):
    return repair.inside(p, [s for r in rings for s in zip(r, r[1:] + r[:1], strict=True)])


def held(p, polygons):
    return sum(odd(p, x) for x in polygons)


def simple(ring):
    sides = list(zip(ring, ring[1:] + ring[:1], strict=True))
    for i, (a, b) in enumerate(sides):
        for j in range(i + 2, len(sides)):
            if (i, j) != (0, len(sides) - 1) and repair.meets(a, b, *sides[j]):
                return False
    return len(set(ring)) == len(ring) > 2


@pytest.mark.parametrize("seed", range(30))
def test_the_same_ground_in_simple_rings(seed):
    r = random.Random(seed)
    point = (lambda: (r.uniform(0, 10), r.uniform(0, 10))) if seed % 2 else (lambda: (float(r.randint(0, 5)), float(r.randint(0, 5))))
    rings = [[point() for _ in range(r.randint(3, 9))] for _ in range(r.randint(1, 3))]
    polygons = repair.made_valid(rings)
    assert all(simple(x) for p in polygons for x in p)
    assert all(repair.area(p[0]) > 0 and all(repair.area(h) < 0 for h in p[1:]) for p in polygons)
    for _ in range(400):
        p = (r.uniform(-1, 11), r.uniform(-1, 11))
        assert held(p, polygons) == odd(p, rings)


def test_known_shapes():
    tie = repair.made_valid([[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]])
    assert [len(p) for p in tie] == [1, 1] and [repair.area(p[0]) for p in tie] == [1.0, 1.0]
    eight = repair.made_valid([[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)], [(1.5, 1.5), (2.5, 1.5), (2.5, 2.5), (1.5, 2.5)]])
    assert [len(p) for p in eight] == [2, 1] and sum(repair.area(x) for p in eight for x in p) == 13.0
    assert repair.made_valid([[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]) == [] and repair.made_valid([]) == []
    twice = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]] * 2
    assert repair.made_valid(twice) == []


def test_table(spark):
    square, tie = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)], [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]
    rows = spark.createDataFrame([(1, [square]), (2, [tie]), (3, None), (4, []), (5, [[(0.0, 0.0)]]), (6, [tie, None])], "id long, polygon array<array<struct<lng:double,lat:double>>>")
    got = {r.id: r.polygons for r in repair.repaired(rows).collect()}
    assert len(got) == 6 and [len(x) for x in got[1]] == [1] and len(got[1][0][0]) == 4
    assert len(got[2]) == 2 and got[3] is None and got[4] == [] and got[5] == [] and len(got[6]) == 2

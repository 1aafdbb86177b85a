import random

import pytest
from pyspark.sql import functions as F

from heathgrid.operators import landform


def plain(cells):
    left, out = set(cells), {}
    while left:
        start = min(left)
        group, stack = set(), [start]
        while stack:
            x, y = stack.pop()
            if (x, y) in left:
                left.discard((x, y))
                group.add((x, y))
                stack += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
        out |= dict.fromkeys(group, frozenset(group))
    return out


@pytest.mark.parametrize(("seed", "share"), [(0, 0.4), (1, 0.6)])
def test_groups_over_many_tiles(spark, seed, share):
    r = random.Random(seed)
    cells = [(x, y) for x in range(-20, 30) for y in range(-10, 30) if r.random() < share]
    rows = landform.groups(spark.createDataFrame([("g", *c) for c in cells] + [("h", 0, 0)], "grid_id string, x int, y int"), 8).collect()
    want = plain(cells)
    got = {(q.x, q.y): (q.whole, q.cells_in) for q in rows if q.grid_id == "g"}
    assert len(rows) == len(cells) + 1 and got.keys() == want.keys()
    assert all(got[c][1] == len(want[c]) for c in want)
    assert len({v[0] for v in got.values()}) == len(set(want.values())) and all(len({got[c][0] for c in g}) == 1 for g in set(want.values()))


def test_a_snake_through_every_tile(spark):
    cells = [(x, y) for y in range(0, 40, 2) for x in range(40)] + [(39 if y % 4 == 1 else 0, y) for y in range(1, 39, 2)]
    rows = landform.groups(spark.createDataFrame([("g", *c) for c in cells], "grid_id string, x int, y int"), 5)
    assert [(q.whole, q.cells_in) for q in rows.select("whole", "cells_in").distinct().collect()] == [(0, len(cells))]
    small = spark.createDataFrame([("g", x, y, int((x, y) in set(cells) or (x, y) == (3, 3))) for x in range(6) for y in range(6)], "grid_id string, x int, y int, bench int")
    kept = landform.remove_small(small, size=4)
    assert kept.count() == 36 and kept.dtypes == small.dtypes
    assert landform.groups(small.where("false")).count() == 0
    assert kept.where(F.col("bench") == 1).count() == small.where("bench = 1").count() - (0 if (3, 2) in set(cells) else 1)

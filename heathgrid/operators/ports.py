"""Least costs at the rims of tiles, found level by level, so that long ways don't need a round a tile.

A port is a cell of a block from which a step leads to a cell of another block. A block is kept as its ports and the
hours between them on ways within it. Two blocks make one: their ports that don't lead
out of it are eliminated, each as a cell between all the others. So a raster takes as many levels as its sides in tiles can be
halved; down again, a block's known ports give those of its parts. A block has as many ports as it has border
cells with something beyond, so one that spans a narrow raster stays small however long it is.

Hours are sums of the same steps as a search over the whole makes, added up in another order: they differ in the last digits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heathgrid.shared import cut

STEPS = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
DX, DY, TURN = np.array([(*d, i) for i, d in enumerate(STEPS)]).T[:, :, None]
WAY = np.hypot(DX, DY)
#: Cells that are settled without halving them; ports of the parts of a block, beyond which blocks aren't joined any more; nodes eliminated at a time.
LEAF, MOST, FEW = 64, 2048, 32
#: Columns of a node: its place, what its steps cost by, and the directions (bits, as in STEPS) of its neighbours.
X, Y, BASE, GX, GY, OUT = range(6)
BLOCK = "bx int, by int, n int, nodes binary, hours binary, kept binary, way binary, parts array<int>"

Box = tuple[int, int, int, int]


def step_hours(base0, base1, rise, way):
    """Hours of a step over that distance and rise, between cells of these base costs."""
    return way / 1000 / (6 * np.exp(-3.5 * np.abs(rise / way + 0.05))) * (base0 + base1) / 2


def steps(nodes: np.ndarray, cell: float, reverse: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From, to and hours of all steps between nodes; reverse: of the steps back."""
    key = (nodes[:, Y].astype(np.int64) << 32) + nodes[:, X].astype(np.int64)
    order = np.argsort(key)
    want = key + (DY << 32) + DX
    at = order[np.minimum(np.searchsorted(key[order], want), len(key) - 1)]
    turn, one = np.nonzero(key[at] == want)
    two = at[turn, one]
    dx, dy, way = DX[turn, 0], DY[turn, 0], (WAY * cell)[turn, 0]
    a, b = nodes[one].T, nodes[two].T
    hours = step_hours(a[BASE], b[BASE], ((a[GX] + b[GX]) * dx + (a[GY] + b[GY]) * dy) * cell / 2, way)
    known = ~np.isnan(hours)
    one, two, hours = one[known], two[known], hours[known]
    return (two, one, hours) if reverse else (one, two, hours)


def leads_out(nodes: np.ndarray, box: Box) -> np.ndarray:
    """Whether a step leads from a node out of the box (x, y, width, height)."""
    x0, y0, w, h = box
    x, y = nodes[:, X] + DX, nodes[:, Y] + DY
    beyond = (x < x0) | (x >= x0 + w) | (y < y0) | (y >= y0 + h)
    return (((nodes[:, OUT].astype(int) >> TURN) & 1).astype(bool) & beyond).any(axis=0)


def joined(parts: list[tuple[np.ndarray, np.ndarray]], kept: np.ndarray, cell: float, reverse: bool) -> np.ndarray:
    """Hours from the sources (row 0) and from every node of all parts to every one, on ways between whose ends no kept node lies but within a part."""
    nodes = np.concatenate([p for p, _ in parts])
    hours, at = np.full((len(nodes) + 1, len(nodes)), np.inf), 0
    for part, own in parts:
        to = slice(at, at + len(part))
        hours[0, to], hours[at + 1 : at + 1 + len(part), to] = own[0], own[1:]
        at += len(part)
    one, two, step = steps(nodes, cell, reverse)
    hours[one + 1, two] = np.minimum(hours[one + 1, two], step)
    gone = np.flatnonzero(~kept)
    for some in (gone[i : i + FEW] for i in range(0, len(gone), FEW)):  # a few nodes and rows at a time stay in the processor's cache
        into, onward = hours[:, some], hours[some + 1]
        for i, k in enumerate(some):
            np.minimum(into, into[:, i, None] + into[k + 1], out=into)
        for rows, ahead in ((hours[i : i + FEW], into[i : i + FEW]) for i in range(0, len(hours), FEW)):
            room = np.empty_like(rows)
            for i in np.flatnonzero(np.isfinite(ahead).any(axis=0)):
                np.minimum(rows, np.add(ahead[:, i, None], onward[i], out=room), out=rows)
    return hours


def dissected(nodes: np.ndarray, source: np.ndarray, box: Box, cell: float, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ports among a box's nodes and their hours, as in joined: halves first, so that few cells meet at a time."""
    x0, y0, w, h = box
    if len(nodes) <= LEAF or w * h <= LEAF:
        own = np.full((len(nodes) + 1, len(nodes)), np.inf)
        own[0, source] = 0.0
        parts = [(nodes, own)]
    else:
        half = (w // 2, 0) if w >= h else (0, h // 2)
        first = nodes[:, X] < x0 + half[0] if half[0] else nodes[:, Y] < y0 + half[1]
        boxes = ((x0, y0, half[0] or w, half[1] or h), (x0 + half[0], y0 + half[1], w - half[0], h - half[1]))
        parts = [dissected(nodes[m], source[m], b, cell, reverse) for m, b in zip((first, ~first), boxes, strict=True) if m.any()]
    nodes = np.concatenate([p for p, _ in parts])
    kept = leads_out(nodes, box)
    hours = joined(parts, kept, cell, reverse)
    return nodes[kept], hours[np.concatenate([[True], kept])][:, kept]


def stored(nodes: np.ndarray, hours: np.ndarray) -> dict:
    return {"n": len(nodes), "nodes": nodes.tobytes(), "hours": np.ascontiguousarray(hours).tobytes()}


def loaded(n: int, nodes: bytes, hours: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(nodes).reshape(n, 6), np.frombuffer(hours).reshape(n + 1, n)


def spread_down(row) -> list[tuple[int, int, bytes]]:
    """Place and ports' hours of a block's parts, from those of the block's own ports."""
    kept = np.frombuffer(row.kept, dtype=bool)
    own = np.frombuffer(row.cost)
    whole = np.empty(len(kept))
    whole[kept] = own
    way = np.frombuffer(row.way).reshape(len(own) + 1, -1)
    whole[~kept] = (np.concatenate([[0.0], own])[:, None] + way).min(axis=0)
    found, at = [], 0
    for bx, by, n in np.asarray(row.parts).reshape(-1, 3).tolist():
        found.append((bx, by, whole[at : at + n].tobytes()))
        at += n
    return found


def rim_costs(static: DataFrame, sources: list[tuple[int, int]], corner: tuple[int, int], across: int, along: int, cell: float, reverse: bool, size: int) -> DataFrame:
    """grid_id, x, y, cost of all ports of tiles that are reached; static: cells of tiles and of the ring around (tx, ty), the least of which is `corner`, so many across and along.

    If blocks get too many ports, those joined so far only hold the ways from sources within them: no least costs, but bounds.
    """
    grid = f"grid_id {dict(static.dtypes)['grid_id']}"
    starts = {(int(x), int(y)) for x, y in sources}

    def rims(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(key[1]), int(key[2])
        box = (tx * size, ty * size, size, size)
        tile = tile[tile["base"].notna()]
        x, y = tile["x"].to_numpy() - box[0] + 1, tile["y"].to_numpy() - box[1] + 1
        open_ = np.zeros((size + 4, size + 4), bool)
        open_[y + 1, x + 1] = True
        out = sum(open_[y + 1 + dy, x + 1 + dx].astype(int) << i for i, (dx, dy) in enumerate(STEPS))
        nodes = np.column_stack([tile[c].to_numpy(float) for c in ("x", "y", "base", "dzdx", "dzdy")] + [np.asarray(out, float)])
        nodes = nodes[(x > 0) & (x <= size) & (y > 0) & (y <= size)]
        if not len(nodes):
            return pd.DataFrame([], columns=["grid_id", *names])
        source = np.array([(int(a), int(b)) in starts for a, b in nodes[:, :2]], bool)
        ports = dissected(nodes, source, box, cell, reverse)
        return pd.DataFrame([{"grid_id": key[0], "bx": tx - corner[0], "by": ty - corner[1], **stored(*ports), "kept": b"", "way": b"", "parts": []}])

    def joining(wide: int, high: int):
        def join(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
            bx, by = int(key[1]), int(key[2])
            box = (corner[0] * size + bx * wide, corner[1] * size + by * high, wide, high)
            parts = [loaded(b.n, b.nodes, b.hours) for b in blocks.itertuples()]
            nodes = np.concatenate([p for p, _ in parts])
            kept = leads_out(nodes, box)
            hours = joined(parts, kept, cell, reverse)[np.concatenate([[True], kept])] if len(nodes) else np.empty((1, 0))
            places = [int(v) for b in blocks.itertuples() for v in (b.bx, b.by, b.n)]
            return pd.DataFrame([{"grid_id": key[0], "bx": bx, "by": by, **stored(nodes[kept], hours[:, kept]), "kept": kept.tobytes(), "way": np.ascontiguousarray(hours[:, ~kept]).tobytes(), "parts": places}])

        return join

    def first(batches):
        for rows in batches:
            rows["cost"] = [loaded(r.n, r.nodes, r.hours)[1][0].tobytes() for r in rows.itertuples()]
            yield rows[["grid_id", "bx", "by", "cost"]]

    def down(batches):
        for rows in batches:
            yield pd.DataFrame([(r.grid_id, *part) for r in rows.itertuples() for part in spread_down(r)], columns=["grid_id", "bx", "by", "cost"])

    def opened(batches):
        for rows in batches:
            for r in rows.itertuples():
                nodes = np.frombuffer(r.nodes).reshape(-1, 6)
                cost = np.frombuffer(r.cost)
                reached = np.isfinite(cost)
                yield pd.DataFrame({"grid_id": r.grid_id, "x": nodes[reached, X].astype(int), "y": nodes[reached, Y].astype(int), "cost": cost[reached]})

    names = ["bx", "by", "n", "nodes", "hours", "kept", "way", "parts"]
    levels = [cut(static.groupBy("grid_id", "tx", "ty").applyInPandas(rims, f"{grid}, {BLOCK}"))]
    wide, high = size, size
    while max(across, along) > 1:
        if across > 1 and (wide <= high or along == 1):
            halved, wide, across = "bx", 2 * wide, (across + 1) // 2
        else:
            halved, high, along = "by", 2 * high, (along + 1) // 2
        block = ["grid_id", *(F.shiftright(c, int(c == halved)).alias(f"p{c}") for c in ("bx", "by"))]
        if (levels[-1].groupBy(*block).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) > MOST:
            break
        rows = levels[-1].select("*", *block[1:]).groupBy("grid_id", "pbx", "pby")
        levels.append(cut(rows.applyInPandas(joining(wide, high), f"{grid}, {BLOCK}")))
    kind = f"{grid}, bx int, by int, cost binary"
    known = levels[-1].select("grid_id", "bx", "by", "n", "nodes", "hours").mapInPandas(first, kind)
    for rows in levels[:0:-1]:
        known = cut(rows.select("grid_id", "bx", "by", "kept", "way", "parts").join(known, ["grid_id", "bx", "by"]).mapInPandas(down, kind))
    return levels[0].select("grid_id", "bx", "by", "nodes").join(known, ["grid_id", "bx", "by"]).mapInPandas(opened, f"{grid}, x int, y int, cost double")

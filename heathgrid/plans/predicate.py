"""Saved terrain predicates: JSON trees compiled to one boolean Column, which is never NULL.

A leaf over unknown ground is false, and so a negated leaf is true there; kleene=True keeps unknown
ground unknown instead, up to the root.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from heathgrid.functions.num import azimuth_delta

#: Metric names and the columns that hold them.
METRICS = {
    "elevation": "z", "slope": "slope", "aspect": "aspect", "curvatureProfile": "curvature_profile", "curvaturePlan": "curvature_plan", "tpiSmall": "tpi_small", "tpiLarge": "tpi_large",
    "ruggedness": "ruggedness", "insolation": "insolation", "windExposure": "wind_exposure", "shelter": "shelter", "skyView": "sky_view", "bedding": "bedding",
}
WIND_METRICS = ("windExposure", "shelter", "bedding")
#: Limits of a tree.
MOST_DEPTH, MOST_OPERANDS = 12, 32


def within(metric: str, low: float | None = None, high: float | None = None) -> dict:
    return {"kind": "range", "metric": metric} | ({} if low is None else {"min": low}) | ({} if high is None else {"max": high})


def every(*operands: dict) -> dict:
    return {"kind": "all", "operands": list(operands)}


#: The presets.
PRESETS = {
    "Bedding benches": every({"kind": "bench", "isBench": True}, within("slope", None, 10)),
    "Saddles & crossings": {"kind": "wood", "features": [3]},
    "Midslope drainages": every({"kind": "weiss", "classes": [2]}, within("slope", 3, 30)),
    "Leeward spur points": every({"kind": "weiss", "classes": [9, 8]}, within("windExposure", None, -0.25), within("slope", 10, 35)),
    "Late-season sun slopes": every(within("insolation", 0.6), within("slope", 5)),
    "Sidehill walkable grade": within("slope", 8, 20),
    "Thermal sinks": every(within("curvaturePlan", None, -0.001), within("skyView", None, 0.72)),
}


class InvalidPredicate(ValueError):
    pass


def children(p: dict) -> list[dict]:
    return [p["operand"]] if p["kind"] == "not" else p["operands"] if p["kind"] in ("all", "any") else []


def depth(p: dict) -> int:
    return 1 + max(map(depth, children(p)), default=0)


def widest(p: dict) -> int:
    return max([len(children(p)) if p["kind"] in ("all", "any") else 0, *map(widest, children(p))])


def has_negation(p: dict) -> bool:
    return p["kind"] == "not" or any(map(has_negation, children(p)))


def has_condition(p: dict) -> bool:
    return p["kind"] not in ("not", "all", "any") or any(map(has_condition, children(p)))


def limit_violation(p: dict) -> str | None:
    if depth(p) > MOST_DEPTH:
        return f"nested deeper than {MOST_DEPTH}"
    return f"more than {MOST_OPERANDS} conditions in a group" if widest(p) > MOST_OPERANDS else None


def parse(text: str | dict) -> dict:
    """A checked tree; raises InvalidPredicate."""
    p = json.loads(text) if isinstance(text, str) else text
    check(p, 1)
    return p


def check(p: object, level: int) -> None:
    if not isinstance(p, dict) or "kind" not in p:
        raise InvalidPredicate("a condition must be an object with a kind")
    if level > MOST_DEPTH:
        raise InvalidPredicate(f"nested deeper than {MOST_DEPTH}")
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
    kind = p["kind"]
    if kind == "range":
        if p.get("metric") not in METRICS or p["metric"] == "aspect":
            raise InvalidPredicate(f"unknown metric {p.get('metric')!r}")
        if not all(number(p[k]) for k in ("min", "max") if p.get(k) is not None):
            raise InvalidPredicate("bounds must be finite numbers")
    elif kind == "aspect":
        if not (number(p.get("centerDeg")) and number(p.get("toleranceDeg"))):
            raise InvalidPredicate("an aspect window needs a centre and a tolerance")
    elif kind in ("weiss", "wood"):
        codes = p.get("classes" if kind == "weiss" else "features")
        if not isinstance(codes, list) or not all(map(number, codes)):
            raise InvalidPredicate("classes must be a list of numbers")
    elif kind == "bench":
        if not isinstance(p.get("isBench"), bool):
            raise InvalidPredicate("isBench must be true or false")
    elif kind == "not":
        check(p.get("operand"), level + 1)
    elif kind in ("all", "any"):
        if not isinstance(p.get("operands"), list) or len(p["operands"]) > MOST_OPERANDS:
            raise InvalidPredicate(f"a group needs a list of at most {MOST_OPERANDS} conditions")
        for x in p["operands"]:
            check(x, level + 1)
    else:
        raise InvalidPredicate(f"unknown kind {kind!r}")


def columns(p: dict) -> set[str]:
    """Columns that a tree reads; an aspect also needs the slope, which tells flat from unknown."""
    kind = p["kind"]
    own = {METRICS[p["metric"]]} if kind == "range" else {"aspect", "slope"} if kind == "aspect" else {kind} if kind in ("weiss", "wood", "bench") else set()
    return own.union(*map(columns, children(p)))


def wind_columns(p: dict) -> set[str]:
    return {METRICS[m] for m in WIND_METRICS} & columns(p)


def compiled(p: dict, available: list[str], kleene: bool = False) -> Column:
    """The tree as a boolean Column over the available columns; a leaf on a column that isn't there is false."""
    found = _compiled(p, set(available), kleene)
    return found if kleene else F.coalesce(found, F.lit(False))


def _compiled(p: dict, available: set[str], kleene: bool) -> Column:
    kind = p["kind"]
    down = lambda x: _compiled(x, available, kleene)
    if kind == "not":
        return ~down(p["operand"])
    if kind in ("all", "any"):
        out = F.lit(kind == "all")
        for x in p["operands"]:
            out = out & down(x) if kind == "all" else out | down(x)
        return out
    leaf = _leaf(p) if columns(p) <= available else F.lit(False)
    return leaf if kleene else F.coalesce(leaf, F.lit(False))


def _leaf(p: dict) -> Column:
    kind = p["kind"]
    if kind == "range":
        c = F.col(METRICS[p["metric"]])
        out = c.isNotNull() & F.lit(True)
        if p.get("min") is not None:
            out = c >= float(p["min"])
        if p.get("max") is not None:
            out = (out & (c <= float(p["max"]))) if p.get("min") is not None else c <= float(p["max"])
        return out
    if kind == "aspect":
        near = F.abs(azimuth_delta(F.col("aspect"), F.lit(float(p["centerDeg"])))) <= float(p["toleranceDeg"])
        flat = F.col("slope").isNotNull() & F.lit(bool(p.get("includeFlat", False)))
        return F.when(F.col("aspect") < 0, flat).otherwise(near)
    if kind in ("weiss", "wood"):
        return F.col(kind).isin([int(x) for x in p["classes" if kind == "weiss" else "features"]])
    return F.col("bench") == (1 if p["isBench"] else 0)


def advice(share: Column) -> Column:
    """tighten or loosen a filter that matches much or next to nothing of an area."""
    return F.when(share > 0.35, "tighten").when(share < 0.002, "loosen")


def describe_aspect(center: float, tolerance: float) -> str:
    if tolerance >= 180:
        return "any direction"
    names = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
    name = lambda d: names[math.floor((d % 360) / 45 + 0.5) % 8]
    return f"{name(center - tolerance)} to {name(center + tolerance)}"


def default(kind: str) -> dict:
    """The leaf that a new condition of a kind starts as."""
    return {
        "range": within("slope", 0, 20), "aspect": {"kind": "aspect", "centerDeg": 180, "toleranceDeg": 45, "includeFlat": False}, "weiss": {"kind": "weiss", "classes": []},
        "wood": {"kind": "wood", "features": []}, "bench": {"kind": "bench", "isBench": True}, "not": {"kind": "not", "operand": within("slope", 0, 20)},
        "all": every(), "any": {"kind": "any", "operands": []},
    }[kind]

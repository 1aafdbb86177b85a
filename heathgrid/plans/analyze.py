"""From a set of wanted layers to one plan: how far they reach, and only the columns they need."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heathgrid.functions import solar, wind
from heathgrid.operators import landform, mosaic, rays, surface
from heathgrid.operators.mosaic import InsufficientHalo
from heathgrid.plans import predicate
from heathgrid.shared import cut

#: Reach in cells of each layer's window.
SMALL, LARGE, VRM, RING = 3, 20, 4, 8
LAYERS = ("slope", "aspect", "curvature", "ruggedness", "vrm", "tpi_small", "tpi_large", "weiss", "wood", "bench", "hillshade", "multi_hillshade", "insolation", "wind_exposure", "shelter", "sky_view", "bedding")
REACH = {
    "tpi_small": SMALL, "tpi_large": LARGE, "weiss": LARGE, "vrm": VRM + 1, "bench": RING + 1, "sky_view": rays.SKY_REACH, "shelter": rays.SHELTER_REACH,
    "bedding": max(rays.SHELTER_REACH, VRM + 1, RING + 1),
}
WINDY = ("wind_exposure", "shelter", "bedding")
#: Columns of predicates, by the layer that makes them, where the names differ.
MADE_BY = {"curvature_profile": "curvature", "curvature_plan": "curvature", "z": "slope"}


def required_halo(layers: set[str]) -> int:
    return max((REACH.get(x, 1) for x in layers), default=0)


def layers_of(tree: dict) -> set[str]:
    """Layers that a predicate needs."""
    return {MADE_BY.get(c, c) for c in predicate.columns(tree)}


def widened(x0: int, x1: int, y0: int, y1: int, layers: set[str]) -> tuple[int, int, int, int]:
    """Bounds to scan for results within bounds."""
    h = required_halo(layers)
    return x0 - h, x1 + h, y0 - h, y1 + h


def analyze(cells: DataFrame, layers: set[str], cell_size: float, halo: int, wind_from: float | None = None, sun: tuple[float, float] | None = None, celsius: float | None = None, at: tuple[datetime, float, float] | None = None) -> DataFrame:
    """cells (grid_id, x, y, z; the halo's included) with the wanted layers' columns, without the halo's rows.

    sun is (altitude, azimuth), or else worked out for `at` (time in the session's zone, which is to be UTC;
    latitude, longitude). Layers of the wind are left out without a wind; bedding goes without its terms of
    the cold without a sun or a temperature. Raises InsufficientHalo, and ValueError for an unknown layer and
    for insolation without a sun. Columns that only lead to wanted ones are dropped, so Catalyst prunes
    what nobody reads.
    """
    if unknown := layers - set(LAYERS):
        raise ValueError(f"unknown layers: {', '.join(sorted(unknown))}")
    if sun is None and at is not None:
        sun = tuple(cells.sparkSession.range(1).select(solar.sun(*map(F.lit, at)).alias("s")).select("s.*").first())
    if sun is None and "insolation" in layers:
        raise ValueError("insolation needs a sun, or a time and place")
    layers = {x for x in layers if x not in WINDY or wind_from is not None}
    if (need := required_halo(layers)) > halo:
        raise InsufficientHalo(need, halo, sorted(x for x in layers if REACH.get(x, 1) > halo))
    want = lambda *names: bool(layers & set(names))
    own, keep = cells.columns, []
    out = surface.surface(cells, cell_size) if layers - {"ruggedness", "tpi_small", "tpi_large", "sky_view", "shelter"} else cells
    if want("curvature", "wood"):
        out = surface.curvature(out, cell_size)
    if want("ruggedness"):
        out = surface.ruggedness(out)
    if want("vrm", "bedding"):
        out = surface.vector_ruggedness(out, VRM)
    for name, radius in (("tpi_small", SMALL), ("tpi_large", LARGE)):
        if want(name, "weiss"):
            out = surface.tpi(out, radius, name)
    kernels = {}
    if want("sky_view"):
        kernels["sky_view"] = (rays.sky_view, "double", cell_size)
    if want("shelter", "bedding"):
        kernels["shelter"] = (rays.shelter, "double", cell_size, wind_from)
    if kernels:
        # the kernels see heights alone; their columns meet the others by cell
        out = out.join(mosaic.over_tiles(cells, kernels, max(rays.SKY_REACH if want("sky_view") else 0, rays.SHELTER_REACH if "shelter" in kernels else 0)).drop("z"), ["grid_id", "x", "y"])
    bounds = cells.groupBy("grid_id").agg(*(f(c).alias(f"_{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))))
    inside = F.lit(True)
    for c in "xy":
        inside &= F.col(c).between(F.col(f"_{c}0") + halo, F.col(f"_{c}1") - halo)
    out = out.join(bounds, "grid_id").where(inside).drop("_x0", "_x1", "_y0", "_y1")
    if want("weiss"):
        out = surface.standardized(surface.standardized(out, "tpi_small", "_zs"), "tpi_large", "_zl")
        out = out.withColumn("weiss", landform.weiss(F.col("_zs"), F.col("_zl"), F.col("slope")))
    if want("wood"):
        out = out.withColumn("wood", landform.wood(F.col("slope"), F.col("cross_sectional"), F.col("max_curvature"), F.col("min_curvature"), landform.curvature_tolerance(cell_size)))
    if want("bench", "bedding"):
        out = landform.ring_stats(out)
    if want("bench"):
        out = cut(out)  # the groups' rounds read it, and so does the result
        found = landform.remove_small(out.withColumn("bench", landform.bench_candidate(F.col("slope"), F.col("ring_samples"), F.col("ring_steep"))).select("grid_id", "x", "y", "bench"))
        out = out.join(found, ["grid_id", "x", "y"])
    if want("hillshade"):
        out = out.withColumn("hillshade", solar.hillshade(F.col("dzdx"), F.col("dzdy")))
    if want("multi_hillshade"):
        out = out.withColumn("multi_hillshade", solar.multi_hillshade(F.col("dzdx"), F.col("dzdy")))
    if sun is not None and want("insolation", "bedding"):
        out = out.withColumn("insolation", solar.insolation(F.col("slope"), F.col("aspect"), F.lit(float(sun[0])), F.lit(float(sun[1]))))
    if want("wind_exposure", "bedding"):
        out = out.withColumn("wind_exposure", wind.wind_exposure(F.col("slope"), F.col("aspect"), wind_from))
    if want("bedding"):
        cold = sun is not None and celsius is not None
        out = out.withColumn("bedding", wind.bedding(*(F.col(c) for c in ("slope", "wind_exposure", "ring_mean", "ring_samples", "ring_missing", "shelter", "vrm")), F.col("insolation") if cold else None, wind.cold_weight(F.lit(float(celsius))) if cold else None))
    for x in LAYERS:
        if x in layers:
            keep += ["curvature_profile", "curvature_plan", "longitudinal", "cross_sectional", "max_curvature", "min_curvature"] if x == "curvature" else [x]
    return out.select(*own, *(c for c in dict.fromkeys(keep) if c in out.columns and c not in own))


def area_share(cells: DataFrame, tree: str | dict, cell_size: float, halo: int, **given) -> DataFrame:
    """cells, matched, share, advice: of an area with its halo, how much a saved filter matches; unmeasured cells count as cells."""
    tree = predicate.parse(tree)
    layers = layers_of(tree)
    fields = analyze(cells, layers, cell_size, halo, **given)
    match = predicate.compiled(tree, fields.columns)
    out = fields.agg(F.count("*").alias("cells"), F.coalesce(F.sum(match.cast("long")), F.lit(0)).alias("matched"))
    share = F.when(F.col("cells") > 0, F.col("matched") / F.when(F.col("cells") > 0, F.col("cells"))).otherwise(0.0)
    return out.withColumn("share", share).withColumn("advice", predicate.advice(F.col("share")))

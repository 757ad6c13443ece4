"""Plane regions from planar voxels, and splitting of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import plane_consistent
from ..session import cut_lineage
from .components import connected_components
from .spatial import adjacent_cells
from .voxels import KEY, merge_gaussians, with_shape


def plane_regions(voxels: DataFrame, keys: list[str], max_offset: float = 0.2, min_cos: float = 0.95) -> DataFrame:
    """Grow planes over neighbouring planar voxels that accept each other.

    Every accepted pair is an edge and a region is a connected component, so the result
    does not depend on the order in which voxels are visited.  ``voxels`` come from
    ``voxel_gaussians``; the result maps planar voxels to ``region`` (its smallest voxel).
    """
    flat = cut_lineage(voxels.filter("planar").select(*keys, *KEY, "mx", "my", "mz", "nx", "ny", "nz"))
    pairs = adjacent_cells(flat, keys, list(KEY))

    def side(name: str):
        cells = [F.col("m" + a).alias(f"{name}m{a}") for a in "xyz"] + [F.col("n" + a).alias(f"{name}n{a}") for a in "xyz"]
        return flat.select(*keys, F.struct(*KEY).alias(name), *cells)

    both = pairs.join(side("u"), [*keys, "u"]).join(side("v"), [*keys, "v"])
    vec = {f"{s}{p}": tuple(F.col(f"{s}{p}{a}") for a in "xyz") for s in "uv" for p in "mn"}
    ok = plane_consistent(vec["um"], vec["un"], vec["vm"], vec["vn"], max_offset, min_cos) & plane_consistent(
        vec["vm"], vec["vn"], vec["um"], vec["un"], max_offset, min_cos)
    labels = connected_components(flat.select(*keys, F.struct(*KEY).alias("id")), both.filter(ok).select(*keys, "u", "v"), keys=keys)
    return labels.select(*keys, "id.*", F.col("component").alias("region"))


def plane_features(voxels: DataFrame, regions: DataFrame, keys: list[str], min_points: int = 20, max_nz: float = 0.707) -> DataFrame:
    """Merged Gaussian of every region that is large and upright enough."""
    members = voxels.join(regions, [*keys, *KEY])
    merged = with_shape(merge_gaussians(members, [*keys, "region"]))
    return merged.filter((F.col("n") > min_points) & (F.abs(F.col("nz")) < max_nz))


def without_planes(points: DataFrame, regions: DataFrame, planes: DataFrame, keys: list[str]) -> DataFrame:
    """Points whose voxel belongs to no accepted plane; ``points`` carry their voxel."""
    taken = regions.join(planes.select(*keys, "region"), [*keys, "region"], "left_semi").select(*keys, *KEY)
    return points.join(taken, [*keys, *KEY], "left_anti")


def voxel_kinds(voxels: DataFrame, regions: DataFrame, planes: DataFrame, lines: DataFrame | None, keys: list[str]) -> DataFrame:
    """Kind and axis of every voxel: plane voxels keep their normal, voxels of a line take
    its direction, all others are clusters.  ``lines`` map voxels to ``dx dy dz``."""
    taken = regions.join(planes.select(*keys, "region"), [*keys, "region"], "left_semi").select(*keys, *KEY, F.lit(True).alias("_p"))
    out = voxels.join(taken, [*keys, *KEY], "left")
    plane = F.coalesce("_p", F.lit(False))
    if lines is None:
        kind = F.when(plane, "Plane").otherwise("Cluster")
        axis = {f"a{a}": F.col(f"n{a}") for a in "xyz"}
    else:
        out = out.join(lines.select(*keys, *KEY, *[F.col("d" + a).alias("_d" + a) for a in "xyz"]), [*keys, *KEY], "left")
        line = F.col("_dx").isNotNull()
        kind = F.when(line, "Line").when(plane, "Plane").otherwise("Cluster")
        axis = {f"a{a}": F.when(line, F.col(f"_d{a}")).otherwise(F.col(f"n{a}")) for a in "xyz"}
    return out.withColumns({"kind": kind, **axis}).drop("_p", "_dx", "_dy", "_dz")

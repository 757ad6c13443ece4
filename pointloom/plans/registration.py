"""Whole registrations: front ends, back ends and their evaluation.

Every step works on all pairs at once.  Points are ``cloud, pid, x, y, z``; pairs are
``src, tgt``; both clouds of a pair are found by joins on the cloud key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, lookup
from ..functions.linalg import SYM, cols, norm
from ..functions.scalar import bin_overlap_distance, descriptor_distance, feature_score
from ..operators import boxes, cliques, consensus, descriptors, evaluate, fitting, gaussian_fit, ground, matching, planes, polar, rangeimage, verify, voxels
from ..operators import compatibility as cg
from ..session import cut_lineage
from .correspondences import PAIR, correspondences
from .features import eigen_descriptor, spread_descriptor

CLOUD = ["cloud"]
IDENTITY = fitting.IDENTITY
SHAPE = ["n", *voxels.MEAN, *SYM, "l0", "l1", "l2", "nx", "ny", "nz"]


def ground_rule(cfg: Config) -> ground.GroundRule:
    return ground.GroundRule(min_range=cfg.min_range, max_range=cfg.max_range)


def cluster_points(points: DataFrame, cfg: Config) -> DataFrame:
    """Points with a ``cluster`` label, by the configured method."""
    method, extra = cfg.cluster_method, cfg.extra
    if method == "dcvc":
        d = {"startR": "start", "deltaR": "shrink", "deltaP": "pitch", "deltaA": "azimuth", "min_range": "min_range", "max_range": "max_range",
             "min_cluster_size": "min_size"}
        given = {v: lookup(extra, "dcvc", k) for k, v in d.items() if lookup(extra, "dcvc", k) is not None}
        rule = polar.PolarRule(**{"min_range": cfg.min_range, "max_range": cfg.max_range, "min_size": cfg.min_cluster_size, **given})
        return polar.segment(points, CLOUD, rule)
    if method == "travel":
        d = {"vert_scan": "rows", "horz_scan": "cols", "min_vert_angle": "min_angle", "max_vert_angle": "max_angle", "downsample": "keep_every",
             "horz_merge_thres": "row_gap", "vert_merge_thres": "link_gap", "vert_scan_size": "link_rows", "horz_scan_size": "link_cols",
             "horz_skip_size": "skip", "horz_extension_size": "extension", "min_range": "min_range", "max_range": "max_range",
             "min_cluster_size": "min_size", "max_cluster_size": "max_size"}
        given = {v: lookup(extra, "travel", k) for k, v in d.items() if lookup(extra, "travel", k) is not None}
        rule = rangeimage.RangeImageRule(**{"min_range": cfg.min_range, "max_range": cfg.max_range, **given})
        return rangeimage.segment(points, CLOUD, ["pid", "x", "y", "z"], rule)
    return polar.euclidean_cluster(points.withColumn("id", F.struct("pid", "x", "y", "z")), CLOUD, 1.0, cfg.min_cluster_size)


def extract_features(points: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Line, plane and cluster features, the voxels with their kind and axis, and the points
    of every feature."""
    labelled = ground.segment_ground(points, CLOUD, ground_rule(cfg))
    above = cut_lineage(labelled.filter(F.col("label") == "nonground").select("cloud", "pid", "x", "y", "z"))
    vox = cut_lineage(voxels.voxel_gaussians(above, CLOUD, cfg.plane_resolution, 10, cfg.eigen_ratio))
    celled = voxels.with_voxel(above, cfg.plane_resolution)
    key = F.struct(*voxels.KEY)
    if cfg.plane_aided:
        regions = cut_lineage(planes.plane_regions(vox, CLOUD, cfg.plane_distance, cfg.plane_normal))
        flat = cut_lineage(planes.plane_features(vox, regions, CLOUD, cfg.min_cluster_size))
        rest = planes.without_planes(celled, regions, flat, CLOUD)
        plane_rows = flat.withColumn("name", F.col("region"))
    else:
        regions = vox.limit(0).select(*CLOUD, *voxels.KEY, key.alias("region"))
        flat = regions.select(*CLOUD, "region").limit(0)
        rest, plane_rows = celled, None
    clustered = cut_lineage(cluster_points(rest.select("cloud", "pid", "x", "y", "z"), cfg))
    lines = cut_lineage(boxes.poles(clustered, ["cloud", "cluster"], cfg.eigen_ratio))
    others = clustered.join(lines.select("cloud", "cluster"), ["cloud", "cluster"], "left_anti")
    blobs = voxels.with_shape(voxels.gaussians(others, ["cloud", "cluster"]))
    if not cfg.plane_aided:
        is_flat = F.col("l1") >= cfg.eigen_ratio * F.greatest(F.col("l0"), F.lit(0.0))
        blobs = cut_lineage(blobs)
        plane_rows = blobs.filter(is_flat).withColumn("name", F.col("cluster"))
        blobs = blobs.filter(~is_flat)
    # a cluster has no plane: its normal is the vertical by convention
    blobs = blobs.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)})

    def named(df: DataFrame, kind: str, name: str) -> DataFrame:
        return df.select("cloud", F.lit(kind).alias("class"), F.xxhash64(F.lit(kind), name).alias("id"), *SHAPE)

    feats = named(lines, "Line", "cluster").unionByName(named(plane_rows, "Plane", "name")).unionByName(named(blobs, "Cluster", "cluster"))
    on_line = voxels.with_voxel(clustered, cfg.plane_resolution).join(lines.select("cloud", "cluster", "dx", "dy", "dz"), ["cloud", "cluster"])
    line_cells = on_line.groupBy(*CLOUD, *voxels.KEY).agg(F.min(F.struct("dx", "dy", "dz")).alias("_d")).select(*CLOUD, *voxels.KEY, "_d.*")
    kinds = planes.voxel_kinds(vox, regions, flat, line_cells, CLOUD)

    def owned(df: DataFrame, kind: str, name: str) -> DataFrame:
        return df.select("cloud", F.lit(kind).alias("class"), F.xxhash64(F.lit(kind), name).alias("id"), "x", "y", "z")

    members = owned(clustered.join(lines.select("cloud", "cluster"), ["cloud", "cluster"], "left_semi"), "Line", "cluster")
    if cfg.plane_aided:
        on_plane = celled.join(regions.join(flat.select("cloud", "region"), ["cloud", "region"], "left_semi"), [*CLOUD, *voxels.KEY])
        members = members.unionByName(owned(on_plane, "Plane", "region")).unionByName(owned(others, "Cluster", "cluster"))
    else:
        upright = plane_rows.select("cloud", "cluster")
        members = members.unionByName(owned(others.join(upright, ["cloud", "cluster"], "left_semi"), "Plane", "cluster"))
        members = members.unionByName(owned(others.join(upright, ["cloud", "cluster"], "left_anti"), "Cluster", "cluster"))
    return cut_lineage(feats), cut_lineage(kinds), members


def with_boxes(features: DataFrame, members: DataFrame, cfg: Config) -> DataFrame:
    """Add tight boxes to ranked features; ``use_pseudo_cov`` also takes its covariance from the box."""
    key = ["cloud", "class", "id"]
    fitted = boxes.tight_boxes(members.join(features.select(*key), key, "left_semi"), features, key)
    fitted = boxes.box_covariance(fitted, cfg.volume_chi2).select(*key, "size", "prior", *[F.col(c).alias("_" + c) for c in SYM])
    out = features.join(fitted, key)
    if cfg.use_pseudo_cov:
        out = out.withColumns({**{c: F.col("_" + c) for c in SYM}, "l2": F.col("prior")})
    return out.drop("prior", *["_" + c for c in SYM])


def rank_features(features: DataFrame, cfg: Config) -> DataFrame:
    """Best features of each class inside the range ring."""
    limit = {"Line": cfg.num_lines, "Plane": cfg.num_planes, "Cluster": cfg.num_clusters}
    asked = {k: v for k, v in limit.items() if v is not None}
    ring = features.filter(norm(cols("m")).between(cfg.min_range, cfg.max_range))
    if not asked:
        return ring
    score = feature_score(F.col("class"), F.col("l0"), F.col("l1"), F.col("l2"))
    some = ring.filter(F.col("class").isin(*asked)).withColumn("score", score)
    best = voxels.top_k(some, ["cloud", "class"], max(asked.values()), [F.desc("score"), F.col("id")])
    allowed = F.coalesce(*[F.when(F.col("class") == k, F.lit(v)) for k, v in asked.items()])
    best = best.filter(F.col("rank") <= allowed).drop("rank", "score")
    return best.unionByName(ring.filter(~F.col("class").isin(*asked)))


def associate(features: DataFrame, pairs: DataFrame, cfg: Config, points: DataFrame | None = None) -> DataFrame:
    """Class-wise matches of the features of both clouds of every pair."""
    on, k = [*PAIR, "class"], cfg.assoc_topk

    def side(df: DataFrame, which: str) -> DataFrame:
        return pairs.select(*PAIR, F.col(which).alias("cloud")).join(df, "cloud").drop("cloud")

    method = cfg.assoc_method
    placed = features.select("cloud", "class", "id", *[F.col("m" + a).alias(a) for a in "xyz"], "nx", "ny", "nz")
    if method == "hash_desc":
        bins = cut_lineage(descriptors.hash_bins(placed, CLOUD).join(placed.select("cloud", "id", "class"), ["cloud", "id"]))
        return matching.bin_overlap_top_k(side(bins, "src"), side(bins, "tgt"), side(placed, "src"), side(placed, "tgt"), on, k, bin_overlap_distance)
    metric = "2-norm"
    if method == "fpfh":
        desc = descriptors.fpfh(placed, CLOUD, 10.0).join(placed.select("cloud", "id", "class"), ["cloud", "id"])
    elif method == "ev_feature":
        desc = features.select("cloud", "class", "id", eigen_descriptor().alias("desc"))
    elif method == "iou3d":
        metric, desc = "iou3d", features.select("cloud", "class", "id", F.col("size").alias("desc"))
    else:
        desc = features.select("cloud", "class", "id", spread_descriptor().alias("desc"))
    desc = cut_lineage(desc)
    src, tgt = side(desc, "src"), side(desc, "tgt")
    if method == "all_to_all":
        return matching.all_to_all(src, tgt, on)
    if method == "random_select":
        return matching.first_k(src, tgt, on, k)
    return matching.mutual_top_k(src, tgt, on, k, lambda a, b: descriptor_distance(a, b, metric))


def keypoint_front_end(points: DataFrame, pairs: DataFrame, cfg: Config, keypoints: bool) -> DataFrame:
    """Correspondences of downsampled non-ground points by FPFH, with or without ISS keypoints."""
    labelled = ground.segment_ground(points, CLOUD, ground_rule(cfg))
    small = voxels.downsample(labelled.filter(F.col("label") == "nonground"), CLOUD, cfg.ds_resolution)
    key = F.xxhash64(*voxels.KEY)
    small = cut_lineage(small.select("cloud", key.alias("id"), "x", "y", "z"))
    res = cfg.ds_resolution
    shaped = cut_lineage(descriptors.normals(small, CLOUD, 3.0 * res if keypoints else cfg.normal_radius))
    wanted = descriptors.iss_keypoints(small, CLOUD, res).select("cloud", "id") if keypoints else None
    desc = cut_lineage(descriptors.fpfh(shaped, CLOUD, 8.0 * res if keypoints else cfg.fpfh_radius, wanted))
    src, tgt = (pairs.select(*PAIR, F.col(c).alias("cloud")).join(desc, "cloud").drop("cloud") for c in ("src", "tgt"))
    found = matching.mutual_nearest(src, tgt, PAIR, 5 if keypoints else 1)
    for side, p in (("src", "s"), ("tgt", "t")):
        at = small.select(F.col("cloud").alias(side), F.col("id").alias(side + "_id"), *[F.col(a).alias(p + a) for a in "xyz"])
        found = found.join(at, [side, side + "_id"])
    numbered = cut_lineage(matching.with_corr_id(found, PAIR, ["src_id", "tgt_id"]))
    return numbered if keypoints else matching.tuple_test(numbered, PAIR)


def front_end(points: DataFrame, pairs: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame | None]:
    """Correspondences of every pair, and the voxel table of the ellipsoid front end."""
    if cfg.front_end == "ellipsoid":
        feats, kinds, members = extract_features(points, cfg)
        best = cut_lineage(rank_features(feats, cfg))
        if cfg.use_pseudo_cov or cfg.assoc_method == "iou3d":
            best = cut_lineage(with_boxes(best, members, cfg))
        return cut_lineage(correspondences(associate(best, pairs, cfg), best)), kinds
    if cfg.front_end in ("fpfh", "iss_fpfh"):
        return cut_lineage(keypoint_front_end(points, pairs, cfg, cfg.front_end == "iss_fpfh")), None
    raise ValueError(f"front end {cfg.front_end!r} brings its own correspondences: use solve_from_correspondences")


def level_poses(corr: DataFrame, best: DataFrame, cfg: Config) -> DataFrame:
    """One transform per pair and level from the members of its largest clique."""
    keys = [*PAIR, "level"]
    rows = best.select(*keys, F.explode("members").alias("corr_id")).join(corr, [*PAIR, "corr_id"])
    size = F.size("members")
    big = cut_lineage(rows.join(best.filter(size >= (2 if cfg.tf_solver in ("teaser", "quatro") else 3)).select(*keys), keys, "left_semi"))
    if cfg.tf_solver in ("teaser", "quatro"):
        return _decoupled(big, keys, cfg)
    start = fitting.fit_pose(big, keys).drop("n")
    if cfg.tf_solver == "svd":
        return start
    if cfg.tf_solver == "gnc":
        return fitting.gnc_fit(big, keys, gaussian_fit.BOUND2 ** 0.5, "rigid")[0]
    flat = boxes.regularized(_renamed(big.filter(F.col("class") == "Plane"), "s"), "PLANE")
    flat = boxes.regularized(_renamed(_restored(flat, "s"), "t"), "PLANE")
    rows = _restored(flat, "t").unionByName(big.filter(F.col("class") != "Plane"))
    return gaussian_fit.refine_pose(rows, start, keys, "gaussian")


def _renamed(df: DataFrame, side: str) -> DataFrame:
    return df.withColumnsRenamed({side + c: c for c in SYM})


def _restored(df: DataFrame, side: str) -> DataFrame:
    return df.withColumnsRenamed({c: side + c for c in SYM})


def _decoupled(rows: DataFrame, keys: list[str], cfg: Config) -> DataFrame:
    """Rotation from chained differences, then translation by per-axis consensus."""
    bound = cfg.noise_bounds[0]
    chained = cg.chain(rows, keys)
    yaw = cfg.tf_solver == "quatro"
    tims = chained.select(*keys, "corr_id", *[
        (F.lit(0.0) if yaw and a == "z" else F.col("d" + s + a)).alias(s + a) for s in "st" for a in "xyz"])
    poses, _ = fitting.gnc_fit(tims, keys, 2.0 * bound, "yaw" if yaw else "rotation", inlier_weight=0.4 if yaw else 0.5)
    poses = cut_lineage(poses)
    turned = rows.join(poses, keys)
    point = tuple(F.col("tf")[4 * i] * F.col("sx") + F.col("tf")[4 * i + 1] * F.col("sy") + F.col("tf")[4 * i + 2] * F.col("sz") for i in range(3))
    shift = consensus.tls_translation(turned.select(*keys, *[p.alias("s" + a) for p, a in zip(point, "xyz")], "tx", "ty", "tz"), keys, bound)[0]
    tf = F.col("tf")
    cells = [F.col(f"t{i // 4}") if i in (3, 7, 11) else tf[i] for i in range(16)]
    return poses.join(shift, keys).select(*keys, F.array(*cells).alias("tf"))


def solve_decoupled(corr: DataFrame, bound: float, estimate_scale: bool = False) -> DataFrame:
    """Scale, then clique, rotation and translation, each by its own robust estimator.

    Scale is the consensus of pairwise length ratios; without it only lengths that agree
    within twice the bound count.
    """
    far = 1e12 if estimate_scale else bound
    tims = cut_lineage(cg.compatible_pairs(corr, PAIR, [far], "point"))
    if estimate_scale:
        scale = cut_lineage(consensus.tls_scale(tims, PAIR, bound).select(*PAIR, F.col("estimate").alias("scale")))
        ratio = F.col("tgt_len") / F.col("src_len")
        tims = cut_lineage(tims.join(scale, PAIR).filter(F.abs(ratio - F.col("scale")) <= 2.0 * bound / F.col("src_len")))
    else:
        scale = corr.select(*PAIR).distinct().withColumn("scale", F.lit(1.0))
    best = cliques.max_clique(tims, PAIR)
    rows = best.select(*PAIR, F.explode("members").alias("corr_id")).join(corr, [*PAIR, "corr_id"]).join(scale, PAIR)
    rows = cut_lineage(rows.withColumns({"s" + a: F.col("s" + a) * F.col("scale") for a in "xyz"}))
    poses = _decoupled(rows, PAIR, Config(front_end="none", tf_solver="teaser", noise_bounds=(bound,)))
    return poses.join(scale, PAIR)


def solve_pyramid(corr: DataFrame, pairs: DataFrame, cfg: Config, points: DataFrame | None, kinds: DataFrame | None) -> DataFrame:
    """Graph pyramid, largest clique and pose per level, then the best verified candidate."""
    levels = list(cfg.noise_bounds)
    tile = 512
    edges = cut_lineage(cg.compatible_pairs(corr, PAIR, levels, cfg.vertex_type, tile))
    best = cut_lineage(cliques.max_clique_levels(edges, PAIR, len(levels)))
    poses = level_poses(corr, best, cfg)
    identity = F.array(*[F.lit(v) for v in IDENTITY])
    every = pairs.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1))))
    cand = every.join(poses, [*PAIR, "level"], "left").select(*PAIR, "level", F.col("tf").isNotNull().alias("valid"), F.coalesce("tf", identity).alias("tf"))
    cand = cut_lineage(cand)
    if len(levels) == 1:
        chosen = cand.select(*PAIR, "level", "tf", F.lit(None).cast("double").alias("score"))
    else:
        chosen = verify_candidates(cand, pairs, cfg, points, kinds)
    all_tf = cand.groupBy(*PAIR).agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "tf"))), lambda v: v.tf).alias("candidates"),
                                     F.max("valid").alias("valid"))
    out = chosen.join(all_tf, PAIR).join(best.select(*PAIR, "level", "members"), [*PAIR, "level"], "left")
    if "class" not in corr.columns:
        return out
    used = best.select(*PAIR, "level", F.explode("members").alias("corr_id")).join(chosen.select(*PAIR, "level"), [*PAIR, "level"], "left_semi")
    counts = verify.inliers_by_class(used.join(corr.select(*PAIR, "corr_id", "class"), [*PAIR, "corr_id"]), PAIR)
    return out.join(counts, PAIR, "left")


def verify_candidates(cand: DataFrame, pairs: DataFrame, cfg: Config, points: DataFrame, kinds: DataFrame | None) -> DataFrame:
    """Score candidates on voxels, planes or plain points; voxels need the ellipsoid front end."""
    res, method = cfg.plane_resolution, cfg.verify_method
    if method == "voxel" and kinds is None:
        method = "dense_pcd"
    if method == "dense_pcd":
        small = cut_lineage(voxels.downsample(points, CLOUD, res).withColumn("key", F.struct(*voxels.KEY)))
        samples = pairs.join(small.select(F.col("cloud").alias("src"), F.col("key").alias("sid"), "x", "y", "z"), "src")
        targets = pairs.join(small.select(F.col("cloud").alias("tgt"), F.col("key").alias("tid"), "x", "y", "z"), "tgt")
        scores = verify.score_candidates(samples, targets, cand.drop("valid"), PAIR, "dcs", 2.0 * res, squared=True)
        return verify.best_candidate(scores, cand, PAIR)
    if method == "plane_based":
        vox = voxels.voxel_gaussians(points, CLOUD, res, 10, cfg.eigen_ratio)
        kinds = cut_lineage(vox.withColumns({"kind": F.when(F.col("planar"), "Plane").otherwise("None"), **{"a" + a: F.col("n" + a) for a in "xyz"}}))
    sampled = voxels.sample_per_voxel(points.select("cloud", "pid", "x", "y", "z"), CLOUD, res, 5, ["pid", "x", "y", "z"])
    sampled = sampled.join(kinds.select(*CLOUD, *voxels.KEY), [*CLOUD, *voxels.KEY], "left_semi")
    sampled = sampled.select(F.col("cloud").alias("src"), F.struct("pid", "x", "y", "z").alias("sid"), "x", "y", "z")
    targets = kinds.select(F.col("cloud").alias("tgt"), F.struct(*voxels.KEY).alias("tid"), *[F.col("m" + a).alias(a) for a in "xyz"], "kind", "ax", "ay", "az")
    kept = cut_lineage(verify.drop_near_repeats(cand, PAIR))
    scores = verify.score_candidates(pairs.join(sampled, "src"), pairs.join(targets, "tgt"), kept, PAIR, cfg.robust_kernel, res)
    return verify.best_candidate(scores, kept, PAIR)


def solve_by_cliques(corr: DataFrame) -> DataFrame:
    """Second-order graph, all maximal cliques, best scored hypothesis, refinement."""
    first = cut_lineage(cg.weighted_pairs(corr, PAIR))
    edges = cut_lineage(cg.second_order(first, PAIR))
    found = cut_lineage(cliques.maximal_cliques(edges, PAIR))
    best = cliques.best_cliques_per_node(found, edges, PAIR)
    poses = cut_lineage(fitting.clique_hypotheses(corr, best, PAIR))
    return fitting.refine(corr, poses, PAIR)


def solve(corr: DataFrame, pairs: DataFrame, cfg: Config, points: DataFrame | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """Transform of every pair by the configured back end; identity where nothing was found.

    All back ends return ``candidates`` and, where correspondences have a class, inliers by class.
    """
    if cfg.back_end == "pyramid":
        return solve_pyramid(corr, pairs, cfg, points, kinds)
    if cfg.back_end == "ransac":
        out, reach = fitting.ransac_fit(corr, PAIR, cfg.ransac_threshold, most=cfg.ransac_iterations), cfg.ransac_threshold
    else:
        out, reach = solve_by_cliques(corr), 0.6
    identity = F.array(*[F.lit(v) for v in IDENTITY])
    out = pairs.join(out, PAIR, "left").withColumns({"valid": F.col("tf").isNotNull(), "tf": F.coalesce("tf", identity)})
    out = out.withColumn("candidates", F.array("tf"))
    if "class" not in corr.columns:
        return out
    out = cut_lineage(out)
    near = fitting.with_distance(corr.join(out.select(*PAIR, "tf"), PAIR)).filter(F.col("dist") < reach)
    return out.join(verify.inliers_by_class(near, PAIR), PAIR, "left")


def register(points: DataFrame, pairs: DataFrame, cfg: Config) -> DataFrame:
    """Global registration of every pair of clouds."""
    corr, kinds = front_end(points, pairs, cfg)
    return solve(corr, pairs, cfg, points, kinds)


def solve_from_correspondences(corr: DataFrame, cfg: Config, points: DataFrame | None = None) -> DataFrame:
    """Registration on given correspondences (``src tgt corr_id sx .. tz``)."""
    given = corr if "src_id" in corr.columns else corr.withColumns({"src_id": F.col("corr_id"), "tgt_id": F.col("corr_id")})
    given = cut_lineage(given)
    return solve(given, given.select(*PAIR).distinct(), cfg, points)


def evaluate_front_end(points: DataFrame, pairs: DataFrame, truth: DataFrame, cfg: Config) -> DataFrame:
    """Matches, true positives and precision of the front end under the true poses."""
    corr, _ = front_end(points, pairs, cfg)
    return evaluate.match_precision(corr, truth, PAIR, cfg.tp_thresh)

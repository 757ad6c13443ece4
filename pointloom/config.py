"""Run configuration: typed defaults, YAML overrides, checks of every named choice."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

import yaml

FRONT_ENDS = ("ellipsoid", "fpfh", "iss_fpfh", "fcgf", "none")
BACK_ENDS = ("pyramid", "ransac", "cliques")
SOLVERS = ("gmm_tls", "gnc", "svd", "teaser", "quatro")
VERIFIERS = ("voxel", "dense_pcd", "plane_based")
CLUSTERERS = ("travel", "dcvc", "euc")
ASSOCIATIONS = ("wasserstein", "ev_feature", "iou3d", "fpfh", "hash_desc", "all_to_all", "random_select")
VERTICES = ("point", "point_ratio", "gaussian", "ellipse")


@dataclass(frozen=True)
class Config:
    dataset: str = "kitti"
    dataset_root: str = ""
    min_range: float = 0.5
    max_range: float = 120.0
    min_cluster_size: int = 20
    ds_resolution: float = 0.5
    front_end: str = "ellipsoid"
    cluster_method: str = "dcvc"
    back_end: str = "pyramid"
    tf_solver: str = "gnc"
    verify_method: str = "voxel"
    robust_kernel: str = "dcs"
    tp_thresh: float = 0.5
    trans_thresh: float = 2.0
    rot_thresh: float = 5.0
    assoc_method: str = "wasserstein"
    assoc_topk: int = 20
    num_clusters: int | None = None
    num_planes: int | None = None
    num_lines: int | None = None
    use_pseudo_cov: bool = False
    plane_aided: bool = True
    volume_chi2: float = 7.815
    vertex_type: str = "point"
    noise_bounds: tuple[float, ...] = (0.2,)
    ransac_iterations: int = 100000
    ransac_threshold: float = 0.5
    normal_radius: float = 1.0
    fpfh_radius: float = 2.5
    plane_resolution: float = 1.0
    plane_distance: float = 0.2
    plane_normal: float = 0.95
    eigen_ratio: float = 30.0
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, choices in (("front_end", FRONT_ENDS), ("back_end", BACK_ENDS), ("tf_solver", SOLVERS), ("verify_method", VERIFIERS),
                              ("cluster_method", CLUSTERERS), ("assoc_method", ASSOCIATIONS), ("vertex_type", VERTICES)):
            if getattr(self, name) not in choices:
                raise ValueError(f"{name} must be one of {choices}, not {getattr(self, name)!r}")
        if list(self.noise_bounds) != sorted(self.noise_bounds) or not self.noise_bounds:
            raise ValueError("noise_bounds must be ascending and not empty")
        if self.tf_solver == "gmm_tls" and self.front_end != "ellipsoid":
            raise ValueError("gmm_tls needs the ellipsoid front end")


# Where a YAML key (section, key) goes; keys of run and sensor files.
YAML_KEYS = {
    ("dataset", "name"): "dataset", ("dataset", "dataset_root"): "dataset_root", ("dataset", "min_range"): "min_range",
    ("dataset", "max_range"): "max_range", ("dataset", "min_cluster_size"): "min_cluster_size",
    ("dataset", "ds_resolution"): "ds_resolution", ("front_end",): "front_end", ("cluster_mtd",): "cluster_method",
    ("back_end",): "back_end", ("tf_solver",): "tf_solver", ("verify_mtd",): "verify_method", ("robust_kernel",): "robust_kernel",
    ("evaluation", "tp_thresh"): "tp_thresh", ("evaluation", "trans_thresh"): "trans_thresh", ("evaluation", "rot_thresh"): "rot_thresh",
    ("association", "method"): "assoc_method", ("association", "topK"): "assoc_topk", ("association", "num_clusters"): "num_clusters",
    ("association", "num_planes"): "num_planes", ("association", "num_lines"): "num_lines",
    ("use_pseudo_cov",): "use_pseudo_cov", ("plane_aided",): "plane_aided", ("volume_chi2",): "volume_chi2",
    ("vertex", "type"): "vertex_type", ("vertex", "noise_bound_vec"): "noise_bounds",
    ("ransac", "max_iterations"): "ransac_iterations", ("ransac", "inlier_threshold"): "ransac_threshold",
    ("fpfh", "normal_radius"): "normal_radius", ("fpfh", "fpfh_radius"): "fpfh_radius",
    ("plane_extraction", "resolution"): "plane_resolution", ("plane_extraction", "distance_thresh"): "plane_distance",
    ("plane_extraction", "normal_thresh"): "plane_normal", ("plane_extraction", "eigenvalue_thresh"): "eigen_ratio",
}

def lookup(node: dict, *path: str, default=None):
    """Nested value with a default."""
    for key in path:
        if not isinstance(node, dict) or key not in node:
            return default
        node = node[key]
    return node


def base_is_unset(base: Config, name: str) -> bool:
    """Counts that mean "all" until a run file sets them."""
    return getattr(base, name) is None


def load_config(*paths: str, base: Config = Config(), aliases: dict[str, str] | None = None) -> Config:
    """Apply run and sensor YAML files in order; sensor sections are kept in ``extra``.

    ``aliases`` renames choices in files written for another program.
    """
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(Config)}
    values: dict = {}
    extra: dict = {}
    for path in paths:
        with open(path) as f:
            doc = yaml.safe_load(f) or {}
        if lookup(doc, "association", "max_corrs") is not None:
            raise ValueError("association.max_corrs is not supported: no correspondence is left out")
        for keys, name in YAML_KEYS.items():
            found = lookup(doc, *keys)
            if found is None:
                continue
            if isinstance(found, str):
                found = (aliases or {}).get(found, found)
            values[name] = tuple(float(v) for v in found) if kinds[name] is tuple else int(found) if base_is_unset(base, name) else kinds[name](found)
        extra.update({k: v for k, v in doc.items() if k in ("travel", "dcvc")})
    return replace(base, **values, extra=extra)

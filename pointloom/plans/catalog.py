"""All named queries; importing a query module registers its queries."""

from . import descriptor_queries, extra_queries, fit_queries, graph_queries, segment_queries, verify_queries, voxel_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

"""All registered queries of the recording, telemetry and graph operators, with their SQL equivalents."""

from . import asof_queries, bench_queries, graph_queries, host_queries, mutation_queries, pose_queries, profile_queries, relational_queries, shape_queries, spatial_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

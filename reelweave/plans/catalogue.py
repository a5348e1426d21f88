"""All queries of the library and their DuckDB counterparts, by name."""

from reelweave.plans import colour_queries, file_queries, media_queries, pose_queries, text_queries, transform_queries  # noqa: F401
from reelweave.plans._query import ORACLES, QUERIES  # noqa: F401

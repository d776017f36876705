"""Analytics for organisation graphs on Spark DataFrames."""

from .graph import Graph, build_graph
from .session import configure, materialize, release, scope

__all__ = ["Graph", "build_graph", "configure", "materialize", "release", "scope"]

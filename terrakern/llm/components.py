"""Connected components of links: those of the library, without the nodes that name their component."""

from __future__ import annotations

from pyspark.sql import DataFrame

from terrakern.operators.graph import stars


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b) but the components' least, which is what `component` holds."""
    return stars(edges)

"""Connected components whose rounds are written as tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vialect.llm.common import written
from vialect.operators import graph


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) as (node, root): each node of an edge with the smallest node of its component."""
    return graph.components(edges, lambda rows: written(rows, "edges"))

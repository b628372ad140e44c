"""Queries over complexes of the embeddings' first two coordinates."""

from __future__ import annotations

from ..operators import topology
from .registry import query
from .structures import _points

_EDGES = """WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.02)"""


@query(
    "dim n",
    sql=f"""{_EDGES} SELECT 0 AS dim, count(*) AS n FROM p UNION ALL SELECT 1, count(*) FROM e
UNION ALL SELECT 2, count(*) FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b""",
)
def topology_rips(spark, d):
    return topology.rips_counts(_points(spark, d), 0.02)


@query("n", "birth death", digits=9)
def topology_persistence(spark, d):
    return topology.persistence_of_components(_points(spark, d), 0.05)

"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import staged


def _ends(edges: DataFrame, of_u: dict, of_v: dict) -> DataFrame:
    """A row for each end of edges (u, v), with the columns that of_u and of_v name."""
    row = lambda columns: F.struct(*(c.alias(name) for name, c in columns.items()))
    return edges.select(F.explode(F.array(row(of_u), row(of_v))).alias("end")).select("end.*")


def _round(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star round over distinct edges (u, v) with v < u; so are the edges that it returns.

    The large star points a node's larger neighbours at the smallest of all its neighbours and itself, the small star the
    node and its smaller neighbours at the smallest of these. Edges that lead down need to be looked at one way only.
    """
    u, v = F.col("u"), F.col("v")
    least = _ends(edges, {"node": u, "next": v}, {"node": v, "next": u}).groupBy("node").agg(F.min("next").alias("m")).select(F.col("node").alias("v"), F.least("node", "m").alias("m"))
    large = edges.join(least, "v").select("u", F.col("m").alias("v"))
    small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
    return _ends(small, {"u": u, "v": F.col("m")}, {"u": v, "v": F.col("m")}).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v) are stars: no u has two edges or is another's v."""
    ends = _ends(edges, {"node": F.col("u"), "up": F.lit(1), "down": F.lit(0)}, {"node": F.col("v"), "up": F.lit(0), "down": F.lit(1)})
    found = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0")
    return found.agg(F.count("*")).first()[0] == 0


def star_forest(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) of every node u that reaches a smaller one, v the smallest that it reaches.

    edges: two columns of one orderable type. Rounds are staged in the shared folder; their number is logarithmic in a
    component's diameter, and none is needed for edges that are such stars. With more edges added, the result stands for
    all edges that it came from. Null ends and self loops are ignored; an empty table gives an empty result.
    """
    a, b = edges.columns[:2]
    now = staged(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            return now
        now = staged(_round(now), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node that it reaches. As star_forest."""
    stars = star_forest(edges, max_rounds)
    smallest = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(smallest)

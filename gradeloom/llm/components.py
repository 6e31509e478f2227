"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom.sources.shared import materialize

#: Rounds needed grow with the logarithm of the longest path; more than these mean a fault.
MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``a, b`` that has a link to another node.

    ``component`` is the smallest node reachable. Null ends, loops and repeated links have no effect; no links
    give no rows; other columns are ignored.

    Each round first points the larger neighbours of every node at its smallest neighbour, then the smaller ones
    (Kiveris et al., 2014), until nothing changes. Counts are kept per link, so a node with very many links is
    summed up map-side and its links are joined as an equi-join that adaptive execution can split. Each round is
    a stored table; the driver sees two numbers a round.
    """
    ordered = "greatest(a, b) AS u", "least(a, b) AS v"
    edges = materialize(links.where("a <> b").selectExpr(*ordered).distinct(), "links")
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.selectExpr("v AS u", "u AS v"))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(smallest, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").selectExpr("v AS u", "m AS v").union(smallest).where("u <> v").distinct()
        edges = materialize(small, "stars")
        before, state = state, _state(edges)
        if state == before:
            return edges.selectExpr("u AS node", "v AS component").union(
                edges.selectExpr("v AS node", "v AS component").distinct()
            )
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")


def _state(edges: DataFrame) -> tuple:
    """Count and order-free hash of the links."""
    return tuple(edges.selectExpr("count(*)", "bit_xor(xxhash64(u, v))", "sum(xxhash64(v, u) % 1000000007)").first())

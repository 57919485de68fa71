"""Connected components of a link table, as a short loop of joins over stored tables."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, functions as F

from tallyspark.session import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``(node long, root long)`` for every node of ``links(a long, b long)``.

    Each round moves a node to the least of itself and its neighbours, in an order that an exclusive or with a
    fresh constant gives, and carries the links over to the new nodes. About half of the nodes go per round,
    whatever the shape, since no chain is sorted in every order. Null ends and loops are ignored; no links give
    no rows. Both sides of every join are stored tables, so that a node with very many links is split.
    """
    order = random.Random(7)
    edges = stored(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct(), "links")
    moves = []
    while not edges.isEmpty():
        flip = F.lit(order.getrandbits(63))
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(flip)).alias("m"))
        move = stored(
            least.select(
                F.col("a").alias("node"),
                F.least("m", F.col("a").bitwiseXOR(flip)).bitwiseXOR(flip).alias("root"),
            ),
            "moves",
        )
        moves.append(move)
        edges = stored(
            edges.join(move.toDF("a", "ra"), "a")
            .join(move.toDF("b", "rb"), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "links",
        )
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves[0]
    for move in moves[1:]:
        further = move.toDF("root", "next")
        roots = stored(
            roots.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots"
        )
    return roots

"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantpulse.llm.common import Scratch, attach_groups


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node with a link: root is the smallest node it reaches.

    Each round links the larger neighbours of a node to its smallest neighbour (large star),
    then the smaller neighbours likewise (small star).  Neighbourhood minima are aggregates,
    and hubs meet theirs by a broadcast of proven size, so a node with a third of all links
    is no task's burden.  Rounds grow with the logarithm of the longest chain; each is
    written to the shared folder, and a round that changes nothing ends the loop.
    """
    edges = scratch.write(_directed(links.toDF("a", "b")), "star-0")
    state, at = _state(edges), 0
    while state["n"]:
        at += 1
        large = scratch.write(_directed(_star(edges, scratch, f"{at}-large", True)), f"large-{at}")
        edges = scratch.write(_directed(_star(large, scratch, f"{at}-small", False)), f"star-{at}")
        scratch.drop(f"star-{at - 1}", f"large-{at}", f"low-{at}-large", f"low-{at}-small")
        before, state = state, _state(edges)
        if state == before:
            break
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.unionAll(edges.select(F.col("b"), F.col("b")).distinct())


def _state(edges: DataFrame):
    return edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
    ).first()


def _directed(links: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller node."""
    return (
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b").distinct()
    )


def _star(edges: DataFrame, scratch: Scratch, label: str, larger: bool) -> DataFrame:
    """Link neighbours to the smallest node of each neighbourhood, itself included."""
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        around = around.unionAll(edges.select(F.col("b"), F.col("a")))
    low = around.groupBy("u").agg(
        F.count("*").alias("n"), F.least(F.min("v"), F.col("u")).alias("m")
    )
    low = scratch.write(low, f"low-{label}")
    met = attach_groups(around, low, "u", "n", around.count(), "v")
    if larger:
        return met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
        low.select(F.col("u").alias("a"), F.col("m").alias("b"))
    )

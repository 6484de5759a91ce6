"""Graphs of entities: one edge for each ordered pair, payloads, and what is reached in a few steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.sources.steps import cut


def build(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the last relation, source and confidence in order; the last evidence that isn't missing."""
    last = lambda c: F.max_by(c, "ord").alias(c)
    return edges.groupBy("src", "dst").agg(last("src_type"), last("dst_type"), last("relation"), last("source"), last("confidence"), F.max_by("evidence_id", F.when(F.col("evidence_id").isNotNull(), F.col("ord"))).alias("evidence_id"), F.count("*").alias("observed"), F.min("ord").alias("first_ord"))


def nodes(graph: DataFrame) -> DataFrame:
    """The ends of all edges, each once, with degrees."""
    ends = graph.select(F.col("src").alias("id"), F.col("src_type").alias("type"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(graph.select(F.col("dst").alias("id"), F.col("dst_type").alias("type"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("id").agg(F.min("type").alias("type"), F.sum("out").alias("out_degree"), F.sum("in").alias("in_degree"))


def cytoscape(graph: DataFrame) -> DataFrame:
    """Elements for a graph view: nodes, then edges; as JSON text."""
    n = nodes(graph).select(F.lit("node").alias("kind"), F.col("id"), F.to_json(F.struct(F.struct("id", "type").alias("data"))).alias("element"))
    id_ = F.concat("src", F.lit("->"), "dst", F.lit(":"), "relation")
    e = graph.select(F.lit("edge").alias("kind"), id_.alias("id"), F.to_json(F.struct(F.struct(id_.alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("relation").alias("label")).alias("data"))).alias("element"))
    return n.unionByName(e)


def graphml(graph: DataFrame) -> DataFrame:
    """Lines of GraphML for nodes and edges; attributes that are null are left out."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    data = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{c}">'), esc(c), F.lit("</data>"))).otherwise("")
    n = nodes(graph).select(F.lit(0).alias("part"), F.concat(F.lit('<node id="'), esc("id"), F.lit('">'), data("type"), F.lit("</node>")).alias("line"))
    e = graph.select(F.lit(1).alias("part"), F.concat(F.lit('<edge source="'), esc("src"), F.lit('" target="'), esc("dst"), F.lit('">'), data("relation"), data("source"), data("confidence"), data("evidence_id"), F.lit("</edge>")).alias("line"))
    return n.unionByName(e)


def reach(graph: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """seeds(seed) -> (seed, id, depth): what is reached from each seed in at most ``depth`` steps, at its least depth.

    Each step joins only what was new in the last one, and never goes back to what a seed has reached.
    """
    front = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).cast("long").alias("depth"))
    known = front
    hops = graph.select(F.col("src").alias("id"), F.col("dst").alias("next")).distinct()
    for step in range(1, depth + 1):
        reached = front.join(hops, "id").select("seed", F.col("next").alias("id")).distinct().withColumn("depth", F.lit(step).cast("long"))
        front = reached.join(known.select("seed", "id"), ["seed", "id"], "left_anti")
        known = known.unionByName(front)
    return known


def components(edges: DataFrame) -> DataFrame:
    """edges(src, dst) -> (id, component): the smallest id that edges reach in any direction. Written.

    Each round takes the smallest label among neighbours, then the label of that
    label, so the rounds follow the logarithm of the longest way.
    """
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("src").alias("id")).agg(F.least(F.col("src"), F.min("dst")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        step = step.join(labels.select(F.col("id").alias("to"), F.col("component").alias("further")), "to")
        step = cut(step.select("id", F.least("to", "further").alias("component"), "was"), "labels")
        if step.where("component <> was").isEmpty():
            return step.select("id", "component")
        labels = step.select("id", "component")


#: What a relation suggests to look at, by the type of its end.
PIVOTS = {
    "RESOLVES_TO": "Investigate IP",
    "BELONGS_TO_ASN": "Investigate ASN",
    "HAS_SUBDOMAIN": "Investigate certificate SAN / subdomain",
    "HAS_PROFILE": "Review public profile",
    "HAS_MX": "Investigate mail provider domain",
}


def suggest_pivots(edges: DataFrame, case: str = "source", limit: int = 12) -> DataFrame:
    """Follow-ups from edges: each action and target once, by its first edge; the first ``limit`` of each case."""
    action = F.lit(None).cast("string")
    for relation, name in PIVOTS.items():
        fits = F.col("relation") == relation
        action = F.when(fits & (F.col("dst_type") == "IP") if relation == "RESOLVES_TO" else fits, name).otherwise(action)
    found = edges.withColumn("action", action).where("action IS NOT NULL")
    first = found.groupBy(case, "action", F.col("dst").alias("target")).agg(F.min("ord").alias("ord"), F.min_by("confidence", "ord").alias("confidence"))
    from pyspark.sql import Window

    # the sort is of one row for each action and target; Spark keeps the first of each group before it moves them
    place = F.row_number().over(Window.partitionBy(case).orderBy("ord", "action", "target"))
    return first.withColumn("place", place).where(F.col("place") <= limit)

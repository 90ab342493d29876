"""Lifting a property graph into entity and relation candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions import scalars as S


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, degree) over a node set: a self-loop counts twice, nodes without edges have 0."""
    ends = edges.select(F.explode(F.array(src, dst)).alias(node)).groupBy(node).agg(F.count("*").alias("degree"))
    return nodes.select(node).distinct().join(ends, node, "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def hub_nodes(nodes: DataFrame, edges: DataFrame, sigma: float = 2.0, node: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """Nodes whose degree is over the mean by more than ``sigma`` population deviations."""
    deg = degrees(nodes, edges, node, src, dst)
    bound = deg.agg((F.avg("degree") + sigma * F.stddev_pop("degree")).alias("bound"))
    # One row: sending it along is bounded by construction.
    return deg.crossJoin(F.broadcast(bound)).filter(F.col("degree") > F.col("bound")).drop("bound")


def inner_edges(edges: DataFrame, nodes: DataFrame, node: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with both ends in ``nodes``."""
    keys = nodes.select(node).distinct()
    return edges.join(keys.withColumnRenamed(node, src), src, "left_semi").join(keys.withColumnRenamed(node, dst), dst, "left_semi")


def lift_graph(nodes: DataFrame, edges: DataFrame, sigma: float = 2.0, code_hubs: bool = False, origin: str = "graph") -> tuple[DataFrame, DataFrame]:
    """(entity candidates, relation candidates) of a graph.

    Concept nodes are candidates; hubs among the code nodes are too when asked for, or when there is no
    concept. Degrees count over the concept nodes if there are any, else over the code hubs.
    """
    concepts, code = nodes.filter("file_type = 'concept'"), nodes.filter("file_type = 'code'")
    some = not concepts.isEmpty()
    chosen = concepts
    if code_hubs or not some:
        hubs = code.join(hub_nodes(code, edges, sigma), "id", "left_semi")
        chosen = concepts.join(hubs.select("id"), "id", "left_anti").unionByName(hubs)
    base = concepts if some else chosen
    marked = chosen.join(hub_nodes(base, inner_edges(edges, base), sigma).select("id", F.lit(True).alias("hub")), "id", "left")
    is_code, label = F.col("file_type") == "code", F.coalesce("label", "id")
    tags = F.filter(F.array(F.when(F.col("hub"), "hub_candidate"), F.when(is_code, "code_symbol")), lambda t: t.isNotNull())
    file = F.nullif(F.coalesce("source_file", F.lit("")), F.lit(""))
    entities = marked.select(
        S.short_id(F.concat(F.lit(f"{origin}:"), "id")).alias("candidate_id"), S.graph_slug(F.col("id")).alias("entity_id"),
        F.when(is_code, S.symbol_type(label)).otherwise("Concept").alias("entity_type"), label.alias("label_en"), F.lit("").alias("label_ko"),
        F.array(F.concat(F.lit(f"{origin}:"), F.coalesce("source_file", F.lit("unknown")), F.lit(":"), label)).alias("evidence_spans"),
        F.concat(F.lit(f"{origin}__"), F.coalesce(S.graph_slug(S.file_stem(file)), F.lit("unknown"))).alias("source_doc_id"),
        F.when(is_code, 0.75).otherwise(0.8).alias("confidence"), tags.alias("tags"), "community", "community_name", "source_file",
    )
    relations = inner_edges(edges, chosen).select(
        S.short_id(F.concat(F.lit(f"{origin}:"), "src", F.lit(":"), "dst", F.lit(":"), F.coalesce("relation", F.lit("")))).alias("candidate_id"),
        S.graph_slug(F.col("src")).alias("source_entity_id"), F.coalesce(F.nullif("relation", F.lit("")), F.lit("related_to")).alias("predicate"), S.graph_slug(F.col("dst")).alias("target_entity_id"),
        F.array(F.concat(F.lit(f"{origin}:"), F.coalesce("source_file", F.lit("unknown")), F.lit(":"), "src", F.lit("→"), "dst")).alias("evidence_spans"), "confidence",
    )
    return entities, relations

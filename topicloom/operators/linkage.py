"""Topic hierarchy by average linkage: all mutually nearest groups of a round merge at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.features import dense_ids
from topicloom.operators.similarity import topic_similarity
from topicloom.session import cut_lineage


def average_hierarchy(topic_terms: DataFrame, topic: str = "topic_id", term: str = "term", weight: str = "weight") -> DataFrame:
    """``(merge_order, topic_a, topic_b, similarity, size)``: groups by their smallest topic, and the topics of the merged one.

    Two groups are as similar as their topics' cosines on average, where topics without a common term count zero and have no row. Under
    average linkage a merge never brings the merged group nearer to a third one than the nearer of its parts was, so groups that are each other's nearest
    may merge in any order: a round merges all of them, and merges are sorted by similarity at the end. Ties go to the smaller ids.
    A pair of groups keeps its summed similarity, so a round is one aggregation of the rows of pairs that share a term; it is written once. Groups without
    similarity to any other join the smallest one last. Null topics are left out; a topic without a weight but zero joins last. An empty table gives no rows.
    """
    terms = topic_terms.where(F.col(topic).isNotNull()).select(topic, term, weight)
    sizes = cut_lineage(terms.select(F.col(topic).alias("g")).distinct().withColumn("size", F.lit(1).cast("long")))
    edges = cut_lineage(topic_similarity(terms, topic, term, weight).where("topic_a < topic_b and similarity > 0").toDF("a", "b", "total"))
    tree = None
    while not edges.isEmpty():
        merges = cut_lineage(_mutual(edges, sizes))
        tree = merges if tree is None else tree.unionByName(merges)
        moved = merges.select(F.col("topic_b").alias("g"), F.col("topic_a").alias("_to"))
        to = lambda side: moved.toDF(side, f"_{side}")
        renamed = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "total")
        renamed = renamed.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = cut_lineage(renamed.agg(F.sum("total").alias("total")))
        sizes = cut_lineage(sizes.join(moved, "g", "left").groupBy(F.coalesce("_to", "g").alias("g")).agg(F.sum("size").alias("size")))
    lowest = sizes.agg(F.min("g")).scalar()
    rest = sizes.where(F.col("g") > lowest).select(lowest.alias("topic_a"), F.col("g").alias("topic_b"), F.lit(0.0).alias("similarity"), F.lit(None).cast("long").alias("size"))
    ordered = (rest if tree is None else tree.unionByName(rest)).withColumn("_far", -F.col("similarity"))
    ranked = dense_ids(ordered, ["_far", "size", "topic_a", "topic_b"], "merge_order")
    return ranked.select((F.col("merge_order") + 1).alias("merge_order"), "topic_a", "topic_b", "similarity", "size")


def _mutual(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs of groups that are each other's nearest. Both ends see the same row, so the nearest pair of all is always among them."""
    sized = edges.join(sizes.toDF("a", "_na"), "a").join(sizes.toDF("b", "_nb"), "b")
    pair = F.struct((F.col("total") / (F.col("_na") * F.col("_nb"))).alias("similarity"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b"), (F.col("_na") + F.col("_nb")).alias("size"))
    ends = sized.select("a", "b", pair.alias("pair")).select("pair", F.explode(F.array("a", "b")).alias("g"))
    best = ends.groupBy("g").agg(F.max("pair").alias("pair"))
    chosen = best.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    return chosen.select((-F.col("pair.a")).alias("topic_a"), (-F.col("pair.b")).alias("topic_b"), "pair.similarity", "pair.size")

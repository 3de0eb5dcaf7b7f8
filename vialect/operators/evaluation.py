"""How well groups match entities: grouping rate, collision rate and their details."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vialect.functions.text import split_names
from vialect.settings import DEFAULTS


def variants(grouped: DataFrame) -> DataFrame:
    """(wikidata_id, entity_label, name, pos) from grouped ground truth; entities in the order of their ids.

    ``pos`` orders all variants: by entity, then by place in its list. It is a struct, so no global numbering is needed.
    """
    names = grouped.select("wikidata_id", "entity_label", F.posexplode(split_names(F.col("street_names"))).alias("k", "name"))
    return names.select("wikidata_id", "entity_label", "name", F.struct("wikidata_id", "k").alias("pos"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pos`` as a number from 0; for reports and clusterings over names that fit one sorted pass."""
    return rows.withColumn("pos", (F.row_number().over(Window.orderBy("pos")) - 1).cast("long"))


def entity_scores(assigned: DataFrame) -> DataFrame:
    """From (wikidata_id, entity_label, group_id): per entity the share of its largest group. Empty group ids don't count."""
    counts = assigned.filter("group_id <> ''").groupBy("wikidata_id", "entity_label", "group_id").agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy("wikidata_id", "entity_label").agg(F.sum("n").alias("total_variants"), F.max("n").alias("dominant_count"), F.count(F.lit(1)).alias("unique_groups"))
    return out.withColumn("score", F.col("dominant_count") / F.col("total_variants"))


def group_entities(assigned: DataFrame) -> DataFrame:
    """(group_id, n_entities) of every group."""
    return assigned.filter("group_id <> ''").groupBy("group_id").agg(F.count_distinct("wikidata_id").alias("n_entities"))


def collisions(assigned: DataFrame) -> DataFrame:
    """(group_id, wikidata_id, label) of every group with several entities."""
    many = group_entities(assigned).filter("n_entities > 1").select("group_id")
    named = assigned.filter("group_id <> ''").groupBy("group_id", "wikidata_id").agg(F.max("entity_label").alias("label"))
    return named.join(many, "group_id", "left_semi")


def summary(assigned: DataFrame) -> DataFrame:
    """One row: both rates and all counts; rates are 0 where there is nothing to count."""
    scores = entity_scores(assigned).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("grouping_rate"), F.count(F.lit(1)).alias("total_entities"), F.coalesce(F.sum("total_variants"), F.lit(0)).alias("total_variants"))
    groups = group_entities(assigned).agg(F.count(F.lit(1)).alias("total_groups"), F.count_if(F.col("n_entities") > 1).alias("colliding_groups"))
    rate = F.when(F.col("total_groups") > 0, F.col("colliding_groups") / F.greatest("total_groups", F.lit(1))).otherwise(0.0)
    return scores.crossJoin(groups).select("grouping_rate", rate.alias("collision_rate"), "total_entities", "total_variants", "total_groups", "colliding_groups")


def problem_entities(assigned: DataFrame, n: int = DEFAULTS.problem_entities) -> DataFrame:
    """The ``n`` lowest scores, ties by id, without perfect ones."""
    return entity_scores(assigned).orderBy("score", "wikidata_id").limit(n).filter("score < 1")


def report(assigned: DataFrame, method: str) -> DataFrame:
    """The evaluation of a method as one nested row, ready for JSON: all collisions and all entities below 1.

    Collisions stand in the order in which their groups are first seen, their entities in that of the ground truth, each
    with its last label; problem entities by score, equal ones in the order of the ground truth. That order is ``pos``
    where the rows have it, else that of ids and names. Rates and scores have four places.
    """
    pos = F.col("pos") if "pos" in assigned.columns else F.struct("wikidata_id", "name")
    rows = assigned.withColumn("_at", pos)
    entities = rows.groupBy("wikidata_id").agg(F.min("_at").alias("seen"), F.max_by("entity_label", "_at").alias("label"))
    groups = rows.filter("group_id <> ''").groupBy("group_id").agg(F.min("_at").alias("first"))
    named = collisions(assigned).select("group_id", "wikidata_id").join(entities, "wikidata_id").groupBy("group_id")
    named = named.agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "wikidata_id", "label"))), lambda x: F.struct(x["wikidata_id"].alias("wikidata_id"), x["label"].alias("label"))).alias("entities"))
    collided = named.join(groups, "group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "group_id", "entities"))), lambda x: F.struct(x["group_id"].alias("group_id"), x["entities"].alias("entities"))).alias("collisions"))
    fields = ("wikidata_id", "entity_label", F.bround("score", 4).alias("score"), "total_variants", "dominant_count", "unique_groups")
    lowest = entity_scores(assigned).filter("score < 1").join(entities, "wikidata_id")
    lowest = lowest.agg(F.transform(F.array_sort(F.collect_list(F.struct("score", "seen", F.col("wikidata_id").alias("id"), F.struct(*fields).alias("e")))), lambda x: x["e"]).alias("problem_entities"))
    rates = summary(assigned).withColumns({c: F.bround(c, 4) for c in ("grouping_rate", "collision_rate")})
    return rates.crossJoin(collided).crossJoin(lowest).select(F.lit(method).alias("method"), "*")

"""Ground truth from tagged names and entity records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialect.functions.text import join_names, match_confidence
from vialect.settings import DEFAULTS, Settings

ENTITY_JSON = (
    "struct<labels:map<string,struct<value:string>>,aliases:map<string,array<struct<value:string>>>,"
    "claims:map<string,array<struct<mainsnak:struct<datavalue:struct<value:string>>>>>>"
)


def pairs(lines: DataFrame, tag: str = DEFAULTS.etymology_tag) -> DataFrame:
    """Distinct (name, wikidata_id) of tagged segments, by name."""
    value = F.try_element_at("tags", F.lit(tag))
    rows = lines.filter(F.col("name").isNotNull() & F.col("highway").isNotNull() & value.isNotNull())
    return rows.select("name", value.alias("wikidata_id")).distinct().orderBy("name", "wikidata_id")


def entity_ids(found: DataFrame) -> DataFrame:
    return found.filter(F.col("wikidata_id").isNotNull() & (F.col("wikidata_id") != "")).select(F.col("wikidata_id").alias("qid")).distinct()


def missing(ids: DataFrame, entities: DataFrame) -> DataFrame:
    """Ids without a record."""
    return ids.join(entities.select("qid"), "qid", "left_anti")


def parse_entity(qid: Column, payload: Column, settings: Settings = DEFAULTS) -> Column:
    """An entity record from a JSON response; keys that are missing leave their lists empty.

    Labels are those of each language and then its aliases, in the order of languages, each once.
    """
    entity = F.from_json(F.get_json_object(payload, "$.entities"), f"map<string,{ENTITY_JSON}>")
    e = F.try_element_at(entity, qid)
    none = F.array().cast("array<string>")
    labels = F.flatten(F.array(*[
        F.concat(
            F.coalesce(F.filter(F.array(F.try_element_at(e["labels"], F.lit(x))["value"]), lambda v: v.isNotNull()), none),
            F.coalesce(F.transform(F.try_element_at(e["aliases"], F.lit(x)), lambda a: a["value"]), none),
        )
        for x in settings.label_languages
    ]))
    kinds = F.coalesce(F.transform(F.try_element_at(e["claims"], F.lit("P31")), lambda c: F.get_json_object(c["mainsnak"]["datavalue"]["value"], "$.id")), none)
    kinds = F.filter(kinds, lambda k: k.isNotNull())
    return F.struct(
        qid.alias("qid"), F.array_distinct(labels).alias("labels"), kinds.alias("instance_of"),
        F.array_contains(kinds, "Q5").alias("is_human"), F.coalesce(F.try_element_at(labels, F.lit(1)), qid).alias("primary_label"),
    )


def score(found: DataFrame, entities: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Pairs with label, kind and confidence; a pair whose entity is unknown has its id as label and confidence 0."""
    both = found.join(entities, found["wikidata_id"] == entities["qid"], "left")
    known = F.col("qid").isNotNull()
    return both.select(
        F.col("name").alias("street_name"),
        "wikidata_id",
        F.coalesce("primary_label", "wikidata_id").alias("entity_label"),
        "is_human",
        F.when(known, match_confidence(F.col("name"), F.col("labels"), F.col("is_human"), settings)).otherwise(0.0).alias("confidence"),
    )


def confidence_counts(scored: DataFrame, threshold: float = DEFAULTS.confidence_threshold) -> DataFrame:
    valid = F.col("confidence") >= threshold
    return scored.agg(F.count_if(valid).alias("valid"), F.count_if(~valid).alias("excluded"))


def grouped(scored: DataFrame, threshold: float = DEFAULTS.confidence_threshold) -> DataFrame:
    """Entities with several confident names: names sorted and joined; label and kind of the first name."""
    rows = scored.filter(F.col("confidence") >= threshold).groupBy("wikidata_id")
    out = rows.agg(
        F.min_by("entity_label", "street_name").alias("entity_label"),
        F.min_by("is_human", "street_name").alias("is_human"),
        join_names(F.collect_set("street_name")).alias("street_names"),
        F.count(F.lit(1)).alias("_n"),
    )
    return out.filter("_n > 1").drop("_n").orderBy("wikidata_id")

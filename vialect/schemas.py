"""Schemas of every table and file that the engine reads or writes; nothing is inferred."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"
LINES = f"name string, highway string, tags map<string,string>, way array<{POINT}>"
METADATA = "key string, value string"
LENGTHS = "name string, total_m double, segments_count bigint, street_count bigint"
UNTAGGED = "name string"
PAIRS = "name string, wikidata_id string"
ENTITIES = "qid string, labels array<string>, instance_of array<string>, is_human boolean, primary_label string"
GROUND_TRUTH = "street_name string, wikidata_id string, entity_label string, is_human boolean, confidence double"
GROUPED = "wikidata_id string, entity_label string, is_human boolean, street_names string"
LLM_CACHE = "model string, name string, canonical string, updated_on string"
EVALUATION = (
    "method string, grouping_rate double, collision_rate double, total_entities bigint, total_variants bigint, total_groups bigint, colliding_groups bigint, "
    "collisions array<struct<group_id:string,entities:array<struct<wikidata_id:string,label:string>>>>, "
    "problem_entities array<struct<wikidata_id:string,entity_label:string,score:double,total_variants:bigint,dominant_count:bigint,unique_groups:bigint>>"
)

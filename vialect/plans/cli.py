"""Command line: compute, ground_truth, evaluate and export_mappings over files."""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vialect import schemas
from vialect.operators import evaluation, ground_truth, lengths, mappings
from vialect.operators.normalizers import Registry, default_registry
from vialect.session import local_session
from vialect.settings import DEFAULTS
from vialect.sources import files


def compute(spark: SparkSession, lines: str, out: str, untagged: str, limit: int | None) -> None:
    table = files.read_lines(spark, lines)
    rows = lengths.street_lengths(table)
    if limit:
        rows = rows.limit(limit)
    if out:
        files.write_csv(rows, out)
    else:
        for line in files.report(rows):
            print(line)
    files.write_csv(lengths.untagged(table), untagged)


def make_ground_truth(spark: SparkSession, lines: str, entities: str, out: str, grouped: str) -> None:
    known = files.read_or_empty(spark, entities, schemas.ENTITIES)
    scored = ground_truth.score(ground_truth.pairs(files.read_lines(spark, lines)), known)
    files.write_csv(scored.orderBy("street_name", "wikidata_id"), out)
    files.write_csv(ground_truth.grouped(scored), grouped)
    print(ground_truth.confidence_counts(scored).head().asDict())


def evaluate(spark: SparkSession, grouped: str, methods: list[str], registry: Registry, out: str | None, verbose: bool) -> DataFrame:
    names = evaluation.numbered(evaluation.variants(files.read_csv(spark, grouped, schemas.GROUPED)))
    reports = None
    for method in methods:
        groups = registry.get(method)(names.groupBy("name").agg(F.min("pos").alias("pos"))).select("name", "group_id")
        assigned = names.join(groups, "name")
        row = evaluation.report(assigned, method)
        reports = row if reports is None else reports.unionByName(row)
        s = row.head()
        print(f"{method}: grouping {s['grouping_rate']:.1%}, collisions {s['collision_rate']:.1%}; {s['total_entities']} entities, {s['total_variants']} variants, {s['total_groups']} groups")
        if verbose:
            for e in s["problem_entities"][: DEFAULTS.problem_entities]:
                print(f"  {e['entity_label']}: {e['score']:.0%} ({e['dominant_count']}/{e['total_variants']} variants, {e['unique_groups']} groups)")
            for c in s["collisions"][: DEFAULTS.collisions]:
                print(f"  {c['group_id']!r} merges {', '.join(f'{x.label} ({x.wikidata_id})' for x in c['entities'])}")
    if out:
        files.write_json(reports.withColumn("generated_at", F.lit(datetime.now(timezone.utc).isoformat())), out)
    return reports


def export_mappings(spark: SparkSession, lengths_csv: str, out: str, methods: list[str], registry: Registry) -> DataFrame:
    rows = files.read_lengths(spark, lengths_csv)
    rows = rows.withColumn("pos", (F.row_number().over(Window.orderBy(F.desc("total_m"), "name")) - 1).cast("long"))
    found = None
    for method in methods:
        assign = registry.get(method)
        if hasattr(assign, "warm"):
            assign.warm(rows.select("name", "pos"))
        groups = assign(rows.groupBy("name").agg(F.min("pos").alias("pos"))).select("name", "group_id")
        row = mappings.nested(rows.join(groups, "name"), method)
        found = row if found is None else found.unionByName(row)
    files.write_json(found.withColumn("generated_at", F.lit(datetime.now(timezone.utc).isoformat())), out)
    return found


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="vialect", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("compute")
    p.add_argument("lines")
    p.add_argument("--limit", type=int)
    p.add_argument("--out", default="street_lengths")
    p.add_argument("--untagged", default="untagged_streets")
    p = sub.add_parser("ground_truth")
    p.add_argument("lines")
    p.add_argument("--cache", default="entities")
    p.add_argument("-o", "--out", default="ground_truth")
    p.add_argument("--grouped", default="ground_truth_grouped")
    p = sub.add_parser("evaluate")
    p.add_argument("--cache", help="folder of the models' answers")
    p.add_argument("grouped")
    p.add_argument("-m", "--method", action="append")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--json")
    p = sub.add_parser("export_mappings")
    p.add_argument("--cache", help="folder of the models' answers")
    p.add_argument("-i", "--input", default="street_lengths")
    p.add_argument("-o", "--out", default="mappings")
    p.add_argument("-m", "--method", action="append")
    a = parser.parse_args(args)
    spark, registry = local_session(), default_registry()
    local = [m for m in registry.ids() if not m.startswith("llm_")]
    for m in set(registry.ids()) - set(local):
        if a.command != "ground_truth" and getattr(a, "cache", None):
            registry.get(m).path = f"{a.cache.rstrip('/')}/{m}"
    if a.command == "compute":
        compute(spark, a.lines, a.out, a.untagged, a.limit)
    elif a.command == "ground_truth":
        make_ground_truth(spark, a.lines, a.cache, a.out, a.grouped)
    elif a.command == "evaluate":
        evaluate(spark, a.grouped, a.method or local, registry, a.json, a.verbose)
    else:
        export_mappings(spark, a.input, a.out, a.method or local, registry)


if __name__ == "__main__":
    main()

"""Enrichment by outside services: entity records and language-model names, with caches as tables.

A service is a callable that the caller injects; it runs on the executors. Answers are cached as rows, so a run asks only
for what no earlier run has answered.
"""

from __future__ import annotations

import datetime
import json
import sys
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vialect import schemas
from vialect.functions.text import ascii_norm, clean_reply, strip_fence
from vialect.operators.graph import stored
from vialect.operators.ground_truth import missing, parse_entity
from vialect.settings import DEFAULTS, Settings
from vialect.sources import files

# The examples shown to a model.
EXAMPLES = {
    "Štefánikova": "Milan Rastislav Štefánik",
    "M. R. Štefánika": "Milan Rastislav Štefánik",
    "Námestie gen. Štefánika": "Milan Rastislav Štefánik",
    "Komenského": "Jan Amos Komenský",
    "Hviezdoslavova": "Pavol Országh Hviezdoslav",
    "Lipová": "Lipová",
    "Hlavná": "Hlavná",
}
TASK = (
    "Say what a Slovak street is named after. For a person give the full name in the Slovak nominative, for a place the name of the place; "
    "a name that only describes the street stays as it is. Answer with that name alone, without explanation or punctuation around it."
)
BATCH_TASK = TASK + " You get several names; answer with one JSON object that maps every name, exactly as it was given, to its answer, and with nothing else."


def prompt(names: Column) -> Column:
    """The message for a list of names, one to a line and quoted."""
    shown = "Examples:\n" + "".join(f'"{k}" → {v}\n' for k, v in EXAMPLES.items())
    return F.concat(F.lit(shown + "\nNames:\n"), F.array_join(F.transform(names, lambda n: F.concat(F.lit('"'), n, F.lit('"'))), "\n"))


def fetch_entities(ids: DataFrame, entities: DataFrame, fetch: Callable[[str], str | None], settings: Settings = DEFAULTS, workers: int = 1) -> DataFrame:
    """``entities`` with the records of ids that it lacks; an id whose request fails stays without.

    ``fetch`` gives the JSON text for an id. ``workers`` requests run at a time, each after a delay.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for qid in batch["qid"]:
                try:
                    out.append(fetch(qid))
                except Exception as e:  # noqa: BLE001  a failed request is a missing answer
                    print(f"no answer for {qid}: {e}", file=sys.stderr)
                    out.append(None)
                time.sleep(settings.request_delay)
            yield batch.assign(payload=out)

    found = missing(ids, entities).repartition(workers).mapInPandas(run, "qid string, payload string").filter("payload is not null")
    records = found.select(parse_entity(F.col("qid"), F.col("payload"), settings).alias("e")).select("e.*")
    return entities.unionByName(stored(records))


def batches(names: DataFrame, size: int = DEFAULTS.llm_batch, lanes: int = 1) -> DataFrame:
    """(batch, names): distinct names in batches of ``size``. Names are dealt over ``lanes`` that number theirs apart."""
    lane = F.pmod(F.xxhash64("name"), F.lit(lanes)) if lanes > 1 else F.lit(0)
    rows = names.select("name").distinct().withColumn("lane", lane)
    rows = rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("lane").orderBy("name")) - 1) / size))
    return rows.groupBy("lane", "batch").agg(F.sort_array(F.collect_list("name")).alias("names"))


def ask(requests: DataFrame, complete: Callable[[str, str, int], str], settings: Settings = DEFAULTS, task: str = BATCH_TASK) -> DataFrame:
    """``requests`` with the reply to each message, null for one that failed. ``complete`` takes task, message and most tokens."""
    most = settings.llm_tokens_batch if task == BATCH_TASK else settings.llm_tokens_single

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = False
        for rows in found:
            out = []
            for message in rows["message"]:
                if asked:
                    time.sleep(settings.llm_delay)
                asked = True
                try:
                    out.append(complete(task, message, most))
                except Exception as e:  # noqa: BLE001  a failed request is a missing answer
                    print(f"no reply: {e}", file=sys.stderr)
                    out.append(None)
            yield rows.assign(reply=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields) + ", reply string"
    return requests.mapInPandas(run, schema)


def canonical(name: Column, answer: Column, settings: Settings = DEFAULTS) -> Column:
    """The normalized answer; without one the normalized name, or empty, as the settings say."""
    cleaned = clean_reply(answer)
    instead = ascii_norm(name) if settings.llm_fallback else F.lit("")
    return F.when(answer.isNull() | (cleaned == ""), instead).otherwise(cleaned)


def _dated(rows: DataFrame, model: str) -> DataFrame:
    today = datetime.date.today().isoformat()
    return rows.select(F.lit(model).alias("model"), "name", "canonical", F.lit(today).alias("updated_on"))


def uncached(names: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Names that the cache has no row for; an empty answer is one."""
    return names.select("name").join(cache.filter(F.col("model") == model).select("name"), "name", "left_anti")


def _answers(requests: DataFrame, complete: Callable[[str, str, int], str], settings: Settings, model: str, lanes: int) -> DataFrame:
    """Rows of a cache for the names of some batches, each asked for once."""
    replies = stored(ask(requests.repartition(lanes, "lane"), complete, settings))
    answers = replies.withColumn("a", F.from_json(strip_fence(F.col("reply")), "map<string,string>")).select(F.explode("names").alias("name"), "a")
    return _dated(answers.select("name", canonical(F.col("name"), F.try_element_at("a", F.col("name")), settings).alias("canonical")), model)


def warm(names: DataFrame, cache: DataFrame, model: str, complete: Callable[[str, str, int], str], settings: Settings = DEFAULTS, lanes: int = 1) -> DataFrame:
    """``cache`` with an answer for every name, asked for in batches; failures are cached as such."""
    requests = batches(uncached(names, cache, model), settings.llm_batch, lanes).withColumn("message", prompt(F.col("names")))
    return cache.unionByName(_answers(requests, complete, settings, model, lanes))


def warm_saved(
    names: DataFrame, path: str, model: str, complete: Callable[[str, str, int], str], settings: Settings = DEFAULTS, lanes: int = 1, at_a_time: int = 1
) -> DataFrame:
    """The cache at ``path`` with an answer for every name; after every ``at_a_time`` batches of each lane their answers are
    appended to it, so a job that fails has lost those of one such round and asks for no more when it is run again."""
    spark = names.sparkSession
    cache = files.read_or_empty(spark, path, schemas.LLM_CACHE)
    requests = stored(batches(uncached(names, cache, model), settings.llm_batch, lanes).withColumn("message", prompt(F.col("names"))))
    last = requests.agg(F.max("batch")).head()[0]
    for low in range(0, 0 if last is None else last + 1, at_a_time):
        some = requests.filter(F.col("batch").between(low, low + at_a_time - 1))
        files.append_cache(_answers(some, complete, settings, model, lanes), path)
    return files.read_or_empty(spark, path, schemas.LLM_CACHE)


def warm_single(names: DataFrame, cache: DataFrame, model: str, complete: Callable[[str, str, int], str], settings: Settings = DEFAULTS, lanes: int = 1) -> DataFrame:
    """As ``warm``, with a request for each name."""
    requests = uncached(names, cache, model).distinct().withColumn("message", prompt(F.array("name"))).repartition(lanes, "name")
    replies = stored(ask(requests, complete, settings, TASK))
    return cache.unionByName(_dated(replies.select("name", canonical(F.col("name"), F.col("reply"), settings).alias("canonical")), model))


def cache_date(cache: DataFrame, model: str) -> DataFrame:
    return cache.filter(F.col("model") == model).agg(F.max("updated_on").alias("updated_on"))


def assign(names: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """``names`` with group_id from the cache; empty where there is none."""
    known = cache.filter(F.col("model") == model).groupBy("name").agg(F.max_by("canonical", "updated_on").alias("canonical"))
    return names.join(known, "name", "left").withColumn("group_id", F.coalesce("canonical", F.lit(""))).drop("canonical")


def stub_reply(task: str, message: str, most: int) -> str:
    """A stand-in for a service: every name in capitals; for tests and dry runs."""
    names = [line[1:-1] for line in message.split("Names:\n", 1)[1].split("\n")]
    return json.dumps({n: n.upper() for n in names}, ensure_ascii=False) if task == BATCH_TASK else names[0].upper()

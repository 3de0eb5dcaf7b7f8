"""The registry of normalizers: an id and a function from names (name, pos) to (name, pos, group_id)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vialect import schemas
from vialect.functions.text import suffix_key
from vialect.operators import clustering, enrich
from vialect.sources import files, services

Assign = Callable[[DataFrame], DataFrame]


def _joined(names: DataFrame, groups: DataFrame) -> DataFrame:
    return names.join(groups.select("name", "group_id"), "name", "left").withColumn("group_id", F.coalesce("group_id", F.lit("")))


def by_suffix(names: DataFrame) -> DataFrame:
    return names.withColumn("group_id", suffix_key(F.col("name")))


def by_indel(names: DataFrame) -> DataFrame:
    return _joined(names, clustering.leader_indel(names))


def by_ngram(names: DataFrame) -> DataFrame:
    return _joined(names, clustering.leader_jaccard(names))


def from_function(f: Callable[[str], str]) -> Assign:
    """Any function of a name, run in batches on the executors."""

    @F.pandas_udf(T.StringType())
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return lambda names: names.withColumn("group_id", F.coalesce(apply("name"), F.lit("")))


@dataclass
class ModelNormalizer:
    """Groups by a language model's answers; calls fill the cache. ``complete`` and ``cache`` may be set by the caller. With
    a ``path`` the cache is a table there, to which answers are appended batch by batch."""

    provider: str
    model: str
    complete: Callable[[str, str, int], str] | None = None
    cache: DataFrame | None = None
    path: str | None = None

    def _ready(self, names: DataFrame) -> None:
        if self.complete is None:
            self.complete = services.model_source(self.provider, self.model)
        if self.complete is None:
            raise LookupError(f"{self.model}: no provider function was given, and {services.KEYS[self.provider]} isn't set")
        if self.cache is None:
            spark = names.sparkSession
            self.cache = files.read_or_empty(spark, self.path, schemas.LLM_CACHE) if self.path else spark.createDataFrame([], schemas.LLM_CACHE)

    def warm(self, names: DataFrame) -> None:
        self._ready(names)
        if self.path:
            self.cache = enrich.warm_saved(names, self.path, self.model, self.complete)
        else:
            self.cache = enrich.warm(names, self.cache, self.model, self.complete)

    def __call__(self, names: DataFrame) -> DataFrame:
        self._ready(names)
        if self.path:
            self.warm(names)
        else:
            self.cache = enrich.warm_single(names, self.cache, self.model, self.complete)
        return enrich.assign(names, self.cache, self.model)

    def cache_date(self) -> str | None:
        return None if self.cache is None else enrich.cache_date(self.cache, self.model).head()[0]


@dataclass
class Registry:
    """Normalizers by id, in order."""

    methods: dict[str, Assign] = field(default_factory=dict)

    def register(self, method: str, assign: Assign) -> None:
        self.methods[method] = assign

    def ids(self) -> list[str]:
        return list(self.methods)

    def get(self, method: str) -> Assign:
        if method not in self.methods:
            raise KeyError(f"unknown method {method!r}; there are {', '.join(self.methods)}")
        return self.methods[method]


def default_registry() -> Registry:
    """The six methods; ids and models are fixed values."""
    return Registry(
        {
            "suffix_stripping": by_suffix,
            "levenshtein": by_indel,
            "ngram": by_ngram,
            "llm_gpt4o_mini": ModelNormalizer("openai", "gpt-4o-mini"),
            "llm_claude_haiku": ModelNormalizer("anthropic", "claude-haiku-4-5-20251001"),
            "llm_gemini_flash": ModelNormalizer("gemini", "gemini-2.5-flash"),
        }
    )

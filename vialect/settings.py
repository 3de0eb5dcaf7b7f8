"""Tunables, with the defaults that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Thresholds, label languages, report sizes, batch sizes and delays (seconds)."""

    confidence_threshold: float = 0.7
    confidence_exact: float = 1.0
    confidence_stem: float = 0.9
    confidence_prefix: float = 0.7
    label_languages: tuple[str, ...] = ("sk", "cs", "en", "de", "hu")
    problem_entities: int = 10
    collisions: int = 10
    indel_ratio: float = 0.8
    ngram_size: int = 3
    ngram_jaccard: float = 0.5
    request_delay: float = 0.1
    request_timeout: float = 10
    llm_delay: float = 0.05
    llm_batch: int = 40
    llm_tokens_single: int = 100
    llm_tokens_batch: int = 4096
    llm_fallback: bool = False
    cluster_eps: float = 100.0
    etymology_tag: str = field(default="name:etymology:wikidata")


DEFAULTS = Settings()

"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over ``host + path`` together with the literal tokens that any match must contain
as whole tokens. A rule is filed under the one of its tokens that the fewest URLs of the table hold. A URL looks its own
tokens up in that index and runs the regular expressions of the rules it finds, and no others; rules without a whole
token are tried on every URL. Everything stays in JVM expressions; the index is a map literal whose size is that of the
rule list.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``site``: whether it is a host and path rule, which goes before all patterns; among those the longest wins."""

    text: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = field(default=())
    site: bool = False


def site_rule(text: str, verdict: str) -> Rule:
    """A rule ``host/path``: fits the host and its subdomains where the URL's path starts with the rule's.

    The last token of a path that doesn't end the segment (``/en/7``) may go on in the URL, so it is no whole token.
    """
    host, _, path = text.partition("/")
    path = f"/{path}" if "/" in text else ""
    whole = [m.group() for m in re.finditer(TOKEN, host)]
    whole += [m.group() for m in re.finditer(TOKEN, path.lower()) if m.end() < len(path)]
    return Rule(text, verdict, rf"^(?:[^/]*\.)?{_quoted(host)}(?:(?=/)|$){_quoted(path)}", tuple(dict.fromkeys(whole)), True)


def pattern_rule(pattern: str, verdict: str, *tokens: str) -> Rule:
    """``tokens``: literals that stand as whole tokens in any match; the caller vouches for them."""
    return Rule(pattern, verdict, pattern, tokens)


def _quoted(s: str) -> str:
    return re.sub(r"[^A-Za-z0-9/_]", lambda m: "\\" + m.group(), s)


#: The rules of the registered query, in the order of its contract.
SITE_RULES = [
    site_rule("com/en/", "block"),
    site_rule("example.com/en/7", "allow"),
    site_rule("net/de/", "allow"),
    site_rule("example.net/de/8", "block"),
    site_rule("org/es/", "block"),
]
#: What the method itself blocks: paths that hold no running text.
PATTERN_RULES = [
    pattern_rule(r"/(?:login|signin|register)(?:[/.]|$)", "block"),
    pattern_rule(r"/wp-login\.php", "block", "wp", "login"),
    pattern_rule(r"/cart(?:/|$)", "block", "cart"),
    pattern_rule(r"/checkout(?:/|$)", "block", "checkout"),
    pattern_rule(r"^(?:[^/]*\.)?adserver\.", "block", "adserver"),
    pattern_rule(r"/ads/", "block", "ads"),
    pattern_rule(r"\.zip$", "block", "zip"),
    pattern_rule(r"\.exe$", "block", "exe"),
    pattern_rule(r"/calendar/[0-9]{4}/[0-9]{1,2}/", "block", "calendar"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the URL is null or has no ``://``."""
    at = F.instr(url, "://")
    tail = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    raw = F.regexp_extract(tail, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(tail, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def _tokens() -> Column:
    text = F.translate(F.concat("host", "path"), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_distinct(F.split(text, r"[^a-z0-9]+"))


def token_counts(df: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many URLs hold each of the given tokens: at most one row for each token comes to the driver."""
    if not tokens:
        return {}
    wanted = F.array(*[F.lit(t) for t in sorted(tokens)])
    found = df.select(F.explode(F.array_intersect(_tokens(), wanted)).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in found.collect()}


def index_rules(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Each rule under its rarest token; under ``""`` if it has none."""
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(rule)
    return index


def filter_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict, and ``tried``: how many regular expressions ran on the row.

    A null URL, and one without ``://``, has empty host and path and gets the default verdict unless a rule without host
    fits. Repeated rows are judged alike. Columns of ``df`` with the names of the result are replaced.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "tried")]
    based = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host.alias("host"), path.alias("path"))
    index = index_rules(rules, token_counts(based, {t for r in rules for t in r.tokens}))

    def packed(rule: Rule) -> Column:
        return F.struct(
            F.lit(int(rule.site)).alias("site"), F.lit(len(rule.text)).alias("size"), F.lit(rule.text).alias("text"),
            F.lit(rule.verdict).alias("verdict"), F.lit(rule.pattern).alias("pattern"),
        )

    always = F.array(*[packed(r) for r in index.get("", [])]) if index.get("") else F.filter(F.array(packed(rules[0])), lambda _: F.lit(False))
    filed = {t: F.array(*[packed(r) for r in found]) for t, found in index.items() if t}
    if filed:
        lookup = F.create_map(*[x for t, found in filed.items() for x in (F.lit(t), found)])
        hits = F.filter(F.transform(_tokens(), lambda t: F.try_element_at(lookup, t)), lambda x: x.isNotNull())
        candidates = F.concat(always, F.flatten(hits))
    else:
        candidates = always
    out = based.withColumn("candidates", candidates)
    fits = F.filter("candidates", lambda r: F.rlike(F.concat("host", "path"), r["pattern"]))
    out = out.withColumn("best", F.array_max(fits))
    return out.select(
        "row.*", "host", "path",
        F.when(F.col("best.site") == 1, F.col("best.text")).alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
        F.size("candidates").alias("tried"),
    )

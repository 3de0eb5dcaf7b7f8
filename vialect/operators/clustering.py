"""Leader clustering of names, exactly as a loop over the names in order would do it, but in parallel.

The loop lets a name join the best earlier representative that is similar enough, else makes it a representative. A name
is a representative exactly if none of its earlier similar names is one: the greedy maximal independent set, found in
rounds (Blelloch, Fineman and Shun, SPAA 2012). Nodes are raw names; names with equal normalized form may end in
different groups, so they aren't merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialect.functions.similarity import indel_ratio, letters, ngrams
from vialect.functions.text import preprocess_name
from vialect.operators.graph import stored
from vialect.settings import DEFAULTS


def nodes(names: DataFrame, name: str = "name", pos: str = "pos") -> DataFrame:
    """Distinct raw names with their first position and normalized form; those without significant words have no group."""
    first = names.groupBy(name).agg(F.min(pos).alias("pos")).withColumnRenamed(name, "name")
    return first.withColumn("p", preprocess_name(F.col("name"))).filter("p <> ''")


def _rare_first(sets: DataFrame, needed: Column, together: int) -> DataFrame:
    """(pos, token) of the prefix of each set in the order of rising frequency.

    Sets with ``needed`` common members share one within the first n - needed + 1 of either, and two within one member
    more, and so on. With ``together`` = 2 the tokens are all pairs within that prefix, which are far rarer than members.
    """
    tokens = sets.select("pos", "n", F.explode("members").alias("token"))
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    ranked = tokens.join(frequency, "token").groupBy("pos", "n").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("ordered"))
    prefix = ranked.select("pos", "n", F.transform(F.slice("ordered", F.lit(1), (F.col("n") - needed + together).cast("int")), lambda o: o["token"]).alias("prefix"))
    if together == 1:
        return prefix.select("pos", F.explode("prefix").alias("token"))
    pairs = F.flatten(F.transform("prefix", lambda x, i: F.transform(F.slice("prefix", i + 2, F.size("prefix")), lambda y: F.concat(x, F.lit(" "), y))))
    return prefix.select("pos", F.explode(F.when(F.col("n") > 1, pairs).otherwise(F.col("prefix"))).alias("token"))


def _candidates(sets: DataFrame, needed: Column, shortest: float, together: int = 1) -> DataFrame:
    """Pairs (i, j) with j before i that share a prefix token and have sizes that allow the threshold."""
    prefix = _rare_first(sets, needed, together).join(sets.select("pos", "n"), "pos")
    a, b = prefix.alias("a"), prefix.alias("b")
    near = (F.col("b.pos") < F.col("a.pos")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * shortest - 1e-9)
    return a.join(b, (F.col("a.token") == F.col("b.token")) & near).select(F.col("a.pos").alias("i"), F.col("b.pos").alias("j")).distinct()


def jaccard_edges(names: DataFrame, threshold: float = DEFAULTS.ngram_jaccard, n: int = DEFAULTS.ngram_size) -> DataFrame:
    """(i, j, s) for names with n-gram Jaccard similarity from ``threshold``, j before i."""
    sets = names.select("pos", ngrams(F.col("p"), n).alias("members")).withColumn("n", F.size("members"))
    pairs = _candidates(sets, F.ceil(F.col("n") * threshold - 1e-9), threshold)
    both = pairs.join(sets.select(F.col("pos").alias("i"), F.col("members").alias("x")), "i").join(sets.select(F.col("pos").alias("j"), F.col("members").alias("y")), "j")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("i", "j", (common / (F.size("x") + F.size("y") - common)).alias("s")).filter(F.col("s") >= threshold)


def indel_edges(names: DataFrame, threshold: float = DEFAULTS.indel_ratio) -> DataFrame:
    """(i, j, s) for names with InDel ratio from ``threshold``, j before i.

    Common letters bound the common subsequence. Single letters are too frequent to find candidates by, so pairs of the
    rarest ones are used; above 2/3 names of two letters or more have two in common, and one of one letter is near to
    itself only.
    """
    sets = names.select("pos", "p", letters(F.col("p")).alias("members")).withColumn("n", F.length("p"))
    shortest = threshold / (2 - threshold)
    pairs = _candidates(sets.drop("p"), F.ceil(F.col("n") * shortest - 1e-9), shortest, 2 if threshold > 2 / 3 else 1)
    both = pairs.join(sets.select(F.col("pos").alias("i"), F.col("p").alias("x"), F.col("members").alias("u")), "i")
    both = both.join(sets.select(F.col("pos").alias("j"), F.col("p").alias("y"), F.col("members").alias("v")), "j")
    both = both.filter(2 * F.size(F.array_intersect("u", "v")) >= threshold * (F.length("x") + F.length("y")) - 1e-9)
    return both.select("i", "j", indel_ratio("x", "y").alias("s")).filter(F.col("s") >= threshold)


def leaders(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, pos, group_id, is_leader) for ``nodes`` and the edges among them."""
    edges = stored(edges.select("i", "j", "s"))
    status = stored(names.select("pos", F.lit("?").alias("status")))
    while True:
        seen = edges.join(status.select(F.col("pos").alias("j"), "status"), "j").groupBy("i")
        seen = seen.agg(F.max((F.col("status") == "leader").cast("int")).alias("led"), F.min((F.col("status") == "member").cast("int")).alias("free"))
        found = F.when(F.col("status") != "?", F.col("status")).when(F.col("led") == 1, "member").when(F.coalesce("free", F.lit(1)) == 1, "leader").otherwise("?")
        status = stored(status.join(seen.withColumnRenamed("i", "pos"), "pos", "left").select("pos", found.alias("status")))
        if status.filter("status = '?'").isEmpty():
            break
    led = status.filter("status = 'leader'").select(F.col("pos").alias("j"))
    best = edges.join(led, "j").groupBy("i").agg(F.max_by("j", F.struct("s", -F.col("j"))).alias("j")).withColumnRenamed("i", "pos")
    out = names.join(status, "pos").join(best, "pos", "left").withColumn("j", F.when(F.col("status") == "leader", F.col("pos")).otherwise(F.col("j")))
    return out.join(names.select(F.col("pos").alias("j"), F.col("p").alias("group_id")), "j").select("name", "pos", "group_id", (F.col("status") == "leader").alias("is_leader"))


def leader_jaccard(names: DataFrame, threshold: float = DEFAULTS.ngram_jaccard, n: int = DEFAULTS.ngram_size) -> DataFrame:
    found = stored(nodes(names))
    return leaders(found, jaccard_edges(found, threshold, n))


def leader_indel(names: DataFrame, threshold: float = DEFAULTS.indel_ratio) -> DataFrame:
    found = stored(nodes(names))
    return leaders(found, indel_edges(found, threshold))

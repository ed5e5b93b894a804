"""Mixing sources to target weights, measured in tokens.

Every document gets a uniform random key, a hash of its id written in hexadecimal digits. The
keys of a source are range-partitioned: a key's first three digits name its range. Token counts are summed by (source,
range) - combined before the shuffle, so a hot source costs no more than its 4,096 ranges - and
prefix sums over the ranges find the one that holds the source's budget. Only that range is
sorted and summed row by row; ranges below it are taken whole, ranges above it not at all.
A source whose budget exceeds its size is repeated in whole epochs before the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plan_mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row for each target: source, target_share, max_repeats, docs, tokens, budget, epochs, remainder, reachable.

    ``total_tokens`` is the size of the mix; by default the size of all documents of the target
    sources. The budget is the share of it, at most ``max_repeats`` times the source's tokens;
    ``epochs`` whole passes are taken and ``remainder`` tokens of one more.
    """
    sizes = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    t = targets.select("source", F.col("target_share").cast("double"), F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0)).alias("max_repeats")).dropna().dropDuplicates(["source"])
    own = t.join(sizes, "source", "left").fillna(0, ["docs", "tokens"])
    all_ = own.agg(F.sum("tokens").alias("available")) if total_tokens is None else own.sparkSession.range(1).select(F.lit(int(total_tokens)).alias("available"))
    own = own.crossJoin(F.broadcast(all_))  # one row
    asked = F.floor(F.col("target_share") * F.col("available")).cast("long")
    most = F.col("tokens") * F.col("max_repeats")
    own = own.withColumn("asked", asked).withColumn("budget", F.least(asked, most)).withColumn("reachable", asked <= most)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens")).cast("long")).otherwise(0)
    return own.withColumn("epochs", epochs).withColumn("remainder", F.col("budget") - F.col("epochs") * F.col("tokens")).drop("available")


def _key(seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.lit(str(seed))).cast("binary"))


def mix_sources(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1) -> DataFrame:
    """Which documents are used how often: doc_id, source, n_tokens, repeats (only documents used at all).

    ``sized``: doc_id, source, n_tokens. The last document of a source is the one with which its
    budget is not exceeded, so a source falls short by less than one document unless its budget
    is out of reach. Documents without a source, or of a source without target, are not used;
    documents of 0 tokens take part (they cost nothing), no more than ``max_repeats`` times
    either; a source of nothing but such documents has no budget and gives none. ``targets`` is a list of sources, one
    row each (repeated or null sources are ignored); it is joined by broadcast if it is small
    enough for Spark's own limit. Repeated doc_ids are different documents. Empty tables give an
    empty result.
    """
    sized = sized.select("doc_id", "source", F.col("n_tokens").cast("long")).filter("source is not null")
    plan = plan_mix(sized, targets, total_tokens).select("source", "epochs", "remainder", "max_repeats")
    docs = sized.withColumn("key", _key(seed)).withColumn("range", F.substring("key", 1, 3))
    by_range = docs.groupBy("source", "range").agg(F.sum("n_tokens").alias("tokens")).join(plan, "source")
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("range"))
    by_range = by_range.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("tokens"))
    # whole: the range lies below the cut; cut: the budget ends inside it. Without a remainder there is no further pass,
    # not even of documents that cost nothing, and none beyond max_repeats
    again = (F.col("remainder") > 0) & (F.col("epochs") < F.col("max_repeats"))
    state = F.when(~again, 0).when(F.col("upto") <= F.col("remainder"), 2).when(F.col("before") < F.col("remainder"), 1).otherwise(0)
    by_range = by_range.withColumn("state", state).select("source", "range", "epochs", "remainder", "before", "state")
    rows = docs.join(by_range, ["source", "range"])
    more = F.sum("n_tokens").over(Window.partitionBy("source", "range").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    cut = rows.filter("state = 1").withColumn("more", F.col("before") + more).withColumn("extra", F.when(F.col("more") <= F.col("remainder"), 1).otherwise(0))
    cols = ["doc_id", "source", "n_tokens", (F.col("epochs") + F.col("extra")).cast("int").alias("repeats")]
    whole = rows.filter("state <> 1").withColumn("extra", F.when(F.col("state") == 2, 1).otherwise(0))
    return whole.select(*cols).union(cut.select(*cols)).filter("repeats > 0")


def mix_report(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1) -> DataFrame:
    """One row for each target source: its target and reached share, documents and tokens used, most repeats, and whether its target was in reach."""
    used = mix_sources(sized, targets, total_tokens, seed).groupBy("source").agg(
        F.count("*").alias("docs_used"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_used"), F.max("repeats").alias("most_repeats"))
    plan = plan_mix(sized, targets, total_tokens)
    out = plan.join(used, "source", "left").fillna(0, ["docs_used", "tokens_used", "most_repeats"])
    whole = F.sum("tokens_used").over(Window.partitionBy())  # one row for each source
    return out.select("source", "target_share", F.try_divide(F.col("tokens_used"), whole).alias("reached_share"), "docs", "tokens", "asked", "docs_used", "tokens_used", "max_repeats", "most_repeats", "reachable")

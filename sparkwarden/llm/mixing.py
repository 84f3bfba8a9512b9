"""Mixing sources to target weights by systematic sampling.

A source's target is shared out over its documents as expected copies; their running sum, plus one random
offset per source, crosses an integer once for each copy that is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import numbered, stored, sums_before, words

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Words wanted over words there, and how often a source's words may be used.
SHARE, MOST = 1.5, 2


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``target`` and ``rate`` (target over size) of every source: columns source, source_size, one row each.

    The wanted total goes to the sources by weight; none gets over ``most`` times its size, and what it
    can't take goes to the others by weight.  In order of ``most * size / weight`` the first sources are full, and
    the others share what is left: the level is that of the first source that isn't full.  Sources without
    words get 0.
    """
    ranked = numbered(sources, [], ["source_order", "source"], "_rank", "source-order")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    rows = stored(
        ranked.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight")),
        "source-weights",
    )
    sums = rows.agg(F.sum("source_size").alias("_all"), F.sum("weight").alias("_weights"))
    # Sums over equal ratios come first, so that the running sum below has one row per ratio only.
    ladder = rows.groupBy("ratio").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"))
    steps = sums_before(ladder, "ratio", ["cap", "weight"], "ladder").select("ratio", F.col("before_cap").alias("full"), F.col("before_weight").alias("gone")).crossJoin(F.broadcast(sums))
    level = steps.withColumn("level", (share * F.col("_all") - F.col("full")) / (F.col("_weights") - F.col("gone"))).where("level <= ratio")
    chosen = level.agg(F.min_by("level", "ratio").alias("level"))
    target = F.when(F.col("cap") <= F.col("level") * F.col("weight"), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return (
        rows.crossJoin(F.broadcast(chosen))
        .withColumn("target", F.coalesce(target, F.lit(0.0)))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .select("source", "source_size", "target", "rate")
    )


def offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) per source and seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\0null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def copies(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every document.

    Size is the number of words (null text: 0).  Documents of a source are taken in order of size, then doc_id:
    each draws from its neighbours in size, which keeps the words taken near the target.  A null source is a source
    like any other and comes last.  Equal rows are documents of their own; which of them gets
    the extra copy makes no difference.  Reruns agree.
    """
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_order", F.col("source").isNull())
    aimed = stored(targets(sources, weights, share, most), "targets")
    # Documents without a word take no words and need no place in the order.
    ranked = numbered(sized.where("size > 0"), ["source"], ["size", "doc_id"], "_rank", "ranked")
    empty = sized.where("size = 0").withColumn("_rank", F.lit(-1).cast("long"))
    rows = ranked.unionByName(empty)
    heads = rows.join(aimed, rows["source"].eqNullSafe(aimed["source"])).select(rows["*"], "source_size", "target", "rate")
    edge = lambda rank: F.floor(rank * F.col("_each") + F.col("_start"))
    taken = (
        heads.withColumn("_each", F.col("rate")).withColumn("_start", offset(F.col("source"), seed))
        .withColumn("copies", F.when(F.col("_rank") < 0, F.lit(0)).otherwise(edge(F.col("_rank") + 1) - edge(F.col("_rank"))).cast("long"))
    )
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns.

    A row's copies follow its doc_id, size and source; rows that repeat all three share out theirs evenly.
    """
    found = copies(docs, seed, weights, share, most).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    keyed = docs.withColumn("_size", word_count(F.col("text")))
    same = keyed["doc_id"].eqNullSafe(found["doc_id"]) & keyed["source"].eqNullSafe(found["source"]) & (keyed["_size"] == found["size"])
    rows = keyed.join(found, same).select(keyed["*"], "_sum", "_rows")
    once = rows.where("_rows = 1").withColumn("_copies", F.col("_sum"))
    place = F.row_number().over(Window.partitionBy("doc_id", "source", "_size").orderBy("text"))
    repeated = rows.where("_rows > 1").withColumn("_copies", F.floor(F.col("_sum") * place / F.col("_rows")) - F.floor(F.col("_sum") * (place - 1) / F.col("_rows")))
    all_rows = once.unionByName(repeated).where("_copies > 0")
    return all_rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies").cast("long")))).select(*docs.columns)

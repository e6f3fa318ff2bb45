"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

The corpus is cut into blocks of equal token counts. Blocks go to sources by highest quotient
``target / (2 * seats + 1)``; each source's blocks go to its shards by the same rule, which gives an
integer quota for every shard; inside a shard the quota is met by a seeded systematic selection of
blocks from a seeded order of the documents, so that every document's share has a closed form and
no block is ever materialised.

Highest quotients without listing all of them: with seats ``round(t / d)`` for one common divisor d
and S claimants, ``T / d`` lies within S/2 of the number of seats. That brackets every claimant's
seats, and only the seats inside the brackets (about S in all) compete by quotient.

Sources are numbered, filled and given seats by aggregations and distributed sorts, so their number is not
bounded by a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crossloom.operators.ordering import numbered

from .common import WORD, cut

#: Above so many distinct sources the per-source tables are joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 20_000
#: Shards over all sources together are at most so many plus one for each source.
MAX_SHARDS = 50_000


def _seats(claims: DataFrame, group: list[str], key: list[str], weight: str, total: Column, n: Column, size: Column) -> DataFrame:
    """Adds ``seats`` to claims: n seats go to a group's claimants by highest quotient, ties by key.

    total, n and size are the group's summed weight, seats to give, and number of claimants. A group's claimants
    (a source's shards, of which there is a bound) meet in a window; without groups a distributed sort ranks the seats."""
    w, half = F.col(weight).cast("double"), size / 2 + 1
    ratio = F.when(total > 0, w / total).otherwise(F.lit(0.0))
    low = F.greatest(F.floor(ratio * (n - half) + 0.5) - 1, F.lit(0)).cast("long")
    high = (F.ceil(ratio * (n + half) + 0.5) + 1).cast("long")
    base = claims.withColumns({"_n": n, "_low": F.when(w > 0, low).otherwise(F.lit(0).cast("long")), "_high": F.when(w > 0, high).otherwise(F.lit(0).cast("long"))})
    seat = F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1)))
    order = [(F.col(weight).cast("double") / (2 * F.col("_seat") + 1)).desc_nulls_last(), *(F.col(k) for k in key), F.col("_seat")]
    if group:
        part = W.partitionBy(*group)
        rows = base.withColumn("_left", F.col("_n") - F.sum("_low").over(part)).withColumn("_seat", seat).withColumn("_pos", F.row_number().over(part.orderBy(*order)) - 1)
    else:
        left = base.agg((F.max("_n") - F.sum("_low")).alias("left")).first()["left"] or 0
        rows = base.withColumn("_seat", seat)
        rows = numbered(rows, order, "_pos", size=rows.count()).withColumn("_left", F.lit(left))
    won = rows.withColumn("_won", (F.col("_seat").isNotNull() & (F.col("_pos") < F.col("_left"))).cast("long"))
    keys = [*group, *key]
    return won.groupBy(*keys).agg(*(F.first(c).alias(c) for c in claims.columns if c not in keys), (F.first("_low") + F.sum("_won")).alias("seats"))


def source_targets(sizes: DataFrame, passes: int = 3) -> DataFrame:
    """One row per source: its place by code point (null last), weight, size, the size of all, and target."""
    per = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-per-source", 8)
    n, total = per.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    per = numbered(per, [F.col("source").isNull(), F.col("source")], "_place", size=n).withColumn("_rank", F.col("_place") + 1).drop("_place")
    per = per.withColumns({"weight": F.col("_rank").cast("long") % 3, "_cap": F.col("source_size") * passes}).withColumn("weight", F.when(F.col("weight") == 0, F.lit(3).cast("long")).otherwise(F.col("weight")))
    per = cut(per, "mix-weights", 8)
    # Fill by weight: the level rises as full sources leave what is over to the others, until no more get full.
    full, level = F.lit(False), -1.0
    while True:
        capped, weights = per.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        rose = (total - (capped or 0)) / weights if weights else level
        if rose <= level:
            break
        level = rose
        full = F.col("_cap") / F.col("weight") <= level
    return per.withColumns({"_total": F.lit(total).cast("long"), "target": F.when(full, F.col("_cap").cast("double")).otherwise(F.col("weight") * F.lit(level))})


def source_blocks(sizes: DataFrame, block_tokens: int = 64, shard_tokens: int = 65_536, passes: int = 3) -> DataFrame:
    """source_targets with words of a block, number of shards, and blocks that the source gets."""
    per = source_targets(sizes, passes)
    n, total, least = per.agg(F.count(F.lit(1)), F.coalesce(F.max("_total"), F.lit(0)), F.min(F.when(F.col("source_size") > 0, F.col("source_size")))).first()
    block = max(1, min(block_tokens, (least or 0) // 100))
    per = per.withColumns({"block": F.lit(block).cast("long"), "shards": F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(max(float(shard_tokens), total / MAX_SHARDS)))).cast("long")})
    per = _seats(per, [], ["_rank"], "target", F.lit(total), F.lit(total // block), F.lit(n))
    return cut(per.select("source", "_rank", "weight", "source_size", "target", "block", "shards", F.col("seats").alias("source_blocks")), "mix-sources", 8)


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, block_tokens: int = 64, shard_tokens: int = 65_536, passes: int = 3) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    Weights are 1, 2, 3, repeating over the sources by code point (null last, as a source of its
    own); together they share as many words as there are; no source's target exceeds ``passes`` times
    its size, what is over is shared again. Blocks have ``block_tokens`` words, fewer where the
    smallest source has under 100 such blocks; a shard's last block may be shorter. A shard takes as many
    words as its blocks have, to less than a block: whole passes over it, then some of its blocks.

    Null text: size 0, nothing taken. A null doc_id is a document like others, dealt by its text. Repeated rows each
    count and are taken on their own. An empty table gives an empty result. Other columns of docs
    are not looked at.

    Returns doc_id, size, source_size, target, taken, source, weight.
    """
    spark = docs.sparkSession
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null-"), F.xxhash64(F.col(text)).cast("string")))))
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("_key"))
    sizes = cut(sizes, "mix-sizes")
    per = source_blocks(sizes, block_tokens, shard_tokens, passes)
    small = F.broadcast if per.count() <= BROADCAST_SOURCES else lambda df: df

    number = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    own = per.select(F.col("source").alias("_source"), "source_size", "target", "weight", "block", "shards", "source_blocks")
    rows = sizes.join(small(own), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("shard", number(F.col("_key"), 1) % F.col("shards"))

    quota = rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), *(F.first(c).alias(c) for c in ("block", "source_blocks", "source_size", "target")))
    quota = quota.withColumn("blocks", F.ceil(F.col("shard_size") / F.col("block")))
    by = W.partitionBy("source")
    quota = quota.withColumns({"_all": F.sum("blocks").over(by), "_shards": F.count(F.lit(1)).over(by)})
    most = F.col("_all") * passes
    give = F.when(F.col("target") >= F.col("source_size") * passes, most).otherwise(F.least(F.col("source_blocks"), most))
    quota = _seats(quota, ["source"], ["shard"], "blocks", F.col("_all"), give, F.col("_shards"))
    start = number(F.md5(F.concat_ws(":", F.lit(f"{seed}-start"), F.coalesce(F.col("source"), F.lit("")), F.col("shard").cast("string"))), 1) % F.greatest(F.col("blocks"), F.lit(1))
    quota = quota.withColumn("_words", F.least(F.col("seats") * F.col("block"), F.col("shard_size") * passes))
    quota = quota.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "blocks", F.expr("_words div greatest(shard_size, 1)").alias("full_passes"), F.expr("_words % greatest(shard_size, 1) div block").alias("picked"), start.alias("start"))
    # One row per shard: at most MAX_SHARDS plus one per source, so what small() decides holds here too.
    rows = rows.join(small(cut(quota, "mix-quotas", 8)), F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    line = W.partitionBy("source", "shard").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_end", F.sum("size").over(line)).withColumn("_begin", F.col("_end") - F.col("size"))

    def picked_before(at: str) -> Column:
        """Words of picked blocks among the shard's first `at` words; block j is picked where
        (j * picked + start) div blocks steps up."""
        return F.expr(f"""
            CASE WHEN picked = 0 THEN 0L
                 WHEN {at} >= blocks * block THEN picked * block
                 ELSE ((({at} div block) * picked + start) div blocks) * block
                      + CASE WHEN ((({at} div block) + 1) * picked + start) div blocks > (({at} div block) * picked + start) div blocks THEN {at} % block ELSE 0L END
            END""")

    taken = F.col("full_passes") * F.col("size") + picked_before("_end") - picked_before("_begin")
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "weight")

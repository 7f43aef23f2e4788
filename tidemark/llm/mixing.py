"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sizes are words.  Sources, by code point with null last, weigh 5, 2, 1 in turn and
share ``share`` of all words; a target stops at ``most`` times its source's size and
what it leaves goes to the others by weight until no target is above.

The documents of a source are dealt to shards of bounded size by a seeded hash; in a
shard they lie end to end in seeded order and are cut into blocks of ``block`` words.
Blocks are seats: the sources share them by highest quotients w / (2j - 1), and so do
the shards of a source, which gives each shard an integer quota.  The words by which a
source's seats miss its target are added to, or taken from, its largest shard.  A
shard takes whole passes of itself and the rest from its blocks in seeded order, the
last one in part.

The quotients are not listed from the first seat on: at a common divisor that is
surely too large every party's seats are known at once, and only the few seats that
are left are ranked.  All of it is DataFrame functions; windows are over sources, over
the shards of a source, or over the rows of a shard.

Defined results: a null text has size 0, and takes 0.  A null source is a source.
Repeated rows are documents of their own.  Reruns agree: everything depends on ids,
sizes and the seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD_PATTERN, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 64
SHARD_WORDS = 1 << 19
SEED = 17


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with weight and target."""
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("_cap", F.col("source_size") * most)
    # sources fill up in the order of cap / weight; those before the first that has room are full
    fill = W.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(share)
    room = total - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    still = F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = weighed.withColumn("_level", room / still).withColumn("_full", F.col("_cap") / F.col("weight") <= F.col("_level"))
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(W.partitionBy())
    target = F.when(F.col("_full") | level.isNull(), F.col("_cap").cast("double")).otherwise(F.col("weight") * level)
    return ranked.withColumn("target", target).drop("_cap", "_level", "_full")


def apportion(parties: DataFrame, party: list[str], weight: str, seats: str, group: list[str]) -> DataFrame:
    """``parties`` with the Sainte-Lague seats of each, in a column ``quota``.

    The parties of a ``group`` share its ``seats`` (the same on all its rows); ties go
    to the party that comes first by ``party``.
    """
    g = W.partitionBy(*group)
    w, n = F.col(weight).cast("double"), F.col(seats)
    some = F.sum(w).over(g)
    count = F.count("*").over(g)
    at = lambda x: F.greatest(F.ceil(w * x - F.lit(0.5)), F.lit(0)).cast("long")  # noqa: E731  seats with quotients above 1 / (2x)
    known = parties.withColumn("_w", w).withColumn("_sum", some).withColumn("_few", count)
    low = F.greatest((n - F.col("_few") / 2 - 1) / F.col("_sum"), F.lit(0.0))
    high = (n + F.col("_few") / 2 + 1) / F.col("_sum")
    w = F.col("_w")
    known = known.withColumn("_from", F.when(F.col("_sum") > 0, at(low)).otherwise(F.lit(0))).withColumn("_to", F.when((F.col("_sum") > 0) & (w > 0), at(high)).otherwise(F.lit(0)))
    known = known.withColumn("_open", n - F.sum("_from").over(g))
    seat = known.where("_to > _from").select(*dict.fromkeys([*party, *group]), "_w", "_open", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("_j"))
    order = W.partitionBy(*group).orderBy((F.col("_w") / (2 * F.col("_j") - 1)).desc(), *(F.col(c).asc_nulls_last() for c in party))
    won = seat.withColumn("_rank", F.row_number().over(order)).where("_rank <= _open").groupBy(*party).agg(F.count("*").alias("_won"))
    same = None
    renamed = won.select(*(F.col(c).alias(f"_p{i}") for i, c in enumerate(party)), "_won")
    for i, c in enumerate(party):
        cond = F.col(c).eqNullSafe(F.col(f"_p{i}"))
        same = cond if same is None else same & cond
    out = known.join(renamed, same, "left").withColumn("quota", F.col("_from") + F.coalesce("_won", F.lit(0)))
    return out.drop("_w", "_sum", "_few", "_from", "_to", "_open", "_won", *(f"_p{i}" for i in range(len(party))))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken) of every document."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    sources = sources.withColumn("_blocks", F.round(F.sum("target").over(W.partitionBy()) / block).cast("long")).withColumn("_one", F.lit(1))
    sources = apportion(sources, ["source"], "target", "_blocks", ["_one"]).withColumnRenamed("quota", "seats")
    sources = written(sources.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long")).select(F.col("source").alias("_source"), "source_size", "target", "seats", "shards"))

    draw = F.xxhash64(F.lit(seed), F.col("id"), F.col("size"))
    dealt = sized.where("size > 0").join(sources, F.col("source").eqNullSafe(F.col("_source"))).select("id", "source", "size", "seats", "target", "shards", draw.alias("draw"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), F.col("shards")))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats"), F.first("target").alias("target"))
    shards = apportion(shards, ["source", "shard"], "words", "seats", ["source"])
    biggest = F.row_number().over(W.partitionBy("source").orderBy(F.desc("words"), "shard"))
    left = F.round("target").cast("long") - F.col("seats") * block
    shards = shards.withColumn("quota", F.col("quota") * block + F.when(biggest == 1, left).otherwise(0))
    # a quota that its shard cannot hold is cut there, and the words go to the shards that have room
    cap = F.col("words") * most
    shards = shards.withColumn("_over", F.greatest(F.col("quota") - cap, F.lit(0)) + F.least(F.col("quota"), F.lit(0)))
    shards = shards.withColumn("quota", F.least(F.greatest("quota", F.lit(0)), cap))
    spare = F.when(F.sum("_over").over(W.partitionBy("source")) >= 0, cap - F.col("quota")).otherwise(-F.col("quota"))
    shards = shards.withColumn("_spare", spare)
    want = F.sum("_over").over(W.partitionBy("source"))
    run = F.coalesce(F.sum("_spare").over(W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    give = F.when(want >= 0, F.greatest(F.least(want - run, F.col("_spare")), F.lit(0))).otherwise(F.least(F.greatest(want - run, F.col("_spare")), F.lit(0)))
    shards = shards.withColumn("quota", F.col("quota") + give)
    shards = written(shards.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "words", F.floor(F.col("quota") / F.col("words")).alias("passes"), (F.col("quota") % F.col("words")).alias("rest")))

    lie = W.partitionBy("source", "shard").orderBy("draw", "id", "size")
    placed = dealt.select("id", "source", "shard", "size", (F.sum("size").over(lie) - F.col("size")).alias("begin"), F.row_number().over(lie).alias("n"))
    placed = placed.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard"))).drop("_source", "_shard")
    parts = placed.select("*", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))).alias("block"))
    # blocks by seeded order within a shard, and how many words of each are taken
    blocks = shards.select("_source", "_shard", "words", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / block))).alias("_block")).where("rest > 0")
    blocks = blocks.withColumn("len", F.least(F.lit(block).cast("long"), F.col("words") - F.col("_block") * block))
    pick = W.partitionBy("_source", "_shard").orderBy(F.xxhash64(F.lit(seed + 2), "_source", "_shard", "_block"), "_block")
    blocks = blocks.withColumn("got", F.greatest(F.least(F.col("rest") - (F.sum("len").over(pick) - F.col("len")), F.col("len")), F.lit(0))).where("got > 0")
    met = parts.join(blocks.select("_source", "_shard", "_block", "got").hint("merge"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")) & (F.col("block") == F.col("_block")), "left")
    inside = F.greatest(F.least(F.col("begin") + F.col("size"), F.col("block") * block + F.col("got")) - F.greatest(F.col("begin"), F.col("block") * block), F.lit(0))
    taken = met.groupBy("source", "shard", "n").agg(F.first("id").alias("id"), F.first("size").alias("size"), F.first("passes").alias("passes"), F.coalesce(F.sum(F.when(F.col("got").isNotNull(), inside)), F.lit(0)).alias("part"))
    some = taken.select("id", "source", "size", (F.col("passes") * F.col("size") + F.col("part")).cast("long").alias("taken"))
    every = some.unionByName(sized.where("size = 0").select("id", "source", "size", F.lit(0).cast("long").alias("taken")))
    return every.join(sources, F.col("source").eqNullSafe(F.col("_source"))).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")

"""Temperature mixing of sources to target weights.

Weights are source token shares to the power of ``alpha``, normalised. ``alpha`` is found
by bisection, so that either the entropy of the weights meets a target, or no source is
repeated more often than a limit when the budget is spent. The weights are realised as
block permutations: the documents of a source are dealt into blocks by hash, every pass
over the source (epoch) visits the blocks in a new order and the documents of a block in a
new order, and the source's budget cuts the last epoch by blocks first, then within one
block. Positions of all sources interleave in proportion.

Sources may be as many as sites: their figures are a table, and what bisection needs of
them are sums, for several exponents in one aggregation. Blocks find their places in two
steps, by ranges of their order and within a range, and documents by windows over blocks;
so no task meets all blocks or all documents of a source. Rows alike in id and text share a
block, and are sorted in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from rotagraph.llm.shared import packed, unpacked
from rotagraph.session import written

#: Tokens of a source that one block holds, on average.
BLOCK_TOKENS = 1 << 18
#: Ranges of a source's order of blocks, as binary digits.
RANGES = 10
#: Figures of sources are broadcast up to so many; beyond, Spark shuffles.
BROADCAST_SOURCES = 10_000
#: Exponents that one aggregation tries, and narrowings: together every digit of a double.
TRIED, PASSES = 15, 13


@dataclass
class Mixture:
    """alpha, the tokens to give, and (source, tokens, weight, quota) of every source."""

    alpha: float
    budget: float
    sources: DataFrame


def bisect(f, low: float, high: float) -> float:
    """Where ``f`` turns from true to false between ``low`` (true) and ``high``; the true
    side. ``f`` judges TRIED ascending points at once."""
    if f([high])[0]:
        return high
    for _ in range(PASSES):
        points = [low + (high - low) * k / (TRIED + 1) for k in range(1, TRIED + 1)]
        k = sum(f(points))
        low, high = [low, *points][k], [*points, high][k]
    return low


def solve(sums: DataFrame, budget: int | None = None, target_entropy: float | None = None, most_repeats: float | None = None) -> Mixture:
    """Finds alpha in 0 (equal weights) to 1 (shares as they are) for ``sums`` (source, n).

    ``target_entropy`` (bits): the largest alpha whose weights have at least that entropy,
    0 where none has. ``most_repeats``: the smallest alpha at which no source gives more
    than so many times its tokens, 1 where none does. With both, the larger alpha, so the
    limit holds. ``budget``: tokens to give; None: just enough that every source is given
    once in full at least, so no document is lost. Quotas are whole tokens; sources without
    tokens have none.
    """
    if budget is not None and budget < 0:
        raise ValueError("the budget is negative")
    live = sums.where("n > 0")
    total, most, least = live.agg(F.sum("n"), F.max("n"), F.min("n")).first()
    if not total:
        return Mixture(1.0, 0.0, sums.select("source", F.col("n").alias("tokens"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota")))
    share = F.col("n") / F.lit(float(total))

    def moments(alphas: list[float]) -> list[tuple[float, float]]:
        """For each alpha the sum of powers of shares, and of these times the logarithm of the share."""
        got = live.agg(*[x for a in alphas for x in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.ln(share)))]).first()
        return list(zip(got[::2], got[1::2], strict=True))

    def mixed_enough(alphas: list[float]) -> list[bool]:
        return [math.log(z) - a * x / z >= target_entropy * math.log(2) for a, (z, x) in zip(alphas, moments(alphas), strict=True)]

    def repeated_little(tempering: list[float]) -> list[bool]:
        """The smallest source is the one most repeated."""
        alphas = [1 - t for t in tempering]
        if budget is None:
            times = [(most / least) ** (1 - a) for a in alphas]
        else:
            times = [budget * (least / total) ** (a - 1) / (z * total) for a, (z, _) in zip(alphas, moments(alphas), strict=True)]
        return [t <= most_repeats * (1 + 1e-12) for t in times]

    alpha = 1.0
    if target_entropy is not None:
        alpha = bisect(mixed_enough, 0.0, 1.0) if mixed_enough([0.0])[0] else 0.0
    if most_repeats is not None:
        enough = 1 - bisect(repeated_little, 0.0, 1.0) if repeated_little([0.0])[0] else 1.0
        alpha = max(alpha, enough) if target_entropy is not None else enough
    z = moments([alpha])[0][0]
    spent = z * (most / total) ** (1 - alpha) * total if budget is None else float(budget)
    weight = F.when(F.col("n") > 0, F.pow(share, F.lit(alpha)) / F.lit(z)).otherwise(0.0)
    # a quota that is a whole number of epochs but for rounding is that number of epochs
    own = F.lit(spent) * F.col("weight")
    epochs = F.round(own / F.col("tokens")).cast("long")
    whole = F.abs(own - epochs * F.col("tokens")) < 1e-6 * F.col("tokens")
    quota = F.when(F.col("tokens") <= 0, F.lit(0)).when(whole, epochs * F.col("tokens")).otherwise(F.floor(own))
    return Mixture(alpha, spent, sums.select("source", F.col("n").alias("tokens"), weight.alias("weight")).withColumn("quota", quota.cast("long")))


def _count(text):
    """Tokens of a text: its runs of visible characters, at least 1, so that every document has a place."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def _mix(*parts):
    """A hash in 0 to 2**62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 2)


def mix(docs: DataFrame, budget: int | None = None, target_entropy: float | None = None, most_repeats: float | None = None, seed: int = 0, id_col: str = "doc_id", source: str = "source", text: str = "text", tokens=None) -> tuple[Mixture, DataFrame]:
    """The mixture, and (id, text_hash, source, n_tokens, epoch, position) of every document
    given: ``position`` in 0 to 1 is its place in the mixed order, ``epoch`` counts from 0.

    Tokens are runs of visible characters (or the column expression ``tokens``), at least
    1 a document. A document is given if its first token lies within the source's quota.
    A null source is a source; repeated rows are documents of their own; null ids take
    part. An empty table gives no rows. Order within a block is by hash of seed, epoch, id
    and text, then id: rows equal in both share no order, and are alike.
    """
    own = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.xxhash64(text)).cast("long").alias("text_hash"),
        F.col(source).alias("source"),
        (_count(F.col(text)) if tokens is None else F.greatest(tokens, F.lit(1)).cast("long")).alias("n_tokens"),
    )
    own = written(own, "mix-documents")
    mixture = solve(written(own.groupBy("source").agg(F.sum("n_tokens").alias("n")), "mix-sources"), budget, target_entropy, most_repeats)
    at_least_one = lambda x: F.greatest(x, F.lit(1)).cast("long")
    plan = mixture.sources.select(
        F.col("source").alias("p_source"), "quota", F.col("tokens").alias("source_tokens"),
        at_least_one(F.floor(F.col("tokens") / BLOCK_TOKENS)).alias("blocks"), at_least_one(F.ceil(F.col("quota") / F.col("tokens"))).alias("epochs"),
    )
    if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    with_block = own.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("block", _mix(F.lit(seed), "id", "text_hash") % F.col("blocks"))
    sizes = written(with_block.groupBy("source", "block", "quota", "source_tokens", "epochs").agg(F.sum("n_tokens").alias("block_tokens")), "mix-block-sizes")
    every = sizes.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1))).withColumn("order", _mix(F.lit(seed), "epoch", "block"))
    every = every.withColumn("range", F.shiftright("order", 62 - RANGES))
    before = lambda column, *order: F.coalesce(F.sum(column).over(Window.partitionBy(*order[0]).orderBy(*order[1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = every.groupBy("source", "epoch", "range").agg(F.sum("block_tokens").alias("range_tokens"))
    ranges = ranges.select(F.col("source").alias("r_source"), F.col("epoch").alias("r_epoch"), F.col("range").alias("r_range"), before("range_tokens", ["source", "epoch"], ["range"]).alias("range_start"))
    inner = every.withColumn("inner_start", before("block_tokens", ["source", "epoch", "range"], ["order", "block"]))
    same = F.col("source").eqNullSafe(F.col("r_source")) & (F.col("epoch") == F.col("r_epoch")) & (F.col("range") == F.col("r_range"))
    start = F.col("epoch") * F.col("source_tokens") + F.col("range_start") + F.col("inner_start")
    placed = inner.join(ranges, same).withColumn("block_start", start).where("block_start < quota").select("source", "block", "epoch", "block_start", "block_tokens", "quota")
    placed = written(placed, "mix-blocks")
    both = with_block.select("id", "text_hash", "source", "n_tokens", "block").join(
        placed.withColumnRenamed("source", "b_source").withColumnRenamed("block", "b_block"),
        F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")),
    )
    inside = Window.partitionBy("source", "block", "epoch").orderBy(_mix(F.lit(seed), "epoch", "id", "text_hash"), "id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("block_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    given = both.withColumn("at", at).where("at < quota")
    position = (F.col("at") + 0.5) / F.col("quota")
    return mixture, given.select("id", "text_hash", "source", "n_tokens", F.col("epoch").cast("int").alias("epoch"), position.alias("position"))


def mixed_documents(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture gives it; same columns.

    Rows alike in id and text are told apart by number only, so such rows are given, taken
    together, as often as all of them are."""
    _, given = mix(docs, seed=seed, id_col=id_col, text=text, **how)
    times = given.groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("source").alias("_source")).agg(F.count("*").alias("_given"))
    own_source = F.col(how.get("source", "source"))
    mine = packed(docs, _own_id=F.col(id_col).cast("long"), _own_hash=F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.xxhash64(text)).cast("long"), _own_source=own_source)
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash")) & F.col("_own_source").eqNullSafe(F.col("_source"))
    joined = mine.join(times, same)
    # of k alike rows given g times in all, the j-th is given g // k times, and once more while j <= g mod k
    alike = Window.partitionBy("_own_hash", "_id", "_source")
    nth = joined.withColumns({"_k": F.count("*").over(alike), "_j": F.row_number().over(alike.orderBy("_own_hash"))})
    times_own = F.expr("_given div _k") + F.when(F.col("_j") <= F.col("_given") % F.col("_k"), 1).otherwise(0)
    repeated = nth.withColumn("_copies", times_own.cast("int")).where("_copies > 0")
    return unpacked(repeated.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))), docs.columns)

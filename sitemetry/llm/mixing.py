"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Every document draws how often it occurs in the mix from a Poisson distribution whose
mean is the repetition rate its source needs: ``rate = weight * target_rows / rows``.
The draw inverts the distribution at a number in [0, 1) hashed from the seed and the
document, so a rerun, or a task repeated after a lost executor, gives the same mix.
A row's fate needs nothing but its source's rate: a source with a third of all rows is
spread over as many tasks as any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut_lineage

#: Means above this are drawn as a sum of several independent draws, since e^-mean underflows.
MEAN_PER_DRAW = 8.0
#: Terms of the cumulative sum in one draw. P(X > 64) for a mean of 8 is under 1e-30,
#: far below the 2^-52 steps of the hashed numbers, so no draw can reach the end.
TERMS = 64
#: Hex digits of the hash that make a number in [0, 1).
DIGITS = 13
#: Rates are broadcast up to this many bytes, and spread over so many keys a source beyond it.
BROADCAST_BYTES, SALTS = 16_000_000, 64


def hashed_unit(*parts: Column) -> Column:
    """A number in [0, 1) fixed by the parts: the first 52 bits of their MD5."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def poisson_at(unit: Column, mean: Column) -> Column:
    """The Poisson quantile: how many cumulative probabilities are at or below ``unit``."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.when(unit < acc["cdf"], acc).otherwise(
            F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), (acc["n"] + 1).alias("n"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["n"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, target_rows: int | None = None) -> DataFrame:
    """Rows, weight and repetition rate of each source.

    ``weights`` are relative; sources it leaves out get none. Without weights every source
    gets the same share. ``target_rows`` is the expected length of the mix, by default the
    number of input rows. A null source counts as the source ``''``.
    """
    counts = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("mix_source")).agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        weighed = counts.withColumn("raw_weight", F.lit(1.0))
    else:
        pairs = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in sorted(weights.items())], "mix_source string, raw_weight double")
        weighed = counts.join(pairs, "mix_source")
    total = weighed.agg(F.sum("raw_weight").alias("weight_sum"), F.sum("n_rows").alias("row_sum"))
    rows = F.lit(float(target_rows)) if target_rows is not None else F.col("row_sum").cast("double")
    return weighed.join(F.broadcast(total)).select(  # one row
        "mix_source",
        "n_rows",
        (F.col("raw_weight") / F.col("weight_sum")).alias("weight"),
        (F.col("raw_weight") / F.col("weight_sum") * rows / F.col("n_rows")).alias("rate"),
    )


def join_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``rows`` with their source's ``__rate``.

    The rates are measured first. Up to BROADCAST_BYTES they are sent to every task, and the
    texts aren't shuffled for them. Beyond that both sides are salted: a source's rate is copied
    to SALTS keys over which its rows are spread.
    """
    rates = cut_lineage(rates)
    size = rates.agg(F.sum(F.length("__source") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(rates), "__source")
    salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("__doc"), F.lit(SALTS)).cast("int")).join(salted, ["__source", "__salt"]).drop("__salt")


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, target_rows: int | None = None, seed: int = 0) -> DataFrame:
    """All columns of ``docs`` with ``mix_copy`` (from 1) and ``mix_order`` (place in the shuffle).

    Rows are dealt to partitions by ``mix_order``, a hash of seed, document and copy, and
    sorted by it inside each: a global shuffle of the replicated corpus.

    Defined cases: a null text or language changes nothing; a row of null doc_id is told apart by
    its text; rows with the same doc_id draw the same count; an empty table gives an empty mix; columns
    of ``docs`` named ``mix_*`` other than the two results are kept.
    """
    content = F.col("text").cast("string") if "text" in docs.columns else F.lit("")
    source, doc = F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(content, F.lit(""))))
    kept = [c for c in docs.columns if c not in ("mix_copy", "mix_order")]
    inner = {c: f"__row_{i}" for i, c in enumerate(kept)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in inner.items()], source.alias("__source"), doc.alias("__doc"))
    rates = source_rates(docs, weights, target_rows).select(F.col("mix_source").alias("__source"), F.col("rate").alias("__rate"))
    draws = F.greatest(F.lit(1), F.ceil(F.col("__rate") / F.lit(MEAN_PER_DRAW))).cast("int")
    rated = join_rates(rows, rates).withColumn("__draws", draws)
    count = F.aggregate(
        F.transform(
            F.sequence(F.lit(1), F.col("__draws")),
            lambda k: poisson_at(hashed_unit(F.lit(str(seed)), F.col("__doc"), k.cast("string")), F.col("__rate") / F.col("__draws")),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    copies = rated.withColumn("__count", count).where("__count > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("__count"))))
    order = hashed_unit(F.lit(f"order{seed}"), F.col("__doc"), F.col("mix_copy").cast("string"))
    mixed = copies.select(*[F.col(n).alias(c) for c, n in inner.items()], "mix_copy", order.alias("mix_order"))
    return mixed.repartition(F.col("mix_order")).sortWithinPartitions("mix_order", "doc_id", "mix_copy")

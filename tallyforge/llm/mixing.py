"""Mixing sources to target weights by Poisson replication (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import free_name, materialise

SEED = "mix-1"
BROADCAST_SOURCES = 10_000
#: A larger rate is drawn as the sum of equal parts of at most this rate, each from a number of its own.
PART_RATE = 32.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts; null counts as empty text."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def repetition_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, source: str = "source") -> DataFrame:
    """(source, n_rows, rate): the mean number of copies that brings each source to its target weight.

    Without ``weights`` a source's weight is its number of rows to ``power``. Weights are
    normalised over the sources present; the mean total stays the number of rows. Null is a
    source of its own. A source without a weight gets rate 0.
    """
    counts = materialise(docs.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).alias("n_rows")), "sources")
    if weights is None:
        weighed = counts.withColumn("_w", F.pow(F.col("n_rows").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_name string, _w double")
        weighed = counts.join(given, F.col("_source").eqNullSafe(F.col("_name")), "left").withColumn("_w", F.coalesce("_w", F.lit(0.0))).drop("_name")
    total = weighed.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("_w"), F.lit(0.0)).alias("weight")).first()
    rate = F.try_divide(F.col("_w") * F.lit(total["rows"]), F.lit(total["weight"]) * F.col("n_rows"))
    return weighed.select("_source", "n_rows", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """Cumulative Poisson probabilities for 0, 1, 2, ... up to where doubles reach 1.

    Terms are built as logarithms, so large rates don't underflow.
    """
    last = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(30.0)).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("steps"))

    def step(s: Column, k: Column) -> Column:
        log_p = s["log_p"] + F.ln(rate / k.cast("double"))
        total = s["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(s["steps"], F.array(total)).alias("steps"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["steps"])).otherwise(F.array(F.lit(1.0)))


def poisson_draw(rate: Column, seed: str, key: Column) -> Column:
    """The Poisson quantile, at ``rate``, of numbers hashed from seed and key: work grows with the rate, as the copies do."""
    return _summed_draws(poisson_steps(rate / draw_parts(rate)), draw_parts(rate), seed, key)


def draw_parts(rate: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rate / F.lit(PART_RATE)).cast("int"))


def _summed_draws(steps: Column, parts: Column, seed: str, key: Column) -> Column:
    def drawn(so_far: Column, part: Column) -> Column:
        u = F.when(part == 0, uniform(F.lit(seed), key)).otherwise(uniform(F.lit(seed), key, part))
        return so_far + F.size(F.filter(steps, lambda c: c <= u))

    return F.aggregate(F.sequence(F.lit(0), parts - F.lit(1)), F.lit(0), drawn)


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, seed: str = SEED) -> DataFrame:
    """Each document as often as its draw says, in a global random order.

    A document's count is the Poisson quantile, at its source's rate, of a number hashed
    from (seed, doc_id), or the sum of such quantiles of equal parts of a large rate: equal ids draw
    equal counts, on any number of executors. Added are
    ``copy`` (int, from 0) and ``shuffle_key`` (MD5 of seed, doc_id and copy): rows are dealt
    by the key and sorted by it within partitions, which reads as one random order. The rates,
    one row per source, are broadcast if there are at most BROADCAST_SOURCES, else joined by
    a shuffle whose hot sources AQE splits. Null text stays; an empty table gives an empty one; repeated rows are
    drawn alike. Columns named copy or shuffle_key are replaced; those of any other name stay.
    """
    docs = docs.drop("copy", "shuffle_key")
    of, steps, parts, n = (free_name(docs, c) for c in ("_source", "_steps", "_parts", "_n"))
    rates = repetition_rates(docs, weights, power).select(F.col("_source").alias(of), "rate")
    found = rates.limit(BROADCAST_SOURCES + 1).collect()
    if len(found) <= BROADCAST_SOURCES:
        rates = F.broadcast(docs.sparkSession.createDataFrame(found, rates.schema))
    share = draw_parts(F.col("rate"))
    drawn = docs.join(rates.select(of, poisson_steps(F.col("rate") / share).alias(steps), share.alias(parts)), F.col("source").eqNullSafe(F.col(of)))
    drawn = drawn.withColumn(n, _summed_draws(F.col(steps), F.col(parts), seed, F.col("doc_id"))).drop(of, steps, parts)
    copies = drawn.where(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(n) - F.lit(1)))).drop(n)
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")

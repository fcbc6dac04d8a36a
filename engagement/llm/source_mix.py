"""Mixing sources to target weights by Poisson replication.

A document of a source that is to be repeated r times on average gets a Poisson number of
copies with mean r: its doc_id, hashed with the seed to a number u in [0, 1), is inverted
in the cumulative distribution of its source. The copies are dealt out at random.
"""

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .ship import ship

#: Hexadecimal digits of an MD5 digest that make one number, and its range.
DIGITS, RANGE = 13, float(1 << 52)


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the MD5 digest of seed and keys; null is a key like others."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long") / F.lit(RANGE)


def poisson_steps(mean: float) -> tuple[int, list[float]]:
    """(first, steps): a Poisson number is first + how many steps are <= u.

    Only what lies within ten deviations of the mean is listed: the rest is beyond the
    resolution of u.
    """
    if not mean > 0:
        return 0, [1.0]
    reach = 10 * math.sqrt(mean) + 40
    first, last = max(0, int(mean - reach)), int(mean + reach)
    steps, total = [], 0.0
    for k in range(first, last + 1):
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        steps.append(min(total, 1.0))
    steps[-1] = 1.0
    return first, steps


def _steps(batches):
    for batch in batches:
        found = [poisson_steps(mean) for mean in batch.column("rate").to_pylist()]
        columns = [batch.column(c) for c in ("source", "rate")]
        columns += [pa.array([f for f, _ in found], pa.int32()), pa.array([s for _, s in found], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["source", "rate", "first", "steps"])


def repetition_rates(docs: DataFrame, targets: dict[str, float] | None, exponent: float, epochs: float) -> DataFrame:
    """source, rate: how often a document of each source is repeated on average.

    The mass of a source is its bytes of text. The mix has ``epochs`` times the mass of
    all sources, shared out by the weights in ``targets`` (unlisted sources get none), or
    else by mass ** ``exponent``. A source without mass is not repeated.
    """
    mass = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("mass"))
    if targets is None:
        weight = F.pow(F.col("mass").cast("double"), F.lit(exponent))
    else:
        weight = F.lit(0.0)
        for source, value in targets.items():
            weight = F.when(F.col("source") == source, F.lit(float(value))).otherwise(weight)
    mass = stored(mass.withColumn("weight", F.when(F.col("mass") > 0, weight).otherwise(0.0)))
    total = mass.agg(F.sum("mass").alias("mass"), F.sum("weight").alias("weight")).first()
    share = F.col("weight") / F.lit(float(total["weight"] or 1.0))
    rate = share * F.lit(epochs * float(total["mass"] or 0)) / F.col("mass")
    return mass.select("source", F.when(F.col("weight") > 0, rate).otherwise(0.0).alias("rate"))


def mix_sources(
    docs: DataFrame, targets: dict[str, float] | None = None, exponent: float = 0.7, epochs: float = 1.0, seed: int = 0
) -> DataFrame:
    """The copies of the rows of ``docs`` (doc_id, source, text, ...), with ``copy`` 0, 1, ...

    All columns are kept, and a column of the input named copy gives way. A null source is
    a source of its own; null texts weigh nothing but are repeated at their source's rate.
    Rows with the same doc_id get the same number of copies in one source. An empty table
    gives an empty result. Copies come in an order that depends on the seed only within a
    partition; partitions are filled at random.

    The rates lie in a table of one row for each source. Spark broadcasts it if its own
    size limit allows, and else splits hot sources when it joins.
    """
    ship(docs.sparkSession)
    docs = docs.drop("copy")
    rates = repetition_rates(docs, targets, exponent, epochs)
    rates = stored(rates.mapInArrow(_steps, "source string, rate double, first int, steps array<double>"))
    rates = rates.where("rate > 0").withColumnRenamed("source", "mix__source").withColumnsRenamed(
        {"rate": "mix__rate", "first": "mix__first", "steps": "mix__steps"}
    )
    drawn = docs.join(rates, docs["source"].eqNullSafe(rates["mix__source"]))
    drawn = drawn.withColumn("mix__u", uniform(seed, F.col("doc_id")))
    below = F.size(F.filter("mix__steps", lambda step: step <= F.col("mix__u")))
    drawn = drawn.withColumn("mix__n", F.col("mix__first") + below).where("mix__n > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("mix__n") - 1)))
    dealt = copies.select(*docs.columns, "copy", F.xxhash64(F.lit(seed), "doc_id", "text", "copy").alias("mix__order"))
    return dealt.repartition("mix__order").sortWithinPartitions("mix__order").drop("mix__order")


def mix_sql(exponent: float = 0.7, seed: int = 0) -> str:
    """DuckDB SQL for the rows of ``mix_sources`` over the documents."""
    return f"""
    with mass as (select source, sum(coalesce(strlen(text), 0)) as m from documents group by source),
    rate as (
        select source, power(m::double, {exponent}) / (select sum(power(m::double, {exponent})) from mass where m > 0)
            * (select sum(m) from mass) / m as r
        from mass where m > 0
    ),
    steps as (
        select source, k, sum(exp(k * ln(r) - r - lgamma(k + 1))) over (partition by source order by k) as p
        from rate, unnest(range(0, (r + 10 * sqrt(r) + 41)::bigint)) as t(k)
    ),
    drawn as (
        select doc_id, text, lang, source, n_chars,
            ('0x' || substr(md5('{seed}|' || coalesce(doc_id::varchar, 'null')), 1, {DIGITS}))::bigint / {RANGE} as u
        from documents
    )
    select d.doc_id, d.text, d.lang, d.source, d.n_chars, s.k::int as copy
    from drawn d join steps s on d.source is not distinct from s.source and s.p <= d.u
    """

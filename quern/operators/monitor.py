"""Operational analytics over logs of events: time buckets, trends without gaps, rates, shares, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket(at: str, size: str, zone: str | None = None) -> Column:
    """The start of the bucket: `5 minutes` and the like on a fixed grid, or hour, day, week, month of a time zone, told in UTC."""
    if " " in size:
        return F.window(F.col(at).cast("timestamp"), size)["start"].cast("timestamp_ntz")
    if zone is None:
        return F.date_trunc(size, at).cast("timestamp_ntz")
    local = F.date_trunc(size, F.from_utc_timestamp(F.col(at).cast("timestamp"), zone))
    return F.to_utc_timestamp(local, zone).cast("timestamp_ntz")


def rate(good: Column, bad: Column) -> Column:
    """Share of good in good and bad, null without any."""
    total = good + bad
    return good.cast("double") / F.when(total != 0, total)


def summary(log: DataFrame, by: list[str], success: Column, failure: Column, value: str) -> DataFrame:
    """Number, successes, failures, success rate and mean value, by columns."""
    good, bad = F.count_if(success), F.count_if(failure)
    return log.groupBy(*by).agg(F.count("*").alias("total"), good.alias("succeeded"), bad.alias("failed"), F.round(rate(good, bad), 6).alias("success_rate"), F.round(F.avg(value), 4).alias("mean_value"))


def trend(log: DataFrame, at: str, size: str, by: list[str], value: str, zone: str | None = None) -> DataFrame:
    return log.groupBy(bucket(at, size, zone).alias("bucket"), *by).agg(F.count("*").alias("total"), F.round(F.sum(value), 2).alias("sum_value"))


def filled(series: DataFrame, step: str, by: list[str], fill: dict[str, float]) -> DataFrame:
    """The series (bucket, by..., values) with a row for every step between its first and last bucket and every key it has.

    The grid is made per key from the two bounds, so it grows with keys times steps, like the result.
    """
    ends = series.agg(F.min("bucket").alias("_first"), F.max("bucket").alias("_last"))
    steps = ends.select(F.explode(F.expr(f"sequence(_first, _last, interval {step})")).alias("bucket"))
    keys = series.select(*by).distinct() if by else None
    grid = steps if keys is None else keys.join(F.broadcast(ends), F.lit(True)).select(*by, F.explode(F.expr(f"sequence(_first, _last, interval {step})")).alias("bucket"))
    return grid.join(series, ["bucket", *by], "left").fillna(fill)


def shares(log: DataFrame, by: str, value: str, most: int) -> DataFrame:
    """The greatest sums by key with their share of the whole; keys without a value come last."""
    sums = log.groupBy(by).agg(F.sum(value).alias("sum_value"))
    whole = sums.agg(F.sum("sum_value").alias("_whole"))
    told = sums.join(F.broadcast(whole), F.lit(True)).select(by, F.round("sum_value", 2).alias("sum_value"), F.round(F.col("sum_value") / F.when(F.col("_whole") != 0, F.col("_whole")), 6).alias("share"))
    return told.orderBy(F.desc_nulls_last("sum_value"), by).limit(most)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each combination of keys: the first in the order."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def capped(rows: DataFrame, key: str, order: list[Column], per_key: int, most: int) -> DataFrame:
    """A fair batch: of each key at most per_key rows, of all at most `most`, in order."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= per_key).drop("_place").orderBy(*order).limit(most)


def last_write_wins(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row written last of each key; partial aggregation keeps one row per key and task."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(sequence)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def absent(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not known yet: what an insert without overwriting adds."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def even_split(amounts: DataFrame, parts: DataFrame, key: str, amount: str) -> DataFrame:
    """Each amount dealt evenly over the parts that share its key, rounded half up; null amounts stay null."""
    counts = parts.groupBy(key).agg(F.count("*").alias("_n"))
    return parts.join(amounts.join(counts, key), key).withColumn("allocated", F.expr(f"cast(floor(({amount} + _n div 2) / _n) as bigint)")).drop("_n")


def objects(log: DataFrame, of: Column, protocol: str, success: Column, failure: Column, at: str, most: int, skip: int = 0, leave_out: str | None = None) -> DataFrame:
    """One page of objects by protocol: calls, successes, failures, rate and last call; most calls first, then by name.

    Rows without an object are none of an object's; leave_out drops one protocol and keeps rows that have none.
    """
    known = log.withColumn("object_id", of).where("object_id is not null")
    known = known.where(~F.col(protocol).eqNullSafe(F.lit(leave_out))) if leave_out is not None else known
    good, bad = F.count_if(success), F.count_if(failure)
    told = known.groupBy("object_id", protocol).agg(F.count("*").alias("calls"), good.alias("succeeded"), bad.alias("failed"), F.round(rate(good, bad), 6).alias("success_rate"), F.max(at).alias("last_at"))
    return told.orderBy(F.desc("calls"), "object_id", protocol).offset(skip).limit(most)


def top_sources(log: DataFrame, of: str, source: str, tenant: str, most: int = 3) -> DataFrame:
    """(of, source, calls, tenants, place): of each object the sources with most calls, and the different tenants they called for, a null among them."""
    by = log.groupBy(of, source, tenant).agg(F.count("*").alias("_n"))
    told = by.groupBy(of, source).agg(F.sum("_n").alias("calls"), F.array_sort(F.collect_set(tenant)).alias("tenants"), F.bool_or(F.col(tenant).isNull()).alias("_null"))
    place = F.row_number().over(W.partitionBy(of).orderBy(F.desc("calls"), F.col(source).asc_nulls_last()))
    return told.withColumn("place", place).where(F.col("place") <= most).select(of, source, "calls", (F.size("tenants") + F.col("_null").cast("int")).alias("tenants"), "place")


def last_failures(log: DataFrame, failure: Column, at: str, key: str, most: int) -> DataFrame:
    """The failures that ended last; those without an end come last of all."""
    return log.where(failure).orderBy(F.desc_nulls_last(at), key).limit(most)


def between(rows: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Rows from start up to, but not at, end."""
    return rows.where((F.col(at) >= F.lit(start).cast("timestamp_ntz")) & (F.col(at) < F.lit(end).cast("timestamp_ntz")))


def token_summary(usage: DataFrame, tokens: str, model: str, by: list[str]) -> DataFrame:
    """Tokens, models, share of calls that were metered (those with tokens), and the mean of these."""
    metered = F.count_if(F.col(tokens) > 0)
    return usage.groupBy(*by).agg(
        F.round(F.sum(tokens), 2).alias("tokens"), F.count_distinct(model).alias("models"), F.round(metered / F.when(F.count("*") > 0, F.count("*")), 6).alias("completeness"),
        F.round(F.sum(F.when(F.col(tokens) > 0, F.col(tokens))) / F.when(metered > 0, metered), 4).alias("per_metered"),
    )


def usage_by(usage: DataFrame, model: str, tokens: str, sort: str, descending: bool, most: int) -> DataFrame:
    """Calls, tokens and mean of each model, sorted by any of these; models without a value come last whichever the direction."""
    told = usage.groupBy(model).agg(F.count("*").alias("calls"), F.round(F.sum(tokens), 2).alias("tokens"), F.round(F.avg(tokens), 4).alias("mean_tokens"))
    return told.orderBy(F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort), F.col(model).asc_nulls_last()).limit(most)


def closed(buckets: DataFrame, size: str, now: str) -> DataFrame:
    """Buckets (bucket, ...) with `closed`: whether their right edge has passed."""
    return buckets.withColumn("closed", F.expr(f"bucket + interval {size}") <= F.lit(now).cast("timestamp_ntz"))


def unreconciled(calls: DataFrame, attempts: DataFrame, key: str, told: str, running: Column) -> DataFrame:
    """(key, told, found) of calls whose number of attempts is not that of the attempts there are; running ones are left out."""
    counts = attempts.groupBy(key).agg(F.count("*").alias("_n"))
    both = calls.where(~F.coalesce(running, F.lit(False))).join(counts, key, "left").withColumn("found", F.coalesce("_n", F.lit(0)))
    return both.where(F.col(told) != F.col("found")).select(key, told, "found")


def raised(calls: DataFrame, attempts: DataFrame, key: str, told: str) -> DataFrame:
    """calls with their number of attempts raised to what there are, never lowered."""
    counts = attempts.groupBy(key).agg(F.count("*").alias("_n"))
    return calls.join(counts, key, "left").withColumn(told, F.greatest(F.col(told), F.coalesce("_n", F.lit(0)))).drop("_n")


def added(totals: DataFrame, batch: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Totals by key with a batch's sums added; late rows simply count where they belong."""
    return totals.select(*keys, *values).union(batch.select(*keys, *values)).groupBy(*keys).agg(*[F.round(F.sum(v), 2).alias(v) for v in values])


def period_change(rows: DataFrame, at: str, value: Column, start: str, end: str) -> DataFrame:
    """(value, base, absolute, pct) of a period of whole days and the one of the same length before it; pct is null where the base is zero."""
    days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    day = F.to_date(at)
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    base_first = F.date_sub(first, days)
    sums = rows.where((day >= base_first) & (day <= last)).agg(F.sum(F.when(day >= first, value)).alias("value"), F.sum(F.when(day < first, value)).alias("base"))
    change = F.col("value") - F.col("base")
    return sums.select(F.round("value", 2).alias("value"), F.round("base", 2).alias("base"), F.round(change, 2).alias("absolute"), F.round(change / F.when(F.col("base") != 0, F.abs("base")) * 100, 4).alias("pct"))

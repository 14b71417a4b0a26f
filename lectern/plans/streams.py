"""Stateful operators on events: the limiter, merges, and event-time windows (an extension)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.streaming import stateful as S

from .registry import query, read

SIX_HOURS = 6 * 3600 * 1_000_000


@query("""with recursive e as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events),
f as (select user_id, event_id, i, us as start, 1 as n from e where i = 1 union all
  select e.user_id, e.event_id, e.i, case when e.us >= f.start + 21600000000 then e.us else f.start end, case when e.us >= f.start + 21600000000 then 1 else f.n + 1 end from f join e on e.user_id = f.user_id and e.i = f.i + 1)
select user_id, event_id, start::bigint as window_start, n::bigint as position, greatest(0, 3 - n)::bigint as remaining, n <= 3 as allowed from f""")
def rate_limit_fixed(spark, sf_dir):
    out = S.rate_limit(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", SIX_HOURS, 3)
    return out.select(F.col("key").alias("user_id"), F.col("tie").alias("event_id"), "window_start", "position", "remaining", "allowed")


@query("select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by all")
def latest_wins(spark, sf_dir):
    out = S.latest_wins(read(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id")
    return out.select("user_id", "event_type", "event_id", "value")


@query("""select time_bucket(interval '1 day', ts) as start, event_type, count(*)::bigint as n from events group by all""")
def tumbling_counts(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.windowed_counts(e, "ts", ["event_type"], "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""with w as (select time_bucket(interval '1 hour', ts) - to_hours(unnest([0, 1, 2])) as start, event_type from events) select start, event_type, count(*)::bigint as n from w group by all""")
def sliding_counts(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.windowed_counts(e, "ts", ["event_type"], "3 hours", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""with m as (select user_id, ts, case when ts <= lag(ts) over (partition by user_id order by ts) + interval '4 hours' then 0 else 1 end as c from events),
s as (select *, sum(c) over (partition by user_id order by ts rows unbounded preceding) as k from m) select user_id, min(ts) as start, max(ts) + interval '4 hours' as "end", count(*)::bigint as n from s group by user_id, k""")
def session_counts(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.sessions(e, "ts", "user_id", "4 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""select event_type, count(*)::bigint as n from events group by 1""")
def streamed_tally(spark, sf_dir):
    """A stream over the table's files, run to its end."""
    source = read(spark, sf_dir, "events")
    name = f"tally_{uuid.uuid4().hex}"
    rows = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events*.parquet")
    job = rows.groupBy("event_type").agg(F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.table(name)

"""Queries that run a stream over ``events`` to its end, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprint.plans.models import rounded
from lexiprint.sources.shared import fresh_dir
from lexiprint.streaming import monitor as M

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
IDLE_HOURS, LATE_HOURS = 24, 1


def _monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user as a model, values as samples in units of 100, errors as resets."""
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    samples = events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("model"), "ts", F.col("event_id").alias("n"), F.array(F.col("value") / 100).alias("vec"), (F.col("event_type") == "error").alias("reset"))
    place = fresh_dir(spark, "monitor")
    return rounded(M.run_to_end(M.drift_events(samples, f"{LATE_HOURS} hours", f"{IDLE_HOURS} hours"), f"{place}/rows", f"{place}/progress"))


QUERIES = {"monitored_drift": _monitored}

_IDLE = IDLE_HOURS * 3_600_000_000
ORACLES = {
    "monitored_drift": f"""with e as (select 'u' || user_id as model, ts, epoch_us(ts) as us, event_id as n, value / 100 as x, event_type = 'error' as reset from events),
w as (select max(us) // 1000 - {LATE_HOURS * 3_600_000} as mark from e),
o as (select *, lead(us) over (partition by model order by us, n) as next_us from e),
d as (select *, count(*) filter (reset) over (partition by model order by us, n) as part from o, w where (us + 999) // 1000 <= mark),
b as (select *, abs(x - first_value(x) over (partition by model, part order by us, n)) as drift from d),
c as (select *, lag(drift) over p as last, avg(drift) over (partition by model, part order by us, n rows between {M.KEPT - 1} preceding and current row) as recent from b window p as (partition by model, part order by us, n)),
r as (
    select model, ts, case when reset then 'reset' else 'sample' end as kind, drift, coalesce(abs(drift - last) > {M.JUMP}, false) as change, recent from c
    union all select model, make_timestamp(us + {_IDLE}), 'silent', drift, false, recent from c where (next_us is null or next_us > us + {_IDLE}) and (us + {_IDLE} + 999) // 1000 <= mark)
select model, ts, kind, round(drift + 1e-10, 6) as drift, case when drift >= 0.25 then 'critical' when drift >= 0.15 then 'high' when drift >= 0.1 then 'medium' when drift >= 0.05 then 'low' else 'none' end as level, change, round(recent + 1e-10, 6) as recent from r""",
}

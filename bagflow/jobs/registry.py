"""Every query of the library by name, with its SQL where SQL can express it.

Queries on logs use `events`: event_id is the step, user_id the key, cents the value in whole cents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import bags, callables, feeds, folds, keyed, pacing
from ..session import scratch
from ..sources import readers, sinks
from ..streaming import keyed_state, live, tables
from . import majority_direction, small_jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The event log in SQL, as `log` in Python.
EV = """ev AS (SELECT *, cast(round(value * 100) AS bigint) AS cents, (event_id % 1000)::double / 1000 AS lat,
 (cast(round(value * 100) AS bigint) % 1000)::double / 1000 AS lon FROM events)"""


def query(sql: str | None = None, name: str | None = None):
    """Register a function as a query, with its SQL."""

    def keep(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLE_SQL[key] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _valued(df: DataFrame) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    return df.withColumns({"cents": cents, "lat": F.col("event_id") % 1000 / F.lit(1000.0), "lon": cents % 1000 / F.lit(1000.0)})


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valued(table(spark, sf_dir, "events"))


def values(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return log(spark, sf_dir).filter(F.col("event_type") == kind).select("cents")


# --- majority direction -------------------------------------------------------------------------------------------

_DIRECTIONS = f"""WITH {EV},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM ev),
p AS (SELECT a.user_id, a.lat AS lat1, a.lon AS lon1, b.lat AS lat0, b.lon AS lon0 FROM r a JOIN r b ON a.user_id = b.user_id AND a.rn = 1 AND b.rn = 2),
d AS (SELECT user_id, (degrees(atan2(sin(lon1 - lon0) * cos(lat1), cos(lat0) * sin(lat1) - sin(lat0) * cos(lat1) * cos(lon1 - lon0))) + 360.0) % 360.0 AS deg FROM p),
l AS (SELECT user_id, CASE WHEN deg BETWEEN 45 AND 135 THEN 'north' WHEN deg BETWEEN 135 AND 225 THEN 'west' ELSE 'south' END AS direction FROM d)
"""


@query(_DIRECTIONS + "SELECT direction, count(*) AS n FROM l GROUP BY 1 ORDER BY n DESC, direction LIMIT 1", "majority_direction")
def _majority_direction(spark, sf_dir):
    return majority_direction.majority(log(spark, sf_dir), "user_id", "event_id", "ts")


@query(_DIRECTIONS + "SELECT direction, count(*) AS n FROM l GROUP BY 1")
def direction_counts(spark, sf_dir):
    return majority_direction.counts(log(spark, sf_dir), "user_id", "event_id", "ts")


@query(
    _DIRECTIONS.replace("CASE WHEN deg", "CASE WHEN deg >= 315 OR deg <= 45 THEN 'east' WHEN deg") + "SELECT user_id, direction FROM l",
)
def directions_with_east(spark, sf_dir):
    return majority_direction.directions(log(spark, sf_dir), "user_id", "event_id", "ts", fix_east=True)


# --- bounds ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 3")
def last_n_per_key(spark, sf_dir):
    return feeds.last_n(table(spark, sf_dir, "events"), 3, "event_id", "user_id").select("event_id", "user_id", "value")


@query("SELECT event_id, user_id, value FROM events ORDER BY event_id DESC LIMIT 100")
def last_n_bag(spark, sf_dir):
    return feeds.last_n(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), 100, "event_id")


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR")
def lease_state(spark, sf_dir):
    return feeds.lease(table(spark, sf_dir, "events"), "48 hours", "ts").select("event_id", "user_id")


@query(
    "SELECT event_id, user_id, event_type FROM events SEMI JOIN (SELECT user_id, event_type FROM events GROUP BY ALL HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR) USING (user_id, event_type)"
)
def lease_renew_state(spark, sf_dir):
    return feeds.lease(table(spark, sf_dir, "events"), "48 hours", "ts", renew=True, element=["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query(
    """SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR) WHERE rn <= 2"""
)
def bounded_state(spark, sf_dir):
    return feeds.bounded(table(spark, sf_dir, "events"), 2, "48 hours", "event_id", "ts", "user_id").select("event_id", "user_id")


# --- projections and filters ----------------------------------------------------------------------------------------


@query("SELECT user_id, event_id AS v_event_id, event_type AS v_event_type FROM events")
def keyed_split(spark, sf_dir):
    out = keyed.keyed(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id")
    return out.select("user_id", scalars.field("value", "event_id").alias("v_event_id"), scalars.field("value", "event_type").alias("v_event_type"))


@query(f"WITH {EV} SELECT cents % 100 AS v FROM ev")
def bag_map(spark, sf_dir):
    return bags.bag_map(log(spark, sf_dir), v=F.col("cents") % 100)


@query(f"WITH {EV} SELECT cents % 100 AS v, count(*) AS multiplicity FROM ev GROUP BY 1")
def bag_map_weighted(spark, sf_dir):
    return bags.bag_map(bags.to_weighted(log(spark, sf_dir).select("cents")), weighted=True, v=F.col("cents") % 100)


@query(f"WITH {EV} SELECT event_id, cents FROM ev WHERE cents % 2 = 0")
def bag_filter(spark, sf_dir):
    return bags.bag_filter(log(spark, sf_dir).select("event_id", "cents"), scalars.is_even(F.col("cents")))


@query(f"WITH {EV} SELECT user_id, cents + 1 AS v FROM ev")
def map_by_key(spark, sf_dir):
    return keyed.map_by_key(log(spark, sf_dir), "user_id", v=F.col("cents") + 1)


@query(f"WITH {EV} SELECT user_id, cents FROM ev WHERE cents > 2000")
def filter_by_key(spark, sf_dir):
    return keyed.filter_by_key(log(spark, sf_dir).select("user_id", "cents"), F.col("cents") > 2000)


@query(f"WITH {EV} SELECT user_id, cents FROM ev WHERE user_id IN (SELECT user_id FROM ev GROUP BY 1 HAVING count(*) >= 66)")
def filter_key_size(spark, sf_dir):
    return keyed.filter_key_size(log(spark, sf_dir).select("user_id", "cents"), "user_id", 66)


@query(f"WITH {EV} SELECT user_id, cents FROM ev WHERE user_id % 3 = 1")
def key_filter(spark, sf_dir):
    return keyed.filter_keys(log(spark, sf_dir).select("user_id", "cents"), F.col("user_id") % 3 == 1)


@query(f"WITH {EV} SELECT user_id AS k, cents AS v FROM ev")
def hash_to_multiset(spark, sf_dir):
    return keyed.to_pairs(log(spark, sf_dir), "user_id", "cents").select(F.col("pair.key").alias("k"), F.col("pair.value").alias("v"))


@query(f"WITH {EV} SELECT event_type, cents FROM ev")
def weighted_roundtrip(spark, sf_dir):
    return bags.from_weighted(bags.to_weighted(log(spark, sf_dir).select("event_type", "cents")))


# --- folds ------------------------------------------------------------------------------------------------------------


def _add(a, b):
    return a + b


@query(f"WITH {EV} SELECT cast(sum(cents) AS bigint) AS total FROM ev HAVING count(*) > 0")
def reduce_sum(spark, sf_dir):
    return bags.bag_reduce(log(spark, sf_dir), "total", F.sum("cents"))


@query(f"WITH {EV} SELECT cast(sum(cents) - 1 AS bigint) AS total FROM ev")
def reduce_sum_init(spark, sf_dir):
    return bags.bag_reduce(log(spark, sf_dir), "total", F.sum("cents"), init=-1, combine=_add).select(F.col("total").cast("long"))


@query(f"WITH {EV} SELECT cast(sum(cents) AS bigint) AS total FROM ev WHERE cents < 0 HAVING count(*) > 0")
def reduce_empty(spark, sf_dir):
    return bags.bag_reduce(log(spark, sf_dir).filter("cents < 0"), "total", F.sum("cents"))


@query(f"WITH {EV} SELECT cast(coalesce(sum(cents), 0) - 1 AS bigint) AS total FROM ev WHERE cents < 0")
def reduce_empty_init(spark, sf_dir):
    return bags.bag_reduce(log(spark, sf_dir).filter("cents < 0"), "total", F.sum("cents"), init=-1, combine=_add).select(F.col("total").cast("long"))


@query(f"WITH {EV} SELECT user_id, cast(sum(cents) AS bigint) AS total FROM ev GROUP BY 1")
def reduce_by_key(spark, sf_dir):
    return keyed.reduce_by_key(log(spark, sf_dir), "user_id", "total", F.sum("cents"))


@query(f"WITH {EV} SELECT user_id, cast(sum(cents) - 1 AS bigint) AS total FROM ev GROUP BY 1")
def reduce_by_key_init(spark, sf_dir):
    return keyed.reduce_by_key(log(spark, sf_dir), "user_id", "total", F.sum("cents"), init=-1, combine=_add)


@query(f"WITH {EV} SELECT user_id, bit_xor(cents) AS x FROM ev GROUP BY 1")
def fold_custom(spark, sf_dir):
    return folds.fold(log(spark, sf_dir), "user_id", "cents", lambda a, b: a ^ b, name="x", arrays=True)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def multiplicities(spark, sf_dir):
    return bags.multiplicities(table(spark, sf_dir, "events"), "event_type")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 1")
def majority_event(spark, sf_dir):
    return bags.majority(table(spark, sf_dir, "events"), "event_type", init=True)


@query("SELECT event_type, count(*) AS runs, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std_dev FROM events GROUP BY 1")
def run_report(spark, sf_dir):
    out = small_jobs.run_report(table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", "runs", F.round("mean", 6).alias("mean"), F.round("std_dev", 6).alias("std_dev"))


# --- set operations -----------------------------------------------------------------------------------------------------

_SIDES = f"""WITH {EV}, s AS (SELECT cents, count(*) FILTER (event_type = 'click') AS l, count(*) FILTER (event_type = 'view') AS r
FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1) """


def _two(spark, sf_dir):
    return values(spark, sf_dir, "click"), values(spark, sf_dir, "view")


def _weighted_two(spark, sf_dir):
    return tuple(bags.to_weighted(x) for x in _two(spark, sf_dir))


@query(_SIDES + "SELECT cents FROM s, range(greatest(l, r)) t(i)")
def bag_union(spark, sf_dir):
    return bags.bag_union(*_two(spark, sf_dir))


@query(_SIDES + "SELECT cents FROM s, range(greatest(l - r, 0)) t(i)")
def bag_subtract(spark, sf_dir):
    return bags.bag_subtract(*_two(spark, sf_dir))


@query(_SIDES + "SELECT cents FROM s, range(least(l, r)) t(i)")
def bag_intersection(spark, sf_dir):
    return bags.bag_intersection(*_two(spark, sf_dir))


@query(f"WITH {EV} SELECT DISTINCT cents FROM ev")
def bag_distinct(spark, sf_dir):
    return bags.bag_distinct(log(spark, sf_dir).select("cents"))


@query(_SIDES + "SELECT cents, greatest(l, r) AS multiplicity FROM s")
def bag_union_weighted(spark, sf_dir):
    return bags.bag_union(*_weighted_two(spark, sf_dir), weighted=True)


@query(_SIDES + "SELECT cents, l - r AS multiplicity FROM s WHERE l > r")
def bag_subtract_weighted(spark, sf_dir):
    return bags.bag_subtract(*_weighted_two(spark, sf_dir), weighted=True)


@query(_SIDES + "SELECT cents, least(l, r) AS multiplicity FROM s WHERE least(l, r) > 0")
def bag_intersection_weighted(spark, sf_dir):
    return bags.bag_intersection(*_weighted_two(spark, sf_dir), weighted=True)


@query(f"WITH {EV} SELECT DISTINCT cents, 1::bigint AS multiplicity FROM ev")
def bag_distinct_weighted(spark, sf_dir):
    return bags.bag_distinct(bags.to_weighted(log(spark, sf_dir).select("cents")), weighted=True)


@query(
    f"""WITH {EV}, s AS (SELECT cents, count(*) FILTER (cents % 5 = 0) AS l, count(*) FILTER (cents % 3 = 0) AS r FROM ev GROUP BY 1),
o AS (SELECT 'union' AS op, cents, greatest(l, r) AS n FROM s UNION ALL SELECT 'intersection', cents, least(l, r) FROM s
UNION ALL SELECT 'left_only', cents, l - r FROM s UNION ALL SELECT 'right_only', cents, r - l FROM s UNION ALL SELECT 'distinct', cents, least(greatest(l, r), 1) FROM s)
SELECT op, cents, n FROM o WHERE n > 0"""
)
def bag_algebra(spark, sf_dir):
    return small_jobs.bag_algebra(log(spark, sf_dir), "cents", 5, 3)


# --- change feeds -------------------------------------------------------------------------------------------------------

_BUFFERED = "b AS (SELECT event_id, user_id, event_id AS valid_from, lead(event_id, 3) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to FROM events)"
_LEASED = "e AS (SELECT a.event_id, a.user_id, a.event_id AS valid_from, b.event_id AS valid_to FROM events a ASOF LEFT JOIN events b ON a.ts + INTERVAL 6 HOUR < b.ts)"
_BOTH = f"""{_BUFFERED}, {_LEASED}, v AS (SELECT b.event_id, b.user_id, b.valid_from, least(b.valid_to, e.valid_to) AS valid_to FROM b JOIN e USING (event_id))"""


def _validity(spark, sf_dir, **bounds):
    out = feeds.validity(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "event_id", **bounds)
    return out.select("event_id", "user_id", "valid_from", "valid_to")


def _both_bounds(spark, sf_dir):
    return _validity(spark, sf_dir, key="user_id", n=3, timeout="6 hours", ts="ts")


def _middle(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.floor(F.max("event_id") / 2).alias("k")).first()["k"]


_MIDDLE = "(SELECT max(event_id) // 2 FROM events)"


@query(f"WITH {_BUFFERED} SELECT * FROM b")
def validity_buffer(spark, sf_dir):
    return _validity(spark, sf_dir, key="user_id", n=3)


@query("SELECT event_id, user_id, event_id AS valid_from, lead(event_id, 500) OVER (ORDER BY event_id) AS valid_to FROM events")
def validity_buffer_bag(spark, sf_dir):
    return _validity(spark, sf_dir, n=500)


@query(f"WITH {_LEASED} SELECT * FROM e")
def validity_lease(spark, sf_dir):
    return _validity(spark, sf_dir, timeout="6 hours", ts="ts")


@query(f"WITH {_BOTH} SELECT * FROM v")
def validity_both(spark, sf_dir):
    return _both_bounds(spark, sf_dir)


@query(f"WITH {_BOTH} SELECT event_id, user_id FROM v WHERE valid_from <= {_MIDDLE} AND (valid_to IS NULL OR valid_to > {_MIDDLE})")
def state_at(spark, sf_dir):
    return feeds.state_at(_both_bounds(spark, sf_dir), _middle(spark, sf_dir)).select("event_id", "user_id")


@query(f"WITH {_BOTH} SELECT event_id, user_id FROM v WHERE valid_from <= {_MIDDLE} - 1 AND (valid_to IS NULL OR valid_to > {_MIDDLE} - 1)")
def delay(spark, sf_dir):
    return feeds.delay(_both_bounds(spark, sf_dir), _middle(spark, sf_dir)).select("event_id", "user_id")


@query(f"WITH {_BOTH} SELECT valid_from AS step, event_id, user_id FROM v")
def diff_add(spark, sf_dir):
    return feeds.diff_add(_both_bounds(spark, sf_dir)).select("step", "event_id", "user_id")


@query(f"WITH {_BOTH} SELECT valid_to AS step, event_id, user_id FROM v WHERE valid_to IS NOT NULL")
def diff_remove(spark, sf_dir):
    return feeds.diff_remove(_both_bounds(spark, sf_dir)).select("step", "event_id", "user_id")


@query(
    """WITH t AS (SELECT event_id, user_id, ts, epoch_us(ts) // 21600000000 AS tick FROM events),
b AS (SELECT *, lead(tick, 3) OVER (PARTITION BY user_id ORDER BY event_id) AS evict FROM t),
v AS (SELECT a.tick, a.evict, c.tick AS expire FROM b a ASOF LEFT JOIN t c ON a.ts + INTERVAL 24 HOUR < c.ts),
d AS (SELECT tick AS step, 1 AS added, 0 AS removed FROM v UNION ALL SELECT least(evict, expire), 0, 1 FROM v WHERE least(evict, expire) IS NOT NULL)
SELECT step, cast(sum(added) AS bigint) AS added, cast(sum(removed) AS bigint) AS removed FROM d GROUP BY 1"""
)
def diff_per_tick(spark, sf_dir):
    v = feeds.validity(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "event_id", key="user_id", n=3, timeout="24 hours", ts="ts", tick="6 hours")
    both = feeds.diff_add(v).select("step", F.lit(1).alias("added"), F.lit(0).alias("removed")).unionByName(feeds.diff_remove(v).select("step", F.lit(0).alias("added"), F.lit(1).alias("removed")))
    return both.groupBy("step").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))


@query(
    f"""WITH {_BOTH} SELECT k.step, count(*) AS n FROM v, range({_MIDDLE}, {_MIDDLE} + 50) k(step)
WHERE valid_from <= k.step AND (valid_to IS NULL OR valid_to > k.step) GROUP BY 1"""
)
def state_sizes(spark, sf_dir):
    k = _middle(spark, sf_dir)
    return feeds.states(_both_bounds(spark, sf_dir), k, k + 49).groupBy("step").agg(F.count("*").alias("n"))


# --- pacing -------------------------------------------------------------------------------------------------------------

_TICKS = f"""WITH {EV}, t AS (SELECT epoch_us(ts) // 600000000 AS tick, * FROM ev),
l AS (SELECT tick, max(event_id) AS event_id, arg_max(cents, event_id) AS cents FROM t GROUP BY 1),
s AS (SELECT unnest(range((SELECT min(tick) FROM l), (SELECT max(tick) FROM l) + 1)) AS tick) """


@query(_TICKS + "SELECT s.tick, l.event_id, l.cents FROM s ASOF JOIN l ON s.tick >= l.tick")
def throttle(spark, sf_dir):
    return pacing.throttle(log(spark, sf_dir), "10 minutes", "ts", "event_id", "event_id", "cents")


@query(
    """WITH t AS (SELECT epoch_us(ts) // 86400000000 AS tick, * FROM events), l AS (SELECT user_id, tick, max(event_id) AS event_id FROM t GROUP BY ALL),
m AS (SELECT max(tick) AS last FROM l), s AS (SELECT user_id, unnest(range(min(tick), (SELECT last FROM m) + 1)) AS tick FROM l GROUP BY 1)
SELECT s.user_id, s.tick, l.event_id FROM s ASOF JOIN l ON s.user_id = l.user_id AND s.tick >= l.tick"""
)
def throttle_by_key(spark, sf_dir):
    return pacing.throttle(log(spark, sf_dir), "1 day", "ts", "event_id", "event_id", key="user_id")


def _running(frame: str) -> str:
    return f"WITH {EV} SELECT event_id, user_id, cast(sum(cents) OVER (PARTITION BY user_id ORDER BY {frame}) AS bigint) AS total FROM ev"


@query(_running("event_id ROWS UNBOUNDED PRECEDING"))
def running_reduce(spark, sf_dir):
    return pacing.running(log(spark, sf_dir), "user_id", "event_id", "total", F.sum("cents")).select("event_id", "user_id", "total")


@query(_running("event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW"))
def running_last_n(spark, sf_dir):
    return pacing.running(log(spark, sf_dir), "user_id", "event_id", "total", F.sum("cents"), rows=5).select("event_id", "user_id", "total")


@query(_running("ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW"))
def running_lease(spark, sf_dir):
    return pacing.running(log(spark, sf_dir), "user_id", "event_id", "total", F.sum("cents"), span="24 hours", ts="ts").select("event_id", "user_id", "total")


_NUMBERED = f"WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM ev)"


@query(
    _NUMBERED
    + """SELECT a.event_id, a.user_id, cast(sum(b.cents) AS bigint) AS total, max(b.cents) AS most, count(*) AS n FROM n a JOIN n b
ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - 4 AND a.rn AND b.ts >= a.ts - INTERVAL 24 HOUR GROUP BY ALL"""
)
def running_bounded(spark, sf_dir):
    """Folds of each user's last five rows that are no older than a day."""
    out = log(spark, sf_dir).select("event_id", "user_id", "cents", "ts")
    for name, agg in (("total", F.sum("cents")), ("most", F.max("cents")), ("n", F.count("*"))):
        out = pacing.running(out, "user_id", "event_id", name, agg, rows=5, span="24 hours", ts="ts")
    return out.select("event_id", "user_id", "total", "most", "n")


_HOT = f"WITH {EV}, h AS (SELECT *, CASE WHEN event_id % 10 = 3 THEN user_id ELSE -1 END AS k FROM ev)"


def _hot(spark, sf_dir):
    """The log with nine tenths of its rows under one key."""
    return log(spark, sf_dir).select("event_id", "ts", "cents", F.when(F.col("event_id") % 10 == 3, F.col("user_id")).otherwise(-1).alias("k"))


@query(_HOT + "SELECT event_id, k, cast(sum(cents) OVER (PARTITION BY k ORDER BY event_id) AS bigint) AS total FROM h")
def running_hot_key(spark, sf_dir):
    """A fold so far of a key that is most of the log, in ranges of some thousand rows."""
    return pacing.running(_hot(spark, sf_dir), "k", "event_id", "total", F.sum("cents"), merge="sum", hot_rows=2000).select("event_id", "k", "total")


@query(_HOT + "SELECT event_id, k, min(cents) OVER (PARTITION BY k ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS least FROM h")
def running_hot_key_span(spark, sf_dir):
    return pacing.running(_hot(spark, sf_dir), "k", "event_id", "least", F.min("cents"), merge="min", span="6 hours", ts="ts", hot_rows=2000).select("event_id", "k", "least")


@query(_HOT + "SELECT event_id, k, max(cents) OVER (PARTITION BY k ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS most FROM h")
def running_hot_key_rows(spark, sf_dir):
    return pacing.running(_hot(spark, sf_dir), "k", "event_id", "most", F.max("cents"), merge="max", rows=100, hot_rows=2000).select("event_id", "k", "most")


@query(f"WITH {EV} SELECT event_id, cast(sum(cents) OVER (ORDER BY event_id) AS bigint) AS total FROM ev")
def running_bag(spark, sf_dir):
    return pacing.running_sum(log(spark, sf_dir).select("event_id", "cents"), "event_id", "cents", "total").select("event_id", "total")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM s GROUP BY user_id, session"""
)
def sessions(spark, sf_dir):
    out = pacing.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "12 hours")
    return out.select("user_id", "n", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query("SELECT event_id, user_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE ts <= p + INTERVAL 6 HOUR")
def gap_filter(spark, sf_dir):
    return keyed.gap_filter(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours", "event_id").select("event_id", "user_id")


# --- joins and keyed state ------------------------------------------------------------------------------------------------


def _newest(spark, sf_dir, kind):
    return keyed.latest(log(spark, sf_dir).filter(F.col("event_type") == kind).select("user_id", "event_id", "cents"), "user_id", "event_id")


@query(
    f"""WITH {EV}, c AS (SELECT user_id, max(event_id) AS click_id, arg_max(cents, event_id) AS click FROM ev WHERE event_type = 'click' GROUP BY 1),
w AS (SELECT user_id, max(event_id) AS view_id, arg_max(cents, event_id) AS view FROM ev WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, click_id, click, view_id, view FROM c JOIN w USING (user_id)"""
)
def zip_keys(spark, sf_dir):
    l = _newest(spark, sf_dir, "click").select("user_id", F.col("event_id").alias("click_id"), F.col("cents").alias("click"))
    r = _newest(spark, sf_dir, "view").select("user_id", F.col("event_id").alias("view_id"), F.col("cents").alias("view"))
    return keyed.zip_keys(l, r, "user_id")


@query(f"WITH {EV} SELECT * FROM (SELECT event_id, user_id, cents, lag(cents) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_cents FROM ev) WHERE prev_cents IS NOT NULL")
def zip_delay(spark, sf_dir):
    return keyed.zip_delay(log(spark, sf_dir).select("event_id", "user_id", "cents"), "user_id", "event_id", "cents")


@query("SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def dict_lookup(spark, sf_dir):
    dim = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return keyed.dict_lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), dim, "c_nationkey")


@query(f"WITH {EV} SELECT user_id, max(event_id) AS event_id, arg_max(cents, event_id) AS cents FROM ev GROUP BY 1")
def latest_per_key(spark, sf_dir):
    return keyed.latest(log(spark, sf_dir).select("user_id", "event_id", "cents"), "user_id", "event_id")


_STATES = f"""WITH {EV}, m AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
d AS (SELECT *, (degrees(atan2(sin(lon - lon0) * cos(lat), cos(lat0) * sin(lat) - sin(lat0) * cos(lat) * cos(lon - lon0))) + 360.0) % 360.0 AS deg FROM m),
l AS (SELECT *, CASE WHEN lat0 IS NULL THEN NULL WHEN deg BETWEEN 45 AND 135 THEN 'north' WHEN deg BETWEEN 135 AND 225 THEN 'west' ELSE 'south' END AS current_direction FROM d)
"""


@query(_STATES + "SELECT event_id, user_id, current_direction, lag(current_direction) OVER (PARTITION BY user_id ORDER BY event_id) AS last_direction FROM l")
def user_state(spark, sf_dir):
    out = keyed.user_state(log(spark, sf_dir).select("event_id", "user_id", "lat", "lon"), "user_id", "event_id", "lat", "lon")
    return out.select("event_id", "user_id", "current_direction", "last_direction")


@query(
    f"""WITH {EV}, c AS (SELECT user_id, max(event_id) AS event_id FROM ev GROUP BY 1) SELECT user_id, event_id FROM c
WHERE user_id IN (SELECT user_id FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 100)"""
)
def changed_state(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id")
    return keyed.changed_state(keyed.latest(ev, "user_id", "event_id"), feeds.last_n(ev, 100, "event_id"), "user_id")


@query("SELECT event_type AS k, user_id, event_id FROM events")
def key_by(spark, sf_dir):
    return bags.key_by(table(spark, sf_dir, "events").select("event_type", "user_id", "event_id"), k=F.col("event_type")).drop("event_type")


@query("SELECT event_type || ':' || user_id AS label FROM events")
def unkey(spark, sf_dir):
    return bags.unkey(table(spark, sf_dir, "events"), label=F.concat_ws(":", "event_type", "user_id"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def word_count(spark, sf_dir):
    return small_jobs.word_count(table(spark, sf_dir, "documents"), "text")


# --- messages -----------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type FROM events")
def parse_delimited(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.concat_ws(";", "user_id", "event_id", "event_type").alias("line"))
    good, _ = readers.parse_delimited(lines, {"user_id": "bigint", "event_id": "bigint", "event_type": "string"})
    return good


@query("SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k FROM events")
def parse_json_props(spark, sf_dir):
    return readers.parse_messages(table(spark, sf_dir, "events"), "k long", "props", "event_id")


@query("SELECT event_id, epoch_us(ts) + 90000000 AS later_us FROM events WHERE ts < TIMESTAMP '2024-01-15'")
def time_functions(spark, sf_dir):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    ev = table(spark, sf_dir, "events").select("event_id", scalars.iso_time(text).alias("at")).filter(F.col("at") < F.to_timestamp(F.lit("2024-01-15")))
    return ev.select("event_id", F.unix_micros(scalars.plus_seconds(F.col("at"), 90)).alias("later_us"))


@query("SELECT event_id, 'x' || event_type AS kind, user_id + 1 AS n FROM events")
def message_fields(spark, sf_dir):
    m = table(spark, sf_dir, "events").select("event_id", F.struct("event_type", "user_id", "value").alias("m"))
    m = m.select("event_id", scalars.with_value(scalars.without("m", "value"), "n", F.col("m.user_id") + 1).alias("m"))
    return m.select("event_id", F.concat(F.lit("x"), scalars.field("m", "event_type")).alias("kind"), scalars.field("m", "n").alias("n"))


@query("SELECT '{\"user_id\":' || user_id || ',\"event_id\":' || event_id || '}' AS message FROM events")
def flatten_out(spark, sf_dir):
    return sinks.flat(table(spark, sf_dir, "events").select("user_id", "event_id"))


@query(
    "WITH m AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), j AS (SELECT '{\"event_type\":\"' || event_type || '\",\"n\":' || n || '}' AS j FROM m) SELECT '[' || string_agg(j, ',' ORDER BY j) || ']' AS document FROM j"
)
def whole_out(spark, sf_dir):
    return sinks.whole(bags.multiplicities(table(spark, sf_dir, "events"), "event_type"))


@query(f"WITH {EV} SELECT '{{\"user_id\":' || user_id || ',\"cents\":' || (cents + 1) || '}}' AS message FROM ev")
def keyed_increment(spark, sf_dir):
    return small_jobs.keyed_increment(log(spark, sf_dir), "user_id", "cents")[1]


@query("SELECT event_type AS first, user_id::varchar AS second FROM events")
def pair_parts(spark, sf_dir):
    pair = F.array("event_type", F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(scalars.first_of(pair).alias("first"), scalars.second_of(pair).alias("second"))


@query(
    """SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all('#' || event_type || ' by #u' || user_id || ' # ', '#([0-9A-Za-z_]+)', 1)) AS tag FROM events) GROUP BY 1"""
)
def hashtag_count(spark, sf_dir):
    text = F.concat(F.lit("#"), "event_type", F.lit(" by #u"), F.col("user_id"), F.lit(" # "))
    return bags.multiplicities(bags.flat_map(table(spark, sf_dir, "events"), scalars.hashtags(text), "tag"), "tag")


@query("SELECT '{\"event_id\":' || event_id || '}' AS one, '[' || event_id || ',' || user_id || ']' AS several FROM events")
def rendered_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select(scalars.rendered("event_id").alias("one"), scalars.rendered("event_id", "user_id").alias("several"))


# --- Python functions ---------------------------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT cents * 2 + 1 AS value FROM ev")
def map_with(spark, sf_dir):
    return callables.map_with(log(spark, sf_dir), lambda c: c * 2 + 1, "cents", returns="long")


@query(f"WITH {EV} SELECT event_id, cents FROM ev WHERE (cents + event_id) % 3 = 0")
def filter_with(spark, sf_dir):
    return callables.filter_with(log(spark, sf_dir).select("event_id", "cents"), lambda c, e: (c + e) % 3 == 0, "cents", "event_id")


@query(f"WITH {EV} SELECT user_id, upper(event_type) || '-' || cents AS value FROM ev")
def map_by_key_with(spark, sf_dir):
    return callables.map_by_key_with(log(spark, sf_dir), "user_id", lambda t, c: t.str.upper() + "-" + c.astype(str), "event_type", "cents", returns="string")


@query(f"WITH {EV} SELECT user_id, cents FROM ev WHERE cents % 100 > 90")
def filter_by_key_with(spark, sf_dir):
    return callables.filter_by_key_with(log(spark, sf_dir).select("user_id", "cents"), lambda c: c % 100 > 90, "cents")


# --- streams --------------------------------------------------------------------------------------------------------------------


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # a pattern, as the table may be one file or a folder of files
    return _valued(readers.read_bag(spark, f"{sf_dir}/event[s].parquet", schema, streaming=True))


def _finished(df: DataFrame, label: str, **options) -> str:
    """Run a stream over what its source holds; returns where it wrote."""
    spark = df.sparkSession
    live.use_rocksdb(spark)
    path = scratch(spark, label)
    live.start(df, f"{path}-checkpoint", path=path, **options).awaitTermination()
    return path


def _changes(spark, sf_dir):
    feed = live.stream_diff(stream(spark, sf_dir), 3, "user_id", "event_id", "cents")
    return spark.read.schema(feed.schema).parquet(_finished(feed, "stream-diff"))


@query(f"WITH {EV} SELECT user_id, event_id, cents FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM ev) WHERE rn <= 3")
def stream_last_n(spark, sf_dir):
    return live.last_n_of(_changes(spark, sf_dir)).select(F.col("key").alias("user_id"), F.col("step").alias("event_id"), F.col("value").alias("cents"))


@query(
    f"""WITH {EV} SELECT user_id, 'add' AS op, event_id, cents FROM ev UNION ALL
SELECT user_id, 'remove', event_id, cents FROM (SELECT *, lead(event_id, 3) OVER (PARTITION BY user_id ORDER BY event_id) AS gone FROM ev) WHERE gone IS NOT NULL"""
)
def stream_diff(spark, sf_dir):
    return _changes(spark, sf_dir).select(F.col("key").alias("user_id"), "op", F.col("step").alias("event_id"), F.col("value").alias("cents"))


def _positions(spark, sf_dir):
    return live.stream_position_state(stream(spark, sf_dir), "user_id", "event_id", "lat", "lon")


@query(_STATES + "SELECT user_id, event_id, current_direction FROM l")
def stream_position_state(spark, sf_dir):
    df = _positions(spark, sf_dir)
    out = spark.read.schema(df.schema).parquet(_finished(df, "stream-position"))
    return out.select(F.col("key").alias("user_id"), F.col("step").alias("event_id"), "current_direction")


@query(
    _STATES
    + """SELECT current_direction, count(*) AS n FROM (SELECT user_id, arg_max(current_direction, event_id) AS current_direction FROM l GROUP BY 1)
WHERE current_direction IS NOT NULL GROUP BY 1 ORDER BY n DESC, current_direction LIMIT 1"""
)
def stream_majority(spark, sf_dir):
    counts = scratch(spark, "stream-counts")
    feed = scratch(spark, "stream-states")
    states = keyed_state.user_states(scratch(spark, "stream-state"), feed, "user_id", "event_id", "lat", "lon", buckets=16)
    batch = keyed_state.then(states, feed, keyed_state.label_counts(counts, "user_id", "event_id", "last_direction", "current_direction"))
    _finished(stream(spark, sf_dir).select("user_id", "event_id", "lat", "lon"), "stream-majority", batch=batch)
    found = live.snapshot(spark, counts).select(F.col("label").alias("current_direction"), "n")
    return found.orderBy(F.desc("n"), "current_direction").limit(1)


def _stream_bag(spark, sf_dir, kind):
    ev = stream(spark, sf_dir)
    state = scratch(spark, "stream-bags")
    tagged, batch = keyed_state.bag_counts(*[ev.filter(F.col("event_type") == k).select("cents") for k in ("click", "view")], state, buckets=16)
    _finished(tagged, "stream-counts", batch=batch)
    return live.bag_op(live.snapshot(spark, state), kind)


@query(_SIDES + "SELECT cents, greatest(l, r) AS multiplicity FROM s")
def stream_bag_union(spark, sf_dir):
    return _stream_bag(spark, sf_dir, "union")


@query(_SIDES + "SELECT cents, least(l, r) AS multiplicity FROM s WHERE least(l, r) > 0")
def stream_bag_intersection(spark, sf_dir):
    return _stream_bag(spark, sf_dir, "intersection")


@query(_SIDES + "SELECT cents, l - r AS multiplicity FROM s WHERE l > r")
def stream_bag_subtract(spark, sf_dir):
    return _stream_bag(spark, sf_dir, "subtract")


@query(f"WITH {EV} SELECT user_id, event_id, cents FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM ev) WHERE rn BETWEEN 2 AND 4")
def stream_delay(spark, sf_dir):
    """The last three rows of each user as they were one arrival earlier."""
    before = live.last_n_of(live.delayed(_changes(spark, sf_dir)))
    return before.select(F.col("key").alias("user_id"), F.col("step").alias("event_id"), F.col("value").alias("cents"))


@query(
    """SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views FROM events
WHERE event_type IN ('click', 'view') GROUP BY 1"""
)
def stream_do_apply(spark, sf_dir):
    """Whenever clicks or views arrive, a function gets all clicks and all views so far and writes their counts."""
    ev = stream(spark, sf_dir).select("event_id", "user_id", "event_type")
    path = scratch(spark, "stream-applied")

    def counts(clicks, views):
        both = bags.multiplicities(clicks, "user_id", name="clicks").join(bags.multiplicities(views, "user_id", name="views"), "user_id", "full")
        both.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("clicks", "views")]).write.mode("overwrite").parquet(path)

    tagged, batch = live.do_apply(counts, scratch(spark, "stream-inputs"), *[ev.filter(F.col("event_type") == k) for k in ("click", "view")])
    _finished(tagged, "stream-apply", batch=batch)
    return spark.read.parquet(path)


@query(
    """SELECT user_id, floor(epoch_us(ts) / 1000)::bigint AS at_ms, count(*) AS multiplicity FROM events
WHERE floor(epoch_us(ts) / 1000) + 172800000 > (SELECT floor(epoch_us(max(ts)) / 1000) FROM events) - 600000 GROUP BY 1, 2"""
)
def stream_lease_timers(spark, sf_dir):
    feed = live.stream_lease_timers(stream(spark, sf_dir), "user_id", "ts", "48 hours", "10 minutes")
    out = spark.read.schema(feed.schema).parquet(_finished(feed, "stream-timers"))
    return live.leased_of(out).select(F.col("key").alias("user_id"), "at_ms", "multiplicity")


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR")
def stream_lease(spark, sf_dir):
    state = scratch(spark, "stream-lease")
    _finished(stream(spark, sf_dir).select("event_id", "user_id", "ts"), "stream-leased", batch=live.stream_lease(state, "ts", "48 hours"))
    return live.snapshot(spark, state).select("event_id", "user_id")


@query(
    """WITH t AS (SELECT epoch_us(ts) - epoch_us(ts) % 3600000000 AS tick_us, event_type FROM events)
SELECT tick_us, event_type, count(*) AS n FROM t WHERE tick_us + 3600000000 <= (SELECT epoch_us(max(ts)) FROM events) - 600000000 GROUP BY 1, 2"""
)
def stream_tick_windows(spark, sf_dir):
    df = live.tick_windows(stream(spark, sf_dir), "ts", "1 hour", "10 minutes", "event_type")
    out = spark.read.schema(df.schema).parquet(_finished(df, "stream-ticks"))
    return out.select(F.unix_micros("tick_start").alias("tick_us"), "event_type", "n")


def _results(spark, sf_dir, label, batch_for, df=None):
    """Run a stateful batch function over the stream and return what it wrote."""
    out = scratch(spark, label)
    _finished(stream(spark, sf_dir) if df is None else df, label, batch=batch_for(scratch(spark, f"{label}-state"), out))
    return tables.results(spark, out)


@query(_STATES + "SELECT event_id, user_id, current_direction, lag(current_direction) OVER (PARTITION BY user_id ORDER BY event_id) AS last_direction FROM l")
def stream_user_state(spark, sf_dir):
    out = _results(spark, sf_dir, "stream-users", lambda state, out: keyed_state.user_states(state, out, "user_id", "event_id", "lat", "lon", date="ts"))
    return out.select("event_id", "user_id", "current_direction", "last_direction")


_LAST_THREE = "OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@query(f"WITH {EV} SELECT event_id, user_id, max(cents) {_LAST_THREE} AS most FROM ev")
def stream_fold_last_n(spark, sf_dir):
    """The largest of each user's last three values, after each arrival."""
    fold = lambda state, out: keyed_state.folded(state, out, "event_id", "most", F.max("cents"), key="user_id", rows=3, columns=["cents"])
    return _results(spark, sf_dir, "stream-fold-n", fold).select("event_id", "user_id", "most")


@query(f"WITH {EV} SELECT event_id, user_id, bit_xor(cents) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS x FROM ev")
def stream_fold_lease(spark, sf_dir):
    """A fold of each user's values of the last day, after each arrival."""
    fold = lambda state, out: keyed_state.folded(state, out, "event_id", "x", F.bit_xor("cents"), key="user_id", span="24 hours", ts="ts", columns=["cents"])
    return _results(spark, sf_dir, "stream-fold-t", fold).select("event_id", "user_id", "x")


@query(f"WITH {EV} SELECT event_id, max(cents) OVER (ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS most FROM ev")
def stream_fold_bag(spark, sf_dir):
    """The largest of the whole bag's last hundred values, after each arrival."""
    fold = lambda state, out: keyed_state.folded(state, out, "event_id", "most", F.max("cents"), rows=100, merge="max", columns=["cents"])
    return _results(spark, sf_dir, "stream-fold-bag", fold).select("event_id", "most")


@query(
    f"""WITH {_BOTH} SELECT 'add' AS op, valid_from AS at, event_id, user_id FROM v
UNION ALL SELECT 'remove', valid_to, event_id, user_id FROM v WHERE valid_to IS NOT NULL"""
)
def stream_bounded(spark, sf_dir):
    """The change feed of a buffer of three per user on a lease of six hours of the whole log."""
    feed = lambda state, out: keyed_state.bounded(state, out, "event_id", key="user_id", n=3, timeout="6 hours", ts="ts")
    out = _results(spark, sf_dir, "stream-bounded", feed, stream(spark, sf_dir).select("event_id", "user_id", "ts"))
    return out.select("op", "at", "event_id", "user_id")


#: Lives of (user, type) under a lease of 12 hours that each arrival renews.
_LIVES = """WITH e AS (SELECT a.event_id, a.user_id, a.event_type, b.event_id AS expire FROM events a ASOF LEFT JOIN events b ON a.ts + INTERVAL 12 HOUR < b.ts),
n AS (SELECT *, lead(event_id) OVER w AS next FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)),
g AS (SELECT *, CASE WHEN expire IS NOT NULL AND (next IS NULL OR expire < next) THEN 1 ELSE 0 END AS ended FROM n),
l AS (SELECT *, sum(ended) OVER (PARTITION BY user_id, event_type ORDER BY event_id) - ended AS life FROM g),
r AS (SELECT user_id, event_type, min(event_id) AS first_step, max(event_id) AS last_step, count(*) AS n, max(CASE WHEN ended = 1 THEN expire END) AS expire_at FROM l GROUP BY user_id, event_type, life)
"""


@query(_LIVES + "SELECT * FROM r")
def renewals(spark, sf_dir):
    out = pacing.renewals(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "ts", "12 hours")
    return out.drop("last_ts")


@query(_LIVES + "SELECT 'add' AS op, event_id AS at, user_id, event_type, 1::bigint AS n FROM e UNION ALL SELECT 'remove', expire_at, user_id, event_type, n FROM r WHERE expire_at IS NOT NULL")
def stream_renew(spark, sf_dir):
    feed = lambda state, out: keyed_state.renewed(state, out, ["user_id", "event_type"], "event_id", "ts", "12 hours")
    return _results(spark, sf_dir, "stream-renew", feed).select("op", "at", "user_id", "event_type", "n")


@query(
    """WITH t AS (SELECT epoch_us(ts) // 86400000000 AS tick, * FROM events), l AS (SELECT user_id, tick, max(event_id) AS event_id FROM t GROUP BY ALL),
m AS (SELECT max(tick) AS last FROM l), s AS (SELECT user_id, unnest(range(min(tick), (SELECT last FROM m))) AS tick FROM l GROUP BY 1)
SELECT s.user_id, s.tick, l.event_id FROM s ASOF JOIN l ON s.user_id = l.user_id AND s.tick >= l.tick"""
)
def stream_throttle(spark, sf_dir):
    feed = lambda state, out: keyed_state.throttled(state, out, "1 day", "ts", "event_id", "event_id", key="user_id")
    return _results(spark, sf_dir, "stream-throttle", feed).select("user_id", "tick", "event_id")


@query(
    f"""WITH {_BOTH}, t AS (SELECT event_id AS step, epoch_us(ts) // 21600000000 AS tick FROM events),
c AS (SELECT 'add' AS op, valid_from AS step, event_id, user_id FROM v UNION ALL SELECT 'remove', valid_to, event_id, user_id FROM v WHERE valid_to IS NOT NULL)
SELECT tick, op, event_id, user_id FROM c JOIN t USING (step) WHERE tick < (SELECT max(tick) FROM t)"""
)
def stream_tick_changes(spark, sf_dir):
    """What came into and went out of the bounded collection in each whole tick of six hours, in both lists if both."""
    feed, state = scratch(spark, "stream-changes"), scratch(spark, "stream-changes-state")
    first = keyed_state.bounded(state, feed, "event_id", key="user_id", n=3, timeout="6 hours", ts="ts")
    lists = lambda state, out: keyed_state.then(first, feed, keyed_state.ticked(state, out, "6 hours", "at_ts"))
    out = _results(spark, sf_dir, "stream-lists", lists, stream(spark, sf_dir).select("event_id", "user_id", "ts"))
    return out.select("tick", "op", "event_id", "user_id")


@query(
    f"""WITH {EV}, s AS (SELECT user_id, event_id, last_value(CASE WHEN event_type = 'click' THEN cents END IGNORE NULLS) OVER w AS click,
last_value(CASE WHEN event_type = 'view' THEN cents END IGNORE NULLS) OVER w AS view FROM ev WHERE event_type IN ('click', 'view')
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT * FROM s WHERE click IS NOT NULL AND view IS NOT NULL"""
)
def stream_zip(spark, sf_dir):
    """Each user's latest click beside the latest view, whenever either changes."""
    ev, out = stream(spark, sf_dir), scratch(spark, "stream-zip")
    sides = [ev.filter(F.col("event_type") == k).select("user_id", "event_id", F.col("cents").alias(k)) for k in ("click", "view")]
    tagged, batch = keyed_state.zipped(*sides, "user_id", "event_id", scratch(spark, "stream-zip-state"), out)
    _finished(tagged, "stream-zipped", batch=batch)
    return tables.results(spark, out)


@query(
    """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM s GROUP BY user_id, session
HAVING max(ts) + INTERVAL 12 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 10 MINUTE"""
)
def stream_sessions(spark, sf_dir):
    df = live.stream_sessions(stream(spark, sf_dir), "user_id", "ts", "12 hours", "10 minutes")
    out = spark.read.schema(df.schema).parquet(_finished(df, "stream-sessions"))
    return out.select("user_id", "n", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))

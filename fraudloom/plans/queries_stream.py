"""Batch twins of the streaming operators, and scoring with a detector."""

import uuid
from datetime import date

from pyspark.sql import functions as F

from fraudloom.operators import feature_sets, sketches
from fraudloom.operators.group_features import FEATURES
from fraudloom.operators.key_tables import Measure
from fraudloom.plans.oracle_views import r6, with_views
from fraudloom.plans.registry import AS_OF, query, round_columns
from fraudloom.sources import fixtures as fx
from fraudloom.session import shared_folder
from fraudloom.streaming import scoring, velocity
from fraudloom.streaming.running import running_features


def _events(spark, sf):
    return fx.table(spark, sf, "events")


def _text(df, *columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


_FMT = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_FLOOR = "time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01')"


@query("stream_velocity", f"""SELECT {_FMT.format('s')} AS window_start,
    {_FMT.format("s + INTERVAL 10 MINUTE")} AS window_end, user_id, count(*) AS n
    FROM (SELECT user_id, unnest([{_FLOOR}, {_FLOOR} - INTERVAL 5 MINUTE]) AS s FROM events) GROUP BY ALL""")
def stream_velocity(spark, sf):
    return _text(velocity.velocity(_events(spark, sf)), "window_start", "window_end")


@query("stream_velocity_tumbling", f"""SELECT {_FMT.format('s')} AS window_start,
    {_FMT.format("s + INTERVAL 1 HOUR")} AS window_end, user_id, count(*) AS n, {r6('sum(value)', 'total')},
    max(value) AS largest
    FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2000-01-01') AS s FROM events) GROUP BY s, user_id""")
def stream_velocity_tumbling(spark, sf):
    df = velocity.velocity(_events(spark, sf), length="1 hour", slide=None, value="value")
    return round_columns(_text(df, "window_start", "window_end"), ["total"])


@query("stream_sessions", """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start,
    strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS n
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE
      THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark, sf):
    return _text(velocity.sessions(_events(spark, sf)), "window_start", "window_end")


@query("daily_summary", f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
    count(*) AS n, {r6('sum(value)', 'total')}, max(value) AS largest FROM events GROUP BY ALL""")
def daily_summary(spark, sf):
    df = velocity.daily_summary(_events(spark, sf)).drop("window_end")
    return round_columns(_text(df, "window_start"), ["total"])


@query("stream_alerts", """SELECT DISTINCT event_id, user_id, event_type, value FROM events
    WHERE value > (SELECT quantile_cont(value, 0.99) FROM events)""")
def stream_alerts(spark, sf):
    from fraudloom.operators.quantile import exact_percentile

    events = _events(spark, sf)
    limit = exact_percentile(events, "value", 0.99)
    return velocity.alerts(events, ["event_id"], "ts", "value", limit).select(
        "event_id", "user_id", "event_type", "value"
    )


def _streamed(spark, sf, name):
    """A given table as a stream of its files; a table may be one file or a folder of them."""
    stored = fx.table(spark, sf, name)
    reader = spark.readStream.schema(stored.schema)
    if any(f.endswith(f"/{name}.parquet") for f in stored.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    return reader.parquet(f"{sf}/{name}.parquet")


def _drained(stream):
    """All that a stream now holds, by way of a file sink in the shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


_OF_USER = [
    Measure("events_of_user", "user_id", "count", "event_id"), Measure("kinds_of_user", "user_id", "distinct", "event_type"),
    Measure("many_kinds", "user_id", "many", "event_type"),
]


@query("stream_running_counts", """SELECT event_id, count(event_id) OVER so_far AS events_of_user,
    count(DISTINCT event_type) OVER so_far AS kinds_of_user, count(DISTINCT event_type) OVER so_far > 1 AS many_kinds
    FROM events WINDOW so_far AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def stream_running_counts(spark, sf):
    running = running_features(_streamed(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"), _OF_USER, ["ts", "event_id"])
    return _drained(running).select("event_id", *(m.out for m in _OF_USER))


_SO_FAR = "CASE WHEN {k} IS NOT NULL THEN {a} OVER (PARTITION BY {k} ORDER BY id ROWS UNBOUNDED PRECEDING) {more} END AS {out}"


def _running_sql(name):
    m = FEATURES[name]
    agg = f"count({'' if m.fn == 'count' else 'DISTINCT '}{m.value})"
    return _SO_FAR.format(k=m.key, a=agg, more="> 1" if m.fn == "many" else "", out=name)


#: Counts of cards, customers and users as of each transaction.
LIVE = [
    "transactions_per_card", "users_per_card", "addresses_per_card", "transactions_per_customer", "cards_per_customer",
    "multiple_states", "cards_per_user",
]


@query("stream_running_features", with_views(f"SELECT id, {', '.join(map(_running_sql, LIVE))} FROM tx", "tx"))
def stream_running_features(spark, sf):
    used = sorted({c for n in LIVE for c in (FEATURES[n].key, FEATURES[n].value)} | {"id"})
    cards, path = fx.transactions(spark, sf).select(*used), f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}/in"
    cards.write.parquet(path)
    rows = spark.readStream.schema(cards.schema).parquet(path)
    return _drained(running_features(rows, LIVE, ["id"])).select("id", *LIVE)


@query("stream_score")
def stream_score(spark, sf):
    cards = fx.transactions(spark, sf)
    return scoring.fit_detector(cards, feature_sets.FOREST, AS_OF).score(cards)


#: Counts and distinct counts of keys over a window of days.
WINDOWED = ["transactions_per_card", "users_per_card", "addresses_per_card", "cards_per_customer", "multiple_states", "transactions_per_state"]
_START, _END = "1995-03-01", "1995-05-30"


def dated_transactions(spark, sf):
    """Card rows with the day of their order."""
    days = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"))
    return fx.transactions(spark, sf).join(days, "id")


def _window_sql():
    measures = [FEATURES[n] for n in WINDOWED]
    columns = [f"w{i}.{m.out}" for i, m in enumerate(measures)]
    inside = f"day >= DATE '{_START}' AND day < DATE '{_END}'"
    joins = []
    for i, m in enumerate(measures):
        agg = f"count({'' if m.fn == 'count' else 'DISTINCT '}{m.value})" + (" > 1" if m.fn == "many" else "")
        joins.append(f"LEFT JOIN (SELECT {m.key} AS k, {agg} AS {m.out} FROM dated WHERE {inside} AND {m.key} IS NOT NULL GROUP BY 1) w{i} ON w{i}.k = dated.{m.key}")
    dated = "SELECT tx.*, o_orderdate::DATE AS day FROM tx JOIN orders ON o_orderkey = id"
    return with_views(f"SELECT id, {', '.join(columns)} FROM dated {' '.join(joins)}", "tx", extra={"dated": dated})


@query("window_counts_from_sketches", _window_sql())
def window_counts_from_sketches(spark, sf):
    rows, path = dated_transactions(spark, sf), f"{shared_folder(spark)}/sketches/{uuid.uuid4().hex}"
    sketches.store_days(rows, "day", WINDOWED, path)
    counted = sketches.add_window_counts(rows, spark.read.parquet(path), date.fromisoformat(_START), date.fromisoformat(_END), WINDOWED)
    return counted.select("id", *WINDOWED)

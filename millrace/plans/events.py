"""The queries on events and line items, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.asof import asof_join
from millrace.operators.intervals import interval_join
from millrace.operators.running import running_totals
from millrace.operators.slices import micros
from millrace.sources.shared import new_folder
from millrace.sources.tables import table
from millrace.streaming import sessions


def _of(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind).select("event_id", "user_id", "ts")


def purchase_last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the last click of its user up to then."""
    events = table(spark, sf_dir, "events")
    found = asof_join(_of(events, "purchase"), _of(events, "click"), ["user_id"], "ts", "ts", prefix="click_")
    return found.drop("click_user_id")


def order_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its customer's last order of a day before."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    earlier = orders.groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    found = asof_join(orders, earlier, ["o_custkey"], "o_orderdate", "o_orderdate", prefix="last_", strict=True)
    return found.drop("last_o_custkey")


def spent_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the values, in hundredths, and the number of all events of its type up to then."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    cents = F.round(F.col("value") * 100).cast("long")
    return running_totals(events, ["event_type"], "ts", {"cents": cents, "n_events": F.lit(1)}).drop("value")


def shipped_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item with the quantity and the number of all items shipped up to its day."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    totals = {"quantity": F.col("l_quantity").cast("long"), "n_items": F.lit(1)}
    return running_totals(items, [], "l_shipdate", totals).drop("l_quantity")


def clicks_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with each click of its user in the day before."""
    events = table(spark, sf_dir, "events")
    found = interval_join(_of(events, "purchase"), _of(events, "click"), ["user_id"], "ts", "ts", 86_400, 0, prefix="click_")
    return found.drop("click_user_id")


def errors_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event how many errors of any user there are from ten minutes before to five minutes after."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    errors = events.where("event_type = 'error'").select("event_id", "ts")
    found = interval_join(events.select("event_id", "ts"), errors, [], "ts", "ts", 600, 300, prefix="error_")
    return found.groupBy("event_id").agg(F.count("*").alias("n_errors"), F.min("error_ts").alias("first"))


SESSION_GAP, SESSION_LATE = 4 * 3600, 24 * 3600


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions of each user, from the events as a stream that ends with what is there."""
    # as a pattern, so that the table may be one file or a folder
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    events = events.select("user_id", F.timestamp_micros(micros(F.col("ts"), "timestamp_ntz")).alias("ts"), F.round(F.col("value") * 100).alias("cents"))
    stream = sessions.sessions(events, "user_id", "ts", "cents", SESSION_GAP, SESSION_LATE)
    folder = new_folder(spark, "sessions")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, sessions.STATE_STORE)
    try:
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        query.start(f"{folder}/sessions").awaitTermination()
    finally:
        spark.conf.set(store, before)
    found = spark.read.schema(stream.schema).parquet(f"{folder}/sessions")
    whole = F.col("last") - F.col("first")
    return found.select(F.col("key").alias("user_id"), F.col("first").alias("first_micros"), whole.alias("micros"), F.col("n").alias("n_events"), F.col("total").alias("cents"))


_SIDES = """(SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p {} JOIN
    (SELECT event_id AS click_event_id, user_id AS u, ts AS click_ts FROM events WHERE event_type = 'click') c ON user_id = u AND """

_FOUND = {
    "purchase_last_click": (
        purchase_last_click,
        f"SELECT event_id, user_id, ts, click_event_id, click_ts FROM {_SIDES.format('ASOF LEFT')} click_ts <= ts",
    ),
    "order_last_order": (
        order_last_order,
        """SELECT o_orderkey, o_custkey, o_orderdate, x.k AS last_o_orderkey, x.d AS last_o_orderdate FROM (
            SELECT *, max(struct_pack(d := o_orderdate, k := o_orderkey)) OVER (
                PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 SECOND PRECEDING) AS x
            FROM orders)""",
    ),
    "spent_so_far": (
        spent_so_far,
        """SELECT event_id, event_type, ts, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS cents, count(*) OVER w AS n_events
        FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)""",
    ),
    "shipped_so_far": (
        shipped_so_far,
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
               CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS quantity, count(*) OVER w AS n_items
        FROM lineitem WINDOW w AS (ORDER BY l_shipdate)""",
    ),
    "clicks_before_purchase": (
        clicks_before_purchase,
        f"SELECT event_id, user_id, ts, click_event_id, click_ts FROM {_SIDES.format('')} click_ts BETWEEN ts - INTERVAL 1 DAY AND ts",
    ),
    "user_sessions": (
        user_sessions,
        f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t, CAST(round(value * 100) AS BIGINT) AS c FROM events),
        begun AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > {SESSION_GAP}000000 AS new FROM e),
        numbered AS (SELECT *, sum(CAST(coalesce(new, true) AS INT)) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS s FROM begun)
        SELECT user_id, min(t) AS first_micros, max(t) - min(t) AS micros, count(*) AS n_events, CAST(sum(c) AS BIGINT) AS cents
        FROM numbered GROUP BY user_id, s
        HAVING max(t) + {SESSION_GAP}000000 < ((SELECT max(t) FROM e) // 1000 - {SESSION_LATE}000) * 1000""",
    ),
    "errors_near": (
        errors_near,
        """SELECT e.event_id, count(*) AS n_errors, min(x.ts) AS first FROM events e
        JOIN events x ON x.event_type = 'error' AND x.ts BETWEEN e.ts - INTERVAL 10 MINUTE AND e.ts + INTERVAL 5 MINUTE GROUP BY 1""",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items()}

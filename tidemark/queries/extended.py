"""As-of and interval joins, comparison of loads, ranks of big groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import round_to
from tidemark.operators.hierarchy import roll_up
from tidemark.operators.semistructured import drift, sum_maps, typed_fields
from tidemark.operators.compare import compare_loads, multiset_difference
from tidemark.operators.intervals import asof_join, interval_join
from tidemark.operators.positions import tiles, value_places
from tidemark.operators.sessions import sessions
from tidemark.plans import rfm as rf
from tidemark.queries.base import present, query
from tidemark.queries.oracle import I, N, R
from tidemark.runtime import scratch_path
from tidemark.streaming.upserts import current, upsert_available
from tidemark.streaming.sessions import session_stream, write_available

# List prices come from the lines with return flag N: the highest unit price of a part and day.
PRICES = f"""p AS (SELECT l_partkey AS part, l_shipdate AS day, MAX({R('l_extendedprice / l_quantity', 4)}) AS price
  FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)"""


def _prices(t):
    lines = t.lineitem.where("l_returnflag = 'N'")
    unit = round_to(F.col("l_extendedprice") / F.col("l_quantity"), 4)
    return lines.groupBy(F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("day")).agg(F.max(unit).alias("price"))


def _returned(t):
    return t.lineitem.where("l_returnflag = 'R'").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("shipped"))


@query("ext_1_asof_price", sql=f"""
WITH {PRICES}
SELECT l.l_orderkey, l.l_linenumber, p.price, p.day AS priced_on
FROM lineitem l ASOF LEFT JOIN p ON p.part = l.l_partkey AND p.day <= l.l_shipdate WHERE l.l_returnflag = 'R'""")
def _(t):
    priced = asof_join(_returned(t), _prices(t), "shipped", "day", ["part"], ["price"], matched_at="priced_on")
    return priced.select("l_orderkey", "l_linenumber", "price", "priced_on")


@query("ext_1_asof_next_order", sql="""
WITH f AS (SELECT o_custkey, o_orderdate, MAX(o_orderkey) AS next_order FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT o.o_orderkey, f.next_order
FROM orders o ASOF LEFT JOIN f ON f.o_custkey = o.o_custkey AND o.o_orderdate <= f.o_orderdate
WHERE o.o_orderstatus = 'O'""")
def _(t):
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    done = orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("next_order"))
    found = asof_join(orders.where("o_orderstatus = 'O'"), done, "o_orderdate", "o_orderdate", ["o_custkey"],
                      ["next_order"], direction="forward")
    return found.select("o_orderkey", "next_order")


@query("ext_2_interval_price", sql=f"""
WITH {PRICES}, v AS (SELECT part, price, day, LEAD(day) OVER (PARTITION BY part ORDER BY day) AS until FROM p)
SELECT l.l_orderkey, l.l_linenumber, v.price
FROM lineitem l JOIN v ON v.part = l.l_partkey AND v.day <= l.l_shipdate AND l.l_shipdate < v.until
WHERE l.l_returnflag = 'R'""")
def _(t):
    until = F.lead("day").over(Window.partitionBy("part").orderBy("day"))
    valid = _prices(t).withColumn("until", until)
    pairs = interval_join(_returned(t), valid, "shipped", "day", "until", ["part"])
    return pairs.select("l_orderkey", "l_linenumber", "price")


@query("ext_2_interval_errors_after_purchase", sql=f"""
SELECT p.user_id, p.event_id, {N} AS errors
FROM events p JOIN events e ON e.user_id = p.user_id AND e.event_type = 'error'
  AND p.ts <= e.ts AND e.ts < p.ts + INTERVAL 1 DAY
WHERE p.event_type = 'purchase' GROUP BY 1, 2""")
def _(t):
    bought = t.events.where("event_type = 'purchase'").select(
        "user_id", "event_id", F.col("ts").alias("since"), (F.col("ts") + F.expr("interval 1 day")).alias("until"))
    errors = t.events.where("event_type = 'error'").select("user_id", "ts")
    pairs = interval_join(errors, bought, "ts", "since", "until", ["user_id"])
    return pairs.groupBy("user_id", "event_id").agg(F.count(F.lit(1)).alias("errors"))


# A later load of the orders: dropped, repriced, repeated, re-statused and new orders,
# one in 97 each (both of price and status in another).
LOAD = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
LOADS = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders),
w AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 IN (3, 5) THEN NULL ELSE o_orderstatus END AS o_orderstatus,
        CASE WHEN o_orderkey % 97 IN (1, 5) THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
      FROM o WHERE o_orderkey % 97 <> 0
      UNION ALL SELECT * FROM o WHERE o_orderkey % 97 = 2
      UNION ALL SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM o WHERE o_orderkey % 97 = 4)"""


def _loads(t):
    old = t.orders.select(*LOAD)
    left = F.col("o_orderkey") % 97
    edited = old.where(left != 0).withColumns({
        "o_orderstatus": F.when(~left.isin(3, 5), F.col("o_orderstatus")),
        "o_totalprice": F.when(left.isin(1, 5), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))})
    added = old.where(left == 4).withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    return old, edited.unionByName(old.where(left == 2)).unionByName(added)


@query("ext_3_multiset_difference", sql=f"""
WITH {LOADS}, a AS (SELECT *, COUNT(*) AS n FROM o GROUP BY ALL), b AS (SELECT *, COUNT(*) AS n FROM w GROUP BY ALL)
SELECT COALESCE(a.o_orderkey, b.o_orderkey) AS o_orderkey, COALESCE(a.o_custkey, b.o_custkey) AS o_custkey,
       COALESCE(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus, COALESCE(a.o_totalprice, b.o_totalprice) AS o_totalprice,
       {I('COALESCE(a.n, 0)')} AS n_old, {I('COALESCE(b.n, 0)')} AS n_new
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey AND a.o_custkey = b.o_custkey AND a.o_totalprice = b.o_totalprice
  AND a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus
WHERE a.n IS DISTINCT FROM b.n""")
def _(t):
    return multiset_difference(*_loads(t))


@query("ext_3_compare_loads", sql=f"""
WITH {LOADS}, a AS (SELECT o_orderkey, {N} AS n, MIN(o_orderstatus) AS s, MIN(o_totalprice) AS v FROM o GROUP BY 1),
b AS (SELECT o_orderkey, {N} AS n, MIN(o_orderstatus) AS s, MIN(o_totalprice) AS v FROM w GROUP BY 1),
j AS (SELECT COALESCE(a.o_orderkey, b.o_orderkey) AS o_orderkey, COALESCE(a.n, 0) AS n_old, COALESCE(b.n, 0) AS n_new,
        concat_ws(',', CASE WHEN a.s IS DISTINCT FROM b.s THEN 'o_orderstatus' END,
                  CASE WHEN a.v IS DISTINCT FROM b.v THEN 'o_totalprice' END) AS c
      FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT o_orderkey, CASE WHEN n_old = 0 THEN 'added' WHEN n_new = 0 THEN 'dropped' WHEN c = '' THEN 'repeated'
       ELSE 'changed' END AS status, n_old, n_new, CASE WHEN n_old > 0 AND n_new > 0 AND c <> '' THEN c END AS changed
FROM j WHERE n_old <> n_new OR c <> ''""")
def _(t):
    return compare_loads(*_loads(t), ["o_orderkey"])


def _tile(value: str) -> str:
    return f"CAST(NTILE(5) OVER (ORDER BY {value}, customer_id) AS INTEGER)"


@query("ext_4_rfm_quintiles", "rfm", sql=f"""
SELECT customer_id, {_tile('-recency')} AS r, {_tile('frequency')} AS f, {_tile('monetary')} AS m FROM rfm""")
def _(t):
    return rf.quintiles(rf.rfm(t.sales))


@query("ext_4_value_places", sql=f"""
SELECT c_custkey, {I('RANK() OVER w')} AS rank, {I('DENSE_RANK() OVER w')} AS dense_rank,
       {R('PERCENT_RANK() OVER w', 9)} AS percent_rank, {R('CUME_DIST() OVER w', 9)} AS cume_dist
FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY FLOOR(c_acctbal))""")
def _(t):
    people = t.customer.select("c_custkey", "c_mktsegment", F.floor("c_acctbal").alias("balance"))
    out = value_places(people, "balance", ["c_mktsegment"])
    return out.select("c_custkey", "rank", "dense_rank", round_to(F.col("percent_rank"), 9).alias("percent_rank"),
                      round_to(F.col("cume_dist"), 9).alias("cume_dist"))


SESSIONS = f"""g AS (SELECT user_id, ts, CAST(value AS DECIMAL(18,2)) AS value,
  CASE WHEN ts <= LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM events),
n AS (SELECT *, SUM(opens) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g),
s AS (SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 12 HOUR AS session_end, {N} AS events,
        CAST(SUM(value) AS DOUBLE) AS value FROM n GROUP BY user_id, no)"""


def _activity(events):
    return events.select("user_id", "ts", F.col("value").cast("decimal(18,2)").alias("value"))


@query("ext_5_sessions", sql=f"WITH {SESSIONS} SELECT * FROM s")
def _(t):
    return sessions(_activity(t.events), "ts", ["user_id"], "12 hours", ["value"])


@query("ext_5_closed_sessions_stream", sql=f"""
WITH {SESSIONS} SELECT * FROM s WHERE session_end <= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY""")
def _(t):
    # the stream reads the table's files as arrivals; sessions open at its end are not given out.
    # A plain path must be a folder, a pattern may match a single file as well.
    arriving = t.spark.readStream.schema(t.events.schema).parquet(f"{t.path}/events.parque[t]")
    timed = _activity(arriving).withColumn("ts", F.col("ts").cast("timestamp"))
    target = scratch_path(t.spark, "sessions")
    write_available(session_stream(timed, "ts", ["user_id"], "12 hours", "1 day", ["value"]),
                    target, scratch_path(t.spark, "sessions-progress"))
    kind = dict(t.events.dtypes)["ts"]
    closed = t.spark.read.parquet(target)
    return closed.withColumns({c: F.col(c).cast(kind) for c in ("session_start", "session_end")})


# Payloads as different writers would send them: the plain counter, a counter as text, further fields.
_PAYLOADS = """
p AS (SELECT event_type, CASE event_type
        WHEN 'purchase' THEN '{"k": ' || json_extract_string(props, '$.k') || ', "tags": ["a", "b"], "paid": true}'
        WHEN 'error' THEN '{"k": "' || json_extract_string(props, '$.k') || '", "detail": {"code": 1}}'
        WHEN 'signup' THEN '{"k": null}' ELSE props END AS payload FROM events)"""


def _payloads(events):
    k = F.get_json_object("props", "$.k")
    sent = (F.when(F.col("event_type") == "purchase", F.concat(F.lit('{"k": '), k, F.lit(', "tags": ["a", "b"], "paid": true}')))
            .when(F.col("event_type") == "error", F.concat(F.lit('{"k": "'), k, F.lit('", "detail": {"code": 1}}')))
            .when(F.col("event_type") == "signup", F.lit('{"k": null}')).otherwise(F.col("props")))
    return events.select("event_type", sent.alias("payload"))


@query("ext_6_typed_json", sql="""
SELECT event_type, COUNT(*) AS n_events, SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS sum_k,
       COUNT(*) FILTER (WHERE NOT json_valid(props)) AS n_unsound
FROM events GROUP BY event_type""")
def _(t):
    typed = typed_fields(t.events, "props", {"k": "long"})
    return typed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("k").alias("sum_k"),
        F.count_if(~F.col("props_sound")).alias("n_unsound"))


@query("ext_6_json_drift", sql=f"""
WITH {_PAYLOADS},
f AS (SELECT payload, unnest(json_keys(payload)) AS field FROM p),
g AS (SELECT field, CASE json_type(payload, '$.' || field)
        WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object'
        WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM f),
h AS (SELECT field, kind, COUNT(*) AS rows FROM g GROUP BY field, kind),
d(field, wanted) AS (VALUES ('k', 'number'), ('tags', 'text'), ('currency', 'text'))
SELECT field, kind, COALESCE(rows, 0) AS rows,
       CASE WHEN kind IS NULL THEN 'missing' WHEN wanted IS NULL THEN 'new'
            WHEN kind IN ('null', wanted) THEN 'expected' ELSE 'other kind' END AS state
FROM h FULL JOIN d USING (field)""")
def _(t):
    return drift(_payloads(t.events), "payload", {"k": "number", "tags": "text", "currency": "text"})


@query("ext_6_map_totals", sql="""
SELECT user_id, event_type AS key, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, COUNT(*) AS rows
FROM events WHERE event_type IS NOT NULL GROUP BY user_id, event_type""")
def _(t):
    maps = t.events.where("event_type IS NOT NULL").select(
        "user_id", F.create_map("event_type", F.col("value").cast("decimal(18,2)")).alias("amounts"))
    return present(sum_maps(maps, "amounts", ["user_id"]))


# Customers in a tree: each reports to the customer of a third of its key.
@query("ext_7_hierarchy_roll_up", sql="""
WITH RECURSIVE n AS (SELECT c_custkey AS node, c_custkey // 3 AS parent FROM customer),
a(node, ancestor, distance) AS (
  SELECT node, node, 0 FROM n
  UNION ALL
  SELECT a.node, m.node, distance + 1 FROM a JOIN n u ON u.node = a.ancestor JOIN n m ON m.node = u.parent
  WHERE m.node <> u.node),
o AS (SELECT o_custkey AS node, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS own FROM orders GROUP BY o_custkey)
SELECT ancestor AS node, CAST(COALESCE(SUM(own) FILTER (WHERE distance = 0), 0) AS DOUBLE) AS own,
       CAST(COALESCE(SUM(own), 0) AS DOUBLE) AS total, COUNT(*) FILTER (WHERE distance > 0) AS below
FROM a LEFT JOIN o USING (node) GROUP BY ancestor""")
def _(t):
    key = F.col("c_custkey")
    above = F.when(key > 0, F.floor(key / 3).cast("long"))
    nodes = t.customer.select(key.alias("node"), above.alias("parent"))
    amounts = t.orders.select(F.col("o_custkey").alias("node"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    return present(roll_up(nodes, "node", "parent", amounts, "amount"))


@query("ext_5_upserted_stream", sql="""
SELECT user_id, ts, event_id, event_type FROM events
QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(t):
    arriving = t.spark.readStream.schema(t.events.schema).parquet(f"{t.path}/events.parque[t]")
    target = scratch_path(t.spark, "upserts")
    upsert_available(arriving.select("user_id", "ts", "event_id", "event_type"), target,
                     scratch_path(t.spark, "upserts-progress"), ["user_id"], ["ts", "event_id"])
    return current(t.spark, target, ["user_id"], ["ts", "event_id"])

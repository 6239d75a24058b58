"""Record versions derived from the test tables, for Spark and as SQL.

Orders: flat records. Version A ran before the last two months arrived; version B no longer
exports orders below 5,000 and formats several fields in another way. Orders from 490,000
on are withdrawn. Documents: records with an array of lines and a nested object; version B
removes repeated lines, reverses the rest, and leaves out documents labelled toxic. Events:
many rows per user; version A ends before the last days, version B has all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER_FIELDS = ["cust", "date", "priority", "rush", "status", "total"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _binary_json(*fields):
    return F.to_json(F.struct(*fields)).cast("binary").alias("transformed_record")


def _order_row(record):
    return [
        F.col("o_orderkey").cast("string").alias("record_id"),
        F.col("o_orderpriority").alias("source"),
        F.col("o_orderdate").cast("date").alias("run_date"),
        F.lit("full").alias("run_type"),
        F.when(F.col("o_totalprice") >= 490000, "delete").otherwise("index").alias("action"),
        record,
    ]


def _iso_date():
    return F.date_format("o_orderdate", "yyyy-MM-dd")


def _b_values() -> dict:
    total = F.col("o_totalprice")
    return {
        "date": F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"),
                       F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(_iso_date()),
        "priority": F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED",
                           F.col("o_orderpriority")),
        "rush": F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(True)),
        "status": F.when(F.col("o_orderstatus") == "P", "PENDING")
        .otherwise(F.col("o_orderstatus")),
        "total": F.when(total >= 400000, F.round(total)).otherwise(total),
    }


def transform_orders_a(orders: DataFrame) -> DataFrame:
    """Version A of the order transform, over any orders."""
    return orders.select(*_order_row(_binary_json(
        F.col("o_custkey").alias("cust"), _iso_date().alias("date"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total"))))


def transform_orders_b(orders: DataFrame) -> DataFrame:
    """Version B: ``cust`` turns into text for totals below 20,000."""
    as_text = F.col("o_totalprice") < 20000
    values = _b_values()
    return orders.select(*_order_row(_binary_json(
        F.when(~as_text, F.col("o_custkey")).alias("cust"),
        F.when(as_text, F.col("o_custkey").cast("string")).alias("cust"),
        *[value.alias(name) for name, value in values.items()])))


def item_versions(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Orders with their distinct lines as an array. Version B gives some lines another quantity
    and leaves out others."""
    item = F.struct(F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").alias("part"),
                    F.col("l_quantity").cast("long").alias("qty"), F.col("l_suppkey").alias("supp"))
    # both sides come from one shuffle of the lines, by the key that the window and the join use
    orders = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").cast("string").alias("record_id")).agg(F.collect_set(item).alias("items"))

    def edited(line):
        qty = F.when((line.part + line.line) % 5 == 0, line.qty + 100).otherwise(line.qty)
        return F.struct(line.line, line.part, qty.alias("qty"), line.supp)

    kept = F.transform(F.filter("items", lambda line: line.part % 11 != 0), edited)
    sides = [orders, orders.withColumn("items", kept).where(F.size("items") > 0)]
    return [side.select(
        "record_id", F.lit("lines").alias("source"),
        F.lit("2024-01-01").cast("date").alias("run_date"), F.lit("full").alias("run_type"),
        F.lit("index").alias("action"), _binary_json(F.array_sort("items").alias("items")))
        for side in sides]


def _a_orders(orders):
    """Early orders, and the cheap ones, which B leaves out: every order has a version."""
    early = F.col("o_orderdate") < F.lit("2001-06-01").cast("timestamp")
    return orders.filter(early | (F.col("o_totalprice") < 5000))


def _b_orders(orders):
    return orders.filter(F.col("o_totalprice") >= 5000)


def order_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    return transform_orders_a(_a_orders(orders)), transform_orders_b(_b_orders(orders))


def typed_order_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same versions with the record as a struct; ``cust`` is text in both."""
    orders = table(spark, sf_dir, "orders")
    as_text = F.col("o_totalprice") < 20000
    cust = F.col("o_custkey").cast("string")
    a = F.struct(
        cust.alias("cust"), _iso_date().alias("date"), F.col("o_orderpriority").alias("priority"),
        F.lit(None).cast("boolean").alias("rush"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total")).alias("transformed_record")
    b = F.struct(
        F.when(as_text, F.concat(F.lit('"'), cust, F.lit('"'))).otherwise(cust).alias("cust"),
        *[value.alias(name) for name, value in _b_values().items()]).alias("transformed_record")
    return (_a_orders(orders).select(*_order_row(a)), _b_orders(orders).select(*_order_row(b)))


def document_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")
    lines = F.split("text", "\n")
    unique = F.reverse(F.array_distinct(lines))

    def rows(df, items):
        return df.select(
            F.col("doc_id").cast("string").alias("record_id"), "source",
            F.lit("2024-01-01").cast("date").alias("run_date"), F.lit("full").alias("run_type"),
            F.lit("index").alias("action"),
            _binary_json(
                F.col("lang"), items.alias("lines"),
                F.struct(F.col("n_chars").alias("chars"), F.size(items).alias("lines"))
                .alias("stats")))

    return rows(documents, lines), rows(documents.join(toxic, "doc_id", "left_anti"), unique)


def event_rows(events: DataFrame) -> DataFrame:
    """Version rows of events, with ``event_id`` kept to break ties."""
    return events.select(
        F.col("user_id").cast("string").alias("record_id"),
        F.col("event_type").alias("source"), F.col("ts").cast("date").alias("run_date"),
        F.when(F.col("event_type").isin("signup", "purchase"), "full").otherwise("daily")
        .alias("run_type"),
        F.when(F.col("event_type") == "error", "delete").otherwise("index").alias("action"),
        _binary_json(
            F.col("event_id").alias("event"),
            F.from_json("props", "k bigint").alias("props"),
            F.col("event_type").alias("type"), "value"),
        "event_id")


def event_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    before = events.filter(F.col("ts") < F.lit("2024-01-25").cast("timestamp"))
    return event_rows(before), event_rows(events)


# --- the same versions as SQL -------------------------------------------------

ORDERS_SQL = """
o AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS record_id, o_orderpriority AS source,
         CAST(o_orderdate AS DATE) AS run_date, 'full' AS run_type,
         CASE WHEN o_totalprice >= 490000 THEN 'delete' ELSE 'index' END AS action,
         o_orderdate < TIMESTAMP '2001-06-01' OR o_totalprice < 5000 AS in_a,
         o_totalprice >= 5000 AS in_b,
         o_custkey AS cust, o_totalprice < 20000 AS cust_text,
         strftime(o_orderdate, '%Y-%m-%d') AS date_a,
         CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN strftime(o_orderdate, '%Y/%m/%d')
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_b,
         o_orderpriority AS priority_a, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority_b,
         o_orderpriority = '1-URGENT' AS rush,
         o_orderstatus AS status_a,
         CASE WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE o_orderstatus END AS status_b,
         o_totalprice AS total_a,
         CASE WHEN o_totalprice >= 400000 THEN round(o_totalprice) ELSE o_totalprice END AS total_b
  FROM orders),
joined AS (
  SELECT *, in_a AND in_b AS both_sides,
         CASE WHEN in_a THEN '{"cust":' || cust || ',"date":"' || date_a || '","priority":"'
              || priority_a || '","status":"' || status_a || '","total":' || total_a || '}'
         END AS record_a,
         CASE WHEN in_b THEN '{"cust":'
              || CASE WHEN cust_text THEN '"' || cust || '"' ELSE CAST(cust AS VARCHAR) END
              || ',"date":"' || date_b || '"'
              || CASE WHEN priority_b IS NULL THEN '' ELSE ',"priority":"' || priority_b || '"' END
              || CASE WHEN rush THEN ',"rush":true' ELSE '' END
              || ',"status":"' || status_b || '","total":' || total_b || '}'
         END AS record_b
  FROM o WHERE in_a OR in_b),
collated AS (SELECT * FROM joined WHERE action <> 'delete'),
diffs AS (
  SELECT *,
         both_sides AND cust_text AS d_cust, both_sides AND date_a <> date_b AS d_date,
         both_sides AND priority_b IS NULL AS d_priority, both_sides AND rush AS d_rush,
         both_sides AND status_a <> status_b AS d_status,
         both_sides AND total_a <> total_b AS d_total
  FROM collated),
flagged AS (
  SELECT *, NOT both_sides AS missing,
         d_cust OR d_date OR d_priority OR d_rush OR d_status OR d_total AS changed,
         concat_ws(',', CASE WHEN d_cust THEN 'cust' END, CASE WHEN d_date THEN 'date' END,
                   CASE WHEN d_priority THEN 'priority' END, CASE WHEN d_rush THEN 'rush' END,
                   CASE WHEN d_status THEN 'status' END, CASE WHEN d_total THEN 'total' END)
           AS fields
  FROM diffs),
records AS (
  SELECT *, CASE WHEN missing OR changed THEN 'true' ELSE 'false' END AS has_diff FROM flagged),
cells AS (
  SELECT record_id, source, unnest(string_split(fields, ',')) AS field
  FROM records WHERE fields <> '')
"""

DOCUMENTS_SQL = """
docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS record_id, source, lang, n_chars,
         string_split(text, chr(10)) AS lines,
         doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AS in_b
  FROM documents),
counted AS (SELECT *, len(lines) AS n_lines, len(list_distinct(lines)) AS n_unique FROM docs),
records AS (
  SELECT *, in_b AND n_lines <> n_unique AS repeats,
         CASE WHEN NOT in_b OR n_lines <> n_unique THEN 'true' ELSE 'false' END AS has_diff,
         CASE WHEN in_b AND n_lines <> n_unique THEN 'lines,stats' ELSE '' END AS fields
  FROM counted),
cells AS (
  SELECT record_id, source, unnest(string_split(fields, ',')) AS field
  FROM records WHERE fields <> '')
"""

EVENTS_SQL = """
e AS (
  SELECT CAST(user_id AS VARCHAR) AS record_id, event_type AS source,
         CAST(ts AS DATE) AS run_date, ts < TIMESTAMP '2024-01-25' AS in_a,
         CASE WHEN event_type IN ('signup', 'purchase') THEN 'full' ELSE 'daily' END AS run_type,
         CASE WHEN event_type = 'error' THEN 'delete' ELSE 'index' END AS action,
         event_id, value, CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) AS k
  FROM events),
latest_b AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id
    ORDER BY run_date DESC NULLS LAST, run_type, action, event_id) AS rn FROM e) WHERE rn = 1),
latest_a AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id
    ORDER BY run_date DESC NULLS LAST, run_type, action, event_id) AS rn FROM e WHERE in_a)
  WHERE rn = 1),
collated AS (
  SELECT * FROM (
    SELECT coalesce(a.record_id, b.record_id) AS record_id, coalesce(a.source, b.source) AS source,
           coalesce(a.run_date, b.run_date) AS run_date,
           coalesce(a.run_type, b.run_type) AS run_type, coalesce(a.action, b.action) AS action,
           a.event_id AS event_a, b.event_id AS event_b, a.source AS type_a, b.source AS type_b,
           a.value AS value_a, b.value AS value_b, a.k AS k_a, b.k AS k_b
    FROM latest_a a FULL JOIN latest_b b ON a.record_id = b.record_id)
  WHERE action <> 'delete')
"""

"""Bookkeeping relations over the test tables: DataFrames, and the same as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.money import MONEY
from tallyforge.lineage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows much is made of: dealt to all tasks first, as its file may be one task's."""
    return spread(table(spark, sf_dir, name))


def chart(spark: SparkSession, d: str) -> DataFrame:
    """Three levels: region, nation, customer; only customers have a reduced code."""
    region, nation, customer = (table(spark, d, t) for t in ("region", "nation", "customer"))
    top = lambda c: (F.col(c) + 1).cast("string")
    mid = F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0")
    null = F.lit(None).cast("string")
    a = region.select(F.concat(top("r_regionkey"), F.lit(".00.000000")).alias("code"), null.alias("reduced_code"), F.col("r_name").alias("description"), F.col("r_regionkey").cast("long").alias("ord"))
    b = nation.select(F.concat_ws(".", top("n_regionkey"), mid, F.lit("000000")), null, "n_name", (F.col("n_nationkey") + 100).cast("long"))
    leaf = F.lpad((F.col("c_custkey") + 1).cast("string"), 6, "0")
    c = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws(".", top("n_regionkey"), mid, leaf), F.col("c_custkey").cast("string"), F.concat_ws(" ", "c_name", "c_mktsegment"), F.col("c_custkey") + 1000)
    return a.union(b).union(c)


CHART = """chart AS (
  SELECT CAST(r_regionkey + 1 AS VARCHAR) || '.00.000000' AS code, CAST(NULL AS VARCHAR) AS reduced_code, r_name AS description, CAST(r_regionkey AS BIGINT) AS ord FROM region
  UNION ALL SELECT CAST(n_regionkey + 1 AS VARCHAR) || '.' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || '.000000', NULL, n_name, n_nationkey + 100 FROM nation
  UNION ALL SELECT CAST(n_regionkey + 1 AS VARCHAR) || '.' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(c_custkey + 1 AS VARCHAR), 6, '0'),
    CAST(c_custkey AS VARCHAR), c_name || ' ' || c_mktsegment, c_custkey + 1000 FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""


def movements(spark: SparkSession, d: str) -> DataFrame:
    """Orders as movements: finished ones go out, others come in."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    sign = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("ord"), F.to_date("o_orderdate").alias("date"), (F.col("o_totalprice").cast(MONEY) * sign).cast(MONEY).alias("amount"),
        F.col("c_name").alias("counterparty"), F.col("o_orderpriority").alias("notes"), F.col("c_nationkey").cast("string").alias("financial_account"), F.col("c_custkey").alias("ledger"),
    )


MOVEMENTS = """movements AS (
  SELECT o_orderkey AS ord, CAST(o_orderdate AS DATE) AS date, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * (CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) AS DECIMAL(18,2)) AS amount,
    c_name AS counterparty, o_orderpriority AS notes, CAST(c_nationkey AS VARCHAR) AS financial_account, c_custkey AS ledger
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def mirrored(spark: SparkSession, d: str) -> DataFrame:
    """Movements, and of every fifth a copy with the opposite sign on another account; both name a transfer."""
    m = movements(spark, d)
    fifth = F.col("ord") % 5 == 0
    first = m.withColumn("notes", F.when(fifth, F.concat(F.lit("Transferência "), "notes")).otherwise(F.col("notes")))
    copy = m.where(fifth).withColumns({
        "ord": F.col("ord") + 100_000_000, "amount": (-F.col("amount")).cast(MONEY), "notes": F.concat(F.lit("Transferência "), "notes"),
        "financial_account": ((F.col("financial_account").cast("int") + 1) % 25).cast("string"),
    })
    return first.unionByName(copy)


MIRRORED = """mirrored AS (
  SELECT ord, date, amount, counterparty, CASE WHEN ord % 5 = 0 THEN 'Transferência ' || notes ELSE notes END AS notes, financial_account, ledger FROM movements
  UNION ALL SELECT ord + 100000000, date, CAST(-amount AS DECIMAL(18,2)), counterparty, 'Transferência ' || notes, CAST((CAST(financial_account AS INTEGER) + 1) % 25 AS VARCHAR), ledger FROM movements WHERE ord % 5 = 0
)"""


def history(spark: SparkSession, d: str) -> DataFrame:
    """Line items as past entries."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 100_000_000 + F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("ord"), F.to_date("l_shipdate").alias("date"),
        (F.col("l_suppkey") % 50).cast("string").alias("debit_account"), (F.col("l_partkey") % 40).cast("string").alias("credit_account"), F.col("l_extendedprice").cast(MONEY).alias("amount"),
        F.concat("l_returnflag", "l_linestatus").alias("standard_history"), F.concat_ws(" ", "p_name", "p_type").alias("complement"),
    )


HISTORY = """history AS (
  SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS ord, CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey % 50 AS VARCHAR) AS debit_account, CAST(l_partkey % 40 AS VARCHAR) AS credit_account,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_returnflag || l_linestatus AS standard_history, p_name || ' ' || p_type AS complement
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def ledger_entries(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's movements by date with a running balance; every 7th is not printed, every 97th is off by one."""
    m = movements(spark, d)
    w = Window.partitionBy("ledger").orderBy("date", "ord")
    true = F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast(MONEY)
    out = m.select("ledger", F.row_number().over(w).alias("ord"), "date", F.greatest("amount", F.lit(0).cast(MONEY)).alias("inflow"), F.greatest(-F.col("amount"), F.lit(0)).cast(MONEY).alias("outflow"), true.alias("_b"), F.col("ord").alias("key"))
    printed = (F.col("_b") + F.when(F.col("key") % 97 == 0, 1).otherwise(0)).cast(MONEY)
    return out.withColumn("balance", F.when(F.col("key") % 7 != 0, printed)).withColumn("full_balance", printed).drop("_b")


LEDGER = """ledger_entries AS (
  SELECT ledger, ord, date, inflow, outflow, key, CASE WHEN key % 7 <> 0 THEN full_balance END AS balance, full_balance FROM (
    SELECT ledger, CAST(row_number() OVER w AS INTEGER) AS ord, date, greatest(amount, 0) AS inflow, CAST(greatest(-amount, 0) AS DECIMAL(18,2)) AS outflow, ord AS key,
      CAST(sum(amount) OVER (PARTITION BY ledger ORDER BY date, ord ROWS UNBOUNDED PRECEDING) + CASE WHEN ord % 97 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS full_balance
    FROM movements WINDOW w AS (PARTITION BY ledger ORDER BY date, ord))
)"""


def statement_tx(spark: SparkSession, d: str) -> DataFrame:
    """Movements without every fifth, every eleventh twice."""
    m = movements(spark, d).where("ord % 5 <> 0")
    return m.unionByName(m.where("ord % 11 = 0"))


STATEMENT = """statement_tx AS (
  SELECT * FROM movements WHERE ord % 5 <> 0 UNION ALL SELECT * FROM movements WHERE ord % 5 <> 0 AND ord % 11 = 0
)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Events as decisions with a confidence (in hundredths) and whether they were right."""
    e = table(spark, d, "events")
    confidence = F.round(1 - F.least(F.col("value"), F.lit(100.0)) / 400, 2)
    return e.select("event_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("event_id") % 240).cast("int")).alias("date"), confidence.alias("confidence"), ((F.col("event_type") != "error") | (F.col("event_id") % 3 == 0)).alias("correct"), "event_type", "user_id")


SCORES = """scores AS (
  SELECT event_id, CAST(DATE '2024-01-01' + CAST(event_id % 240 AS INTEGER) AS DATE) AS date, round(1 - least(value, 100.0) / 400, 2) AS confidence, (event_type <> 'error') OR event_id % 3 = 0 AS correct, event_type, user_id FROM events
)"""
PLAIN = "trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce({0}, '')), '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g'))"

"""Named queries over the test tables, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import bookkeeping as b
from tallyforge.functions import identity, money, text
from tallyforge.operators import accounts as acc
from tallyforge.operators import layout, matching, models, normalize, reconcile, regression
from tallyforge.plans import engine
from tallyforge.plans import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "monthly_audit"

PERIOD = "1998-06"
#: Parents of the synthetic chart whose accounts count as financial: a few nations by name.
PARENTS = {"bank": "nation_1", "application": "nation_23"}
ROLES = {"receivable": (("building", "machinery"), ("customer",)), "supplier": (("household",),), "none": (("no such word",),)}


def query(sql: str = "", amounts: tuple[str, ...] = (), dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query. Named amounts and dates leave as doubles and texts on both sides, so that values compare alike."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(spark, d).withColumns({c: F.col(c).cast("double") for c in amounts} | {c: F.col(c).cast("string") for c in dates})

        QUERIES[f.__name__] = run if amounts or dates else f
        if sql:
            casts = [f"CAST({c} AS DOUBLE) AS {c}" for c in amounts] + [f"CAST({c} AS VARCHAR) AS {c}" for c in dates]
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql
        return f

    return add


def _with(*views: str) -> str:
    return "WITH " + ", ".join(views) + " "


_ACC = """usable AS (
  SELECT h.* FROM history h WHERE strftime(date, '%Y-%m') < '1998-06'
    AND debit_account IN (SELECT reduced_code FROM chart WHERE reduced_code IS NOT NULL) AND credit_account IN (SELECT reduced_code FROM chart WHERE reduced_code IS NOT NULL)
), activity AS (
  SELECT reduced_code, count(*) AS activity FROM (SELECT debit_account AS reduced_code FROM usable UNION ALL SELECT credit_account FROM usable) GROUP BY 1
)"""


# ---- chart of accounts


@query(_with(v.CHART, v.HISTORY, _ACC) + "SELECT reduced_code, activity FROM activity")
def account_activity(spark, d):
    return acc.activity(acc.usable_history(v.history(spark, d), v.chart(spark, d), PERIOD))


@query(_with(v.CHART, v.HISTORY, _ACC) + "SELECT debit_account, count(*) AS entries, sum(amount) AS amount FROM usable GROUP BY 1", amounts=("amount",))
def usable_history(spark, d):
    rows = acc.usable_history(v.history(spark, d), v.chart(spark, d), PERIOD)
    return rows.groupBy("debit_account").agg(F.count(F.lit(1)).alias("entries"), F.sum("amount").alias("amount"))


_FIN = """financial AS (
  SELECT DISTINCT c.reduced_code, p.kind FROM chart c JOIN (
    SELECT regexp_replace(code, '\\.[^.]*$', '') || '.' AS prefix, kind FROM chart JOIN (VALUES ('bank', 'nation_1'), ('application', 'nation_23')) t(kind, w) ON contains(lower(description), w)
  ) p ON starts_with(c.code, p.prefix) WHERE c.reduced_code IS NOT NULL
)"""


@query(_with(v.CHART, _FIN) + "SELECT * FROM financial")
def financial_accounts(spark, d):
    return acc.financial_accounts(v.chart(spark, d), PARENTS)


@query(
    _with(v.CHART, v.HISTORY, _ACC)
    + """, fits AS (
  SELECT 'receivable' AS role, c.reduced_code, c.ord FROM chart c WHERE reduced_code IS NOT NULL AND (contains(lower(description), 'building') OR contains(lower(description), 'machinery')) AND contains(lower(description), 'customer')
  UNION ALL SELECT 'supplier', c.reduced_code, c.ord FROM chart c WHERE reduced_code IS NOT NULL AND contains(lower(description), 'household')
) SELECT role, reduced_code AS counterpart FROM fits LEFT JOIN activity USING (reduced_code) QUALIFY row_number() OVER (PARTITION BY role ORDER BY coalesce(activity, 0) DESC, ord) = 1"""
)
def account_roles(spark, d):
    chart = v.chart(spark, d)
    return acc.roles(chart, acc.activity(acc.usable_history(v.history(spark, d), chart, PERIOD)), ROLES)


_SEM = """names AS (
  SELECT l.reduced_code, l.ord, l.code, lower(r.description) AS a, lower(n.description) AS b, lower(l.description) AS c FROM chart l
  JOIN chart r ON r.code = split_part(l.code, '.', 1) || '.00.000000' JOIN chart n ON n.code = split_part(l.code, '.', 1) || '.' || split_part(l.code, '.', 2) || '.000000' WHERE l.reduced_code IS NOT NULL
), semantic AS (
  SELECT reduced_code, a || ' > ' || b || ' > ' || c AS path, sha256('chart-description-path.v1' || chr(0) || a || ' > ' || b || ' > ' || c) AS semantic_key FROM names
)"""


@query(_with(v.CHART, _SEM) + "SELECT * FROM semantic")
def semantic_accounts(spark, d):
    return acc.semantic_accounts(v.chart(spark, d))


@query(
    _with(v.CHART, _SEM)
    + ", short AS (SELECT reduced_code, sha256(regexp_replace(path, '#[0-9]{7}', '')) AS semantic_key FROM semantic) SELECT semantic_key, min(reduced_code) AS counterpart FROM short GROUP BY 1 HAVING count(*) = 1"
)
def unique_semantic_keys(spark, d):
    semantic = acc.semantic_accounts(v.chart(spark, d))
    return acc.unique_keys(semantic.withColumn("semantic_key", F.sha2(F.regexp_replace("path", "#[0-9]{7}", ""), 256)))


@query(
    _with(v.CHART)
    + "SELECT key AS account_key, count(DISTINCT lower(description)) AS descriptions FROM (SELECT coalesce(reduced_code, code) AS key, description FROM chart UNION ALL SELECT coalesce(reduced_code, code), CASE WHEN ord % 10 = 0 THEN description || ' b' ELSE upper(description) END FROM chart) GROUP BY 1 HAVING count(DISTINCT lower(description)) > 1"
)
def conflicting_descriptions(spark, d):
    chart = v.chart(spark, d)
    other = chart.withColumn("description", F.when(F.col("ord") % 10 == 0, F.concat("description", F.lit(" b"))).otherwise(F.upper("description")))
    return acc.conflicts(chart.unionByName(other))


@query(
    _with(v.CHART, v.HISTORY, _SEM)
    + """SELECT reject AS reason, count(*) AS rows FROM (
  SELECT CASE WHEN strftime(date, '%Y-%m') >= '1998-06' THEN 'on_or_after_cutoff' WHEN f1 = f2 THEN 'not_single_financial_side' WHEN s.semantic_key IS NULL THEN 'counterpart_not_in_chart' WHEN trim(complement) = '' THEN 'missing_text' ELSE 'eligible_rows' END AS reject
  FROM (SELECT h.*, debit_account IN (SELECT reduced_code FROM semantic WHERE contains(path, 'nation_1')) AS f1, credit_account IN (SELECT reduced_code FROM semantic WHERE contains(path, 'nation_1')) AS f2 FROM history h) x
  LEFT JOIN semantic s ON s.reduced_code = CASE WHEN f1 THEN credit_account ELSE debit_account END) GROUP BY 1"""
)
def training_audit(spark, d):
    semantic = acc.semantic_accounts(v.chart(spark, d))
    rows = models.training_rows(v.history(spark, d), semantic, acc.financial_by_path(semantic, {"bank": "nation_1"}), PERIOD)
    return models.training_audit(rows)


# ---- history and memory


@query(
    _with(v.HISTORY)
    + """, each AS (SELECT debit_account, credit_account, standard_history AS h, count(*) AS n, min(ord) AS first FROM history GROUP BY 1, 2, 3)
SELECT debit_account, credit_account, arg_max(h, {'n': n, 'f': -first}) AS candidate, CAST(max(n) AS DOUBLE) / sum(n) AS probability, CAST(sum(n) AS BIGINT) AS support, count(*) AS alternatives, sum(n) >= 2 AND max(n) = sum(n) AS stable FROM each GROUP BY 1, 2"""
)
def pair_history(spark, d):
    return acc.pair_history(v.history(spark, d))


@query(_with(v.HISTORY) + "SELECT debit_account || ':' || complement AS features, min(credit_account) AS label FROM history GROUP BY 1 HAVING count(DISTINCT credit_account) = 1")
def exact_memory(spark, d):
    rows = v.history(spark, d).withColumn("f", F.concat_ws(":", "debit_account", "complement"))
    return acc.exact_memory(rows, "f", "credit_account")


@query(_with(v.HISTORY) + ", each AS (SELECT standard_history AS label, count(*) AS n, min(ord) AS first FROM history GROUP BY 1) SELECT arg_max(label, {'n': n, 'f': -first}) AS label FROM each")
def majority_label(spark, d):
    return acc.majority(v.history(spark, d), "standard_history")


@query(_with(v.HISTORY) + ", f AS (SELECT *, complement || debit_account AS label FROM history) SELECT label, count(*) AS rows FROM f GROUP BY 1 HAVING count(*) >= 3")
def supported_labels(spark, d):
    rows = v.history(spark, d).withColumn("label", F.concat("complement", "debit_account"))
    return acc.supported(rows, "label", 3).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


# ---- movements


@query(
    _with(v.MOVEMENTS, v.MIRRORED)
    + """, t AS (SELECT * FROM mirrored WHERE contains(lower(strip_accents(notes)), 'transfer')),
pairs AS (SELECT a.ord AS "left", b.ord AS "right" FROM t a JOIN t b ON a.date = b.date AND a.amount = -b.amount AND a.financial_account <> b.financial_account AND a.ord < b.ord)
SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY "left" ORDER BY "right") = 1 AND row_number() OVER (PARTITION BY "right" ORDER BY "left") = 1"""
)
def mirrored_transfers(spark, d):
    m = v.mirrored(spark, d)
    return matching.mirrored_pairs(m.where(b.is_transfer(F.col("notes"))))


@query(
    _with(v.MOVEMENTS, v.STATEMENT)
    + """, a AS (SELECT ledger, date, amount, count(*) AS n FROM movements GROUP BY ALL), b AS (SELECT ledger AS statement, date, amount, count(*) AS n FROM statement_tx GROUP BY ALL)
SELECT ledger, statement, CAST(sum(least(a.n, b.n)) AS BIGINT) AS overlap FROM a JOIN b USING (date, amount) GROUP BY 1, 2"""
)
def statement_overlap(spark, d):
    return matching.overlap(v.movements(spark, d), v.statement_tx(spark, d).withColumnRenamed("ledger", "statement"), "ledger", "statement")


_BEST = """asked AS (
  SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN 'inflow' ELSE 'outflow' END AS direction, CAST(o_orderkey % 60 AS VARCHAR) AS account, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]{3,}')) AS ws
  FROM orders JOIN part ON o_orderkey % 500 = p_partkey
), texts AS (
  SELECT complement, list_distinct(regexp_extract_all(lower(complement), '[a-z]{3,}')) AS hw FROM (SELECT DISTINCT complement FROM history)
), sided AS (
  SELECT ord AS h_ord, 'inflow' AS direction, debit_account AS account, credit_account AS counterpart, standard_history, complement FROM history
  UNION ALL SELECT ord, 'outflow', credit_account, debit_account, standard_history, complement FROM history
), sides AS (
  SELECT h_ord, direction, account, counterpart, standard_history, hw FROM (SELECT * FROM sided QUALIFY row_number() OVER (PARTITION BY direction, account, complement ORDER BY h_ord) = 1) JOIN texts USING (complement)
), pool AS (
  SELECT a.ord, a.ws, s.* EXCLUDE (account, direction) FROM asked a JOIN sides s ON a.direction = s.direction AND a.account = s.account
  UNION ALL SELECT a.ord, a.ws, s.* EXCLUDE (account, direction) FROM asked a JOIN sides s ON a.direction = s.direction AND s.account IN ('1', '2', '3')
  WHERE NOT EXISTS (SELECT 1 FROM sides x WHERE x.direction = a.direction AND x.account = a.account)
), scored AS (
  SELECT *, len(list_intersect(ws, hw)) / CAST(least(len(ws), len(hw)) AS DOUBLE) AS score FROM pool
)"""


@query(_with(v.HISTORY, _BEST) + "SELECT ord, counterpart, standard_history, score FROM scored WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY ord ORDER BY score DESC, h_ord) = 1")
def best_history_match(spark, d):
    """All movements against the whole history, by the words alone."""
    return matching.best_history(*_best_inputs(spark, d), with_sequence=False)


def _best_inputs(spark, d):
    orders, part = v.table(spark, d, "orders"), v.table(spark, d, "part")
    asked = orders.join(part, F.col("o_orderkey") % 500 == F.col("p_partkey")).select(
        F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 2 == 0, "inflow").otherwise("outflow").alias("direction"),
        (F.col("o_orderkey") % 60).cast("string").alias("financial_account"), F.concat_ws(" ", "p_name", "p_type").alias("text"),
    )
    return asked, v.history(spark, d), spark.createDataFrame([("1",), ("2",), ("3",)], "reduced_code string")


@query()
def similarity_match(spark, d):
    """With the sequence ratio, which SQL does not express."""
    asked, history, financial = _best_inputs(spark, d)
    return matching.best_history(asked, history, financial)


_MONTH = """, m AS (SELECT * FROM mirrored WHERE strftime(date, '%Y-%m') = '1998-06' AND amount <> 0), t AS (SELECT * FROM m WHERE contains(lower(strip_accents(notes)), 'transfer')),
pairs AS (SELECT a.ord AS x, b.ord AS y FROM t a JOIN t b ON a.date = b.date AND a.amount = -b.amount AND a.financial_account <> b.financial_account AND a.ord < b.ord
  QUALIFY row_number() OVER (PARTITION BY a.ord ORDER BY b.ord) = 1 AND row_number() OVER (PARTITION BY b.ord ORDER BY a.ord) = 1),
left_over AS (SELECT ord, CASE WHEN amount > 0 THEN 'inflow' ELSE 'outflow' END AS direction, financial_account AS account, abs(amount) AS amount, list_distinct(regexp_extract_all(lower(counterparty || ' ' || notes), '[a-z]{3,}')) AS ws
  FROM m WHERE ord NOT IN (SELECT x FROM pairs) AND ord NOT IN (SELECT y FROM pairs)),
sides AS (SELECT ord AS h_ord, 'inflow' AS direction, debit_account AS account, credit_account AS counterpart, list_distinct(regexp_extract_all(lower(complement), '[a-z]{3,}')) AS hw FROM usable
  UNION ALL SELECT ord, 'outflow', credit_account, debit_account, list_distinct(regexp_extract_all(lower(complement), '[a-z]{3,}')) FROM usable),
scored AS (SELECT l.ord, s.counterpart, s.h_ord, len(list_intersect(ws, hw)) / CAST(least(len(ws), len(hw)) AS DOUBLE) AS score FROM left_over l JOIN sides s USING (direction, account)),
best AS (SELECT ord, counterpart, score FROM scored WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY ord ORDER BY score DESC, h_ord) = 1),
known AS (SELECT debit_account AS d, credit_account AS c, count(*) AS support FROM usable GROUP BY 1, 2 HAVING count(DISTINCT standard_history) = 1 AND count(*) >= 2),
chosen AS (SELECT l.*, b.counterpart, b.score, CASE WHEN direction = 'inflow' THEN l.account ELSE b.counterpart END AS d, CASE WHEN direction = 'inflow' THEN b.counterpart ELSE l.account END AS c FROM left_over l LEFT JOIN best b USING (ord)),
status AS (SELECT 'LANCAR' AS status, 'transferencia_espelhada' AS reason, abs(m.amount) AS amount FROM pairs JOIN m ON m.ord = x
  UNION ALL SELECT CASE WHEN score IS NULL THEN 'REVISAR CONTA' ELSE 'LANCAR' END, CASE WHEN score IS NULL THEN 'padrao_por_direcao' ELSE 'historico_textual:' || CAST(round_even(score, 2) AS DECIMAL(4,2)) END || CASE WHEN support IS NULL THEN '' ELSE '|hist_contas:' || support || 'x' END, amount
  FROM chosen LEFT JOIN known USING (d, c))"""


@query(_with(v.MOVEMENTS, v.MIRRORED, v.CHART, v.HISTORY, _ACC) + _MONTH + "SELECT status, reason, count(*) AS entries, sum(amount) AS amount FROM status GROUP BY 1, 2", amounts=("amount",))
def monthly_audit_words(spark, d):
    """The whole cascade over a month of movements and the whole history, resemblance by the words alone, which SQL expresses."""
    return _counted(_entries(spark, d, v.history(spark, d), with_sequence=False))


@query(amounts=("amount",))
def monthly_audit(spark, d):
    """The whole cascade over a month of movements: transfers, rules, history, defaults; the sequence ratio in it is beyond SQL."""
    return _counted(_entries(spark, d, v.history(spark, d)))


def _counted(entries):
    return entries.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("entries"), F.sum("amount").alias("amount"))


def _entries(spark, d, history, with_sequence=True):
    moved = v.mirrored(spark, d).select(
        "ord", F.col("ord").cast("string").alias("id"), "date", "amount", "counterparty", "notes", F.lit(None).cast("string").alias("document"), "financial_account",
        F.concat(F.lit("account "), "financial_account").alias("financial_name"), F.col("ord").cast("int").alias("source_row"),
    )
    base = engine.Base(v.chart(spark, d), history, moved)
    return engine.generate(base, PERIOD, with_sequence=with_sequence)


@query()
def monthly_entries(spark, d):
    """The entries with history of the months before, similarity included."""
    m = v.mirrored(spark, d).select("ord", F.col("ord").cast("string").alias("id"), "date", "amount", "counterparty", "notes", F.lit(None).cast("string").alias("document"), "financial_account", F.lit(None).cast("string").alias("financial_name"), F.lit(1).alias("source_row"))
    return engine.generate(engine.Base(v.chart(spark, d), v.history(spark, d), m), PERIOD).drop("source_rows")


@query(
    _with(v.MOVEMENTS)
    + "SELECT notes, direction, count(*) AS movements, sum(amount) AS total FROM (SELECT *, CASE WHEN amount > 0 THEN 'inflow' ELSE 'outflow' END AS direction FROM movements WHERE strftime(date, '%Y-%m') = '1998-06' AND amount <> 0) GROUP BY 1, 2",
    amounts=("total",),
)
def period_movements(spark, d):
    m = engine.of_period(v.movements(spark, d), PERIOD).withColumn("direction", F.when(F.col("amount") > 0, "inflow").otherwise("outflow"))
    return m.groupBy("notes", "direction").agg(F.count(F.lit(1)).alias("movements"), F.sum("amount").alias("total"))


@query(
    _with(v.MOVEMENTS)
    + """, r AS (SELECT ord, CASE WHEN notes LIKE '1%' THEN 'a' WHEN notes LIKE '5%' THEN 'b' ELSE 'c' END AS reason FROM movements) SELECT reason, count(*) AS entries, min(ord) AS first FROM r GROUP BY 1"""
)
def review_reasons(spark, d):
    r = v.movements(spark, d).select("ord", F.when(F.startswith("notes", F.lit("1")), "a").when(F.startswith("notes", F.lit("5")), "b").otherwise("c").alias("reason"), F.lit("REVISAR CONTA").alias("status"))
    return engine.review_queue(r)


# ---- balances


@query(
    _with(v.MOVEMENTS, v.LEDGER)
    + """, one AS (SELECT CAST(floor(ledger / 10) AS BIGINT) AS sheet, row_number() OVER (PARTITION BY floor(ledger / 10) ORDER BY ledger, ord) AS ord, CASE WHEN key % 3 = 0 THEN CAST(ledger AS VARCHAR) END AS account, date, inflow, outflow, full_balance AS balance FROM ledger_entries),
carried AS (SELECT *, last_value(account IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lag(date) OVER w AS d0, lag(balance) OVER w AS b0 FROM one WINDOW w AS (PARTITION BY sheet ORDER BY ord)),
broken AS (SELECT *, CASE WHEN d0 IS NULL THEN NULL WHEN account <> before THEN 'account_changed' WHEN date < d0 THEN 'date_sequence_restarted' WHEN balance - inflow + outflow = 0 AND b0 <> 0 THEN 'zero_opening_balance_restarted' END AS reason FROM carried)
SELECT sheet, CAST(ord AS INTEGER) AS ord, reason, CAST(sum(CASE WHEN reason IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY sheet ORDER BY ord) + 1 AS BIGINT) AS segment FROM broken"""
)
def ledger_segments(spark, d):
    e = v.ledger_entries(spark, d).withColumn("sheet", F.floor(F.col("ledger") / 10))
    w = Window.partitionBy("sheet").orderBy("ledger", "ord")
    one = e.select("sheet", F.row_number().over(w).alias("ord"), F.when(F.col("key") % 3 == 0, F.col("ledger").cast("string")).alias("account"), "date", "inflow", "outflow", F.col("full_balance").alias("balance"))
    return reconcile.segments(one, "sheet").select("sheet", "ord", "reason", "segment")


@query(
    _with(v.MOVEMENTS, v.LEDGER)
    + "SELECT ledger, ord, full_balance AS actual, CAST(expected AS DECIMAL(18,2)) AS expected FROM (SELECT *, coalesce(lag(full_balance) OVER w, first_value(full_balance - inflow + outflow) OVER w) + inflow - outflow AS expected FROM ledger_entries WINDOW w AS (PARTITION BY ledger ORDER BY ord)) WHERE expected <> full_balance",
    amounts=("actual", "expected"),
)
def balance_mismatches(spark, d):
    e = v.ledger_entries(spark, d).withColumn("balance", F.col("full_balance"))
    out = reconcile.balance_mismatches(e, ["ledger"])
    return out.select("ledger", "ord", F.col("balance").alias("actual"), F.col("expected_balance").cast(money.MONEY).alias("expected"))


@query(
    _with(v.MOVEMENTS, v.LEDGER)
    + """, i AS (SELECT *, count(balance) OVER (PARTITION BY ledger ORDER BY ord) AS g FROM ledger_entries)
SELECT ledger, ord, CAST(coalesce(first_value(balance) OVER (PARTITION BY ledger, g ORDER BY ord), 0) + sum(CASE WHEN balance IS NULL THEN inflow - outflow ELSE 0 END) OVER (PARTITION BY ledger, g ORDER BY ord) AS DECIMAL(18,2)) AS running FROM i""",
    amounts=("running",),
)
def running_balances(spark, d):
    return reconcile.running_balance(v.ledger_entries(spark, d), "ledger").select("ledger", "ord", "running")


_DAILY = """balances AS (
  SELECT ledger, date, arg_max(full_balance, ord) AS balance, max(ord) AS ord FROM ledger_entries WHERE ledger % 13 <> 0 OR ord > 2 GROUP BY 1, 2
), heads AS (
  SELECT ledger, CASE WHEN ledger % 17 <> 0 THEN arg_min(full_balance - inflow + outflow, ord) END AS initial_balance, CASE WHEN ledger % 19 <> 0 THEN arg_max(full_balance, ord) END AS final_balance FROM ledger_entries GROUP BY 1
)"""


def _daily(spark, d):
    e = v.ledger_entries(spark, d)
    tx = e.select("ledger", "ord", "date", (F.col("inflow") - F.col("outflow")).cast(money.MONEY).alias("amount"))
    printed = reconcile.last_per_date(e.where("ledger % 13 <> 0 or ord > 2").withColumn("balance", F.col("full_balance")), "ledger")
    heads = e.groupBy("ledger").agg(
        F.when(F.col("ledger") % 17 != 0, F.min_by(F.col("full_balance") - F.col("inflow") + F.col("outflow"), "ord")).alias("initial_balance"), F.when(F.col("ledger") % 19 != 0, F.max_by("full_balance", "ord")).alias("final_balance")
    )
    return heads, tx, printed


@query(_with(v.MOVEMENTS, v.LEDGER, _DAILY) + "SELECT ledger, date, balance, ord FROM balances", amounts=("balance",), dates=("date",))
def last_balance_per_date(spark, d):
    return _daily(spark, d)[2]


@query(
    _with(v.MOVEMENTS, v.LEDGER, _DAILY)
    + """, moved AS (SELECT ledger, date, sum(inflow - outflow) AS moved FROM ledger_entries GROUP BY 1, 2),
known AS (SELECT b.*, coalesce(lag(balance) OVER (PARTITION BY b.ledger ORDER BY ord), initial_balance) + coalesce(moved, 0) AS expected FROM balances b JOIN heads USING (ledger) LEFT JOIN moved m ON m.ledger = b.ledger AND m.date = b.date),
broken AS (SELECT ledger, arg_min(date, ord) AS date FROM known WHERE expected <> balance GROUP BY 1),
missing AS (SELECT ledger, arg_min(date, ord) AS date FROM ledger_entries e WHERE NOT EXISTS (SELECT 1 FROM balances b WHERE b.ledger = e.ledger AND b.date = e.date) GROUP BY 1),
last AS (SELECT ledger, arg_max(balance, ord) AS balance FROM balances GROUP BY 1),
coded AS (SELECT h.ledger, CASE WHEN initial_balance IS NULL THEN 'bank_initial_balance_missing' WHEN m.date IS NOT NULL THEN 'bank_daily_balance_missing' WHEN b.date IS NOT NULL THEN 'bank_balance_mismatch'
  WHEN final_balance IS NULL THEN 'bank_final_balance_missing' WHEN final_balance <> l.balance THEN 'bank_final_balance_mismatch' END AS code, m.date AS md, b.date AS bd
  FROM heads h LEFT JOIN missing m USING (ledger) LEFT JOIN broken b USING (ledger) LEFT JOIN last l USING (ledger))
SELECT ledger, code, CASE code WHEN 'bank_daily_balance_missing' THEN md WHEN 'bank_balance_mismatch' THEN bd END AS date FROM coded WHERE code IS NOT NULL""",
    dates=("date",),
)
def first_divergence(spark, d):
    return reconcile.first_divergence(*_daily(spark, d), "ledger")


@query(_with(v.MOVEMENTS, v.LEDGER, _DAILY) + "SELECT ledger, arg_min(date, ord) AS date, min(ord) AS ord FROM ledger_entries e WHERE NOT EXISTS (SELECT 1 FROM balances b WHERE b.ledger = e.ledger AND b.date = e.date) GROUP BY 1", dates=("date",))
def dates_without_balance(spark, d):
    _, tx, printed = _daily(spark, d)
    return matching.without_balance(tx, printed, "ledger")


@query(_with(v.MOVEMENTS) + "SELECT financial_account, date, sum(amount) AS moved, count(*) AS transaction_count FROM movements GROUP BY 1, 2", amounts=("moved",), dates=("date",))
def daily_sums(spark, d):
    return reconcile.daily_sums(v.movements(spark, d), "financial_account")


@query(
    _with(v.MOVEMENTS, v.LEDGER)
    + "SELECT ledger, min(date) AS period_start, max(date) AS period_end, CAST(arg_min(full_balance - inflow + outflow, ord) AS DECIMAL(18,2)) AS initial_balance, arg_max(full_balance, ord) AS final_balance, count(*) AS entries FROM ledger_entries GROUP BY 1",
    amounts=("initial_balance", "final_balance"), dates=("period_start", "period_end"),
)
def ledger_headers(spark, d):
    out = reconcile.ledgers(v.ledger_entries(spark, d).withColumn("balance", F.col("full_balance")), ["ledger"])
    return out.withColumn("initial_balance", F.col("initial_balance").cast(money.MONEY))


@query(
    _with(v.MOVEMENTS, v.LEDGER)
    + """, a AS (SELECT ledger, row_number() OVER (PARTITION BY ledger ORDER BY ord) AS position, date, full_balance FROM ledger_entries), b AS (SELECT ledger, row_number() OVER (PARTITION BY ledger ORDER BY ord) AS position, date, CASE WHEN key % 10 = 0 THEN NULL ELSE full_balance END AS full_balance FROM ledger_entries WHERE key % 29 <> 0),
x AS (SELECT a.ledger, a.position, unnest([{'f': 'date', 'l': CAST(a.date AS VARCHAR), 'r': CAST(b.date AS VARCHAR)}, {'f': 'full_balance', 'l': CAST(a.full_balance AS VARCHAR), 'r': CAST(b.full_balance AS VARCHAR)}]) AS p FROM a JOIN b USING (ledger, position))
SELECT ledger, CAST(position AS INTEGER) AS position, p.f AS field, p.l AS left_value, p.r AS right_value FROM x WHERE p.l IS DISTINCT FROM p.r"""
)
def positional_differences(spark, d):
    a = v.ledger_entries(spark, d)
    c = a.where("key % 29 <> 0").withColumn("full_balance", F.when(F.col("key") % 10 != 0, F.col("full_balance")))
    return matching.compared(a, c, ["date", "full_balance"], ["ledger"])


@query(
    _with(v.MOVEMENTS, v.LEDGER)
    + "SELECT ledger, count(*) AS left_count, count(*) FILTER (key % 29 <> 0) AS right_count FROM ledger_entries GROUP BY 1 HAVING count(*) <> count(*) FILTER (key % 29 <> 0)"
)
def count_differences(spark, d):
    a = v.ledger_entries(spark, d)
    return matching.count_mismatch(a, a.where("key % 29 <> 0"), ["ledger"])


# ---- scalars


@query(
    f"""SELECT doc_id, length({v.PLAIN.format("text")}) AS plain_chars, sha256({v.PLAIN.format("text")}) AS plain_sha, len(list_filter(list_distinct(regexp_extract_all({v.PLAIN.format("text")}, '[a-z]{{3,}}')), lambda w: NOT list_contains(['para','com','por','dos','das','uma','ltda','eireli','brasil','pagamento','recebimento','nota','fiscal','fatura','valor','competencia','numero','mes'], w))) AS n_words FROM documents"""
)
def plain_words(spark, d):
    t = F.col("text")
    return v.table(spark, d, "documents").select("doc_id", F.length(text.plain(t)).alias("plain_chars"), F.sha2(text.plain(t), 256).alias("plain_sha"), F.size(text.words(t)).alias("n_words"))


@query("SELECT o_orderkey, upper(regexp_replace(strip_accents(s), '[^A-Za-z0-9]', '', 'g')) AS folded FROM (SELECT o_orderkey, 'Açúcar nº ' || o_orderkey || ' – ' || o_orderpriority AS s FROM orders)")
def folded_titles(spark, d):
    s = F.concat(F.lit("Açúcar nº "), F.col("o_orderkey").cast("string"), F.lit(" – "), "o_orderpriority")
    return v.table(spark, d, "orders").select("o_orderkey", F.regexp_replace(F.upper(F.regexp_replace(text.without_accents(s), "[^A-Za-z0-9]", "")), "[^A-Z0-9]", "").alias("folded"))


@query(
    r"""WITH t AS (SELECT o_orderkey, 'PIX ' || strftime(o_orderdate, '%d/%m/%Y') || ' NF ' || o_orderkey || ' R$ ' || replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') || ' ref ' || strftime(o_orderdate, '%m/%Y') || ' id ' || (o_custkey + 1000) AS s FROM orders)
SELECT o_orderkey, 'direcao_inflow ' || trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(s),
 '\b\d{1,2}[/.-]\d{1,2}[/.-](?:\d{4}|\d{2})\b|\b\d{4}-\d{2}-\d{2}\b', ' data ', 'g'), '\b(?:0?[1-9]|1[0-2])[/.-](?:\d{4}|\d{2})\b', ' competencia ', 'g'),
 '(?:r\$\s*)?\b\d+(?:\.\d{3})*,\d{2}\b|r\$\s*\d+(?:\.\d{2})?\b', ' valor ', 'g'), '\b((?:nf|nfe|nf-e|fat|fatura|nota)\s*[.:#-]?\s*)\d+\b', '\1 numero ', 'g'), '\b\d{4,}\b', ' numero ', 'g'), '\s+', ' ', 'g')) AS features FROM t"""
)
def masked_features(spark, d):
    o = v.table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    s = F.concat(
        F.lit("PIX "), F.date_format(day, "dd/MM/yyyy"), F.lit(" NF "), F.col("o_orderkey").cast("string"), F.lit(" R$ "), F.replace(F.col("o_totalprice").cast(money.MONEY).cast("string"), F.lit("."), F.lit(",")),
        F.lit(" ref "), F.date_format(day, "MM/yyyy"), F.lit(" id "), (F.col("o_custkey") + 1000).cast("string"),
    )
    return o.select("o_orderkey", text.global_features(s, F.lit("inflow")).alias("features"))


@query(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) AS b, CAST(o_orderdate AS DATE) AS c, CAST(NULL AS DATE) AS bad, CAST(o_totalprice AS DECIMAL(18,2)) AS br, CAST(-CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS negative FROM orders""",
    amounts=("br", "negative"), dates=("a", "b", "c", "bad"),
)
def parsed_values(spark, d):
    o = v.table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    amount = F.col("o_totalprice").cast(money.MONEY)
    # 1.234.567,89: dots before each group of three digits, a comma before the cents
    br = F.concat(F.regexp_replace(F.floor(amount).cast("string"), r"(?<=\d)(?=(\d{3})+$)", "."), F.lit(","), F.substring(F.concat(F.lit("0"), (F.floor(amount * 100) % 100).cast("string")), -2, 2))
    return o.select(
        "o_orderkey", money.parse_date(F.date_format("day", "yyyy-MM-dd")).alias("a"), money.parse_date(F.date_format("day", "d/M/yyyy")).alias("b"), money.parse_date(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T01:02:03"))).alias("c"),
        money.parse_date(F.lit("31/02/2024")).alias("bad"), money.parse_money(F.concat(F.lit("R$ "), br)).alias("br"), money.parse_money(F.concat(F.lit("-"), amount.cast("string"))).alias("negative"),
    )


@query(
    r"""WITH k AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + 123456789 AS VARCHAR), 12, '1') AS s, lpad(CAST(o_orderkey * 104729 + 17 AS VARCHAR), 9, '3') AS p FROM orders),
d1 AS (SELECT *, CAST(list_sum(list_transform(range(1, 13), lambda i: CAST(s[i] AS INTEGER) * ([5,4,3,2,9,8,7,6,5,4,3,2])[i])) % 11 AS INTEGER) AS r FROM k WHERE length(s) = 12 AND length(p) = 9),
d2 AS (SELECT *, CASE WHEN r < 2 THEN 0 ELSE 11 - r END AS a FROM d1),
d3 AS (SELECT *, CAST((list_sum(list_transform(range(1, 13), lambda i: CAST(s[i] AS INTEGER) * ([6,5,4,3,2,9,8,7,6,5,4,3])[i])) + a * 2) % 11 AS INTEGER) AS q FROM d2),
d4 AS (SELECT o_orderkey, s, p, a, CASE WHEN q < 2 THEN 0 ELSE 11 - q END AS b FROM d3)
SELECT o_orderkey, s || a || b AS cnpj, TRUE AS valid, FALSE AS wrong, s[1:2] || '.' || s[3:5] || '.' || s[6:8] || '/' || s[9:12] || '-' || a || b AS formatted FROM d4"""
)
def company_ids(spark, d):
    s = F.lpad((F.col("o_orderkey") * 7919 + 123456789).cast("string"), 12, "1")
    p = F.lpad((F.col("o_orderkey") * 104729 + 17).cast("string"), 9, "3")
    o = v.table(spark, d, "orders").select("o_orderkey", s.alias("s"), p.alias("p")).where("length(s) = 12 and length(p) = 9")
    tried = o.withColumn("cnpj", F.concat("s", money.company_digits(F.col("s"))))
    wrong = F.concat(F.substring("cnpj", 1, 13), ((F.substring("cnpj", 14, 1).cast("int") + 1) % 10).cast("string"))
    return tried.select("o_orderkey", "cnpj", money.valid_cnpj(F.col("cnpj")).alias("valid"), money.valid_cnpj(wrong).alias("wrong"), identity.format_tax_id(F.col("cnpj")).alias("formatted"))


@query(
    """SELECT o_orderkey, '12.345.678/0001-' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS masked, '12.345.678/9012-' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS labelled, CAST(NULL AS VARCHAR) AS phone,
 'PIX ENVIADO' AS description, CAST(10000 + o_orderkey % 90000 AS VARCHAR) AS document, 'ACME ' || o_orderkey AS party FROM orders"""
)
def printed_identities(spark, d):
    two = F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")
    split = identity.split_document(F.concat(F.lit("PIX ENVIADO "), (10000 + F.col("o_orderkey") % 90000).cast("string")))
    return v.table(spark, d, "orders").select(
        "o_orderkey", identity.extract_tax_id(F.lit("nothing here"), F.concat(F.lit("Pago a 12.345.678/0001-"), two)).alias("masked"),
        identity.extract_tax_id(F.concat(F.lit("CNPJ: 123456789012"), two)).alias("labelled"), identity.extract_tax_id(F.lit("(11) 91234-5678")).alias("phone"),
        split["description"].alias("description"), split["document"].alias("document"), identity.party_of(F.concat(F.lit("REMET. ACME "), F.col("o_orderkey").cast("string"))).alias("party"),
    )


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'PAGAMENTO PIX' ELSE 'RECEBIMENTO PIX' END || ' - ' || upper(c_name) || CASE WHEN contains(c_name, CAST(o_orderkey AS VARCHAR)) THEN '' ELSE ' - DOC ' || o_orderkey END AS history,
  c_name || ' - Pix recebido - ' || o_orderkey AS plain, o_orderkey % 3 = 0 AS compound FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def complements(spark, d):
    o = v.table(spark, d, "orders").join(v.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    party = F.concat(F.lit("00123-"), "c_name")
    amount = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    doc = F.col("o_orderkey").cast("string")
    taxes = F.when(F.col("o_orderkey") % 3 == 0, "ICMS e IPI 06/98").otherwise("ICMS 06/98")
    return o.select("o_orderkey", b.history_complement(party, F.lit("Pix recebido"), F.concat(F.lit(""), doc), amount).alias("history"), b.complement(party, F.lit("Pix recebido"), doc).alias("plain"), b.is_compound(taxes).alias("compound"))


# ---- layouts


@query(
    """WITH docs AS (SELECT p_partkey AS doc, [c FOR c IN ['DATA','LANCAMENTO','VALOR','SALDO','RAZAOSOCIAL','CPFCNPJ','CREDITO','DEBITO','DCTO','ENTRADA','SAIDA'] IF (p_partkey * 31 + length(c) * 17 + ascii(c)) % 3 <> 0] AS titles FROM part),
recipes AS (SELECT * FROM (VALUES (0, 'itau-spreadsheet-bank-statement-v1', ['DATA','LANCAMENTO','RAZAOSOCIAL','CPFCNPJ','VALOR','SALDO']), (1, 'itau-current-account-spreadsheet-v1', ['DATA','LANCAMENTO','VALORR','SALDOR']),
 (2, 'bradesco-net-empresa-xls-v1', ['DATA','LANCAMENTO','DCTO','CREDITO','DEBITO','SALDO']), (3, 'cash-ledger-spreadsheet-v1', ['DATA','EMISSAO','DOCUMENTO','CLIENTEFORNECEDOR','ANOTACOES','ENTRADA','SAIDA','SALDO']),
 (4, 'itau-digital-bank-statement-v1', ['DATA','LANCAMENTO','VALOR','SALDO']), (5, 'bradesco-bank-statement-v1', ['DATA','LANCAMENTO','CREDITO','DEBITO','SALDO']), (6, 'cash-ledger-report-v1', ['DATA','ENTRADA','SAIDA','SALDO'])) t(ord, id, headers)),
scored AS (SELECT doc, ord, id, CASE WHEN len(titles) > 0 THEN len(list_intersect(titles, headers)) / CAST(len(list_distinct(list_concat(titles, headers))) AS DOUBLE) ELSE 0 END AS similarity FROM docs, recipes)
SELECT doc, id AS recipe, similarity FROM scored WHERE similarity >= 0.4 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY similarity DESC, ord) = 1"""
)
def recipe_match(spark, d):
    names = ["DATA", "LANCAMENTO", "VALOR", "SALDO", "RAZAOSOCIAL", "CPFCNPJ", "CREDITO", "DEBITO", "DCTO", "ENTRADA", "SAIDA"]
    keep = [F.when((F.col("p_partkey") * 31 + len(c) * 17 + ord(c[0])) % 3 != 0, F.lit(c)) for c in names]
    docs = v.table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.filter(F.array(*keep), lambda c: c.isNotNull()).alias("titles"))
    return layout.best_recipe(docs, layout.recipe_table(spark), 0.4)


_WORDS = """words AS (
  SELECT l_orderkey AS doc, 1 AS page, l_linenumber * 100000 + l_partkey AS ord, l_returnflag || CAST(l_partkey AS VARCHAR) AS text, CAST(l_suppkey % 100 AS DOUBLE) AS x0, CAST(l_quantity AS DOUBLE) AS top FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY l_suppkey, l_quantity, l_extendedprice) = 1
)"""


def _words(spark, d):
    line = v.table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_suppkey", "l_quantity", "l_extendedprice")
    one = line.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return one.select(
        F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("ord"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"),
        (F.col("l_suppkey") % 100).cast("double").alias("x0"), F.col("l_quantity").cast("double").alias("top"),
    )


@query(
    "WITH RECURSIVE "
    + _WORDS
    + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY top, x0, ord, text) AS n FROM words),
fold(doc, page, n, anchor, line) AS (SELECT doc, page, n, top, 1 FROM numbered WHERE n = 1
  UNION ALL SELECT w.doc, w.page, w.n, CASE WHEN abs(w.top - f.anchor) > 2 THEN w.top ELSE f.anchor END, CASE WHEN abs(w.top - f.anchor) > 2 THEN f.line + 1 ELSE f.line END FROM fold f JOIN numbered w ON w.doc = f.doc AND w.page = f.page AND w.n = f.n + 1)
SELECT doc, page, CAST(line AS INTEGER) AS line, min(anchor) AS top, string_agg(text, ' ' ORDER BY x0, text) AS text FROM fold JOIN numbered USING (doc, page, n) GROUP BY 1, 2, 3"""
)
def word_lines(spark, d):
    return layout.lines(_words(spark, d))


@query("WITH " + _WORDS + ", bands AS (SELECT * FROM (VALUES ('date', 0.0, 20.0), ('description', 20.0, 60.0), ('amount', 60.0, 90.0)) t(field, lo, hi)) SELECT field, count(*) AS words FROM words LEFT JOIN bands ON x0 + 2 >= lo AND x0 + 2 < hi GROUP BY 1")
def banded_words(spark, d):
    bands = spark.createDataFrame([("date", 0.0, 20.0), ("description", 20.0, 60.0), ("amount", 60.0, 90.0)], "field string, left double, right double")
    words = _words(spark, d).withColumn("x1", F.col("x0") + 4)
    return layout.banded(words, bands).groupBy("field").agg(F.count(F.lit(1)).alias("words"))


@query(
    """SELECT o_orderkey AS doc, CAST(o_orderkey % 5 + 2 AS INTEGER) AS row_number, CAST(o_orderdate AS DATE) AS date, CAST(o_totalprice AS DECIMAL(18,2)) * (CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) AS amount,
  CASE WHEN o_orderstatus = 'F' THEN 'debit' ELSE 'credit' END AS transaction_type FROM orders""",
    amounts=("amount",), dates=("date",),
)
def statement_from_cells(spark, d):
    """Sheets with a title row and one movement each, through titles, header, records and the family's normaliser."""
    o = v.dealt(spark, d, "orders").withColumn("r", (F.col("o_orderkey") % 5 + 2).cast("int"))
    price = F.replace(F.col("o_totalprice").cast(money.MONEY).cast("string"), F.lit("."), F.lit(","))
    cell = lambda row, col, value: F.struct(row.alias("row_number"), F.lit(col).alias("column"), value.alias("value"))
    one = F.lit(1)
    cells = F.array(
        cell(one, 1, F.lit("Data")), cell(one, 2, F.lit("Lançamento")), cell(one, 3, F.lit("Crédito")), cell(one, 4, F.lit("Débito")),
        cell(F.col("r"), 1, F.date_format("o_orderdate", "dd/MM/yyyy")), cell(F.col("r"), 2, F.col("o_orderpriority")),
        cell(F.col("r"), 3, F.when(F.col("o_orderstatus") != "F", price)), cell(F.col("r"), 4, F.when(F.col("o_orderstatus") == "F", price)),
    )
    null = F.lit(None).cast("string")
    cells = o.select(F.col("o_orderkey").alias("doc"), F.lit(0).alias("sheet_ord"), F.inline(cells)).withColumns({"formula": null, "calculated_value": null})
    rows = layout.mapped_rows(cells, layout.alias_table(spark))
    header = layout.first_header(rows).where(layout.family_of(F.col("columns")) == "bank_statement")
    out = normalize.transactions(normalize.statement_rows(normalize.records(cells, header)))
    return out.select("doc", F.col("ord").alias("row_number"), "date", "amount", "transaction_type")


# ---- models and gates


@query(
    _with(v.SCORES)
    + """, steps AS (SELECT confidence, count(*) AS n, sum(CAST(correct AS INTEGER)) AS r FROM scores GROUP BY 1), cum AS (SELECT confidence, sum(n) OVER (ORDER BY confidence DESC) AS accepted, sum(r) OVER (ORDER BY confidence DESC) AS good FROM steps),
ok AS (SELECT confidence, accepted, CAST(good AS DOUBLE) / accepted AS precision FROM cum WHERE accepted >= 20 AND CAST(good AS DOUBLE) / accepted >= 0.86)
SELECT 0.86 AS target_precision, (SELECT min(confidence) FROM ok) AS threshold, CAST(coalesce((SELECT arg_min(accepted, confidence) FROM ok), 0) AS BIGINT) AS accepted, (SELECT arg_min(precision, confidence) FROM ok) AS precision, coalesce((SELECT arg_min(accepted, confidence) FROM ok), 0) / CAST(count(*) AS DOUBLE) AS coverage, count(*) AS observations FROM scores"""
)
def calibrated_threshold(spark, d):
    return models.calibrated(v.scores(spark, d), 0.86)


@query(
    _with(v.SCORES)
    + """, g AS (SELECT unnest([0.80, 0.85, 0.90, 0.95, 0.98, 1.00]) AS gate), p AS (SELECT DISTINCT strftime(date, '%Y-%m') AS period FROM scores),
ok AS (SELECT p.period, CAST(gate AS DOUBLE) AS gate, count(*) FILTER (confidence >= gate) AS n, count(*) FILTER (confidence >= gate AND correct) AS r FROM p CROSS JOIN g LEFT JOIN scores s ON strftime(s.date, '%Y-%m') < p.period GROUP BY 1, 2)
SELECT period, coalesce(min(gate) FILTER (n >= 20 AND CAST(r AS DOUBLE) / n >= 0.8), 1.0) AS gate FROM ok GROUP BY 1"""
)
def prequential_gates(spark, d):
    return models.prequential_gates(v.scores(spark, d), 0.8)


@query(
    """WITH docs AS (SELECT p_partkey AS doc, regexp_extract_all(lower(p_name || ' ' || p_type), '\\b\\w\\w+\\b') AS ws FROM part), terms AS (SELECT doc, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM docs),
counts AS (SELECT doc, term, count(*) AS tf FROM terms GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM counts GROUP BY 1 HAVING count(*) >= 2), n AS (SELECT count(*) AS n FROM docs),
w AS (SELECT doc, term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS weight FROM counts JOIN df USING (term), n)
SELECT doc, term, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc)), 6) AS weight FROM w"""
)
def tfidf_weights(spark, d):
    docs = v.dealt(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.concat_ws(" ", "p_name", "p_type").alias("t"))
    return models.tfidf(docs, "doc", models.word_ngrams(F.col("t"))).withColumn("weight", F.round("weight", 6))


@query()
def classifier_metrics(spark, d):
    """Trained on history before a cut, tested behind it; the optimiser is Spark's, so there is no SQL for it."""
    rows = v.history(spark, d).select("ord", "date", F.col("standard_history").alias("label"), text.local_features(F.col("complement"), F.lit("inflow"), F.col("debit_account")).alias("features_text"))
    train, test, _ = models.temporal_split(rows)
    return models.metrics(models.predict_texts(models.fit(train), test))


@query(_with(v.SCORES) + "SELECT count(*) AS rows, avg(CAST(correct AS INTEGER)) AS top_1, avg(CAST(correct OR user_id % 2 = 0 AS INTEGER)) AS top_3, 1.0 AS seen, round(avg(confidence), 6) AS mean_confidence FROM scores")
def model_metrics(spark, d):
    s = v.scores(spark, d)
    ranked = F.when(F.col("correct"), F.array(F.lit("a"), F.lit("b"))).when(F.col("user_id") % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("c")))
    return models.metrics(s.select(F.lit("a").alias("label"), ranked.alias("ranked"), "confidence")).withColumn("mean_confidence", F.round("mean_confidence", 6))


# ---- regression


def _files(spark, d):
    docs = v.table(spark, d, "documents")
    return docs.select(F.concat(F.lit("Dir/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, ".PDF").otherwise(".txt")).alias("path"), F.sha2("text", 256).alias("sha256"))


_FILES = "files AS (SELECT 'Dir/' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '.PDF' ELSE '.txt' END AS path, sha256(text) AS sha256 FROM documents)"


@query("WITH " + _FILES + " SELECT sha256, arg_min(path, lower(path)) AS path, array_to_string(list(path ORDER BY lower(path)), ',') AS paths, CAST(count(*) AS INTEGER) AS copies FROM files GROUP BY 1")
def file_inventory(spark, d):
    return regression.inventory(_files(spark, d)).withColumn("paths", F.array_join("paths", ","))


@query("WITH " + _FILES + ", first AS (SELECT sha256, arg_min(path, lower(path)) AS path FROM files GROUP BY 1) SELECT DISTINCT path FROM first WHERE lower(path) LIKE '%.pdf' AND sha256 NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 8 = 0)")
def untracked_files(spark, d):
    manifest = v.table(spark, d, "documents").where("doc_id % 8 = 0").select(F.sha2("text", 256).alias("sha256"))
    return regression.untracked(regression.inventory(_files(spark, d)), manifest)


@query(
    """WITH e AS (SELECT c_custkey AS id, c_mktsegment AS t, unnest([{'f': 'name', 'v': c_name}, {'f': 'nation', 'v': CAST(c_nationkey AS VARCHAR)}, {'f': 'extra', 'v': NULL}]) AS x FROM customer),
c AS (SELECT id, t, x.f AS field, x.f <> 'extra' OR id % 2 = 0 AS present, x.f = 'name' OR (x.f = 'nation' AND id % 5 <> 0) OR (x.f = 'extra' AND id % 2 = 0) AS matches FROM e),
d AS (SELECT id, t, bool_and(matches) AS passed FROM c GROUP BY 1, 2)
SELECT t AS document_type, CAST(NULL AS VARCHAR) AS field, count(*) AS expected, count(*) FILTER (id % 7 <> 0) AS found, count(*) FILTER (passed) AS matched, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS mismatched FROM d GROUP BY 1
UNION ALL SELECT t, field, count(*), count(*) FILTER (present), count(*) FILTER (matches), count(*) FILTER (NOT present), count(*) FILTER (present AND NOT matches) FROM c GROUP BY 1, 2"""
)
def golden_coverage(spark, d):
    customer = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("document_type"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit(None).cast("string").alias("extra"))
    expected = regression.unpivoted(customer, "id", ["name", "nation", "extra"])
    found = regression.unpivoted(customer.withColumn("nation", F.when(F.col("id") % 5 != 0, F.col("nation")).otherwise(-1)), "id", ["name", "nation", "extra"]).where("field <> 'extra' or id % 2 = 0")
    checks = regression.field_checks(expected, found)
    passed = checks.groupBy("id").agg(F.bool_and("matches").alias("passed"))
    documents = customer.join(passed, "id").select("id", "document_type", F.when(F.col("id") % 7 != 0, F.col("document_type")).alias("found_type"), "passed")
    return regression.coverage(documents, checks)


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, '{"o_orderkey":"' || o_orderkey || '","o_orderstatus":"' || o_orderstatus || '"}' AS row FROM orders) SELECT o_custkey, count(*) AS count, sha256('[' || string_agg(row, ',' ORDER BY o_orderkey) || ']') AS sha256, arg_min(row, o_orderkey) AS first, arg_max(row, o_orderkey) AS last FROM r GROUP BY 1"""
)
def row_digests(spark, d):
    o = v.table(spark, d, "orders").withColumn("ord", F.col("o_orderkey"))
    return regression.digest(o, "o_custkey", ["o_orderkey", "o_orderstatus"])


@query(
    "WITH pages AS (SELECT doc_id AS doc, CAST(doc_id % 3 AS INTEGER) AS page, text FROM documents) SELECT doc, CASE WHEN length(trim(text, ' ')) >= 20 AND length(text) > 0 THEN 'textual' ELSE 'probable_image' END AS classification FROM pages"
)
def page_classes(spark, d):
    pages = v.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 3).cast("int").alias("page"), "text")
    return layout.page_class(layout.page_metrics(pages))

"""Queries over clients' models, exact vocabularies, orders of books and the choice of statements, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import layout, local, matching, models
from tallyforge.operators.ordering import numbered
from tallyforge.plans import views as v
from tallyforge.plans.catalogue import _with, query

#: Terms the queries keep of each block: fewer than there are, so that the cut and its ties are tried.
WORD_TERMS, GRAM_TERMS = 60, 400

_GRAMS = "list_transform(range(1, greatest(len(w) - {n} + 1, 1) + 1), lambda i: substring(w, i, {n}))"


@query(
    f"""WITH docs AS (SELECT p_partkey AS doc, lower(p_name || ' ' || p_type) AS t FROM part), ws AS (SELECT doc, regexp_extract_all(t, '\\b\\w\\w+\\b') AS ws FROM docs),
word AS (SELECT doc, 'word' AS block, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM ws),
padded AS (SELECT doc, ' ' || unnest(regexp_extract_all(t, '\\S+')) || ' ' AS w FROM docs),
gram AS (SELECT doc, 'char' AS block, unnest(list_concat({_GRAMS.format(n=3)}, CASE WHEN len(w) >= 4 THEN {_GRAMS.format(n=4)} ELSE [] END, CASE WHEN len(w) >= 5 THEN {_GRAMS.format(n=5)} ELSE [] END)) AS term FROM padded),
counts AS (SELECT doc, block, term, count(*) AS tf FROM (SELECT * FROM word UNION ALL SELECT * FROM gram) GROUP BY ALL),
df AS (SELECT block, term, count(*) AS df, sum(tf) AS total FROM counts GROUP BY ALL HAVING count(*) >= 2),
kept AS (SELECT * FROM df QUALIFY row_number() OVER (PARTITION BY block ORDER BY total DESC, term) <= CASE block WHEN 'word' THEN {WORD_TERMS} ELSE {GRAM_TERMS} END),
w AS (SELECT doc, block, term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS weight FROM counts JOIN kept USING (block, term), (SELECT count(*) AS n FROM docs))
SELECT doc, block, term, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc, block)), 6) AS weight FROM w"""
)
def tfidf_blocks(spark, d):
    docs = v.dealt(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.concat_ws(" ", "p_name", "p_type").alias("t"))
    return models.union_tfidf(docs, "doc", F.col("t"), WORD_TERMS, GRAM_TERMS).withColumn("weight", F.round("weight", 6))


def _clients(spark, d):
    """Line items as clients' approved examples, and orders as what they are asked."""
    line, part = v.table(spark, d, "lineitem"), v.table(spark, d, "part")
    direction = lambda c: F.when(F.col(c) % 2 == 0, "inflow").otherwise("outflow")
    examples = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_suppkey") % 7).cast("string").alias("client_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.to_date("l_shipdate").alias("date"), F.col("p_type").alias("text"), direction("l_partkey").alias("direction"),
        (F.col("l_partkey") % 3).cast("string").alias("financial_account"), F.lit(None).cast("decimal(18,2)").alias("amount"), (F.col("l_partkey") % 4).cast("string").alias("counterpart"), F.when(F.col("l_suppkey") % 7 != 3, F.col("l_returnflag")).alias("standard_history"),
    )
    orders = v.table(spark, d, "orders")
    probes = orders.join(part, F.col("o_orderkey") % 997 == F.col("p_partkey")).select(
        (F.col("o_custkey") % 8).cast("string").alias("client_id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 11 == 0, "nothing known").otherwise(F.col("p_type")).alias("text"), direction("p_partkey").alias("direction"),
        F.when(F.col("o_orderkey") % 13 != 0, (F.col("p_partkey") % 3).cast("string")).alias("financial_account"), F.lit(None).cast("decimal(18,2)").alias("amount"),
    )
    return examples, probes


_CLIENTS = """examples AS (SELECT CAST(l_suppkey % 7 AS VARCHAR) AS client_id, l_orderkey * 10 + l_linenumber AS ord, lower(p_type) AS text, l_partkey % 2 AS direction, l_partkey % 3 AS account, CAST(l_partkey % 4 AS VARCHAR) AS counterpart,
  CASE WHEN l_suppkey % 7 <> 3 THEN l_returnflag END AS standard_history FROM lineitem JOIN part ON l_partkey = p_partkey WHERE strftime(CAST(l_shipdate AS DATE), '%Y-%m') < '1998-06'),
probes AS (SELECT CAST(o_custkey % 8 AS VARCHAR) AS client_id, o_orderkey AS ord, CASE WHEN o_orderkey % 11 = 0 THEN 'nothing known' ELSE lower(p_type) END AS text, p_partkey % 2 AS direction, p_partkey % 3 AS account
  FROM orders JOIN part ON o_orderkey % 997 = p_partkey WHERE o_orderkey % 13 <> 0),
heads AS (SELECT client_id, ord, text, direction, account, 'account' AS head, counterpart AS label FROM examples UNION ALL SELECT client_id, ord, text, direction, account, 'history', standard_history FROM examples WHERE standard_history IS NOT NULL),
memory AS (SELECT client_id, head, text, direction, account, min(label) AS label FROM heads GROUP BY ALL HAVING count(DISTINCT label) = 1),
major AS (SELECT client_id, head, label FROM (SELECT client_id, head, label, count(*) AS n, min(ord) AS first FROM heads GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY client_id, head ORDER BY n DESC, first) = 1)"""


@query(
    _with(_CLIENTS)
    + """, asked AS (SELECT p.*, m.head, m.label AS majority FROM probes p JOIN major m USING (client_id)), told AS (SELECT a.client_id, a.ord, a.head, k.label, a.majority FROM asked a LEFT JOIN memory k USING (client_id, head, text, direction, account))
SELECT client_id, ord, max(label) FILTER (head = 'account') AS account_memory, max(majority) FILTER (head = 'account') AS account_majority, max(label) FILTER (head = 'history') AS history_memory, max(majority) FILTER (head = 'history') AS history_majority FROM told GROUP BY ALL"""
)
def client_heads(spark, d):
    """What memory and majority answer for each client's movements in both heads, all clients at once."""
    examples, probes = _clients(spark, d)
    rows = local.head_rows(examples, "1998-06")
    asked = probes.where("financial_account is not null").select("client_id", "ord", local.local_features(F.col("text"), F.col("direction"), F.col("financial_account")).alias("features"))
    told = asked.join(local.majority(rows), "client_id").join(local.memory(rows, "features"), ["client_id", "head", "features"], "left")
    of = lambda c, head: F.max(F.when(F.col("head") == head, F.col(c)))
    return told.groupBy("client_id", "ord").agg(of("label", "account").alias("account_memory"), of("majority", "account").alias("account_majority"), of("label", "history").alias("history_memory"), of("majority", "history").alias("history_majority"))


@query()
def client_predictions(spark, d):
    """Both heads of every client's model, classifiers included, which are trained here and have no SQL."""
    examples, probes = _clients(spark, d)
    return local.predicted(examples, probes, "1998-06").withColumns({c: F.round(c, 6) for c in ("p", "hp", "combined")})


@query()
def clients_left_out(spark, d):
    """Each client answered by a model of the others."""
    examples, _ = _clients(spark, d)
    rows = examples.select("client_id", "ord", "date", F.col("text").alias("features"), F.col("standard_history").alias("label")).where("label is not null")
    return local.fold_metrics(local.without_each(rows)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(
    _with(v.MOVEMENTS, v.STATEMENT)
    + """, books AS (SELECT 0 AS kind, ledger, ord, amount FROM movements UNION ALL SELECT 1, ledger, ord, amount FROM statement_tx)
SELECT kind, ledger, ord, amount, row_number() OVER (ORDER BY kind, ledger, ord) AS number FROM books""",
    amounts=("amount",),
)
def numbered_books(spark, d):
    """One running number over the rows of all ledgers, then of all statements; repeated rows are each numbered."""
    books = v.movements(spark, d).select(F.lit(0).alias("kind"), "ledger", "ord", "amount").unionByName(v.statement_tx(spark, d).select(F.lit(1).alias("kind"), "ledger", "ord", "amount"))
    return numbered(books, ["kind", "ledger", "ord"], "number")


#: Rounds of the choice that the SQL writes out; sf0.01 needs nine, tables with many ledgers of one size as many as there are statements. The query goes on until no pair is left.
_ROUNDS = 8


def _rounds() -> str:
    steps = []
    for i in range(_ROUNDS):
        steps.append(f"f{i} AS MATERIALIZED (SELECT ledger, statement FROM (SELECT *, row_number() OVER (PARTITION BY ledger ORDER BY overlap DESC, statement) AS x, row_number() OVER (PARTITION BY statement ORDER BY entries DESC, ledger) AS y FROM o{i}) WHERE x = 1 AND y = 1)")
        steps.append(f"o{i + 1} AS MATERIALIZED (SELECT * FROM o{i} WHERE ledger NOT IN (SELECT ledger FROM f{i}) AND statement NOT IN (SELECT statement FROM f{i}))")
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT ledger, statement FROM f{i}" for i in range(_ROUNDS))


@query(
    _with(v.MOVEMENTS, v.STATEMENT)
    + """, l AS (SELECT ledger % 60 AS ledger, date, count(*) AS n FROM movements GROUP BY ALL), s AS (SELECT ledger % 50 AS statement, date, count(*) AS n FROM statement_tx GROUP BY ALL),
sizes AS (SELECT ledger, CAST(ceil(sum(n) / 4) AS BIGINT) AS entries FROM l GROUP BY 1), pairs AS (SELECT ledger, statement, sum(least(l.n, s.n)) AS overlap FROM l JOIN s USING (date) GROUP BY ALL),
o0 AS MATERIALIZED (SELECT ledger, statement, overlap, entries FROM pairs JOIN sizes USING (ledger) WHERE overlap >= greatest(1, entries // 2)), """
    + _rounds()
)
def ledger_statements(spark, d):
    """Which statement each of sixty ledgers takes, by the days they share; more ledgers than statements."""
    of = lambda df, n, name: df.select((F.col("ledger") % n).alias(name), "date")
    ledgers, statements = of(v.movements(spark, d), 60, "ledger"), of(v.statement_tx(spark, d), 50, "statement")
    sizes = ledgers.groupBy("ledger").agg(F.ceil(F.count(F.lit(1)) / 4).alias("entries"))
    return matching.ledger_accounts(sizes, matching.overlap(ledgers, statements, "ledger", "statement", ("date",)))


_TITLES = ("DATA", "LANCAMENTO", "VALOR", "SALDO", "RAZAOSOCIAL", "CPFCNPJ", "CREDITO", "DEBITO", "DCTO", "ENTRADA", "SAIDA", "CODIGO", "DESCRICAO", "VALORR", "SALDOR")
_LABELS = ("Controle de Fechamento de Caixa", "Saldo inicial", "Entrada", "Lançamentos do período", "Saldo anterior", "CNPJ/CPF", "Itaú", "Extrato mensal", "Bradesco", "Crédito", "Débito")


def _listed(values) -> str:
    return "[" + ", ".join("'" + x + "'" for x in values) + "]"


def _routing_sql() -> str:
    hit = lambda name, kind, needs: f"WHEN source = '{kind}' AND " + " AND ".join(f"contains(folded, '{n}')" if kind == "printed" else f"list_contains(titles, '{n}')" for n in needs) + f" THEN '{name}'"
    adapter = "CASE " + " ".join(hit(n, kind, needs) for n, _, kind, needs in layout.ADAPTERS) + " END"
    family = "CASE adapter " + " ".join(f"WHEN '{n}' THEN '{f}'" for n, f, _, _ in layout.ADAPTERS) + " END"
    recipes = ", ".join(f"({i}, '{r[0]}', '{r[1]}', {_listed(r[3])})" for i, r in enumerate(layout.RECIPES))
    return f"""WITH docs AS (SELECT p_partkey AS doc, CASE WHEN p_partkey % 3 = 0 THEN 'printed' ELSE 'sheet' END AS source,
  array_to_string([c FOR c IN {_listed(_LABELS)} IF (p_partkey * 7 + length(c) * 5 + ascii(c)) % 5 <> 0], ' ') AS text, [c FOR c IN {_listed(_TITLES)} IF (p_partkey * 31 + length(c) * 17 + ascii(c)) % 4 <> 0] AS titles FROM part),
folded AS (SELECT *, lower(regexp_replace(upper(strip_accents(text)), '[^A-Z0-9]', '', 'g')) AS folded FROM docs), asked AS (SELECT doc, titles, {adapter} AS adapter FROM folded), known AS (SELECT *, {family} AS family FROM asked),
recipes AS (SELECT * FROM (VALUES {recipes}) t(ord, id, family, headers)),
scored AS (SELECT doc, ord, id, len(list_intersect(titles, headers)) / CAST(len(list_distinct(list_concat(titles, headers))) AS DOUBLE) AS similarity FROM known JOIN recipes USING (family)),
best AS (SELECT doc, id AS recipe, similarity FROM scored WHERE similarity >= 0.4 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY similarity DESC, ord) = 1)
SELECT doc, adapter, family, recipe, similarity, CASE WHEN adapter IS NULL THEN 'unsupported_layout' WHEN recipe IS NULL THEN 'columns_not_confirmed' END AS code FROM known LEFT JOIN best USING (doc)"""


@query(_routing_sql())
def adapter_choice(spark, d):
    """Documents with labels and titles missing here and there to the first adapter that takes them, and to a recipe of its family."""
    k = F.col("p_partkey")
    kept = lambda values, a, b, n: F.filter(F.array(*[F.when((k * a + len(c) * b + ord(c[0])) % n != 0, F.lit(c)) for c in values]), lambda c: c.isNotNull())
    docs = v.dealt(spark, d, "part").select(k.alias("doc"), F.when(k % 3 == 0, "printed").otherwise("sheet").alias("source"), F.array_join(kept(_LABELS, 7, 5, 5), " ").alias("text"), kept(_TITLES, 31, 17, 4).alias("titles"))
    return layout.routed(docs, layout.recipe_table(spark), least=0.4)

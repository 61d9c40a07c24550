"""More named queries over the test tables: scalars, sources, layouts, records and choices, each with the SQL it is checked against."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tallyforge.functions import bookkeeping as b
from tallyforge.functions import identity, money, text
from tallyforge.operators import accounts as acc
from tallyforge.operators import layout, matching, models, normalize, reconcile, regression
from tallyforge.plans import engine
from tallyforge.plans import views as v
from tallyforge.plans.catalogue import _ACC, _SEM, PERIOD, QUERIES, _with, query
from tallyforge.sources import files, invoices, workbooks

_BEFORE = set(QUERIES)


def _orders(spark, d):
    return v.table(spark, d, "orders")


def _s(c):
    return F.col(c).cast("string")


# ---- scalars


@query("SELECT o_orderkey, 'no ' || o_orderkey || ' 1a parcela a b fim abc 12 x2 ij' AS plain, '123' AS digits FROM orders")
def plain_forms(spark, d):
    """Ordinals, hard spaces, ligatures, wide letters, fractions, raised digits; what has no ASCII form goes."""
    t = F.concat(F.lit("Nº "), _s("o_orderkey"), F.lit(" 1ª parcela\ta b ﬁm ＡＢＣ ½ x² ĳ→"))
    return _orders(spark, d).select("o_orderkey", text.plain(t).alias("plain"), text.plain(F.lit("①②③")).alias("digits"))


@query("SELECT o_orderkey, 'acme,bell,' || CASE WHEN o_orderstatus = 'F' THEN 'fechado,' ELSE '' END || 'order' AS words FROM orders")
def meaningful_words(spark, d):
    t = F.concat(F.lit("Pagamento NF para Acme Béll LTDA ed order "), F.when(F.col("o_orderstatus") == "F", "FECHADO").otherwise("da"), _s("o_orderkey"))
    return _orders(spark, d).select("o_orderkey", F.array_join(F.array_sort(text.words(t)), ",").alias("words"))


@query("SELECT o_orderkey, 'a b -c ' || o_orderkey AS spaced, 'ação ' || o_orderkey AS repaired, CAST(NULL AS VARCHAR) AS dash, 'x' AS kept FROM orders")
def cleaned_texts(spark, d):
    key = _s("o_orderkey")
    return _orders(spark, d).select(
        "o_orderkey", text.clean(F.concat(F.lit("  a b ­c \n"), key)).alias("spaced"), text.clean(F.concat(F.lit("aÃ§Ã£o "), key)).alias("repaired"),
        text.dash_to_null(F.lit(" - ")).alias("dash"), text.dash_to_null(F.lit(" x ")).alias("kept"),
    )


@query(
    """SELECT o_orderkey, CAST(day AS VARCHAR) AS inside, CAST(day AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS outside, strftime(CAST(date_trunc('month', day) + INTERVAL 1 MONTH AS DATE), '%Y-%m') AS next, strftime(day, '%m') <= '12' AS is_period
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)"""
)
def row_dates(spark, d):
    """Days printed without a year, by the statement's period."""
    o = _orders(spark, d).withColumn("day", F.to_date("o_orderdate"))
    short = F.date_format("day", "dd/MM")
    return o.select(
        "o_orderkey", money.parse_row_date(short, F.date_sub("day", 3), F.date_add("day", 20)).cast("string").alias("inside"), money.parse_row_date(short, F.date_add("day", 5), F.date_add("day", 30)).cast("string").alias("before"),
        money.parse_row_date(short, F.date_add("day", 30), F.date_add("day", 60)).cast("string").alias("outside"), money.next_period(F.date_format("day", "yyyy-MM")).alias("next"), money.is_period(F.date_format("day", "yyyy-MM")).alias("is_period"),
    )


@query(
    "SELECT o_orderkey, p AS br, p AS us, p AS printed, p AS written, CAST(NULL AS DOUBLE) AS none FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS p FROM orders)", amounts=("br", "us", "printed", "written", "none")
)
def separators(spark, d):
    """Amounts with either decimal separator, of printed forms and as written."""
    price = F.col("o_totalprice").cast(money.MONEY)
    us = F.regexp_replace(F.format_number(price.cast("double"), 2), " ", "")
    br = F.translate(us, ",.", ".,")
    return _orders(spark, d).select("o_orderkey", money.parse_mixed(F.concat(F.lit("R$ "), br)).alias("br"), money.parse_mixed(us).alias("us"), money.parse_printed(F.concat(F.lit("R$ "), br)).alias("printed"), money.exact_decimal(F.concat(F.lit(" "), price.cast("string"))).alias("written"), money.exact_decimal(F.lit("x")).alias("none"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 'Pago  a ' || o_custkey ELSE 'Pago a Fornecedor ' || o_custkey END AS stripped, CASE o_orderkey % 3 WHEN 0 THEN 'CNPJ' WHEN 1 THEN 'CPF' ELSE 'unknown' END AS kind,
  CASE WHEN o_orderkey % 5 < 4 THEN 'Cidade ' || o_custkey ELSE '' END AS city, CASE WHEN o_orderkey % 5 < 2 THEN 'SP' WHEN o_orderkey % 5 < 4 THEN 'RJ' ELSE '' END AS state, lpad(CAST(o_custkey % 10000000 AS VARCHAR), 7, '0') AS code, lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') || '000' AS postal FROM orders"""
)
def stripped_identities(spark, d):
    """Ids in their mask, as digits, missing from the text and empty; persons', companies' and other ids; cities with and without a state."""
    k, c = F.col("o_orderkey"), _s("o_custkey")
    two = F.lpad((k % 100).cast("string"), 2, "0")
    masked, bare = F.concat(F.lit("12.345.678/0001-"), two), F.concat(F.lit("123456780001"), two)
    tail = F.concat(F.lit("Fornecedor "), c)
    line = F.when(k % 4 == 0, F.concat_ws(" ", F.lit("Pago a"), masked, tail)).when(k % 4 == 1, F.concat_ws(" ", F.lit("Pago a"), bare, tail)).when(k % 4 == 2, F.concat_ws(" ", F.lit("Pago a"), tail)).otherwise(F.concat(F.lit("Pago  a "), c))
    kind = identity.tax_id_type(F.when(k % 3 == 0, masked).when(k % 3 == 1, F.concat(F.lit("123.456.789-"), two)).otherwise(two))
    city = F.concat(F.lit("Cidade "), c)
    place = identity.city_state(F.when(k % 5 < 2, F.concat(city, F.lit(" / SP"))).when(k % 5 < 4, F.concat(city, F.lit("-RJ"))).otherwise(city))
    both = identity.code_postal(F.concat(F.lpad((F.col("o_custkey") % 10_000_000).cast("string"), 7, "0"), F.lit(" / "), F.lpad((k % 100_000).cast("string"), 5, "0"), F.lit("-000")))
    return _orders(spark, d).select("o_orderkey", identity.strip_tax_id(line, F.when(k % 4 < 3, masked).otherwise("")).alias("stripped"), kind.alias("kind"), place["city"].alias("city"), place["state"].alias("state"), both["code"].alias("code"), both["postal_code"].alias("postal"))


@query(
    "SELECT o_orderkey, 'direcao_outflow banco_' || (o_custkey % 9) || ' valor_' || CAST(floor(p * 100) AS BIGINT) || ' ordem_' || length(CAST(CAST(floor(p) AS BIGINT) AS VARCHAR)) || ' pix numero' AS features, 'direcao_outflow banco_' || (o_custkey % 9) || ' pix numero' AS bare FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders)"
)
def local_feature_texts(spark, d):
    o = _orders(spark, d)
    made = lambda amount: text.local_features(F.concat(F.lit("Pix "), (F.col("o_orderkey") + 100000).cast("string")), F.lit("outflow"), (F.col("o_custkey") % 9).cast("string"), amount)
    return o.select("o_orderkey", made(F.col("o_totalprice").cast(money.MONEY)).alias("features"), made(None).alias("bare"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS daily, o_orderkey % 2 = 0 AS transfer, CASE WHEN o_orderkey % 5 = 0 THEN 'despesa_bancaria' WHEN o_orderkey % 5 = 1 THEN 'tributo:icms' END AS rule FROM orders")
def movement_predicates(spark, d):
    key = F.col("o_orderkey")
    line = F.when(key % 3 == 0, "Saldo do dia").otherwise("Pix saldo")
    moved = F.when(key % 2 == 0, "TRANSFERÊNCIA entre contas").otherwise("aplicação")
    ruled = F.when(key % 5 == 0, "Tarifa de pacote").when(key % 5 == 1, "ICMS 06/98").when(key % 5 == 2, "ICMS e IPI").otherwise("compra")
    return _orders(spark, d).select("o_orderkey", b.is_daily_balance(line).alias("daily"), b.is_transfer(moved).alias("transfer"), b.rule_of(ruled, F.lit("outflow")).alias("rule"))


_KEY = "rpad(CAST(3550308 AS VARCHAR) || '1' || '2' || lpad(CAST(o_custkey AS VARCHAR), 14, '0') || lpad(CAST(o_orderkey AS VARCHAR), 13, '0'), 49, '7')"


@query(
    f"""WITH k AS (SELECT o_orderkey, o_custkey, {_KEY} AS base FROM orders), t AS (SELECT *, CAST(list_sum(list_transform(range(1, 50), lambda i: CAST(base[50 - i] AS INTEGER) * (2 + (i - 1) % 8))) % 11 AS INTEGER) AS r FROM k)
SELECT o_orderkey, base || (CASE WHEN r < 2 THEN 0 ELSE 11 - r END) AS key, TRUE AS valid, FALSE AS wrong, CASE WHEN o_orderkey % 2 = 0 THEN 'number' ELSE '' END AS differing FROM t"""
)
def invoice_keys(spark, d):
    base = F.rpad(F.concat(F.lit("355030812"), F.lpad(_s("o_custkey"), 14, "0"), F.lpad(_s("o_orderkey"), 13, "0")), 49, "7")
    key = F.concat(base, money.key_digit(base).cast("string"))
    o = _orders(spark, d).withColumn("key", key)
    wrong = F.concat(F.substring("key", 1, 49), ((F.substring("key", 50, 1).cast("int") + 1) % 10).cast("string"))
    number = F.lpad((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(0)).cast("string"), 13, "0")
    parts = money.inconsistent_segments(F.col("key"), {"issue_municipality": F.lit("3550308"), "number": number, "environment": F.lit(None).cast("string")})
    return o.select("o_orderkey", "key", money.valid_key(F.col("key")).alias("valid"), money.valid_key(wrong).alias("wrong"), F.array_join(parts, ",").alias("differing"))


@query(
    """WITH k AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + 11 AS VARCHAR), 9, '2') AS s FROM orders WHERE length(CAST(o_orderkey * 7919 + 11 AS VARCHAR)) <= 9),
a AS (SELECT *, CAST(list_sum(list_transform(range(1, 10), lambda i: CAST(s[i] AS INTEGER) * (11 - i))) % 11 AS INTEGER) AS r FROM k), x AS (SELECT *, CASE WHEN r < 2 THEN 0 ELSE 11 - r END AS da FROM a),
b AS (SELECT *, CAST((list_sum(list_transform(range(1, 10), lambda i: CAST(s[i] AS INTEGER) * (12 - i))) + da * 2) % 11 AS INTEGER) AS q FROM x)
SELECT o_orderkey, s || da || (CASE WHEN q < 2 THEN 0 ELSE 11 - q END) AS cpf FROM b"""
)
def person_ids(spark, d):
    """Of the hundred ends of nine digits the one that makes a valid id."""
    s = F.lpad((F.col("o_orderkey") * 7919 + 11).cast("string"), 9, "2")
    o = _orders(spark, d).where(F.length((F.col("o_orderkey") * 7919 + 11).cast("string")) <= 9).select("o_orderkey", s.alias("s"))
    tried = o.select("o_orderkey", F.explode(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda e: F.concat("s", F.lpad(e.cast("string"), 2, "0")))).alias("cpf"))
    return tried.where(money.valid_cpf(F.col("cpf")))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'negative_fiscal_value' WHEN 2 THEN 'inconsistent_totals' WHEN 3 THEN 'inconsistent_iss_total' END AS issue FROM orders"""
)
def fiscal_rules(spark, d):
    k = F.col("o_orderkey") % 5
    dec = lambda c: c.cast("decimal(38,10)")
    gross = dec(F.lit(1000))
    iss = dec(F.when(k == 3, 51).otherwise(50))
    net = dec(F.when(k == 2, 1001).when(k == 1, -1).otherwise(950))
    return _orders(spark, d).select("o_orderkey", money.fiscal_issue(gross, dec(F.lit(1000)), dec(F.lit(5)), iss, net).alias("issue"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS deep, o_orderstatus AS flat, CAST(NULL AS VARCHAR) AS missing FROM orders")
def json_paths(spark, d):
    payload = F.to_json(F.struct(F.col("o_orderstatus").alias("s"), F.struct(F.struct(F.col("o_orderkey").alias("c")).alias("b")).alias("a")))
    return _orders(spark, d).select("o_orderkey", regression.dotted(payload, "a.b.c").alias("deep"), regression.dotted(payload, "s").alias("flat"), regression.dotted(payload, "a.x").alias("missing"))


# ---- sources


def _content(spark, d):
    """A delimited file an order: a quoted line break and a quoted delimiter in its records."""
    o = _orders(spark, d)
    body = F.concat(F.lit("Data;Texto;Valor\n"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(';"a;\nb c";'), _s("o_orderkey"), F.lit("\n;;\n;z;"), F.col("o_orderstatus"), F.lit("\n"))
    return o.select(_s("o_orderkey").alias("sha256"), F.encode(body, "utf-8").alias("content"))


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS doc, t.c AS coordinate, t.x AS value FROM (SELECT *, unnest([{'c': 'A1', 'x': 'Data'}, {'c': 'B1', 'x': 'Texto'}, {'c': 'C1', 'x': 'Valor'},
 {'c': 'A2', 'x': strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y')}, {'c': 'B2', 'x': 'a;b c'}, {'c': 'C2', 'x': CAST(o_orderkey AS VARCHAR)}, {'c': 'B4', 'x': 'z'}, {'c': 'C4', 'x': o_orderstatus}]) AS t FROM orders)"""
)
def delimited_cells(spark, d):
    return workbooks.csv_cells(_content(spark, d)).select("doc", "coordinate", "value")


@query("SELECT o_orderkey, 'é — € ' || o_orderkey AS windows, 'é – ' || o_orderkey AS utf8, ';' AS delimiter FROM orders")
def decoded_files(spark, d):
    key = F.encode(_s("o_orderkey"), "utf-8")
    windows = F.concat(F.unhex(F.lit("E92097208020")), key)
    utf8 = F.concat(F.unhex(F.lit("EFBBBF")), F.encode(F.lit("é – "), "utf-8"), key)
    table = F.concat(F.lit("a;b,c\n1;2,3\n"), _s("o_orderkey"), F.lit(";4,5,6"))
    return _orders(spark, d).select("o_orderkey", files.text_of(windows).alias("windows"), files.text_of(utf8).alias("utf8"), files.delimiter_of(table).alias("delimiter"))


@query(
    """SELECT o_orderkey, (['pdf', 'xml', 'xls', 'csv', NULL, NULL, NULL])[o_orderkey % 7 + 1] AS format, (['.pdf', '.txt', '.XLS', '.csv', '.pdf', '.bin', '.csv'])[o_orderkey % 7 + 1] = '.XLS' AS upper,
 CASE o_orderkey % 7 WHEN 4 THEN 'unknown_format' WHEN 5 THEN 'unknown_format' WHEN 6 THEN 'file_empty' END AS issue, CASE WHEN o_orderkey % 7 IN (1, 4) THEN 'extension_content_mismatch' END AS warning FROM orders"""
)
def detected_formats(spark, d):
    k = (F.col("o_orderkey") % 7).cast("int")
    bodies = F.array(*[F.unhex(F.lit(x.hex())) for x in (b"%PDF-1.4", b"\xef\xbb\xbf <x/>", bytes.fromhex("D0CF11E0A1B11AE100"), b"a;b\n1;2\n", b"words", b"words", b"")])
    names = F.array(*[F.lit(x) for x in ("a.pdf", "b.txt", "c.XLS", "d.csv", "e.pdf", "f.bin", "g.csv")])
    made = _orders(spark, d).select("o_orderkey", F.concat(F.lit("dir/"), F.get(names, k)).alias("path"), F.get(bodies, k).alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    out = files.detected(files.described(made))
    return out.select("o_orderkey", "format", (F.col("extension") == ".xls").alias("upper"), "issue", "warning")


def _workbook_bytes(keys: pd.Series) -> pd.Series:
    def one(key: int) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/sharedStrings.xml", "<sst><si><t>Data</t></si><si><r><t>Va</t></r><r><t>lor</t></r></si></sst>")
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>{key}</v></c><c r="B3"><f>A3*2</f><v>{2 * key}</v></c></row></sheetData></worksheet>')
        return out.getvalue()

    return keys.map(one)


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS doc, t.r AS coordinate, t.v AS value, t.f AS formula, t.c AS calculated_value FROM (SELECT *, unnest([{'r': 'A1', 'v': 'Data', 'f': NULL, 'c': NULL}, {'r': 'AB1', 'v': 'Valor', 'f': NULL, 'c': NULL},
 {'r': 'A3', 'v': CAST(c_custkey AS VARCHAR), 'f': NULL, 'c': NULL}, {'r': 'B3', 'v': NULL, 'f': '=A3*2', 'c': CAST(2 * c_custkey AS VARCHAR)}]) AS t FROM customer)"""
)
def workbook_cells(spark, d):
    from tallyforge.shipping import ship

    ship(spark)
    made = v.dealt(spark, d, "customer").select(_s("c_custkey").alias("sha256"), F.pandas_udf(_workbook_bytes, "binary")("c_custkey").alias("content"))
    return workbooks.xlsx_cells(made).select("doc", "coordinate", "value", "formula", "calculated_value")


def _invoice_xml(o):
    key = F.lpad(_s("o_orderkey"), 50, "1")
    return F.concat(
        F.lit('<?xml version="1.0"?><NFSe xmlns="http://www.sped.fazenda.gov.br/nfse" versao="'), F.when(F.col("o_orderkey") % 4 == 0, "9.99").otherwise("1.01"), F.lit('"><infNFSe Id="NFS'), key, F.lit('"><nNFSe>'), _s("o_orderkey"),
        F.lit("</nNFSe><emit><CNPJ>12345678000195</CNPJ><xNome>Acme</xNome></emit><valores><vLiq>"), F.col("o_totalprice").cast(money.MONEY).cast("string"), F.lit("</vLiq></valores><DPS><infDPS><toma><CPF>12345678909</CPF></toma></infDPS></DPS></infNFSe></NFSe>"),
    )


@query(
    """SELECT o_orderkey AS doc, lpad(CAST(o_orderkey AS VARCHAR), 50, '1') AS key, CAST(o_orderkey AS VARCHAR) AS number, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS net, '12345678000195' AS provider, 'CPF' AS customer_kind, TRUE AS no_intermediary, '/NFSe/infNFSe/nNFSe' AS origin FROM orders WHERE o_orderkey % 4 <> 0""",
    amounts=("net",),
)
def invoice_records(spark, d):
    o = v.dealt(spark, d, "orders")
    rows = invoices.normalized(o.select(F.col("o_orderkey").alias("doc"), _invoice_xml(o).alias("xml")))
    return rows.select("doc", "key", "number", F.col("amounts.net").alias("net"), F.col("provider.tax_id").alias("provider"), F.col("customer.tax_id_type").alias("customer_kind"), F.col("intermediary").isNull().alias("no_intermediary"), F.col("provenance")["number"].alias("origin"))


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'unsupported_nfse_version' END AS issue, count(*) AS documents FROM orders GROUP BY 1 UNION ALL SELECT 'unsafe_xml', count(*) FROM orders UNION ALL SELECT 'unsupported_xml_root', count(*) FROM orders")
def invoice_gate(spark, d):
    o = v.dealt(spark, d, "orders")
    xml = F.explode(F.array(_invoice_xml(o), F.lit("<!DOCTYPE x><NFSe/>"), F.lit("<other/>")))
    return invoices.gate(o.select(F.col("o_orderkey").alias("doc"), xml.alias("xml"))).groupBy("issue").agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT o_orderkey AS doc, t.r AS row_number, t.c AS column, t.v AS value, 'page-2-table-0' AS sheet FROM (SELECT o_orderkey, unnest([{'r': 1, 'c': 1, 'v': 'Data'}, {'r': 1, 'c': 3, 'v': 'Valor'}, {'r': 2, 'c': 2, 'v': o_orderstatus}]) AS t FROM orders)")
def page_table_cells(spark, d):
    strings = lambda *xs: F.array(*[x.cast("string") for x in xs])
    table = F.array(strings(F.lit("Data"), F.lit(""), F.lit("Valor")), strings(F.lit(None), F.col("o_orderstatus"), F.lit(None)))
    pages = _orders(spark, d).select(F.col("o_orderkey").alias("doc"), F.lit(2).alias("page"), F.array(table).alias("tables"))
    return workbooks.table_cells(pages).select("doc", "row_number", "column", "value", "sheet")


@query(
    """SELECT o_orderkey AS doc, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS DOUBLE) AS amount, CASE WHEN o_orderstatus = 'F' THEN 'debit' ELSE 'credit' END AS transaction_type FROM orders""",
    amounts=("amount",),
)
def recognised_payloads(spark, d):
    """Payloads of a recogniser: zero amounts and bad dates go."""
    price = F.concat(F.when(F.col("o_orderstatus") == "F", "-").otherwise(""), F.translate(F.col("o_totalprice").cast(money.MONEY).cast("string"), ".", ","))
    made = lambda date, amount: F.struct(date.alias("date"), F.lit("x").alias("description"), F.lit(None).cast("string").alias("counterparty"), F.lit(None).cast("string").alias("document"), amount.alias("amount"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    payload = F.to_json(F.struct(F.lit("Itaú").alias("bank"), F.array(made(day, price), made(day, F.lit("0,00")), made(F.lit("31/12"), price)).alias("transactions")))
    return normalize.from_vision(_orders(spark, d).select(F.col("o_orderkey").alias("doc"), payload.alias("payload"))).select("doc", _s("date").alias("date"), "amount", "transaction_type")


# ---- layouts


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Itaú' WHEN 1 THEN 'Bradesco' END AS bank, CASE o_orderkey % 3 WHEN 0 THEN 'itau-digital-bank-statement-v1' END AS recipe, 'a é �' AS decoded FROM orders")
def printed_banks(spark, d):
    k = F.col("o_orderkey") % 3
    page = F.when(k == 0, "Banco ITAÚ lançamentos do período saldo anterior CNPJ/CPF").when(k == 1, "BRADESCO").otherwise("outro")
    return _orders(spark, d).select("o_orderkey", layout.bank_of(page).alias("bank"), layout.recognised(page).alias("recipe"), layout.decoded_cids(F.concat(F.lit("(cid:3) (cid:4) (cid:"), (F.col("o_orderkey") + 100).cast("string"), F.lit(")")), {3: "a", 4: "é"}).alias("decoded"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'inflow' WHEN 2 THEN 'balance' ELSE 'amount' END AS field, CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.72 WHEN 2 THEN 0.62 ELSE 0.4 END AS score,
 CASE o_orderkey % 4 WHEN 0 THEN 'known' WHEN 1 THEN 'paused' WHEN 2 THEN 'proposal' ELSE 'unreadable' END AS status FROM orders"""
)
def title_suggestions(spark, d):
    k = F.col("o_orderkey") % 4
    title = F.when(k == 0, "Data movimento").when(k == 1, "Recebido").when(k == 2, "Saldos").otherwise("xyz")
    found = layout.suggestion(title, F.lit("money"))
    status = layout.entry_status(k < 2, k == 1, F.lit(False), k == 2)
    return _orders(spark, d).select("o_orderkey", found["field"].alias("field"), found["score"].cast("double").alias("score"), status.alias("status"))


def _cells(spark, d):
    """A sheet an order: a title row and three records."""
    cell = lambda r, c, value: F.struct(F.lit(r).alias("row_number"), F.lit(c).alias("column"), value.cast("string").alias("value"))
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    price = F.translate(F.col("o_totalprice").cast(money.MONEY).cast("string"), ".", ",")
    made = [cell(1, 1, F.lit("Data")), cell(1, 2, F.lit("Histórico")), cell(1, 3, F.lit("Entrada")), cell(1, 4, F.lit("Saída")), cell(1, 5, F.lit("Saldo"))]
    for r, inflow, outflow, balance in ((2, price, None, None), (3, None, F.lit("1,00"), None), (4, F.lit("2,50"), None, F.lit("7,00"))):
        made += [cell(r, 1, day), cell(r, 2, F.col("o_orderpriority"))] + [cell(r, c, x) for c, x in ((3, inflow), (4, outflow), (5, balance)) if x is not None]
    null = F.lit(None).cast("string")
    return v.dealt(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(0).alias("sheet_ord"), F.inline(F.array(*made))).withColumns({"formula": null, "calculated_value": null})


@query("SELECT o_orderkey AS doc, t.c AS column, t.k AS kind, 3 - t.m AS samples FROM (SELECT o_orderkey, unnest([{'c': 1, 'k': 'date', 'm': 0}, {'c': 2, 'k': 'text', 'm': 0}, {'c': 3, 'k': 'money', 'm': 1}, {'c': 4, 'k': 'money', 'm': 2}, {'c': 5, 'k': 'money', 'm': 2}]) AS t FROM orders)")
def column_kinds(spark, d):
    cells = layout.rendered(_cells(spark, d)).where("row_number > 1")
    return layout.kind_of(cells, ["doc", "column"]).select("doc", "column", F.when(F.col("column") == 2, "text").otherwise(F.col("kind")).alias("kind"), F.col("samples").cast("int").alias("samples"))


@query("SELECT o_orderkey AS doc, 'cash_ledger' AS family, 5 AS cells, sha256('[\"DATA\",\"HISTORICO\",\"ENTRADA\",\"SAIDA\",\"SALDO\"]') AS fingerprint, '' AS missing FROM orders")
def sheet_headers(spark, d):
    rows = layout.mapped_rows(_cells(spark, d), layout.alias_table(spark))
    head = layout.first_header(rows)
    return head.select("doc", layout.family_of(F.col("columns")).alias("family"), F.col("n_cells").cast("int").alias("cells"), layout.fingerprint(F.col("titles")).alias("fingerprint"), F.array_join(layout.missing_fields(F.col("columns"), "cash_ledger"), ",").alias("missing"))


@query(
    """SELECT o_orderkey AS doc, t.r AS ord, t.i AS inflow, t.o AS outflow, t.b AS balance FROM (SELECT o_orderkey, unnest([{'r': 2, 'i': p, 'o': 0.0, 'b': p}, {'r': 3, 'i': 0.0, 'o': 1.0, 'b': p - 1}, {'r': 4, 'i': 2.5, 'o': 0.0, 'b': 7.0}]) AS t FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders))""",
    amounts=("inflow", "outflow", "balance"),
)
def ledger_from_cells(spark, d):
    """Titles, header, records and running balances of cash ledgers."""
    cells = _cells(spark, d)
    header = layout.first_header(layout.mapped_rows(cells, layout.alias_table(spark)))
    return normalize.ledger_entries(normalize.records(cells, header)).select("doc", "ord", "inflow", "outflow", "balance")


@query("SELECT o_orderkey AS doc, 2 AS fields, 1.0 AS best FROM orders")
def column_proposals(spark, d):
    cells = _cells(spark, d).where("column in (1, 3)")
    header = layout.first_header(layout.mapped_rows(cells, layout.alias_table(spark)))
    return layout.proposals(cells, header).groupBy("doc").agg(F.count_distinct("field").cast("int").alias("fields"), F.max("confidence").alias("best"))


@query(
    """WITH w AS (SELECT l_orderkey AS doc, CAST(round_even(l_quantity / 3.0, 0) * 3 AS INTEGER) AS row_number FROM lineitem) SELECT doc, row_number, count(*) AS cells FROM w GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def grid_rows(spark, d):
    line = v.table(spark, d, "lineitem")
    words = line.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.col("l_quantity").cast("double").alias("top"), F.col("l_suppkey").cast("double").alias("x0"), F.col("l_linenumber").alias("ord"), F.col("l_shipmode").alias("text") if "l_shipmode" in line.columns else F.col("l_returnflag").alias("text"))
    return layout.word_grid(words).groupBy("doc", "row_number").agg(F.count(F.lit(1)).alias("cells"))


@query("SELECT l_orderkey AS doc, count(*) AS words FROM (SELECT DISTINCT l_orderkey, l_returnflag, round(l_quantity, 2) AS q FROM lineitem) GROUP BY 1")
def distinct_words(spark, d):
    words = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.col("l_returnflag").alias("text"), *(F.col("l_quantity").cast("double").alias(c) for c in ("x0", "x1", "top", "bottom")), F.col("l_linenumber").alias("ord"))
    return layout.without_duplicates(words).groupBy("doc").agg(F.count(F.lit(1)).alias("words"))


@query(
    """WITH rows AS (SELECT p_partkey AS ord, 'r' || (p_partkey % 40) AS id, [p_brand, p_type, CAST(p_size % 3 AS VARCHAR)] AS headers FROM part),
sided AS (SELECT *, 0 AS side, 'seed' AS bank FROM rows WHERE ord % 2 = 0 UNION ALL SELECT ord, id, list_reverse(headers), 1, 'stored' FROM rows WHERE ord % 3 = 0),
catalog AS (SELECT * FROM sided QUALIFY row_number() OVER (PARTITION BY id, list_sort(headers) ORDER BY side DESC, ord DESC) = 1)
SELECT id, array_to_string(headers, '/') AS headers, ord, bank FROM catalog
UNION ALL SELECT id, array_to_string(headers, '/'), ord, 'new' FROM rows r WHERE ord % 5 = 0 AND NOT EXISTS (SELECT 1 FROM catalog c WHERE c.id = r.id AND c.headers = r.headers)"""
)
def recipe_catalog(spark, d):
    """Seeds and stored recipes, of which the stored win and the newest of these, and new ones that are not there yet."""
    rows = v.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("r"), F.col("p_partkey") % 40).alias("id"), F.array("p_brand", "p_type", (F.col("p_size") % 3).cast("string")).alias("headers"))
    seeds, stored = rows.where("ord % 2 = 0").withColumn("bank", F.lit("seed")), rows.where("ord % 3 = 0").withColumns({"headers": F.reverse("headers"), "bank": F.lit("stored")})
    every = layout.remembered(layout.catalog(seeds, stored), rows.where("ord % 5 = 0").withColumn("bank", F.lit("new")))
    return every.select("id", F.array_join("headers", "/").alias("headers"), "ord", "bank")


# ---- records, matches, reports


def _records(spark, d, fields):
    """Records as read below a header: doc, row_number, values."""
    pairs = [x for name, value in fields.items() for x in (F.lit(name), value.cast("string"))]
    return _orders(spark, d).select((F.col("o_orderkey") % 100).alias("doc"), F.col("o_orderkey").alias("row_number"), F.create_map(*pairs).alias("values"))


@query("SELECT o_orderkey % 100 AS doc, o_orderkey AS ord, '1.' || o_custkey AS code, o_orderpriority AS description FROM orders WHERE o_orderkey % 3 <> 0")
def chart_records(spark, d):
    code = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("1."), _s("o_custkey")))
    return normalize.chart(_records(spark, d, {"code": code, "description": F.col("o_orderpriority"), "reduced_code": F.lit(None)})).select("doc", "ord", "code", "description")


@query("SELECT doc, code, count(*) AS rows FROM (SELECT o_orderkey % 100 AS doc, '1.' || (o_custkey % 50) AS code FROM orders) GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_chart_codes(spark, d):
    code = F.concat(F.lit("1."), (F.col("o_custkey") % 50).cast("string"))
    return normalize.duplicate_codes(normalize.chart(_records(spark, d, {"code": code, "description": F.col("o_orderpriority")})))


@query("SELECT o_orderkey AS ord, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, CAST(o_custkey AS VARCHAR) AS debit_account, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM orders WHERE o_orderkey % 4 <> 0", amounts=("amount",))
def history_records(spark, d):
    rows = _records(spark, d, {"date": F.date_format("o_orderdate", "dd/MM/yyyy"), "debit_account": F.col("o_custkey"), "credit_account": F.when(F.col("o_orderkey") % 4 != 0, "9"), "amount": F.translate(F.col("o_totalprice").cast(money.MONEY).cast("string"), ".", ",")})
    return normalize.history(rows).select("ord", _s("date").alias("date"), "debit_account", "amount")


@query(
    """WITH r AS (SELECT o_orderkey % 100 AS doc, o_orderkey AS ord, CAST(o_orderdate AS DATE) AS date, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS p, CASE WHEN o_orderkey % 5 = 0 THEN 'opening' WHEN o_orderkey % 5 = 1 THEN 'daily' ELSE 'transaction' END AS kind FROM orders)
SELECT doc, arg_min(p, ord) FILTER (kind = 'opening') AS initial_balance, arg_max(p, {'d': date, 'o': ord}) FILTER (kind = 'daily') AS final_balance, count(*) FILTER (kind = 'transaction') AS transactions, CAST(min(date) FILTER (kind = 'transaction') AS VARCHAR) AS period_start FROM r GROUP BY 1""",
    amounts=("initial_balance", "final_balance"),
)
def statement_headers(spark, d):
    k = F.col("o_orderkey") % 5
    price = F.translate(F.col("o_totalprice").cast(money.MONEY).cast("string"), ".", ",")
    rows = _records(spark, d, {"date": F.date_format("o_orderdate", "dd/MM/yyyy"), "description": F.when(k == 0, "Saldo anterior").when(k == 1, "SALDO TOTAL disponível").otherwise("Pix"), "balance": F.when(k < 2, price), "amount": F.when(k > 1, price)})
    return normalize.statements(normalize.statement_rows(rows)).select("doc", "initial_balance", "final_balance", "transactions", _s("period_start").alias("period_start"))


@query(_with(v.CHART, v.HISTORY, _SEM) + "SELECT CASE WHEN s.semantic_key IS NULL THEN 'counterpart_not_in_chart' END AS reject, count(*) AS rows FROM (SELECT CASE WHEN ord % 3 = 0 THEN 'x' ELSE credit_account END AS counterpart FROM history) h LEFT JOIN semantic s ON s.reduced_code = h.counterpart GROUP BY 1")
def resolved_counterparts(spark, d):
    rows = v.history(spark, d).select(F.when(F.col("ord") % 3 == 0, "x").otherwise(F.col("credit_account")).alias("counterpart"))
    return acc.resolved(rows, acc.semantic_accounts(v.chart(spark, d))).groupBy("reject").agg(F.count(F.lit(1)).alias("rows"))


@query(
    """WITH p AS (SELECT l_orderkey AS page, l_linenumber AS id, CAST(l_quantity AS DOUBLE) AS top FROM lineitem WHERE l_linenumber % 2 = 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_partkey) = 1),
r AS (SELECT l_orderkey AS page, l_linenumber AS ord, CAST(l_quantity AS DOUBLE) AS top FROM lineitem WHERE l_linenumber % 2 = 1 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_partkey) = 1),
s AS (SELECT page, min(top) - 8 AS lo, max(top) + 20 AS hi FROM r GROUP BY 1)
SELECT p.page, p.id, arg_min(r.ord, {'d': abs(p.top - r.top), 'o': r.ord}) AS row_ord FROM p JOIN s USING (page) JOIN r USING (page) WHERE p.top BETWEEN lo AND hi GROUP BY 1, 2"""
)
def nearest_rows(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_quantity", "l_partkey")
    line = v.table(spark, d, "lineitem").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    of = lambda odd, name: line.where(F.col("l_linenumber") % 2 == odd).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias(name), F.col("l_quantity").cast("double").alias("top"))
    return matching.nearest(of(0, "id"), of(1, "ord"), ["page"])


@query("SELECT count(*) AS kept FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def page_repeats(spark, d):
    """Each order's row on page 1, and again at the top of page 2, where it goes unless its text differs."""
    o = _orders(spark, d)
    row = lambda page, top, t: o.select(F.col("o_orderkey").alias("doc"), F.lit(page).alias("page"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").cast(money.MONEY).alias("amount"), t.alias("text"), F.lit(top).alias("top"))
    again = F.when(F.col("o_orderkey") % 2 == 0, "other").otherwise("pix")
    return matching.without_page_repeats(row(1, 90.0, F.lit("long pix")).unionByName(row(2, 1.0, again))).agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT c_custkey AS id, 'dir/' || c_custkey AS path, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS found FROM customer")
def located_manifest(spark, d):
    customer = v.table(spark, d, "customer")
    stock = regression.inventory(customer.where("c_custkey % 3 = 0").select(F.concat(F.lit("dir/"), _s("c_custkey")).alias("path"), F.sha2("c_name", 256).alias("sha256")))
    out = regression.located(customer.select(F.col("c_custkey").alias("id"), F.sha2("c_name", 256).alias("sha256")), stock)
    return out.select("id", F.coalesce("path", F.concat(F.lit("dir/"), _s("id"))).alias("path"), F.col("path").isNotNull().cast("int").alias("found"))


@query("SELECT c_custkey AS left_id, c_custkey + 1 AS right_id, 'p' || c_custkey AS left_path, CASE WHEN c_custkey + 1 IN (SELECT c_custkey FROM customer) THEN 'p' || (c_custkey + 1) END AS right_path FROM customer")
def cross_validated_pairs(spark, d):
    customer = v.table(spark, d, "customer")
    documents = customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("p"), _s("c_custkey")).alias("path"))
    return regression.cross_validated(customer.select(F.col("c_custkey").alias("left_id"), (F.col("c_custkey") + 1).alias("right_id")), documents)


@query("SELECT count(*) AS documents, count(*) FILTER (c_custkey % 4 <> 0) AS passed, count(*) FILTER (c_custkey % 4 = 0) AS failed, FALSE AS success FROM customer")
def regression_summary(spark, d):
    return regression.summary(v.table(spark, d, "customer").select((F.col("c_custkey") % 4 != 0).alias("passed")))


@query("SELECT c_custkey AS id, c_custkey % 2 = 0 AS passed, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'name' END AS failed_fields FROM customer")
def fixture_verdicts(spark, d):
    customer = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    found = customer.withColumn("name", F.when(F.col("id") % 2 == 0, F.col("name")).otherwise("x"))
    return regression.verdicts(regression.expectation_checks(customer, found, ["name", "segment"])).withColumn("failed_fields", F.array_join("failed_fields", ","))


_RUN = "entries AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 4 = 0 THEN 'REVISAR CONTA' ELSE 'LANCAR' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'transferencia_espelhada' WHEN 1 THEN 'global_tfidf:0.9' ELSE 'x' END AS reason, CAST(o_custkey AS VARCHAR) AS debit_account, CAST(o_custkey + 700 AS VARCHAR) AS credit_account FROM orders)"


def _run_entries(spark, d):
    k = F.col("o_orderkey")
    return _orders(spark, d).select(
        k.alias("ord"), F.when(k % 4 == 0, "REVISAR CONTA").otherwise("LANCAR").alias("status"), F.when(k % 3 == 0, "transferencia_espelhada").when(k % 3 == 1, "global_tfidf:0.9").otherwise("x").alias("reason"),
        _s("o_custkey").alias("debit_account"), (F.col("o_custkey") + 700).cast("string").alias("credit_account"),
    )


@query(_with(_RUN) + "SELECT count(*) AS generated_entries, count(*) FILTER (status = 'LANCAR') AS launch, count(*) FILTER (status <> 'LANCAR') AS review_count, count(*) FILTER (reason = 'transferencia_espelhada') AS transfers_collapsed, count(*) FILTER (reason LIKE 'global_tfidf:%') AS global_fallback_count FROM entries")
def run_audit(spark, d):
    return engine.audit(_run_entries(spark, d))


@query(_with(_RUN, v.CHART) + "SELECT DISTINCT code FROM (SELECT debit_account AS code FROM entries UNION ALL SELECT credit_account FROM entries) WHERE code NOT IN (SELECT reduced_code FROM chart WHERE reduced_code IS NOT NULL)")
def unknown_accounts(spark, d):
    return engine.unknown_codes(_run_entries(spark, d), v.chart(spark, d))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS empty FROM orders")
def dataset_size(spark, d):
    return models.dataset_digest(_orders(spark, d), ["o_orderkey"]).select("n", (F.length("digest") - 64).cast("long").alias("empty"))


@query("SELECT o_custkey AS doc, o_orderkey AS ord, last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS text FROM orders")
def carried_texts(spark, d):
    rows = _orders(spark, d).select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("text"))
    return reconcile.carried(rows, "doc", "text")


@query(
    """WITH r AS (SELECT o_custkey AS doc, o_orderkey AS ord, o_orderstatus AS t, sum(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g FROM orders) SELECT doc, min(ord) AS ord, string_agg(t, ' ' ORDER BY ord) AS text FROM r WHERE g > 0 GROUP BY doc, g"""
)
def continued_lines(spark, d):
    rows = _orders(spark, d).select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 3 == 0).alias("starts"), F.col("o_orderstatus").alias("text"))
    return reconcile.continued(rows, "doc", "starts", "text").select("doc", "ord", "text")


@query(
    _with(v.CHART, v.HISTORY, _ACC)
    + """, w AS (SELECT reduced_code, ord, description, unnest(list_distinct(regexp_extract_all(lower(description), '[a-z]{3,}'))) AS word FROM chart WHERE reduced_code IS NOT NULL OR reduced_code IS NULL), a AS (SELECT DISTINCT c_mktsegment AS name, unnest(list_distinct(regexp_extract_all(lower(c_mktsegment || ' customer'), '[a-z]{3,}'))) AS word FROM customer),
s AS (SELECT name, reduced_code, ord, description, count(*) AS shared FROM a JOIN w USING (word) GROUP BY ALL) SELECT name, reduced_code FROM s LEFT JOIN activity USING (reduced_code) QUALIFY row_number() OVER (PARTITION BY name ORDER BY shared DESC, coalesce(activity, 0) DESC, length(description), ord) = 1"""
)
def accounts_by_words(spark, d):
    chart = v.chart(spark, d)
    active = acc.activity(acc.usable_history(v.history(spark, d), chart, PERIOD))
    names = v.table(spark, d, "customer").select(F.concat("c_mktsegment", F.lit(" customer")).alias("name")).distinct()
    return matching.account_by_words(names, chart, active).select(F.regexp_replace("name", " customer$", "").alias("name"), "reduced_code")


@query(
    """SELECT o_orderkey, CASE WHEN l >= 0.5 THEN 'local' WHEN g >= 0.6 THEN 'global' ELSE 'local' END AS source, CASE WHEN l >= 0.5 OR g >= 0.6 THEN 'Alta' ELSE 'Baixa' END AS confidence FROM (SELECT o_orderkey, (o_orderkey % 10) / 10.0 AS l, (o_orderkey % 7) / 7.0 AS g FROM orders)"""
)
def arbitrated_choices(spark, d):
    side = lambda p: F.struct(F.lit("1").alias("counterpart"), p.alias("probability"))
    rows = _orders(spark, d).select("o_orderkey", side((F.col("o_orderkey") % 10) / 10.0).alias("local"), side((F.col("o_orderkey") % 7) / 7.0).alias("global"))
    return models.arbitrated(rows, 0.5, 0.6).select("o_orderkey", "choice.source", "choice.confidence")


@query(
    _with(v.HISTORY) + """, h AS (SELECT *, strftime(date, '%Y-%m') AS m, CAST(ord % 5 AS VARCHAR) AS client_id FROM history), t AS (SELECT max(m) AS last FROM h), c AS (SELECT max(m) AS last FROM h WHERE client_id = '1')
SELECT (SELECT count(*) FROM h, t WHERE m < last) AS train, (SELECT count(*) FROM h, t WHERE m = last) AS test, (SELECT last FROM t) AS last, (SELECT count(*) FROM h, c WHERE client_id <> '1' AND m < last) AS others, (SELECT count(*) FROM h WHERE client_id = '1') AS own"""
)
def held_out_splits(spark, d):
    rows = v.history(spark, d).withColumn("client_id", (F.col("ord") % 5).cast("string"))
    train, test, last = models.temporal_split(rows)
    others, own = models.leave_one_out(rows, "1")
    return spark.createDataFrame([(train.count(), test.count(), last, others.count(), own.count())], "train long, test long, last string, others long, own long")


@query(
    _with(v.HISTORY)
    + """, f AS (SELECT debit_account || '|' || complement AS ft, debit_account || '|' || complement || '|' || CAST(amount AS VARCHAR) AS f, credit_account AS label FROM history), a AS (SELECT f, min(label) AS l FROM f GROUP BY 1 HAVING count(DISTINCT label) = 1), b AS (SELECT ft, min(label) AS l FROM f GROUP BY 1 HAVING count(DISTINCT label) = 1),
p AS (SELECT ord, debit_account || '|' || complement AS ft, debit_account || '|' || complement || '|' || CASE WHEN ord % 2 = 0 THEN CAST(amount AS VARCHAR) ELSE '0.00' END AS f FROM history)
SELECT ord, coalesce(a.l, b.l) AS label FROM p LEFT JOIN a USING (f) LEFT JOIN b USING (ft) WHERE coalesce(a.l, b.l) IS NOT NULL"""
)
def memory_choices(spark, d):
    h = v.history(spark, d)
    ft = F.concat_ws("|", "debit_account", "complement")
    rows = h.select(ft.alias("features_text"), F.concat_ws("|", ft, _s("amount")).alias("features"), F.col("credit_account").alias("label"))
    probes = h.select("ord", ft.alias("features_text"), F.concat_ws("|", ft, F.when(F.col("ord") % 2 == 0, _s("amount")).otherwise("0.00")).alias("features"))
    return models.memory_choice(rows, probes)


NAMES = tuple(n for n in QUERIES if n not in _BEFORE)

"""Printed invoices made of customers and suppliers: complete and broken forms, and the records that SQL expects of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import forms
from tallyforge.plans import views as v
from tallyforge.plans.catalogue import query


def _printed(value, prefix=""):
    return F.concat(F.lit(prefix), F.replace(value.cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")))


def _words(spark, d):
    """One form a customer. Codes stand between a label and its values, values lie too low, words are printed twice, covers come first, and cells are empty or wrong, each in some forms."""
    K = F.col("c_custkey")  # noqa: N806
    customer, supplier, nation = v.dealt(spark, d, "customer"), v.table(spark, d, "supplier"), v.table(spark, d, "nation")
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(supplier.select("s_suppkey", "s_name"), F.col("s_suppkey") == K % 13, "left")
    text = lambda c: c.cast("string")
    dash = lambda when, value: F.when(when, F.lit("-")).otherwise(value)
    only = lambda when, value: F.when(when, value)
    low = F.when(K % 9 == 0, 68.0).otherwise(55.0)
    balance = F.col("c_acctbal")
    cells = [
        (10, 5, F.concat(F.lit("DANFSe v2."), text(K % 3))), (10, 200, "Documento Auxiliar da NFS-e"), (10, 505, F.col("n_name")), (20, 5, "CHAVE DE ACESSO DA NFS-e"),
        (30, 5, F.when(K % 17 == 0, F.lpad(text(K), 10, "0")).otherwise(F.concat(F.lpad(text(K), 7, "0"), text(K % 2 + 1), F.lit("1" * 42)))),
        (40, 5, "NÚMERO DA NFS-e"), (46, 500, only(K % 3 == 0, F.lit("QR"))), (low, 5, text(K)), (low, 150, F.concat(F.lit("01/"), F.lpad(text(K % 14 + 1), 2, "0"), F.lit("/2024"))),
        (low, 300, F.concat(F.lit("03/02/2024 10:"), F.lpad(text(K % 60), 2, "0"))), (80, 5, "NÚMERO DA DPS"), (90, 5, text(K % 100)), (90, 150, F.concat(F.lit("S"), text(K % 5))), (100, 150, "SITUAÇÃO DA NFS-e"), (110, 150, F.col("c_mktsegment")),
        (120, 5, "PRESTADOR / FORNECEDOR DA NFS-e"), (130, 5, "CPF / CNPJ / NIF"), (140, 5, F.coalesce(F.lpad(text(F.col("s_suppkey")), 14, "4"), F.lit("-"))), (150, 5, "NOME / NOME EMPRESARIAL"), (160, 5, F.coalesce("s_name", F.lit("-"))),
        (190, 5, "TOMADOR / ADQUIRENTE DA OPERAÇÃO"), (200, 5, "CPF / CNPJ / NIF"), (210, 5, F.when(K % 3 == 0, F.lpad(text(K), 14, "5")).when(K % 3 == 1, F.lpad(text(K), 11, "6")).otherwise("-")),
        (220, 5, "NOME / NOME EMPRESARIAL"), (230, 5, F.col("c_name")), (230, 300, F.concat(F.col("n_name"), F.when(K % 5 != 0, F.lit(" / bR")).otherwise(""))), (230, 450, F.concat(F.lit("35"), text(K), F.lit(" / "), text(K % 1000))),
        (240, 5, "ENDEREÇO"), (250, 5, F.concat(F.lit("Rua "), text(K))), (250, 300, "a@b.example"), (270, 5, "SERVIÇO PRESTADO"), (280, 5, "CÓD. TRIBUTAÇÃO NACIONAL / MUNICIPAL"),
        (290, 5, F.when(K % 4 == 0, text(K % 10)).otherwise(F.concat(text(K % 10), F.lit(" / "), text(K % 7)))), (290, 400, F.col("n_name")), (300, 5, only(K % 6 != 0, F.concat(F.lit("grupo "), text(K % 5)))),
        (310, 5, "DESCRIÇÃO DO SERVIÇO"), (320, 5, only(K % 19 != 0, F.concat(F.lit("trabalho "), text(K)))), (330, 5, only((K % 19 != 0) & (K % 2 == 0), F.concat(F.lit("parte "), text(K % 4)))),
        (350, 5, "TRIBUTAÇÃO MUNICIPAL (ISSQN)"), (360, 5, "TIPO DE TRIBUTAÇÃO DO ISSQN"), (370, 5, "Tributável"), (380, 110, "BC ISSQN"), (380, 355, "RETENÇÃO DO ISSQN"), (380, 470, "ISSQN APURADO"),
        (390, 110, _printed(balance, "R$ ")), (390, 355, F.when(K % 2 == 0, "Retido").otherwise("Não Retido")), (390, 470, F.when(K % 11 == 0, "isento").otherwise(_printed(balance))), (400, 5, "TRIBUTAÇÃO FEDERAL (EXCETO CBS)"),
        (410, 5, "IRRF"), (420, 5, dash(K % 3 != 0, _printed(F.col("c_nationkey")))), (440, 5, "TRIBUTAÇÃO IBS / CBS"), (450, 5, "BC APÓS EXCLUSÕES E REDUÇÕES"), (450, 400, "ALÍQUOTA IBS UF / MUN"),
        (460, 5, dash(K % 2 == 1, _printed(balance))), (460, 400, dash(K % 4 != 0, F.lit("0,10% / 0,05%"))), (470, 5, "VALOR TOTAL APURADO - IBS"), (480, 5, dash(K % 4 != 2, F.lit("1,50"))),
        (500, 5, "VALOR TOTAL DA NFS-e"), (510, 5, "VALOR DO SERVIÇO"), (520, 5, dash(K % 13 == 0, _printed(balance, "R$ "))), (530, 5, "VALOR LÍQUIDO DA NFS-e"), (530, 200, "TOTAL DO IBS/CBS"), (540, 5, _printed(balance)), (540, 200, "7,25"),
    ]
    col = lambda c, t: (F.lit(c) if isinstance(c, (int, str)) else c).cast(t)
    form = F.array(*[F.struct(col(top, "double").alias("top"), F.lit(float(x)).alias("x"), col(t, "string").alias("t")) for top, x, t in cells])
    covered = (K % 6 == 0) & (K % 17 != 0)
    page = F.when(covered, 2).otherwise(1)
    cover = F.when(covered, F.array(F.struct(F.lit(10.0).alias("top"), F.lit(5.0).alias("x"), F.lit("NÚMERO DA NFS-e capa").alias("t")))).otherwise(F.array().cast("array<struct<top:double,x:double,t:string>>"))
    both = rows.select(K.alias("doc"), page.alias("page"), F.inline(form)).unionByName(rows.select(K.alias("doc"), F.lit(1).alias("page"), F.inline(cover)))
    words = both.where("t is not null").select("doc", "page", "top", "x", F.posexplode(F.split("t", " ")).alias("i", "text"))
    words = words.select("doc", "page", "top", (F.col("x") + F.col("i") * 3).alias("x0"), "text", F.explode(F.when(F.col("doc") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("ord"))
    return words.withColumns({"x1": F.col("x0") + 2, "bottom": F.col("top") + 8})


@query(
    """SELECT k AS doc, CASE WHEN k % 6 = 0 AND k % 17 <> 0 THEN 2 ELSE 1 END AS page, k % 17 <> 0 AS recognised, '2.' || k % 3 AS version, key, substr(key, 8, 1) AS environment, substr(key, 1, 7) AS issue_code, n_name AS issue_name,
  CASE WHEN k % 9 <> 0 THEN CAST(k AS VARCHAR) END AS number, CASE WHEN k % 9 <> 0 AND k % 14 < 12 THEN '2024-' || lpad(CAST(k % 14 + 1 AS VARCHAR), 2, '0') || '-01' END AS competence_date,
  CASE WHEN k % 9 <> 0 THEN '2024-02-03 10:' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || ':00' END AS issue_datetime, CAST(k % 100 AS VARCHAR) || '/S' || k % 5 AS dps, c_mktsegment AS status,
  CASE WHEN s_name IS NOT NULL THEN lpad(CAST(s_suppkey AS VARCHAR), 14, '4') || ' CNPJ ' || s_name END AS provider,
  CASE k % 3 WHEN 0 THEN lpad(CAST(k AS VARCHAR), 14, '5') || ' CNPJ ' || c_name WHEN 1 THEN lpad(CAST(k AS VARCHAR), 11, '6') || ' CPF ' || c_name END AS customer,
  CASE WHEN k % 5 <> 0 THEN 'BR' END AS state, '35' || k || '|' || k % 1000 || '|Rua ' || k || '|a@b.example' AS place, CAST(k % 10 AS VARCHAR) AS national_tax_code, CASE WHEN k % 4 <> 0 THEN CAST(k % 7 AS VARCHAR) END AS municipal_tax_code,
  CASE WHEN k % 6 <> 0 THEN 'grupo ' || k % 5 END AS national_tax_description, CASE WHEN k % 19 <> 0 THEN 'trabalho ' || k || CASE WHEN k % 2 = 0 THEN ' parte ' || k % 4 ELSE '' END END AS description,
  CASE WHEN k % 2 = 0 THEN 'Retido' ELSE 'Não Retido' END AS iss_type, b AS taxable_base, CASE WHEN k % 11 <> 0 THEN b END AS iss, CASE WHEN k % 3 = 0 THEN c_nationkey END AS ir, CASE WHEN k % 13 <> 0 THEN b END AS gross, b AS net,
  CASE WHEN k % 2 = 0 THEN b END AS ibs_base, CASE WHEN k % 4 = 0 THEN 0.1 END AS ibs_state_rate, CASE WHEN k % 4 = 0 THEN 0.05 END AS ibs_municipal_rate, CASE k % 4 WHEN 2 THEN 1.5 WHEN 0 THEN 7.25 END AS ibs_total,
  array_to_string(list_sort(list_filter([CASE WHEN k % 17 = 0 THEN 'invalid_printed_key:key' END, CASE WHEN k % 9 = 0 THEN 'missing_required_evidence:number' END, CASE WHEN k % 9 = 0 THEN 'missing_required_evidence:competence_date' END,
    CASE WHEN k % 9 = 0 THEN 'missing_required_evidence:issue_datetime' END, CASE WHEN k % 9 <> 0 AND k % 14 >= 12 THEN 'invalid_printed_date:competence_date' END, CASE WHEN s_name IS NULL THEN 'missing_required_evidence:provider.name' END,
    CASE WHEN s_name IS NULL THEN 'missing_required_evidence:provider.tax_id' END, CASE WHEN k % 3 = 2 THEN 'missing_required_evidence:customer.tax_id' END, CASE WHEN k % 11 = 0 THEN 'unparseable_printed_value:amounts.iss' END,
    CASE WHEN k % 13 = 0 THEN 'missing_required_evidence:amounts.gross' END, CASE WHEN k % 19 = 0 THEN 'missing_required_evidence:service.description' END], lambda x: x IS NOT NULL)), ',') AS issues
FROM (SELECT *, c_custkey AS k, CAST(c_acctbal AS DECIMAL(18,2)) AS b, CASE WHEN c_custkey % 17 <> 0 THEN lpad(CAST(c_custkey AS VARCHAR), 7, '0') || (c_custkey % 2 + 1) || repeat('1', 42) END AS key
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_suppkey = c_custkey % 13)""",
    amounts=("taxable_base", "iss", "ir", "gross", "net", "ibs_base", "ibs_state_rate", "ibs_municipal_rate", "ibs_total"),
    dates=("competence_date", "issue_datetime"),
)
def printed_invoice_records(spark, d):
    """Every customer's printed form to its record: parties, service, taxes, optional groups and what the form lacks."""
    r = forms.printed_invoices(_words(spark, d))
    party = lambda p: F.when(F.col(f"{p}.tax_id").isNotNull(), F.concat_ws(" ", f"{p}.tax_id", f"{p}.tax_id_type", f"{p}.name"))
    return r.select(
        "doc", "page", "recognised", "version", "key", "environment", "locations.issue_code", "locations.issue_name", "number", "competence_date", F.date_format("issue_datetime", "yyyy-MM-dd HH:mm:ss").alias("issue_datetime"), F.concat_ws("/", "dps.number", "dps.series").alias("dps"), "status",
        party("provider").alias("provider"), party("customer").alias("customer"), "customer.address.state", F.concat_ws("|", "customer.address.municipality_code", "customer.address.postal_code", "customer.address.street", "customer.email").alias("place"),
        "service.national_tax_code", "service.municipal_tax_code", "service.national_tax_description", "service.description", "retentions.iss_type", "amounts.taxable_base", "amounts.iss", "retentions.ir", "amounts.gross", "amounts.net",
        F.col("taxes.ibs_cbs.taxable_base").alias("ibs_base"), "taxes.ibs_cbs.ibs_state_rate", "taxes.ibs_cbs.ibs_municipal_rate", "taxes.ibs_cbs.ibs_total",
        F.array_join(F.array_sort(F.transform("issues", lambda i: F.concat_ws(":", i["code"], i["field"]))), ",").alias("issues"),
    )

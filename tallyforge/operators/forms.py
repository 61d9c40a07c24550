"""Printed service invoices: the lines of a form, its sections and labels, and the cells that stand below them.

The form is data: a label is looked for behind others (``ANCHORS``) and a cell is a stretch of the width in a line below a label
(``CELLS``). All of a page's lines are one array, so a page is resolved where it lies, after one shuffle of its words.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.money import EXACT, parse_printed
from tallyforge.functions.text import clean, fold, folded, let
from tallyforge.lineage import tasks
from tallyforge.operators.printed import TOLERANCE, is_printed_invoice, line_text, page_lines

WIDTH = 595.0
LOOK_AHEAD = 18.0
#: Lines that can be so near: each begins more than the tolerance below the one before.
_NEAR = int(LOOK_AHEAD / TOLERANCE)
DEFAULT_VERSION = "2.0"

# The form's labels. Each is the first line with that text behind the first of the named lines that was found
# ("x.below" is the line under x), and before the last named line if that was found.
ANCHORS = [
    ("heading", "DANFSe", [], None),
    ("key", "CHAVE DE ACESSO DA NFS-e", [], None),
    ("number", "NÚMERO DA NFS-e", [], None),
    ("dps", "NÚMERO DA DPS", ["number.below", "number"], None),
    ("status", "SITUAÇÃO DA NFS-e", ["dps.below", "dps"], None),
    ("provider", "PRESTADOR / FORNECEDOR DA NFS-e", [], None),
    ("customer", "TOMADOR / ADQUIRENTE DA OPERAÇÃO", ["provider"], None),
    ("service", "SERVIÇO PRESTADO", ["customer"], None),
    ("provider_id", "CPF / CNPJ / NIF", ["provider"], "customer"),
    ("provider_name", "NOME / NOME EMPRESARIAL", ["provider_id.below", "provider_id", "provider"], "customer"),
    ("provider_address", "ENDEREÇO", ["provider_name.below", "provider_name", "provider"], "customer"),
    ("customer_id", "CPF / CNPJ / NIF", ["customer"], "service"),
    ("customer_name", "NOME / NOME EMPRESARIAL", ["customer_id.below", "customer_id", "customer"], "service"),
    ("customer_address", "ENDEREÇO", ["customer_name.below", "customer_name", "customer"], "service"),
    ("codes", "CÓD. TRIBUTAÇÃO NACIONAL / MUNICIPAL", ["service"], None),
    ("description", "DESCRIÇÃO DO SERVIÇO", ["codes.below", "codes"], None),
    ("municipal", "TRIBUTAÇÃO MUNICIPAL (ISSQN)", ["description", "codes.below"], None),
    ("taxation", "TIPO DE TRIBUTAÇÃO DO ISSQN", ["municipal"], None),
    ("incidence", "MUNICÍPIO / UF / PAÍS DA INCIDÊNCIA", ["municipal"], None),
    ("base", "BC ISSQN", ["taxation", "municipal"], None),
    ("rate", "ALÍQUOTA APLICADA", ["taxation", "municipal"], None),
    ("retention", "RETENÇÃO DO ISSQN", ["taxation", "municipal"], None),
    ("iss", "ISSQN APURADO", ["taxation", "municipal"], None),
    ("federal", "TRIBUTAÇÃO FEDERAL (EXCETO CBS)", ["municipal"], None),
    ("ir", "IRRF", ["federal"], None),
    ("inss", "CONTRIBUIÇÃO PREVIDENCIÁRIA", ["federal"], None),
    ("pis", "PIS - DÉBITO APURAÇÃO PRÓPRIA", ["federal"], None),
    ("cofins", "COFINS - DÉBITO APURAÇÃO PRÓPRIA", ["federal"], None),
    ("ibs", "TRIBUTAÇÃO IBS / CBS", ["federal"], None),
    ("total", "VALOR TOTAL DA NFS-e", ["ibs", "federal"], None),
    ("ibs_incidence", "IND. OPERAÇÃO / MUNICÍPIO INCIDÊNCIA", ["ibs"], "total"),
    ("ibs_base", "BC APÓS EXCLUSÕES E REDUÇÕES", ["ibs"], "total"),
    ("ibs_rates", "ALÍQUOTA IBS UF / MUN", ["ibs"], "total"),
    ("ibs_municipal_rate", "ALÍQ. EFETIVA MUNICIPAL - IBS", ["ibs"], "total"),
    ("ibs_municipal", "VALOR APURADO MUNICIPAL - IBS", ["ibs"], "total"),
    ("ibs_state_rate", "ALÍQ. EFETIVA ESTADUAL - IBS", ["ibs"], "total"),
    ("ibs_state", "VALOR APURADO ESTADUAL - IBS", ["ibs"], "total"),
    ("ibs_total", "VALOR TOTAL APURADO - IBS", ["ibs"], "total"),
    ("cbs_rate", "ALÍQUOTA - CBS", ["ibs"], "total"),
    ("cbs_effective", "ALÍQUOTA EFETIVA - CBS", ["ibs"], "total"),
    ("cbs", "VALOR TOTAL APURADO - CBS", ["ibs"], "total"),
    ("gross", "VALOR DO SERVIÇO", ["total"], None),
    ("unconditional", "DESCONTO INCONDICIONADO", ["total"], None),
    ("conditional", "DESCONTO CONDICIONADO", ["total"], None),
    ("retained", "TOTAL DAS RETENÇÕES", ["total"], None),
    ("net", "VALOR LÍQUIDO DA NFS-e", ["total"], None),
    ("summary", "TOTAL DO IBS/CBS", ["total"], None),
    ("invoice_total", "VALOR LÍQUIDO + IBS/CBS", ["total"], None),
]


_SPEC = "label string, behind array<struct<i:int,below:int>>, before int"
_CELL = "field string, at string, x0 double, x1 double, kind string, must boolean"


def _party_cells(party: str) -> list[tuple]:
    return [
        (f"{party}.tax_id", f"{party}_id.below", 0, 190, "text", True), (f"{party}.municipal_registration", f"{party}_id.below", 190, 385, "text", False), (f"{party}.phone", f"{party}_id.below", 385, 595, "text", False),
        (f"{party}.name", f"{party}_name.below", 0, 290, "text", True), (f"{party}.address.state", f"{party}_name.below", 290, 440, "text", False), (f"{party}.address.postal_code", f"{party}_name.below", 440, 595, "text", False),
        (f"{party}.address.street", f"{party}_address.below", 0, 290, "text", False), (f"{party}.email", f"{party}_address.below", 290, 595, "text", False),
    ]


# The cells: field, line, left and right end, kind, and whether the form must have it.
CELLS = [
    ("key", "key.below", 0, 595, "text", True), ("locations.issue_name", "heading", 500, 595, "text", False),
    ("number", "number.below", 0, 145, "text", True), ("competence_date", "number.below", 145, 290, "date", True), ("issue_datetime", "number.below", 290, 440, "datetime", True),
    ("dps.number", "dps.below", 0, 145, "text", True), ("dps.series", "dps.below", 145, 290, "text", True), ("dps.issue_datetime", "dps.below", 290, 440, "text", False),
    ("status", "status.below", 145, 290, "text", True), *_party_cells("provider"), *_party_cells("customer"),
    ("service.tax_codes", "codes.below", 0, 190, "text", False), ("service.nbs_code", "codes.below", 190, 385, "text", False), ("locations.service_name", "codes.below", 385, 595, "text", False),
    ("taxes.iss_taxation", "taxation.below", 0, 190, "text", False), ("locations.incidence_name", "incidence.below", 190, 385, "text", False),
    ("amounts.taxable_base", "base.below", 100, 230, "money", False), ("amounts.rate", "rate.below", 230, 350, "money", False), ("retentions.iss_type", "retention.below", 350, 465, "text", False), ("amounts.iss", "iss.below", 465, 595, "money", False),
    ("retentions.ir", "ir.below", 0, 190, "money", False), ("retentions.inss", "inss.below", 190, 385, "money", False), ("retentions.pis", "pis.below", 0, 190, "money", False), ("retentions.cofins", "cofins.below", 190, 385, "money", False),
    ("taxes.ibs_cbs.incidence", "ibs_incidence.below", 190, 385, "text", False), ("taxes.ibs_cbs.taxable_base", "ibs_base.below", 0, 145, "money", False), ("taxes.ibs_cbs.rates", "ibs_rates.below", 385, 595, "text", False),
    ("taxes.ibs_cbs.ibs_municipal_effective_rate", "ibs_municipal_rate.below", 0, 145, "money", False), ("taxes.ibs_cbs.ibs_municipal", "ibs_municipal.below", 145, 290, "money", False),
    ("taxes.ibs_cbs.ibs_state_effective_rate", "ibs_state_rate.below", 290, 440, "money", False), ("taxes.ibs_cbs.ibs_state", "ibs_state.below", 440, 595, "money", False), ("taxes.ibs_cbs.ibs_total", "ibs_total.below", 0, 145, "money", False),
    ("taxes.ibs_cbs.cbs_rate", "cbs_rate.below", 145, 290, "money", False), ("taxes.ibs_cbs.cbs_effective_rate", "cbs_effective.below", 290, 440, "money", False), ("taxes.ibs_cbs.cbs", "cbs.below", 440, 595, "money", False),
    ("amounts.gross", "gross.below", 0, 145, "money", True), ("amounts.unconditional_discount", "unconditional.below", 145, 290, "money", False), ("amounts.conditional_discount", "conditional.below", 290, 440, "money", False), ("amounts.retained_total", "retained.below", 440, 595, "money", False),
    ("amounts.net", "net.below", 0, 190, "money", False), ("taxes.ibs_cbs.summary_total", "summary.below", 190, 385, "money", False), ("taxes.ibs_cbs.invoice_total", "invoice_total.below", 385, 595, "money", False),
]


def _table(rows: list[tuple], fields: str) -> Column:
    """Rows as one constant array of structs; the optimizer reads it once, while the plan is made."""
    names = [f.split(" ")[0] for f in fields.split(", ")]
    return F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")


def _first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def _text_in(line: Column, left: Column, right: Column) -> Column:
    middle = lambda w: (w["x0"] + w["x1"]) / 2
    return F.array_join(F.transform(F.filter(line["words"], lambda w: (middle(w) >= left) & (middle(w) < right)), lambda w: w["text"]), " ")


def form_pages(words: DataFrame, anchors: list[tuple] = ANCHORS) -> DataFrame:
    """doc, page, recognised, lines: of each document the first page that is an invoice for certain, else its first page.

    A line is (n, top, bottom, text, words, labels); a page's lines are bounded by the page. Words without text or place are passed over.
    """
    placed = words.where("text <> '' and x0 is not null and x1 is not null and top is not null")
    labels = F.array(*[F.lit(label) for label in dict.fromkeys(folded(a[1]) for a in anchors)])

    def line(x: Column, text: Column) -> Column:
        # the text is folded once for all labels
        found = let(fold(text), lambda f: F.filter(labels, lambda label: F.contains(f, label)))
        return F.struct(x["line"].alias("n"), x["top"].alias("top"), x["bottom"].alias("bottom"), text.alias("text"), x["words"].alias("words"), found.alias("labels"))

    # all pages of a document meet in one task, as the page that counts is chosen of them: dealt by document, the words are shuffled once;
    # to so many tasks, as their bytes are few for what is made of them
    page = page_lines(placed.repartition(tasks(words), "doc")).select("doc", "page", F.transform("lines", lambda x: let(line_text(x["words"]), lambda text: line(x, text))).alias("lines"))
    known = page.withColumn("recognised", F.coalesce(is_printed_invoice(line_text(F.col("lines"))), F.lit(False)))
    chosen = known.groupBy("doc").agg(F.min_by(F.struct("page", "recognised", "lines"), F.struct(~F.col("recognised"), F.col("page"))).alias("_p"))
    return chosen.select("doc", "_p.*")


def found_lines(lines: Column, anchors: list[tuple] = ANCHORS) -> Column:
    """map of a label's name, and of name.below, to the number of its line; labels that are not there are missing in it.

    The fold keeps an array of the lines found so far by the label's place in ``anchors`` (null: not there), so that a label finds those it is behind at once.
    """
    place = {name: i for i, (name, *_) in enumerate(anchors)}
    at = lambda name: (place[name.removesuffix(".below")], int(name.endswith(".below")))
    specs = _table([(folded(label), [dict(zip(("i", "below"), at(b))) for b in behind], place[before] if before else None) for _, label, behind, before in anchors], _SPEC)
    hits = F.flatten(F.transform(lines, lambda x: F.transform(x["labels"], lambda label: F.struct(label.alias("label"), x["n"].alias("n")))))

    def walk(hits: Column, size: Column) -> Column:
        def step(found: Column, spec: Column) -> Column:
            known = lambda r: F.get(found, r["i"]) + r["below"]
            behind = F.filter(F.transform(spec["behind"], known), lambda n: n <= size)
            bounds = F.struct(F.coalesce(_first(behind), F.lit(0)).alias("after"), F.coalesce(F.get(found, spec["before"]), size + 1).alias("until"))
            fits = lambda b: _first(F.filter(hits, lambda h: (h["label"] == spec["label"]) & (h["n"] > b["after"]) & (h["n"] < b["until"])))["n"].cast("int")
            return F.concat(found, F.array(let(bounds, fits)))

        names = F.array(*[F.array(F.lit(name), F.lit(f"{name}.below")) for name in place])
        entry = lambda names, n, by: F.struct(F.get(names, F.lit(by)).alias("key"), (n + by).alias("value"))
        both = lambda n, i: let(F.get(names, i), lambda two: F.array(entry(two, n, 0), entry(two, n, 1)))
        found = F.aggregate(specs, F.array().cast("array<int>"), step)
        return F.map_from_entries(F.filter(F.flatten(F.transform(found, both)), lambda e: e["value"] <= size))

    return let(hits, lambda hits: let(F.size(lines), lambda size: walk(hits, size)))


def cell_values(lines: Column, found: Column, cells: list[tuple] = CELLS) -> Column:
    """map of field to struct(text, excerpt, x0, x1, top, bottom); fields whose line is not there are missing in it.

    Where a cell's own stretch is empty in its line, as beside a code that is printed between label and value, the first line
    not more than 18 points below that has anything there counts. A lone dash is an empty value.
    """
    placed = F.filter(F.transform(_table(cells, _CELL), lambda s: F.struct(s["field"].alias("field"), s["x0"].alias("x0"), s["x1"].alias("x1"), F.try_element_at(found, s["at"]).alias("n"))), lambda s: s["n"].isNotNull())

    def read(s: Column) -> Column:
        text = lambda x: F.struct(_text_in(x, s["x0"], s["x1"]).alias("excerpt"), x["top"].alias("top"), x["bottom"].alias("bottom"))
        below = lambda own: F.filter(F.slice(lines, s["n"] + 1, _NEAR), lambda x: x["top"] - own["top"] <= LOOK_AHEAD)
        # the lines below are only read where there is nothing in the cell's own
        hit = lambda own: F.when(own["excerpt"] != "", own).otherwise(F.coalesce(_first(F.filter(F.transform(below(own), text), lambda u: u["excerpt"] != "")), own))
        return let(let(text(F.element_at(lines, s["n"])), hit), lambda hit: entry(s, hit))

    def entry(s: Column, hit: Column) -> Column:
        text = let(clean(hit["excerpt"]), lambda t: F.when(t != "-", t))
        return F.struct(s["field"].alias("key"), F.struct(text.alias("text"), hit["excerpt"].alias("excerpt"), s["x0"].alias("x0"), s["x1"].alias("x1"), hit["top"].alias("top"), hit["bottom"].alias("bottom")).alias("value"))

    return F.map_from_entries(F.transform(placed, read))


def between(lines: Column, start: Column, end: Column) -> Column:
    """The text of the lines behind one and before another, or to the end where that is missing; null without a start or text."""
    inside = F.slice(lines, start + 1, F.greatest(F.coalesce(end, F.size(lines) + 1) - start - 1, F.lit(0)))
    return let(clean(F.array_join(F.transform(inside, lambda x: x["text"]), " ")), lambda t: F.when(t != "-", t))


def _piece(text: Column, n: int, separator: str = "/") -> Column:
    return F.nullif(F.trim(F.get(F.split(text, separator), F.lit(n - 1))), F.lit(""))


def printed_day(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "d/M/yyyy"))


def printed_moment(text: Column) -> Column:
    """Day and time, with or without seconds, as printed: without a zone."""
    pattern = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?$"
    part = lambda i: F.regexp_extract(text, pattern, i).try_cast("int")
    return F.when(text.rlike(pattern), F.try_make_timestamp_ntz(part(3), part(2), part(1), part(4), part(5), F.coalesce(part(6), F.lit(0)).cast("decimal(8,6)")))


def _party(at, party: str) -> Column:
    digits = F.nullif(F.regexp_replace(at(f"{party}.tax_id"), r"\D", ""), F.lit(""))
    kind = F.when(F.length(digits) == 14, "CNPJ").when(F.length(digits) == 11, "CPF").when(digits.isNotNull(), "unknown")
    state = F.upper(F.nullif(F.regexp_extract(at(f"{party}.address.state"), r"/\s*([A-Za-z]{2})$", 1), F.lit("")))
    place = at(f"{party}.address.postal_code")
    address = F.struct(_piece(place, 1).alias("municipality_code"), at(f"{party}.address.street").alias("street"), state.alias("state"), _piece(place, 2).alias("postal_code"))
    return F.struct(digits.alias("tax_id"), kind.alias("tax_id_type"), *[at(f"{party}.{f}").alias(f) for f in ("name", "municipal_registration", "phone", "email")], address.alias("address"))


def _group(at_money, names: list[str], prefix: str) -> list[Column]:
    return [at_money(f"{prefix}.{n}").alias(n) for n in names]


def printed_invoices(words: DataFrame) -> DataFrame:
    """A record for each document of words (doc, page, ord, text, x0, x1, top, bottom).

    Parties, service, amounts, retentions and taxes; ibs_cbs is null where nothing of it is printed; ``provenance`` tells page, place
    and excerpt of each cell that was read; ``issues`` (code, field, value) what the form must have and lacks, or what can't be read as what
    it should be. Nothing is made up: what is not printed is null. Words printed twice count once and their order does not matter; a document without a placed
    word has no record.
    """
    pages = form_pages(words).withColumn("_found", found_lines(F.col("lines")))
    read = pages.withColumn("_v", cell_values(F.col("lines"), F.col("_found")))
    line = lambda name: F.try_element_at("_found", F.lit(name))
    heading = F.try_element_at("lines", F.coalesce(line("heading"), F.lit(0) + F.size("lines") + 1))["text"]
    read = read.select(
        "doc", "page", "recognised", "_v", F.coalesce(F.nullif(F.regexp_extract(heading, r"(?i)v\s*(\d+(?:\.\d+)?)", 1), F.lit("")), F.lit(DEFAULT_VERSION)).alias("version"),
        between(F.col("lines"), line("codes.below"), line("description")).alias("_national"), between(F.col("lines"), line("description"), line("municipal")).alias("_description"),
    )
    at = lambda field: F.try_element_at("_v", F.lit(field))["text"]
    # every amount is read once: the records and the issues both need it
    wanted = F.array(*[F.lit(field) for field, *_, kind, _ in CELLS if kind == "money"])
    amounts = F.map_from_entries(F.transform(wanted, lambda f: F.struct(f.alias("key"), parse_printed(F.try_element_at("_v", f)["text"]).cast(EXACT).alias("value"))))
    read = read.withColumn("_m", amounts).withColumn("key", F.nullif(F.regexp_extract(at("key"), r"\d{50}", 0), F.lit(""))).withColumn("competence_date", printed_day(at("competence_date"))).withColumn("issue_datetime", printed_moment(at("issue_datetime")))
    money = lambda field: F.try_element_at("_m", F.lit(field))
    rates = [parse_printed(_piece(at("taxes.ibs_cbs.rates"), n)).cast(EXACT) for n in (1, 2)]
    ibs = "taxes.ibs_cbs"
    has_ibs = F.coalesce(money(f"{ibs}.taxable_base"), *rates, money(f"{ibs}.ibs_total"), money(f"{ibs}.cbs")).isNotNull()
    ibs_cbs = F.struct(
        _piece(at(f"{ibs}.incidence"), 2).alias("incidence_location_code"), _piece(at(f"{ibs}.incidence"), 3).alias("incidence_location_name"), rates[0].alias("ibs_state_rate"), rates[1].alias("ibs_municipal_rate"),
        F.coalesce(money(f"{ibs}.ibs_total"), money(f"{ibs}.summary_total")).alias("ibs_total"),
        *_group(money, ["taxable_base", "ibs_state_effective_rate", "ibs_municipal_effective_rate", "cbs_rate", "cbs_effective_rate", "invoice_total", "ibs_state", "ibs_municipal", "cbs"], ibs),
    )
    return read.select(
        "doc", "page", "recognised", "version", "key", at("number").alias("number"), F.struct(at("dps.number").alias("number"), at("dps.series").alias("series")).alias("dps"),
        F.nullif(F.substring("key", 8, 1), F.lit("")).alias("environment"), at("status").alias("status"), "issue_datetime", "competence_date", _party(at, "provider").alias("provider"), _party(at, "customer").alias("customer"),
        F.struct(F.substring("key", 1, 7).alias("issue_code"), *[at(f"locations.{f}").alias(f) for f in ("issue_name", "service_name", "incidence_name")]).alias("locations"),
        F.struct(
            _piece(at("service.tax_codes"), 1).alias("national_tax_code"), _piece(at("service.tax_codes"), 2).alias("municipal_tax_code"), at("service.nbs_code").alias("nbs_code"),
            F.col("_national").alias("national_tax_description"), F.col("_description").alias("description"),
        ).alias("service"),
        F.struct(F.lit("BRL").alias("currency"), *_group(money, ["gross", "taxable_base", "rate", "iss", "retained_total", "unconditional_discount", "conditional_discount", "net"], "amounts")).alias("amounts"),
        F.struct(at("retentions.iss_type").alias("iss_type"), *_group(money, ["ir", "inss", "pis", "cofins"], "retentions")).alias("retentions"),
        F.struct(at("taxes.iss_taxation").alias("iss_taxation"), F.when(has_ibs, ibs_cbs).alias("ibs_cbs")).alias("taxes"),
        F.transform_values("_v", lambda k, v: F.struct(F.col("page").alias("page"), v["x0"].alias("x0"), v["x1"].alias("x1"), v["top"].alias("top"), v["bottom"].alias("bottom"), v["excerpt"].alias("excerpt"))).alias("provenance"),
        _issues(at).alias("issues"),
    )


def for_rules(records: DataFrame) -> DataFrame:
    """Printed records in the columns that the rules for invoices go by; the key's own digits name the environment and the municipality."""
    return records.select("doc", "key", "number", F.col("locations.issue_code").alias("issue_code"), F.col("environment").alias("generation_environment"), "provider", "customer", "amounts")


def _issues(at) -> Column:
    """What the form must have and lacks, and what is printed but can't be read, as (code, field, value)."""
    kind = "struct<code:string,field:string,value:string>"

    def issue(when: Column, code: str, field: str, value: Column | None = None) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), (F.lit(None) if value is None else value).cast("string").alias("value")))

    def of(field: str, money: bool, must: bool) -> Column:
        lacks = issue(at(field).isNull(), "missing_required_evidence", field) if must else F.lit(None)
        unread = issue(at(field).isNotNull() & F.try_element_at("_m", F.lit(field)).isNull(), "unparseable_printed_value", field, at(field)) if money else F.lit(None)
        return F.coalesce(lacks, unread)

    cells = F.array(*[of(field, kind == "money", must) for field, *_, kind, must in CELLS if must or kind == "money"])
    more = F.array(
        issue(at("key").isNotNull() & F.col("key").isNull(), "invalid_printed_key", "key", at("key")),
        issue(at("competence_date").isNotNull() & F.col("competence_date").isNull(), "invalid_printed_date", "competence_date", at("competence_date")),
        issue(at("issue_datetime").isNotNull() & F.col("issue_datetime").isNull(), "invalid_printed_date", "issue_datetime", at("issue_datetime")),
        issue(F.col("_description").isNull(), "missing_required_evidence", "service.description"),
    )
    return F.filter(F.concat(cells.cast(f"array<{kind}>"), more.cast(f"array<{kind}>")), lambda i: i.isNotNull())

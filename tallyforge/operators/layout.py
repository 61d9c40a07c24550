"""Layouts: titles to fields, families, recipes, column types, word lines and bands. Input is the cells or words relation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.money import parse_date, parse_money
from tallyforge.functions.text import clean, fold, let
from tallyforge.lineage import large, tasks

# Folded titles of each field.
ALIASES = {
    "date": ("DATA", "DATAMOVIMENTO", "DATALANCAMENTO"),
    "description": ("LANCAMENTO", "HISTORICO", "DESCRICAO", "HISTORICOPADRAO"),
    "counterparty": ("RAZAOSOCIAL", "CLIENTEFORNECEDOR", "CLIENTE", "FORNECEDOR", "CONTRAPARTE"),
    "tax_id": ("CPFCNPJ", "CNPJCPF", "CNPJ", "CPF"),
    "amount": ("VALOR", "VALORR", "VALORRS"),
    "credit": ("CREDITO", "CREDITOR"),
    "debit": ("DEBITO", "DEBITOR"),
    "balance": ("SALDO", "SALDOR", "SALDOATUAL"),
    "document": ("DCTO", "DOCUMENTO", "DOC", "NUMERODOCUMENTO"),
    "inflow": ("ENTRADA",),
    "outflow": ("SAIDA",),
    "issue_date": ("EMISSAO", "DATAEMISSAO"),
    "notes": ("ANOTACOES", "ANOTACAO", "OBSERVACAO", "OBSERVACOES"),
}
# Abbreviated titles.
ABBREVIATIONS = {
    "DT": "date", "DTMOV": "date", "DTMOVIMENTO": "date",
    "DESC": "description", "DESCR": "description", "TEXTO": "description",
    "VL": "amount", "VLR": "amount", "MONTANTE": "amount",
    "RECEBIDO": "inflow", "RECEBIMENTOS": "inflow",
    "PAGO": "outflow", "PAGAMENTOS": "outflow",
}
# The fields each family needs; any of its sets will do.
REQUIRED = {"cash_ledger": (("date", "inflow", "outflow", "balance"),), "bank_statement": (("date", "description", "amount"), ("date", "description", "credit", "debit"))}
# Banks and what tells them.
BANKS = {"Itaú": ("ITAU",), "Bradesco": ("BRADESCO",), "Santander": ("SANTANDER",)}
# The recipes that are known from the start, in the order in which ties are decided.
RECIPES = (
    ("itau-spreadsheet-bank-statement-v1", "bank_statement", "Itaú", ("DATA", "LANCAMENTO", "RAZAOSOCIAL", "CPFCNPJ", "VALOR", "SALDO"), ()),
    ("itau-current-account-spreadsheet-v1", "bank_statement", "Itaú", ("DATA", "LANCAMENTO", "VALORR", "SALDOR"), ()),
    ("bradesco-net-empresa-xls-v1", "bank_statement", "Bradesco", ("DATA", "LANCAMENTO", "DCTO", "CREDITO", "DEBITO", "SALDO"), ()),
    ("cash-ledger-spreadsheet-v1", "cash_ledger", None, ("DATA", "EMISSAO", "DOCUMENTO", "CLIENTEFORNECEDOR", "ANOTACOES", "ENTRADA", "SAIDA", "SALDO"), ()),
    ("itau-digital-bank-statement-v1", "bank_statement", "Itaú", ("DATA", "LANCAMENTO", "VALOR", "SALDO"), ("lancamentosdoperiodo", "saldoanterior", "cnpjcpf", "itau")),
    ("bradesco-bank-statement-v1", "bank_statement", "Bradesco", ("DATA", "LANCAMENTO", "CREDITO", "DEBITO", "SALDO"), ("extratomensal", "saldoanterior", "bradesco", "credito", "debito")),
    ("cash-ledger-report-v1", "cash_ledger", None, ("DATA", "ENTRADA", "SAIDA", "SALDO"), ("controledefechamentodecaixa", "saldoinicial", "entrada")),
)
# The adapters in the order in which they are asked: what they are, their family, what they read, and the labels or titles that tell them.
ADAPTERS = (
    ("cash-ledger-report-v1", "cash_ledger", "printed", ("controledefechamentodecaixa", "saldoinicial", "entrada")),
    ("cash-ledger-spreadsheet-v1", "cash_ledger", "sheet", ("DATA", "ENTRADA", "SAIDA", "SALDO")),
    ("itau-spreadsheet-bank-statement-v1", "bank_statement", "sheet", ("DATA", "LANCAMENTO", "RAZAOSOCIAL", "CPFCNPJ", "VALOR", "SALDO")),
    ("itau-current-account-spreadsheet-v1", "bank_statement", "sheet", ("DATA", "LANCAMENTO", "VALORR", "SALDOR")),
    ("bradesco-net-empresa-xls-v1", "bank_statement", "sheet", ("DATA", "LANCAMENTO", "DCTO", "CREDITO", "DEBITO", "SALDO")),
    ("itau-digital-bank-statement-v1", "bank_statement", "printed", ("lancamentosdoperiodo", "saldoanterior", "cnpjcpf", "itau")),
    ("bradesco-bank-statement-v1", "bank_statement", "printed", ("extratomensal", "saldoanterior", "bradesco", "credito", "debito")),
    ("chart-of-accounts", "chart_of_accounts", "sheet", ("CODIGO", "DESCRICAO")),
    ("accounting-history", "accounting_history", "sheet", ("DATA", "DEBITO", "CREDITO", "VALOR")),
)
# Headers of the sheets that hold a chart or a history.
CHART_HEADERS = ("CODIGO", "DESCRICAO")
REUSE_AT = 0.85
SAMPLE_ROWS, SAMPLES = 20, 5


def recipe_table(spark: SparkSession, recipes: Sequence[tuple] = RECIPES) -> DataFrame:
    rows = [(i, r[0], r[1], r[2], list(r[3]), list(r[4])) for i, r in enumerate(recipes)]
    return spark.createDataFrame(rows, "ord int, id string, family string, bank string, headers array<string>, labels array<string>")


def alias_table(spark: SparkSession, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    return spark.createDataFrame([(i, f, t) for i, (f, ts) in enumerate(aliases.items()) for t in ts], "field_ord int, field string, title string")


def effective(formula: Column, calculated: Column, value: Column) -> Column:
    return F.when(formula.isNotNull(), calculated).otherwise(value)


def rendered(cells: DataFrame) -> DataFrame:
    """Cells with text: adds ``text``; blank ones go."""
    return cells.withColumn("text", clean(effective(F.col("formula"), F.col("calculated_value"), F.col("value")))).where("text is not null")


def mapped_rows(cells: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each row's titles and fields: (doc, sheet_ord, row_number, n_cells, titles, columns map field -> column).

    The first column of a field wins. The alias table is a fixed handful of rows, so it is broadcast. A row's cells meet once.
    """
    titled = rendered(cells).withColumn("title", fold(F.col("text")))
    key = ["doc", "sheet_ord", "row_number"]
    known = aliases.groupBy("title").agg(F.collect_set("field").alias("fields"))
    seen = titled.select(*key, "column", "title").join(F.broadcast(known), "title", "left")
    titles = seen.groupBy(*key).agg(F.count(F.lit(1)).alias("n_cells"), F.array_sort(F.collect_list(F.when(F.col("title") != "", F.struct("column", "title", "fields")))).alias("_t"))
    fields = F.transform(F.filter("_t", lambda t: t["fields"].isNotNull()), lambda t: F.transform(t["fields"], lambda f: F.struct(f.alias("field"), t["column"].alias("column"))))
    first = lambda pairs: F.filter(pairs, lambda p, i: (i == 0) | (F.get(pairs, i - 1)["field"] != p["field"]))
    columns = let(let(F.array_sort(F.flatten(fields)), first), lambda pairs: F.when(F.size(pairs) > 0, F.map_from_entries(pairs)))
    return titles.select(*key, "n_cells", F.transform("_t", lambda t: t["title"]).alias("titles"), columns.alias("columns"))


def family_of(columns: Column) -> Column:
    """The family whose needed fields a map of columns has; cash before bank."""
    fields = F.coalesce(F.map_keys(columns), F.array().cast("array<string>"))
    out = None
    for family in ("cash_ledger", "bank_statement"):
        ok = F.lit(False)
        for need in REQUIRED[family]:
            ok = ok | (F.size(F.array_except(F.array(*[F.lit(f) for f in need]), fields)) == 0)
        out = F.when(ok, family) if out is None else out.when(ok, family)
    return out


def first_header(rows: DataFrame) -> DataFrame:
    """Of each document the first row with two cells and two known fields, else the first with two cells. Later grids never count."""
    known = F.size(F.coalesce(F.map_keys("columns"), F.array().cast("array<string>"))) >= 2
    w = Window.partitionBy("doc").orderBy(F.desc("_known"), "sheet_ord", "row_number")
    return rows.where("n_cells >= 2").withColumn("_known", known).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_known")


def best_recipe(headers: DataFrame, recipes: DataFrame, least: float = REUSE_AT) -> DataFrame:
    """Headers (doc, titles) -> doc, recipe, similarity: the most similar set of titles if similar enough, ties in the recipes' order.

    Sets without a common title have no similarity, so pairs come from a join on titles. Where both sides have a ``family``, recipes of another one are no match.
    Recipes are a catalogue of layouts, one a bank and version, and are broadcast; documents are not.
    """
    on = ["title", *(["family"] if "family" in headers.columns else [])]
    # dealt by document before titles are taken apart, so that no task counts the titles of more than its share
    own = headers.select("doc", *on[1:], F.array_distinct("titles").alias("_t")).repartition(tasks(headers), "doc")
    asked = own.select("doc", *on[1:], F.size("_t").alias("_n"), F.explode("_t").alias("title"))
    known = recipes.select("ord", "id", *on[1:], F.size(F.array_distinct("headers")).alias("_m"), F.explode(F.array_distinct("headers")).alias("title"))
    shared = asked.join(F.broadcast(known), on).groupBy("doc", "ord", "id", "_n", "_m").agg(F.count(F.lit(1)).alias("_both"))
    scored = shared.withColumn("similarity", F.col("_both") / (F.col("_n") + F.col("_m") - F.col("_both")))
    best = scored.groupBy("doc").agg(F.max_by(F.struct("id", "similarity"), F.struct("similarity", -F.col("ord"))).alias("b"))
    return best.where(F.col("b.similarity") >= least).select("doc", F.col("b.id").alias("recipe"), "b.similarity")


def adapter_of(source: Column, text: Column, titles: Column, adapters: Sequence[tuple] = ADAPTERS) -> Column:
    """The first adapter that takes a document: a printed one all of whose labels stand in the text, a sheet's whose titles are all in the header row. Null where none does."""
    folded, have = F.lower(fold(F.coalesce(text, F.lit("")))), F.coalesce(titles, F.array().cast("array<string>"))
    hits = []
    for name, family, kind, needs in adapters:
        ok = F.lit(True)
        for n in needs:
            ok = ok & (F.contains(folded, F.lit(n)) if kind == "printed" else F.array_contains(have, n))
        hits.append(F.when((source == kind) & ok, F.struct(F.lit(name).alias("adapter"), F.lit(family).alias("family"))))
    return F.coalesce(*hits)


def routed(documents: DataFrame, recipes: DataFrame, adapters: Sequence[tuple] = ADAPTERS, least: float = REUSE_AT) -> DataFrame:
    """Documents (doc, source, text, titles) -> doc, adapter, family, recipe, similarity, code: each to exactly one adapter, or to a code.

    An adapter only takes a saved recipe of its own family; a document that is recognised but has none waits for its columns to be confirmed
    (``columns_not_confirmed``), one that no adapter takes is ``unsupported_layout``. One pass over the documents and one join on titles.
    """
    taken = documents.withColumn("_a", adapter_of(F.col("source"), F.col("text"), F.col("titles"), adapters))
    taken = taken.select("doc", "titles", F.col("_a.adapter").alias("adapter"), F.col("_a.family").alias("family"))
    found = best_recipe(taken.where("family is not null").select("doc", "titles", "family"), recipes, least)
    code = F.when(F.col("adapter").isNull(), "unsupported_layout").when(F.col("recipe").isNull(), "columns_not_confirmed")
    return taken.drop("titles").join(large(found), "doc", "left").withColumn("code", code)


def catalog(seeds: DataFrame, stored: DataFrame) -> DataFrame:
    """Union of recipes keyed by id and headers; the stored one wins."""
    both = seeds.withColumn("_from", F.lit(0)).unionByName(stored.withColumn("_from", F.lit(1)))
    w = Window.partitionBy("id", F.array_sort("headers")).orderBy(F.desc("_from"), F.desc("ord"))
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_from")


def remembered(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Appends recipes that are not there yet."""
    return stored.unionByName(new.join(stored, ["id", "headers"], "left_anti").select(*stored.columns))


def next_id(recipes: DataFrame, family: str, bank: str | None) -> str:
    """The id of the newest version of a family and bank (not one more than it)."""
    slug = "".join(c for c in (bank or "desconhecido").upper() if c.isascii() and c.isalnum()) or "DESCONHECIDO"
    prefix = f"{slug}-spreadsheet-{'bank-statement' if family == 'bank_statement' else 'cash-ledger'}-v"
    version = recipes.select(F.max(F.regexp_extract("id", f"^{prefix}(\\d+)$", 1).try_cast("int"))).first()[0]
    return f"{prefix}{max(1, version or 1)}"


def bank_of(text: Column, banks: Mapping[str, Sequence[str]] = BANKS) -> Column:
    out = None
    for bank, marks in banks.items():
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(fold(text), F.lit(m))
        out = F.when(hit, bank) if out is None else out.when(hit, bank)
    return out


def kind_of(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Type of a column's samples: date, tax_id or money where at least half look so, in this order, else text."""
    is_date = (parse_date(F.col("text")).isNotNull() | F.col("text").rlike(r"^\d{2}/\d{2}$")).cast("int")
    is_id = F.length(F.regexp_replace("text", r"\D", "")).isin(11, 14).cast("int")
    is_money = parse_money(F.col("text")).isNotNull().cast("int")
    sums = cells.groupBy(*keys).agg(F.sum(is_date).alias("_d"), F.sum(is_id).alias("_t"), F.sum(is_money).alias("_m"), F.count(F.lit(1)).alias("samples"))
    half = F.greatest(F.lit(1), F.floor((F.col("samples") + 1) / 2))
    kind = F.when(F.col("_d") >= half, "date").when(F.col("_t") >= half, "tax_id").when(F.col("_m") >= half, "money").otherwise("text")
    return sums.select(*keys, "samples", kind.alias("kind"))


def suggestion(title: Column, kind: Column) -> Column:
    """struct(field, score) for a title: exact 1, abbreviation .72, a common beginning of four .62, else by type."""
    t = fold(title)
    pick = lambda field, score: F.struct(F.lit(field).alias("field"), F.lit(score).alias("score"))
    exact = [F.when(t.isin(*titles), pick(f, 1.0)) for f, titles in ALIASES.items()]
    short = [F.when(t == a, pick(f, 0.72)) for a, f in ABBREVIATIONS.items()]
    begin = []
    for f, titles in ALIASES.items():
        hit = F.lit(False)
        for a in titles:
            hit = hit | F.startswith(t, F.lit(a[:4])) | F.startswith(F.lit(a), F.substring(t, 1, 4))
        begin.append(F.when((F.length(t) >= 4) & hit, pick(f, 0.62)))
    typed = [F.when(kind == "date", pick("date", 0.45)), F.when(kind == "tax_id", pick("tax_id", 0.45)), F.when(kind == "money", pick("amount", 0.40))]
    return F.coalesce(*exact, *short, *begin, *typed)


def proposals(cells: DataFrame, header: DataFrame) -> DataFrame:
    """A row for each titled column of a document's header: title, type of its samples, the field suggested for it.

    Fields are given out once, by score, then the later column, then the later field name; of the at most few dozen
    columns of a header each takes what is left, which a fold over the sorted suggestions does.
    """
    text = rendered(cells)
    titles = text.join(large(header.select("doc", "sheet_ord", "row_number")), ["doc", "sheet_ord", "row_number"]).select("doc", "sheet_ord", F.col("row_number").alias("header_row"), "column", F.col("text").alias("title"))
    below = text.join(large(titles), ["doc", "sheet_ord", "column"]).where((F.col("row_number") > F.col("header_row")) & (F.col("row_number") <= F.col("header_row") + SAMPLE_ROWS))
    w = Window.partitionBy("doc", "column").orderBy("row_number")
    samples = below.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= SAMPLES)
    kinds = kind_of(samples, ["doc", "column"])
    guessed = titles.join(large(kinds), ["doc", "column"], "left").withColumn("s", suggestion(F.col("title"), F.coalesce("kind", F.lit("unknown"))))
    by_doc = guessed.groupBy("doc").agg(F.sort_array(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s.score", "column", "s.field"))), asc=False).alias("_all"))
    empty = F.array().cast("array<struct<score:double,column:int,field:string>>")
    taken = F.aggregate("_all", empty, lambda held, x: F.when(F.exists(held, lambda h: h["field"] == x["field"]), held).otherwise(F.concat(held, F.array(F.struct(x["score"].cast("double").alias("score"), x["column"].cast("int").alias("column"), x["field"].alias("field"))))))
    given = by_doc.select("doc", F.inline(taken))
    return guessed.drop("s").join(large(given.withColumnRenamed("score", "confidence")), ["doc", "column"], "left")


def fingerprint(titles: Column) -> Column:
    """SHA-256 of the folded titles as a compact JSON list."""
    quoted = F.transform(titles, lambda t: F.concat(F.lit('"'), fold(t), F.lit('"')))
    return F.sha2(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), 256)


def confirmed_map(family: str, columns: Mapping[str, int], available: set[int]) -> str:
    """Checks a confirmed map of columns and returns its family's name; raises on what cannot be read by it."""
    name = {"bank": "bank_statement", "cash": "cash_ledger"}.get(family)
    if name is None or not columns or not set(columns) <= set(ALIASES) or len(set(columns.values())) != len(columns):
        raise ValueError("layout_map_invalid")
    have = set(columns)
    ok = any(set(need) <= have for need in REQUIRED["bank_statement"]) if name == "bank_statement" else "date" in have and bool({"inflow", "outflow"} & have)
    if not ok or not set(columns.values()) <= available:
        raise ValueError("layout_map_invalid")
    return name


def missing_fields(columns: Column, family: str) -> Column:
    """The fields a family still needs, by its set with the smallest gap."""
    have = F.coalesce(F.map_keys(columns), F.array().cast("array<string>"))
    gaps = [F.array_except(F.array(*[F.lit(f) for f in need]), have) for need in REQUIRED[family]]
    return F.array_min(F.array(*[F.struct(F.size(g).alias("n"), F.lit(i).alias("i"), g.alias("fields")) for i, g in enumerate(gaps)]))["fields"]


def recognised(text: Column, recipes: Sequence[tuple] = RECIPES) -> Column:
    """The first recipe all of whose labels stand in a printed document's text."""
    folded = F.lower(fold(text))
    hits = []
    for r in recipes:
        if r[4]:
            ok = F.lit(True)
            for label in r[4]:
                ok = ok & F.contains(folded, F.lit(label))
            hits.append(F.when(ok, F.lit(r[0])))
    return F.coalesce(*hits)


def entry_status(has_recipe: Column, pinned_shifted: Column, trusted: Column, has_proposal: Column) -> Column:
    return F.when(has_recipe & ~pinned_shifted, "known").when(has_recipe & pinned_shifted, "paused").when(trusted, "trusted").when(has_proposal, "proposal").otherwise("unreadable")


def banded(words: DataFrame, bands: DataFrame) -> DataFrame:
    """Words to the field whose band [left, right) holds their middle; bands are a handful of rows a layout."""
    middle = (F.col("x0") + F.col("x1")) / 2
    return words.join(F.broadcast(bands), (middle >= F.col("left")) & (middle < F.col("right")), "left").drop("left", "right")


def handshake(words: DataFrame, bands: DataFrame) -> DataFrame:
    """doc, applies: whether every header label stands in its own band."""
    middle = (F.col("x0") + F.col("x1")) / 2
    labels = words.withColumn("label", fold(F.col("text"))).join(F.broadcast(bands), "label")
    return labels.groupBy("doc").agg((F.bool_and((middle >= F.col("left")) & (middle < F.col("right"))) & (F.count_distinct("label") == F.lit(bands.count()))).alias("applies"))


def without_duplicates(words: DataFrame) -> DataFrame:
    """Words printed twice in one place (to a hundredth) count once, the first."""
    spot = [F.round(c, 2) for c in ("x0", "x1", "top", "bottom")]
    w = Window.partitionBy("doc", "page", "text", *spot).orderBy("ord")
    return words.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lines(words: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Words of each page to lines: a line ends where a word is more than the tolerance off the line's first word.

    The anchor makes this a fold in order and no window; a page is a bounded group. Returns doc, page, line, top, text.
    """
    page = words.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("top", "x0", "ord", "text"))).alias("_w"))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0).alias("line"), F.array().cast("array<struct<line:int,top:double,x0:double,text:string>>").alias("out"))

    def step(held: Column, w: Column) -> Column:
        fresh = held["top"].isNull() | (F.abs(w["top"] - held["top"]) > tolerance)
        line = F.when(fresh, held["line"] + 1).otherwise(held["line"])
        top = F.when(fresh, w["top"]).otherwise(held["top"]).cast("double")
        row = F.struct(line.cast("int").alias("line"), top.alias("top"), w["x0"].cast("double").alias("x0"), w["text"].alias("text"))
        return F.struct(top.alias("top"), line.cast("int").alias("line"), F.concat(held["out"], F.array(row)).alias("out"))

    rows = page.select("doc", "page", F.inline(F.aggregate("_w", start, step)["out"]))
    grouped = rows.groupBy("doc", "page", "line").agg(F.min("top").alias("top"), F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("_t"))
    return grouped.select("doc", "page", "line", "top", F.array_join(F.transform("_t", lambda t: t["text"]), " ").alias("text"))


def word_grid(words: DataFrame, bucket: float = 3.0, reach: float = 40.0) -> DataFrame:
    """Rows of a page without tables: words bucketed by their top (half to even), at least two to a row, as cells."""
    at = words.withColumn("row_number", (F.bround(F.col("top") / bucket) * bucket).cast("int"))
    w = Window.partitionBy("doc", "page", "row_number")
    kept = at.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n >= 2")
    order = Window.partitionBy("doc", "page", "row_number").orderBy("x0", "ord")
    return kept.select("doc", F.col("page").alias("sheet_ord"), "row_number", F.row_number().over(order).alias("column"), F.col("text").alias("value"), F.lit(None).cast("string").alias("formula"), F.lit(None).cast("string").alias("calculated_value"))


def page_metrics(pages: DataFrame, chars: int = 20, ratio: float = 0.85) -> DataFrame:
    """Characters, share of readable ones, and whether a page has useful text."""
    n = F.length("text")
    bad = F.regexp_count("text", F.lit(r"�|\(cid:\d+\)|[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    share = F.when(n > 0, (n - bad) / n).otherwise(0.0)
    return pages.select("doc", "page", n.alias("chars"), share.alias("ratio"), ((F.length(F.trim("text")) >= chars) & (share >= ratio)).alias("useful"))


def page_class(metrics: DataFrame) -> DataFrame:
    kind = F.when(F.bool_and("useful"), "textual").when(F.bool_or("useful"), "hybrid").otherwise("probable_image")
    return metrics.groupBy("doc").agg(kind.alias("classification"))


def decoded_cids(text: Column, table: Mapping[int, str]) -> Column:
    """(cid:N) marks to the characters of a font's table; unknown ones to U+FFFD."""
    known = F.create_map(*[x for n, c in table.items() for x in (F.lit(n), F.lit(c))]) if table else F.lit(None).cast("map<int,string>")
    parts = F.regexp_extract_all(text, F.lit(r"\(cid:(\d+)\)|[\s\S]"), F.lit(0))
    one = lambda p: F.when(p.rlike(r"^\(cid:\d+\)$"), F.coalesce(known[F.regexp_extract(p, r"(\d+)", 1).try_cast("int")], F.lit("�"))).otherwise(p)
    return F.array_join(F.transform(parts, one), "")

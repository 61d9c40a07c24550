"""Printed documents: words with positions to statements and cash ledgers; ``forms`` reads invoices.

A page's words become lines (layout.lines' rule) and each line's words fall into the bands of its layout. The
bands and labels are rows of small tables, so a new layout is data.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.identity import extract_tax_id, party_of, split_document, strip_tax_id
from tallyforge.functions.money import MONEY, parse_date, parse_money, transaction_type
from tallyforge.functions.text import clean, fold, let
from tallyforge.operators import matching

# Where the columns of the known layouts are printed.
STATEMENT_BANDS = {"date": (0.0, 80.0), "description": (80.0, 220.0), "counterparty": (220.0, 356.0), "tax_id": (356.0, 450.0), "amount": (450.0, 512.0), "balance": (512.0, 596.0)}
LEDGER_BANDS = {
    "date": (0.0, 76.0), "issue_date": (76.0, 136.0), "document": (136.0, 223.0), "counterparty": (223.0, 465.0), "notes": (465.0, 650.0),
    "inflow": (650.0, 710.0), "outflow": (710.0, 765.0), "balance": (765.0, 830.0),
}
ACCOUNT_BOX, PERIOD_BAND = (0.0, 240.0, 55.0, 78.0), (650.0, 780.0)
#: How far off a line's first word its others may begin.
TOLERANCE = 2.0
# What an invoice's page says for certain.
INVOICE_SIGNALS = ("DANFSE", "DOCUMENTOAUXILIARDANFSE", "CHAVEDEACESSODANFSE", "NUMERODANFSE", "PRESTADORFORNECEDORDANFSE")


def page_lines(words: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Words (doc, page, ord, text, x0, x1, top, bottom) to doc, page, lines: arrays of (line, top, bottom, words); a line ends more than the tolerance off its first word.

    A page is a bounded group: its words are one array from one shuffle, and what layout.without_duplicates does, the sorting and the fold that
    keeps the anchor go on in it. A line's top is its first word's; its words (x0, x1, text) are sorted.
    """
    word = F.struct("text", "ord", *[F.col(c).cast("double").alias(c) for c in ("top", "x0", "x1", "bottom")])
    page = words.groupBy("doc", "page").agg(F.collect_list(word).alias("_w"))
    spot = ("text", "_0", "_1", "_2", "_3")
    placed = lambda w: F.struct(w["text"].alias("text"), *[F.round(w[c], 2).alias(f"_{i}") for i, c in enumerate(("x0", "x1", "top", "bottom"))], *[w[c].alias(c) for c in ("ord", "top", "x0", "x1", "bottom")])

    def again(w: Column, before: Column) -> Column:
        same = before.isNotNull()
        for c in spot:
            same = same & w[c].eqNullSafe(before[c])
        return same

    once = lambda ws: F.filter(ws, lambda w, i: (i == 0) | ~again(w, F.get(ws, i - 1)))
    order = lambda w: F.struct(*[w[c].alias(c) for c in ("top", "x0", "ord", "x1", "bottom", "text")])
    # no two words of one text and place have different hashes: where all hashes differ none is printed twice
    hashes = F.transform("_w", lambda w: F.xxhash64(w["text"], *[F.round(w[c], 2) for c in ("x0", "x1", "top", "bottom")]))
    each = F.size(F.array_distinct(hashes)) == F.size("_w")
    ordered = F.array_sort(F.when(each, F.transform("_w", order)).otherwise(F.transform(let(F.array_sort(F.transform("_w", placed)), once), order)))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(held: Column, w: Column) -> Column:
        fresh = held["top"].isNull() | (F.abs(w["top"] - held["top"]) > tolerance)
        return F.when(fresh, F.struct(w["top"].alias("top"), (held["at"] + 1).alias("at"), F.concat(held["starts"], F.array(held["at"])).alias("starts"))).otherwise(F.struct(held["top"].alias("top"), (held["at"] + 1).alias("at"), held["starts"].alias("starts")))

    def line(ws: Column, starts: Column, at: Column, i: Column) -> Column:
        own = F.slice(ws, at + 1, F.coalesce(F.get(starts, i + 1), F.size(ws)) - at)
        sorted_ = F.array_sort(F.transform(own, lambda w: F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"), w["text"].alias("text"))))
        return F.struct((i + 1).alias("line"), F.get(ws, at)["top"].alias("top"), F.array_max(F.transform(own, lambda w: w["bottom"])).alias("bottom"), sorted_.alias("words"))

    lines = let(ordered, lambda ws: let(F.aggregate(ws, start, step)["starts"], lambda starts: F.transform(starts, lambda at, i: line(ws, starts, at, i))))
    return page.select("doc", "page", lines.alias("lines"))


def cut(words: Column, left: float, right: float) -> Column:
    """The text of a line's words (array of structs sorted by x0) whose middle is in [left, right)."""
    inside = F.filter(words, lambda w: ((w["x0"] + w["x1"]) / 2 >= left) & ((w["x0"] + w["x1"]) / 2 < right))
    return clean(F.array_join(F.transform(inside, lambda w: w["text"]), " "), repair=False)


def line_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def banded_lines(words: DataFrame, bands: Mapping[str, tuple[float, float]]) -> DataFrame:
    """A row per line: doc, page, line, top, bottom, text, words, and a column per band."""
    held = page_lines(words).select("doc", "page", F.inline("lines"))
    return held.select("*", line_text(F.col("words")).alias("text"), *[cut(F.col("words"), a, b).alias(name) for name, (a, b) in bands.items()])


def banded_statement(words: DataFrame, bands: Mapping[str, tuple[float, float]] = STATEMENT_BANDS) -> DataFrame:
    """Rows of a statement printed in bands, with their kind; wrapped text around a row is joined to the nearest transaction.

    A fragment below a page's last row that is no bare description goes to the first transaction of the next page.
    """
    lines = banded_lines(words, bands).withColumn("ord", F.col("page") * 10_000 + F.col("line"))
    folded = fold(F.coalesce("description", F.lit("")))
    kind = F.when(F.contains(folded, F.lit("SALDOANTERIOR")), "opening").when(F.contains(folded, F.lit("SALDOTOTAL")) & F.contains(folded, F.lit("DIA")), "daily").when(parse_money(F.col("amount")).isNotNull(), "transaction")
    dated = lines.withColumn("day", parse_date(F.col("date")))
    rows = dated.where("day is not null").withColumn("kind", kind).where("kind is not null")
    header = F.contains(fold(F.col("text")), F.lit("LANCAMENTOS")) & F.contains(fold(F.col("text")), F.lit("CNPJCPF"))
    loose = dated.where(F.col("day").isNull() & ~header & F.coalesce("description", "counterparty", "tax_id").isNotNull())
    span = rows.groupBy("doc", "page").agg(F.min("top").alias("_first"), F.max("top").alias("_last"))
    loose = loose.join(span, ["doc", "page"]).where("top >= _first - 8 and top <= _last + 20")
    only_text = F.col("description").isNotNull() & F.col("counterparty").isNull() & F.col("tax_id").isNull()
    carried = (F.col("top") > F.col("_last") + 2) & ~only_text
    tx = rows.where("kind = 'transaction'")
    here = matching.nearest(loose.where(~carried).withColumn("id", F.col("ord")).select("doc", "page", "id", "top"), tx.select("doc", "page", "ord", "top"), ["doc", "page"], above=1e9, below=1e9).select("doc", "id", "row_ord")
    first = tx.groupBy("doc", "page").agg(F.min("ord").alias("row_ord"))
    later = loose.where(carried).select("doc", F.col("page").alias("_from"), F.col("ord").alias("id")).join(first, "doc").where("page > _from").groupBy("doc", "id").agg(F.min_by("row_ord", "page").alias("row_ord"))
    pieces = loose.select("doc", F.col("ord").alias("id"), "description", "counterparty", "tax_id").join(here.unionByName(later), ["doc", "id"])
    own = tx.select("doc", F.col("ord").alias("id"), "description", "counterparty", "tax_id", F.col("ord").alias("row_ord"))
    joined = own.unionByName(pieces).groupBy("doc", F.col("row_ord").alias("ord")).agg(
        *[clean(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("id", F.col(c).alias("t"))))), lambda s: s["t"]), " "), repair=False).alias(f"_{c}") for c in ("description", "counterparty", "tax_id")]
    )
    out = rows.join(joined, ["doc", "ord"], "left")
    split = split_document(F.coalesce("_description", "description"))
    amount = parse_money(F.col("amount"))
    return out.select(
        "doc", "page", "ord", "kind", F.col("day").alias("date"), F.when(F.col("kind") == "transaction", split["description"]).otherwise(F.col("description")).alias("description"),
        F.coalesce("_counterparty", "counterparty").alias("counterparty"), extract_tax_id(F.coalesce("_tax_id", "tax_id"), F.coalesce("_counterparty", "counterparty")).alias("counterparty_tax_id"),
        F.when(F.col("kind") == "transaction", split["document"]).alias("document"), amount.alias("amount"), parse_money(F.col("balance")).alias("balance"), transaction_type(amount).alias("transaction_type"),
    )


# The lines of a statement printed as text.
MOVEMENT = r"(-?\d{1,3}(?:\.\d{3})*,\d{2})\s+(-?\d{1,3}(?:\.\d{3})*,\d{2})$"
HEADINGS = ("TOTAL", "DATALANCAMENTO", "OSDADOS", "FOLHA")
NOTES = ("EXTRATOMENSAL", "NOMEDOUSUARIO", "SALDOSINVEST")


def text_statement(lines: DataFrame) -> DataFrame:
    """Lines of text (doc, page, line, text) of a statement to transactions.

    Dates carry forward, text before a movement's line is its description, and a line behind it that names a party or
    tax id belongs to it. A movement repeated at the top of the next page counts once.
    """
    w = Window.partitionBy("doc").orderBy("page", "line")
    t = F.trim("text")
    dated = lines.where(t != "").withColumn("day", parse_date(F.regexp_extract(t, r"^(\d{2}/\d{2}/\d{4})", 1))).withColumn("t", F.trim(F.regexp_replace(t, r"^\d{2}/\d{2}/\d{4}", "")))
    dated = dated.withColumn("date", F.last("day", ignorenulls=True).over(w))
    folded = fold(F.col("t"))
    heading, note = F.lit(False), F.lit(False)
    for h in HEADINGS:
        heading = heading | F.startswith(folded, F.lit(h))
    for n in NOTES:
        note = note | F.contains(folded, F.lit(n))
    opening = F.contains(folded, F.lit("SALDOANTERIOR"))
    kind = F.when(opening, "opening").when(heading, "break").when(F.col("t").rlike(MOVEMENT) & F.col("date").isNotNull(), "movement").when(note, "note").otherwise("text")
    dated = dated.withColumn("kind", kind).withColumn("tax", extract_tax_id(F.col("t"))).withColumn("party", party_of(F.col("t")))
    seen = F.count(F.when(F.col("kind") == "movement", 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    dated = dated.withColumn("before", seen)
    behind = (F.col("kind") == "text") & (F.col("before") > 0) & (F.col("tax").isNotNull() | F.col("party").isNotNull())
    dated = dated.withColumn("kind", F.when(behind, "behind").otherwise(F.col("kind")))
    # text since the last movement or break is what the next movement begins with
    island = F.sum(F.col("kind").isin("opening", "break").cast("int")).over(w) * 1_000_000 + F.col("before")
    dated = dated.withColumn("island", island)
    begun = dated.where("kind = 'text'").groupBy("doc", "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "t"))), lambda s: s["t"]), " ").alias("begun"))
    tail = dated.where("kind = 'behind'").groupBy("doc", "before").agg(F.min_by("tax", F.struct("page", "line")).alias("tax"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("party").isNotNull(), F.struct("page", "line", "party")))), lambda s: s["party"]), " ").alias("party"))
    moves = dated.where("kind = 'movement'").join(begun, ["doc", "island"], "left").withColumn("n", F.col("before") + 1)
    moves = moves.drop("tax", "party").join(tail.withColumnRenamed("before", "n"), ["doc", "n"], "left")
    head = F.trim(F.regexp_replace("t", MOVEMENT, ""))
    document = F.nullif(F.regexp_extract(head, r"(\d{4,12})\s*$", 1), F.lit(""))
    rest = F.trim(F.regexp_replace(head, r"\d{4,12}\s*$", ""))
    amount = parse_money(F.regexp_extract("t", MOVEMENT, 1))
    out = moves.select(
        "doc", "page", (F.col("page") * 10_000 + F.col("line")).alias("ord"), F.col("line").cast("double").alias("top"), "date", clean(F.concat_ws(" ", "begun", rest), repair=False).alias("text"), document.alias("document"),
        clean(F.col("party"), repair=False).alias("counterparty"), F.col("tax").alias("counterparty_tax_id"), amount.alias("amount"), parse_money(F.regexp_extract("t", MOVEMENT, 2)).alias("balance"), transaction_type(amount).alias("transaction_type"),
    )
    return matching.without_page_repeats(out).withColumnRenamed("text", "description").drop("top")


def text_opening(lines: DataFrame) -> DataFrame:
    """The first printed opening balance of each document."""
    found = lines.where(F.contains(fold(F.col("text")), F.lit("SALDOANTERIOR")))
    value = F.element_at(F.regexp_extract_all("text", F.lit(r"-?\d{1,3}(?:\.\d{3})*,\d{2}"), F.lit(0)), -1)
    found = found.where(F.col("text").rlike(r"\d,\d{2}"))
    return found.groupBy("doc").agg(F.min_by(parse_money(value), F.struct("page", "line")).alias("initial_balance"))


def printed_ledger(words: DataFrame, bands: Mapping[str, tuple[float, float]] = LEDGER_BANDS) -> DataFrame:
    """Entries of printed cash ledgers: wrapped lines join the row before them on the page, an account's box splits ledgers."""
    lines = banded_lines(words, bands).withColumn("ord", F.col("page") * 10_000 + F.col("line")).withColumn("day", parse_date(F.col("date")))
    money = {c: parse_money(F.col(c)) for c in ("inflow", "outflow", "balance")}
    starts = F.col("day").isNotNull()
    whole = starts & money["balance"].isNotNull() & (money["inflow"].isNotNull() | money["outflow"].isNotNull())
    w = Window.partitionBy("doc", "page").orderBy("line")
    lines = lines.withColumn("_row", F.sum(starts.cast("int")).over(w)).withColumn("_whole", whole)
    footer = F.coalesce(clean(F.col("text"), repair=False).rlike(r"^\d+\s*/\s*\d+$"), F.lit(False))
    more = ~starts & ~footer & F.coalesce("document", "counterparty", "notes").isNotNull()
    rows = lines.where((starts | more) & (F.col("_row") > 0))
    joined = lambda c: clean(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("line", F.col(c).alias("t"))))), lambda s: s["t"]), " "), repair=False).alias(c)
    head = lambda e, name: F.max(F.when(starts, e)).alias(name)
    entries = rows.groupBy("doc", "page", "_row").agg(
        F.min("ord").alias("ord"), F.bool_or("_whole").alias("_ok"), head(F.col("day"), "date"), head(parse_date(F.col("issue_date")), "issue_date"), *[joined(c) for c in ("document", "counterparty", "notes")],
        *[head(money[c], c) for c in ("inflow", "outflow", "balance")],
    ).where("_ok").drop("_ok", "_row")
    tax = extract_tax_id(F.col("notes"), F.col("counterparty"))
    entries = entries.withColumn("counterparty_tax_id", tax)
    entries = entries.withColumns({c: strip_tax_id(F.col(c), F.col("counterparty_tax_id")) for c in ("notes", "counterparty")} | {c: F.coalesce(c, F.lit(0)).cast(MONEY) for c in ("inflow", "outflow")})
    accounts = page_accounts(lines)
    out = entries.join(accounts, ["doc", "page"], "left")
    # a page's account that differs from the one before, a missing one included, starts a new ledger
    pages = out.select("doc", "page", "account").distinct()
    order = Window.partitionBy("doc").orderBy("page")
    known = F.last("account", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.row_number().over(order) == 1
    pages = pages.withColumn("_new", (~first & ~F.col("account").eqNullSafe(known)).cast("int")).withColumn("segment", F.sum("_new").over(order) + 1)
    return out.drop("account").join(pages.select("doc", "page", F.last("account", ignorenulls=True).over(order).alias("account"), "segment"), ["doc", "page"])


def page_accounts(lines: DataFrame) -> DataFrame:
    """The first text in a page's account box that is no balance."""
    left, right, top, bottom = ACCOUNT_BOX
    value = cut(F.col("words"), left, right)
    found = lines.where(F.col("top").between(top, bottom)).withColumn("_v", value).where(F.col("_v").isNotNull() & ~F.contains(fold(F.col("_v")), F.lit("SALDO")))
    return found.groupBy("doc", "page").agg(F.min_by("_v", "line").alias("account"))


def ledger_periods(words: DataFrame) -> DataFrame:
    """Printed first and last dates of each document."""
    lines = banded_lines(words, {"value": PERIOD_BAND}).withColumn("_f", fold(F.col("text"))).withColumn("_d", parse_date(F.col("value")))
    at = lambda label: F.max_by(F.when(F.contains("_f", F.lit(label)), F.col("_d")), F.when(F.contains("_f", F.lit(label)) & F.col("_d").isNotNull(), F.struct("page", "line")))
    return lines.groupBy("doc").agg(at("DATAINICIAL").alias("period_start"), at("DATAFINAL").alias("period_end"))


def is_printed_invoice(text: Column) -> Column:
    def of(t: Column) -> Column:
        signs = let(fold(t), lambda f: F.forall(F.array(*[F.contains(f, F.lit(s)) for s in INVOICE_SIGNALS]), lambda found: found))
        return t.rlike(r"(?<!\d)\d{50}(?!\d)") & signs

    return let(text, of)

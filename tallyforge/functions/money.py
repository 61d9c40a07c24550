"""Dates, money and check digits as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import clean, let

MONEY = "decimal(18,2)"
EXACT = "decimal(38,10)"
LOOKBACK_DAYS = 7


def _date_of(t: Column) -> Column:
    iso, stamp = r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"
    return F.coalesce(
        F.when(t.rlike(iso), F.try_to_date(t, "yyyy-M-d")),
        F.when(t.rlike(stamp), F.try_to_date(F.substring_index(t, "T", 1), "yyyy-M-d")),
        F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(t, "d/M/yyyy")),
    )


def parse_date(text: Column) -> Column:
    """ISO date, ISO date and time, or day/month/year; anything else is null."""
    return let(clean(text), _date_of)


def parse_row_date(text: Column, start: Column, end: Column) -> Column:
    """A full date, or day/month in the first year that puts it between a week before the period and its end.

    Years are tried in the order: of the end, of the start, before the start's.
    """
    years = F.array(F.year(end), F.year(start), F.year(start) - 1)

    def of(t: Column) -> Column:
        dates = F.transform(years, lambda y: F.try_to_date(F.concat(t, F.lit("/"), y.cast("string")), "dd/MM/yyyy"))
        inside = F.filter(dates, lambda d: (d >= F.date_sub(start, LOOKBACK_DAYS)) & (d <= end))
        return F.coalesce(_date_of(t), F.when(t.rlike(r"^\d{2}/\d{2}$"), F.get(inside, F.lit(0))))

    return let(clean(text), of)


def parse_money(text: Column) -> Column:
    """The first amount of a text, in cents rounded half up. Dots group thousands where a decimal comma follows."""
    found = F.regexp_extract(F.replace(clean(text), F.lit("R$"), F.lit("")), r"[-+]?\d[\d.]*,\d{1,2}|[-+]?\d+(?:\.\d{1,2})?", 0)
    # dots are points only where no comma is
    point = lambda f: F.when(F.contains(f, F.lit(",")), F.translate(f, ",.", ".")).otherwise(f)
    return F.round(let(found, point).try_cast(EXACT), 2).cast(MONEY)


def parse_printed(text: Column) -> Column:
    """Amounts and rates of printed forms: currency, percent, blanks and dots go, a comma is the decimal point."""
    t = F.regexp_replace(clean(text, repair=False), r"R\$|%|[\s.]", "")
    return F.replace(t, F.lit(","), F.lit(".")).try_cast(EXACT)


def parse_mixed(text: Column) -> Column:
    """Amounts with either separator: the last of the two is the decimal point; cents rounded half to even."""
    def point(t: Column) -> Column:
        comma, dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
        comma_last = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))
        br = F.translate(t, ",.", ".")
        return F.when(comma & dot & comma_last, br).when(comma & dot, F.translate(t, ",", "")).when(comma, br).otherwise(t)

    return F.bround(let(F.regexp_replace(text.cast("string"), r"R\$|\s", ""), point).try_cast(EXACT), 2).cast(MONEY)


def exact_decimal(text: Column) -> Column:
    """A decimal as written, unrounded; a null where the text is no finite number."""
    return F.trim(text).try_cast(EXACT)


def signed(inflow: Column, outflow: Column) -> Column:
    return F.coalesce(inflow, F.lit(0)) - F.coalesce(outflow, F.lit(0))


def amount_of(amount: Column, credit: Column, debit: Column) -> Column:
    """The amount column wins; else credit less the size of debit; null where all are."""
    both = F.coalesce(credit, F.lit(0)) - F.abs(F.coalesce(debit, F.lit(0)))
    return F.coalesce(amount, F.when(credit.isNotNull() | debit.isNotNull(), both)).cast(MONEY)


def amount_credit_first(credit: Column, debit: Column) -> Column:
    """The spreadsheet variant: a credit, and only without one the debit, as a negative."""
    return F.coalesce(credit, -F.abs(debit)).cast(MONEY)


def transaction_type(amount: Column, zero_is_credit: bool = True) -> Column:
    return F.when(amount >= 0 if zero_is_credit else amount > 0, "credit").otherwise("debit")


def period_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def next_period(period: Column) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(period, F.lit("-01"))), 1), "yyyy-MM")


def is_period(period: Column) -> Column:
    return period.rlike(r"^\d{4}-\d{2}$")


def _digits(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int"))


def _weighted(digits: Column, weights: Sequence[int]) -> Column:
    return F.aggregate(F.zip_with(digits, F.array(*[F.lit(w) for w in weights]), lambda d, w: F.coalesce(d * w, F.lit(0))), F.lit(0), lambda a, x: a + x)


def _complement11(total: Column) -> Column:
    rest = total % 11
    return F.when(rest < 2, F.lit(0)).otherwise(11 - rest)


def key_digit(digits: Column, length: int = 49) -> Column:
    """Modulo-11 check digit with the weights 2 to 9 repeating from the right."""
    return _complement11(_weighted(F.reverse(_digits(digits)), [2 + i % 8 for i in range(length)]))


def valid_key(key: Column) -> Column:
    return key.rlike("^[0-9]{50}$") & (key_digit(F.substring(key, 1, 49)) == F.substring(key, 50, 1).try_cast("int"))


def _two_digits(base: Column, first: Sequence[int], second: Sequence[int]) -> tuple[Column, Column]:
    a = _complement11(_weighted(base, first))
    return a, _complement11(_weighted(F.concat(base, F.array(a)), second))


def _valid_id(text: Column, length: int, first: Sequence[int], second: Sequence[int]) -> Column:
    d = _digits(text)
    a, b = _two_digits(F.slice(d, 1, length - 2), first, second)
    same = F.size(F.array_distinct(d)) == 1
    return F.coalesce(text.rlike(f"^[0-9]{{{length}}}$") & ~same & (F.get(d, F.lit(length - 2)) == a) & (F.get(d, F.lit(length - 1)) == b), F.lit(False))


_COMPANY = [2 + i % 8 for i in range(13)][::-1]


def company_digits(base: Column) -> Column:
    """The two check digits behind the first twelve of a company's id."""
    a, b = _two_digits(_digits(base), _COMPANY[1:], _COMPANY)
    return F.concat(a.cast("string"), b.cast("string"))


def valid_cnpj(text: Column) -> Column:
    return _valid_id(text, 14, _COMPANY[1:], _COMPANY)


def valid_cpf(text: Column) -> Column:
    return _valid_id(text, 11, range(10, 1, -1), range(11, 1, -1))


def key_segments(key: Column) -> Column:
    """The parts of an invoice key that repeat fields of the document."""
    cut = {"issue_municipality": (1, 7), "environment": (8, 1), "provider_tax_id_type": (9, 1), "provider_tax_id": (10, 14), "number": (24, 13)}
    return F.struct(*[F.substring(key, a, n).alias(name) for name, (a, n) in cut.items()])


def inconsistent_segments(key: Column, document: dict[str, Column]) -> Column:
    """Names of the segments that differ from the document's fields, where it has them."""
    parts = key_segments(key)
    names = [F.when(value.isNotNull() & (parts[name] != value), F.lit(name)) for name, value in document.items()]
    return F.filter(F.array(*names), lambda n: n.isNotNull())


def fiscal_issue(gross: Column, base: Column, rate: Column, iss: Column, net: Column, *others: Column) -> Column:
    """The first rule an invoice's amounts break: a negative, net above gross, or ISS off base times rate by over a cent."""
    negative = F.lit(False)
    for value in (gross, base, iss, *others, net):
        negative = negative | F.coalesce(value < 0, F.lit(False))
    expected = F.bround((base * rate / 100).cast(EXACT), 2)
    return (
        F.when(negative, "negative_fiscal_value").when(net > gross, "inconsistent_totals").when(F.abs(expected - iss) > F.lit("0.01").cast(MONEY), "inconsistent_iss_total")
    )

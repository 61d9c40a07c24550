"""Tax ids, document numbers and parties in printed fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import clean, fold, let

# The printed forms.
MENTION = r"(?i)\b(?:\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}|\d{3}\.\d{3}\.\d{3}-\d{2}|(?:(?:CNPJ|CPF)\s*:?\s*)?\d{11,14})\b"
FOLDED_LABEL = r"(?:CNPJ|CPF)(\d{11,14})"
PHONE = r"\(?\d{2}\)?\s*9\d{4}-?\d{4}"
PARTY_PREFIX = r"(?i)^\s*(REMET\.?|DEST\.?|DESTINO\.?|BENEF\.?)\s*"
DOCUMENT_LABEL = r"(?i)(?:^|\s)(?:NF|N[ºO°]|DOC(?:UMENTO)?)\s*\.?\s*(\d{3,12})\s*$"
MOVEMENT_HEAD = r"(?i)^(PIX|BOLETO|TED|DOC|PAGAMENTOS|TARIFA|IOF|SISPAG|DEBITO|CREDITO|RESGATE|APLIC)\b"
GENERIC_PARTY = r"(?i)^(PIX(\s+(ENVIADO|TRANSF|RECEBIDO))?|TED|DOC|TARIFA|TRANSFERÊNCIA( AVULSA)?|SALDO ANTERIOR)$"
TRAILING_NUMBER = r"(?<![A-Z0-9])(\d{4,12})$"
YEAR = r"^(19|20)\d{2}$"
CITY_STATE = r"^(.*?)\s*[/-]\s*([A-Z]{2})$"
# What a company's name has in it.
COMPANY_TOKENS = ("LTDA", "EIRELI", "S/A", "SA", "ME", "EPP")


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def format_tax_id(text: Column) -> Column:
    """Fourteen digits in the company mask, eleven in the person's, others bare."""
    d = F.regexp_replace(text, r"\D", "")
    company = F.regexp_replace(d, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")
    person = F.regexp_replace(d, r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4")
    return F.when(F.length(d) == 14, company).when(F.length(d) == 11, person).otherwise(d)


def _tax_id_in(t: Column) -> Column:
    """The best of all candidates in a text: each has the rank of its class, of one class the first counts.

    Classes, best first: with its mask; behind a label; behind a label once the text is folded; a bare run of fourteen digits; another bare run
    of eleven or more, or the digits of the whole text, unless something looks like a telephone number.
    """
    no_phone = ~t.rlike(PHONE)
    rank = lambda m: F.when(m.rlike("[./-]"), 0).when(m.rlike("^[Cc]"), 1).when(F.length(m) == 14, 3).when(no_phone, 4)
    candidate = lambda r, i, value: F.struct(r.cast("int").alias("rank"), i.cast("int").alias("at"), value.alias("value"))
    printed = F.transform(F.regexp_extract_all(t, F.lit(MENTION), F.lit(0)), lambda m, i: candidate(rank(m), i, m))
    digits = F.regexp_replace(t, r"\D", "")
    alone = (F.length(digits) == 14) | (F.regexp_replace(t, r"[\s.\-]", "").rlike(r"^\d{11}$") & no_phone)
    others = F.array(candidate(F.lit(2), F.lit(0), _first(fold(t), FOLDED_LABEL)), candidate(F.lit(5), F.lit(0), F.when(alone, digits)))
    best = F.array_min(F.filter(F.concat(printed, others), lambda c: c["rank"].isNotNull() & c["value"].isNotNull()))
    return format_tax_id(best["value"])


def extract_tax_id(*parts: Column) -> Column:
    """The tax id printed in the first part that has one, else in all parts together."""
    every = F.array(*[clean(p, repair=False) for p in parts])
    # the joined text is only looked at where no part has an id of its own
    found = lambda ps: F.coalesce(F.get(F.filter(F.transform(ps, lambda p: let(p, _tax_id_in)), lambda x: x.isNotNull()), F.lit(0)), let(clean(F.array_join(ps, " "), repair=False), _tax_id_in))
    return let(every, found)


def split_document(text: Column) -> Column:
    """struct(description, document): a labelled number, or 4 to 12 digits behind a movement's head, peeled off the end."""
    return let(clean(text, repair=False), _split)


def _split(t: Column) -> Column:
    labelled = _first(t, DOCUMENT_LABEL)
    trailing = _first(t, TRAILING_NUMBER)
    head = clean(F.regexp_replace(t, TRAILING_NUMBER, ""), repair=False)
    peel = trailing.isNotNull() & ~trailing.rlike(YEAR) & ~F.length(trailing).isin(11, 14) & head.rlike(MOVEMENT_HEAD)
    peel = F.coalesce(peel, F.lit(False))
    description = F.when(labelled.isNotNull(), clean(F.regexp_replace(t, DOCUMENT_LABEL, ""), repair=False)).when(peel, head).otherwise(t)
    return F.struct(description.alias("description"), F.when(labelled.isNotNull(), labelled).when(peel, trailing).alias("document"))


def strip_tax_id(text: Column, tax_id: Column) -> Column:
    digits = F.regexp_replace(tax_id, r"\D", "")
    t = F.replace(text, tax_id, F.lit(" "))
    t = F.when(digits != "", F.replace(t, digits, F.lit(" "))).otherwise(t)
    return F.when((F.coalesce(text, F.lit("")) != "") & (F.coalesce(tax_id, F.lit("")) != ""), clean(t, repair=False)).otherwise(text)


def party_of(line: Column) -> Column:
    """The company on the line behind a movement: after a sender's or receiver's label, or with a company's suffix."""
    return let(clean(line, repair=False), lambda t: let(_candidate(t), lambda c: _party(t, c)))


def _candidate(t: Column) -> Column:
    return F.coalesce(clean(F.regexp_replace(F.regexp_replace(t, PARTY_PREFIX, ""), r"^[ .\-]+|[ .\-]+$", ""), repair=False), t)


def _party(t: Column, candidate: Column) -> Column:
    labelled = t.rlike(PARTY_PREFIX)
    only_id = _tax_id_in(candidate).isNotNull() & ~labelled & F.replace(candidate, F.lit(" "), F.lit("")).rlike(r"^[\d.\-/]+$")
    company = F.lit(False)
    for token in COMPANY_TOKENS:
        company = company | F.contains(fold(candidate), F.lit(token))
    return F.when(~candidate.rlike(GENERIC_PARTY) & ~only_id & (labelled | company), candidate)


def city_state(text: Column) -> Column:
    return F.struct(F.trim(F.regexp_extract(text, CITY_STATE, 1)).alias("city"), F.regexp_extract(text, CITY_STATE, 2).alias("state"))


def code_postal(text: Column) -> Column:
    parts = F.split(text, r"\s*/\s*")
    return F.struct(F.regexp_replace(F.get(parts, F.lit(0)), r"\D", "").alias("code"), F.regexp_replace(F.get(parts, F.lit(1)), r"\D", "").alias("postal_code"))


def tax_id_type(text: Column) -> Column:
    n = F.length(F.regexp_replace(text, r"\D", ""))
    return F.when(n == 14, "CNPJ").when(n == 11, "CPF").otherwise("unknown")

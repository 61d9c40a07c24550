"""Predicates and texts of bookkeeping movements, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import collapsed, let, plain

# The taxes of which a movement may name several.
TAX_FAMILIES = (
    r"\bicms\b", r"\bipi\b", r"\bpis\b", r"\bcofins\b", r"\binss\b",
    r"\birrf\b", r"\birpj\b", r"\bcsll\b|\bc[ ._-]*soc\b|contribuicao social", r"\bpcc\b",
)
# Single taxes and the words of the account each is owed on.
TAX_ROLES = {
    "icms": (("icm",), ("recolher",)),
    "ipi": (("ipi",), ("recolher",)),
    "inss": (("inss",), ("recolher",)),
    "fgts": (("fgts",), ("recolher",)),
    "irpj": (("renda pj", "irpj"), ("recolher",)),
    "csll": (("contribuicao social", "csll"), ("recolher",)),
    "pis": (("pis",), ("recolher",)),
    "cofins": (("cofins",), ("recolher",)),
}
# Rules before the taxes: (direction or any, terms, account words, reason).
TERM_RULES = (
    ("inflow", ("rendimento", "rentab", "juros receb"), (("juros", "rendimento"), ("recebid", "receita")), "rendimento"),
    ("outflow", ("tarifa", "iof", "encargos banc", "doc/ted"), (("desp",), ("banc",)), "despesa_bancaria"),
    (None, ("capitaliza",), (("capitaliza",),), "capitalizacao"),
)
# The account words of what no rule tells, by direction, and the parents of accounts that hold money.
DEFAULT_ROLES = {"inflow": (("dupl", "cliente"), ("receber",)), "outflow": (("fornecedor",),)}
FINANCIAL_PARENTS = {"bank": "bancos conta movimento", "application": "aplicacoes de curto prazo"}

# What tells a transfer: the word, or a deposit that is made or drawn.
TRANSFER, DEPOSIT, DEPOSIT_MOVES = "transfer", "cdb", ("aplic", "resgat")
# Notes that only name the operation.
BARE_NOTES = ("pix enviado", "pix recebido", "pix recebida", "ted enviada", "ted recebido", "ted recebida", "boleto pago", "pagamento", "recebimento")


def has_any(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def is_compound(text: Column, families: tuple[str, ...] = TAX_FAMILIES) -> Column:
    """Whether a text names more than one tax."""
    return let(plain(text), lambda p: reduce(lambda a, b: a + b, [p.rlike(f).cast("int") for f in families]) > 1)


def is_transfer(text: Column) -> Column:
    return let(plain(text), lambda p: F.contains(p, F.lit(TRANSFER)) | (F.contains(p, F.lit(DEPOSIT)) & has_any(p, DEPOSIT_MOVES)))


def has_role(description: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """Each group has a term that the plain description contains."""
    return let(plain(description), lambda p: reduce(lambda a, b: a & b, [has_any(p, g) for g in groups]))


def rule_of(text: Column, direction: Column) -> Column:
    """The reason of the first rule that fits, or null; of taxes exactly one must be named."""

    def first(p: Column) -> Column:
        out = None
        for way, terms, _, reason in TERM_RULES:
            fits = has_any(p, terms) if way is None else (direction == way) & has_any(p, terms)
            out = F.when(fits, reason) if out is None else out.when(fits, reason)
        named = F.filter(F.array(*[F.when(p.rlike(rf"\b{t}\b"), F.lit(f"tributo:{t}")) for t in TAX_ROLES]), lambda x: x.isNotNull())
        return out.when(F.size(named) == 1, F.get(named, F.lit(0)))

    return let(plain(text), first)


def role_of(reason: str) -> tuple[tuple[str, ...], ...]:
    """The account words of a rule's reason."""
    found = {r: groups for _, _, groups, r in TERM_RULES} | {f"tributo:{t}": g for t, g in TAX_ROLES.items()}
    return found[reason]


def complement(counterparty: Column, notes: Column, document: Column) -> Column:
    """Party without a leading number, notes and document; a fixed text where all are empty."""
    party = F.trim(F.regexp_replace(F.coalesce(counterparty, F.lit("")), r"^\d{3,}-", ""))
    joined = F.concat_ws(" - ", *[F.nullif(x, F.lit("")) for x in (party, notes, document)])
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("Movimento bancario"))


def is_daily_balance(text: Column, prefixes: tuple[str, ...] = ("SALDO",)) -> Column:
    folded = F.regexp_replace(F.upper(text), r"\s+", "")
    return reduce(lambda a, b: a | b, [F.startswith(folded, F.lit(p)) for p in prefixes])


def upper_text(text: Column) -> Column:
    return F.upper(collapsed(F.translate(F.coalesce(text.cast("string"), F.lit("")), " ", " ")))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \-/]+|[ \-/]+$", "")


def operation(p: Column, inflow: Column) -> Column:
    """What kind of movement a plain text tells of; the order of the conditions decides."""
    has = lambda t: F.contains(p, F.lit(t))
    return (
        F.when(has("transfer"), "TRANSFERENCIA ENTRE CONTAS")
        .when(has("rendimento") | has("rentab"), "RENDIMENTO BANCARIO")
        .when(has("iof"), "IOF")
        .when(has("tarifa"), "TARIFA BANCARIA")
        .when(has("encargo"), "ENCARGOS BANCARIOS")
        .when(has("boleto") & ~inflow, "BOLETO PAGO")
        .when(has("pix"), F.when(inflow, "RECEBIMENTO PIX").otherwise("PAGAMENTO PIX"))
        .when(has("ted"), F.when(inflow, "RECEBIMENTO TED").otherwise("PAGAMENTO TED"))
        .otherwise(F.when(inflow, "RECEBIMENTO").otherwise("PAGAMENTO"))
    )


# The words in notes that only repeat an operation.
REPEATED = {
    "PAGAMENTO PIX": r"(?i)\bPIX\s+(?:ENVIADO|RECEBIDO|RECEBIDA)?\b",
    "RECEBIMENTO PIX": r"(?i)\bPIX\s+(?:ENVIADO|RECEBIDO|RECEBIDA)?\b",
    "PAGAMENTO TED": r"(?i)\bTED\s+(?:ENVIADA|ENVIADO|RECEBIDA|RECEBIDO)?\b",
    "RECEBIMENTO TED": r"(?i)\bTED\s+(?:ENVIADA|ENVIADO|RECEBIDA|RECEBIDO)?\b",
    "BOLETO PAGO": r"(?i)\bBOLETO\s+PAGO\b",
    "TARIFA BANCARIA": r"(?i)TARIFA(?:\s*BANCARIA)?",
    "IOF": r"(?i)IOF",
    "RENDIMENTO BANCARIO": r"(?i)RENDIMENTO",
}


def history_complement(counterparty: Column, notes: Column, document: Column, amount: Column) -> Column:
    """Operation, then party and notes without the words that name the operation, then the document unless it is there."""
    joined = F.trim(F.concat_ws(" ", *[F.trim(F.coalesce(x, F.lit(""))) for x in (counterparty, notes, document)]))
    party = F.regexp_replace(_bare(F.regexp_replace(upper_text(counterparty), r"^(?:\d{3,}\s*[-/]\s*)+", "")), r"S/A$", " S/A")
    # each step names its values, as each is used several times by the next
    parts = F.struct(operation(plain(joined), amount > 0).alias("op"), party.alias("party"), upper_text(notes).alias("note"), upper_text(document).alias("doc"))

    def without_operation(s: Column) -> Column:
        words = F.create_map(*[F.lit(x) for pair in REPEATED.items() for x in pair])[s["op"]]
        left = F.when(words.isNotNull(), _bare(F.regexp_replace(s["note"], words, F.lit("")))).otherwise(s["note"])
        left = F.when(plain(s["note"]).isin(*BARE_NOTES), F.lit("")).otherwise(left)
        return F.struct(s["op"].alias("op"), s["party"].alias("party"), left.alias("left"), s["doc"].alias("doc"))

    def with_detail(s: Column) -> Column:
        same = (s["party"] != "") & (s["left"] != "") & (plain(s["party"]) == plain(s["left"]))
        both = F.concat_ws(" - ", F.nullif(s["party"], F.lit("")), F.nullif(s["left"], F.lit("")))
        return F.struct(s["op"].alias("op"), F.when(same, s["party"]).otherwise(both).alias("detail"), s["doc"].alias("doc"))

    def whole(s: Column) -> Column:
        tail = F.when((s["doc"] != "") & ~F.contains(s["detail"], s["doc"]), F.concat(F.lit("DOC "), s["doc"]))
        return F.concat_ws(" - ", s["op"], F.nullif(s["detail"], F.lit("")), tail)

    return let(let(let(parts, without_operation), with_detail), whole)

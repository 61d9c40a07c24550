"""Text normalisers as column expressions.

Accents go through ``translate`` with a table derived from Unicode decompositions, so these stay inside
whole-stage code generation. ``plain_exact`` and ``fold_exact`` are Arrow functions with full Unicode
decomposition for scripts the table does not reach.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Words that carry no meaning in a movement's text.
STOP_WORDS = (
    "para", "com", "por", "dos", "das", "uma", "ltda", "eireli", "brasil", "pagamento",
    "recebimento", "nota", "fiscal", "fatura", "valor", "competencia", "numero", "mes",
)

# What is masked in a movement's text before it becomes a feature, in this order.
MASKS = (
    (r"\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b|\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", " documento_fiscal "),
    (r"\b\d{1,2}[/.-]\d{1,2}[/.-](?:\d{4}|\d{2})\b|\b\d{4}-\d{2}-\d{2}\b", " data "),
    (r"\b(?:0?[1-9]|1[0-2])[/.-](?:\d{4}|\d{2})\b", " competencia "),
    (r"(?:r\$\s*)?\b\d+(?:\.\d{3})*,\d{2}\b|r\$\s*\d+(?:\.\d{2})?\b", " valor "),
    (r"\b((?:nf|nfe|nf-e|fat|fatura|nota)\s*[.:#-]?\s*)\d+\b", "$1 numero "),
    (r"\b\d{4,}\b", " numero "),
)


def _accents() -> tuple[str, str]:
    """Letters up to U+024F that decompose into one ASCII letter and marks, and these letters."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(c, d[0]) for c, d in pairs if d[0].isascii() and d[0].isalpha() and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


ACCENTED, BASE = _accents()


def _compatible(plane_end: int = 0x20000) -> tuple[str, str, str, str]:
    """Characters whose compatibility decomposition has one ASCII character, and these; those with several, and theirs."""
    one, many = [], []
    for c in range(0x80, plane_end):
        if 0xD800 <= c < 0xE000:
            continue
        ascii_ = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if x.isascii())
        if ascii_:
            (one if len(ascii_) == 1 else many).append((chr(c), ascii_))
    return "".join(c for c, _ in one), "".join(a for _, a in one), "\x00".join(c for c, _ in many), "\x00".join(a for _, a in many)


_ONE, _ONE_ASCII, _MANY, _MANY_ASCII = _compatible()
_MANY_CLASS = "[" + _MANY.replace("\x00", "") + "]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once and named, so that a plan does not repeat its expression for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, BASE)


def collapsed(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _spelt(t: Column) -> Column:
    """With ligatures, fractions and other characters of several letters spelt out; only texts that have one are taken apart."""
    spelling = F.map_from_arrays(F.split(F.lit(_MANY), "\x00"), F.split(F.lit(_MANY_ASCII), "\x00"))
    parts = F.regexp_extract_all(t, F.lit(f"{_MANY_CLASS}|[^{_MANY_CLASS[1:]}+"), F.lit(0))
    spelt = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(spelling, p), p)), "")
    # a translation looks letters up in a map, where a class of hundreds of members is tried one by one
    return F.when(F.length(F.translate(t, _MANY.replace("\x00", ""), "")) < F.length(t), spelt).otherwise(t)


def plain(text: Column) -> Column:
    """Lower-case ASCII of the compatibility decomposition (accents go, ligatures, ordinals and wide letters become plain ones), other characters dropped, blanks collapsed; null gives an empty text."""

    def of(t: Column) -> Column:
        ascii_ = F.regexp_replace(F.translate(_spelt(t), _ONE, _ONE_ASCII), r"[^\x00-\x7F]", "")
        return F.when(t.rlike(r"[^\x00-\x7F]"), ascii_).otherwise(t)

    return F.trim(F.regexp_replace(F.lower(let(F.coalesce(text, F.lit("")), of)), r"[\s\x1c-\x1f]+", " "))


def fold(text: Column) -> Column:
    """Upper-case letters A-Z and digits only."""
    return F.regexp_replace(F.upper(without_accents(text)), "[^A-Z0-9]", "")


def folded(text: str) -> str:
    """What ``fold`` makes of a fixed text."""
    return re.sub("[^A-Z0-9]", "", text.translate(str.maketrans(ACCENTED, BASE)).upper())


def _plain_exact():
    """Defined in here, the function travels to the workers by value; they need not have this package."""

    def plain_of(text: pd.Series) -> pd.Series:
        return text.fillna("").map(lambda t: " ".join(unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower().split()))

    return F.pandas_udf(plain_of, StringType())


def _fold_exact():
    def fold_of(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t).upper() if c.isascii() and c.isalnum()))

    return F.pandas_udf(fold_of, StringType())


plain_exact, fold_exact = _plain_exact(), _fold_exact()


def words(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct words of three letters or more in the plain text, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(plain(text), F.lit("[a-z]{3,}"), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(w) for w in stop])) if stop else found


def clean(text: Column, repair: bool = True) -> Column:
    """Hard spaces and soft hyphens replaced, UTF-8 read as Latin-1 repaired (unless told not to), blanks collapsed, empty to null."""
    t = F.translate(text.cast("string"), "\u00a0\u00ad", " -")
    return let(collapsed(let(t, _repaired) if repair else t), lambda c: F.when(c != "", c))


def _repaired(t: Column) -> Column:
    bytes_ = F.encode(t, "iso-8859-1")
    broken = t.rlike("[ÃÂ]") & ~t.rlike(r"[^\x00-\xFF]")
    # the bytes' validity guards the decoding, which would raise
    return F.when(broken & F.is_valid_utf8(bytes_.cast("string")), F.try_validate_utf8(bytes_.cast("string"))).otherwise(t)


def dash_to_null(text: Column) -> Column:
    """The variant for printed forms, where a lone dash stands for nothing."""
    return let(clean(text, repair=False), lambda t: F.when(t != "-", t))


def normalized(text: Column) -> Column:
    """Lower-case with tax ids, dates, periods, amounts, invoice numbers and long numbers masked, in that order."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for pattern, mask in MASKS:
        t = F.regexp_replace(t, pattern, mask)
    return collapsed(t)


def global_features(text: Column, direction: Column) -> Column:
    return F.trim(F.concat(F.lit("direcao_"), direction, F.lit(" "), normalized(text)))


def local_features(text: Column, direction: Column, account: Column, amount: Column | None = None) -> Column:
    """Adds the account and, unless the amount is null or 0, its cents and the number of digits of its whole part."""
    head = F.concat(F.lit("direcao_"), direction, F.lit(" banco_"), account)
    if amount is not None:
        value = F.abs(amount)
        cents = F.concat(F.lit(" valor_"), F.floor(value * 100).cast("string"), F.lit(" ordem_"), F.length(F.floor(value).cast("string")).cast("string"))
        head = F.concat(head, F.when(value != 0, cents).otherwise(F.lit("")), F.lit(""))
        head = F.coalesce(head, F.concat(F.lit("direcao_"), direction, F.lit(" banco_"), account))
    return F.trim(F.concat(head, F.lit(" "), normalized(text)))


def movement_text(*parts: Column, trim: bool = False) -> Column:
    """The non-empty parts, joined by spaces."""
    return F.concat_ws(" ", *[F.nullif(F.trim(p) if trim else p, F.lit("")) for p in parts])


def containment(left: Column, right: Column) -> Column:
    """Shared words over the smaller set; 0 where a set is empty."""
    least = F.least(F.size(left), F.size(right))
    return F.when(least > 0, F.size(F.array_intersect(left, right)) / least).otherwise(F.lit(0.0))


def jaccard(left: Column, right: Column) -> Column:
    both = F.size(F.array_union(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.size(F.array_intersect(left, right)) / both).otherwise(F.lit(0.0))


def _sequence_ratio():
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(left, right, strict=True)])

    return F.pandas_udf(ratio, DoubleType())


#: Ratcliff-Obershelp similarity, which no built-in expression computes; for candidates only.
sequence_ratio = _sequence_ratio()


def _bounded_ratio():
    """Like the other Arrow functions self-contained, so that it travels by value."""

    def ratio(left: pd.Series, right: pd.Series, least: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        import numpy as np

        def letters(lines: list[bytes]) -> np.ndarray:
            rows = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
            return np.bincount(rows * 256 + np.frombuffer(b"".join(lines), np.uint8), minlength=len(lines) * 256).reshape(-1, 256)

        a, b = (list(map(str, x.fillna(""))) for x in (left, right))
        out: list[float | None] = []
        for start in range(0, len(a), 1024):
            x, y = a[start : start + 1024], b[start : start + 1024]
            # twice the common letters over all letters: no ratio is above it, where a letter is a byte
            p, q = letters([s.encode() for s in x]), letters([s.encode() for s in y])
            most = 2 * np.minimum(p, q).sum(1) / np.maximum(p.sum(1) + q.sum(1), 1)
            able = (most >= least.iloc[start : start + 1024].to_numpy(float) - 1e-9).tolist()
            out += [SequenceMatcher(None, s, t).ratio() if go or not s.isascii() or not t.isascii() or not s + t else None for s, t, go in zip(x, y, able, strict=True)]
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(ratio, DoubleType())


#: The sequence ratio where it may reach the third column's value, null where the lines' common letters say that it can't.
bounded_ratio = _bounded_ratio()


def similarity(left: Column, right: Column) -> Column:
    """Of two word sets: three quarters containment, one quarter sequence ratio of the sorted words."""
    line = lambda ws: F.array_join(F.array_sort(ws), " ")
    score = containment(left, right) * 0.75 + sequence_ratio(line(left), line(right)) * 0.25
    return F.when((F.size(left) > 0) & (F.size(right) > 0), score).otherwise(F.lit(0.0))

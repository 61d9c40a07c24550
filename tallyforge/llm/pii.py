"""Personal data: exact base patterns, and spans added by a character-level BiLSTM with CRF transitions.

The tagger is trained in numpy from labelled spans (made-up ones unless others are given). It reads every whole text in
overlapping windows; the windows' scores are merged and one best tag path is found for the whole text. What it marks beyond
the base spans are addresses spelt with "[at]", grouped card numbers and phone numbers that the base rules leave out, secrets
(keys and tokens) and account numbers (IBAN). Windows far from any digit and at-sign can hold none of these and are not read. An added span loses foreign characters at its ends, an address or a secret grows
to its whole run, and a check of the form follows, so that plain numbers stay; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import tagger
from tallyforge.llm.common import arrow_map, portions, table

KINDS = tagger.KINDS
#: Labelled texts the tagger is trained on by default, and the steps.
EXAMPLES, STEPS = 12_000, 1_000
#: Bytes of texts that are tagged at once; a longer text is tagged alone.
PORTION = 1 << 18

#: Every base kind has a digit or an at-sign.
_BASE = re.compile(r"[0-9@]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_HOST = re.compile(r"[A-Za-z0-9.-]*")
_AT = re.compile(r"@|[\[(] ?at ?[\])]", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Za-z0-9_+/=-]")
_NUMBERED = re.compile(r"[0-9][A-Za-z0-9_+/=-]*")
# possessive runs of digits behind a non-digit match what the plain pattern matches, in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their at-signs: the longest run before it that no earlier match holds, a domain behind."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            # a run before a failing sign can't start a later match: the sign itself is no part of one
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end), leftmost and non-overlapping within each kind; matches that fail a check are dropped."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return ordered(out)


def ordered(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], s[0], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


#: Characters a span of a kind may begin and end with; others at its ends are cut off before the check.
_ENDS = (re.compile(r"[A-Za-z0-9]"), re.compile(r"[0-9]"), re.compile(r"[0-9]"), re.compile(r"[0-9]"), re.compile(r"[A-Za-z0-9=]"), re.compile(r"[A-Za-z0-9]"))
_STARTS = (_ENDS[0], _ENDS[1], _ENDS[2], re.compile(r"[0-9+(]"), re.compile(r"[A-Za-z0-9]"), re.compile(r"[A-Za-z]"))
_WHOLE = (
    re.compile(r"[A-Za-z0-9._%+-]+(?:(?:@| ?[\[(] ?at ?[\])] ?)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", re.IGNORECASE),
    re.compile(r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}"),
    re.compile(r"(?:[0-9][ -]?){13,18}[0-9]"),
    re.compile(r"\+?[0-9(][ ().0-9-]+[0-9]"),
    re.compile(r"[A-Za-z0-9_+/=-]{20,}"),
    re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", re.IGNORECASE),
)


def checked(text: str, span: Span) -> Span | None:
    """The span without foreign ends, if it then has the form of its kind and does not stand inside a longer token."""
    kind, start, end = span
    while start < end and not _STARTS[kind].match(text[start]):
        start += 1
    while end > start and not _ENDS[kind].match(text[end - 1]):
        end -= 1
    value = text[start:end]
    if not value or not _WHOLE[kind].fullmatch(value):
        return None
    if kind and ((start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())):
        return None
    if kind == 2 and value.isdigit() and not luhn(value):
        return None
    if kind == 3:
        digits = sum(map(str.isdigit, value))
        if not 10 <= digits <= 15 or value[0] != "+" and (digits == len(value) or digits > 11):
            return None
    if kind == 4 and (sum(map(str.isdigit, value)) < 4 or sum(map(str.isalpha, value)) < 4):
        return None
    if kind == 5:
        plain = value.replace(" ", "")
        if tagger.iban_rest(plain[4:] + plain[:4]) != 1:
            return None
    return kind, start, end


def grown(text: str, span: Span) -> Span:
    """An address or a secret that the tagger marked in part, with the rest of its run on either side; other spans as they are."""
    kind, start, end = span
    if kind == 4:
        while start and _TOKEN.match(text[start - 1]):
            start -= 1
        while end < len(text) and _TOKEN.match(text[end]):
            end += 1
    if kind or not _AT.search(text, start, end):
        return kind, start, end
    while start and _LOCAL.match(text[start - 1]):
        start -= 1
    return kind, start, _HOST.match(text, end).end()


def zones(text: str) -> list[tuple[int, int]]:
    """(start, end) of the digits, with the tokens they stand in, and of the at-signs, spelt ones too.

    No span that touches none of them passes the check, grown or not: every form of _WHOLE needs a digit or an at-sign, and only a secret grows
    from a part of a token without one. The tagger alone tells which of these places are personal data.
    """
    out, done = [m.span() for m in _AT.finditer(text)], 0
    for m in _NUMBERED.finditer(text):
        start = m.start()
        while start > done and _TOKEN.match(text[start - 1]):
            start -= 1
        done = m.end()
        if out and out[-1][1] <= start <= out[-1][1] + 16:  # near ones are one
            out[-1] = (out[-1][0], done)
        else:
            out.append((start, done))
    return out


def found_spans(model: dict[str, np.ndarray], texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """For each text the base spans and the tagger's that pass the check and touch no base span. The tagger reads wherever such spans can be (zones())."""
    # as marked where the whole of it does not pass, or touches a base span
    added = [[[s for s in (checked(t, grown(t, span)), checked(t, span)) if s] for span in spans] for t, spans in zip(texts, tagger.marked(model, texts, zones=[zones(t) for t in texts]), strict=True)]
    out = []
    for b, more in zip(base, added, strict=True):
        taken = sorted((s, e) for _, s, e in b)
        starts = np.array([s for s, _ in taken] or [0])
        ends = np.maximum.accumulate(np.array([e for _, e in taken] or [0]))
        free = lambda s: not len(taken) or not (i := np.searchsorted(starts, s[2])) or ends[i - 1] <= s[1]  # noqa: E731, B023
        keep = [s for forms in more if (s := next(filter(free, forms), None))]
        out.append(ordered([*b, *dict.fromkeys(keep)]))
    return out


_models: dict[tuple[int, int], dict[str, np.ndarray]] = {}


def default_model(spark: SparkSession, examples: int = EXAMPLES, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Trained in a task, once a driver process; the training is deterministic, and the model is a few thousand numbers."""
    key = (examples, steps)
    if key not in _models:

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if sum(b.num_rows for b in batches):
                model = tagger.train(tagger.examples(examples), steps=steps)
                yield pa.RecordBatch.from_arrays([pa.array(list(model)), pa.array([list(a.shape) for a in model.values()], pa.list_(pa.int32())), pa.array([a.astype(np.float32).tobytes() for a in model.values()])], names=["name", "shape", "numbers"])

        rows = arrow_map(spark.range(0, 1, 1, 1), run, "name string, shape array<int>, numbers binary").collect()
        _models[key] = {r["name"]: np.frombuffer(r["numbers"], np.float32).reshape(r["shape"]).copy() for r in rows}
    return _models[key]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, base counts by kind, base_sha256, spans (base and added ones).

    Positions are code points, ends exclusive. Null and empty texts have no spans. Repeated rows get equal
    results, a null doc_id stays null, whole texts are read, an empty table gives no rows, other columns are
    not read. The model is a few thousand numbers and goes along with the tasks.
    """
    model = model or default_model(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for whole in batches:
            for batch in portions(whole, PORTION):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                base = [base_spans(t) if _BASE.search(t) else [] for t in texts]
                rows = []
                for b, spans in zip(base, found_spans(model, texts, base), strict=True):
                    rows.append((*(sum(k == kind for k, _, _ in b) for kind in range(4)), hashlib.sha256(joined(b).encode()).hexdigest() if b else nothing, joined(spans)))
                types = [pa.int64()] * 4 + [pa.string()] * 2
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return arrow_map(docs.select("doc_id", "text"), run, SCHEMA)


def masked(docs: DataFrame, model: dict[str, np.ndarray] | None = None, form: str = "[{}]") -> DataFrame:
    """Documents with each span replaced by its kind's name; the other columns and the order of columns stay.

    A null text stays null, an empty one empty; repeated rows get equal texts, a null doc_id is like any other, long texts are
    read whole, an empty table gives no rows. ``n_chars``, where it is a column, follows the new text.
    """
    model = model or default_model(docs.sparkSession)
    columns = docs.columns
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, PORTION):
                texts = batch.column("text").to_pylist()
                base = [base_spans(t) if t and _BASE.search(t) else [] for t in texts]
                spans = found_spans(model, [t or "" for t in texts], base)
                texts = [replaced(t, s, form) if s else t for t, s in zip(texts, spans, strict=True)]
                at = batch.schema.get_field_index("text")
                yield batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))

    out = arrow_map(docs, run, schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(schema["n_chars"].dataType)))
    return out.select(*columns)


def replaced(text: str, spans: list[Span], form: str) -> str:
    """Overlapping spans are replaced as one, by the name of the first."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], form.format(KINDS[kind])]
        at = max(at, end)
    return "".join(out) + text[at:]


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))

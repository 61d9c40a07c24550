"""Printed invoices: whole forms, odd forms, and random ones beside a loop."""

import datetime
import hashlib
import random
import re
import unicodedata
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyforge.operators import forms
from tallyforge.operators import printed as printed_words
from tallyforge.plans import ingestion

KEY = "3550308" + "2" + "1" * 42
# (label line, value line): cells as (x, text)
FORM = [
    ([(5, "DANFSe v2.0"), (200, "Documento Auxiliar da NFS-e"), (505, "São Paulo")], None),
    ([(5, "CHAVE DE ACESSO DA NFS-e")], [(5, KEY)]),
    ([(5, "NÚMERO DA NFS-e"), (150, "COMPETÊNCIA"), (300, "EMISSÃO")], [(5, "42"), (150, "01/02/2024"), (300, "03/02/2024"), (360, "10:20:30")]),
    ([(5, "NÚMERO DA DPS"), (150, "SÉRIE")], [(5, "7"), (150, "A1"), (300, "03/02/2024")]),
    ([(5, "EMITIDA"), (150, "SITUAÇÃO DA NFS-e")], [(150, "Normal")]),
    ([(5, "PRESTADOR / FORNECEDOR DA NFS-e")], None),
    ([(5, "CPF / CNPJ / NIF"), (200, "INSCRIÇÃO"), (400, "TELEFONE")], [(5, "11.222.333/0001-81"), (200, "998"), (400, "(11) 5555")]),
    ([(5, "NOME / NOME EMPRESARIAL"), (300, "MUNICÍPIO / UF")], [(5, "ACME SERVICOS"), (300, "São Paulo / sp"), (450, "3550308 / 01000-000")]),
    ([(5, "ENDEREÇO"), (300, "E-MAIL")], [(5, "Rua A, 1"), (300, "a@b.example")]),
    ([(5, "TOMADOR / ADQUIRENTE DA OPERAÇÃO")], None),
    ([(5, "CPF / CNPJ / NIF")], [(5, "529.982.247-25"), (200, "-")]),
    ([(5, "NOME / NOME EMPRESARIAL")], [(5, "Fulana"), (300, "Recife"), (450, "2611606 /")]),
    ([(5, "ENDEREÇO")], [(5, "-")]),
    ([(5, "SERVIÇO PRESTADO")], None),
    ([(5, "CÓD. TRIBUTAÇÃO NACIONAL / MUNICIPAL"), (200, "NBS")], [(5, "01.02.03 / 9"), (200, "1.15"), (400, "Recife / PE")]),
    ([(5, "Análise e"), (60, "desenvolvimento")], None),
    ([(5, "DESCRIÇÃO DO SERVIÇO")], [(5, "Suporte de")]),
    ([(5, "março"), (60, "de 2024")], None),
    ([(5, "TRIBUTAÇÃO MUNICIPAL (ISSQN)")], None),
    ([(5, "TIPO DE TRIBUTAÇÃO DO ISSQN"), (200, "MUNICÍPIO / UF / PAÍS DA INCIDÊNCIA")], [(5, "Tributável"), (200, "Recife / PE")]),
    ([(5, "X"), (110, "BC ISSQN"), (240, "ALÍQUOTA APLICADA"), (355, "RETENÇÃO DO ISSQN"), (470, "ISSQN APURADO")], [(110, "R$ 1.000,00"), (240, "2,50%"), (355, "Não Retido"), (470, "R$ 25,00")]),
    ([(5, "TRIBUTAÇÃO FEDERAL (EXCETO CBS)")], None),
    ([(5, "IRRF"), (200, "CONTRIBUIÇÃO PREVIDENCIÁRIA")], [(5, "R$ 15,00"), (200, "-")]),
    ([(5, "PIS - DÉBITO APURAÇÃO PRÓPRIA"), (200, "COFINS - DÉBITO APURAÇÃO PRÓPRIA")], [(5, "6,50"), (200, "30,00")]),
    ([(5, "TRIBUTAÇÃO IBS / CBS")], None),
    ([(200, "IND. OPERAÇÃO / MUNICÍPIO INCIDÊNCIA")], [(200, "01 / 2611606 / Recife")]),
    ([(5, "BC APÓS EXCLUSÕES E REDUÇÕES"), (400, "ALÍQUOTA IBS UF / MUN")], [(5, "1.000,00"), (400, "0,10% / 0,05%")]),
    ([(5, "ALÍQ. EFETIVA MUNICIPAL - IBS"), (150, "VALOR APURADO MUNICIPAL - IBS"), (300, "ALÍQ. EFETIVA ESTADUAL - IBS"), (445, "VALOR APURADO ESTADUAL - IBS")], [(5, "0,05"), (150, "0,50"), (300, "0,10"), (445, "1,00")]),
    ([(5, "VALOR TOTAL APURADO - IBS"), (150, "ALÍQUOTA - CBS"), (300, "ALÍQUOTA EFETIVA - CBS"), (445, "VALOR TOTAL APURADO - CBS")], [(5, "1,50"), (150, "0,90"), (300, "0,90"), (445, "9,00")]),
    ([(5, "VALOR TOTAL DA NFS-e")], None),
    ([(5, "VALOR DO SERVIÇO"), (150, "DESCONTO INCONDICIONADO"), (300, "DESCONTO CONDICIONADO"), (445, "TOTAL DAS RETENÇÕES")], [(5, "R$ 1.000,00"), (150, "-"), (300, "10,00"), (445, "51,50")]),
    ([(5, "VALOR LÍQUIDO DA NFS-e"), (200, "TOTAL DO IBS/CBS"), (400, "VALOR LÍQUIDO + IBS/CBS")], [(5, "938,50"), (200, "10,50"), (400, "949,00")]),
]


def printed(form=FORM, page=1, step=10.0):
    """The form's lines: (page, top, [(x, text)])."""
    flat = [line for pair in form for line in pair if line is not None]
    return [(page, 10 + step * i, cells) for i, cells in enumerate(flat)]


def rows(lines, doc="d"):
    out = []
    for page, top, cells in lines:
        for x, text in cells:
            for k, t in enumerate(text.split(" ")):
                out.append((doc, page, len(out), t, float(x + 3 * k), float(x + 3 * k + 2), float(top), float(top + 8)))
    return out


def frame(spark, *documents):
    return spark.createDataFrame([r for d in documents for r in d], "doc string, page int, ord int, text string, x0 double, x1 double, top double, bottom double")


def records(spark, *documents):
    return {r.doc: r for r in forms.printed_invoices(frame(spark, *documents)).collect()}


def test_a_whole_form(spark):
    r = records(spark, rows(printed()))["d"]
    assert (r.page, r.recognised, r.version, r.key, r.number, r.environment, r.status, list(r.dps)) == (1, True, "2.0", KEY, "42", "2", "Normal", ["7", "A1"])
    assert (r.competence_date, r.issue_datetime) == (datetime.date(2024, 2, 1), datetime.datetime(2024, 2, 3, 10, 20, 30))
    p, c = r.provider, r.customer
    assert (p.tax_id, p.tax_id_type, p.name, p.municipal_registration, p.phone, p.email) == ("11222333000181", "CNPJ", "ACME SERVICOS", "998", "(11) 5555", "a@b.example")
    assert list(p.address) == ["3550308", "Rua A, 1", "SP", "01000-000"]
    assert (c.tax_id, c.tax_id_type, c.name, c.municipal_registration, list(c.address)) == ("52998224725", "CPF", "Fulana", None, ["2611606", None, None, None])
    assert list(r.locations) == ["3550308", "São Paulo", "Recife / PE", "Recife / PE"]
    assert list(r.service) == ["01.02.03", "9", "1.15", "Análise e desenvolvimento", "Suporte de março de 2024"]
    a = r.amounts
    assert (a.gross, a.taxable_base, a.rate, a.iss, a.retained_total, a.unconditional_discount, a.conditional_discount, a.net) == (D(1000), D(1000), D("2.5"), D(25), D("51.5"), None, D(10), D("938.5"))
    assert list(r.retentions) == ["Não Retido", D(15), None, D("6.5"), D(30)] and r.taxes.iss_taxation == "Tributável"
    i = r.taxes.ibs_cbs
    assert (i.incidence_location_code, i.incidence_location_name, i.taxable_base, i.ibs_state_rate, i.ibs_municipal_rate, i.ibs_total, i.cbs, i.cbs_rate, i.invoice_total) == ("2611606", "Recife", D(1000), D("0.1"), D("0.05"), D("1.5"), D(9), D("0.9"), D(949))
    assert (i.ibs_state, i.ibs_municipal, i.ibs_state_effective_rate, i.ibs_municipal_effective_rate, i.cbs_effective_rate) == (D(1), D("0.5"), D("0.1"), D("0.05"), D("0.9"))
    assert r.issues == []
    seen = r.provenance["provider.name"]
    assert (seen.page, seen.x0, seen.x1, seen.excerpt, seen.bottom - seen.top) == (1, 0.0, 290.0, "ACME SERVICOS", 8.0) and set(r.provenance) == {c[0] for c in forms.CELLS}


def changed(old, new):
    return [tuple(None if line is None else [(x, new if t == old else t) for x, t in line] for line in pair) for pair in FORM]


def test_order_and_copies_of_words_do_not_matter(spark):
    whole = rows(printed())
    twice = [(d, p, 10_000 - o, *rest) for d, p, o, *rest in reversed(whole)] + [(d, p, 20_000 + o, *rest) for d, p, o, *rest in whole[:40]]
    assert records(spark, whole)["d"] == records(spark, twice)["d"]


def test_what_is_missing_is_told_and_not_made_up(spark):
    start, end = (next(i for i, pair in enumerate(FORM) if pair[0][0][1] == t) for t in ("DESCRIÇÃO DO SERVIÇO", "TRIBUTAÇÃO MUNICIPAL (ISSQN)"))
    without = FORM[:start] + [(FORM[start][0], None)] + FORM[end:]
    r = records(spark, rows(printed(without)))["d"]
    assert r.service.description is None and [list(i) for i in r.issues] == [["missing_required_evidence", "service.description", None]]
    cases = {
        "R$ 1.000,00": ("mil", {("unparseable_printed_value", "amounts.gross", "mil"), ("unparseable_printed_value", "amounts.taxable_base", "mil")}),
        "01/02/2024": ("31/02/2024", {("invalid_printed_date", "competence_date", "31/02/2024")}),
        KEY: ("123", {("invalid_printed_key", "key", "123")}),
        "Fulana": ("-", {("missing_required_evidence", "customer.name", None)}),
    }
    for old, (new, told) in cases.items():
        r = records(spark, rows(printed(changed(old, new))))["d"]
        assert {tuple(i) for i in r.issues} == told, old
    assert records(spark, rows([(1, 10, [(5, "nada")])]))["d"].key is None


def test_a_code_between_label_and_value(spark):
    def shifted(by):
        lines = printed(step=30.0)
        at = next(i for i, (_, _, cells) in enumerate(lines) if cells[0][1] == "42")
        page, top, cells = lines[at]
        return lines[:at] + [(page, top - 3 - by, [(500, "QR")]), (page, top, cells)] + lines[at + 1 :]

    near, far = records(spark, rows(shifted(10)))["d"], records(spark, rows(shifted(16)))["d"]
    assert (near.number, near.competence_date) == ("42", datetime.date(2024, 2, 1))
    assert far.number is None and {i.field for i in far.issues} >= {"number", "competence_date", "issue_datetime"}


def test_optional_groups(spark):
    start, end = (next(i for i, pair in enumerate(FORM) if pair[0][0][1] == t) for t in ("TRIBUTAÇÃO IBS / CBS", "VALOR TOTAL DA NFS-e"))
    bare = FORM[: start + 1] + FORM[end:]
    assert records(spark, rows(printed(bare)))["d"].taxes.ibs_cbs is None
    total = records(spark, rows(printed(changed("1,50", "-"))))["d"].taxes.ibs_cbs
    assert total.ibs_total == D("10.5") and total.cbs == D(9)


def test_the_page_that_is_an_invoice_counts(spark):
    sure = [([(5, "DANFSe v3.1"), (200, "Documento Auxiliar da NFS-e")], None), *FORM[1:]]
    cover = [(1, 10, [(5, "CHAVE DE ACESSO DA NFS-e")]), (1, 20, [(5, "9" * 50)])]
    got = records(spark, rows(cover + printed(sure, page=2)), rows(cover, "cover"), [("bad", 1, 1, "", 1.0, 2.0, 3.0, 4.0), ("bad", 1, 2, "x", None, 2.0, 3.0, 4.0), ("bad", 1, 3, None, 1.0, 2.0, 3.0, 4.0)])
    assert (got["d"].page, got["d"].recognised, got["d"].version, got["d"].key) == (2, True, "3.1", KEY)
    assert (got["cover"].recognised, got["cover"].key, got["cover"].version) == (False, "9" * 50, "2.0") and set(got) == {"d", "cover"}
    assert forms.printed_invoices(frame(spark, rows(cover)).limit(0)).count() == 0


def test_printed_pages_are_ingested_and_checked(spark, tmp_path):
    bodies = {n: b"%PDF-1.4 " + n.encode() for n in ("good", "plain")}
    for n, body in bodies.items():
        (tmp_path / f"{n}.pdf").write_bytes(body)
    doc = {n: hashlib.sha256(body).hexdigest() for n, body in bodies.items()}
    words = frame(spark, rows(printed(changed("Fulana", "-")), doc["good"]), rows([(1, 10, [(5, "nada")])], doc["plain"]), rows(printed(), "no such file"))
    got = ingestion.ingest(spark, str(tmp_path), words=words)
    assert [(r.doc, r.number) for r in got.printed_invoices.collect()] == [(doc["good"], "42")]
    # the customer's name is missing, and the key's last digit does not check
    assert {(r.severity, r.code) for r in got.issues.where(F.col("doc") == doc["good"]).collect()} == {("warning", "missing_required_evidence"), ("error", "invalid_nfse_key")}


def by_loop(words):
    """Lines, found labels and cells of one page, the plain way."""
    fold = lambda t: re.sub("[^A-Z0-9]", "", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").upper())
    lines = []
    for w in sorted(words, key=lambda w: (w[6], w[4])):
        if not lines or w[6] - lines[-1][0][6] > 2:
            lines.append([])
        lines[-1].append(w)
    lines = [sorted(x, key=lambda w: w[4]) for x in lines]
    folded = [fold(" ".join(w[3] for w in x)) for x in lines]
    found = {}
    for name, label, behind, before in forms.ANCHORS:
        after = next((found[b] for b in behind if b in found), -1)
        hits = [i for i in range(after + 1, found.get(before, len(lines))) if fold(label) in folded[i]]
        if hits:
            found[name] = hits[0]
            if hits[0] + 1 < len(lines):
                found[f"{name}.below"] = hits[0] + 1
    values = {}
    for field, at, a, b, *_ in forms.CELLS:
        if at in found:
            top = lambda i: min(w[6] for w in lines[i])
            cut = lambda i: " ".join(w[3] for w in lines[i] if a <= (w[4] + w[5]) / 2 < b)  # noqa: B023, E731
            near = [cut(i) for i in range(found[at], len(lines)) if top(i) - top(found[at]) <= forms.LOOK_AHEAD]
            text = next((t for t in near if t), "")
            values[field] = None if text in ("", "-") else text
    return {k: v + 1 for k, v in found.items()}, values


def test_random_forms_equal_a_loop(spark):
    r = random.Random(11)
    documents = {}
    for n in range(25):
        form = [pair for pair in FORM if r.random() < 0.9]
        form = [tuple(None if line is None or (i and r.random() < 0.1) else [c for c in line if r.random() < 0.93] or [(300, "-")] for i, line in enumerate(pair)) for pair in form]
        if n % 3 == 0:
            r.shuffle(form)
        documents[f"d{n}"] = rows(printed([(a, b) for a, b in form if a], step=r.choice([4.0, 10.0, 25.0])), f"d{n}")
    pages = forms.form_pages(frame(spark, *documents.values())).withColumn("found", forms.found_lines(F.col("lines")))
    got = {x.doc: (x.found, {k: v.text for k, v in x.v.items()}) for x in pages.select("doc", "found", forms.cell_values(F.col("lines"), F.col("found")).alias("v")).collect()}
    assert len(got) == 25
    for doc, words in documents.items():
        assert got[doc] == by_loop(words), doc


def test_pages_are_read_after_one_shuffle(spark):
    """Words were shuffled by place, page, line and document before, and each line folded once a label."""
    plan = forms.form_pages(frame(spark, rows(printed())))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_lines_of_words_equal_a_loop(spark):
    r = random.Random(5)
    words = [(f"d{n % 3}", n % 2, n, r.choice("abc"), x := r.choice([1.0, 1.004, 1.006, 7.5]), x + 2, r.choice([None, 10.0, 10.004, 11.0, 12.3, 14.301, 30.0]), 40.0 + n % 4 / 1000) for n in r.sample(range(240), 240)]
    expected = {}
    spot = lambda w: (w[0], w[1], w[3], *[None if v is None else round(v, 2) for v in w[4:]])
    first = {}
    for w in sorted(words, key=lambda w: w[2]):
        first.setdefault(spot(w), w)
    for w in sorted(first.values(), key=lambda w: (w[6] is not None, w[6] or 0.0, w[4], w[2])):
        lines = expected.setdefault(w[:2], [])
        if not lines or lines[-1][0] is None or abs(w[6] - lines[-1][0]) > printed_words.TOLERANCE:
            lines.append([w[6], w[7], []])
        lines[-1][1] = max(lines[-1][1], w[7])
        lines[-1][2].append((w[4], w[5], w[3]))
    got = {(p.doc, p.page): [[x.top, x.bottom, [tuple(w) for w in x.words]] for x in p.lines] for p in printed_words.page_lines(frame(spark, words)).collect()}
    assert got == {k: [[top, bottom, sorted(ws)] for top, bottom, ws in lines] for k, lines in expected.items()} and sum(map(len, got.values())) > 20

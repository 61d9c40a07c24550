import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import bookkeeping as b
from tallyforge.functions import identity, money, text

D = Decimal


def one(spark, value, column):
    """The value of an expression over one text column ``x``."""
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


@pytest.fixture(autouse=True)
def _column(spark):
    """The column of one(), which needs a session."""
    global X
    X = F.col("x")


@pytest.mark.parametrize("value,expected", [("  Ação\tÇ ", "acao c"), (None, ""), ("ß – é", "e"), ("A  B", "a b")])
def test_plain(spark, value, expected):
    assert one(spark, value, text.plain(X)) == expected
    assert one(spark, value, text.plain_exact(X)) == expected


def test_words_drop_stop_words_and_short_ones(spark):
    assert sorted(one(spark, "Pagamento para ACME Ltda de Peças acme", text.words(X))) == ["acme", "pecas"]


@pytest.mark.parametrize("value,expected", [("Razão Social", "RAZAOSOCIAL"), ("Dcto. Nº", "DCTON"), ("", "")])
def test_fold(spark, value, expected):
    assert one(spark, value, text.fold(X)) == expected
    assert one(spark, value, text.fold_exact(X)) == expected


@pytest.mark.parametrize("value,expected", [(" a\xa0 b\xad ", "a b-"), ("  ", None), (None, None), ("DescriÃ§Ã£o", "Descrição"), ("SÃO", "SÃO")])
def test_clean(spark, value, expected):
    assert one(spark, value, text.clean(X)) == expected


@pytest.mark.parametrize(
    "value,expected",
    [
        ("NF 123 de 01/02/2024 R$ 1.234,56", "nf numero de data valor"),
        ("CNPJ 12.345.678/0001-90 comp 01/2024", "cnpj documento_fiscal comp competencia"),
        ("id 98765 x 12", "id numero x 12"),
        (None, ""),
    ],
)
def test_normalized_masks_in_order(spark, value, expected):
    assert one(spark, value, text.normalized(X)) == expected


def test_local_features_omit_missing_and_zero_amounts(spark):
    f = lambda a: one(spark, "Acme", text.local_features(X, F.lit("inflow"), F.lit("7"), F.lit(a).cast("decimal(18,2)")))
    assert f("50") == "direcao_inflow banco_7 valor_5000 ordem_2 acme"
    assert f("0") == f(None) == "direcao_inflow banco_7 acme"


@pytest.mark.parametrize(
    "value,expected",
    [("2024-02-03", datetime.date(2024, 2, 3)), ("2024-02-03T10:20:30", datetime.date(2024, 2, 3)), ("1/2/2026", datetime.date(2026, 2, 1)), ("31/02/2024", None), ("x", None), (None, None)],
)
def test_parse_date(spark, value, expected):
    assert one(spark, value, money.parse_date(X)) == expected


def test_parse_row_date_takes_the_year_of_the_period(spark):
    f = lambda v: one(spark, v, money.parse_row_date(X, F.to_date(F.lit("2025-01-01")), F.to_date(F.lit("2025-01-31"))))
    assert f("31/12") == datetime.date(2024, 12, 31)
    assert f("15/01") == datetime.date(2025, 1, 15)
    assert f("15/06") is None


@pytest.mark.parametrize("value,expected", [("R$ 1.234,56", D("1234.56")), ("-7,5", D("-7.50")), ("12.5", D("12.50")), ("abc", None), ("", None), (None, None), ("1.234.567,89 C", D("1234567.89"))])
def test_parse_money(spark, value, expected):
    assert one(spark, value, money.parse_money(X)) == expected


@pytest.mark.parametrize("value,expected", [("1,234.56", D("1234.56")), ("1.234,56", D("1234.56")), ("0,125", D("0.12")), ("x", None)])
def test_parse_mixed_rounds_half_to_even(spark, value, expected):
    assert one(spark, value, money.parse_mixed(X)) == expected


def test_rates_and_exact_decimals(spark):
    assert one(spark, "2,50 %", money.parse_printed(X)) == D("2.5")
    assert one(spark, "1.23456", money.exact_decimal(X)) == D("1.23456")
    assert one(spark, "NaN", money.exact_decimal(X)) is None


def test_amounts(spark):
    row = spark.createDataFrame([(None, D("5.00"), D("2.00")), (D("9.00"), D("5.00"), None), (None, None, None)], "a decimal(18,2), c decimal(18,2), d decimal(18,2)")
    assert [r[0] for r in row.select(money.amount_of(F.col("a"), F.col("c"), F.col("d"))).collect()] == [D("3.00"), D("9.00"), None]
    assert [r[0] for r in row.select(money.amount_credit_first(F.col("c"), F.col("d"))).collect()] == [D("5.00"), D("5.00"), None]


def test_periods(spark):
    assert one(spark, "2024-12", money.next_period(X)) == "2025-01"
    assert one(spark, "2024-1", money.is_period(X)) is False


@pytest.mark.parametrize("value,cnpj,cpf", [("11222333000181", True, False), ("11222333000182", False, False), ("52998224725", False, True), ("11111111111", False, False), ("", False, False), (None, False, False)])
def test_tax_id_digits(spark, value, cnpj, cpf):
    assert one(spark, value, money.valid_cnpj(X)) is cnpj
    assert one(spark, value, money.valid_cpf(X)) is cpf


def test_invoice_key_digit(spark):
    digits = "1234567" + "1" + "2" + "11222333000181" + "0000000000042" + "2401" + "123456789"
    assert len(digits) == 49
    total = sum(int(c) * (2 + i % 8) for i, c in enumerate(reversed(digits))) % 11
    check = 0 if total < 2 else 11 - total
    assert one(spark, digits + str(check), money.valid_key(X)) is True
    assert one(spark, digits + str((check + 1) % 10), money.valid_key(X)) is False


@pytest.mark.parametrize(
    "value,expected",
    [
        ("Pago 12.345.678/0001-90", "12.345.678/0001-90"), ("CPF: 52998224725", "529.982.247-25"), ("CNPJ12345678000190", "12.345.678/0001-90"), ("x 12345678000190", "12.345.678/0001-90"),
        ("11144477735", "111.444.777-35"), ("52998224725", None), ("(11) 91234-5678", None), ("nothing", None), (None, None),
    ],
)
def test_extract_tax_id(spark, value, expected):
    assert one(spark, value, identity.extract_tax_id(X)) == expected


@pytest.mark.parametrize(
    "value,expected",
    [("PIX ENVIADO 12345", ("PIX ENVIADO", "12345")), ("BOLETO 2024", ("BOLETO 2024", None)), ("Compra NF 123", ("Compra", "123")), ("LOJA 12345", ("LOJA 12345", None)), (None, (None, None))],
)
def test_split_document(spark, value, expected):
    assert tuple(one(spark, value, identity.split_document(X))) == expected


@pytest.mark.parametrize("value,expected", [("REMET. ACME", "ACME"), ("Padaria Ltda", "Padaria Ltda"), ("PIX ENVIADO", None), ("12.345.678/0001-90", None), ("texto livre", None), (None, None)])
def test_party(spark, value, expected):
    assert one(spark, value, identity.party_of(X)) == expected


def test_strip_tax_id(spark):
    assert one(spark, "ACME 529.982.247-25 x 52998224725", identity.strip_tax_id(X, F.lit("529.982.247-25"))) == "ACME x"


def test_printed_pairs(spark):
    assert tuple(one(spark, "São Paulo / SP", identity.city_state(X))) == ("São Paulo", "SP")
    assert tuple(one(spark, "3550308 / 01000-000", identity.code_postal(X))) == ("3550308", "01000000")


def test_compound_and_transfer(spark):
    assert one(spark, "ICMS e IPI", b.is_compound(X)) and not one(spark, "ICMS e ICMS", b.is_compound(X))
    assert one(spark, "Transferência", b.is_transfer(X)) and one(spark, "resgate CDB", b.is_transfer(X)) and not one(spark, "CDB", b.is_transfer(X))


@pytest.mark.parametrize(
    "value,direction,expected",
    [("Rendimento", "inflow", "rendimento"), ("Rendimento", "outflow", None), ("Tarifa", "outflow", "despesa_bancaria"), ("capitalização", "inflow", "capitalizacao"), ("guia FGTS", "outflow", "tributo:fgts"), ("FGTS INSS", "outflow", None)],
)
def test_rules(spark, value, direction, expected):
    assert one(spark, value, b.rule_of(X, F.lit(direction))) == expected


@pytest.mark.parametrize(
    "row,expected",
    [
        (("00015-AIRLIQUIDEBRASILLTDA-PAULINIA", "PIX ENVIADO", "0000355193", -1), "PAGAMENTO PIX - AIRLIQUIDEBRASILLTDA-PAULINIA - DOC 0000355193"),
        (("ACME", "PIX RECEBIDO", "123", 50), "RECEBIMENTO PIX - ACME - DOC 123"),
        ((None, "Tarifa bancaria mensal", None, -5), "TARIFA BANCARIA - MENSAL"),
        ((None, "pagamento", None, -5), "PAGAMENTO"),
        (("Acme", "Transferência", None, 5), "TRANSFERENCIA ENTRE CONTAS - ACME - TRANSFERÊNCIA"),
    ],
)
def test_history_complement(spark, row, expected):
    df = spark.createDataFrame([row], "c string, n string, d string, a int")
    assert df.select(b.history_complement(F.col("c"), F.col("n"), F.col("d"), F.col("a"))).first()[0] == expected


def test_complement_default(spark):
    assert one(spark, None, b.complement(X, X, X)) == "Movimento bancario"


def test_fiscal_rules(spark):
    schema = "g decimal(18,2), b decimal(18,2), r decimal(18,2), i decimal(18,2), n decimal(18,2)"
    rows = [(D("100"), D("100"), D("2"), D("2.00"), D("98")), (D("-1"), None, None, None, None), (D("1"), None, None, None, D("2")), (D("100"), D("100"), D("2"), D("2.02"), D("90"))]
    df = spark.createDataFrame(rows, schema)
    found = [r[0] for r in df.select(money.fiscal_issue(*[F.col(c) for c in "gbrin"])).collect()]
    assert found == [None, "negative_fiscal_value", "inconsistent_totals", "inconsistent_iss_total"]


def test_plain_equals_the_exact_function(spark):
    import sys
    import unicodedata

    given = [chr(c) for c in range(1, sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co") and c < 0x20000]
    rows = [(i, "a " + "".join(given[i : i + 50]) + " Z\x1c\x1dq") for i in range(0, len(given), 50)] + [(-1, None), (-2, ""), (-3, "Nº 5 1ª parcela a\u00a0b ﬁm ＡＢ")]
    df = spark.createDataFrame(rows, "i int, t string").select("i", "t", text.plain(F.col("t")).alias("p"))
    for r in df.collect():
        assert r.p == " ".join(unicodedata.normalize("NFKD", r.t or "").encode("ascii", "ignore").decode().lower().split()), r.i
    assert {r.i: r.p for r in df.where("i = -3").collect()} == {-3: "no 5 1a parcela a b fim ab"}

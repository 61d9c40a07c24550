import os

import pytest

from tallyforge.plans import catalogue, catalogue_forms, catalogue_models, catalogue_more  # noqa: F401
from tests.helpers import assert_same, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, con, name):
    assert_same(catalogue.QUERIES[name](spark, FOLDER), catalogue.SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_similarity_equals_a_loop(spark):
    from difflib import SequenceMatcher

    asked, history, financial = catalogue._best_inputs(spark, FOLDER)
    found = {r.ord: (r.counterpart, round(r.score, 9)) for r in catalogue.QUERIES["similarity_match"](spark, FOLDER).collect()}
    words = lambda t: {w for w in t.lower().split() if len(w) > 2}
    rows = sorted(history.collect(), key=lambda r: r.ord)
    money = {r[0] for r in financial.collect()}
    for a in asked.collect()[:60]:
        side, other = ("debit_account", "credit_account") if a.direction == "inflow" else ("credit_account", "debit_account")
        pool = [r for r in rows if r[side] == a.financial_account] or [r for r in rows if r[side] in money]
        best = None
        for r in pool:
            x, y = words(a.text), words(r.complement)
            s = 0.75 * len(x & y) / min(len(x), len(y)) + 0.25 * SequenceMatcher(None, " ".join(sorted(x)), " ".join(sorted(y))).ratio()
            if best is None or s > best[1] + 1e-12:
                best = (r[other], s)
        expected = (best[0], round(best[1], 9)) if best and best[1] >= 0.5 else None
        assert found.get(a.ord) == expected


@pytest.mark.parametrize("name", ["best_history_match", "similarity_match"])
def test_best_history_takes_whole_tables(spark, con, name):
    from difflib import SequenceMatcher

    words = lambda t: {w for w in t.lower().split() if len(w) > 2}
    asked = con.execute("SELECT o_orderkey, p_name || ' ' || p_type FROM orders JOIN part ON o_orderkey % 500 = p_partkey ORDER BY 1").fetchall()
    history = con.execute(f"WITH {catalogue.v.HISTORY} SELECT debit_account, credit_account, complement FROM history ORDER BY ord").fetchall()
    history = [(a, b, words(c)) for a, b, c in history]
    found = {r.ord: (r.counterpart, round(r.score, 9)) for r in catalogue.QUERIES[name](spark, FOLDER).collect()}
    assert any(i % 7 for i in found) and set(found) <= {i for i, _ in asked}
    for i, text in asked[::9]:
        side = i % 2
        pool = [r for r in history if r[side] == str(i % 60)] or [r for r in history if r[side] in ("1", "2", "3")]
        best, x = None, words(text)
        for r in pool:
            s = len(x & r[2]) / min(len(x), len(r[2]))
            if name == "similarity_match":
                s = 0.75 * s + 0.25 * SequenceMatcher(None, " ".join(sorted(x)), " ".join(sorted(r[2]))).ratio() if s >= 1 / 3 else 0.0
            if best is None or s > best[1] + 1e-12:
                best = (r[1 - side], s)
        assert found.get(i) == ((best[0], round(best[1], 9)) if best and best[1] >= 0.5 else None)


def test_flagship_uses_the_whole_history(spark, monkeypatch):
    from collections import Counter
    from decimal import ROUND_HALF_EVEN, Decimal
    from difflib import SequenceMatcher

    from tallyforge.functions.text import words
    from tallyforge.operators import accounts as acc
    from tallyforge.plans import engine

    v, period, F = catalogue.v, catalogue.PERIOD, catalogue.F
    # texts like the movements': those of the test tables are too unlike
    texts = F.array(*[F.lit(t) for t in ("customer urgent", "customer high priority", "medium", "something else", "not specified low")])
    plain = v.history
    monkeypatch.setattr(v, "history", lambda spark, d: plain(spark, d).withColumn("complement", F.element_at(texts, (F.xxhash64("ord") % 5 + 5).cast("int") % 5 + 1)))
    chart = v.chart(spark, FOLDER)
    moved = v.mirrored(spark, FOLDER).withColumn("document", F.lit(None).cast("string"))
    _, rest = engine.transfers(engine.with_text(engine.of_period(moved.withColumns({"id": F.col("ord").cast("string"), "financial_name": F.lit("x"), "source_row": F.lit(1)}), period)))
    rest = rest.select("direction", "financial_account", words(F.col("text")).alias("w")).collect()
    usable = acc.usable_history(v.history(spark, FOLDER), chart, period).select("ord", "debit_account", "credit_account", words(F.col("complement")).alias("w")).collect()
    money = {r.reduced_code for r in acc.financial_accounts(chart).collect()}
    expected = Counter()
    for m in rest:
        side = "debit_account" if m.direction == "inflow" else "credit_account"
        x, best = set(m.w), 0.0
        for r in [r for r in usable if r[side] == m.financial_account] or [r for r in usable if r[side] in money]:
            y = set(r.w)
            if x & y and 0.75 * (c := len(x & y) / min(len(x), len(y))) + 0.25 >= 0.5:
                best = max(best, 0.75 * c + 0.25 * SequenceMatcher(None, " ".join(sorted(x)), " ".join(sorted(y))).ratio())
        reason = "historico_textual:%s" % Decimal(repr(best)).quantize(Decimal("0.01"), ROUND_HALF_EVEN) if best >= 0.5 else "padrao_por_direcao"
        expected[("LANCAR" if best >= 0.5 else "REVISAR CONTA", reason)] += 1
    found = Counter()
    for r in catalogue.QUERIES[catalogue.FLAGSHIP](spark, FOLDER).collect():
        found[r.status, r.reason.split("|")[0]] += r.entries
    assert {k: n for k, n in found.items() if k[1] != "transferencia_espelhada"} == expected
    assert any(k[1].startswith("historico_textual") for k in found)


def test_company_ids_of_large_keys(spark, tmp_path):
    spark.createDataFrame([(5,), (99_999_999,), (100_000_000,), (120_000_000,), (9_000_000_000,)], "o_orderkey long").toPandas().to_parquet(tmp_path / "orders.parquet")
    got = catalogue.QUERIES["company_ids"](spark, str(tmp_path))
    assert got.count() == 5
    assert_same(got, catalogue.SQL["company_ids"], connect(str(tmp_path)))


def test_classifier_metrics_are_of_the_operators_own_width(spark, monkeypatch):
    import inspect

    widths, plain = [], catalogue.models.classifier
    monkeypatch.setattr(catalogue.models, "classifier", lambda features: widths.append(features) or plain(features))
    assert catalogue.QUERIES["classifier_metrics"](spark, FOLDER).count() > 0
    assert widths == [inspect.signature(catalogue.models.fit).parameters["features"].default]

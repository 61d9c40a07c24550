"""Versions of stored rows, compaction, and imports that read what has changed."""

import os

from pyspark.sql import functions as F

from tallyforge.operators import layout
from tallyforge.sources.stores import KeyStore, imported


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_the_newest_version_of_a_key_wins(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "store"), ["k"])
    assert store.latest() is None
    made = lambda rows: spark.createDataFrame(rows, "k string, v int")
    store.append(made([("a", 1), ("a", 2), ("b", 3), (None, 4)]))
    store.append(made([("a", 5), ("c", 6), (None, 7)]))
    now = [("a", 5), ("b", 3), ("c", 6), (None, 7)]
    assert rows_of(store.latest().select("k", "v")) == sorted(now, key=str)
    store.compact()
    assert rows_of(store.latest().select("k", "v")) == sorted(now, key=str)
    store.append(made([("b", 8)]))
    store.vacuum()
    assert rows_of(store.latest().select("k", "v")) == sorted([("a", 5), ("b", 8), ("c", 6), (None, 7)], key=str)
    assert sorted(os.listdir(tmp_path / "store")) == ["generation=1"]


def test_a_version_that_was_not_finished_does_not_count(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "store"), ["k"])
    store.append(spark.createDataFrame([("a", 1)], "k string, v int"))
    store.append(spark.createDataFrame([("a", 2)], "k string, v int"))
    os.remove(tmp_path / "store" / "generation=0" / "version=2" / "_SUCCESS")
    assert rows_of(store.latest()) == [("a", 1)]
    store.append(spark.createDataFrame([("a", 3)], "k string, v int"))
    assert rows_of(store.latest()) == [("a", 3)]


def test_recipes_are_stored_and_come_back(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "recipes"), ["id", "headers"])
    seeds = layout.recipe_table(spark)
    store.append(seeds.where("ord = 0").withColumn("bank", F.lit("Outro")))
    store.append(seeds.where("ord = 1").withColumns({"id": F.lit("mine-v1"), "ord": F.lit(90)}))
    every = layout.catalog(seeds, store.latest().select(*seeds.columns))
    assert every.count() == seeds.count() + 1 and every.where("bank = 'Outro'").count() == 1
    asked = spark.createDataFrame([("d", ["DATA", "LANCAMENTO", "RAZAOSOCIAL", "CPFCNPJ", "VALOR", "SALDO"])], "doc string, titles array<string>")
    assert layout.best_recipe(asked, every).first().recipe == "itau-spreadsheet-bank-statement-v1"


def test_only_changed_clients_are_read(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "dataset"), ["client_id"])
    asked = []

    def read(part):
        clients = sorted((r.client_id, r.sha256) for r in part.collect())
        asked.append(clients)
        return spark.createDataFrame([(c, f"row of {c} {h}") for c, h in clients if c != "empty"], "client_id string, text string")

    manifest = lambda rows: spark.createDataFrame(rows, "client_id string, sha256 string")
    first = [("a", "1"), ("a", "2"), ("b", "3"), ("empty", "9")]
    expected = [("a", "row of a 1"), ("a", "row of a 2"), ("b", "row of b 3")]
    assert rows_of(imported(store, manifest(first), read)) == expected
    assert rows_of(imported(store, manifest(first[::-1]), read)) == expected
    assert asked == [sorted(first)]  # the second run reads nothing
    assert rows_of(imported(store, manifest([("a", "1"), ("a", "2"), ("b", "4"), ("c", "5")]), read)) == [*expected[:2], ("b", "row of b 4"), ("c", "row of c 5")]
    assert asked[1:] == [[("b", "4"), ("c", "5")]]
    store.compact()
    assert rows_of(imported(store, manifest([("b", "4")]), read)) == [("b", "row of b 4")] and len(asked) == 2
    assert imported(KeyStore(spark, str(tmp_path / "none"), ["client_id"]), manifest([]), read).count() == 0

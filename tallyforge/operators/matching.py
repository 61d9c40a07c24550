"""Matching of movements: mirrored transfers, best history row, multiset overlap, positional comparison, nearest rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import bounded_ratio, words
from tallyforge.lineage import cut, few, spread
from tallyforge.operators.ordering import numbered


def mirrored_pairs(events: DataFrame) -> DataFrame:
    """Greedy pairing of transfers: rows (ord, date, amount, financial_account), already known to be transfers.

    In order, each event takes the first later one on its date with the opposite amount and another account.
    Pairs only form within (date, absolute amount), so partitions sorted by that and the order are scanned once;
    what is held are the events of one group that still wait. Returns left, right (the ords).
    """
    rows = events.where("financial_account is not null and amount <> 0").select("date", F.abs("amount").alias("size"), (F.col("amount") > 0).alias("inflow"), F.col("financial_account").cast("string").alias("account"), F.col("ord").cast("long").alias("ord"))
    rows = rows.withColumn("size", F.col("size").cast("string")).repartition("date", "size").sortWithinPartitions("date", "size", "ord")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: object = None
        waiting: dict[bool, dict[str, deque[int]]] = {}
        for batch in batches:
            out = []
            for date, size, inflow, account, at in batch.itertuples(index=False):
                if (date, size) != group:
                    group, waiting = (date, size), {True: {}, False: {}}
                others = waiting[not inflow]
                # the longest waiting event of another account: the head of each account's queue is its longest waiting
                partner = min(((q[0], a) for a, q in others.items() if a != account), default=None)
                if partner is None:
                    waiting[inflow].setdefault(account, deque()).append(at)
                    continue
                others[partner[1]].popleft()
                if not others[partner[1]]:
                    del others[partner[1]]
                out.append((partner[0], at))
            if out:
                yield pd.DataFrame(out, columns=["left", "right"])

    return rows.mapInPandas(run, "left long, right long")


#: Movements with one word that one task gets at most in the candidate search; a word of more is split.
HOT_WORD = 20_000


def needed(size: Column, least: float, with_sequence: bool) -> Column:
    """How many words of the smaller set must be shared for a score of ``least``.

    With the sequence ratio, which is below 1 unless the sets are equal: the least whole number above size * (4 least - 1) / 3.
    """
    if with_sequence:
        return F.least(size, F.floor(size * (4 * least - 1) / 3).cast("int") + 1)
    return F.greatest(F.lit(1), F.ceil(size * least).cast("int"))


def containment_candidates(texts: DataFrame, rows: DataFrame, key: list[str], least: float = 0.5, with_sequence: bool = True, hot: int = HOT_WORD) -> DataFrame:
    """Pairs (key, m_line, h_line, h_ord, h) of texts of a key whose word sets may reach the score; ``texts`` (key, line), ``rows`` (key, line, h_ord, h), lines being distinct words joined by spaces.

    Of the smaller set so many words must be in the larger one that one of its rarest ``size - needed + 1`` is: only these are joined with all
    words of the other side, so a word that is common there is only joined where a set is too small to do without. What is rare is counted on
    the other side. Words of many movements are split, and the other side's rows with them are repeated for each part.
    """
    on = [*key, "word"]
    words_of = F.split("line", " ")
    columns = [*key, "line", "h_ord", "h", F.size(words_of).alias("size"), F.explode(words_of).alias("word")]
    tokens = texts.select(*key, "line", F.lit(None).cast(rows.schema["h_ord"].dataType).alias("h_ord"), F.lit(None).cast(rows.schema["h"].dataType).alias("h")).select(*columns).unionByName(rows.select(*columns))
    # only words of both sides can meet
    counts = tokens.groupBy(*on).agg(F.count_if(F.col("h_ord").isNull()).alias("in_m"), F.count("h_ord").alias("in_h")).where("in_m > 0 and in_h > 0").withColumn("parts", F.ceil(F.col("in_m") / hot).cast("int"))
    other = F.when(F.col("h_ord").isNull(), F.col("in_h")).otherwise(F.col("in_m"))
    # the words of a set from the rarest on the other side; those that meet nothing come first
    met = tokens.join(counts, on, "left").groupBy(*key, "line", "h_ord", "size").agg(F.first("h").alias("h"), F.array_sort(F.collect_list(F.struct(F.coalesce(other, F.lit(0)).alias("n"), "word", "parts"))).alias("ranked"))
    # read four times below
    met = cut(met.where(F.get("ranked", F.col("size") - 1)["n"] > 0))
    met = met.select(*key, "line", "h_ord", "h", "size", F.posexplode("ranked").alias("place", "t")).where("t.n > 0").select(*key, "line", "h_ord", "h", "size", "t.word", "t.parts", (F.col("place") <= F.col("size") - needed(F.col("size"), least, with_sequence)).alias("first"))
    m = met.where("h_ord is null").select(*on, F.pmod(F.xxhash64("line"), F.col("parts")).cast("int").alias("part"), F.col("line").alias("m_line"), F.col("size").alias("m_size"), F.col("first").alias("m_first"))
    h = met.where("h_ord is not null").select(*on, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("line").alias("h_line"), "h_ord", "h", F.col("size").alias("h_size"), F.col("first").alias("h_first"))
    found = [*key, "m_line", "h_line", "h_ord", "h"]
    small_m = m.where("m_first").join(h, [*on, "part"]).where("h_size >= m_size").select(*found)
    small_h = h.where("h_first").join(m, [*on, "part"]).where("m_size > h_size").select(*found)
    return small_m.unionByName(small_h).distinct()


def best_history(movements: DataFrame, history: DataFrame, financial: DataFrame, with_sequence: bool = True, least: float = 0.5) -> DataFrame:
    """For each movement (ord, direction, financial_account, text) its best history row of the same side.

    The pool are the history rows with the movement's own account on its side, and only where there is none
    those with any financial account there. The score is three quarters word containment and one quarter
    sequence ratio; candidates come from a prefix-filtered join on words, and the ratio runs only on pairs for which the lines' common letters
    let it reach the threshold. Returns ord, counterpart, standard_history, score; the first row of equal scores.
    """
    line = lambda text: F.array_join(F.array_sort(words(text)), " ").alias("line")
    sided = lambda entries: entries.select(
        F.col("ord").alias("h_ord"), "standard_history", "complement",
        F.inline(F.array(
            F.struct(F.lit("inflow").alias("direction"), F.col("debit_account").alias("account"), F.col("credit_account").alias("counterpart")),
            F.struct(F.lit("outflow").alias("direction"), F.col("credit_account").alias("account"), F.col("debit_account").alias("counterpart")),
        )),
    )
    # of equal texts of a side the first row stands for all; a text's words are made as often as texts differ, not as often as they occur
    firsts = cut(sided(history).groupBy("direction", "account", "complement").agg(F.min("h_ord").alias("h_ord")))
    # the pool is chosen before scoring: rows without words count for it as well
    own = firsts.select("direction", "account", F.lit(True).alias("_own")).distinct()
    asked = movements.where("financial_account is not null").select("ord", "direction", F.col("financial_account").alias("account"), "text")
    # cut, as a condition on what is made of them would move to where the texts are not distinct yet
    every = cut(spread(asked.select("direction", "account", "text").distinct())).withColumn("m_line", line(F.col("text"))).where("m_line <> ''").join(own, ["direction", "account"], "left")
    every = cut(every.select("direction", "account", "text", F.when(F.col("_own"), F.concat(F.lit("="), "account")).otherwise("*").alias("pool"), "m_line"))
    money = financial.select(F.col("reduced_code").alias("account"), F.lit(True).alias("_money")).distinct()
    pools = F.filter(F.array(F.concat(F.lit("="), "account"), F.when(F.col("_money"), F.lit("*"))), lambda p: p.isNotNull())
    # equal words of one pool score alike: the first row stands for them
    texts = spread(firsts.select("complement").distinct()).select("complement", line(F.col("complement"))).where("line <> ''")
    leading = firsts.join(texts, "complement").join(money, "account", "left").withColumn("pool", F.explode(pools)).groupBy("direction", "pool", "line").agg(F.min("h_ord").alias("h_ord"))
    rows = few(firsts.join(texts, "complement").join(money, "account", "left").withColumn("pool", F.explode(pools)).join(leading, ["direction", "pool", "line", "h_ord"]).select("direction", "account", "complement", "h_ord", "pool", "line"))
    # few of the history's rows are first of their text: the others go before they have sides
    rows = sided(history.join(rows.withColumnRenamed("h_ord", "ord"), "ord", "left_semi")).join(rows, ["direction", "account", "complement", "h_ord"]).groupBy("direction", "pool", "line").agg(F.min_by(F.struct("counterpart", "standard_history"), "h_ord").alias("h"), F.min("h_ord").alias("h_ord"))
    # and movements of one pool with equal words have the same best row: each text is matched once
    key = ["direction", "pool"]
    pairs = containment_candidates(every.select(*key, F.col("m_line").alias("line")).distinct(), rows, key, least, with_sequence)
    a, b = F.split("m_line", " "), F.split("h_line", " ")
    pairs = pairs.withColumn("contained", F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))
    if with_sequence:
        pairs = pairs.where(F.col("contained") * 0.75 + 0.25 >= least).withColumn("score", F.col("contained") * 0.75 + bounded_ratio("m_line", "h_line", (F.lit(least) - F.col("contained") * 0.75) / 0.25) * 0.25)
    else:
        pairs = pairs.withColumn("score", F.col("contained"))
    best = pairs.where(F.col("score") >= least).groupBy(*key, "m_line").agg(F.max_by(F.struct("h.counterpart", "h.standard_history", "score"), F.struct("score", -F.col("h_ord"))).alias("b"))
    told = few(every.join(best, [*key, "m_line"]).select("direction", "account", "text", "b"))
    return asked.join(told, ["direction", "account", "text"]).select("ord", "b.counterpart", "b.standard_history", "b.score")


def overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str, on: tuple[str, ...] = ("date", "amount")) -> DataFrame:
    """Size of the multiset intersection of each pair of groups, by counts of equal rows."""
    a = left.groupBy(left_key, *on).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(right_key, *on).agg(F.count(F.lit(1)).alias("_b"))
    return a.join(b, list(on)).groupBy(left_key, right_key).agg(F.sum(F.least("_a", "_b")).alias("overlap"))


def ledger_accounts(ledgers: DataFrame, overlaps: DataFrame) -> DataFrame:
    """ledger, statement: which statement each ledger is; ledgers (ledger, entries), overlaps (ledger, statement, overlap).

    The largest ledger chooses first, of equal ones the first by its id; each takes, of the statements that are left, the one with the largest overlap (of
    equal ones the first), if that holds half of its entries. A round settles all pairs that are each other's first: the ledger's best
    statement that is left, and of all ledgers that could take this statement the one that chooses first. Rounds go on until no pair is left; in each,
    the first of the ledgers that are left is settled at least.
    """
    least = F.greatest(F.lit(1), F.floor(F.col("entries") / 2))
    open_ = cut(overlaps.join(ledgers.where("entries is not null"), "ledger").where(F.col("overlap") >= least).select("ledger", "statement", "overlap", "entries"))
    settled = open_.select("ledger", "statement").where(F.lit(False))
    while not open_.isEmpty():
        of_ledger = open_.groupBy("ledger").agg(F.min_by("statement", F.struct(-F.col("overlap"), F.col("statement"))).alias("statement"))
        of_statement = open_.groupBy("statement").agg(F.min_by("ledger", F.struct(-F.col("entries"), F.col("ledger"))).alias("ledger"))
        found = cut(of_ledger.join(of_statement, ["ledger", "statement"]))
        settled = settled.unionByName(found)
        open_ = cut(open_.join(found.select("ledger"), "ledger", "left_anti").join(found.select("statement"), "statement", "left_anti").select("ledger", "statement", "overlap", "entries"))
    return settled


def account_by_words(names: DataFrame, accounts: DataFrame, active: DataFrame) -> DataFrame:
    """name -> the account whose description shares most words with it, then the more active, then the shorter description; none without a shared word."""
    own = accounts.join(active, "reduced_code", "left").select("reduced_code", "ord", F.coalesce("activity", F.lit(0)).alias("_activity"), F.length("description").alias("_length"), F.explode(words(F.col("description"))).alias("word"))
    asked = names.select("name", F.explode(words(F.col("name"))).alias("word"))
    shared = asked.join(own, "word").groupBy("name", "reduced_code", "ord", "_activity", "_length").agg(F.count(F.lit(1)).alias("_shared"))
    return shared.groupBy("name").agg(F.max_by("reduced_code", F.struct("_shared", "_activity", -F.col("_length"), -F.col("ord"))).alias("reduced_code"))


def compared(left: DataFrame, right: DataFrame, fields: list[str], key: list[str]) -> DataFrame:
    """Positional comparison: rows of equal ordinal, a row for each field that differs (nulls are values). Without a key each side is one sequence."""
    at = lambda df: df.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy("ord"))) if key else numbered(df, ["ord"], "position")
    a = at(left).select(*key, "position", F.struct(*fields).alias("_a"))
    b = at(right).select(*key, "position", F.struct(*fields).alias("_b"))
    both = a.join(b, [*key, "position"])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_a.{f}").cast("string").alias("left_value"), F.col(f"_b.{f}").cast("string").alias("right_value")) for f in fields])
    return both.select(*key, "position", F.inline(pairs)).where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def count_mismatch(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    a = left.groupBy(*key).agg(F.count(F.lit(1)).alias("left_count"))
    b = right.groupBy(*key).agg(F.count(F.lit(1)).alias("right_count"))
    both = (a.join(b, key, "full") if key else a.crossJoin(b)).select(*key, F.coalesce("left_count", F.lit(0)).alias("left_count"), F.coalesce("right_count", F.lit(0)).alias("right_count"))
    return both.where("left_count <> right_count")


def nearest(points: DataFrame, rows: DataFrame, page: list[str], at: str = "top", above: float = 8.0, below: float = 20.0) -> DataFrame:
    """Fragments (id, page, top) to the nearest row (ord, page, top) of their page, ties to the first.

    Only fragments from ``above`` before the page's first row to ``below`` after its last attach; pages are small.
    """
    span = rows.groupBy(*page).agg((F.min(at) - above).alias("_low"), (F.max(at) + below).alias("_high"))
    inside = points.join(span, page).where(F.col(at).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")
    pairs = inside.join(rows.select(*page, F.col("ord").alias("row_ord"), F.col(at).alias("_row_at")), page)
    return pairs.groupBy(*page, "id").agg(F.min_by("row_ord", F.struct(F.abs(F.col(at) - F.col("_row_at")), "row_ord")).alias("row_ord"))


def without_page_repeats(rows: DataFrame, top: float = 5.0) -> DataFrame:
    """Drops rows at the top of a page that repeat one of the page before: same date and amount, and a text that ends alike."""
    before = rows.select((F.col("page") + 1).alias("_page"), F.col("doc").alias("_doc"), F.col("date").alias("_date"), F.col("amount").alias("_amount"), F.col("text").alias("_text"), F.col("top").alias("_top"))
    repeat = (
        (F.col("doc") == F.col("_doc")) & (F.col("page") == F.col("_page")) & F.col("date").eqNullSafe(F.col("_date")) & (F.col("amount") == F.col("_amount"))
        & (F.col("top") <= top) & F.endswith("_text", "text")
    )
    return rows.join(before, repeat, "left_anti")


def without_balance(transactions: DataFrame, balances: DataFrame, key: str) -> DataFrame:
    """The first transaction of each statement on a date without a daily balance."""
    missing = transactions.join(balances.select(key, "date").distinct(), [key, "date"], "left_anti")
    return missing.groupBy(key).agg(F.min_by("date", "ord").alias("date"), F.min("ord").alias("ord"))


def assigned_account(ledger_account: Column, by_words: Column, by_overlap: Column) -> Column:
    """A ledger's account: by its printed name's words, else by its statement."""
    return F.when(ledger_account.isNotNull(), by_words).otherwise(F.coalesce(by_words, by_overlap))

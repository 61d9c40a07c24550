"""Toxicity by weak supervision.

1. Voters. A lexicon written down from general usage, a voter a word. Words and word beginnings that a bounded sample of labelled
   rows associates with toxic texts: in a language the lexicon does not reach nothing else tells them. Patterns (shouting, runs of
   exclamation marks, masked words, a hit near an address, several hits, no hit at all).
2. A generative label model estimates by expectation-maximisation, from the votes and the classes' shares alone, how often
   each voter votes and how accurate it is, and, from the covariances that remain given the latent label, which voters repeat each
   other; correlated voters share their weight. It yields a posterior label for each sampled text.
3. A linear classifier is trained on these labels, over the voters' words, "any word of the lexicon" and those word and
   word-beginning features that tell the posterior labels apart.
4. The classifier's slope and bias are calibrated on the sampled labels, weighted to the classes' shares
   among all labels that may be learned from.
5. Every whole text is scored by the classifier.

Labels come only from rows whose crc32(doc_id as text) mod ``FOLDS`` is not 0. Ids, languages, sources and
labels are no inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import CACHE_WORDS, arrow_map, let_go, table, texts_of, written

FOLDS = 5
#: The bounded sample that the voters' model and the classifier are fitted on: rows of each class.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 6_000
#: The least log-likelihood ratio of a learned voter, of tens of thousands of features that are looked at.
EVIDENCE = 16.0
#: What a weight loses to zero at each step, per unit of it.
PENALTY = 2e-4
# Common insults, slurs on a person's mind, worth or looks, threats and swear words of English, French, German and Spanish, as
# any dictionary marks them; listed from general usage, in the order of the alphabet.
LEXICON = {
    "en": """ass asshole bastard bitch bloody bozo bullshit clown coward cretin crap creep cunt damn deadbeat despicable dickhead dimwit dirtbag disgrace disgusting douche dumb dumbass
        dunce dupe failure fake fathead filth filthy fool freak fuck fucking garbage goon greedy gross halfwit hate hideous hypocrite idiot idiotic ignorant imbecile incompetent jackass jerk
        kill liar loser lousy lowlife lunatic maggot moron moronic nasty nitwit oaf obnoxious pathetic pig prick psycho punk rat repulsive retard rotten scum scumbag shameful shit
        shut sicko sleaze slimy slob slut smug sucker sucks stupid swine terrible thug trash trashy twit ugly useless vermin vile weakling weirdo whiner whore wimp worthless wretched""",
    "fr": "abruti andouille bouffon connard connasse crétin débile dégoûtant idiote imbécile merde minable nul ordure pourri putain raclure salaud salope taré",
    "de": "arschloch blödmann depp dreckig dummkopf ekelhaft erbärmlich hurensohn idioten miststück nichtsnutz scheiße schlampe schwachkopf schwein trottel versager vollidiot wertlos widerlich",
    "es": "asqueroso basura bobo cabrón cerdo estúpido gilipollas idiotas imbécil inútil maldito mierda patético payaso perdedor puta tonto",
}
WORDS = tuple(sorted({w for words in LEXICON.values() for w in words.split()}))

_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_MASKED = re.compile(r"^[A-Za-z]{1,3}[*#@$%]{2,}[A-Za-z]{0,3}$")
_ADDRESS = frozenset({"you", "your", "you're", "youre", "ur", "tu", "toi", "vous", "du", "dich", "dir", "tú", "ti", "eres"})
#: Words on either side of an insult in which an address counts as near.
NEAR = 3


def bare(word: bytes) -> str:
    """A word as it stands in a text, lower-case and without signs and digits at its ends."""
    return _EDGE.sub("", word.decode("utf-8", "replace").lower())


def beginnings(n: int) -> Iterator[int]:
    """Lengths of the beginnings of a word of n letters that are features: from 4 one by one, beyond 10 ever fewer."""
    k = 4
    while k < n:
        yield k
        k += max(1, (k - 4) // 6)


#: The feature of every word of the lexicon and its plural: what the sample shows of some of them holds for the others.
LISTED = "#"
_LISTED = frozenset(w + end for w in WORDS for end in ("", "s"))


def features_of(word: bytes) -> list[str]:
    """Of a word as it stands in a text: the bare word after "=", its beginnings after "^", and whether the lexicon has it."""
    w = bare(word)
    return ["=" + w, *("^" + w[:n] for n in beginnings(len(w))), *([LISTED] if w in _LISTED else ())] if w else []


PATTERNS = 7


def seats_of(learned: Iterable[str]) -> dict[str, int]:
    """The voter's place of each feature: the lexicon's words and their plurals first, then learned features."""
    seats = {"=" + w + end: i for i, w in enumerate(WORDS) for end in ("s", "")}
    for f in learned:
        seats.setdefault(f, max(seats.values()) + 1)
    return seats


def votes_of(text: bytes, seats: dict[str, int]) -> tuple[list[int], list[int]]:
    """The places of the words' voters in a text, and the patterns' votes: 1 toxic, -1 clean, 0 none."""
    raw = text.split()
    n = max(1, len(raw))
    of = {w: places for w in set(raw) if (places := {seats[f] for f in features_of(w) if f in seats})}
    at = [i for i, w in enumerate(raw) if w in of] if of else []
    address = any(bare(w) in _ADDRESS for i in at for w in raw[max(0, i - NEAR) : i + NEAR + 1])
    patterns = [
        int(2 * sum(map(bytes.isupper, raw)) > n), int(b"!!" in text), int(any(_MASKED.match(w.decode("utf-8", "replace")) for w in set(raw) if b"*" in w or b"#" in w)),
        int(address), int(len(of) > 1), int(100 * len(at) > n), -int(not at),
    ]
    return sorted(set().union(*of.values())), patterns


def training_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the folds that may be learned from; a doc_id labelled twice is toxic if one label says so."""
    rows = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    return rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))


def sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> tuple[DataFrame, float]:
    """A bounded sample (text, _toxic), the labelled rows of each class with the smallest hashes of their ids, and the share of toxic rows among all that may be learned from.

    A text that is there with several labels is toxic if one says so.
    """
    rows = training_rows(labels)
    count = {r._toxic: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    n1, n0 = count.get(1, 0), count.get(0, 0)
    first = lambda y, n: rows.where(F.col("_toxic") == y).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(n)
    few = first(1, toxic).unionByName(first(0, clean))  # at most toxic + clean rows, so it is broadcast
    rows_of = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    one = rows_of.groupBy("doc_id").agg(F.min_by(F.struct("text", "_toxic"), F.struct(F.xxhash64("text"), "text")).alias("_one"))  # of several texts of one id one, chosen by hash
    picked = one.groupBy("_one.text").agg(F.max("_one._toxic").alias("_toxic"))
    return picked, n1 / max(1, n0 + n1)


def _ratio(toxic: Column, both: Column, n1: float, n0: float) -> Column:
    """Dunning's log-likelihood ratio of a feature that is in so many texts, so many of them toxic: the evidence that the two classes' rates differ at all."""
    total = n1 + n0
    part = lambda count, n, all_: F.when(count > 0, count * F.log(count * total / (n * all_))).otherwise(0.0)
    clean, absent = both - toxic, total - both
    return 2 * (part(toxic, F.lit(n1), both) + part(clean, F.lit(n0), both) + part(n1 - toxic, F.lit(n1), absent) + part(n0 - clean, F.lit(n0), absent))


#: Parts of a text that a posterior label is counted in, so that sums are of whole numbers and do not depend on their order.
PARTS = 1 << 20


def counted(picked: DataFrame, posterior: dict[int, float]) -> DataFrame:
    """feature, toxic, both: for each feature the texts it is in, and how much of them is toxic by the posterior labels (by row)."""
    held = picked.sparkSession.sparkContext.broadcast(posterior)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value
        toxic, both = Counter(), Counter()
        for batch in batches:
            for text, row in zip(texts_of(batch), batch.column("_row").to_pylist(), strict=True):
                found = {f for w in set(text.split()) for f in features_of(w)}
                share = round(of[row] * PARTS)
                both.update(found)
                if share:
                    toxic.update(dict.fromkeys(found, share))
        yield pa.RecordBatch.from_arrays([pa.array(list(both), pa.string()), pa.array([toxic[f] for f in both], pa.int64()), pa.array(list(both.values()), pa.int64())], names=["feature", "toxic", "both"])

    sums = arrow_map(picked, run, "feature string, toxic long, both long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("both").alias("both"))
    return sums.select("feature", (F.col("toxic") / PARTS).alias("toxic"), F.col("both").cast("double").alias("both"))


def telling(picked: DataFrame, posterior: dict[int, float], toxic_only: bool, evidence: float = EVIDENCE) -> list[str]:
    """The features with the evidence asked for, either way or of toxic texts alone (their rate four times that in clean ones). Only these come to the driver."""
    n1 = max(sum(posterior.values()), 1e-9)
    n0 = max(len(posterior) - n1, 1e-9)
    ok = _ratio(F.col("toxic"), F.col("both"), n1, n0) >= evidence
    if toxic_only:
        ok &= F.col("toxic") / n1 > 4 * (F.col("both") - F.col("toxic")) / n0
    return sorted(r.feature for r in counted(picked, posterior).where(ok).select("feature").collect())


class LabelModel:
    """Votes are 1 (toxic), -1 (clean) and 0 (abstains). Rows are texts, columns voters; the share of toxic texts is given."""

    def __init__(self, prior: float, rounds: int = 60, tolerance: float = 1e-5):
        self.prior, self.rounds, self.tolerance = min(max(prior, 0.01), 0.99), rounds, tolerance

    def fit(self, votes: np.ndarray) -> LabelModel:
        n, m = votes.shape
        cast = {k: np.nonzero(votes == k) for k in (1, -1)}  # almost all abstain, so the votes' places are held and no masks
        posterior = np.where(np.bincount(cast[1][0], minlength=n) > 0, 0.9, 0.1)
        self.weight = np.ones(m)
        # as if voters were independent at first: what the label makes them share shows as correlation until it is known
        for correlated in (False, True):
            if correlated:
                # of the likelier label: a share of the other would look like a correlation
                self.weight = self.shared(votes, posterior > 0.5)
            for _ in range(self.rounds):
                # P(vote | label) for the three votes, smoothed towards voters that are right more often than not
                rates = np.empty((2, 3, m))
                for y, p in ((1, posterior), (0, 1 - posterior)):
                    for k, vote in enumerate((1, -1)):
                        agree = 2.0 if (vote == 1) == (y == 1) else 0.5
                        rates[y, k] = np.bincount(cast[vote][1], p[cast[vote][0]], m) + agree * 0.5
                    rates[y, 2] = p.sum() + 0.5 * 2.5 - rates[y, 0] - rates[y, 1] + 0.25
                self.rates = rates / rates.sum(1, keepdims=True)
                before, posterior = posterior, self._posterior(cast, n)
                if np.abs(posterior - before).max() < self.tolerance:
                    break
        right = np.bincount(cast[1][1], posterior[cast[1][0]], m) + np.bincount(cast[-1][1], (1 - posterior)[cast[-1][0]], m)
        self.accuracy = (right + 1) / (np.bincount(cast[1][1], minlength=m) + np.bincount(cast[-1][1], minlength=m) + 2)
        return self

    def shared(self, votes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """A voter's weight: one over its sum of squared correlations with all voters, itself included, given the label."""
        m = votes.shape[1]
        self.correlation = np.zeros((m, m), np.float32)
        for own in (toxic, ~toxic):
            mean = votes[own].mean(0, dtype=np.float64) if own.any() else np.zeros(m)
            some = np.flatnonzero(own)
            for a in range(0, len(some), 1000):
                centred = (votes[some[a : a + 1000]] - mean).astype(np.float32)
                self.correlation += centred.T @ centred
        scale = np.sqrt(np.maximum(np.diag(self.correlation), 1e-9))
        self.correlation /= scale[:, None]
        self.correlation /= scale
        return 1 / np.maximum(1.0, np.einsum("ij,ij->i", self.correlation, self.correlation, dtype=np.float64))

    def _posterior(self, cast: dict[int, tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        ratio = np.log(self.rates[1]) - np.log(self.rates[0])
        # who abstains says nothing: with many narrow voters almost all abstain from any text
        score = np.log(self.prior / (1 - self.prior)) + sum(np.bincount(cast[vote][0], (ratio[k] * self.weight)[cast[vote][1]], n) for k, vote in enumerate((1, -1)))
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self._posterior({k: np.nonzero(votes == k) for k in (1, -1)}, len(votes))


def linear(rows: np.ndarray, columns: np.ndarray, n_features: int, y: np.ndarray, rounds: int = 120, rate: float = 0.5, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels: the texts' features are given as places (row, column) of ones. Gradient steps scaled
    per feature, each followed by a shrinking of the weights, which leaves most at exactly 0."""
    w, b = np.zeros(n_features), 0.0
    second_w, second_b = np.full(n_features, 1e-8), 1e-8
    n = len(y)
    for _ in range(rounds):
        z = np.bincount(rows, w[columns], n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        gw, gb = np.bincount(columns, g[rows], n_features), g.sum()
        second_w += gw**2
        second_b += gb**2
        step = rate / np.sqrt(second_w)
        w = w - step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b -= rate * gb / np.sqrt(second_b)
    return w, float(b)


def calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logits: the shift for which the weighted F1 at 0.5 is best, the slope of the best likelihood.

    Where all logits are equal, the shift to the classes' shares.
    """
    order = np.argsort(-z, kind="stable")
    hit, miss = np.cumsum((weight * y)[order]), np.cumsum((weight * (1 - y))[order])
    # a cut is a place between different logits
    cut = np.flatnonzero(z[order][1:] != z[order][:-1])
    if not len(cut):
        # nothing tells the texts apart: all get the classes' shares
        odds = (weight @ y + 1e-3) / (weight @ (1 - y) + 1e-3)
        return 1.0, float(np.log(odds) - z[0])
    f1 = 2 * hit / (hit + miss + hit[-1])
    best = cut[np.argmax(f1[cut])]
    shift = -float((z[order][best] + z[order][best + 1]) / 2)
    slopes = np.geomspace(0.5, 30, 40)
    losses = [float(weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * np.clip(s * (z + shift), -30, 30))) for s in slopes]
    return float(slopes[int(np.argmin(losses))]), shift


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The classifier: weights of features and a bias; besides them the voters' accuracies and the label model. Without labelled rows it has a bias alone.

    The features of texts are counted on the executors; the driver holds the votes of the sample and the features that tell.
    """
    picked, prior = sample(docs, labels)
    picked = written(picked.withColumn("_row", F.xxhash64("text")), "toxicity-sample")
    gold = {r._row: float(r._toxic) for r in picked.select("_row", "_toxic").collect()}
    if not gold:
        return {"weights": {}, "bias": float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))}
    seats = seats_of(telling(picked, gold, True))
    voters = max(seats.values()) + 1

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cast = [votes_of(text, seats) for text in texts_of(batch)]
            kinds = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array([v for v, _ in cast], kinds), pa.array([p for _, p in cast], kinds)], names=["row", "votes", "patterns"])

    cast = sorted(arrow_map(picked, vote, "row long, votes array<int>, patterns array<int>").collect())
    order = [r.row for r in cast]
    votes = np.zeros((len(cast), voters + PATTERNS), np.int8)
    for i, r in enumerate(cast):
        votes[i, r.votes] = 1
        votes[i, voters:] = r.patterns
    y = np.array([gold[i] for i in order])
    share = float(y.mean())
    model = LabelModel(share).fit(votes)
    posterior = model.posterior(votes)
    # voters have their say whatever their evidence against the posteriors is, so a small sample does not leave the classifier without features
    names = sorted({LISTED, *seats, *telling(picked, dict(zip(order, posterior.tolist(), strict=True)), False)})
    place = {f: i for i, f in enumerate(names)}

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [sorted({place[f] for w in set(text.split()) for f in features_of(w) if f in place}) for text in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(xs, pa.list_(pa.int32()))], names=["row", "x"])

    found = sorted(arrow_map(picked, features, "row long, x array<int>").collect())
    rows = np.repeat(np.arange(len(found)), [len(r.x) for r in found])
    columns = np.array([j for r in found for j in r.x], np.int64)
    w, b = linear(rows, columns, len(names), posterior)
    z = np.bincount(rows, w[columns], len(found)) + b
    if 0 < share < 1:
        slope, shift = calibrated(z, y, np.where(y == 1, prior / share, (1 - prior) / (1 - share)))
        w, b = w * slope, (b + shift) * slope
    accuracy = {f: float(model.accuracy[i]) for f, i in seats.items()}
    let_go()
    return {"weights": {f: float(v) for f, v in zip(names, w, strict=True) if v}, "bias": float(b), "accuracy": accuracy, "seats": seats, "label_model": model}


def scorer(model: dict):
    """text -> score: the bias and the weights of the distinct features; the weighted features of words are kept while there is room."""
    weights, bias = model["weights"], model["bias"]
    none: tuple[str, ...] = ()

    class Held(dict):
        def __missing__(self, word: bytes) -> tuple[str, ...]:
            if len(self) >= CACHE_WORDS:
                self.clear()
            value = self[word] = tuple(f for f in features_of(word) if f in weights) or none
            return value

    held = Held()

    def score(text: bytes) -> float:
        found = {f for fs in map(held.__getitem__, set(text.split())) if fs for f in fs}
        # sorted, so that equal texts get equal sums in any order of a set
        z = bias + sum(sorted(weights[f] for f in found))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))

    return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, model: dict | None = None) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without features. A null doc_id is not held out. Repeated
    rows get equal scores; whole texts are read; an empty table gives no rows, and without labels of both
    classes every score is the same. Other columns are not read.
    """
    model = model or fit(docs, labels)
    small = docs.sparkSession.sparkContext.broadcast({"weights": model["weights"], "bias": model["bias"]})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(small.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([of(t) for t in texts_of(batch)], pa.float64())], names=["doc_id", "score"])

    scored = arrow_map(docs.select("doc_id", "text"), run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, model: dict | None = None) -> DataFrame:
    """The documents with a score below 0.5, all columns as they are; nothing is shuffled.

    Null and empty texts have the score of a text without features, repeated rows go or stay together, rows of a null
    doc_id are scored like others, whole texts are read, an empty table gives no rows.
    """
    model = model or fit(docs, labels)
    small = docs.sparkSession.sparkContext.broadcast({"weights": model["weights"], "bias": model["bias"]})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(small.value)
        for batch in batches:
            yield batch.filter(pa.array([of(t) < 0.5 for t in texts_of(batch)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

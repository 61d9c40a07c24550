"""The recurrent model by finite differences and sums of probabilities, the base by brute force, and held-out texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import perplexity, recurrent

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small_model(seed=0, hidden=4):
    g = np.random.default_rng(seed)
    counts = np.array([50, 20, 10, 9, 5, 3, 1, 7, 7.0])
    classes = recurrent.Classes(counts[:7], 2, 3)
    return classes, {k: v.astype(float) + g.normal(0, 0.3, v.shape) for k, v in recurrent.initial(classes, counts, hidden).items()}, g


def test_gradients_by_finite_differences():
    classes, p, g = small_model()
    symbols, mask, h = g.integers(0, 9, (3, 5)), np.ones((3, 5), bool), g.normal(0, 1, (3, 4))
    mask[1, 3:] = False
    _, grads, _ = recurrent.gradients(p, classes, symbols, mask, h)
    for k in p:
        for _ in range(8):
            at = tuple(g.integers(0, d) for d in p[k].shape)
            up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            slope = (recurrent.gradients(up, classes, symbols, mask, h)[0] - recurrent.gradients(down, classes, symbols, mask, h)[0]) / 2e-6
            assert abs(slope - grads[k][at]) < 1e-6


def test_probabilities_sum_to_one():
    classes, p, g = small_model()
    h = g.normal(0, 2, (5, 4))
    sums = sum(np.exp(recurrent.log_probabilities(p, classes, h, np.full(5, s))) for s in range(9))
    assert np.allclose(sums, 1)
    large = {k: v * 200 for k, v in p.items()}
    assert np.isfinite(recurrent.log_probabilities(large, classes, h, np.zeros(5, int))).all()


def plain_score(p, classes, text):
    """Symbol by symbol."""
    h, out = np.zeros((1, len(p["recurrent"])), np.float32), 0.0
    for s in text.tolist():
        out += float(recurrent.log_probabilities(p, classes, h, np.array([s]))[0])
        h = recurrent.step(h, p["input"][[s]], p["recurrent"])[0]
    return out


@pytest.mark.parametrize("slots", [1, 3, 100])
def test_state_is_carried_through_whole_texts(slots):
    classes, p, g = small_model(hidden=6)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    texts = [g.integers(0, 9, n) for n in (0, 1, 15, 16, 17, 200, 33, 5, 64, 2, 900)]
    got = recurrent.scores(p, classes, texts, slots)
    assert np.allclose(got, [plain_score(p, classes, t) for t in texts], rtol=1e-4)
    # the same window scores otherwise after another past
    a, b = np.append(np.zeros(16, int), texts[2]), np.append(np.full(16, 3), texts[2])
    tail = lambda t: plain_score(p, classes, t) - plain_score(p, classes, t[:16])
    assert abs(tail(a) - tail(b)) > 1e-4
    assert len(recurrent.scores(p, classes, [])) == 0


def test_steps_by_gate_are_the_plain_steps():
    """Gates are whole blocks in training and scoring; the states are those of step()."""
    _, p, g = small_model(hidden=6)
    h, symbols = g.normal(0, 1, (5, 6)), g.integers(0, 9, (3, 5))
    inputs, u = recurrent.by_gate(p)
    a = recurrent.inputs_of(inputs, symbols)
    assert a.flags.c_contiguous and a.shape == (3, 3, 5, 6)
    for t in range(3):
        wanted = recurrent.step(h, p["input"][symbols[t]], p["recurrent"])[0]
        out = np.empty_like(h)
        recurrent.advance(h, a[t], u, np.empty((3, 5, 6)), np.empty_like(h), out)
        assert np.allclose(out, wanted, rtol=1e-12, atol=1e-12)
        h = out


def test_training_learns_an_order():
    g = np.random.default_rng(3)
    cycle = [np.array([1 + (k + i) % 6 for i in range(60)] + [0]) for k in g.integers(0, 6, 300)]
    counts = np.bincount(np.concatenate(cycle), minlength=9)
    classes = recurrent.Classes(counts[:7], 2, 3)
    p = recurrent.initial(classes, counts)
    before = recurrent.scores(p, classes, cycle).sum()
    q, _, read = recurrent.train(p, recurrent.fresh_squares(p), classes, cycle)
    assert read == sum(map(len, cycle)) and recurrent.scores(q, classes, cycle).sum() > 0.4 * before


def test_groups_and_hashes(spark):
    words = [b"", b"a", b"the", "été".encode(), b"x" * 5000, *(b"w%d" % i for i in range(9000))]
    centres = perplexity.centres_of(words[:200], np.arange(200) + 1)
    assert perplexity.groups_of(words, centres).tolist() == [int((perplexity.profiles([w]) @ centres.T).argmax()) for w in words]
    sample = spark.createDataFrame([(w,) for w in words[:50]], "w binary").select("w", F.xxhash64("w").alias("h")).collect()
    assert all(r.h == perplexity.word_hash(bytes(r.w)) for r in sample)


def test_frequent_words_fit(spark):
    r = random.Random(1)
    for numbers in ([5, 5, 3, 2, 2, 1, 1, 1], [1] * 9, [], [r.choice([1, 2, 50, 5000, 5001, 10**7]) for _ in range(90)]):
        counts = spark.createDataFrame([(b"%d" % i, n) for i, n in enumerate(numbers)], "word binary, n long")
        for most in (1, 4, 40, 1000):
            least = perplexity.frequent_from(counts, most)
            kept = sum(n >= least for n in numbers)
            more = [n for n in numbers if n < least]
            # the next lower count would be too many, but for counts of one step
            assert kept <= most and (not more or sum(n >= max(more) * 0.98 for n in numbers) > most)


ODD = [(3, None), (1, ""), (2, " \n\t "), (7, "one Two"), (7, "one Two"), (9, "Ünï cödé 😀 x ONE"), (None, "no id here at all"), (5, "w " * 3000), (8, "a b c d e f"), (11, "A b C d\x0be f g"), (12, "end end END <end>")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], COLUMNS)


def base_by_brute_force(rows):
    words = [[w if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [None] for _, t in rows]
    out_of = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(w for ws, out in zip(words, out_of, strict=True) if not out for w in ws)
    total = sum(counts.values())
    size = total + 0.1 * (len(counts) + 1)
    return [(i, out, len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 0.1) / size) for w in ws), 6)) for (i, _), ws, out in zip(rows, words, out_of, strict=True)]


@pytest.mark.parametrize("words,lookup", [(4, 6), (2048, 65_536)])
def test_base_by_brute_force(spark, words, lookup):
    r = random.Random(2)
    rows = ODD + [(100 + i, " ".join("w%d" % int(r.paretovariate(0.6)) for _ in range(r.randint(1, 60)))) for i in range(60)]
    docs = frame(spark, rows).withColumns({c: F.lit("x") for c in ("row", "hash", "n", "group", "word", "times", "round", "_key", "base", "score")})
    got = perplexity.score(docs, perplexity.fit(docs, words=words, lookup=lookup, least=3000, rounds=2)).collect()
    key = lambda t: (t[0] is None, t)
    assert sorted(((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got), key=key) == sorted(base_by_brute_force(rows), key=key)
    assert all(math.isfinite(x.score) and x.score < 0 for x in got)


def test_no_documents_and_no_training_documents(spark):
    assert perplexity.score(frame(spark, [])).count() == 0
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = perplexity.score(frame(spark, [(i, "some words here") for i in out])).collect()
    assert len(got) == 3 and all(x.held_out and x.n_known == x.train_tokens == 0 and abs(x.base_score) < 1e-9 and x.score < 0 for x in got)


def test_history_helps_on_held_out_texts(spark):
    """Two languages with words of their own: who has seen the first words knows which one it is."""
    r = random.Random(5)
    languages = [["%s%d" % (k, i) for i in range(150)] for k in ("ba", "zu")]
    rows = [(i, " ".join(r.choice(languages[i % 2]) for _ in range(80))) for i in range(400)]
    got = [x for x in perplexity.score(frame(spark, rows)).collect() if x.held_out]
    gain = sum(x.score - x.base_score for x in got) / sum(x.n_tokens for x in got)
    assert len(got) > 20 and gain > 0.2
    again = {x.doc_id: x.score for x in perplexity.score(frame(spark, rows).repartition(7)).collect()}
    assert all(abs(again[x.doc_id] - x.score) < 1e-3 * abs(x.score) for x in got)


@pytest.mark.parametrize("rounds", [1, 3])
def test_training_reads_every_stretch_once(spark, rounds):
    """All symbols of the training documents, none of the held out ones, whatever the size of the corpus."""
    r = random.Random(8)
    rows = ODD + [(100 + i, " ".join(r.choice(["a", "b", "w%d" % r.randint(0, 50)]) for _ in range(r.choice([0, 1, 127, 128, 129, 700])))) for i in range(80)]
    docs = frame(spark, rows)
    model, _, parts = perplexity._fitted(docs, words=20, least=2000, rounds=1)
    learnt = parts.where(~perplexity.held_out(F.col("doc_id")))
    kind = model.lexicon.kind
    cut = lambda b: [bytes(b[i : i + size]) for i in range(0, len(b), size)]
    size = perplexity.STRETCH * np.dtype(kind).itemsize
    wanted = Counter(s for x in learnt.collect() for s in cut(x.symbols))
    dealt = [perplexity.stretches(learnt, kind, k, rounds).collect() for k in range(rounds)]
    assert Counter(bytes(x.symbols) for part in dealt for x in part) == wanted and all(dealt)
    assert sum(len(s) * n for s, n in wanted.items()) == model.total * np.dtype(kind).itemsize

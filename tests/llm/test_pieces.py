"""The parts that need no session."""

import math
import random
import zlib

import numpy as np
import pytest

from tallyforge.llm import binary, fingerprints, jaccard, packing, pii, quality, tagger, toxicity
from tallyforge.llm.common import SLAB, shingle_sets
from tallyforge.llm.tokens import encoder, vocabulary_path

ODD = [b"", b" \n\t", b"a", b"A b", b"a b c d e", "é ß　x \x85 y".encode(), b"z" * 3000 + b" y", b"x " * 2000, b" ".join(b"w%d" % i for i in range(SLAB // 4)), b"q" * (2 * SLAB) + b" end"]


def words(text):
    return text.lower().split()


def windows(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("width", [1, 4, 5])
def test_shingles_count_the_distinct_windows(width):
    for text, got in zip(ODD, shingle_sets(ODD, width), strict=True):
        assert len(got) == len(windows(text, width)) and (np.diff(got.astype(object)) > 0).all()


def test_shingles_do_not_depend_on_neighbours_or_case():
    alone = [next(shingle_sets([t], 4)).tolist() for t in ODD]
    assert alone == [s.tolist() for s in shingle_sets(ODD, 4)] == [s.tolist() for s in shingle_sets([t.upper() if t.isascii() else t for t in ODD], 4)]
    # a short text is no window of a longer one
    a, b = shingle_sets([b"a b c", b"a b c d"], 4)
    assert not np.intersect1d(a, b).size


def sets(r, n, shared):
    base = [b"w%d" % r.randint(0, 10**6) for _ in range(n)]
    other = base[: int(n * shared)] + [b"v%d" % r.randint(0, 10**6) for _ in range(n - int(n * shared))]
    return b" ".join(base), b" ".join(other)


def test_sketches_estimate_and_merge():
    r = random.Random(3)
    a, b = sets(r, 4000, 0.6)
    x, y = fingerprints.sketches([a, b])
    wa, wb = windows(a, 5), windows(b, 5)
    assert abs(fingerprints.resemblance(x, y) - len(wa & wb) / len(wa | wb)) < 0.15
    assert abs(fingerprints.containment(x, y) - len(wa & wb) / len(wa)) < 0.2
    assert abs(fingerprints.distinct(x) / len(wa) - 1) < 0.3
    whole = fingerprints.sketches([a + b" " + b])[0]
    # merging the parts' sketches is the sketch of the union of their shingles
    assert np.array_equal(fingerprints.merge(x, y), np.union1d(*shingle_sets([a, b], 5))[: fingerprints.K]) and len(whole) == fingerprints.K
    assert np.array_equal(fingerprints.decode(fingerprints.encode(x)), x)
    empty = fingerprints.sketches([b""])[0]
    assert fingerprints.resemblance(empty, empty) == 1 and fingerprints.resemblance(x, empty) == 0 and fingerprints.distinct(empty) == 0


def test_short_texts_are_exact():
    a, b = b"one two three four five six", b"one two three four five seven"
    x, y = fingerprints.sketches([a, b])
    assert fingerprints.resemblance(x, y) == pytest.approx(1 / 3)


@pytest.mark.parametrize("text,expected", [(b"a b c a b c", 6), (b"a a a a", 4), (b"a b c d", 0), (b"", 0), (b"x a b c y a b c z", 6)])
def test_repeated_words(text, expected):
    assert quality.View(text).n_repeat_words == expected


def test_quality_view_counts():
    v = quality.View("É # a\n\n é $$ b\nx\nx\n \nx".encode())
    assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines) == (9, 10, 3, 2)


def test_rules_rank_by_rejection_per_cost():
    assert quality.ranked({"a": 10, "b": 1, "c": 5}, {"a": 100, "b": 1, "c": 0}) == ["a", "b", "c"]


def test_segment_tree_equals_a_search():
    r = random.Random(2)
    tree, held = binary.CapacityTree(100), []
    for i in range(3000):
        if held and r.random() < 0.5:
            need = r.randint(1, 100)
            fit = [c for c, _ in held if c >= need]
            got = tree.best(need)
            assert (got is None) == (not fit)
            if fit:
                c, row = divmod(got, 1 << 32)
                assert c == min(fit)
                held.remove((c, row))
        else:
            c = r.randint(1, 100)
            tree.add(c, i)
            held.append((c, i))


def test_best_fit_holds_every_piece_once():
    lengths = np.array([5000, 1, 2048, 2047, 900, 700, 500, 1], np.int64)
    doc, start, size = binary.split(lengths, 2048)
    assert [int(size[doc == d].sum()) for d in range(len(lengths))] == lengths.tolist()
    row, offset, n = binary.best_fit(size, 2048)
    for k in range(n):
        spans = sorted(zip(offset[row == k], size[row == k], strict=True))
        assert spans[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) <= 2048


def cheapest(positions, penalties, length):
    """By trying all windows."""
    best = [0.0] + [None] * (len(positions) - 1)
    for j in range(1, len(positions)):
        options = []
        for i in range(j):
            n = positions[j] - positions[i]
            if n <= length:
                options.append(best[i] + (0 if n & (n - 1) == 0 else length - n))
        best[j] = min(options) + penalties[j]
    return best[-1]


def test_dynamic_programme_is_optimal():
    r = random.Random(8)
    for _ in range(60):
        length = 32
        lengths = np.array([r.randint(1, 70) for _ in range(r.randint(1, 25))])
        ends = np.array(sorted(r.sample(range(1, int(lengths.sum()) + 1), min(5, int(lengths.sum())))))
        c, pen = packing.candidates(lengths, ends, 8, 2.0, 5.0)
        found = packing.cuts(c, pen, length).tolist()
        at = dict(zip(c.tolist(), pen.tolist(), strict=True))
        cost = sum((0 if (n := b - a) & (n - 1) == 0 else length - n) + at[b] for a, b in zip(found, found[1:], strict=False))
        assert cost == pytest.approx(cheapest(c.tolist(), pen.tolist(), length))
        p = packing.pieces(lengths, ends, length, 8, 2.0, 5.0)
        assert p[:, 2].sum() == lengths.sum() and (p[:, 2] > 0).all() and p[:, 4].max() < length


def test_ids_equal_the_tokenizers_library():
    e = encoder(vocabulary_path())
    texts = ["", " ", "a<|endoftext|>b <|endoftext|>", "x" * 5000 + " y", "\x1c\x85 　 ok  \n\n  z", "it's we'LL 12३ ½ 😀", " " * 50 + "a" + "\t" * 20, "Ünïcödé\r\nnew"]
    assert e.fast is not None
    assert [e.ids(t)[:-1].tolist() for t in texts] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert all(e.ids(t)[-1] == 1 for t in texts)
    assert zlib.crc32(e.ids("").astype("<u4").tobytes()) == zlib.crc32(b"\x01\x00\x00\x00")


def test_ids_equal_the_library_over_all_characters_and_runs():
    import sys
    import unicodedata

    e = encoder(vocabulary_path())
    given = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    r = random.Random(8)
    texts = ["".join(given[a : a + 400]) for a in range(0, len(given), 400)] + [f"a {c}1 {c}{c} b" for c in r.sample(given, 3000)]
    for _ in range(400):
        texts.append("".join(r.choice([" ", "  ", "a", "'s", "1", "\n", "é", "-", "x" * r.randint(1, 3000), r.choice(given)]) for _ in range(r.randint(1, 30))))
    for text, x in zip(texts, e.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert e.fast.encode(text, allowed_special="all") == x.ids, text[:40]


def test_every_sentence_end_may_be_a_cut():
    lengths, ends = np.array([124]), np.array([40, 45, 60, 110])
    c, pen = packing.candidates(lengths, ends, 32, 4.0, 24.0)
    assert set(ends.tolist()) <= set(c.tolist()) and packing.cuts(c, pen, 64).tolist() == [0, 60, 124]


def test_tree_and_forests_equal_brute_force():
    r = random.Random(6)
    texts = []
    for _ in range(12):
        base = ["w%d" % r.randint(0, 500) for _ in range(r.choice([3, 20, 90, 600]))]
        for _ in range(6):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 15))):
                t[r.randrange(len(t))] = "n%d" % r.randint(0, 10**6)
            texts.append(" ".join(t).encode())
    s = list(shingle_sets(texts, 4))
    for percent in (60, 85, 100):
        link = {(i, j) for i in range(len(s)) for j in range(i) if 100 * len(np.intersect1d(s[i], s[j])) >= percent * len(np.union1d(s[i], s[j]))}
        near = {(max(i, int(j)), min(i, int(j))) for i, js in jaccard._near_pairs(np.array([len(x) for x in s]), [jaccard._vector(x) for x in s], percent) for j in js}
        assert link <= near
        assert components(len(s), jaccard.verified_forest(s, percent)) == components(len(s), link)
        side = np.array([i % 2 for i in range(len(s))])
        across = {(i, j) for i, j in link if side[i] != side[j]}
        assert components(len(s), jaccard.verified_forest(s, percent, apart=lambda i, near: near[side[near] != side[i]])) == components(len(s), across)
        for i, j in link:  # the prefixes of linked sets meet
            k = lambda x: set(np.sort(x)[: jaccard.prefix_length(len(x), percent)].tolist())
            assert k(s[i]) & k(s[j])


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_count_vectors_fold_and_pack():
    s = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 3000, np.uint64))
    v = jaccard._vector(s)
    assert len(v) == jaccard.groups_for(3000) == 512 and v.sum() == 3000
    assert jaccard._folded(v, 64).tolist() == np.bincount((s >> np.uint64(32)).astype(np.int64) % 64, minlength=64).tolist()
    assert jaccard._unpacked(jaccard._packed(v), 3000).tolist() == v.tolist()
    big = np.full(64, 300)
    assert jaccard._unpacked(jaccard._packed(big), 100).tolist() == big.tolist()


@pytest.mark.parametrize(
    "text,expected",
    [
        ("a.b@c.de x@y z@q..r", ["email:0:8"]),
        ("x@y.zw@q.rs", ["email:0:6"]),
        ("1.2.3.4 1.2.3.400 1.2.3.4.5 001.2.3.4", ["ip:0:7", "ip:18:25", "ip:28:37"]),
        ("4111 1111 1111 1111 x 4111111111111112", ["card:0:19"]),
        ("4111 1111 1111 1111 4111111111111111", []),
        ("+1 (017) 555-7713 +12", ["phone:0:17"]),
        ("", []),
    ],
)
def test_base_spans(text, expected):
    assert pii.joined(pii.base_spans(text)).split(",") == (expected or [""])


def test_base_spans_equal_the_plain_patterns():
    import re

    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    r = random.Random(4)
    for _ in range(3000):
        t = "".join(r.choice("ab@@..--++ 0123456789()\n") for _ in range(r.randint(0, 60)))
        found = []
        for k, p in enumerate(plain):
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m[0])
                if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15][k]:
                    found.append((k, m.start(), m.end()))
        assert pii.base_spans(t) == pii.ordered(found), t


def test_base_spans_are_linear():
    import time

    began = time.time()
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + "2" * 300_000, "@" * 100_000):
        pii.base_spans(t)
    assert time.time() - began < 20


@pytest.fixture(scope="module")
def model(spark):
    return pii.default_model(spark)


def test_training_is_the_same_in_a_task(spark):
    here, there = tagger.train(tagger.examples(60), steps=3), pii.default_model(spark, 60, 3)
    assert here.keys() == there.keys() and all(np.array_equal(here[k], there[k]) for k in here)


def test_plain_numbers_are_no_cards(model):
    texts = ["order 12345678901234 shipped", "id 1234567890123456 and 99887766554433221", "sum 111222333444555666 only"]
    assert not any(pii.luhn(w) for t in texts for w in t.split() if len(w) > 13 and w.isdigit())
    assert pii.found_spans(model, texts, [pii.base_spans(t) for t in texts]) == [[], [], []]
    assert pii.checked("4111111111111111", (2, 0, 16)) == (2, 0, 16) and pii.checked("4111111111111112", (2, 0, 16)) is None
    assert [k for k, _, _ in pii.found_spans(model, ["card 4929 1273 8841 0092 paid"], [[]])[0]] == [2]


def test_tagger_finds_held_out_spans(model):
    held = tagger.examples(400, seed=77)
    found = pii.found_spans(model, [t for t, _ in held], [[] for _ in held])
    hit = wanted = given = 0
    for (text, spans), f in zip(held, found, strict=True):
        inner = lambda xs: {x for x in xs if x[1] > 0 and x[2] < len(text)}  # noqa: E731, B023
        # what the check lets through of the labelled spans is wanted: numbers of other lengths are not
        right = {s for x in inner(spans) if (s := pii.checked(text, x))}
        f = inner(f)
        hit, wanted, given = hit + len(right & f), wanted + len(right), given + len(f)
    assert hit / wanted > 0.85 and hit / given > 0.8


def whole_search(p, text):
    """Merged scores of every character and one search over the whole text, nothing left out."""
    codes = tagger.codes(text)
    sums, shares = np.zeros((len(codes), tagger.TAGS)), np.zeros((len(codes), 1))
    weight = np.minimum(np.arange(1, tagger.READ + 1), np.arange(tagger.READ, 0, -1))[:, None]
    for start in range(0, max(1, len(codes) - (tagger.READ - tagger.STRIDE)), tagger.STRIDE):
        part = codes[start : start + tagger.READ]
        window = np.append(part, np.full(tagger.READ - len(part), tagger.SYMBOLS - 3))
        sums[start : start + len(part)] += (tagger.emissions(p, window[None])[0][:, 0] * weight)[: len(part)]
        shares[start : start + len(part)] += weight[: len(part)]
    scores = sums / shares
    best, back = p["first"] + scores[0], []
    for row in scores[1:]:
        through = best[:, None] + p["transition"]
        back.append(through.argmax(0))
        best = through.max(0) + row
    tags = [int(best.argmax())]
    for b in back[::-1]:
        tags.append(int(b[tags[-1]]))
    return tagger.spans_of(np.array(tags[::-1]))


def test_marks_equal_a_search_over_the_whole_text(model):
    texts = [t for t, _ in tagger.examples(40, seed=5)]
    texts += ["", "a", " ".join(texts), "".join(texts[:9]) * 3, "1" * 700, "no data at all " * 60]
    assert tagger.marked(model, texts) == [whole_search(model, t) if t else [] for t in texts]
    assert [tagger.marked(model, [t])[0] for t in texts] == tagger.marked(model, texts, rows=3)


def odd_texts(n, seed):
    """Texts in which spans, parts of spans, digits and at-signs stand far apart or close, across the edges of windows."""
    r = random.Random(seed)
    pieces = [t[a:b] for t, spans in tagger.examples(300, seed=6) for _, a, b in spans] + ["@", " [at] ", "(AT)", "1", "12 34", "+", "-", "ſ", "é", "\n", "abcdefghijklmnopqrstuvw", "_" * 30, "A" * 25 + "12", "7" * 300, "x.y-" * 70]
    return ["".join(r.choice(pieces) if r.random() < 0.3 else "word " * r.choice([1, 1, 5, 30, 60, 140]) for _ in range(r.randint(1, 12))) + "w" * r.randint(0, 20) for _ in range(n)]


def test_spans_are_those_of_reading_every_window(model, monkeypatch):
    texts = odd_texts(150, 1) + [t for t, _ in tagger.examples(150, seed=8)] + ["", "a", "no data at all " * 300]
    base = [pii.base_spans(t) for t in texts]
    read, states = [], tagger._states
    monkeypatch.setattr(tagger, "_states", lambda table, recurrent, symbols: (read.append(symbols.shape[1]), states(table, recurrent, symbols))[1])
    found, few = pii.found_spans(model, texts, base), sum(read)
    assert [pii.found_spans(model, [t], [b])[0] for t, b in zip(texts, base, strict=True)] == found
    read.clear()
    # a text without a digit and an at-sign, in letters or as a sign, is not read by the tagger
    assert pii.found_spans(model, ["no data here " * 90], [[]]) == [[]] and not read
    monkeypatch.setattr(pii, "zones", lambda text: [(0, len(text))] if text else [])
    assert pii.found_spans(model, texts, base) == found and sum(read) > few


def test_marks_that_touch_zones_are_those_of_the_whole_text(model):
    """Any zones, also within stretches that run over many windows."""
    r = random.Random(9)
    texts = odd_texts(80, 2) + ["1 2-3" * 400, "+1 (2" * 300 + " word" * 200 + "9" * 500]
    whole = tagger.marked(model, texts)
    for _ in range(3):
        zones = [sorted((a, min(len(t), a + r.randint(1, 40))) for a in (r.randrange(len(t)) for _ in range(r.randint(0, 3)))) for t in texts]
        got = tagger.marked(model, texts, zones=zones)
        for g, w, z in zip(got, whole, zones, strict=True):
            touching = {s for s in w if any(s[1] < b and a < s[2] for a, b in z)}
            assert touching <= set(g) <= set(w)


@pytest.mark.parametrize("text,kind", [("api key: sk-Ab3dE5gH7jK9mN1pQ3sT5vW7", 4), ("pay DE89 3704 0044 0532 0130 00 today", 5), ('token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" is', 4)])
def test_secrets_and_account_numbers_are_found(model, text, kind):
    assert [k for k, _, _ in pii.found_spans(model, [text], [[]])[0]] == [kind]


def test_long_spans_pass_the_check():
    text = "x" * 400 + "@" + "y" * 400 + ".org"
    assert pii.checked(text, (0, 0, len(text))) == (0, 0, len(text))
    assert pii.checked("DE89 3704 0044 0532 0130 01", (5, 0, 27)) is None


def test_gradients_are_those_of_the_loss():
    p = {k: v.astype(np.float64) for k, v in tagger.initial(3, 2, 1).items()}
    x, y = np.array([[1, 5, 9, 2]]), np.array([[0, 1, 2, 0]])

    def loss(q):
        return tagger._crf(q, tagger.emissions(q, x)[0].astype(np.float64), y.T)[0]

    scores, _ = tagger.emissions(p, x)
    _, grads, _ = tagger._crf(p, scores.astype(np.float64), y.T)
    q = p | {"transition": p["transition"].copy()}
    q["transition"][0, 1] += 1e-5
    assert (loss(q) - loss(p)) / 1e-5 == pytest.approx(grads["transition"][0, 1], rel=1e-2, abs=1e-4)


def test_windows_are_reconciled_over_long_regions(model):
    text = ("abc def " * 20 + "4929 1234 5678 9012" + " ghi jkl" * 20)[:]
    base = pii.base_spans(text)
    whole = pii.found_spans(model, [text], [base])[0]
    assert any(text[a:b] == "4929 1234 5678 9012" for _, a, b in whole)
    assert pii.found_spans(model, ["", "no digits"], [[], []]) == [[], []]


@pytest.mark.parametrize(
    "address",
    [
        "JOHN.SMITH [AT] EXAMPLE.COM", "john.smith(At)example.com", "bartholomew.maximilian.featherstonehaugh [at] example.com", "jo [at] department-of-mathematics.university-of-somewhere.example.org",
        "BARTHOLOMEW.MAXIMILIAN.FEATHERSTONEHAUGH(AT)DEPARTMENT-OF-MATHEMATICS.EXAMPLE.ORG",
    ],
)
def test_addresses_in_capitals_and_long_ones_are_found_whole(model, address):
    text = f"please write to {address} today"
    assert pii.found_spans(model, [text], [[]])[0] == [(0, 16, 16 + len(address))]


def test_added_spans_leave_base_spans_alone(model):
    text = "mail a.b@c.de or 4111111111111111 or 1234567890123456"
    base = pii.base_spans(text)
    found = pii.found_spans(model, [text], [base])[0]
    assert set(base) <= set(found)
    assert all(a >= e or b <= s for k, a, b in set(found) - set(base) for _, s, e in base)


def test_masks_replace_overlaps_once():
    assert pii.replaced("ab12cd", [(0, 1, 4), (1, 2, 3)], "[{}]") == "a[email]cd"


def test_toxic_features_and_votes():
    assert toxicity.features_of("(Idiots!!)".encode()) == ["=idiots", "^idio", "^idiot", toxicity.LISTED]
    assert toxicity.features_of(b"12") == toxicity.features_of(b"---") == [] and toxicity.features_of(b"x") == ["=x"]
    assert len(toxicity.features_of(b"z" * 100_000)) < 100
    seats = toxicity.seats_of(["^vran", "=idiot"])
    assert seats["^vran"] == len(toxicity.WORDS) and seats["=idiot"] == seats["=idiots"]
    found, patterns = toxicity.votes_of(b"You Idiots! vrankly", seats)
    assert found == sorted({seats["=idiot"], seats["^vran"]}) and patterns == [0, 0, 0, 1, 1, 1, 0]
    assert toxicity.votes_of(b"", seats) == ([], [0, 0, 0, 0, 0, 0, -1])


def em_by_loops(votes, prior, rounds):
    """The label model's estimates, one number at a time."""
    n, m = votes.shape
    p = [0.9 if any(v == 1 for v in row) else 0.1 for row in votes]
    weight = [1.0] * m
    for done in range(2 * rounds):
        if done == rounds:
            h = [float(x > 0.5) for x in p]
            mean = {(y, j): sum((x if y else 1 - x) * votes[i, j] for i, x in enumerate(h)) / sum(x if y else 1 - x for x in h) for y in (1, 0) for j in range(m)}
            cov = [[sum((x if y else 1 - x) * (votes[i, a] - mean[y, a]) * (votes[i, b] - mean[y, b]) for y in (1, 0) for i, x in enumerate(h)) for b in range(m)] for a in range(m)]
            weight = [1 / max(1.0, sum(cov[a][b] ** 2 / max(cov[a][a], 1e-9) / max(cov[b][b], 1e-9) for b in range(m))) for a in range(m)]
        rate = {}
        for y in (1, 0):
            q = [x if y else 1 - x for x in p]
            for j in range(m):
                raw = {k: sum(q[i] for i in range(n) if votes[i, j] == k) + 0.5 * (2.0 if k and (k == 1) == (y == 1) else 0.5) for k in (1, -1, 0)}
                for k in raw:
                    rate[y, k, j] = raw[k] / sum(raw.values())
        z = [math.log(prior / (1 - prior)) + sum(weight[j] * math.log(rate[1, votes[i, j], j] / rate[0, votes[i, j], j]) for j in range(m) if votes[i, j]) for i in range(n)]
        p = [1 / (1 + math.exp(-x)) for x in z]
    return p, weight


def test_label_model_equals_loops():
    r = np.random.default_rng(3)
    votes = r.choice(np.array([1, 0, 0, -1], np.int8), (14, 4))
    m = toxicity.LabelModel(0.3, rounds=4, tolerance=0).fit(votes)
    p, weight = em_by_loops(votes, 0.3, 4)
    assert m.weight.tolist() == pytest.approx(weight, rel=1e-3) and m.posterior(votes).tolist() == pytest.approx(p, rel=1e-3, abs=1e-4)


def test_label_model_tells_accurate_voters_and_copies():
    r = np.random.default_rng(0)
    y = r.random(2000) < 0.3
    votes = np.zeros((2000, 5), np.int8)
    for j, (hit, miss) in enumerate([(0.8, 0.02), (0.7, 0.02), (0.5, 0.5), (0.6, 0.05)]):
        votes[:, j] = np.where(y, r.random(2000) < hit, r.random(2000) < miss)
    votes[:, 4] = votes[:, 0]  # a copy
    m = toxicity.LabelModel(0.3).fit(votes)
    assert m.accuracy[0] > m.accuracy[2] and m.correlation[0, 4] > 0.95 and m.weight[0] < 0.7
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.9


def test_calibration_of_equal_logits_keeps_the_shares():
    z, y = np.full(20, 0.3), np.array([1.0] * 4 + [0.0] * 16)
    slope, shift = toxicity.calibrated(z, y, np.ones(20))
    assert abs(1 / (1 + np.exp(-slope * (z[0] + shift))) - 0.2) < 0.01
    slope, shift = toxicity.calibrated(np.append(z[:19], 2.0), y[::-1], np.ones(20))
    assert slope * (0.3 + shift) < 0 < slope * (2.0 + shift)

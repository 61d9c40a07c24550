"""Operators on small tables: results by brute force, and the odd cases."""

import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import binary, chat, components, fingerprints, jaccard, mixing, packing, pii, quality, queries, toxicity, warc
from tallyforge.llm.tokens import encoder, vocabulary_path
from tests.helpers import assert_same, connect

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], COLUMNS)


ODD = [(3, None, "b"), (1, "", None), (2, " \n\t ", "a"), (7, "one", "a"), (7, "one", "a"), (9, "Ünï cödé 😀 x", "a"), (None, "no id here at all", "b"), (5, "w " * 40_000, "a"), (8, "a b c d e f", None), (11, "A b C d e f", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, repeated rows, and extra columns whose names operators use inside."""
    return docs(spark, ODD).withColumns({c: F.lit("x") for c in ("size", "target", "_key", "_part", "cluster", "vector", "score", "_toxic", "fingerprint")})


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")


def test_empty_tables(spark, none, labels):
    for out in (
        fingerprints.fingerprint_edits(none), fingerprints.fingerprint(none), fingerprints.merged(none, "source"), quality.quality(none), quality.cascade(none), binary.packed_rows(none), binary.packed_matrices(none),
        pii.personal_data(none), pii.masked(none), toxicity.score(none, labels), toxicity.score(none, labels.where("1 = 0")), mixing.mix(none), mixing.mixed(none), jaccard.join_components(none), jaccard.one_of_each(none),
        packing.pack(none), warc.derivatives(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))), chat.chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert out.count() == 0


# ---- 1


def edited(rows):
    order = sorted(((i is None, i or 0, t or ""), t or "") for i, t, _ in rows)
    texts = [t for _, t in order]
    out = []
    for k, t in enumerate(texts):
        half = len(t) // 2
        out.append((t, t[: len(t) - half] + texts[(k + 1) % len(texts)][:half]))
    return out


def shingle_set(t, n):
    w = [x.lower() if x.isascii() else x for x in BLANK.findall(t)]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_edits_by_brute_force(odd, partitions):
    got = sorted((r.n_chars, r.edited_sha256, round(r.near_edited, 9)) for r in fingerprints.fingerprint_edits(odd, partitions=partitions).collect())
    expected = []
    for t, e in edited(ODD):
        a, b = shingle_set(t, 5), shingle_set(e, 5)
        expected.append((len(t), hashlib.sha256(e.encode()).hexdigest(), round(len(a & b) / len(a | b), 9) if a | b else 1.0))
    assert got == sorted(expected)


def test_equal_texts_have_equal_fingerprints(odd):
    rows = fingerprints.fingerprint_edits(odd).collect()
    assert len({r.fingerprint for r in rows if r.doc_id in (8, 11)}) == 1 and len({r.fingerprint for r in rows if r.doc_id in (1, 2, 3)}) == 1


def test_only_null_ids_and_one_row(spark):
    assert fingerprints.fingerprint_edits(docs(spark, [(None, "b c", "s"), (None, "a d", "s")])).count() == 2
    r = fingerprints.fingerprint_edits(docs(spark, [(4, "ab cd", "s")])).first()
    assert r.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()


def test_merged_sketches_equal_those_of_the_whole(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w%d" % r.randint(0, 900) for _ in range(60)), "ab"[i % 2]) for i in range(80)]
    got = {x.source: x for x in fingerprints.merged(docs(spark, rows).repartition(7), "source").collect()}
    for s in "ab":
        every = np.unique(np.concatenate(list(fingerprints.shingle_sets([t.encode() for _, t, k in rows if k == s], 5))))
        assert got[s].fingerprint == fingerprints.encode(every[: fingerprints.K]) and abs(got[s].n_shingles / len(every) - 1) < 0.3


# ---- 2


def test_quality_odd_rows_and_order(odd):
    got = quality.quality(odd).collect()
    assert len(got) == len(ODD) and all(r.base_failed and not r.kept for r in got)
    a, b = (sorted((r.doc_id or -1, r.rejected_by is None) for r in quality.cascade(odd, order=o).collect()) for o in (list(quality.BASE | quality.RULES), list(quality.BASE | quality.RULES)[::-1]))
    assert a == b


# ---- 3 and 10


def check_pieces(pieces, rows):
    e = encoder(vocabulary_path())
    got = {}
    for doc_id, start, length, crc in pieces:
        got.setdefault(doc_id, []).append((start, length, crc))
    expected = {}
    for i, t, _ in rows:
        expected.setdefault(i, []).append(e.ids(t or ""))
    for i, all_ids in expected.items():
        spans = sorted(got[i])
        ids = all_ids[0]
        each = len(spans) // len(all_ids)
        for a in range(0, len(spans), len(all_ids)):
            start, length, crc = spans[a]
            assert crc is None or zlib.crc32(ids[start : start + length].astype("<u4").tobytes()) == crc
        assert sum(n for _, n, _ in spans) == len(ids) * len(all_ids) and each >= 1


def test_packing_loses_nothing(odd):
    rows = packing.pack(odd, stretch=3000).collect()
    check_pieces([(r.doc_id, r.start, r.length, r.ids_crc32) for r in rows], ODD)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for group in by.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_matrices_round_trip(spark, odd, tmp_path):
    target = str(tmp_path / "packed")
    binary.write_packed(odd, target, stretch=3000)
    e = encoder(vocabulary_path())
    found = {}
    for m in binary.read_packed(spark, target):
        for k in range(m["n_rows"]):
            cu = m["cu_seqlens"][k]
            for a, b, i, start in zip(cu, cu[1:], m["doc_ids"][k], m["starts"][k], strict=False):
                found.setdefault(i, {}).setdefault(start, m["ids"][k, a:b])
                assert m["position_ids"][k, a:b].tolist() == list(range(b - a))
            assert not m["ids"][k, cu[-1] :].any() and not m["position_ids"][k, cu[-1] :].any()
    for i, t, _ in ODD:
        assert np.concatenate([found[i][s] for s in sorted(found[i])]).tolist() == e.ids(t or "").tolist()
    assert sorted(x for r in binary.packed_rows(odd, stretch=3000).collect() for x in r.doc_ids if x is not None) == sorted(x for m in binary.read_packed(spark, target) for ids in m["doc_ids"] for x in ids if x is not None)


# ---- 4


def test_personal_data_odd_rows(spark, odd):
    assert {r.spans for r in pii.personal_data(odd).collect()} == {""}
    d = docs(spark, [(1, "é a.b@c.de, 1.2.3.4", "s"), (2, None, "s"), (3, "x 4929123456789012 y", "s")])
    got = {r.doc_id: r for r in pii.personal_data(d).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].spans) == (1, 1, "email:2:10,ip:12:19")
    assert got[1].base_sha256 == hashlib.sha256(b"email:2:10,ip:12:19").hexdigest() and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {r.doc_id: r for r in pii.masked(d.withColumn("extra", F.lit(1))).collect()}
    assert masked[1].text == "é [email], [ip]" and masked[1].n_chars == 15 and masked[2].text is None and masked[1].extra == 1


# ---- 5


def test_toxicity_learns_from_its_folds_alone(spark, labels):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = [(i, " ".join([word() for _ in range(30)] + (["vrankly", "vrankest"] if i % 3 == 0 else [])), "s") for i in range(400)]
    d = docs(spark, rows)
    got = toxicity.score(d, labels).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert sum(x.predicted == (x.doc_id % 3 == 0) for x in got) > 395 and all(0 <= x.score <= 1 for x in got)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id").isin(held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {x.doc_id: x.score for x in toxicity.score(d, flipped).collect()} == {x.doc_id: x.score for x in got}
    assert toxicity.without_toxic(d, labels).count() == sum(x.predicted == 0 for x in got)


@pytest.mark.parametrize("toxic", [0, 1, 10])
def test_toxicity_of_small_samples(spark, toxic):
    """However few toxic labels there are, clean texts stay clean and insults are told."""
    r = random.Random(toxic)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    insult = lambda: " ".join(r.sample(["idiot", "moron", "pathetic", "worthless", "scum", "trash"], 3))
    learnt = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:80]
    bad = set(learnt[:toxic])
    rows = [(i, " ".join(word() for _ in range(40)) + (" " + insult() if i in bad or i >= 190 else ""), "s") for i in range(200)]
    got = toxicity.score(docs(spark, rows), spark.createDataFrame([(i, 1, int(i in bad)) for i in learnt], "doc_id long, quality int, toxic int")).collect()
    assert not any(x.predicted for x in got if x.doc_id not in bad and x.doc_id < 190)
    assert sum(x.predicted for x in got if x.doc_id >= 190) >= min(toxic, 10)  # with none of it in the sample nothing can be learned


def test_toxicity_samples_one_text_of_an_id(spark):
    rows = [(7, "text number %d" % i, "s") for i in range(50)] + [(8, "other", "s")]
    picked, _ = toxicity.sample(docs(spark, rows), spark.createDataFrame([(7, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int"))
    assert picked.count() == 2


@needs_tables
@pytest.mark.parametrize("folder,least", [("sf0.001", 0.9), ("sf0.01", 0.75), ("sf0.1", 0.88)])
def test_toxicity_held_out(spark, folder, least):
    """F1 on the labels that were not learned from; the lexicon alone has 0.64 at sf0.1."""
    folder = f"/root/testdata/{folder}"
    got = toxicity.op5_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    hit = sum(x.predicted and x.toxic for x in got)
    assert 2 * hit >= least * (sum(x.predicted for x in got) + sum(x.toxic for x in got))


def test_toxicity_odd_rows(odd, labels):
    got = toxicity.score(odd, labels.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(got) == len(ODD) and len({r.score for r in got}) == 1 and {r.held_out for r in got if r.doc_id is None} == {False}


# ---- 6 and 7


def test_warc_records(spark):
    pages = spark.createDataFrame([(1, "http://a", "<html><title>T &amp; t</title><script>x</script><p>Hi&nbsp;<b>you</b></p><a href='q'>l</a></html>"), (2, None, None), (1, "http://a", None)], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses(pages)).withColumn("record", warc.record()).collect()
    assert len(rows) == 6 and len({r.record_id for r in rows}) == 6
    conv = next(r for r in rows if r.warc_type == "conversion" and r.block)
    assert conv.block == "T & t Hi you l" and conv.content_length == len(conv.block) and conv.block_digest == "sha256:" + hashlib.sha256(conv.block.encode()).hexdigest()
    meta = next(r for r in rows if r.warc_type == "metadata" and r.refers_to == conv.refers_to)
    assert "links: 1" in meta.block and "converted-digest: " + conv.block_digest in meta.block and meta.payload_digest == conv.payload_digest
    assert bytes(conv.record).decode().endswith(f"Content-Length: {conv.content_length}\r\n\r\n{conv.block}\r\n\r\n")


def test_chat_keeps_maximal_conversations(spark):
    turns = {1: "ab", 2: "abc", 3: "abc", 4: "abd", 5: "b", None: "zz", 6: ""}
    rows = [(c, n, "user", t) for c, text in turns.items() for n, t in enumerate(text)] + [(9, 0, None, None), (9, 1, "x", "")]
    got = {r.conv_id: r for r in chat.chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hashes", F.lit(1))).collect()}
    assert set(got) == {2, 4, 5, None, 9} and got[2].n_copies == 2 and got[2].n_turns == 3
    assert got[5].rendered == "<|im_start|>user\nb<|im_end|>\n" and got[9].rendered.startswith("<|im_start|>\n<|im_end|>\n")


def test_warc_reserved_names_and_open_tags(spark):
    rows = [("r1", "u", "d", "h", "a<b", "x", "y", 3, "t")]
    given = spark.createDataFrame(rows, "record_id string, target_uri string, warc_date string, http_headers string, payload string, payload_digest string, _text string, content_length long, _title string")
    out = warc.derivatives(given)
    assert len(set(out.columns)) == len(out.columns) and {r.payload_digest for r in out.collect()} == {"sha256:" + hashlib.sha256(b"a<b").hexdigest()}
    assert {r._text for r in out.collect()} == {"y"} and {r._title for r in out.collect()} == {"t"}


def test_page_texts_equal_the_patterns_and_are_linear():
    import time

    r = random.Random(5)
    parts = ["<script", "<SCRIPT>", "</script>", "<style>", "</style>", "<!--", "-->", "<p>", "<", ">", "x ", " \n", "&amp;", "&lt;", "<title>", "</title>", "<a ", "<a\n", "href=", "<a href='q'>"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        s = re.sub(r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ", t)
        s = re.sub("<[^>]*>", " ", s)
        for entity, char in warc.ENTITIES:
            s = s.replace(entity, char)
        m = re.search(r"(?is)<title[^>]*>(.*?)</title>", t)
        assert warc.text_of(t) == re.sub(r"[ \t\n\x0b\f\r]+", " ", s).strip(" "), t
        assert warc.title_of(t) == (re.sub(r"[ \t\n\x0b\f\r]+", " ", m[1]).strip(" ") if m else ""), t
        assert warc.links_of(t) == len(re.findall(r"(?i)<a\s[^>]*href=", t)), t
    began = time.time()
    for t in ("<" * 300_000, "<script>" * 60_000, "<a " * 100_000, "<title>" * 60_000, "<!--" * 90_000, "<a href=" * 50_000):
        warc.text_of(t), warc.title_of(t), warc.links_of(t)
    assert time.time() - began < 10


def test_long_conversations_are_hashed_in_linear_time():
    import time

    began = time.time()
    assert len(chat.rolling(["user"] * 200_000, ["x"] * 200_000)) == 200_000 and time.time() - began < 10


# ---- 8


def water(sizes, share=1.5, most=2):
    """Resharing round by round, as the words have it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


@pytest.mark.parametrize("per_range", [2, 50, 20_000])
def test_mixing_meets_its_targets(spark, per_range):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(0, 30), r.choice(["a", "b", "Z", "é", None, "a", "a"])) for i in range(300)]
    got = mixing.mix(docs(spark, rows), rows_per_range=per_range).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target = water(sizes)
    taken = {}
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(target[x.source]) and 0 <= x.taken <= 2 * x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert all(taken[s] == math.floor(target[s] + 1e-6) for s in sizes)
    again = mixing.mix(docs(spark, rows[::-1]).repartition(3), rows_per_range=per_range).collect()
    assert {(x.doc_id, x.taken) for x in again} == {(x.doc_id, x.taken) for x in got}
    words = {}
    for x in mixing.mixed(docs(spark, rows), rows_per_range=per_range).collect():
        words[x.doc_id] = words.get(x.doc_id, 0) + len(x.text.split())
        assert x.n_chars == len(x.text)
    assert {i: n for i, n in words.items() if n} == {x.doc_id: x.taken for x in got if x.taken}


def test_mixing_odd_rows(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and {r["size"] for r in got if r.doc_id in (1, 2, 3)} == {0}
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.count() > 0


def test_mixing_of_repeated_rows_takes_what_the_plan_has(spark):
    rows = [(5, "a b c", "s")] * 60 + [(None, "x %d y z" % i, "s") for i in range(40)] + [(None, "p q", "t")] * 30 + [(i, "w " * i, "u") for i in range(9)]
    d = docs(spark, rows).withColumns({"_mix_cuts": F.lit(1), "_mix_words": F.lit(2), "_mix_source": F.lit("q")})
    for share in (0.3, 0.9, 1.5):
        got = mixing.mix(d, share=share, rows_per_range=7).collect()
        assert len(got) == len(rows)
        plan, out = {}, {}
        for x in got:
            plan[x.source] = plan.get(x.source, 0) + x.taken
        mixed = mixing.mixed(d, share=share, rows_per_range=7)
        for x in mixed.collect():
            out[x.source] = out.get(x.source, 0) + len(x.text.split())
        assert mixed.columns == d.columns and {s: n for s, n in plan.items() if n} == {s: n for s, n in out.items() if n}


@pytest.mark.parametrize("fan", [2, 1000])
def test_sums_before_ranges_by_brute_force(spark, fan, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", fan)
    sums = [(s, p, p * 7 % 5 + 1) for s in ("a", None) for p in range(30) if p % 3]
    got = {(r.source, r._part): r._ahead for r in mixing._ahead(spark.createDataFrame(sums, "source string, _part long, _sum long")).collect()}
    assert got == {(s, p): sum(n for t, q, n in sums if t == s and q < p) for s, p, _ in sums}


def test_mixing_plan_grows_by_the_same_with_each_epoch(spark):
    """Sums of a later epoch's ranges are not taken from a plan that has the earlier epochs' in it, several times each."""
    d = docs(spark, [(i, "w " * i, "s") for i in range(9)])
    joins = [mixing.planned(d, mixing.WEIGHTS, 1.5, most, 42, 4)._jdf.queryExecution().optimizedPlan().toString().count("Join ") for most in (1, 2, 3)]
    assert joins[2] - joins[1] == joins[1] - joins[0] == 1


def test_mixing_without_words(spark):
    assert {(r.target, r.taken) for r in mixing.mix(docs(spark, [(1, "", "a"), (2, None, "b")])).collect()} == {(0.0, 0)}


# ---- 9


def components_by_brute_force(rows, n=4, percent=85):
    sets = [(i, shingle_set(t or "", n)) for i, t, _ in rows]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and ((i == j) or (x and y and 100 * len(x & y) >= percent * len(x | y))):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i if i is not None else -1, len(s), least.get(find(k), None) if i is not None else None) for k, (i, s) in enumerate(sets))


def near_copies(seed=2, groups=25, most=12):
    r = random.Random(seed)
    passage = ["p%d" % i for i in range(60)]
    rows = []
    for _ in range(groups):
        base = ["w%d" % r.randint(0, 3000) for _ in range(r.choice([2, 5, 30, 120, 400]))]
        if r.random() < 0.4:
            base = base + passage
        for _ in range(r.randint(1, most)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, len(t) // 25, len(t) // 12])):
                t[r.randrange(len(t))] = "n%d" % r.randint(0, 10**7)
            rows.append((len(rows) * 3 % 1009, " ".join(t), "s"))
    return rows


@pytest.mark.parametrize("block", [4, 500])
def test_components_by_brute_force(spark, block):
    rows = near_copies()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_components(docs(spark, rows), block=block).collect())
    assert got == components_by_brute_force(rows)
    kept = jaccard.one_of_each(docs(spark, rows), block=block)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in got}) and kept.columns == COLUMNS.replace(" long", "").replace(" string", "").split(", ")


@pytest.mark.parametrize("block", [4, 500])
def test_all_links_by_brute_force(spark, block):
    rows = near_copies() + [(2000 + i, t, s) for i, t, s in near_copies()[:9]] + [(9000, "one two three four five six", "s"), (9000, "six five four three two one", "s")]
    least = {}
    for i, t, _ in rows:
        if t:
            key = frozenset(shingle_set(t, 4))
            least[key] = min(i, least.get(key, i))
    sets = sorted(((i, s) for s, i in least.items()), key=lambda p: p[0])
    expected = sorted((i, j) for n, (j, y) in enumerate(sets) for i, x in sets[:n] if i != j and 100 * len(x & y) >= 85 * len(x | y))
    assert sorted((r.a, r.b) for r in jaccard.join_links(docs(spark, rows), block=block).collect()) == expected
    assert len(expected) > len({i for pair in expected for i in pair})


def test_pipeline_stage_links_at_five_words_and_four_fifths(spark):
    base = [["%s%d" % (k, i) for i in range(190)] for k in "abc"]
    edited = ["e%d" % i if i in (30, 70, 110, 150) else w for i, w in enumerate(base[0])]
    cut, rest = base[1][:155], base[2][:140]
    rows = [(i, " ".join(t), "s") for i, t in enumerate([base[0], edited, base[1], cut, base[2], rest])] + [(100 + i, t, s) for i, t, s in near_copies()]
    kept = sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs(spark, rows), FOLDER).collect())
    assert kept[:4] == [0, 2, 4, 5] and kept == sorted({c for _, _, c in components_by_brute_force(rows, 5, 80)})


def test_components_of_odd_rows(spark, odd):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_components(odd).collect())
    assert got == components_by_brute_force(ODD)
    assert sorted(r.doc_id or -1 for r in jaccard.one_of_each(odd).collect()) == [-1, 1, 2, 3, 5, 7, 8, 9]


def test_one_large_group_of_near_copies(spark):
    r = random.Random(1)
    base = ["w%d" % i for i in range(150)]
    rows = [(i, " ".join("n%d" % r.randint(0, 10**8) if r.random() < 0.01 else w for w in base), "s") for i in range(400)]
    links = spark.createDataFrame([(i, i % 3) for i in range(3, 900)], "a long, b long")
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.join_components(docs(spark, rows), block=40).collect())
    assert got == components_by_brute_force(rows)
    assert components.components(links).select("component").distinct().count() == 3


def test_one_id_with_two_texts(spark):
    a, b, c = ("x%d " * 30 % tuple(range(30)), "y%d " * 30 % tuple(range(30)), "z%d " * 30 % tuple(range(30)))
    rows = [(5, a, "s"), (5, b, "s"), (1, a, "s"), (7, b, "s"), (9, c, "s")]
    assert {r.doc_id: r.component_id for r in jaccard.join_components(docs(spark, rows)).collect()} == {5: 1, 1: 1, 7: 1, 9: 9}


def test_chains_and_stars_have_one_component(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}


# ---- all


@needs_tables
@pytest.mark.parametrize("name", sorted(set(queries.SQL) - {"op11_pareto"}))  # whose whole numbers may be null: test_pareto compares them as rows
def test_query_equals_its_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, FOLDER), queries.SQL[name], connect(FOLDER))


@needs_tables
def test_pipeline_stages_against_their_input(spark):
    rows = docs_of(FOLDER)
    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, d, FOLDER)
    scores = {r.doc_id: r.predicted for r in toxicity.score(d, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    kept = [r for r in rows if not scores[r[0]]]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in kept)
    assert 0.9 * len(rows) < len(kept) < len(rows)
    single = stages["ngram_jaccard_join"](spark, clean, FOLDER)
    ids = {c for _, _, c in components_by_brute_force(kept, 5, 80)}
    assert sorted(r.doc_id for r in single.collect()) == sorted(ids) and 0.5 * len(kept) < len(ids) < len(kept)
    masked = stages["personal_data"](spark, single, FOLDER)
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts.keys() == ids and any("[" in t for t in texts.values())
    for i, t, _ in kept:
        if i in ids:
            assert not pii.base_spans(texts[i]) and (texts[i] == t or "[" in texts[i])
    mix = stages["mixing"](spark, masked, FOLDER)
    assert mix.columns == d.columns
    total = sum(len(BLANK.findall(t)) for t in texts.values())
    assert abs(sum(len(BLANK.findall(r.text)) for r in mix.collect()) - 1.5 * total) <= 30
    assert stages["packing"](spark, mix, FOLDER).agg(F.count_distinct("doc_id")).first()[0] == mix.select("doc_id").distinct().count()


@needs_tables
def test_pipeline_runs(spark):
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048 and packed.select("doc_id").distinct().count() > 100


def docs_of(folder):
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()

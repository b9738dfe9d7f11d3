"""Each operator against brute force on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from lodestone.llm import decontaminate, embeddings, graph, language, mixing, near, quality, scoring, substring, suffix, warc

EXTRA = ", key string, n long, shard int"
VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def corpus(n=60, seed=0):
    """Documents with copies, near copies, shared passages, nulls, empty and long texts."""
    rng = random.Random(seed)
    words = lambda k: [rng.choice(VOCABULARY) + rng.choice(["", "s", "Ed", "é"]) for _ in range(k)]
    passage = " ".join(words(60))
    texts = [" ".join(words(rng.randint(1, 120))) for _ in range(n)]
    for i in range(0, n, 5):
        texts[i] = f"{texts[i]} {passage}\n{' '.join(words(20))}"
    for i in range(1, n - 8, 9):
        texts[i + 3] = texts[i]
        w = texts[i].split(" ")
        w[len(w) // 2] = "changed"
        texts[i + 7] = " ".join(w)
    texts += [None, "", "  \t ", "x", "be be " * 40, " ".join(words(4000)), passage.upper()]
    return list(enumerate(texts))


def table(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "k", 1, 2) for d, t in rows], f"doc_id long, text string{EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_suffix_dedup(spark, rows):
    rows = [*rows, (None, rows[5][1]), (None, rows[5][1]), (3, rows[3][1])]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.kept_sha256) for r in suffix.remove_repeats(table(spark, rows)).collect())
    want = suffix.brute(rows, 50)
    assert got == sorted((d is None, d or 0, *w, hashlib.sha256(w[3]).hexdigest()) for (d, _), w in zip(rows, want, strict=True))
    assert suffix.remove_repeats(table(spark, [])).count() == 0


def test_substring_dedup(spark, rows):
    rows = [*rows, (None, rows[5][1]), (3, rows[3][1])]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(table(spark, rows)).collect())
    want = substring.brute([t for _, t in rows], 35)
    assert got == sorted((d is None, d or 0, *w) for (d, _), w in zip(rows, want, strict=True))
    assert substring.remove_repeats(table(spark, [])).count() == 0


def test_near_dedup(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.group(table(spark, rows), per_block=4).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in near.brute(rows).items()}
    again = near.group(table(spark, [(1, "a b c"), (1, "a b c"), (None, "A B C"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in again) == [(0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True)]
    assert near.group(table(spark, [])).count() == 0


def morse(a, b, n):
    """n words of a Thue-Morse sequence, and those with both exchanged."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ["".join(b if x else a for x in bits), "".join(a if x else b for x in bits)]


def test_patterns_that_collide_in_polynomials(spark):
    """Long words of alternating letters differ for every operator that hashes words."""
    one, two = morse("a", "b", 2048)
    around = lambda w: " ".join([f"w{i}" for i in range(34)] + [w])
    rows = [(0, one), (1, two), (2, around(one)), (3, around(two)), (4, one + "c" * 60), (5, two + "c" * 60)]
    df = table(spark, rows)
    assert {r.doc_id: r.component_id for r in near.group(df).collect()} == {d: c for d, (_, c) in near.brute(rows).items()}
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(df).collect()} == dict.fromkeys(range(6), 0)
    want = [w[:3] for w in suffix.brute(rows, 50)]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix.remove_repeats(df).collect()) == [(i, *w) for i, w in enumerate(want)]
    items = spark.createDataFrame([(9, one)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.matches(df, items).collect()} == {0, 2}
    from pyspark.sql import functions as F

    known = {r.doc_id: r.n_known for r in scoring.score(df, F.col("doc_id") == 0).collect()}
    assert known == {0: 2, 1: 1, 2: 2, 3: 1, 4: 1, 5: 1}


def test_texts_longer_than_a_chunk(spark):
    """A text of 600 kB and its copies among others, and one of 20,000 words."""
    rng = random.Random(15)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(5)) for _ in range(n))
    long = words(100_000)
    rows = [(0, long), (1, words(20_000)), (2, f"x {long[:300_000]} {words(50)}"), (3, long), (4, words(30)), (5, rng.choice([long])[200_000:400_000])]
    df = table(spark, rows)
    assert {r.doc_id: r.component_id for r in near.group(df).collect()} == {d: c for d, (_, c) in near.brute(rows).items()}
    want = substring.brute([t for _, t in rows], 35)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df).collect()) == [(i, *w) for i, w in enumerate(want)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix.remove_repeats(df).collect()}
    # by hand: all of 3 and 5, the copied part of 2
    assert got[3] == (len(long), len(long), 1) and got[5] == (200_000, 200_000, 1) and got[0][1] == got[1][1] == got[4][1] == 0
    assert 300_000 <= got[2][1] <= 300_004 and got[2][2] == 1


def test_near_dedup_finds_pairs_at_the_threshold(spark):
    """Pairs of similarity 0.75 to 0.8, each of words of its own: at least 0.99 are found, and
    none below."""
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for i in range(800):
        w = [word() for _ in range(104)]
        # five shingles change with each word that stands apart from others: 100 + 100 - 2c in both
        changed = w[:]
        for j in (range(10, 10 + 30 * (2 + i % 2), 30)):
            changed[j] = word()
        tail = 3 + i % 5
        changed[-tail:] = [word() for _ in range(tail)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(changed))]
    want = {d: c for d, (_, c) in near.brute(rows).items()}
    got = {r.doc_id: r.component_id for r in near.group(table(spark, rows)).collect()}
    linked = [d for d, c in want.items() if c != d]
    assert len(linked) >= 100 and all(got[d] in (d, want[d]) for d in want)
    assert sum(got[d] == want[d] for d in linked) >= 0.99 * len(linked)


def test_near_dedup_of_many_alike(spark):
    """A chain of texts of which neighbours alone are alike."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[4 * i :] + [f"v{j}" for j in range(4 * i)])) for i in range(25)]
    got = {r.doc_id: r.component_id for r in near.group(table(spark, rows), per_block=8).collect()}
    assert got == {d: c for d, (_, c) in near.brute(rows).items()}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(5, 5)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, rows):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(k))) for i, k in enumerate((3, 8, 20, 40))]
    items += [(9, None), (10, " "), (11, " ".join(rows[5][1].split()[:30])), (11, " ".join(rows[5][1].split()[:30]))]
    w = items[3][1].split()
    w[20] = "changed"
    docs = [*rows, (100, f"start here {items[2][1].upper()} end"), (101, " ".join(w)), (102, " ".join(w[:36])), (103, items[0][1]), (104, " ".join(w[:12]))]
    df, it = table(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(df, it).collect()}
    assert got == decontaminate.brute(docs, items[:7], 0.75) and {(100, 2), (101, 3), (103, 0)} <= set(got)
    clean = decontaminate.clean(df, it)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.matches(df, it.where("item_id < 0")).count() == 0


def test_decontamination_of_items_of_one_shingle(spark):
    """Items of exactly `width` words, and of one word less and more, are found."""
    items = [(i, " ".join(VOCABULARY[i : i + k])) for i, k in ((0, 4), (4, 5), (9, 6))]
    docs = [(0, f"x y {items[1][1].upper()} z"), (1, items[1][1]), (2, " ".join(VOCABULARY[:15])), (3, "x " * 9), (4, f"{VOCABULARY[4]} x y z {VOCABULARY[8]}")]
    df, it = table(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, r.similarity) for r in decontaminate.matches(df, it).collect()}
    assert {k: v[2] for k, v in got.items()} == decontaminate.brute(docs, items, 0.75)
    assert got[0, 4] == (2, 5, 1.0) and got[1, 4] == (0, 5, 1.0) and got[2, 4] == (4, 5, 1.0)
    assert {r.doc_id for r in decontaminate.clean(df, it).collect()} == {3, 4}


def test_decontamination_of_repeated_shingles(spark):
    """An item's run of equal words that the document replaces by another such run."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items, docs = [], []
    for i in range(12):
        w = [word() for _ in range(108)]
        items.append((i, " ".join([*w, *[word()] * 17])))
        docs.append((i, " ".join([word(), *w, *[word()] * 17, word()])))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == decontaminate.brute(docs, items, 0.75) and len(got) == 12
    sh = np.array([rng.randint(0, 9) for _ in range(60)], np.uint64)
    for s in range(51):
        seen, pairs = {}, []
        for x in sh[s : s + 10].tolist():
            seen[x] = seen.get(x, 0) + 1
            pairs.append(seen[x])
        want = np.packbits(decontaminate.signs(sh[s : s + 10], np.array(pairs)).sum(0) > 0)
        assert np.array_equal(decontaminate.fingerprints(sh, np.array([s]), 10)[0], want)


def test_decontamination_of_many_items(spark, monkeypatch):
    """Thousands of items of one length, over several slices: near ones are found, memory is that
    of tiles, and every fingerprint within the radius is a candidate."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(3000)]
    docs = []
    for i in range(0, 3000, 100):
        w = items[i][1].split()
        w[rng.randrange(30)] = word()
        docs.append((i, " ".join([word() for _ in range(40)] + (w if i % 200 else items[i][1].split()) + [word()])))
    monkeypatch.setattr(decontaminate, "SLICE", 1 << 18)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == decontaminate.brute(docs, [items[i] for i, _ in docs], 0.75) and len(got) >= 15
    prints = np.random.default_rng(1).integers(0, 256, (400, 16)).astype(np.uint8)
    near = (decontaminate.NEAR[prints[:, None], prints[None]] <= decontaminate.RADIUS // decontaminate.BLOCKS).any(2)
    distance = decontaminate.NEAR[prints[:, None], prints[None]].sum(2)
    assert near[distance <= decontaminate.RADIUS].all()


def test_archive(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "x\ny", ""), (None, "n", "z"), (7, "same", "q"), (7, "same", "q")]
    rows += [(7, "same", "other"), (2, "http://b", "<p>é</p>"), (None, None, None)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n int, sha256 string").repartition(2)
    archive = warc.write(pages)
    got = warc.read(archive).collect()
    assert all(r.verified for r in got) and len(got) == 10 and len({r.record_id for r in got}) == 10
    by = {r.page_id: r for r in got}
    import base64

    assert by[1].payload_digest == base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode() and by[1].payload_bytes == 9
    assert (by[1].record_type, by[2].record_type, by[2].refers_to, by[4].refers_to) == ("response", "revisit", 1, 3)
    assert sorted(r.record_type for r in got if r.page_id == 7) == ["response", "response", "revisit"]
    assert [r.refers_to for r in got if r.record_type == "revisit"].count(3) == 2
    records = {r.page_id: warc.parse(bytes(r.record)) for r in warc.reconstruct(archive).collect()}
    assert records[1][1] == "<p>é</p>".encode() and records[2][1] == b"" and records[4][0]["WARC-Target-URI"] == "x%0Ay"
    assert archive.payloads.count() == 5
    whole = warc.read(warc.write(pages, min_bytes=2)).where("page_id in (3, 4, 7)").collect()
    assert {r.record_type for r in whole} == {"response"}
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_archive_export(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "aé\r\n\r\nb"), (2, "v", "c")], "page_id long, url string, html string")
    warc.export(warc.write(pages), str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert data.count(b"WARC/1.1\r\n") == 2 and "aé\r\n\r\nb".encode() in data


def test_quality(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(VOCABULARY) for _ in range(40))
    rows = [(i, good() if i % 3 else " ".join(w.upper() + "!!" for w in good().split())) for i in range(240)] + [(500, None), (501, "")]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(None, 1, 0), (3, None, 0)], "doc_id long, label int, text int")
    weights = quality.fit(docs, labels)
    assert np.array_equal(weights, quality.fit(docs, labels)) and not np.array_equal(weights, quality.fit(docs, labels, max_rows=50))
    got = {r.doc_id: r.score for r in quality.score(docs, weights).collect()}
    assert len(got) == 242 and all(0 <= s <= 1 for s in got.values()) and got[500] == got[501]
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in range(200, 240))
    kept = quality.keep(docs, weights)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, s in got.items() if s >= 0.5}
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    # against plain updates in the order of the sample, a document labelled twice with both
    from pyspark.sql import functions as F

    some = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(7, 0), (500, 1), (501, 0)], "doc_id long, label int")
    ordered = docs.join(some, "doc_id").orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id", "label", "text").collect()
    plain = quality.brute([(r.text, r.label) for r in ordered])
    learned = quality.fit(docs, some)
    assert {i: learned[i] for i in plain} == pytest.approx(plain, abs=1e-5) and np.count_nonzero(learned) == sum(v != 0 for v in plain.values())
    w = np.zeros((1 << quality.BITS) + 1)
    w[list(plain)] = list(plain.values())
    for r in quality.score(docs, learned).collect():
        slots = quality.features(*[(x, np.array([0, len(x)])) for x in [np.frombuffer((dict(rows)[r.doc_id] or "").encode(), np.uint8)]][0])[0]
        assert r.score == pytest.approx(1 / (1 + math.exp(-(w[-1] + w[slots].sum() * quality.SCALE / max(1, len(slots))))), abs=1e-5)
    data = np.frombuffer("Ab!! ab c--d".encode(), np.uint8)
    assert len(quality.features(data, np.array([0, len(data)]))[0]) == 3 * len(quality.tokens("Ab!! ab c--d")) == 18


def test_language(spark):
    samples = {"a": b"the cat sat on the mat and the hat", "b": b"el gato de la casa y el perro"}
    model = language.Model(samples)
    texts = [b"the cat and el gato zq 7 x", b"", b"casa mat hat hat hat the", b"zzz", "é".encode(), bytes(samples["a"])]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    assert model.phrases(data, offsets).tolist() == [[language.brute(t, s) for s in samples.values()] for t in texts]
    rng = random.Random(4)
    # phrases go on across the places where long texts are cut
    sample = bytes(rng.choice(b"abc ") for _ in range(3000))
    model = language.Model({"long": sample, "other": sample[::-1][:900], "one": b"a" * 700})
    texts = [sample[100:2900], sample[5:1400] + sample[900:2500], b"a" * 5000, bytes(rng.choice(b"abcd ") for _ in range(4000)), b"zz" * 600, sample * 3]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    want = [[language.brute(t, s) for s in (sample, b"a" * 700, sample[::-1][:900])] for t in texts]
    assert model.phrases(data, offsets).tolist() == want and want[0][0] == 1 and want[2][1] == 8
    make = lambda k: " ".join(rng.choice({"x": ["the", "and", "of", "with"], "y": ["der", "und", "mit", "von"]}[k]) + rng.choice("abc") for _ in range(30))
    rows = [(i, make("xy"[i % 2]), "xy"[i % 2]) for i in range(60)] + [(100, None, "x"), (101, "12 !", "y"), (102, make("x"), None), (103, make("y") * 300, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, language.fit(docs.where("doc_id < 40"))).collect()}
    assert all(got[d][0] == lang for d, t, lang in rows if lang and d not in (100, 101)) and got[102][0] == "x"
    assert got[100] == got[101] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs.limit(0))).collect()} == {"und"}


def test_language_ties_and_clashes(spark):
    """Equal samples: the lesser name wins with score 0.5; predictions of whole texts agree with
    plain parsing; columns named like the operator's own pass by."""
    rng = random.Random(14)
    text = lambda n: " ".join(rng.choice(["un", "deux", "trois", "quatre", "cinq"]) for _ in range(n))
    same, other = text(200), "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(1, same, "b"), (2, same, "a"), (3, other, "c"), (4, text(3000), None), (5, other[50:800] * 4, None), (6, "", None), (7, None, "a"), (4, "un", None)]
    docs = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], "doc_id long, text string, lang string, key int, letters string, h int")
    samples = language.fit(docs.where("lang is not null"), sample_bytes=2048)
    assert samples["a"] == samples["b"]
    got = sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.predict(docs, samples).collect())
    want = []
    for d, t, *_ in rows:
        cost = sorted((language.brute((t or "").encode(), s) * math.log2(len(s)), k) for k, s in samples.items())
        want.append((d, cost[0][1], round(cost[1][0] / (cost[0][0] + cost[1][0]), 9)) if t else (d, "und", 0.0))
    assert got == sorted(want) and (2, "a", 0.5) in got and {x for _, x, _ in got} == {"a", "c", "und"}


def test_many_languages(spark):
    """Every language is learned, and slices of languages agree with one model of all."""
    rng = random.Random(8)
    own = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(4)] for i in range(70)}
    text = lambda k: " ".join(rng.choice(own[k]) for _ in range(20))
    rows = [(i, text(k), k) for i, k in enumerate([*own, *list(own)[:64]])] + [(1000 + i, text(k), None) for i, k in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, samples).collect()}
    assert [got[1000 + i][0] for i in range(70)] == sorted(own)
    whole, texts = language.Model(samples), [t.encode() for _, t, _ in rows]
    cost = whole.costs(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    two = np.sort(cost, 1)[:, :2]
    assert [got[d] for d, _, _ in rows] == [(whole.names[i], s) for i, s in zip(cost.argmin(1), two[:, 1] / two.sum(1), strict=True)]


def test_language_samples(spark):
    """Samples fill up from short texts, skip blank ones and copies, and reach into long texts."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    header = "licence " * 200
    rows = [("short", f"{word()} {word()}") for _ in range(600)] + [("blank", "  12 ") for _ in range(500)] + [("blank", word())]
    rows += [("paged", header + " ".join(word() for _ in range(900))) for _ in range(40)] + [("same", header)] * 300 + [("same", word())]
    rows += [("one", " ".join(word() for _ in range(6000))), ("none", "1"), ("none", None), (None, word())]
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    got = language.fit(docs, sample_bytes=8192)
    assert sorted(got) == ["blank", "one", "paged", "same", "short"] and got == language.fit(docs.repartition(5), sample_bytes=8192)
    assert len(got["short"]) == len(got["one"]) == len(got["paged"]) == 8192
    assert got["paged"].count(b"licence ") * 8 < 8192 * 0.6
    texts = [t for k, t in rows if k == "same"]
    assert sorted(got["same"].decode().strip("\n").split("\n"), key=len)[0] == texts[-1] and got["same"].count(b"\n") == 3
    assert got["blank"].decode() == f"\n{rows[1100][1]}"


def test_ppm(spark):
    rng = np.random.default_rng(0)
    train = [bytes(rng.choice(list(b"abcD \xc3"), rng.integers(0, 40)).tolist()) for _ in range(8)]
    for order in (1, 2, 5):
        from collections import Counter

        counts = Counter()
        for t in train:
            text, _ = scoring.padded(np.frombuffer(t, np.uint8), np.array([0, len(t)]), order)
            counts.update(scoring.grams(text, order).tolist())
        trie = scoring.Trie(order, np.array(list(counts), np.uint64), np.array(list(counts.values())))
        plain = scoring.brute_ppm(train, order)
        for t in [b"", b"abc d", b"zzza", b"dcba dcba aaaa", train[0], b"ABCD"]:
            text, _ = scoring.padded(np.frombuffer(t, np.uint8), np.array([0, len(t)]), order)
            assert trie.log10(scoring.grams(text, order)).sum() == pytest.approx(plain(t), abs=1e-4)
        # all symbols after one context
        ctx = np.full(256, int.from_bytes(bytes(b"ab" * order)[:order], "big") << 8, np.uint64) | np.arange(256, dtype=np.uint64)
        assert (10 ** trie.log10(ctx)).sum() == pytest.approx(1, abs=1e-5)


def test_scoring(spark, rows):
    from pyspark.sql import functions as F

    rows = [*rows, (None, "alpha beta"), (3, rows[3][1])]
    got = scoring.score(table(spark, rows), F.col("doc_id") % 2 == 0).collect()
    low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for _, t in rows]
    learned = [w for (d, _), v in zip(rows, tokens, strict=True) if d is not None and d % 2 == 0 for w in v]
    n, v = len(learned), len(set(learned))
    plain = scoring.brute_ppm([(t or "").encode() for d, t in rows if d is not None and d % 2 == 0], 5)
    want = sorted(
        (d is None, d or 0, len(w), sum(x in set(learned) for x in w), sum(math.log10((learned.count(x) + 1) / (n + v + 1)) for x in w), plain((t or "").encode()))
        for (d, t), w in zip(rows, tokens, strict=True)
    )
    have = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
    assert all(g[:4] == w[:4] and g[4] == pytest.approx(w[4], abs=1e-6) and g[5] == pytest.approx(w[5], rel=1e-5, abs=1e-3) for g, w in zip(have, want, strict=True))
    assert {r.train_tokens for r in got} == {n}
    assert scoring.score(table(spark, []), F.lit(True)).count() == 0
    assert scoring.score(table(spark, rows), F.lit(False)).first().n_known == 0


def test_scoring_keeps_all_grams(spark):
    """More distinct n-grams than 4 million: each still counts."""
    from pyspark.sql import functions as F

    letters = np.random.default_rng(7).integers(97, 123, (140, 32_000)).astype(np.uint8)
    rows = [(i, bytes(t).decode()) for i, t in enumerate(letters)]
    counts = [scoring.grams(scoring.padded(t, np.array([0, len(t)]), 5)[0], 5) for t in letters]
    v, n = np.unique(np.concatenate(counts), return_counts=True)
    assert len(v) > 4_000_000
    trie = scoring.Trie(5, v, n)
    got = {r.doc_id: r.score for r in scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect()}
    assert got == pytest.approx({i: float(trie.log10(c).sum()) for i, c in enumerate(counts)}, rel=1e-5)


def test_pruned_trie(spark, rows):
    trie = scoring.ppm_fit(table(spark, rows), 3, max_nodes=100)
    assert len(trie.slots[trie.slots > 0]) <= 100


def linked(x, threshold=0.9):
    """Plain link counts and least members of components of vectors."""
    x = np.array(x, np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near_ = unit @ unit.T >= threshold
    np.fill_diagonal(near_, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near_, label[None, :], len(x)).min(1, initial=len(x)))
        if (new == label).all():
            return near_.sum(1), label
        label = new


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 8))
    x[40:80] = x[:40] + rng.normal(size=(40, 8)) * 0.25
    x[80:100] = x[0] * rng.uniform(0.5, 2, size=(20, 1)) + rng.normal(size=(20, 8)) * 0.02
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(200, None, 0), (201, [], 0), (202, [0.0] * 8, 0), (203, [float("nan")] * 8, 0), (204, [None] * 8, 0), (205, [1.0, 2.0], 0), (206, [1.0, 2.0], 0), (207, [float("inf")] + [0.0] * 7, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, row int").repartition(3)
    count, label = linked(x)
    for block in (16, None):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.group(df, per_block=block).collect()}
        assert all(got[i] == (count[i], label[i], label[i] == i) for i in range(120))
        assert all(got[i] == (0, i, True) for i in (200, 201, 202, 203, 204, 207)) and got[205] == (1, 205, True) and got[206] == (1, 205, False)
    assert embeddings.group(df.limit(0)).count() == 0
    assert [tuple(r) for r in embeddings.group(df.where("vec_id = 202")).collect()] == [(202, 0, 202, True)]


def test_embeddings_of_any_size(spark):
    """Components whose squares over- or underflow, null and repeated ids."""
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [1e-200, 1e-200]), (4, [5e-324, 5e-324]), (5, [1.0, 1.0]), (6, [1.7e308, -1.7e308]), (None, [1.0, 1.01]), (5, [2.0, -2.0])]
    got = sorted((r.vec_id or 99, r.n_links, r.component_id, r.kept) for r in embeddings.group(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 5, 1, True), (2, 5, 1, False), (3, 5, 1, False), (4, 5, 1, False), (5, 1, 5, True), (5, 5, 1, False), (6, 1, 5, False), (99, 5, 1, False)]


def test_embeddings_of_many_alike(spark):
    """Thousands of equal and almost equal vectors beside others, over many blocks: bounds settle
    whole groups."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 16))
    x[:1500] = x[0]
    x[1500:3000] = x[1500] + rng.normal(size=(1500, 16)) * 0.01
    x[3000:3300] = x[3000] + rng.normal(size=(300, 16)) * 0.3
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in order], "vec_id long, embedding array<float>").repartition(5)
    count, label = linked(x.astype(np.float32))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.group(df, per_block=50).collect()}
    assert all(got[i] == (count[i], label[i]) for i in range(len(x)))


def test_cover_tree():
    rng = np.random.default_rng(12)
    x = embeddings.unit(rng.normal(size=(20, 6))[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 6)) * rng.choice([0, 0.02, 0.2], 3000)[:, None])
    tree = embeddings.CoverTree(x)
    y = x[tree.order]
    assert sorted(tree.order.tolist()) == list(range(3000)) and (tree.children > 0).sum() > 1
    for i in range(len(tree.start)):
        a, b = tree.start[i], tree.end[i]
        assert embeddings.chord(y[a:b] @ y[a]).max() <= tree.radius[i] + 1e-6
        if n := tree.children[i]:
            kids = np.arange(tree.child[i], tree.child[i] + n)
            assert tree.start[kids[0]] == a and tree.end[kids[-1]] == b and (tree.start[kids[1:]] == tree.end[kids[:-1]]).all()
            assert tree.radius[kids].max() < tree.radius[i] + embeddings.slack(6)


def reshared(sizes, weights, share, repeats):
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed = {}
    while free := [s for s in names if s not in fixed]:
        rest, total = share * sum(sizes.values()) - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > repeats * sizes[s]]
        fixed |= {s: repeats * sizes[s] for s in over} if over else {s: rest * weight[s] / total for s in free}
    return fixed


def test_targets(spark):
    for sizes in ({"a": 10, "b": 100, "c": 5, "d": 50, None: 7}, {"a": 1}, {f"s{i:02}": (i * 37) % 100 + 1 for i in range(20)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        assert {r.source: r.target for r in mixing.targets(df, (5, 2, 1), 1.5, 2).collect()} == pytest.approx(reshared(sizes, (5, 2, 1), 1.5, 2))


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "b", "é", "c", None])) for i in range(400)] + [(None, "x y", "a"), (5, None, "b")]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, source string, size int, target int").repartition(3)
    for buckets in (20_000, 1):
        got = mixing.mix(docs, rows_per_bucket=buckets).collect()
        key = sorted((r.doc_id or -1, r.source or "", r.taken) for r in got)
        assert len(got) == 402 and key == sorted((r.doc_id or -1, r.source or "", r.taken) for r in mixing.mix(docs).collect())
        total = sum(r.size for r in got)
        assert total * 1.5 - 60 <= sum(r.taken for r in got) <= total * 1.5 and all(r.taken in (0, r.size, 2 * r.size) for r in got)
        for source in {r.source for r in got}:
            mine = [r for r in got if r.source == source]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 60 and mine[0].source_size == sum(r.size for r in mine)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_folds(spark, rows):
    from lodestone.llm.common import fold

    got = {r.doc_id: r.f for r in table(spark, rows).select("doc_id", fold().alias("f")).collect()}
    assert got == {d: zlib.crc32(str(d).encode()) for d, _ in rows}

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwise.llm import mixing, near_duplicates, repeats, revisits, scoring, sequences, url_filter
from shelfwise.llm.components import components
from shelfwise.llm.deep_shallow import common, deep_shallow, reaches
from shelfwise.llm.words import hash_words

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_words_are_hashed_alike_anywhere():
    words = {}
    for raw in (b"a bb\tccc\n" * 60_000, b"ccc a", b" " * 300_000 + b"bb", b"x" * 300_000 + b" a"):
        h = hash_words(raw)
        assert len(h) == len(raw.split()) and all(words.setdefault(w, x) == x for w, x in zip(raw.split(), h.tolist(), strict=True))
    assert len(set(words.values())) == len(words)


def shingle_sets(rows, size):
    for _, t in rows:
        w = SPACE.findall(low(t))
        yield {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def test_near_duplicates(docs, rows, empty):
    for size in (2, 5):
        sets = list(shingle_sets(rows, size))
        parent = list(range(len(rows)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    parent[root(a)] = root(b)
        least = {}
        for k, (i, _) in enumerate(rows):
            if i is not None:
                least[root(k)] = min(least.get(root(k), i), i)
        want = Counter((i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows) if i is not None)
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs, size=size).collect() if r.doc_id is not None)
        assert got == want
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_near_duplicates_in_a_crowd(spark):
    """A group in which most links go through one text, with blocks of a few classes."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 150)]
    texts = []
    for k in range(60):
        own = list(base)
        for at in rng.choice(150, rng.integers(1, 22), replace=False):
            own[at] = f"z{k}_{at}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    sets = list(shingle_sets(rows, 2))
    links = [(a, b) for a in range(60) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    parent = list(range(60))
    for a, b in links:
        old, new = parent[a], parent[b]
        parent = [min(old, new) if x in (old, new) else x for x in parent]
    before, near_duplicates.BLOCK = near_duplicates.BLOCK, 4
    try:
        got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()}
    finally:
        near_duplicates.BLOCK = before
    assert got == dict(enumerate(parent))


def test_overlaps():
    rng = np.random.default_rng(6)
    a, b = ([np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in rng.integers(1, 900, k)] for k in (7, 9))
    assert near_duplicates.overlaps(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_components(spark):
    rng = np.random.default_rng(7)
    pairs = [(k, k + 1) for k in range(0, 40)] + [tuple(map(int, rng.integers(100, 200, 2))) for _ in range(90)] + [(300, x) for x in range(301, 340)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(parent[a], parent[b])
            changed |= parent[a] != m or parent[b] != m
            parent[a] = parent[b] = m
    assert got == {x: r for x, r in parent.items() if x != r}


def test_deep_shallow_order_and_reaches():
    rng = np.random.default_rng(8)
    for n in (2, 3, 9, 60):
        base = bytes(rng.choice(list(b"ab"), 300).tolist())

        def changed():
            x = bytearray(base)  # noqa: B023
            for _ in range(rng.integers(0, 4)):
                x[rng.integers(10, 300)] = rng.choice(list(b"abc"))
            return bytes(x[: rng.choice([300, 300, 180])])

        lefts, rights = [changed() for _ in range(n)], [changed() for _ in range(n)]
        order, shared = deep_shallow(rights, 10)
        assert [rights[i] for i in order] == sorted(rights) and shared[1:] == [common(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
        for span, got in zip((250, 120), reaches(lefts, rights, (250, 120), 10), strict=True):
            want = [(0, 0)] * n
            for i in range(n):
                for j in range(n):
                    a, b = common(lefts[i], lefts[j]), common(rights[i], rights[j])
                    if i != j and a + b >= span:
                        want[i] = (max(want[i][0], a), max(want[i][1], b))
            assert list(zip(*got, strict=True)) == want


def removed(raws, span):
    """Which bytes of each text are covered by a string of so many bytes that also starts elsewhere."""
    seen = Counter(r[k : k + span] for r in raws for k in range(len(r) - span + 1))
    for r in raws:
        edge = np.zeros(len(r) + 1, int)
        for k in range(len(r) - span + 1):
            if seen[r[k : k + span]] > 1:
                edge[k] += 1
                edge[k + span] -= 1
        yield np.cumsum(edge[:-1]) > 0


def test_repeats(docs, rows, empty):
    raws = [(t or "").encode() for _, t in rows]
    for span, passage, most in ((400, 200, 50_000), (400, None, 50_000), (120, 70, 50_000), (120, 70, 1), (120, None, 1)):
        want = Counter()
        for (i, _), r, gone, short in zip(rows, raws, removed(raws, span), removed(raws, passage or span), strict=True):
            want[i, len(r), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), int(short.sum()), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()] += 1
        cut = repeats.cut_repeats(docs, span=span, passage=passage, most=most)
        assert cut.columns == [*docs.columns, "cut_2"]
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.n_passage_bytes, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in cut.select("doc_id", "cut_2.*").collect())
        assert got == want
    assert repeats.cut_repeats(empty, passage=200).count() == 0


def test_spelling_is_a_distribution():
    """Over all continuations of a short word: the probabilities of its ends and of its longer forms add up, in each group."""
    words, groups = [b"the", b"then", b"than", b"a", b"an", b"ant", b"der", b"den"] * 3, np.array([0, 0, 0, 0, 0, 0, 1, 1] * 3)
    counts = mixing.count_bits(words, groups)
    bits = 8 * sum(len(w) + 1 for w in words)
    assert (counts.sum(axis=1) == bits).all()
    model = mixing.Mixer()
    model.train(words, groups, mixing.without_own(counts))
    p = lambda own: model.log_probabilities(own, [0, 1], mixing.predictions(counts))
    every = [b"th" + bytes([c]) for c in range(256) if c != 32]
    total = np.exp(p([b""] + [bytes([c]) for c in range(256) if c != 32])).sum(axis=0)
    assert (total > 0).all() and (total < 1).all() and (np.exp(p(every)).sum(axis=0) < 1).all()
    own = p([b"then", b"zzzq", b"der"])
    assert own[0, 0] > own[1, 0] and own[2, 1] > own[2, 0]


def test_scores(docs, rows, empty):
    from pyspark.sql import functions as F

    held = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 2
    got = scoring.score_texts(docs, held, class_col="lang").toPandas()
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*SPACE.findall(low(t)), ""]) for i, t in rows]
    c = Counter(w for i, own in tokens if not is_held(i) for w in own)
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, is_held(i), len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), 6)) for i, own in tokens)
    assert sorted((-1 if pd.isna(r.doc_id) else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples()) == want
    assert (got.score < 0).all() and got.score.notna().all()
    assert scoring.score_texts(empty, F.lit(False)).count() == 0
    assert scoring.score_texts(docs.where("doc_id < 4"), F.lit(True)).where("n_known > 0").count() == 0


def test_scores_of_buckets_in_shares(docs, rows, monkeypatch):
    """Twenty chunks, of which three rows of a bucket meet in a group: counts and base scores stay, and scores move only with the order of training."""
    def scores():
        return sorted(tuple(r) for r in scoring.score_texts(docs.where("doc_id is not null").repartition(20), F.col("doc_id") % 7 == 2).collect())

    whole = scores()
    monkeypatch.setattr(scoring, "FAN", 3)
    split = scores()
    assert [r[:5] for r in split] == [r[:5] for r in whole] and len(whole) == sum(doc is not None for doc, _ in rows)
    assert [r[5] for r in split] == pytest.approx([r[5] for r in whole])
    assert [r[6] for r in split] == pytest.approx([r[6] for r in whole], rel=0.05)


def test_urls(spark):
    pages = [(1, "http://a.org/x", '<a href="http://b.net/">'), (2, "http://b.net/", "<a href=//c.net/q>"), (3, "http://c.net/1", None), (4, "http://e.net/1", "<A HREF='http://d.com/de/x'>"), (5, "http://D.com/de/x?a/b", ""), (6, None, None), (7, "nourl", "x"), (8, "https://www.example.org/en/12#t", None), (8, "https://www.example.org/en/2", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).select("page_id", "judged.*").collect()), key=lambda x: x[:3])
    assert [x[:3] + x[4:] for x in got] == [(1, "a.org", "/x", "allow"), (2, "b.net", "/", "allow"), (3, "c.net", "/1", "allow"), (4, "e.net", "/1", "block"), (5, "d.com", "/de/x", "block"), (6, "", "", "allow"), (7, "", "", "allow"), (8, "www.example.org", "/en/12", "block"), (8, "www.example.org", "/en/2", "allow")]
    assert {x[0]: x[3] for x in got if x[0] < 8} == {1: "org/", 2: None, 3: None, 4: None, 5: "com/de/", 6: None, 7: None}
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "url as judged", "page_id as host", "html as __host")
    assert url_filter.judge_urls(clash).columns == [*clash.columns, "judged_2"]


def test_spread_against_plain_iteration(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b), int(n)) for a, b, n in zip(rng.integers(0, 12, 40), rng.integers(0, 12, 40), rng.integers(1, 5, 40), strict=True) if a != b]
    m = np.zeros((12, 12))
    for a, b, n in edges:
        m[a, b] += n
    seeds = np.zeros((12, 2))
    seeds[0, 0] = seeds[5, 1] = 1
    links = spark.createDataFrame([(str(a), str(b), float(m[a, b])) for a in range(12) for b in range(12) if m[a, b]], "source string, target string, links double")
    seeds_df = spark.createDataFrame([(str(k), float(a), float(b)) for k, (a, b) in enumerate(seeds)], "host string, trust double, distrust double")
    out, into = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-9), (m / np.maximum(m.sum(axis=0, keepdims=True), 1e-9)).T
    for rounds, within in ((4, 1e-6), (None, 1e-4)):
        got = url_filter.spread(links, seeds_df, tolerance=1e-5 if rounds is None else 0.0, rounds=rounds)
        t, d = 0.15 * seeds[:, 0], 0.15 * seeds[:, 1]
        for _ in range(rounds or 500):
            t, d = 0.15 * seeds[:, 0] + 0.85 * out.T @ t, 0.15 * seeds[:, 1] + 0.85 * into.T @ d
        for r in got.collect():
            assert abs(r.trust - t[int(r.host)]) < within and abs(r.distrust - d[int(r.host)]) < within


def test_revisits(spark):
    t = lambda s: datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=s)
    records = [
        (1, "response", "http://A.com/x/", t(10), {"etag": '"1"', "content-type": "a"}), (2, "response", "https://www.a.com/x?utm_source=q", t(20), {"etag": '"2"', "date": "d0"}), (3, "response", "http://a.com:80/x#f", t(20), {"last-modified": "m"}),
        (4, "revisit", "http://a.com/x", t(15), {"etag": 'W/"1"', "date": "d1", "content-length": "0"}), (5, "revisit", "http://a.com/x", t(20), {"etag": '"9"'}), (6, "revisit", "http://a.com/x", t(30), {"last-modified": "m"}),
        (7, "revisit", "http://a.com/x", t(31), {}), (8, "revisit", "http://a.com/x", t(10), {"etag": '"1"'}), (9, "revisit", None, t(40), None), (10, "revisit", "http://a.com/x?b=2&a=1", t(40), {}), (11, "response", "http://a.com/x?a=1&ref=z&b=2", t(39), None), (4, "revisit", "http://a.com/x", t(15), {"etag": 'W/"1"', "date": "d1", "content-length": "0"}),
    ]
    df = spark.createDataFrame(records, "record_id long, kind string, url string, ts timestamp, headers map<string,string>")
    got = Counter((r.record_id, r.response_id, r.status, tuple(sorted((r.headers or {}).items()))) for r in revisits.resolve(df).collect())
    merged = (("content-type", "a"), ("date", "d1"), ("etag", 'W/"1"'))
    assert got == Counter([(4, 1, "resolved", merged), (4, 1, "resolved", merged), (5, 1, "mismatch", ()), (6, 3, "resolved", (("last-modified", "m"),)), (7, 3, "unverified", ()), (8, None, "orphan", ()), (9, None, "orphan", ()), (10, 11, "unverified", ())])
    assert revisits.resolve(df.limit(0)).count() == 0


def test_stages_of_odd_tables(spark, docs, rows, empty):
    """Nulls, blank and repeated rows, repeated ids and clashing names, against brute force; empty tables."""
    from shelfwise.llm import packing

    raws = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, t), r, gone in zip(rows, raws, removed(raws, repeats.PASSAGE), strict=True):
        if not r or not gone.all():
            at, left = 0, ""
            for c in t or "":
                n = len(c.encode())
                left += c * (not gone[at : at + n].any())
                at += n
            want[i, left if t is not None else None] += 1
    kept = repeats.stage(spark, docs, "")
    assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == want

    sets, parent = list(shingle_sets(rows, 5)), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = parent[a], parent[b]
                parent = [min(old, new) if x in (old, new) else x for x in parent]
    least = {root: min((rows[k][0] for k, x in enumerate(parent) if x == root and rows[k][0] is not None), default=None) for root in set(parent)}
    want = Counter((i, t) for k, (i, t) in enumerate(rows) if i is None or not sets[k] or i == least[parent[k]])
    kept = near_duplicates.stage(spark, docs, "")
    assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == want
    twice = spark.createDataFrame([(1, rows[0][1]), (2, rows[0][1]), (2, rows[1][1]), (3, rows[1][1] + " more")], "doc_id long, text string")
    assert Counter((r.doc_id, r.text[:20]) for r in near_duplicates.stage(spark, twice, "").collect()) == Counter([(1, rows[0][1][:20]), (2, rows[1][1][:20])])

    assert packing.stage(spark, docs, "").select("doc_id").distinct().count() == len({i for i, _ in rows})
    for stage in (repeats.stage, near_duplicates.stage, packing.stage):
        assert stage(spark, empty, "").count() == 0


def test_pipeline_stages(spark, rows, tmp_path):
    data = [(i, t, "en", "s", len(t or "")) for i, t in rows if i is not None]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(dict(rows)[1].split()[5:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeats", "decontamination", "packing"]
    assert set(range(2, 12)) <= set(got.doc_id) and not {21, 22, 32, 40, 41, 43, 47} & set(got.doc_id)


def test_scores_depend_on_the_order_of_tokens(spark):
    """The same words in the order of the training texts and shuffled: only what sees the tokens before tells them apart."""
    sentence = [f"w{k}" for k in range(40)]
    mixed = random.Random(3).sample(sentence, 40)
    rows = [(i, " ".join(sentence[i % 7 :] + sentence[: i % 7])) for i in range(60)] + [(100, " ".join(sentence)), (101, " ".join(mixed))]
    got = {r.doc_id: r.score for r in scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 100).collect()}
    assert got[100] > got[101] + 10


def test_bits_of_tokens_are_a_distribution():
    """At one place, over all cells and the unknown word, probabilities add up to 1; each token of a text is counted, not each distinct word."""
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 32, 50, dtype=np.uint64).astype(np.uint32)
    text = words[rng.integers(0, 50, 3000) * rng.integers(0, 2, 3000)]
    first = np.arange(3000) % 100 == 0
    tokens = sequences.Tokens(text, rng.random(3000) < 0.9, first, (np.arange(3000) // 300 % 3).astype(np.uint8))
    counts = sequences.count_bits(tokens)
    assert (counts.sum(axis=1) == 3000 + sequences.CELL_BITS * tokens.known.sum()).all()
    model = sequences.Mixer()
    model.train(tokens, sequences.without_own(counts))
    every = (np.arange(sequences.CELLS + 1, dtype=np.uint64) << np.uint64(32 - sequences.CELL_BITS)).astype(np.uint32)
    n = len(every)
    ends = sequences.Tokens(np.stack([np.full(n, words[0]), every], axis=1).ravel(), np.stack([np.ones(n, bool), np.arange(n) < n - 1], axis=1).ravel(), np.tile([True, False], n), np.zeros(2 * n, np.uint8))
    total = np.exp(model.log_probabilities(ends, sequences.predictions(counts))[1::2]).sum()
    assert total == pytest.approx(1, abs=1e-3)


def _some_tokens(n: int) -> sequences.Tokens:
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 32, 60, dtype=np.uint64).astype(np.uint32)
    first = rng.random(n) < 0.02
    first[0] = True
    return sequences.Tokens(words[rng.integers(0, 60, n) * rng.integers(0, 2, n)], rng.random(n) < 0.9, first, (np.arange(n) // 300 % 3).astype(np.uint8))


def test_slots_of_tokens_are_counted_plainly():
    """Each token's bits one by one: the predictors that see no word before are counted by their few nodes, the others token by token; a token's eleven bits lie in four groups of
    neighbouring slots for each predictor, so that its walk through a table meets four places of memory, not eleven."""
    tokens, want = _some_tokens(9000), Counter()
    few, lines = sequences.few_slots(3), [[set() for _ in range(9000)] for _ in range(sequences.PREDICTORS)]
    done = 0
    for part in tokens.parts(4000):
        for _, at, bit, node, classes, slots in sequences._bits(*part):
            for i, t in enumerate((np.arange(len(part[0])) + done)[at].tolist()):
                own = [int(few[0][0, node[i]]), int(few[1][classes[i], node[i]]), int(slots[0, i]), int(slots[1, i])]
                for k, slot in enumerate(own):
                    want[k, slot, int(bit[i])] += 1
                    lines[k][t].add(slot >> sequences.NEAR)
        done += len(part[0])
    counts = sequences.count_bits(tokens).reshape(sequences.PREDICTORS, sequences.SLOTS, 2)
    assert {(k, s, b): int(counts[k, s, b]) for k, s, b in np.argwhere(counts).tolist()} == dict(want)
    assert max(len(x) for own in lines for x in own) <= 4


def test_probabilities_of_tokens_equal_plain_ones():
    """Bit by bit in 64-bit floats, each predictor looked up by itself."""
    tokens = _some_tokens(9000)
    counts = sequences.count_bits(tokens)
    model, table = sequences.Mixer(), sequences.predictions(counts)
    model.train(tokens, sequences.without_own(counts))
    few, levels = sequences.few_slots(3), np.linspace(-8, 8, sequences.LEVELS)
    centre = 1 / (1 + np.exp(-levels))
    seen, ones = model.refine[:, :, 1], model.refine[:, :, 0]
    refined, want = np.log((ones + 2 * centre) / (seen - ones + 2 * (1 - centre))), []
    for part in tokens.parts(4000):
        own = np.zeros(len(part[0]))
        for gate, at, bit, node, classes, slots in sequences._bits(*part):
            x = np.stack([table[0][few[0][0, node]], table[1][few[1][classes, node]], table[2][slots[0]], table[3][slots[1]], np.ones(len(bit))])
            mixed = np.clip(model.weights[gate] @ x, -12, 12)
            final = (mixed + refined[gate][np.floor((np.clip(mixed, -8, 8) + 8) * 2 + 0.5).astype(int)]) / 2
            own[at] -= np.log1p(np.exp(np.where(bit == 1, -final, final)))
        want.append(own)
    off = np.abs(model.log_probabilities(tokens, table) - np.concatenate(want))
    assert np.mean(off < 1e-4) > 0.99  # the others stand between two levels of the map


def test_tables_of_tasks_are_summed_once(spark):
    """Up to 64 tasks' tables meet in one group a block; the sum is that of all batches."""
    from shelfwise.llm import tables

    met, size = spark.sparkContext.accumulator(0), 1 << 17
    added = tables._added

    def counted(rows):
        met.add(len(rows))
        return added(rows)

    def count(batch, total):
        total += np.bincount(batch["id"], minlength=size).astype(np.int32)

    tables._added, before = counted, tables._added
    try:
        got = tables.summed(spark.range(0, 30, 1, 10), count, size)
    finally:
        tables._added = before
    assert (got == np.bincount(np.arange(30), minlength=size)).all()
    assert met.value <= 2 * 11 * (size >> 16)  # 10 tables and their sum in each of two blocks; a second run of a stage is allowed for

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import zstandard

from shelfwise.llm import decontamination, licences, packing, quality, tokens, wavelet

SPACE, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def collected(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_quality_counts(docs, rows, empty):
    want = Counter()
    for i, t in rows:
        t = t or ""
        words, lines = SPACE.findall(t), [x for x in t.split("\n") if SPACE.search(x)]
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        n, again = Counter(windows), set()
        for k, w in enumerate(windows):
            if n[w] > 1:
                again |= set(range(k, k + 5))
        want[i, len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(words) < 10 or 100 * len(again) > 20 * len(words)] += 1
    got = quality.judge(docs)
    assert collected(got, "doc_id", *[f"quality_signals.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]) == want
    assert set(got.columns) == {*docs.columns, "quality_signals"}
    assert quality.judge(empty).count() == 0


def test_quality_bands():
    rng = np.random.default_rng(1)
    squeeze = quality.zstandard.ZstdCompressor(level=3)
    assert quality.verdict(rng.bytes(5000), squeeze)[3] == "incompressible"
    assert quality.verdict(b"the same line again\n" * 300, squeeze)[3] == "repetitive"
    half = " ".join(f"word{x}" for x in rng.integers(0, 10**6, 4000)).encode() + b"x" * 60_000
    assert quality.verdict(half, squeeze)[3] in ("repetitive chunks", "repetitive")
    assert quality.verdict(" ".join(f"word{x}" for x in rng.integers(0, 10**4, 900)).encode(), squeeze)[3] == "repetitive"
    for n in (20, 255):
        assert quality.band(n) == (0.0, np.inf)
    for n, least, most in quality.BANDS:
        assert quality.band(n) == pytest.approx((least, most))
    assert quality.BANDS[2][1] > quality.band(600)[0] > quality.BANDS[3][1]


def open_prose(rng, words):
    """Words of which a third are among sixty common ones and the others are new, as in texts with a long tail."""
    letters = list("eeeeeettttaaaooiinnsshhrrddllcumwfgypbvk")
    word = lambda: "".join(rng.choice(letters, rng.integers(2, 11)))
    common = [word() for _ in range(60)]
    return [common[min(59, int(rng.exponential(12)))] if rng.random() < 0.33 else word() for _ in range(words)]


@pytest.mark.parametrize("words", [400])
def test_quality_bands_decide_what_the_base_rule_keeps(words):
    """Words that carry rows of symbols: no window of five words comes back, but they squeeze better than any prose does, licences included."""
    rng = np.random.default_rng(words)
    plain = open_prose(rng, words)
    with_symbols = [w + "*$%&"[len(w) % 4] * 8 for w in plain]
    for text, kept in ((" ".join(plain), True), (" ".join(with_symbols), False)):
        r = quality.signals_of(quality.pd.Series([text])).iloc[0]
        assert not r.base_failed and bool(r.kept) == kept, (r.whole_ratio, r.reason)


@pytest.mark.parametrize("size", [500, 1000, 3000, 20_000])
def test_quality_of_encoded_and_half_repeated_texts(size):
    rng = np.random.default_rng(size)
    squeeze = quality.zstandard.ZstdCompressor(level=3)
    words = " ".join(open_prose(rng, 6000)).encode()
    assert quality.verdict(words[:size], squeeze)[3] is None
    raw = rng.bytes(size)
    assert quality.verdict(base64.encodebytes(raw)[:size], squeeze)[3] == "incompressible"
    in_hex = "\n".join(raw.hex()[i : i + 64] for i in range(0, 2 * size, 64)).encode()[:size]
    assert quality.verdict(in_hex, squeeze)[3] == ("incompressible" if size >= 3072 else None)  # shorter hex has the ratios of prose
    assert (quality.verdict(words[: size * 6 // 10] + b"=-" * (size * 2 // 10), squeeze)[3] or "").startswith("repetitive")


def plain_judge(raw):
    """Kept or not by the bands, from their definition."""

    def limits(n):
        if n < quality.BANDS[0][0]:
            return 0.0, math.inf
        below = [b for b in quality.BANDS if b[0] <= n][-1]
        above = next((b for b in quality.BANDS if b[0] > n), below)
        part = 0.0 if above is below else (math.log2(n) - math.log2(below[0])) / (math.log2(above[0]) - math.log2(below[0]))
        return tuple(below[k] + part * (above[k] - below[k]) for k in (1, 2))

    def ratio(x):
        return len(zstandard.ZstdCompressor(level=3).compress(x)) / len(x)

    def large(x):
        entropy = -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values()) / 8
        most = 1.0 if len(x) >= 4096 else 1.02 if len(x) >= 3072 else math.inf
        return ratio(x) > limits(len(x))[1] or ratio(x) > most * entropy

    if not limits(len(raw))[0] <= ratio(raw) or large(raw):
        return False
    chunks = [raw[k : k + 4096] for k in range(0, len(raw), 4096)] if len(raw) > 4096 else []
    small = sum(len(c) for c in chunks if ratio(c) < limits(len(c))[0] - 0.07)
    return 4 * small <= len(raw) and 4 * sum(len(c) for c in chunks if large(c)) <= len(raw)


def test_quality_verdicts_against_a_plain_judge(docs, rows):
    rng = np.random.default_rng(12)
    squeeze = quality.zstandard.ZstdCompressor(level=3)
    texts = [t.encode() for _, t in rows if t]
    for n in (200, 256, 300, 700, 1500, 3000, 3500, 4096, 4097, 9000, 40_000):
        words = " ".join(open_prose(rng, n // 4)).encode()[:n]
        texts += [words, rng.bytes(n).hex().encode()[:n], rng.bytes(n), words[: n // 2] + b"la la " * (n // 10), words[: n * 2 // 3] + rng.bytes(n // 3), b"".join(w + b"###" for w in words.split())]
    lexicon = open_prose(rng, 400)
    plain = " ".join(lexicon[k] for k in rng.integers(0, 400, 12_000)).encode()
    texts += [words[:28_000] + b"la la lu " * 1_300, plain[:29_500] + base64.b64encode(rng.bytes(8_000))]
    verdicts = [quality.verdict(raw, squeeze)[3] for raw in texts]
    assert [v is None for v in verdicts] == [plain_judge(raw) for raw in texts] and len({*verdicts}) == 5
    got = quality.judge(docs).where("not quality_signals.base_failed").select("text", "quality_signals.kept").collect()
    assert len(got) > 20 and all(r.kept == plain_judge(r.text.encode()) for r in got)


def test_quality_keeps_licences():
    """Real prose, and the most regular there is: the licences that this machine has."""
    found = [p for p in Path("/usr/share/common-licenses").glob("*") if p.is_file() and p.stat().st_size > 1000]
    kept = {p.name: quality.signals_of(quality.pd.Series([p.read_text(encoding="utf-8", errors="replace")])).iloc[0] for p in found}
    assert all(r.kept for r in kept.values() if not r.base_failed), {n: (r.reason, r.whole_ratio) for n, r in kept.items() if not r.kept}


def test_blocks_of_items_are_bounded(spark):
    """One item repeated very often is one; blocks stay within twice their size, whatever the hash does."""
    items = [(1, "a b c d e f g h i j k")] * 500 + [(k, " ".join(f"w{k}x{i}" for i in range(1 + k % 37))) for k in range(2, 400)] + [(1000, " ".join(f"long{i}" for i in range(1000)))]
    df = spark.createDataFrame(items, "item_id long, text string")
    for most in (40, 100, 5000):
        blocks, rows = decontamination.item_blocks(df, "item_id", "text", most, 10)
        sizes = Counter()
        for r in rows.collect():
            sizes[r.block] += len(ALNUM.findall(low(r.text)))
        assert max(sizes.values()) <= 2 * most and len(sizes) <= blocks and sum(1 for r in rows.collect() if r.item == "1") == 1


def test_quality_stage_keeps_columns(docs, spark):
    kept = quality.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()}.isdisjoint({40, 41, 42, 43, 32})


def hits(items, text, window=10):
    table = {}
    for name, t in items:
        w = ALNUM.findall(low(t))
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            table.setdefault(tuple(w[k : k + m]), set()).add("null" if name is None else str(name))
    words = ALNUM.findall(low(text))
    hit, found = [False] * len(words), set()
    for m in {len(x) for x in table}:
        for k in range(len(words) - m + 1):
            own = table.get(tuple(words[k : k + m]))
            if own:
                found |= own
                hit[k : k + m] = [True] * m
    return words, sum(hit), found


@pytest.mark.parametrize("block_words", [10**6, 40])
def test_decontamination(spark, rows, docs, empty, block_words):
    text = dict(rows)
    items = [(1, " ".join(text[1].split()[5:30])), (2, " ".join(text[2].split()[3:14]).upper()), (3, "one two"), (4, None), (5, ""), (None, " ".join(text[3].split()[:12])), (6, " ".join(text[1].split()[10:25]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_items(docs, bench, block_words=block_words)
    assert found.columns == [*docs.columns, "hits_2"]
    got = Counter((r.doc_id, r.n, r.h, ",".join(r.i)) for r in found.select("doc_id", decontamination.F.col("hits_2.n_words").alias("n"), decontamination.n_hit("hits_2").alias("h"), decontamination.F.col("hits_2.items").alias("i")).collect())
    want = Counter()
    for i, t in rows:
        words, n, own = hits(items, t)
        want[i, len(words), n, ",".join(sorted(own))] += 1
    assert got == want
    cleaned = decontamination.decontaminate(docs, bench, max_coverage=1.0, block_words=block_words)
    assert cleaned.columns == docs.columns
    assert all(hits(items, r.text)[1] == 0 for r in cleaned.where("doc_id in (1, 2, 3)").collect())
    assert cleaned.where("doc_id = 4").first().text == text[4]
    assert decontamination.find_items(empty, bench, block_words=block_words).count() == 0
    assert decontamination.find_items(docs, bench.limit(0)).where("size(hits_2.items) > 0").count() == 0


@pytest.mark.parametrize(("name", "split"), [("byte_bpe_50k.json", "space-led"), ("word_bpe_49k.json", "white space")])
def test_cached_tokens_are_the_librarys(rows, name, split):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = tokens.CachedTokenizer(public_tokenizers.path(name), split, most=150)
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    texts = [t for _, t in rows if t] + ["a  b", "x́ J̌ H̱", " lead", "trail ", "it's 's don't... what?! 3.5, a1,", "日本語 テキスト。", "a \x85b c", "é. x**y !!! a!!b??"]
    for _ in range(2):
        for t in texts:
            assert own.encode([t])[0].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    got = packing.pack(docs, with_ids=True).toPandas()
    for doc, text in {i: t for i, t in rows if i is not None and i != 47}.items():
        own = got[got.doc_id == doc].sort_values("start")
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in own.ids])
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids + [1]
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
        assert (own.doc_tokens == len(ids)).all() and own.ids_crc32.tolist() == [zlib.crc32(x) for x in own.ids]
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        total = own.length.sum()
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and total <= 2048 and total & (total - 1) == 0
    assert packing.pack(empty).count() == 0


def test_sum_of_squares_choice():
    packer = packing.SumOfSquares(width=12)
    rng = np.random.default_rng(2)
    for size in rng.integers(1, 12, 400).tolist():
        n = packer.counts.copy()
        costs = {h: 2 * (n[h + size] - n[h] + 1) if h + size < 12 else 1 - 2 * n[h] for h in range(1, 12 - size + 1) if n[h]}
        costs[0] = 2 * n[size] + 1
        assert costs[packer.level(size)] == min(costs.values())
        list(packer.place(packing.Piece(0, 0, np.zeros(size, np.uint32), size)))


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 300, 9000), np.zeros(5, int), np.array([], int), rng.integers(0, 60_000, 3000)):
        w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
        assert (w.decode() == ids).all()
        for i in range(0, len(ids), 701):
            c = int(ids[i])
            assert w.access(i) == c and w.rank(c, i) == (ids[:i] == c).sum() and w.select(c, int((ids[:i] == c).sum())) == i
            assert (w.occurrences(c) == np.flatnonzero(ids == c)).all()
        assert w.count(70_000) == 0


def test_shards(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    shards = wavelet.write_shards(docs, shard_tokens=2000)
    got = wavelet.read_shards(shards).join(wavelet.shard_starts(shards), ["part", "shard"]).toPandas()
    got["start"] = got.base + got.within
    got = got.sort_values("start")
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]] and got.doc_id.dropna().is_monotonic_increasing and got.doc_id.isna()[:2].all()
    for doc, text in {i: t for i, t in rows if i is not None}.items():
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = got[got.doc_id == doc]
        assert set(own.n_tokens) == {len(ids)} and set(own.ids_crc32) == {zlib.crc32(ids.tobytes())}
    assert wavelet.read_shards(wavelet.write_shards(empty)).count() == 0


def test_licences(docs, rows, empty):
    got = {(r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()): r for r in licences.scan(docs).select("doc_id", "text", "licence_2.*").collect()}
    for i, t in rows:
        words, starts, labels = ALNUM.findall(low(t)), [], set()
        for phrase, label in licences.PHRASES:
            p = phrase.split()
            own = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            starts, labels = starts + own, labels | ({label} if own else set())
        r = got[i, hashlib.md5((t or "").encode()).hexdigest()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert next(r for (i, _), r in got.items() if i == 50).labels == "apache,apache-2.0"
    assert licences.scan(empty).count() == 0


def filler(rng, words):
    return " ".join(rng.choices(["alpha", "beta", "software", "the", "license", "version", "été"], k=words))


def plain_licences(texts):
    """(labels, score) of each text: every place of every template is tried."""
    words = [ALNUM.findall(low(t)) for t in texts]
    seen = Counter(w for own in words for w in set(own))

    def stands(own, phrase):
        p = phrase.split()
        return any(own[i : i + len(p)] == p for i in range(len(own) - len(p) + 1))

    for own in words:
        labels, score = {label for x, label in licences.PHRASES if stands(own, x)}, 0.0
        for label, must, notice in licences.TEMPLATES:
            template = notice.split()
            rare = sorted(set(template), key=lambda w: (seen[w], w))[: licences.TERMS]
            places = [i for i, w in enumerate(template) if w in rare]
            best = max((sum(0 <= s + i < len(own) and own[s + i] == template[i] for i in places) for s in range(-len(template), len(own))), default=0) / len(places)
            if best >= licences.ENOUGH and all(stands(own, x) for x in must):
                labels, score = labels | {label}, max(score, best)
        yield ",".join(sorted(labels)), score


def test_licences_against_a_plain_matcher(spark):
    """Notices whole, cut short at either end, with words changed or put in between, twice, beside each other, and without a mandatory phrase."""
    rng = random.Random(5)
    texts = [None, "", "License", filler(rng, 200)]
    for _, _, notice in licences.TEMPLATES:
        words = notice.split()
        changed = [rng.choice(["other", w, w, w]) for w in words]
        split = words[: len(words) // 2] + ["inserted"] + words[len(words) // 2 :]
        for own in (words, words[: 2 * len(words) // 3], words[len(words) // 3 :], changed, split, words + words[::-1] + words):
            texts.append(filler(rng, 10) + "\n" + " ".join(own).title() + ". " + filler(rng, 5))
    texts += [" ".join(rng.choice(licences.TEMPLATES)[2] for _ in range(3)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.licence for r in licences.scan(df).collect()}
    for i, (labels, score) in enumerate(plain_licences(texts)):
        assert (got[i].labels, got[i].score) == (labels, pytest.approx(score)), texts[i]


def test_licences_beside_each_other(spark):
    """Each notice is found whatever else the text holds, and not by a few of its words."""
    notices = {t: t[2] for t in licences.TEMPLATES}
    bsd, nc, mpl = (next(n for (label, _, _), n in notices.items() if label == x) for x in ("bsd-3-clause", "cc-by-nc-4.0", "mpl-2.0"))
    texts = [f"{bsd}. {nc}", f"{bsd}\n{mpl}\n{nc}", "\n".join(notices.values()), "the mozilla public license", "x " * 3000 + mpl + " redistribution forms permitted provided conditions modification" * 3]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "licence.*").collect()}
    assert [set(got[k].labels.split(",")) - {""} for k in (0, 1)] == [{"bsd-3-clause", "cc-by", "cc-by-nc-4.0"}, {"bsd-3-clause", "cc-by", "cc-by-nc-4.0", "mpl-2.0"}]
    assert {label for label, _, _ in licences.TEMPLATES} <= set(got[2].labels.split(",")) and got[2].score == 1
    assert (got[3].labels, got[3].score) == ("", 0)
    assert got[4].labels == "mpl-2.0"

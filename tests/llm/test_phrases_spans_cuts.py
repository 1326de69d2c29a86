import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfwise.llm import collocations, fill_in_middle, personal_data

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase of up to four words."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        kept = []
        for p, a in candidates.items():
            if 100 * inside[p] < 80 * a:
                score, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return Counter(out)


def few_words(seed, texts, words=9):
    """Texts of few different words, so that many phrases come back, with separators, capitals and passages that are shared."""
    rng = random.Random(seed)
    letters = ["a", "b", "c", "dé", "E", "Ü", "g", "h1", "İ"][:words]
    shared = " ".join(rng.choice(letters) for _ in range(9))
    out = []
    for _ in range(texts):
        text = "".join(rng.choices(letters, [9, 7, 5, 3, 2, 2, 1, 1, 1][:words])[0] + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", "!"]) for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "en", "en", "fr", None, "und"]), text + (f" {shared} x" if rng.random() < 0.3 else "")))
    return out


@pytest.mark.parametrize(("least", "top", "nodes"), [(30, 2000, 16384), (5, 12, 3), (4, 25, 1), (12, 1, 2), (2, 40, 7)])
def test_collocations(spark, least, top, nodes):
    """Small rounds, so that languages settle at different times and most phrases are never grown."""
    rows = [*few_words(least, 300), ("en", None), (None, None), ("de", ""), ("de", "one two three"), ("en", "a b " * 400 + "z")]
    df = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, rank long, phrase string").repartition(3)
    got = collocations.collocations(df, least=least, top=top, nodes=nodes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert Counter(tuple(r) for r in got.collect()) == phrases(rows, least, top)


def test_collocations_of_shared_passages(spark):
    """Passages far from each other in count: phrases within longer ones go, ties at the last place are settled."""
    rng = random.Random(4)
    rows = []
    for k in range(40):
        passage = " ".join(f"p{k}w{i}" for i in range(rng.randint(1, 7)))
        rows += [("en", passage + rng.choice([" end", ".", " also that"]))] * rng.choice([3, 3, 3, 4, 8])
    df = spark.createDataFrame(rows, "lang string, text string")
    for top in (5, 20, 60):
        assert Counter(tuple(r) for r in collocations.collocations(df, least=3, top=top, nodes=4).collect()) == phrases(rows, 3, top)


def test_collocations_of_nothing(spark, empty, docs, rows):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(docs.select("text", "lang").where("text is null or length(text) < 3")).count() == 0
    langs = {(r.doc_id, r.text): r.lang for r in docs.select("doc_id", "text", "lang").collect()}
    every = [(langs[i, t], t) for i, t in rows]
    repeated = docs.select("doc_id", "text", "lang").collect()
    every = [(r.lang, r.text) for r in repeated]
    assert Counter(tuple(r) for r in collocations.collocations(docs, least=3, top=50).collect()) == phrases(every, 3, 50)


def test_collocations_hash_anew_when_words_share_a_hash(spark, monkeypatch):
    """A hash so short that words share it until the third seed."""
    plain = collocations.word_counts
    seen = []

    def short(docs, seed):
        seen.append(seed)
        out = plain(docs, seed)
        return out.withColumn("code", collocations.F.lit(7).cast("long")) if seed < 2 else out

    monkeypatch.setattr(collocations, "word_counts", short)
    rows = few_words(3, 60)
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=4, top=30)
    assert Counter(tuple(r) for r in got.collect()) == phrases(rows, 4, 30) and seen == [0, 1, 2]


def test_scores_are_exact(spark):
    a, left, right = 9_000_000_000_007, 9_000_000_000_009, 9_000_000_000_031
    df = spark.createDataFrame([(a, left, right)], "a long, f1 long, f2 long").selectExpr(f"{collocations._weakest(('f1', 'f2'))} as cut", collocations._BOUND)
    r = df.first()
    assert (r.cut.score, r.cut.k, r.cut.l, r.cut.r) == (2000000 * a // (left + right), 1, left, right) and r.bound == 2000000 * a // (left + a)


def test_counting_of_rows_that_share_a_hash(monkeypatch):
    rng = np.random.default_rng(2)
    columns = [rng.integers(1, 5, 500) for _ in range(3)]
    want = Counter(zip(*[c.tolist() for c in columns], strict=True))
    for shift in (0, 62):
        monkeypatch.setattr(collocations, "_pair_hash", lambda a, b, s=shift: (a.view(np.uint64) * np.uint64(3) + b.view(np.uint64) * np.uint64(5)) >> np.uint64(s))
        own, n = collocations.counted(columns)
        assert dict(zip(zip(*[c.tolist() for c in own], strict=True), n.tolist(), strict=True)) == want


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)
                or kind == "phone" and 9 <= len(digits) <= 15
            ):
                out.append((kind, *m.span()))
    return out


def with_checksum(digits):
    return next(digits + str(d) for d in range(10) if luhn(digits + str(d)))


def messy(seed, n):
    rng = random.Random(seed)
    parts = ["a", "Bc", "é", "@", ".", "..", "-", "+", " ", "  ", "1", "25", "256", "0", "4111 1111 1111 1111", "(017) 555-7713", "x@y.z", "%_", "\n", "@@", "1.2.3.4", "+49", ")", "(", "𝄞"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    return out + [with_checksum("".join(rng.choices("0123456789", k=rng.randint(11, 19)))) for _ in range(60)]


EXPECTED = [
    ("pay to DE89 3704 0044 0532 0130 00 now", [("iban", "DE89 3704 0044 0532 0130 00", True)]),
    ("GB82WEST12345698765432", [("iban", "GB82WEST12345698765432", True)]),
    ("GB82WEST12345698765433 account", []),
    ("her social security number is 123-45-6789.", [("ssn", "123-45-6789", False)]),
    ("123-45-6789", []),
    ("social security 000-45-6789 and 666-45-6789", []),
    ("device 00:1A:2b:3c:4D:5e.", [("mac", "00:1A:2b:3c:4D:5e", False)]),
    ("00:1A:2b:3c:4D:5e:77", []),
    ("call 030 1234567 today", [("local_phone", "030 1234567", False)]),
    ("see 030 1234567 today", []),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962", False)]),
    ('colour = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', []),
    ("password: aaaaaaaaaaaaaaaaaaaa1", []),
]


def test_personal_data_against_the_patterns():
    for text in messy(1, 4000):
        found = [(s.kind, s.start, s.end) for s in personal_data.spans_of(text)]
        assert [s for s in found if s[0] in BASE] == base_spans(text), text
        places = [s for s in personal_data.spans_of(text) if s.kind not in BASE]
        assert all(s.score >= personal_data.THRESHOLD for s in places)


@pytest.mark.parametrize(("text", "want"), EXPECTED)
def test_further_kinds(text, want):
    got = [(s.kind, text[s.start : s.end], s.checksum) for s in personal_data.spans_of(text) if s.kind not in BASE]
    assert got == want


def test_words_nearby_move_the_score():
    far, near = (personal_data.spans_of(t)[0] for t in ("number 4111 1111 1111 1111 there", "credit card 4111 1111 1111 1111 there"))
    alone, named = (personal_data.spans_of(t)[0] for t in ("10.1.2.3", "server address 10.1.2.3"))
    assert alone.score < named.score and named.context == "address,server" and alone.context == ""
    assert (far.kind, near.kind) == ("card", "card") and far.score < near.score


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000, "a@" * 100_000, "+1 " * 100_000, "+" + " " * 300_000, "A1" * 150_000, "=" + "a" * 300_000, "1-" * 150_000, "(1" * 100_000, "a." * 150_000 + "@"):
        assert isinstance(personal_data.spans_of(text), list)


def test_personal_data_of_documents(spark, docs, rows, empty):
    extra = spark.createDataFrame([(900, "mail a.b@c.de or +1 (017) 555-7713, ip 10.0.0.255", "x"), (901, None, "y"), (901, "é 4111-1111-1111-1111", "z")], "doc_id long, text string, personal_data string")
    out = personal_data.redact(personal_data.find(extra))
    assert out.columns == ["doc_id", "text", "personal_data", "personal_data_2", "redacted"]
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert got[900, "mail a.b@c.de or +1 (017) 555-7713, ip 10.0.0.255"].redacted == "mail <EMAIL> or <PHONE>, ip <IP>"
    assert got[901, None].redacted is None and got[901, None].personal_data_2 == []
    assert [(s.kind, s.start, s.end) for s in got[901, "é 4111-1111-1111-1111"].personal_data_2] == [("card", 2, 21)]
    own = Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.personal_data if s.kind in BASE)) for r in personal_data.find(docs).collect())
    assert own == Counter((i, tuple(base_spans(t))) for i, t in rows)
    assert personal_data.find(empty).count() == 0


UNITS = re.compile("[A-Za-z]+|[^A-Za-z]")


def by_list(doc, text):
    """The cuts by a list of all units."""
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, len(units))))
    if h4 % 100 < 20:
        return doc, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, docs, rows, empty):
    more = [(2000 + k, t) for k, t in enumerate(["<P>", "a<M>b", "<", "<P", "P>x<S", "<<S", "é", "aé b\n\tC", "𝄞𝄞 a𝄞b", "a" * 50_000, "𝄞é1 " * 20_000, "<S", "S><M", ">"] * 4)]
    df = docs.select("doc_id", "text", "start").unionByName(spark.createDataFrame([(i, t, "x") for i, t in more], "doc_id long, text string, start string")).withColumn("fill_in_middle", fill_in_middle.F.lit(1))
    out = fill_in_middle.transform(df)
    assert out.columns == ["doc_id", "text", "start", "fill_in_middle", "fill_in_middle_2"]
    got = Counter((r.doc_id, *r.fill_in_middle_2) for r in out.collect())
    assert got == Counter(by_list(i, t) for i, t in [*rows, *more])
    assert {x[2] for x in got} == {"plain", "spm", "psm"}
    back = out.select("text", fill_in_middle.restored(fill_in_middle.F.col("fill_in_middle_2.output"), fill_in_middle.F.col("fill_in_middle_2.form")).alias("again"))
    assert all((r.text or "") == r.again for r in back.collect())
    assert fill_in_middle.transform(empty).count() == 0


def test_restored_where_parts_look_like_sentinels(spark):
    """Every cut of short texts of the characters that sentinels are made of."""
    rng = random.Random(6)
    rows = []
    for _ in range(800):
        text = "".join(rng.choice(["<", ">", "P", "S", "M", "é"]) for _ in range(rng.randint(1, 9)))
        draw = "".join(f"{rng.randrange(2**32):08x}" for _ in range(2)) + f"{0:08x}" + f"{rng.randrange(2**32):08x}"
        rows.append((text, *fill_in_middle.cut(text, draw)))
    df = spark.createDataFrame(rows, "text string, n long, form string, prefix_chars long, middle_chars long, output string")
    F = fill_in_middle.F
    assert df.where(F.col("text") != fill_in_middle.restored(F.col("output"), F.col("form"))).count() == 0 and df.where("form <> 'plain'").count() > 300


def test_skip_list_finds_every_rank():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 5, 300, 5000):
        ends = np.cumsum(rng.integers(1, 9, n))
        units = fill_in_middle.SkipList(ends)
        assert [units.find(k) for k in range(n + 1)] == [0, *ends.tolist()]
        assert all(int(u.sum()) <= n and len(u) == len(c) for u, c in zip(units.units, units.chars, strict=True))
        for bad in (-1, n + 1):
            with pytest.raises(IndexError):
                units.find(bad)
    # few steps: each lane has about a quarter of the links of the one below it
    assert len(units.units) > 3 and len(units.units[1]) < n / 2

"""Phrase collocations by best-first branch and bound.

Phrases of two to ``LONGEST`` words are scored by their weakest cut: ``floor(SCALE * a / (l + r))`` with a, l and r the counts of
phrase, first part and rest. A phrase that begins with P has at most P's count and a first cut of which l is the count of P's first
word and r at least a, so ``floor(SCALE * f(P) / (f(first word) + f(P)))`` bounds P and all that grows from it.

1. Words are counted by language; words under ``least`` end a phrase, as separators do. All words have the same bound, so
   all are grown at once: pairs.
2. A round takes each language's open phrases of the highest bounds, ties included, and reads the words once: it counts every
   phrase of one word more that has one of them at its beginning or at its end. That gives their children, and decides
   whether they survive, for a phrase within a longer one of nearly its count goes. A phrase inside a phrase two words
   longer is inside one that is one word longer, whose count lies between theirs, so one word more is enough.
3. The score that the ``top``-th survivor of a language has closes all phrases of a lower bound. The rounds end when no
   language has an open phrase left; ties at that score are all grown.

Counting is in tasks over blocks of words and then by phrase in Spark; scores, bounds, survivors and the frontier are tables. Only a
round's phrases (at most ``MOST_NODES``) and a bit map of frequent words (of fixed size; it lets a rare word pass now and
then, whose phrases fail the count) come to the driver. Words are 64-bit hashes; if two words of a language or of two
languages share one, all is hashed again by another seed. Counts of phrases are by all their words, without hashes of them.

Defined results: a null text has no words; a null language is ``und``; repeated rows count again; ties follow count, then
phrase in UTF-8 byte order; long texts are read whole; extra columns aren't read; without texts there are no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.shared import bound_batches, discard, release_shuffles, staged
from shelfwise.llm.words import GOLD, M1, M2, mix, prefix_hash, slice_hash

LEAST, TOP, SCALE, LONGEST = 30, 2000, 2_000_000, 4
#: A phrase goes if a longer one with it inside has at least so many hundredths of its count.
INSIDE = 80
#: Open phrases of a language that a round takes (twice as many the next time), and of all languages (which bounds what is broadcast).
NODES, MOST_NODES = 16_384, 1 << 18
#: Bytes of text that are split at a time, and words that are counted at a time.
TEXT_BYTES, BLOCK_WORDS = 1 << 20, 500_000
#: Bits of the map of frequent words.
MAP_BITS = 26

#: A-Z become a-z, tab becomes a space, and separators of pieces become line feeds; UTF-8's bytes of other characters stay.
_PLAIN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_HASHED = 1 << 18


def _blocks(raw: bytes) -> Iterator[tuple[int, int]]:
    """Slices that end at a space or line feed wherever there is one."""
    first = 0
    while len(raw) - first > _HASHED:
        after = max(raw.rfind(b" ", first, first + _HASHED), raw.rfind(b"\n", first, first + _HASHED)) + 1
        if after <= first:
            found = [x for x in (raw.find(b" ", first + _HASHED), raw.find(b"\n", first + _HASHED)) if x >= 0]
            after = min(found) + 1 if found else len(raw)
        yield first, after
        first = after
    yield first, len(raw)


class Spelt:
    """The words of several texts: hash, whether a piece begins before it, and where it stands in ``raw``."""

    def __init__(self, langs: list[str], texts: list[bytes], seed: int):
        self.raw = b"\n".join(texts).translate(_PLAIN) + b"\n"
        hashed = self.raw.translate(bytes((b + 97 * seed) % 256 for b in range(256))) if seed else self.raw
        firsts, afters, hashes, pieces, piece = [], [], [], [], 0
        for a, b in _blocks(self.raw):
            x = np.frombuffer(self.raw, np.uint8)[a:b]
            line = x == 10
            gap = np.ones(len(x) + 2, np.int8)
            gap[1:-1] = line | (x == 32)
            step = np.diff(gap)
            first, after = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
            lines = np.cumsum(line)
            hashes.append(slice_hash(prefix_hash(hashed[a:b]), first, after))
            pieces.append(piece + lines[first])
            firsts.append(a + first)
            afters.append(a + after)
            piece += int(lines[-1]) if len(lines) else 0
        self.first, self.after, pieces = (np.concatenate(x) for x in (firsts, afters, pieces))
        salts = {lang: np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, salt=bytes([seed])).digest(), "little")) for lang in set(langs)}
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends, self.first, side="right")
        code = mix(np.concatenate(hashes) + np.array([salts[lang] for lang in langs], np.uint64)[self.text])
        self.code = np.where(code == 0, GOLD, code).view(np.int64)
        self.starts = np.ones(len(pieces), bool)
        self.starts[1:] = pieces[1:] != pieces[:-1]


def _spelt(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[list[str], Spelt]]:
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            langs.append(lang)
            texts.append(text)
            size += len(text)
            if size >= TEXT_BYTES:
                yield langs, Spelt(langs, texts, seed)
                langs, texts, size = [], [], 0
    if texts:
        yield langs, Spelt(langs, texts, seed)


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """``lang, code, word, f`` of all words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, own in _spelt(batches, seed):
            if len(own.code):
                codes, at, n = np.unique(own.code, return_index=True, return_counts=True)
                words = [own.raw[a:b] for a, b in zip(own.first[at].tolist(), own.after[at].tolist(), strict=True)]
                yield pa.record_batch({"lang": pa.array([langs[t] for t in own.text[at].tolist()], pa.string()), "code": codes, "word": pa.array(words, pa.binary()), "n": n})

    rows = docs.mapInArrow(of, "lang string, code long, word binary, n long")
    return rows.groupBy("lang", "code", "word").agg(F.sum("n").alias("f"))


def word_map(words: DataFrame) -> np.ndarray:
    """A bit for each slot that a word has: MAP_BITS bits, whatever the number of words."""
    slots = F.shiftright("code", 6).bitwiseAND((1 << MAP_BITS - 6) - 1)
    rows = words.groupBy(slots.alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(code & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << MAP_BITS - 6, np.int64)
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    return out


def encoded(docs: DataFrame, seed: int, bits: np.ndarray) -> DataFrame:
    """Rows of word codes; zeros stand where no phrase can go on."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _spelt(batches, seed):
            slot = (own.code >> 6) & ((1 << MAP_BITS - 6) - 1)
            frequent = (shared.value[slot] >> (own.code & 63)) & 1 == 1
            code = own.code[frequent]
            if len(code):
                # a zero before each word that begins a piece or follows a word that isn't frequent
                gap = own.starts.copy()
                gap[1:] |= ~frequent[:-1]
                out = np.zeros(len(code) + int(gap[frequent].sum()) + 1, np.int64)
                out[np.arange(len(code)) + np.cumsum(gap[frequent])] = code
                yield pa.record_batch({"codes": pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), pa.array(out))})

    return docs.mapInArrow(of, "codes array<long>")


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Blocks of words; each row begins and ends with a zero, so no phrase crosses from one to the next. A block is a row longer than BLOCK_WORDS at most."""
    parts, n = [], 0
    for batch in batches:
        rows = batch.column("codes")
        ends, codes = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            parts.append(codes[a:b])
            n += b - a
            if n >= BLOCK_WORDS:
                yield np.concatenate(parts)
                parts, n = [], 0
    if parts:
        yield np.concatenate(parts)


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a.view(np.uint64) * M1 + b.view(np.uint64) * M2
    return (h ^ (h >> np.uint64(31))) * GOLD


def counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and how often each occurs, by a sort of hashes; by one of the columns themselves if two rows share a hash."""
    h = columns[0].view(np.uint64)
    for c in columns[1:]:
        h = _pair_hash(h, c)
    order = np.argsort(h)
    h, own = h[order], [c[order] for c in columns]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if any((c[1:] != c[:-1])[~new[1:]].any() for c in own):
        order = np.lexsort(columns)
        own = [c[order] for c in columns]
        new[1:] = np.any([c[1:] != c[:-1] for c in own], axis=0)
    at = np.flatnonzero(new)
    return [c[at] for c in own], np.diff(np.append(at, len(new)))


#: Rows that a task hands over at a time.
_BATCH = 1 << 16


def _rows(columns: list[np.ndarray], size: int) -> Iterator[pa.RecordBatch]:
    """Distinct phrases and their counts, with zeros for the words up to ``size``."""
    own, n = counted(columns)
    for first in range(0, len(n), _BATCH):
        part = [c[first : first + _BATCH] for c in own]
        none = [np.zeros(len(part[0]), np.int64)] * (size - len(part))
        yield pa.record_batch({f"c{i}": c for i, c in enumerate([*part, *none], 1)} | {"n": n[first : first + _BATCH]})


def _at_least(codes: DataFrame, count, size: int, least: int) -> DataFrame:
    """``c1, ..., a``: sums by phrase of what ``count`` finds in tasks. Blocks are counted before the shuffle, so no task holds a table of all its phrases."""
    words = [f"c{i}" for i in range(1, size + 1)]
    rows = codes.mapInArrow(count, ", ".join(f"{c} long" for c in [*words, "n"]))
    return rows.repartition(*words).groupBy(*words).agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def pairs(codes: DataFrame, least: int) -> DataFrame:
    """``c1, c2, a`` of all pairs of words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _coded(batches):
            at = np.flatnonzero((c[:-1] != 0) & (c[1:] != 0))
            if len(at):
                yield from _rows([c[at], c[at + 1]], 2)

    return _at_least(codes, of, 2, least)


class _Members:
    """Hashes of phrases: a small table that nearly all others fail, then a look-up. An equal hash only has a few more phrases counted."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.table = np.zeros(1 << 22, bool)
        self.table[self.sorted >> np.uint64(42)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = self.table[h >> np.uint64(42)]
        at = np.flatnonzero(out)
        place = np.searchsorted(self.sorted, h[at])
        out[at] = self.sorted[np.minimum(place, len(self.sorted) - 1)] == h[at] if len(self.sorted) else False
        return out


def grown(codes: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Counts of all phrases of one word more that have one of ``nodes`` at their beginning or end."""
    table = nodes.select("c1", "c2", "c3").toArrow()  # MOST_NODES rows at most
    c1, c2, c3 = (table[c].to_numpy() for c in ("c1", "c2", "c3"))
    two = c3 == 0
    twos, threes = _pair_hash(c1[two], c2[two]), _pair_hash(_pair_hash(c1[~two], c2[~two]), c3[~two])
    shared = codes.sparkSession.sparkContext.broadcast((twos, threes))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_two, in_three = (_Members(h) for h in shared.value)
        for c in _coded(batches):
            if len(c) < 4:
                continue
            word = c != 0
            three = word[:-2] & word[1:-1] & word[2:]
            h = _pair_hash(c[:-1], c[1:])
            node = in_two.of(h)
            at = np.flatnonzero(three & (node[:-1] | node[1:]))
            if len(at):
                yield from _rows([c[at], c[at + 1], c[at + 2]], 4)
            if len(in_three.sorted):
                node = in_three.of(_pair_hash(h[:-1], c[2:])) & three
                at = np.flatnonzero(three[:-1] & word[3:] & (node[:-1] | node[1:]))
                if len(at):
                    yield from _rows([c[at], c[at + 1], c[at + 2], c[at + 3]], 4)

    return _at_least(codes, of, 4, least)


def _share(a: str, both: str) -> str:
    """``floor(SCALE * a / both)`` in SQL, exact: products may pass 64 bits."""
    return f"cast({a} as decimal(20,0)) * cast({SCALE} as decimal(7,0)) div cast({both} as decimal(20,0))"


def _weakest(*cuts: tuple[str, str]) -> str:
    """The cut of the lowest score, and of these the first, as a struct ``score, k, l, r``."""
    of = [f"named_struct('score', {_share('a', f'{left} + {right}')}, 'k', {k}, 'l', {left}, 'r', {right})" for k, (left, right) in enumerate(cuts, 1)]
    return f"array_min(array({', '.join(of)}))"


_BOUND = _share("a", "f1 + a") + " as bound"


def _pairs_scored(found: DataFrame, words: DataFrame) -> DataFrame:
    first, second = words.select("lang", F.col("code").alias("c1"), F.col("f").alias("f1")), words.select(F.col("code").alias("c2"), F.col("f").alias("f2"))
    return found.join(first, "c1").join(second, "c2").selectExpr("lang", "c1", "c2", "a", "f1", "f2", f"{_weakest(('f1', 'f2'))} as cut", _BOUND)


def _threes_scored(found: DataFrame, two: DataFrame) -> DataFrame:
    """Every pair in a phrase has at least its count, so all are known."""
    front = two.selectExpr("lang", "c1", "c2", "a as f12", "f1")
    back = two.selectExpr("c1 as c2", "c2 as c3", "a as f23", "f2 as f3")
    return found.join(front, ["c1", "c2"]).join(back, ["c2", "c3"]).selectExpr("lang", "c1", "c2", "c3", "a", "f1", "f12", "f23", "f3", f"{_weakest(('f1', 'f23'), ('f12', 'f3'))} as cut", _BOUND)


def _fours_scored(found: DataFrame, two: DataFrame, three: DataFrame) -> DataFrame:
    """Of phrases whose first three words are known; where the last three aren't, ``cut`` is null and ``bound`` takes the phrase's own count for theirs."""
    front = three.selectExpr("lang", "c1", "c2", "c3", "f1", "f12", "a as f123")
    back = three.selectExpr("c1 as c2", "c2 as c3", "c3 as c4", "a as f234")
    end = two.selectExpr("c1 as c3", "c2 as c4", "a as f34", "f2 as f4")
    known = found.join(front, ["c1", "c2", "c3"]).join(end, ["c3", "c4"]).join(back, ["c2", "c3", "c4"], "left")
    last = ("f12", "f34"), ("f123", "f4")
    return known.selectExpr("lang", "c1", "c2", "c3", "c4", "a", f"if(f234 is null, null, {_weakest(('f1', 'f234'), *last)}) as cut", f"{_weakest(('f1', 'coalesce(f234, a)'), *last)}.score as bound")


def _nth_highest(values: DataFrame, value: str, n: int) -> DataFrame:
    """``lang, least``: the n-th highest value of each language that has so many; by counts over ranges of values, then within one of them."""
    down = Window.partitionBy("lang").orderBy(F.desc("of")).rowsBetween(Window.unboundedPreceding, -1)

    def reached(counts: DataFrame, before: str) -> DataFrame:
        up_to = F.coalesce(F.sum("n").over(down), F.lit(0)) + F.col(before)
        return counts.withColumn("before", up_to).where(f"before < {n} and before + n >= {n}")

    ranges = values.groupBy("lang", F.expr(f"{value} div 1024").alias("of")).agg(F.count("*").alias("n"))
    there = reached(ranges.withColumn("none", F.lit(0)), "none").select("lang", F.col("of").alias("range"), F.col("before").alias("above"))
    within = values.join(there, "lang").where(f"{value} div 1024 = range").groupBy("lang", F.col(value).alias("of"), "above").agg(F.count("*").alias("n"))
    return reached(within, "above").select("lang", F.col("of").alias("least"))


def _not_inside(phrases: DataFrame, longer: DataFrame, keys: list[str]) -> DataFrame:
    """Phrases that no longer one, with them at its beginning or end, has nearly the count of."""
    at_front = longer.select(*keys, F.col("a").alias("longer"))
    at_end = longer.select(*[F.col(f"c{i + 2}").alias(k) for i, k in enumerate(keys)], F.col("a").alias("longer"))
    most = at_front.union(at_end).groupBy(*keys).agg(F.max("longer").alias("longer"))
    inside = F.expr(f"cast(longer as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {INSIDE}")
    return phrases.join(most, keys, "left").where(F.col("longer").isNull() | ~inside).drop("longer")


_KEYS = ["c1", "c2", "c3"]


class Search:
    """The state between rounds: tables of what has been counted, and of what has been grown."""

    def __init__(self, codes: DataFrame, words: DataFrame, least: int, top: int):
        self.codes, self.words, self.least, self.top, self.round = codes, words, least, top, 0
        self.two = staged(_pairs_scored(pairs(codes, least), words), "pairs")
        spark = codes.sparkSession
        empty = spark.createDataFrame([], "c1 long, c2 long, c3 long, c4 long, a long")
        self.three = _threes_scored(empty.drop("c4"), self.two)
        self.found = self.four = empty
        self.done = spark.createDataFrame([], "c1 long, c2 long, c3 long")
        self.fours = _fours_scored(self.four, self.two, self.three)

    def survivors(self) -> DataFrame:
        """``lang, c1, c2, c3, c4, a, cut`` of phrases whose score is known and that surely stay."""
        none = F.lit(0).cast("long")
        grown_two = self.two.join(self.done.where("c3 = 0").select("c1", "c2"), ["c1", "c2"], "semi")
        grown_three = self.three.join(self.done.where("c3 <> 0"), _KEYS, "semi")
        columns = ["lang", *_KEYS, "c4", "a", "cut"]
        out = _not_inside(grown_two, self.three, ["c1", "c2"]).withColumn("c3", none).withColumn("c4", none).select(*columns)
        out = out.union(_not_inside(grown_three, self.four, _KEYS).withColumn("c4", none).select(*columns))
        return out.union(self.fours.where("cut is not null").select(*columns))

    def open(self) -> DataFrame:
        """``lang, c1, c2, c3, bound`` of phrases not grown yet; for one of four words whose score isn't known, the pair inside it that tells it."""
        two = self.two.selectExpr("lang", "c1", "c2", "0L as c3", "bound")
        inner = self.fours.where("cut is null").selectExpr("lang", "c2 as c1", "c3 as c2", "0L as c3", "bound")
        every = two.union(self.three.select("lang", *_KEYS, "bound")).union(inner)
        return every.groupBy("lang", *_KEYS).agg(F.max("bound").alias("bound")).join(self.done, _KEYS, "anti")

    def grow(self, nodes: DataFrame) -> None:
        """One reading of the words."""
        self.round += 1
        new = staged(grown(self.codes, nodes, self.least), f"grown-{self.round}").join(self.found, ["c1", "c2", "c3", "c4"], "anti")
        self.found = staged(self.found.unionByName(new), f"found-{self.round}")
        self.done = staged(self.done.union(nodes.select(*_KEYS)), f"done-{self.round}")
        self.three = staged(_threes_scored(self.found.where("c4 = 0").drop("c4"), self.two), f"threes-{self.round}")
        self.four = self.found.where("c4 <> 0")
        self.fours = staged(_fours_scored(self.four, self.two, self.three), f"fours-{self.round}")

    def settle(self, nodes: int) -> DataFrame:
        """Rounds until no open phrase can be among the first ``top`` or tie with the last of them; the survivors that are."""
        while True:
            survivors = staged(self.survivors().withColumn("score", F.col("cut.score")), f"survivors-{self.round}")
            settled = staged(_nth_highest(survivors, "score", self.top), f"settled-{self.round}")
            least = F.coalesce(F.col("least"), F.lit(0))
            still = staged(self.open().join(settled, "lang", "left").where(F.col("bound") >= least).drop("least"), f"open-{self.round}")
            best = _nth_highest(still, "bound", nodes).withColumnRenamed("least", "from")
            batch = still.join(best, "lang", "left").where(F.col("bound") >= F.coalesce("from", F.lit(0))).orderBy(F.desc("bound"), *_KEYS).limit(MOST_NODES)
            batch = staged(batch, f"batch-{self.round}")
            if batch.isEmpty():
                return survivors.join(settled, "lang", "left").where(F.col("score") >= least).drop("least")
            self.grow(batch)
            nodes *= 2


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, nodes: int = NODES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases by score, count and phrase. ``least`` is two or more."""
    spark = docs.sparkSession
    bound_batches(spark)
    release_shuffles(spark)
    own = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    for seed in itertools.count():
        every = staged(word_counts(own, seed), "words")
        if every.groupBy("code").count().where("count > 1").isEmpty():
            break
        discard(every)
    words = every.where(F.col("f") >= least)
    codes = staged(encoded(own, seed, word_map(words)), "codes")
    found = Search(codes, words, least, top).settle(nodes)
    spelt = words.select("code", F.col("word").cast("string").alias("word"))
    for i in range(1, LONGEST + 1):
        found = found.join(spelt.select(F.col("code").alias(f"c{i}"), F.col("word").alias(f"w{i}")), f"c{i}", "left")
    found = found.withColumn("phrase", F.concat_ws(" ", *[f"w{i}" for i in range(1, LONGEST + 1)]))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
numbered AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, piece, unnest(w) AS w1, unnest(range(len(w))) AS i FROM numbered),
runs AS (SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4 FROM words WINDOW p AS (PARTITION BY piece ORDER BY i)),
grams AS (
  SELECT lang, 1 AS m, w1 AS phrase, count(*) AS f FROM runs GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY ALL),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE m >= 2 AND f >= 30),
cut AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS left_part, array_to_string(w[k + 1:], ' ') AS right_part
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f + r.f)::HUGEINT)::BIGINT AS score
  FROM cut c JOIN grams l ON l.lang = c.lang AND l.phrase = c.left_part JOIN grams r ON r.lang = c.lang AND r.phrase = c.right_part),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, a, m, w, unnest(range(1, m)) AS s FROM candidates),
longer AS (SELECT lang, array_to_string(w[s:s + size - 1], ' ') AS phrase, max(a) AS f FROM (SELECT *, unnest(range(2, m)) AS size FROM parts) WHERE s + size - 1 <= m GROUP BY 1, 2),
kept AS (SELECT w.* FROM weakest w LEFT JOIN longer g ON g.lang = w.lang AND g.phrase = w.phrase WHERE g.f IS NULL OR 100::HUGEINT * g.f < 80::HUGEINT * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

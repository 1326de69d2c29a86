"""Benchmark decontamination by a generalised suffix automaton.

The items' words go into one automaton (states are classes of word sequences with the same end positions in the items).
A text streams through it; the automaton keeps the longest suffix read so far that occurs in any item, so every place
where it is at least ``window`` words long ends a shared window. Items of fewer words count as one window of their own.

Items are taken in blocks of at most ``BLOCK_WORDS`` words (a longer item in parts that overlap by a window), each block its own
automaton. With one block the texts are read once and never shuffled. With more, they are read once a block, so that one
automaton is held at a time, and what each block found is added up by document.

Defined results: null or empty texts have no words and no hits; null item texts have no window; a null item id counts as
the id ``null``; repeated rows are judged one by one; extra columns stay as they are (a result column whose name is taken gets another, see
``free_name``); an empty table of texts or of items gives no hits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.shared import bound_batches, free_name, hidden_prefix, release_shuffles, staged
from shelfwise.llm.words import alnum_words, utf8

WINDOW = 10
#: Words of items that one automaton (and one broadcast) may hold.
BLOCK_WORDS = 200_000
HITS = "n_words long, longest long, spans array<struct<first:long,after:long>>, items array<string>"


class SuffixAutomaton:
    """Of several word-number sequences. ``length``: of a state's longest sequence; ``link``: state of its longest proper suffix in another class."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """A state for the sequences of q that aren't longer than those that reach it from p."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
            last = new

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The longest suffix that occurs in an item, after one more word."""
        to = self.next
        while state and w not in to[state]:
            state = self.link[state]
            length = self.length[state]
        if w in to[state]:
            return to[state][w], length + 1
        return 0, 0

    def suffix(self, state: int, length: int) -> int:
        """The state that holds the suffix of that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state


class Items:
    """Automaton of a block of items, and which items each shared window belongs to."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        sequences = []
        for name, text in items:
            words = alnum_words(text)
            if words:
                sequences.append((name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        for _, words in sequences:
            self.automaton.add(words)
        self.least = min((min(window, len(words)) for _, words in sequences), default=window)
        self.whole: dict[int, set[str]] = {}  # by the state of a window
        self.short: dict[int, list[tuple[int, str]]] = {}  # by the state of an item of fewer words
        for name, words in sequences:
            state = length = 0
            for w in words:
                state, length = self.automaton.step(state, length, w)
                if length >= window:
                    self.whole.setdefault(self.automaton.suffix(state, window), set()).add(name)
            if len(words) < window:
                self.short.setdefault(self.automaton.suffix(state, len(words)), []).append((len(words), name))
        self.ends: dict[int, list[tuple[int, str]]] = {}

    def ending(self, state: int) -> list[tuple[int, str]]:
        """Short items that end in a state or in one of its suffixes."""
        if state not in self.ends:
            own, at = [], state
            while at > 0:
                own += self.short.get(at, [])
                at = self.automaton.link[at]
            self.ends[state] = own
        return self.ends[state]

    def find(self, words: list[bytes]) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Longest matching length, hit spans in order (apart from each other), items with a window in the text."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))))
        longest, spans, found = 0, [], set()
        for first, after in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if after - first < self.least:  # no window fits between words that no item has
                continue
            state = length = 0
            for at, w in enumerate(ids[first:after].tolist(), first):
                state, length = self.automaton.step(state, length, w)
                longest = max(longest, length)
                most = 0
                if length >= self.window:
                    most = self.window
                    found |= self.whole[self.automaton.suffix(state, self.window)]
                if self.short:
                    for size, name in self.ending(state):
                        if size <= length:
                            most = max(most, size)
                            found.add(name)
                if most:
                    start = at - most + 1
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, at + 1))
        return longest, spans, found


_BUILT: dict[str, Items] = {}


def _hits(text: Column, block, key: str, window: int, cut_from: int | None = None) -> Column:
    """The struct of HITS, and with ``cut_from`` also ``kept``: the text without hit spans of so many words or more, null where it has none."""

    @F.pandas_udf(HITS + ", kept string" * (cut_from is not None))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Items(block.value, window)
        items = _BUILT[key]
        for texts in batches:
            rows = []
            for t in texts:
                t = t if isinstance(t, str) else None
                words = alnum_words(t)
                longest, spans, found = items.find(words)
                rows.append((len(words), longest, [{"first": a, "after": b} for a, b in spans], sorted(found)))
                if cut_from is not None:
                    rows[-1] += (without(t, [x for x in spans if x[1] - x[0] >= cut_from]),)
            yield pd.DataFrame(rows, columns=["n_words", "longest", "spans", "items"] + ["kept"] * (cut_from is not None))

    return of.asNondeterministic()(text)


def merged(spans) -> list[tuple[int, int]]:
    """Spans in order, those that touch as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the spans of words; null where there are none."""
    if not text or not spans:
        return None
    raw = utf8(text)
    at = [m.span() for m in _WORD.finditer(raw)]
    keep, done = [], 0
    for first, after in spans:
        keep.append(raw[done : at[first][0]])
        done = at[after - 1][1]
    return b"".join([*keep, raw[done:]]).decode("utf-8", "surrogatepass")


def _pairs(spans) -> list[tuple[int, int]]:
    return [(x["first"], x["after"]) for x in spans] if spans is not None else []


def _merged(spans: Column) -> Column:
    @F.pandas_udf("array<struct<first:long,after:long>>")
    def of(spans: pd.Series) -> pd.Series:
        return spans.map(lambda x: [{"first": a, "after": b} for a, b in merged(_pairs(x))])

    return of(spans)


def _without(text: Column, spans: Column, cut_from: int) -> Column:
    @F.pandas_udf("string")
    def of(texts: pd.Series, spans: pd.Series) -> pd.Series:
        own = [[x for x in merged(_pairs(s)) if x[1] - x[0] >= cut_from] for s in spans]
        return pd.Series([without(t if isinstance(t, str) else None, s) for t, s in zip(texts, own, strict=True)], index=texts.index, dtype=object)

    return of(text, spans)


_SPACE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int, window: int) -> tuple[int, DataFrame]:
    """The number of blocks, and the distinct items as (block, item, text): by a hash, so that a block has some ``most`` words and never over twice as many; longer items in overlapping parts."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    words = F.split(F.trim(F.regexp_replace("text", _SPACE, " ")), " ")
    step = max(1, most - window + 1)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - window, F.lit(0)), F.lit(step)), lambda i: F.array_join(F.slice(words, i + 1, most), " "))
    rows = rows.withColumn("text", F.explode(F.when(F.size(words) > most, parts).otherwise(F.array("text")))).distinct()
    block = lambda n: F.pmod(F.xxhash64("item", "text"), F.lit(n)).alias("block")
    size = F.sum(F.size(F.split("text", _SPACE))).alias("n")
    blocks = -(-(rows.agg(size).first()[0] or 0) // most) or 1
    while blocks > 1 and rows.groupBy(block(blocks)).agg(size).agg(F.max("n")).first()[0] > 2 * most:
        blocks *= 2
    return blocks, rows.select(block(blocks), "item", "text")


def find_items(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, out: str = "hits", cut_from: int | None = None) -> DataFrame:
    """``docs`` with the struct of HITS in column ``out``: words from ``first`` up to before ``after`` are in a window of an item.

    ``cut_from``: the struct also has ``kept``, the text without hit spans of so many words or more, null where there are none."""
    spark = docs.sparkSession
    bound_batches(spark)
    out = free_name(docs, out)
    blocks, items = item_blocks(items, item_id, item_text, block_words, window)
    own = lambda k: spark.sparkContext.broadcast([(r.item, r.text) for r in items.where(F.col("block") == k).collect()])
    if blocks == 1:
        return docs.withColumn(out, _hits(F.col(text_col), own(0), uuid.uuid4().hex, window, cut_from))
    release_shuffles(spark)
    p = hidden_prefix(docs)
    key = {f"{p}k1": F.xxhash64(docs[text_col]), f"{p}k2": F.xxhash64(F.lit(1), docs[text_col])}  # repeated texts are one
    parts = None
    for k in range(blocks):
        block = own(k)
        part = staged(docs.select(*[c.alias(n) for n, c in key.items()], _hits(docs[text_col], block, uuid.uuid4().hex, window).alias("hits")), "hits")
        block.destroy()
        part = part.dropDuplicates([*key])
        parts = part if parts is None else parts.unionByName(part)
    every = parts.groupBy(*key).agg(
        F.max("hits.n_words").alias(f"{p}n"), F.max("hits.longest").alias(f"{p}longest"), F.flatten(F.collect_list("hits.spans")).alias(f"{p}spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits.items")))).alias(f"{p}items"),
    )
    joined = docs.withColumns(key).join(every, [*key])
    spans = F.col(f"{p}spans")
    hits = [F.col(f"{p}n").alias("n_words"), F.col(f"{p}longest").alias("longest"), _merged(spans).alias("spans"), F.col(f"{p}items").alias("items")]
    if cut_from is not None:
        hits.append(_without(F.col(text_col), spans, cut_from).alias("kept"))
    return joined.select(*docs.columns, F.struct(*hits).alias(out))


def n_hit(hits: str) -> Column:
    return F.aggregate(f"{hits}.spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", max_coverage: float = 0.3, least_span: int = 1, **options) -> DataFrame:
    """``docs`` without hit spans of at least ``least_span`` words; texts of which more than ``max_coverage`` is hit go altogether."""
    out = free_name(docs, "hits")
    found = find_items(docs, items, text_col=text_col, out=out, cut_from=least_span, **options)
    found = found.where(n_hit(out) <= max_coverage * F.greatest(F.col(f"{out}.n_words"), F.lit(1)))
    return found.withColumn(text_col, F.coalesce(F.col(f"{out}.kept"), F.col(text_col))).drop(out)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "hits.n_words", n_hit("hits").alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"), (F.size("hits.spans") > 0).alias("contaminated"), F.col("hits.longest").alias("longest_match"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Hit spans are cut out; a document that is mostly benchmark text goes."""
    kept = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept

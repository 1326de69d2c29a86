"""Exact repeats of long byte strings, by sorting suffixes at sampled anchors.

Every ``span``-byte string picks as its anchor the k-byte gram of least hash in it, the leftmost if equal (winnowing). Equal
strings pick equal grams at equal offsets, so all repeats of ``span`` bytes are found among anchors with equal grams, some
two in ``span - k`` positions; the rest of the text never meets in a shuffle.

(1) One pass writes each anchor's gram hash and the hash of its context, the bytes that any string with this anchor can
cover. (2) Grams that occur once go. (3) Anchors with equal contexts are one: all of their context is repeated. (4) Where a
gram has several contexts, one of each is cut out of its text, and the contexts of a gram are sorted as suffixes to the
right and to the left of the anchor by deep-shallow sorting; from neighbours in these orders follows how far repeated
strings reach to each side. A gram with more than ``most`` different contexts is not gathered: its strings are counted by hash,
one row for each offset. (5) Each text loses what its anchors cover. The same sorting can tell of shorter repeats, of
``passage`` bytes: anchors are then sampled as these need them, and their bytes are counted beside those that are removed.

Defined results: a null or empty text has no bytes and loses none (its kept text is empty); repeated rows are repeats of each other;
rows are told apart by doc_id and text, so a doc_id may be null or occur twice; extra columns stay as they are (a result
column whose name is taken gets another, see ``free_name``); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.deep_shallow import reaches
from shelfwise.llm.shared import bound_batches, discard, fewer_files, free_name, hidden_prefix, partitions, release_shuffles, staged
from shelfwise.llm.words import mix, powers, prefix_hash, slice_hash, utf8

SPAN = 400
#: Different contexts of one gram that one task sorts, some 700 bytes each.
MOST = 50_000
_PIECE = 1 << 17
_AT = np.uint64((1 << 20) - 1)

ANCHORS = "k1 long, k2 long, at int, gram long, context long"
CONTEXTS = "gram long, context long, copies long, left binary, right binary"
#: How far repeated strings of ``span`` and of ``passage`` bytes reach.
REACHES = "gram long, context long, to_left int, to_right int, passage_left int, passage_right int"
CUT = "kept binary, n_bytes long, n_removed long, n_spans long, n_passage_bytes long"


def gram_size(span: int) -> int:
    return span // 6


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive numbers, from running minima of blocks forwards and backwards."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def anchors(raw: bytes, span: int = SPAN, every: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of a text's ``every``-byte strings, their gram hashes, and their context hashes."""
    n, k = len(raw), gram_size(every)
    found = []
    for a in range(0, n - every + 1, _PIECE):  # strings that start in a .. b-1
        b = min(n - every + 1, a + _PIECE)
        low, high = max(0, a - span), min(n, b + 2 * span)
        prefix = prefix_hash(raw[low:high])
        _, down = powers(len(prefix))
        first, grams = a - low, b - a + every - k
        gram = mix((prefix[first + k : first + k + grams] - prefix[first : first + grams]) * down[first : first + grams])
        least = sliding_least((gram & ~_AT) | np.arange(grams, dtype=np.uint64), every - k + 1)
        at = (least & _AT).astype(np.int64)
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        where = at + first
        left, right = np.maximum(where - (span - k), 0), np.minimum(where + span, high - low)
        context = mix(slice_hash(prefix, left, right) + (where - left).astype(np.uint64))
        found.append((at + a, gram[at], context))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    at, gram, context = (np.concatenate(x) for x in zip(*found, strict=True))
    at, own = np.unique(at, return_index=True)
    return at, gram[own], context[own]


def _anchors_of(span: int, every: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"], strict=True):
                at, gram, context = anchors(utf8(text if isinstance(text, str) else None), span, every)
                if len(at):
                    parts.append((np.full(len(at), k1), np.full(len(at), k2), at, gram.view(np.int64), context.view(np.int64)))
            if parts:
                k1, k2, at, gram, context = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pd.DataFrame({"k1": k1, "k2": k2, "at": at.astype(np.int32), "gram": gram, "context": context})

    return of


def _contexts_of(span: int, every: int):
    """Cuts the wanted contexts out of their texts; the left part backwards."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = gram_size(every)
        for batch in batches:
            rows = []
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                raw = utf8(text)
                for w in wanted:
                    at = w["at"]
                    rows.append((w["gram"], w["context"], w["copies"], raw[max(0, at - span + k) : at][::-1], raw[at : at + span]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CONTEXTS.split(", ")])

    return of


def _reaches_of(span: int, every: int):
    """For contexts in order of their gram; a gram's contexts may go over several batches."""
    spans = (span, every)

    def one(gram: int, group: dict[int, tuple[int, bytes, bytes]]) -> Iterator[tuple]:
        found = reaches([x[1] for x in group.values()], [x[2] for x in group.values()], spans, gram_size(every)) if len(group) > 1 else [([0], [0])] * 2
        for n, (context, (copies, a, b)) in enumerate(group.items()):
            if copies > 1:
                yield gram, context, *[x for s in spans for x in ((len(a), len(b)) if len(a) + len(b) >= s else (0, 0))]
            elif found[1][0][n] + found[1][1][n]:
                yield gram, context, *[x[n] for side in found for x in side]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in REACHES.split(", ")]
        now, group = None, {}
        for batch in batches:
            rows = []
            for gram, context, copies, left, right in zip(batch["gram"], batch["context"], batch["copies"], batch["left"], batch["right"], strict=True):
                if gram != now:
                    rows += one(now, group) if group else []
                    now, group = gram, {}
                group[context] = (copies, bytes(left), bytes(right))
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame(list(one(now, group)) if group else [], columns=columns)

    return of


def _strings_of(widths: list[int], every: int):
    """(gram, context, copies, width, back, string): each string of ``width`` bytes that holds the anchor, by how far before it it starts."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for gram, context, copies, left, right in zip(batch["gram"], batch["context"], batch["copies"], batch["left"], batch["right"], strict=True):
                prefix = prefix_hash(bytes(left)[::-1] + bytes(right))
                for width in widths:
                    back = np.arange(max(0, width - len(right)), min(len(left), width - gram_size(every)) + 1)
                    start = len(left) - back
                    yield pd.DataFrame({"gram": gram, "context": context, "copies": copies, "width": width, "back": back, "string": slice_hash(prefix, start, start + width).view(np.int64)})

    return of


def _crowded(contexts: DataFrame, span: int, every: int) -> DataFrame:
    """REACHES for grams with too many contexts for one task: counts of their strings by hash."""
    rows = contexts.mapInPandas(_strings_of(sorted({span, every}), every), "gram long, context long, copies long, width int, back int, string long")
    again = rows.groupBy("gram", "width", "back", "string").agg(F.sum("copies").alias("n")).where("n > 1")
    met = rows.join(again, ["gram", "width", "back", "string"])
    far = lambda width, x: F.coalesce(F.max(F.when(F.col("width") == width, x)), F.lit(0)).cast("int")
    back, ahead = F.col("back"), F.col("width") - F.col("back")
    return met.groupBy("gram", "context").agg(far(span, back).alias("to_left"), far(span, ahead).alias("to_right"), far(every, back).alias("passage_left"), far(every, ahead).alias("passage_right"))


def covered(ranges, n: int) -> list[list[int]]:
    """Ranges within 0..n in order, those that touch as one."""
    spans: list[list[int]] = []
    for a, b in sorted((max(0, a), min(n, b)) for a, b in ranges):
        if spans and spans[-1][1] >= a:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return spans


def _cut(span: int, align: bool):
    def of(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(texts, ranges, strict=True):
            raw = utf8(text if isinstance(text, str) else None)
            own = own if own is not None else ()
            spans = covered([(r["first"], r["after"]) for r in own if r["after"] > r["first"]] if len(raw) >= span else [], len(raw))
            if align and spans:  # whole characters
                for s in spans:
                    while s[0] > 0 and raw[s[0]] & 0xC0 == 0x80:
                        s[0] -= 1
                    while s[1] < len(raw) and raw[s[1]] & 0xC0 == 0x80:
                        s[1] += 1
                spans = covered(spans, len(raw))
            keep, done = [], 0
            for a, b in spans:
                keep.append(raw[done:a])
                done = b
            kept = b"".join([*keep, raw[done:]])
            passages = covered([(r["passage_first"], r["passage_after"]) for r in own if r["passage_after"] > r["passage_first"]], len(raw))
            rows.append((kept, len(raw), len(raw) - len(kept), len(spans), sum(b - a for a, b in passages)))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in CUT.split(", ")])

    return of


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, passage: int | None = None, most: int = MOST, align: bool = False, out: str = "cut") -> DataFrame:
    """``docs`` with the struct of CUT in column ``out``: the text without each byte covered by a ``span``-byte string that also starts elsewhere,
    and how many bytes are covered by such strings of ``passage`` bytes (at most ``span``, by default the same).

    ``align`` also removes the other bytes of characters that a cut would split."""
    spark = docs.sparkSession
    bound_batches(spark)
    release_shuffles(spark)
    p, out, every = hidden_prefix(docs), free_name(docs, out), min(passage or span, span)
    key = [F.xxhash64(docs[id_col], docs[text_col]).alias("k1"), F.coalesce(docs[id_col].cast("long"), F.lit(-1)).alias("k2")]
    texts = docs.select(*key, docs[text_col].alias("text"))
    found = staged(texts.mapInPandas(_anchors_of(span, every), ANCHORS), "anchors")
    grams = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), (F.min("context") != F.max("context")).alias("mixed")).where("n > 1")
    grams = staged(fewer_files(grams), "grams")  # else the join below would share the sum's partitioning, and a common gram couldn't be split
    hits = staged(fewer_files(found.join(grams, "gram").select("k1", "k2", "at", "gram", "context", "mixed")), "hits")
    discard(found, grams)

    kinds = hits.where("mixed").groupBy("gram", "context").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "at")).alias("place"))
    kinds = staged(fewer_files(kinds.select("gram", "context", "copies", "place.*")), "kinds")
    crowd = staged(fewer_files(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("gram")), "crowd")
    wanted = kinds.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "context", "copies", "at")).alias("wanted"))
    contexts = staged(fewer_files(texts.join(wanted, ["k1", "k2"]).select("text", "wanted").mapInPandas(_contexts_of(span, every), CONTEXTS)), "contexts")
    discard(kinds)
    few = contexts.join(crowd, "gram", "left_anti").repartition(partitions(spark), "gram").sortWithinPartitions("gram", "context")
    reach = few.mapInPandas(_reaches_of(span, every), REACHES).unionByName(_crowded(contexts.join(crowd, "gram", "left_semi").dropDuplicates(["gram", "context"]), span, every))
    reach = staged(fewer_files(reach), "reaches")
    discard(contexts, crowd)

    back, at = span - gram_size(every), F.col("at")
    whole = hits.where("not mixed").select("k1", "k2", (at - back).alias("first"), (at + span).alias("after"), (at - back).alias("passage_first"), (at + span).alias("passage_after"))
    part = hits.where("mixed").join(reach, ["gram", "context"])
    part = part.select("k1", "k2", (at - F.col("to_left")).alias("first"), (at + F.col("to_right")).alias("after"), (at - F.col("passage_left")).alias("passage_first"), (at + F.col("passage_right")).alias("passage_after"))
    ranges = whole.unionByName(part).groupBy(F.col("k1").alias(f"{p}k1"), F.col("k2").alias(f"{p}k2")).agg(F.collect_set(F.struct("first", "after", "passage_first", "passage_after")).alias(f"{p}ranges"))
    keyed = docs.withColumns({f"{p}k1": F.xxhash64(docs[id_col], docs[text_col]), f"{p}k2": F.coalesce(docs[id_col].cast("long"), F.lit(-1))})
    cut = F.pandas_udf(_cut(span, align), CUT).asNondeterministic()
    return keyed.join(ranges, [f"{p}k1", f"{p}k2"], "left").select(*docs.columns, cut(F.col(text_col), F.col(f"{p}ranges")).alias(out))


#: Bytes that a passage of 50 words surely holds.
PASSAGE = 200


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut_repeats(docs, passage=PASSAGE).select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256"), "cut.n_passage_bytes")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand elsewhere are cut out; a document that loses all of its text goes."""
    own = free_name(docs, "cut")
    cut = cut_repeats(docs, span=PASSAGE, align=True, out=own).where(f"{own}.n_removed < {own}.n_bytes or {own}.n_bytes = 0")
    text = F.when(F.col(f"{own}.n_removed") > 0, F.col(f"{own}.kept").cast("string")).otherwise(F.col("text"))
    return fewer_files(cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns))

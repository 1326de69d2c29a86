"""Language-model scores: logistic context mixing over each text's tokens in their order, and over the spelling of words that training hasn't.

P(token | those before) = P(known) P(cell | known) W(word | cell, class) for a known word, and (1 - P(known)) S(word | group of the class) for another. P(known) and the
cell (a hash of the word) are told bit by bit by the mixer of ``sequences``, which sees the tokens before. W is the word's discounted count (less D = once / (once + 2 twice),
by the numbers of words that training has once and twice) times the class's share of the word's tokens, over its sum over the cell's words; S is the mixed spelling. The class is the one
that the document's tokens so far speak for. So the known words of all cells and the unknown ones share one distribution at each place.
In training, a token counts as known if its word occurs a second time.

(1) One pass numbers the words of a chunk of documents and writes the documents as numbers, and the chunk's words with their
training counts by class, in buckets of a hash of the word. (2) Buckets are summed over chunks: a word of any frequency is one
entry a chunk. (3) All training words, with the groups they occur in, fill the tables of the spelling, summed by block; then they train its
weights, each task from the same start, and the tasks' weights are averaged by the words they saw: new words are types, not tokens. (4) Each distinct word is scored once.
(5) The chunks fetch their own words' counts and values. (6) All tokens of all training texts, in their order, fill the tables of the sequences; (7) they train its weights, likewise; (8) all texts are
scored. Tables and weights have a fixed size.

A bucket of a common word has a row in each chunk. Its rows are dealt into shares of some FAN rows by chunk: they are summed by share, then shares
are summed, and each share fetches from its own copy of the bucket, so no group has a row for each chunk of the corpus.

Defined results: a null or empty text is the end alone; a null doc_id counts as training; a null class is a class; repeated rows
count each; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import mixing, sequences
from shelfwise.llm.shared import bound_batches, discard, id_columns, ids, partitions, release_shuffles, staged
from shelfwise.llm.tables import expand, squeeze, summed
from shelfwise.llm.words import Lexicon, space_words

CLASSES = 16
CHUNK_BYTES = 16 << 20
BUCKET_BYTES = 8 << 20
#: Rows of a bucket that meet in one group, by the mean over its shares.
FAN = 256
#: The classes of most tokens have a group of spelling of their own each; the others share one.
OWN_GROUPS = 4
#: Tokens that a word's class shares are smoothed by, towards the shares of all tokens.
_SMOOTH = 0.5
_END = b""
_BLOCK = 1 << 16

CODED = "kind int, chunk long, bucket int, doc_id long, held_out boolean, n_bytes long, first int, n int, codes binary, words binary, counts binary"
WORDS = "bucket int, n int, known long, once long, twice long, tokens array<long>, words binary, counts binary"
SCORED = "bucket int, n int, words binary, counts binary, log_p binary"
PARTS = "bucket int, share long, words binary, counts binary"
VALUES = "chunk long, first int, n int, hashes binary, counts binary, log_p binary"
#: A chunk: its documents' fields and tokens one behind the other, and its words.
READY = "doc_id array<long>, no_id array<boolean>, held_out array<boolean>, n_bytes array<long>, n_tokens array<long>, codes binary, leaning binary, hashes binary, counts binary, log_p binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def squeeze_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def expand_words(raw: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(bytes(raw)).split(b" ")


def _coded(buckets: int):
    """Documents as numbers, and words with counts, chunk by chunk."""
    columns = [x.split()[0] for x in CODED.split(", ")]

    def written(chunk: int, lexicon: Lexicon, docs: list[tuple]) -> pd.DataFrame:
        words = list(lexicon)
        bucket = (lexicon.hashes() % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")  # a bucket's words get neighbouring numbers
        new = np.empty(len(words), np.uint32)
        new[order] = np.arange(len(words), dtype=np.uint32)
        counts = np.zeros((len(words), CLASSES), np.uint32)
        rows, training = [], {}
        for doc, held_out, of_class, size, codes in docs:
            codes = new[codes]
            if not held_out:
                training.setdefault(of_class, []).append(codes)
            rows.append((0, chunk, None, doc, held_out, size, None, len(codes), squeeze(codes), None, None))
        for of_class, codes in training.items():
            counts[:, of_class] = np.bincount(np.concatenate(codes), minlength=len(words))
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edge)):
            own = order[edge[b] : edge[b + 1]]
            rows.append((1, chunk, int(b), None, None, None, int(edge[b]), len(own), None, squeeze_words([words[i] for i in own]), squeeze(counts[edge[b] : edge[b + 1]])))
        return pd.DataFrame(rows, columns=columns).astype({"bucket": "Int32", "doc_id": "Int64", "n_bytes": "Int64", "first": "Int32", "held_out": "boolean"})

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, size, lexicon, docs = TaskContext.get().partitionId() << 32, 0, Lexicon(), []
        for batch in batches:
            for doc, text, held_out, of_class in zip(ids(batch), batch["text"], batch["held_out"], batch["class"], strict=True):
                words = space_words(text if isinstance(text, str) else None)
                words.append(_END)
                raw = sum(map(len, words)) + len(words)
                docs.append((doc, bool(held_out), int(of_class), raw, lexicon.codes(words).astype(np.uint32)))
                size += raw
                if size >= CHUNK_BYTES:
                    yield written(chunk, lexicon, docs)
                    chunk, size, lexicon, docs = chunk + 1, 0, Lexicon(), []
        if docs:
            yield written(chunk, lexicon, docs)

    return of


def _total(rows: pd.DataFrame, kind) -> tuple[Lexicon, np.ndarray]:
    """The words of a group's rows, and their counts added up."""
    lexicon, parts = Lexicon(), []
    for words, counts in zip(rows["words"], rows["counts"], strict=True):
        parts.append((lexicon.codes(expand_words(words)), expand(counts, kind, CLASSES)))
    total = np.zeros((len(lexicon), CLASSES), np.int64)
    for codes, counts in parts:
        total[codes] += counts  # a row has a word once
    return lexicon, total


def _share(kind):
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        """The words of a share of a bucket's rows with their counts."""
        lexicon, total = _total(rows, kind)
        return pd.DataFrame({"bucket": [int(rows["bucket"].iloc[0])], "share": [int(rows["share"].iloc[0])], "words": [squeeze_words(list(lexicon))], "counts": [squeeze(total)]})

    return of


def _summed(kind):
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        return _sums(int(rows["bucket"].iloc[0]), *_total(rows, kind))

    return of


def _sums(bucket: int, lexicon: Lexicon, total: np.ndarray) -> pd.DataFrame:
    """A bucket's words with their counts over all chunks."""
    each = total.sum(axis=1)
    counts = {"known": [int((each > 0).sum())], "once": [int((each == 1).sum())], "twice": [int((each == 2).sum())], "tokens": [total.sum(axis=0).tolist()]}
    return pd.DataFrame({"bucket": [bucket], "n": [len(lexicon)]} | counts | {"words": [squeeze_words(list(lexicon))], "counts": [squeeze(total)]})


def spelling_groups(by_class: np.ndarray) -> np.ndarray:
    """The group of each class."""
    out = np.full(CLASSES, OWN_GROUPS)
    out[np.argsort(-by_class, kind="stable")[:OWN_GROUPS]] = np.arange(OWN_GROUPS)
    return out


def _known(row, group: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The training words of a bucket, once for each group that they occur in, and these groups: what unknown words' spelling is learnt from. Tokens are learnt from in their order (``sequences``)."""
    words, counts = expand_words(row.words), expand(row.counts, np.int64, CLASSES)
    by_group = np.stack([counts[:, group == g].sum(axis=1) for g in range(OWN_GROUPS + 1)], axis=1) > 0
    at, groups = np.nonzero(by_group & np.fromiter(map(bool, words), bool, len(words))[:, None])
    return [words[i] for i in at.tolist()], groups


def _slots(group: np.ndarray):
    def of(batch: pd.DataFrame, total: np.ndarray) -> None:
        """Counts of the predictors' slots over a batch's words."""
        for row in batch.itertuples():
            mixing.count_bits(*_known(row, group), total.reshape(mixing.PREDICTORS, -1))

    return of


def _weights(tables, group: np.ndarray):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixer, leave_out, n = mixing.Mixer(), mixing.without_own(tables.value), 0
        for batch in batches:
            for row in batch.itertuples():
                words, groups = _known(row, group)
                mixer.train(words, groups, leave_out)
                n += len(words)
        if n:
            yield _learned(mixer, n)

    return of


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The higher half of each word's 64-bit hash, the same in every process."""
    lexicon = Lexicon()
    lexicon.codes(words)
    return (lexicon.hashes() >> np.uint64(32)).astype(np.uint32)


class Shares(NamedTuple):
    """What a known word's share of each class's tokens needs: the classes' shares of all tokens, and the discount."""

    prior: np.ndarray
    discount: float

    def of(self, counts: np.ndarray, used: np.ndarray) -> np.ndarray:
        each = counts.sum(axis=1)
        share = (counts[:, used] + _SMOOTH * self.prior[used]) / (each + _SMOOTH)[:, None]
        return np.maximum(each - self.discount, 0)[:, None] * share


def _cells(shares: Shares, used: np.ndarray):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The known words' shares by cell and class."""
        total = np.zeros((sequences.CELLS, len(used)))
        for batch in batches:
            for row in batch.itertuples():
                own, cell = shares.of(expand(row.counts, np.int64, CLASSES), used), sequences.cells(word_hashes(expand_words(row.words)))
                for k in range(len(used)):
                    total[:, k] += np.bincount(cell, own[:, k], sequences.CELLS)
        yield pd.DataFrame({"i": np.arange(total.size), "x": total.ravel()})

    return of


def _scored(tables, mixer: tuple[np.ndarray, np.ndarray], shares: Shares, total: np.ndarray, used: np.ndarray, group: np.ndarray):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each class the logarithm of a known word's probability among the known ones, or of an unknown word's spelling."""
        model, table = mixing.Mixer(*mixer), mixing.predictions(tables.value)
        groups, place = np.unique(group[used], return_inverse=True)
        for batch in batches:
            for row in batch.itertuples():
                words, counts = expand_words(row.words), expand(row.counts, np.int64, CLASSES)
                each = counts.sum(axis=1)
                log_p = np.log(np.maximum(shares.of(counts, used) / total, 1e-300))
                new = np.flatnonzero(each == 0)
                log_p[new] = model.log_probabilities([words[i] for i in new.tolist()], groups.tolist(), table)[:, place]
                yield pd.DataFrame({"bucket": [row.bucket], "n": [row.n], "words": [row.words], "counts": [squeeze(each)], "log_p": [squeeze(log_p.astype(np.float32))]})

    return of


def _fetched(width: int):
    def of(asked: pd.DataFrame, scored: pd.DataFrame) -> pd.DataFrame:
        """Each chunk's words of a bucket (one share of its chunks), with count and probabilities in the chunk's order."""
        columns = [x.split()[0] for x in VALUES.split(", ")]
        if not len(scored) or not len(asked):
            return pd.DataFrame([], columns=columns)
        row = scored.iloc[0]
        words = expand_words(row.words)
        place, hashes = {w: i for i, w in enumerate(words)}, word_hashes(words)
        counts, log_p = expand(row.counts, np.int64), expand(row.log_p, np.float32).reshape(-1, width)
        out = []
        for r in asked.itertuples():
            at = np.fromiter(map(place.__getitem__, expand_words(r.words)), np.int64, r.n)
            out.append((r.chunk, r.first, r.n, squeeze(hashes[at]), squeeze(counts[at]), squeeze(log_p[at])))
        return pd.DataFrame(out, columns=columns)

    return of


def leaning(log_p: np.ndarray, start: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Before each token of a document, the class that the tokens before it speak for."""
    out, gate = np.empty(len(codes), np.uint8), start
    for i in range(0, len(codes), _BLOCK):
        sums = np.cumsum(np.vstack([gate, log_p[codes[i : i + _BLOCK]]]), axis=0, dtype=np.float64)
        out[i : i + _BLOCK] = sums[:-1].argmax(axis=1)
        gate = sums[-1]
    return out


def _ready(prior: np.ndarray):
    def of(docs: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        """A chunk's row of READY."""
        values, start = values.sort_values("first"), np.log(prior)
        all_of = lambda c, kind: np.concatenate([expand(x, kind) for x in values[c]])
        log_p = all_of("log_p", np.float32).reshape(-1, len(prior))
        codes = [expand(x, np.uint32) for x in docs["codes"]]
        own = {c: [docs[c].tolist()] for c in ("doc_id", "no_id", "held_out", "n_bytes")} | {"n_tokens": [[len(x) for x in codes]], "codes": [squeeze(np.concatenate(codes))]}
        own |= {"leaning": [squeeze(np.concatenate([leaning(log_p, start, x) for x in codes]))], "hashes": [squeeze(all_of("hashes", np.uint32))], "counts": [squeeze(all_of("counts", np.int64))], "log_p": [squeeze(log_p)]}
        return pd.DataFrame(own)

    return of


def _tokens(row, at_least: int, training: bool) -> tuple[sequences.Tokens, np.ndarray]:
    """A chunk's tokens, or those of its training documents, and their codes; words of ``at_least`` so many training tokens are known."""
    codes, lean, lengths = expand(row.codes, np.uint32), expand(row.leaning, np.uint8), np.asarray(row.n_tokens, np.int64)
    first = np.zeros(len(codes), bool)
    first[np.cumsum(lengths) - lengths] = True  # a document has its end at least
    if training:
        kept = np.repeat(~np.asarray(row.held_out, bool), lengths)
        codes, lean, first = codes[kept], lean[kept], first[kept]
    return sequences.Tokens(expand(row.hashes, np.uint32)[codes], (expand(row.counts, np.int64) >= at_least)[codes], first, lean), codes


def _counted(batch: pd.DataFrame, total: np.ndarray) -> None:
    for row in batch.itertuples():
        sequences.count_bits(_tokens(row, 2, True)[0], total.reshape(sequences.PREDICTORS, -1))


def _sequence_weights(tables):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixer, leave_out, n = sequences.Mixer(), sequences.without_own(tables.value), 0
        for batch in batches:
            for row in batch.itertuples():
                tokens, codes = _tokens(row, 2, True)
                mixer.train(tokens, leave_out)
                n += len(codes)
        if n:
            yield _learned(mixer, n)

    return of


def _learned(mixer, n: int) -> pd.DataFrame:
    return pd.DataFrame({"i": np.arange(mixer.weights.size + mixer.refine.size), "x": np.concatenate([mixer.weights.ravel() * n, mixer.refine.ravel()]), "n": n})


def _model(df: DataFrame, train, start) -> tuple[np.ndarray, np.ndarray]:
    """The tasks' weights, averaged by what they saw, and their maps that refine, added up."""
    flat = np.concatenate([start.weights.ravel(), start.refine.ravel()]).astype(np.float64)
    for r in df.mapInPandas(train, "i long, x double, n long").groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
        flat[r.i] = r.x / r.n if r.i < start.weights.size else r.x
    return flat[: start.weights.size].reshape(start.weights.shape), flat[start.weights.size :].reshape(start.refine.shape)


def _texts(tables, mixer: tuple[np.ndarray, np.ndarray], log_cells: np.ndarray, tokens: int, distinct: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, table = sequences.Mixer(*mixer), sequences.predictions(tables.value)
        for batch in batches:
            for row in batch.itertuples():
                own, codes = _tokens(row, 1, False)
                counts, log_p = expand(row.counts, np.int64), expand(row.log_p, np.float32).reshape(-1, log_cells.shape[1])
                each, base_of = model.log_probabilities(own, table), np.log10((counts + 1) / (tokens + 1 * (distinct + 1)))
                for k in range(0, len(codes), _BLOCK):
                    b = slice(k, k + _BLOCK)
                    each[b] += log_p[codes[b], own.leaning[b]] - np.where(own.known[b], log_cells[sequences.cells(own.hashes[b]), own.leaning[b]], 0)
                at = np.flatnonzero(own.first)
                score = np.add.reduceat(each, at) / np.log(10)
                base = np.add.reduceat(base_of[codes], at)
                known = np.add.reduceat(own.known, at, dtype=np.int64)
                doc = pd.array([None if none else i for i, none in zip(row.doc_id, row.no_id, strict=True)], "Int64")
                out = pd.DataFrame({"doc_id": doc, "held_out": row.held_out, "n_tokens": row.n_tokens, "n_known": known, "train_tokens": tokens, "base_score": base, "score": score})
                yield out.assign(bits_per_byte=-score / np.log10(2) / np.asarray(row.n_bytes))

    return of


def score_texts(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None) -> DataFrame:
    """A row of SCORES for each document; the model learns from those that aren't ``held_out``."""
    spark = docs.sparkSession
    bound_batches(spark)
    release_shuffles(spark)
    of_class = F.pmod(F.crc32(F.coalesce(docs[class_col].cast("string"), F.lit("")).cast("binary")), F.lit(CLASSES)).cast("int") if class_col else F.lit(0)
    own = docs.select(*id_columns(docs[id_col]), docs[text_col].alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), of_class.alias("class"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-size // BUCKET_BYTES))
    coded = staged(own.mapInPandas(_coded(buckets), CODED), "coded")
    asked = coded.where("kind = 1").select("chunk", "bucket", "first", "n", "words", "counts")
    shares = staged(asked.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / FAN).alias("shares")), "shares")
    asked = asked.join(shares, "bucket").withColumn("share", F.pmod(F.xxhash64("chunk"), "shares")).drop("shares")
    parts, kind, most = asked.select("bucket", "share", "words", "counts"), np.uint32, shares.agg(F.max("shares")).first()[0] or 0
    while most > 1:
        parts, kind, most = parts.groupBy("bucket", "share").applyInPandas(_share(kind), PARTS), np.int64, -(-most // FAN)
        parts = parts.withColumn("share", F.col("share") % most)
    words = words_staged = staged(parts.groupBy("bucket").applyInPandas(_summed(kind), WORDS), "words")

    per_class = [F.sum(F.col("tokens")[k]) for k in range(CLASSES)]
    distinct, once, twice, *by_class = (x or 0 for x in words.agg(*map(F.sum, ("known", "once", "twice")), *per_class).first())
    by_class = np.array(by_class, np.float64)
    tokens = int(by_class.sum())
    shares_of = Shares(by_class / max(tokens, 1), min(max(once / max(once + 2 * twice, 1), 0.05), 0.95))
    used, group = np.flatnonzero(by_class > 0) if tokens else np.arange(1), spelling_groups(by_class)

    words = words.repartition(partitions(spark), "bucket")
    in_cells = np.zeros(sequences.CELLS * len(used))
    for r in words.mapInPandas(_cells(shares_of, used), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        in_cells[r.i] = r.x
    in_cells = in_cells.reshape(sequences.CELLS, len(used))
    total = np.maximum(in_cells.sum(axis=0), 1e-300)
    log_cells = np.log(np.maximum(in_cells / total, 1e-300))
    table = summed(words, _slots(group), mixing.PREDICTORS * 2 * mixing.SLOTS).reshape(mixing.PREDICTORS, 2 * mixing.SLOTS)
    tables = spark.sparkContext.broadcast(table)
    model = _model(words, _weights(tables, group), mixing.Mixer())

    scored = words.mapInPandas(_scored(tables, model, shares_of, total, used, group), SCORED)
    copies = scored.join(shares, "bucket").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    values = asked.drop("counts").groupBy("bucket", "share").cogroup(copies.groupBy("bucket", "share")).applyInPandas(_fetched(len(used)), VALUES)
    texts = coded.where("kind = 0").select("chunk", *id_columns(F.col("doc_id")), "held_out", "n_bytes", "codes")
    ready = staged(texts.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInPandas(_ready(shares_of.prior[used] if tokens else np.ones(1)), READY), "ready")
    discard(coded, words_staged)

    table = summed(ready, _counted, sequences.SIZE).reshape(sequences.PREDICTORS, 2 * sequences.SLOTS)
    tables = spark.sparkContext.broadcast(table)
    model = _model(ready, _sequence_weights(tables), sequences.Mixer())
    return ready.mapInPandas(_texts(tables, model, log_cells, tokens, distinct), SCORES)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 2
    return score_texts(docs, held_out, class_col="lang")

"""Token shards as wavelet matrices (Claude, Navarro and Ordóñez): one compressed file a shard, with access, rank, select and occurrences.

A shard's ids are stored as bit planes from the highest bit down; after each plane the ids are dealt stably into those with a 0
and those with a 1. A plane keeps running counts of ones, so that a position can be followed down the planes (access, rank) and
up again (select) without unpacking the rest.

Documents are range-partitioned by id, so shards are in ascending order of doc_id and hold whole documents. Each shard is
one row of a Parquet table in the shared folder; Spark's committer writes it, so lost executors leave no half-written shard.

Defined results: a null or empty text has its end id alone; rows with equal doc_id keep the order of their text's hash;
null ids come first; an empty table gives no shard; extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.shared import bound_batches, id_columns, ids, partitions, staged
from shelfwise.llm.tokens import tokenizer

END = 2
SHARD_TOKENS = 2_000_000
_MAGIC = b"WVM1"
_BLOCK = 4096  # bits between two running counts


class WaveletMatrix:
    """``planes``: packed bits of each plane; ``zeros``: ids with a 0 there; ``ones``: ones before each block."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ones: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ones = n, planes, zeros, ones

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.asarray(ids)
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        dealt, planes, zeros, ones = np.empty_like(ids), [], [], []
        for k in reversed(range(bits)):
            bit = (ids & ids.dtype.type(1 << k)) != 0
            planes.append(np.packbits(bit))
            ones.append(cls._directory(planes[-1]))
            low = len(ids) - int(ones[-1][-1])
            zeros.append(low)
            np.compress(~bit, ids, out=dealt[:low])
            np.compress(bit, ids, out=dealt[low:])
            ids, dealt = dealt, ids
        return cls(len(ids), planes, zeros, ones)

    @staticmethod
    def _directory(packed: np.ndarray) -> np.ndarray:
        each = np.bitwise_count(packed).astype(np.int64)
        step = _BLOCK // 8
        return np.concatenate([[0], np.cumsum(np.add.reduceat(each, np.arange(0, len(each), step)))]) if len(each) else np.zeros(1, np.int64)

    def to_bytes(self) -> bytes:
        squeeze = zstandard.ZstdCompressor(level=1)
        parts = [_MAGIC, struct.pack("<QB", self.n, len(self.planes))]
        for plane, zeros, ones in zip(self.planes, self.zeros, self.ones, strict=True):
            bits, counts = squeeze.compress(plane.tobytes()), squeeze.compress(ones.astype("<u4").tobytes())
            parts += [struct.pack("<QII", zeros, len(bits), len(counts)), bits, counts]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        if raw[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix")
        n, levels = struct.unpack_from("<QB", raw, 4)
        at, planes, zeros, ones = 13, [], [], []
        expand = zstandard.ZstdDecompressor()
        for _ in range(levels):
            z, a, b = struct.unpack_from("<QII", raw, at)
            at += 16
            planes.append(np.frombuffer(expand.decompress(raw[at : at + a]), np.uint8))
            ones.append(np.frombuffer(expand.decompress(raw[at + a : at + a + b]), "<u4").astype(np.int64))
            zeros.append(z)
            at += a + b
        return cls(n, planes, zeros, ones)

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at >> 3]) >> (7 - (at & 7)) & 1

    def _ones(self, level: int, at: int) -> int:
        """Ones before position ``at``."""
        block = at // _BLOCK
        part = self.planes[level][block * (_BLOCK // 8) : at >> 3]
        n = int(self.ones[level][block]) + int(np.bitwise_count(part).sum())
        return n + ((int(self.planes[level][at >> 3]) >> (8 - (at & 7))).bit_count() if at & 7 else 0)

    def access(self, at: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, at), self._ones(level, at)
            value = value << 1 | bit
            at = zeros + ones if bit else at - ones
        return value

    def _range(self, value: int, first: int, after: int) -> tuple[int, int]:
        """Where the ids equal to ``value`` among positions first..after-1 end up below the last plane."""
        levels = len(self.planes)
        if value >> levels:
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, first), self._ones(level, after)
            first, after = (zeros + a, zeros + b) if value >> (levels - 1 - level) & 1 else (first - a, after - b)
        return first, after

    def rank(self, value: int, at: int) -> int:
        """How often ``value`` stands before position ``at``."""
        first, after = self._range(value, 0, at)
        return after - first

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def occurrences(self, value: int) -> np.ndarray:
        """All positions of ``value``, followed up the planes from the last one."""
        first, after = self._range(value, 0, self.n)
        at = np.arange(first, after)
        for level in reversed(range(len(self.planes))):
            bit = value >> (len(self.planes) - 1 - level) & 1
            bits = np.unpackbits(self.planes[level], count=self.n)
            at = np.flatnonzero(bits == bit)[at - self.zeros[level] * bit]
        return at

    def select(self, value: int, k: int) -> int:
        """Position of the k-th ``value``, from 0."""
        first, after = self._range(value, 0, self.n)
        if not 0 <= k < after - first:
            raise IndexError(k)
        at = first + k
        for level in reversed(range(len(self.planes))):
            bit = value >> (len(self.planes) - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] * bit)
        return at

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        ones = self.ones[level]
        before = ones if bit else np.minimum(np.arange(len(ones)) * _BLOCK, self.n) - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * (_BLOCK // 8) : (block + 1) * (_BLOCK // 8)])
        return block * _BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def decode(self) -> np.ndarray:
        """All ids, put together from the last plane up."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, level in enumerate(reversed(range(len(self.planes)))):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            up = np.empty_like(out)
            up[~bit] = out[: self.zeros[level]]
            up[bit] = out[self.zeros[level] :] | out.dtype.type(1 << k)
            out = up
        return out.astype(np.uint32)


SHARDS = "part int, shard int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, matrix binary"
READ = "doc_id long, part int, shard int, within long, n_tokens long, ids_crc32 long"


def write_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, split: str = "white space", end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The shard table, written to the shared folder in ascending order of the id and opened again."""
    spark = docs.sparkSession
    bound_batches(spark)
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, shard = tokenizer(path, split), TaskContext.get().partitionId(), 0
        docs_in, ids_in, n = [], [], 0

        def written():
            matrix = WaveletMatrix.build(np.concatenate(ids_in)).to_bytes()
            return pd.DataFrame({"part": [part], "shard": [shard], "n_tokens": [n], "doc_ids": [docs_in], "doc_tokens": [[len(x) for x in ids_in]], "matrix": [matrix]})

        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            for doc, tokens in zip(ids(batch), encoder.encode(texts), strict=True):
                docs_in.append(doc)
                ids_in.append(np.append(tokens, np.uint32(end)))
                n += len(tokens) + 1
                if n >= shard_tokens:
                    yield written()
                    docs_in, ids_in, n, shard = [], [], 0, shard + 1
        if docs_in:
            yield written()

    own = docs.select(*id_columns(docs[id_col]), docs[text_col].alias("text"))
    ordered = own.repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return staged(ordered.mapInPandas(of, SHARDS), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """A row of READ for each document of the shard table, its ids decoded from the planes."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, sizes = WaveletMatrix.from_bytes(row.matrix).decode().astype("<u4"), np.asarray(row.doc_tokens, np.int64)
                first = np.cumsum(sizes) - sizes
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(first.tolist(), sizes.tolist(), strict=True)]
                docs = pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], dtype="Int64")
                yield pd.DataFrame({"doc_id": docs, "part": row.part, "shard": row.shard, "within": first, "n_tokens": sizes, "ids_crc32": crc})

    return shards.mapInPandas(of, READ)


def shard_starts(shards: DataFrame) -> DataFrame:
    """Ids before each shard: sums of the parts before (a row for each range partition) and of the shards before within the part."""
    sizes = shards.select("part", "shard", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("shard_start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_shards(shards).join(shard_starts(shards), ["part", "shard"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")

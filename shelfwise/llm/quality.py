"""Quality rules by compression bands.

Each text gets zstandard ratios (compressed bytes / bytes) over the whole text and over fixed chunks. A band, chosen by
length, holds the ratios that ordinary prose has: a text under its band repeats itself, one above it can't be compressed
(base64, keys). A text that gets no smaller than its byte frequencies alone make it has no repeats, as hex has none. Only
counters of the text itself decide, so a partition needs nothing from any other one. Hex under 3072 bytes has the ratios of prose and stays.

Defined results: a null or empty text has no words and is rejected by the base rule; ties and repeated rows are judged one
by one; extra columns stay as they are (a result column whose name is taken gets another, see ``free_name``); an empty
table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.shared import bound_batches, free_name
from shelfwise.llm.words import hash_words, utf8, windows

CHUNK = 4096
LEVEL = 3
#: (bytes, least ratio, greatest ratio); between two lengths the limits lie on a line over the logarithm of the length. Production parameters. The least
#: ratios are under those of all texts of good quality in one half of the labelled documents of sf0.1 (by crc32 of the id), and lower still where ordinary
#: prose of another kind goes lower: licences, which are the most regular prose there is, have 0.438 at 2 KB, 0.409 at 4 KB, 0.361 at 8 KB and 0.334 at 16 KB.
#: The greatest leave room for prose of many names and numbers. Texts under 256 bytes tell nothing.
BANDS = (
    (256, 0.420, 0.86), (384, 0.440, 0.80), (512, 0.450, 0.76), (768, 0.448, 0.72), (1024, 0.445, 0.68), (1536, 0.438, 0.64), (2048, 0.430, 0.62), (3072, 0.415, 0.58),
    (4096, 0.400, 0.55), (6144, 0.372, 0.50), (8192, 0.350, 0.50), (16384, 0.322, 0.48), (32768, 0.290, 0.48), (131072, 0.220, 0.48),
)
#: A chunk may be so much more regular than a whole text of its length: a licence's warranty, say.
CHUNK_ROOM = 0.07
#: (bytes from which it holds, greatest quotient of the ratio and that of the byte frequencies alone): over all documents of sf0.1 and check_s
#: at most 1.009 from 3072 bytes and 0.975 from 4096; hex has 1.037-1.059 and 1.007-1.051.
GAINS = ((0, 9.9), (3072, 1.02), (4096, 1.0))
#: Share of chunks that must leave the band of their own length before a text that passes as a whole is rejected.
BAD_CHUNKS = 0.25

SIGNALS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, whole_ratio double, least_chunk_ratio double, greatest_chunk_ratio double, reason string"


_LENGTHS, _LEAST, _MOST = (np.array(x, np.float64) for x in zip(*BANDS, strict=True))


def band(n_bytes: int) -> tuple[float, float]:
    """Least and greatest ratio of a text or chunk of so many bytes."""
    if n_bytes < _LENGTHS[0]:
        return 0.0, np.inf
    at = np.log2(n_bytes)
    return float(np.interp(at, np.log2(_LENGTHS), _LEAST)), float(np.interp(at, np.log2(_LENGTHS), _MOST))


def frequency_ratio(raw: bytes) -> float:
    """The ratio that the frequencies of the bytes alone allow."""
    n = np.bincount(np.frombuffer(raw, np.uint8))
    share = n[n > 0] / len(raw)
    return float(-(share * np.log2(share)).sum()) / 8


def too_large(raw: bytes, ratio: float) -> bool:
    most = next(most for least, most in reversed(GAINS) if len(raw) >= least)
    return ratio > band(len(raw))[1] or len(raw) >= GAINS[1][0] and ratio > most * frequency_ratio(raw)


def verdict(raw: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[float, float, float, str | None]:
    """Ratios of the whole text and of its least and most compressible chunk, and why it is rejected, if it is."""
    if not raw:
        return 0.0, 0.0, 0.0, None
    whole = len(squeeze.compress(raw)) / len(raw)
    if len(raw) <= CHUNK:
        parts, ratios = [raw], [whole]
    else:
        parts = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        ratios = [len(squeeze.compress(p)) / len(p) for p in parts]
    under = sum(len(p) for r, p in zip(ratios, parts, strict=True) if r < band(len(p))[0] - (CHUNK_ROOM if len(parts) > 1 else 0))
    over = sum(len(p) for r, p in zip(ratios, parts, strict=True) if too_large(p, r))
    reason = (
        "repetitive" if whole < band(len(raw))[0]
        else "incompressible" if too_large(raw, whole)
        else "repetitive chunks" if under > BAD_CHUNKS * len(raw)
        else "incompressible chunks" if over > BAD_CHUNKS * len(raw)
        else None
    )
    return whole, min(ratios), max(ratios), reason


def repeated_words(h: np.ndarray, size: int = 5) -> int:
    """Words in windows of ``size`` words that are found twice or more in the text, the first included."""
    w = windows(h, size)
    if len(w) < 2:
        return 0
    s = np.sort(w)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(w, again))
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def signals_of(texts: pd.Series) -> pd.DataFrame:
    """A row of SIGNALS for each text."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    raws = [utf8(t if isinstance(t, str) else None) for t in texts]
    rows = []
    for text, raw in zip(texts, raws, strict=True):
        own = hash_words(raw)
        word_chars = (len(text) if raw else 0) - (len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c")))
        symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
        lines = Counter(x for x in raw.split(b"\n") if x.split()) if b"\n" in raw else {}
        repeat = repeated_words(own)
        failed = len(own) < 10 or 100 * repeat > 20 * len(own)
        whole, least, most, reason = verdict(raw, squeeze)
        rows.append((len(own), word_chars, symbols, sum(n - 1 for n in lines.values()), repeat, failed, not failed and reason is None, whole, least, most, reason))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in SIGNALS.split(", ")])


def signals(text: Column) -> Column:
    """The struct of SIGNALS as a column, for use beside any other columns."""

    @F.pandas_udf(SIGNALS)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            yield signals_of(t)

    return of.asNondeterministic()(text)  # so that it is evaluated once, not again in a filter


def judge(docs: DataFrame, text_col: str = "text", out: str = "quality_signals") -> DataFrame:
    """``docs`` with the struct of SIGNALS in column ``out``."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(free_name(docs, out), signals(F.col(text_col)))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "quality_signals.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    own = free_name(docs, "quality")
    return judge(docs, out=own).where(f"{own}.kept").drop(own)

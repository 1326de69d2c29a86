"""Fill-in-the-middle: texts cut into prefix, middle and suffix at ranks of units, and put together around sentinels.

Units are runs of the letters A-Z and a-z, and each other character by itself. Both cuts are ranks among a text's units; the
code points at which they lie come from an indexable skip list over the boundaries between units. Its lanes link ever fewer
boundaries, and each link carries two widths: how many units and how many code points it passes. A descent adds widths up
while they stay within the rank, goes down a lane where they don't, and ends exactly at the boundary of that rank.
Random numbers come from SHA-256 of a seed and the document's id, so any executor makes the same cuts again.

Defined results: a null or empty text, and one that contains a sentinel, stays as it is (form ``plain``, no cuts; null
counts as empty); a null id has the random numbers of an empty id; rows that repeat an id are cut alike, by their own
texts; long texts are cut whole; extra columns stay as they are (a result column whose name is taken gets another, see
``free_name``); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.shared import bound_batches, free_name
from shelfwise.llm.words import mix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Percent of texts that are transformed, and of these the percent that have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
CUTS = "n long, form string, prefix_chars long, middle_chars long, output string"

#: A boundary reaches each further lane with a chance of one in 2**THIN.
THIN, LANES = 2, 12


class _Towers:
    """Which boundaries stand in each lane, and at which place of the lane below; the same for every list, so only made once a process and as far as needed."""

    def __init__(self) -> None:
        self.size, self.at, self.down = 0, [], []

    def upto(self, size: int) -> _Towers:
        if size > self.size:
            self.size = max(size, 2 * self.size, 1 << 14)
            h = mix(np.arange(self.size, dtype=np.uint64))
            self.at, self.down = [], [np.empty(0, np.int64)]
            for lane in range(1, LANES):
                high = h & np.uint64((1 << THIN * lane) - 1) == 0
                high[0] = True  # the head is as high as the list
                self.at.append(np.flatnonzero(high))
                self.down.append(self.at[-1] if lane == 1 else np.searchsorted(self.at[-2], self.at[-1]))
        return self


_TOWERS = _Towers()


class SkipList:
    """Over the boundaries between a text's units. ``ends``: code points before each boundary but the first, which lies at 0.

    ``units[lane][i]`` and ``chars[lane][i]`` are the widths of the link that leaves the i-th boundary of that lane."""

    def __init__(self, ends: np.ndarray):
        self.n = len(ends)
        chars_at = np.concatenate([[0], ends])
        towers = _TOWERS.upto(self.n + 1)
        self.units, self.chars, self.down = [np.ones(self.n, np.int64)], [np.diff(chars_at)], towers.down
        for at in towers.at:
            own = at[: np.searchsorted(at, self.n, side="right")]
            if len(own) < 2:  # no link in this lane or any above it
                break
            self.units.append(np.diff(own))
            self.chars.append(np.diff(chars_at[own]))

    def find(self, rank: int) -> int:
        """The code point at which so many units end."""
        if not 0 <= rank <= self.n:
            raise IndexError(f"rank {rank} of {self.n} units")
        units = chars = at = 0
        for lane in reversed(range(len(self.units))):
            u, c = self.units[lane], self.chars[lane]
            while at < len(u) and units + u[at] <= rank:
                units, chars, at = units + int(u[at]), chars + int(c[at]), at + 1
            if lane:
                at = int(self.down[lane][at])
        return chars


def unit_ends(text: str) -> np.ndarray:
    """The code point after each unit."""
    c = np.frombuffer(text.encode("latin-1"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (c | 32) - c.dtype.type(97) < 26
    ends = np.ones(len(c), bool)
    ends[:-1] = ~(letter[:-1] & letter[1:])
    return np.flatnonzero(ends) + 1


class Cut(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def cut(text: str, draw: str, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> Cut:
    """``draw``: at least 32 hexadecimal digits, four random numbers of eight."""
    ends = unit_ends(text)
    h1, h2, h3, h4 = (int(draw[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return Cut(len(ends), "plain", None, None, text)
    units = SkipList(ends)
    a, b = (units.find(rank) for rank in sorted((h1 % (units.n + 1), h2 % (units.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return Cut(units.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Cut(units.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, out: str = "fill_in_middle") -> DataFrame:
    """``docs`` with the struct of CUTS in column ``out``."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf(CUTS)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, draws in batches:
            rows = [cut(t if isinstance(t, str) else "", d, rate, suffix_first) for t, d in zip(texts, draws, strict=True)]
            yield pd.DataFrame(rows, columns=Cut._fields).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    draws = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))), 256)
    return docs.withColumn(free_name(docs, out), of.asNondeterministic()(docs[text_col], draws))  # evaluated once, not again in a filter


def _around(text: Column, sentinel: str) -> tuple[Column, Column]:
    """What stands before and after the first sentinel."""
    before = F.substring_index(text, sentinel, 1)
    return before, F.substr(text, F.length(before) + len(sentinel) + 1)


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given, from its output and form alone.

    No part contains a sentinel, and none can arise where a part meets one, for ``<`` and ``>`` stand only at their ends."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    prefix, rest = _around(body, SUFFIX)
    suffix, middle = _around(rest, MIDDLE)
    suffix_2, rest_2 = _around(body, PREFIX)
    prefix_2, middle_2 = _around(rest_2, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_2, middle_2, suffix_2)).otherwise(output)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    of = transform(docs).select("doc_id", "fill_in_middle.*")
    return of.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = """
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
units AS (
  SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS us, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM drawn),
ranks AS (
  SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS first_cut, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS last_cut,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (
  SELECT *, coalesce(array_to_string(us[1:first_cut], ''), '') AS p, coalesce(array_to_string(us[first_cut + 1:last_cut], ''), '') AS m,
    coalesce(array_to_string(us[last_cut + 1:], ''), '') AS s FROM ranks)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts
"""

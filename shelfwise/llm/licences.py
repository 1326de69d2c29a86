"""Licence scan by a positional index of rare words.

Each template keeps as index terms its words of highest IDF over the whole corpus, with their positions in the template. A text
looks up all terms of each template whose mandatory phrases stand in it as a whole; every place of such a term proposes, for each
posting, where the template would start. Proposals that agree intersect the postings by relative position; a template is found
where enough of all its terms agree, whatever other templates the text holds.

DataFrame functions only; two passes over the texts. The first counts in how many texts each template word stands (as many rows as the
templates have words); the second is row-local, so no text, word or licence can make a partition larger than others.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are judged one by one; extra
columns stay as they are (a result column whose name is taken gets another, see ``free_name``); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.shared import free_name, hidden_prefix

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of words in small letters, the ASCII ones one by one: the engine looks such a set up in a table, and tests ranges in turn.
_WORD = f"[{_LOWER}0123456789" + r"\x{80}-\x{10FFFF}]+"

#: Phrases and labels of the base rule.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Fixed values: (label, mandatory phrases, notice); short notices, and the wording of licences and of the headers they ask for.
TEMPLATES = (
    ("agpl-3.0", ("gnu affero general public license",), "licensed under the gnu affero general public license version 3"),
    ("apache-2.0", ("apache license", "version 2 0"), "licensed under the apache license version 2 0"),
    ("apache-2.0", ("apache license", "version 2 0"), "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd-2-clause", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice"), "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is"),
    ("bsd-3-clause", ("redistribution and use in source and binary forms",), "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", ("redistribution and use in source and binary forms", "endorse or promote products derived from this software"), "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsl-1.0", ("boost software license",), "distributed under the boost software license version 1 0"),
    ("cc-by-4.0", ("cc by 4 0",), "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", ("cc by nc 4 0",), "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", ("cc by sa 4 0",), "licensed under cc by sa 4 0"),
    ("cc0-1.0", ("cc0 1 0",), "dedicated to the public domain under cc0 1 0 universal"),
    ("epl-2.0", ("eclipse public license",), "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("gpl-3.0", ("gnu general public license", "version 3"), "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", ("gnu general public license", "version 3"), "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("isc", ("permission to use copy modify and or distribute this software",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-3.0", ("gnu lesser general public license",), "licensed under the gnu lesser general public license version 3"),
    ("mit", ("mit license",), "released under the mit license"),
    ("mit", ("permission is hereby granted free of charge",), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", ("permission is hereby granted free of charge", "without restriction"), "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", ("mozilla public license",), "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", ("free and unencumbered software",), "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", ("without any express or implied warranty",), "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
)
TERMS = 8  # index terms of a template
ENOUGH = 0.5  # share of a template's places of index terms that must agree on where it starts


def lowered(text: Column) -> Column:
    """A-Z in small letters; other letters may become small too, but none becomes an ASCII one: the only sign that would is kept from it."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(text, F.lit("\u212a")), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def words_of(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase starts, words counted from 0."""
    own = phrase.split()
    fits = lambda i: [F.get(words, i + k) == w for k, w in enumerate(own)]

    def all_of(i: Column) -> Column:
        out, *rest = fits(i)
        for x in rest:
            out = out & x
        return F.coalesce(out, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), all_of)


def _has(text: Column, phrase: str) -> Column:
    """Whether all words of the phrase occur in the text as strings: cheap, and true wherever the phrase is."""
    out = F.lit(True)
    for w in phrase.split():
        out = out & F.contains(text, F.lit(w))
    return out


def _starts(at: Column, word: str, position: int) -> Column:
    """Where the template would start for each place of a word that stands at ``position`` in it."""
    return F.transform(F.filter(at, lambda x: x["w"] == word), lambda x: x["i"] - position)


def _strings(x) -> Column:
    return F.array(*[F.lit(w) for w in x]) if x else F.array().cast("array<string>")


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many texts each word stands: one row a word comes to the driver, whatever the corpus."""
    found = docs.select(F.explode(F.array_intersect(words_of(lowered(F.col(text_col))), _strings(vocabulary))).alias("word"))
    return {r.word: r.n for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def index_terms(frequencies: dict[str, int], templates) -> list[list[tuple[str, int]]]:
    """Of each template its TERMS words of highest IDF, with their positions; ties by the word."""
    out = []
    for _, _, notice in templates:
        words = notice.split()
        rare = sorted(set(words), key=lambda w: (frequencies.get(w, 0), w))[:TERMS]
        out.append([(w, i) for i, w in enumerate(words) if w in rare])
    return out


def _longest_run(starts: Column) -> Column:
    """How many of the starts are the same, of the start that most agree on."""
    step = lambda a, x: F.when(x == a["start"], a["run"] + 1).otherwise(F.lit(1))
    return F.aggregate(
        F.array_sort(starts), F.struct(F.lit(None).cast("int").alias("start"), F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda a, x: F.struct(x.alias("start"), step(a, x).alias("run"), F.greatest(a["best"], step(a, x)).alias("best")), lambda a: a["best"],
    )


def scan(docs: DataFrame, *, text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, out: str = "licence") -> DataFrame:
    """``docs`` with a struct of n_words, n_base, first_word, last_word, base_labels, labels and score."""
    vocabulary = sorted({w for _, _, notice in templates for w in notice.split()})
    terms = index_terms(document_frequencies(docs, text_col, vocabulary), templates)
    p, out = hidden_prefix(docs), free_name(docs, out)
    low, words, joined, sure, at, scores, starts, base = (F.col(f"{p}{c}") for c in ("low", "words", "joined", "sure", "at", "scores", "starts", "base"))
    every = docs.withColumn(f"{p}low", lowered(F.col(text_col))).withColumn(f"{p}words", words_of(low))

    # The base rule.
    none = F.array().cast("array<int>")
    places = [F.when(_has(low, x), _places(words, x)).otherwise(none) for x, _ in phrases]
    labels = F.array_compact(F.array(*[F.when(_has(low, x), F.when(F.size(_places(words, x)) > 0, label)) for x, label in phrases]))
    every = every.withColumns({f"{p}starts": F.concat(*places), f"{p}base": labels})

    # Look up all terms of the templates whose phrases stand in the text; words are joined only where phrases can be there at all.
    phrase_sets = list(dict.fromkeys(must for _, must, _ in templates))
    any_cheap, whole = F.lit(False), []
    for must in phrase_sets:
        cheap, stands = F.lit(True), F.lit(True)
        for x in must:
            cheap, stands = cheap & _has(low, x), stands & F.contains(joined, F.lit(f" {x} "))
        any_cheap = any_cheap | cheap
        whole.append(stands)
    every = every.withColumn(f"{p}joined", F.when(any_cheap, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))).otherwise(F.lit("")))
    every = every.withColumn(f"{p}sure", F.when(joined != "", F.array(*whole)).otherwise(F.array_repeat(F.lit(False), len(whole))))
    is_sure = [F.get(sure, F.lit(phrase_sets.index(must))) for _, must, _ in templates]
    wanted = F.array_distinct(F.concat(*[F.when(x, _strings([w for w, _ in own])).otherwise(_strings([])) for x, own in zip(is_sure, terms, strict=True)]))
    found = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(wanted, w), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull())
    every = every.withColumn(f"{p}at", F.when(F.exists(sure, lambda x: x), found).otherwise(F.array().cast("array<struct<i:int,w:string>>")))

    # Intersect the postings by where the template would start; a place of a term proposes a start once.
    shares = []
    for own, is_there in zip(terms, is_sure, strict=True):
        share = _longest_run(F.concat(*[_starts(at, w, i) for w, i in own])) / len(own)
        shares.append(F.when(is_there, F.when(share >= ENOUGH, share).otherwise(0.0)).otherwise(0.0))
    every = every.withColumn(f"{p}scores", F.when(F.size(at) > 0, F.array(*shares)).otherwise(F.array_repeat(F.lit(0.0), len(shares))))
    own_labels = F.filter(F.zip_with(scores, _strings([label for label, _, _ in templates]), lambda x, label: F.when(x > 0, label)), lambda x: x.isNotNull())

    text_of = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    result = F.struct(
        F.size(words).cast("long").alias("n_words"), F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        text_of(base).alias("base_labels"), text_of(F.concat(base, own_labels)).alias("labels"), F.array_max(scores).alias("score"),
    )
    return every.select(*docs.columns, result.alias(out))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "licence.*")

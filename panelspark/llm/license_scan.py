"""License scans by diagonal voting (operator 4).

Every rolling k-gram of a document's words is joined with the k-grams of the
templates.  A hit at word p for template word q votes for the diagonal p - q.
Votes are summed by diagonal, neighbouring diagonals (words put in or left out)
are merged into spans, and spans with enough votes are verified word by word
against their template.
"""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LETTERS, Words, list_array, lower_ascii, text_chunks
from .line_dedup import key_of
from .shared import written

K = 4
#: Diagonals at most this far apart belong to one span.
MAX_SHIFT = 3
#: Share of a template's k-grams that must vote for a span, and of its words that must be there in order.
MIN_VOTES, MIN_SCORE = 0.3, 0.8
#: Spans that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST = 50_000

#: The phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public notices and the label of each.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


def words_of(texts: list[str]) -> Words:
    raw = [t.encode() for t in texts]
    return Words(lower_ascii(np.frombuffer(b"".join(raw), np.uint8)), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), LETTERS)


def chunk_words(column: pa.Array):
    for row, data, offsets in text_chunks(column):
        yield row, Words(lower_ascii(data), offsets, LETTERS)


def phrase_places(words: Words, phrase: np.ndarray) -> np.ndarray:
    """First words of all places where the phrase's words stand consecutively in one text."""
    at = np.flatnonzero(words.hashes == phrase[0])
    text = words.text_of()
    for j in range(1, len(phrase)):
        at = at[at + j < len(words.hashes)]
        at = at[(words.hashes[at + j] == phrase[j]) & (text[at + j] == text[at])]
    return at


def base_scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("found", T.ArrayType(T.StringType()))])
    phrases = [(words_of([p]).hashes, label) for p, label in PHRASES.items()]

    def run(batches):
        for batch in batches:
            for row, words in chunk_words(batch.column(2)):
                n = len(words.counts)
                number, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                found: list[list[str]] = [[] for _ in range(n)]
                for phrase, label in phrases:
                    at = phrase_places(words, phrase)
                    if len(at):
                        text = np.searchsorted(words.bounds, at, side="right") - 1
                        at = at - words.bounds[text]
                        number += np.bincount(text, minlength=n)
                        np.minimum.at(first, text, at)
                        np.maximum.at(last, text, at)
                        for i in np.unique(text).tolist():
                            found[i].append(label)
                none = number == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(words.counts, pa.int64()), pa.array(number), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(found, pa.list_(pa.string()))], names=schema.fieldNames()
                )

    return docs.select(key_of(id_col, text_col).alias("key"), id_col, text_col).mapInArrow(run, schema)


def rolling_grams(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, pos, gram): every k-gram hash of every document; exploded on the JVM."""

    def run(batches):
        for batch in batches:
            for row, words in chunk_words(batch.column(1)):
                hashes, _, n = words.windows(K)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), list_array(hashes.view(np.int64), n, pa.int64())], names=["key", "grams"])

    arrays = docs.select(key_of(id_col, text_col).alias("key"), text_col).mapInArrow(run, "key long, grams array<long>")
    return arrays.select("key", F.posexplode("grams").alias("pos", "gram"))


def template_grams(spark) -> DataFrame:
    rows = []
    for t, (_, text) in enumerate(TEMPLATES):
        hashes, at, _ = words_of([text]).windows(K)
        rows += [(h, t, p) for h, p in zip(hashes.view(np.int64).tolist(), at.tolist(), strict=True)]
    return spark.createDataFrame(rows, "gram long, template int, tpos int")


def candidate_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, spans): the spans of each document that has any, before verification."""
    spark = docs.sparkSession
    # the templates are fixed values, so this broadcast has a fixed size
    hits = rolling_grams(docs, id_col, text_col).join(F.broadcast(template_grams(spark)), "gram")
    votes = hits.groupBy("key", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.countDistinct("pos").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.min("tpos").alias("tlow"))
    line = Window.partitionBy("key", "template").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= MAX_SHIFT, 0).otherwise(1)
    merged = votes.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(line))
    grams = [len(words_of([text]).windows(K)[1]) for _, text in TEMPLATES]
    enough = F.element_at(F.array(*[F.lit(max(1, int(MIN_VOTES * n))) for n in grams]), F.col("template") + 1)
    spans = merged.groupBy("key", "template", "span").agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high")).where(F.col("votes") >= enough)
    return spans.groupBy("key").agg(F.collect_list(F.struct("template", "low", "high")).alias("spans"))


def verified_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, added, score, spans): what holds of the spans, word by word."""
    spans = written(candidate_spans(docs, id_col, text_col), "license-spans")
    small = spans.count() <= MAX_BROADCAST
    texts = docs.select(key_of(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(spans) if small else spans, "key").select("key", "text", "spans")
    templates = [(label, words_of([text]).hashes.tolist()) for label, text in TEMPLATES]
    schema = "key long, added array<string>, score double, spans array<struct<template:int,start:int,end:int,score:double>>"

    def run(batches):
        kind = pa.list_(pa.struct([("template", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for row, words in chunk_words(batch.column(1)):
                n = len(words.counts)
                added, best, kept = [], [], []
                for i, candidates in enumerate(batch.column(2).slice(row, n).to_pylist()):
                    own = words.hashes[words.bounds[i] : words.bounds[i + 1]].tolist()
                    good = []
                    for c in candidates:
                        label, wanted = templates[c["template"]]
                        # a span can begin and end with words that no k-gram covers; its last k-gram covers K words
                        low = max(0, c["low"] - len(wanted))
                        near = own[low : c["high"] + K + len(wanted)]
                        blocks = [b for b in difflib.SequenceMatcher(None, near, wanted, autojunk=False).get_matching_blocks() if b.size]
                        score = sum(b.size for b in blocks) / len(wanted)
                        if score >= MIN_SCORE:
                            good.append({"template": c["template"], "start": low + blocks[0].a, "end": low + blocks[-1].a + blocks[-1].size, "score": min(1.0, score)})
                    # of overlapping spans the best stay: a notice differs from its relatives in a word or two
                    good = [g for g in good if not any(h["score"] > g["score"] and h["start"] < g["end"] and g["start"] < h["end"] for h in good)]
                    kept.append(good)
                    added.append(sorted({templates[g["template"]][0] for g in good}))
                    best.append(max((g["score"] for g in good), default=0.0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(added, pa.list_(pa.string())), pa.array(best, pa.float64()), pa.array(kept, kind)], names=["key", "added", "score", "spans"])

    return joined.mapInArrow(run, schema).dropDuplicates(["key"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License phrases and notices of every whole text.

    Returns ``id_col, n_words, n_base, first_word, last_word, base_labels, labels,
    score, spans`` (template number, first word, word after the last, share of the
    template's words found in order; of overlapping spans the best), one row per input row: repeated and null
    ids stay, rows of one id and text get equal results, a null or empty text has
    no words and empty labels, an empty table gives no rows, other columns are
    ignored.  ``score`` is the best span's share, 0 without one.

    The k-grams are joined where they are read; only hits are shuffled.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))  # whatever names they have outside
    base = base_scan(docs, "id", "text")
    found = verified_spans(docs, "id", "text")
    joined = base.join(found, "key", "left")
    plain = F.array_join(F.array_sort(F.array_distinct("found")), ",")
    every = F.array_join(F.array_sort(F.array_union("found", F.coalesce("added", F.array().cast("array<string>")))), ",")
    return joined.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", plain.alias("base_labels"), every.alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans")

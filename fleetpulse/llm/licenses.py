"""License scan with a positional rare-token index (native DataFrame plan).

Templates are license notices and whole license texts as word lists, each with
one mandatory key phrase.  Over all documents the document frequency of every
template word is counted; a key phrase is indexed by its highest-IDF words (up
to ``ANCHORS``) and their offsets.  Each occurrence of such a word in a file is
a posting (template, start the phrase would have); the postings of a template's
words are intersected, so that only starts remain at which all of them stand at
their relative positions.  There the key phrase is compared word by word.  The
score is the IDF-weighted share of the best template's words that stand at
their own relative positions.

The index has a few entries per template (a constant list, not data), so it
travels inside the plan as literals: one scan counts, one scan decides, and
nothing is shuffled but the counts.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import item_words


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key_offset: int
    key_words: tuple[str, ...]
    base: bool = False


def template(label: str, text: str, key: str | None = None, base: bool = False) -> Template:
    """``text`` as item words; ``key`` (default: all of it) must occur in it."""
    words, phrase = (tuple(re.findall(r"[0-9a-z]+", x.lower())) for x in (text, key or text))
    at = next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)
    return Template(label, words, at, phrase, base)


ANCHORS = 3
START_BITS = 40                 # a posting is one number: template, then start

# Public license texts.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
GPL_FILE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}
General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""

# The base phrases, and common license notices with their mandatory phrases.
TEMPLATES = (
    template("cc-by", "cc by", base=True),
    template("gpl", "general public license", base=True),
    template("reserved", "all rights reserved", base=True),
    template("mit", "Released under the MIT License", "MIT License"),
    template("mit", MIT, "Permission is hereby granted, free of charge"),
    template("isc", ISC, "Permission to use, copy, modify, and/or distribute this software"),
    template("zlib", ZLIB, "Altered source versions must be plainly marked as such"),
    template("apache-2.0", APACHE, "Apache License, Version 2.0"),
    template("gpl-2.0", "under the terms of the GNU General Public License, version 2",
             "GNU General Public License, version 2"),
    template("gpl-3.0", "licensed under the GNU General Public License, version 3",
             "GNU General Public License, version 3"),
    template("gpl-3.0", GPL_FILE.format(name="", version="3"), "either version 3 of the License"),
    template("gpl-2.0", GPL_FILE.format(name="", version="2"), "either version 2 of the License"),
    template("lgpl", "under the terms of the GNU Lesser General Public License", "GNU Lesser General Public License"),
    template("agpl", "under the terms of the GNU Affero General Public License", "GNU Affero General Public License"),
    template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License"),
    template("bsd", BSD,
             "Redistribution and use in source and binary forms"),
    template("cc-by-nc", "Licensed under CC BY-NC 4.0", "CC BY-NC"),
    template("cc-by-sa", "Licensed under CC BY-SA 4.0", "CC BY-SA"),
    template("cc-by-4.0", "Licensed under a Creative Commons Attribution 4.0 International License",
             "Creative Commons Attribution 4.0"),
    template("unlicense", UNLICENSE,
             "free and unencumbered software"),
)


def word_idf(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> dict[str, float]:
    """``ln((1 + documents) / (1 + df)) + 1`` of each template word, counted over all documents.

    One row per template word reaches the driver."""
    vocab = sorted({w for t in templates for w in t.words})
    words = F.array_intersect(item_words(F.col(text_col)), _literal(vocab))
    # the empty word stands for "a document", so that one scan gives the total, too
    seen = docs.select(F.explode(F.concat(words, F.array(F.lit("")))).alias("word"))
    df = {r["word"]: r["df"] for r in seen.groupBy("word").agg(F.count(F.lit(1)).alias("df")).collect()}
    total = df.get("", 0)
    return {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in vocab}


def anchors(templates, idf: dict[str, float]) -> list[list[int]]:
    """Of every template the offsets of its key phrase's words of highest IDF, at most ``ANCHORS``, highest first."""
    return [sorted(range(len(t.key_words)), key=lambda j: (-idf[t.key_words[j]], j))[:ANCHORS] for t in templates]


def _literal(values, kind: str = "array<string>") -> Column:
    """An array of words or numbers as one literal."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast(kind)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, places, score`` where ``places`` is an
    array of ``(label, base, start, size, share)``, one for each place of a key phrase
    (``start`` of the phrase, word positions from 0; ``share``: matched IDF mass of the template).

    Null and empty texts have no words, no places and score 0.  Repeated rows
    and ids are scanned row by row; other columns are ignored.
    """
    idf = word_idf(docs, templates, text_col)
    index: dict[str, list] = {}
    for k, (t, offsets) in enumerate(zip(templates, anchors(templates, idf), strict=True)):
        for rank in range(ANCHORS):                     # a phrase of fewer words repeats one: no further condition
            o = offsets[rank % len(offsets)]
            index.setdefault(t.key_words[o], []).append((k, rank, o))
    first = sorted(w for w, entries in index.items() if any(rank == 0 for _, rank, _ in entries))
    postings = F.create_map(*[x for w, entries in sorted(index.items()) for x in (F.lit(w), F.array(*[
        F.struct(F.lit(k).alias("t"), F.lit(rank).alias("rank"), F.lit(o).alias("offset")) for k, rank, o in entries]))])
    catalog = F.array(*[F.struct(
        F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.key_offset).alias("key_offset"),
        _literal(t.key_words).alias("key_words"), _literal(t.words).alias("words"),
        _literal([idf[w] for w in t.words], "array<double>").alias("idf")) for t in templates])

    w = F.col("w")
    rare = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("pos"), F.try_element_at(postings, x).alias("found"))),
                    lambda x: x["found"].isNotNull())
    posted = F.flatten(F.transform(rare, lambda x: F.transform(x["found"], lambda e: F.struct(
        e["t"].alias("t"), e["rank"].alias("rank"), (x["pos"] - e["offset"]).alias("start")))))

    def posting_list(rank: int) -> Column:
        mine = F.filter("posted", lambda c: (c["rank"] == rank) & (c["start"] >= 0))
        return F.transform(mine, lambda c: F.shiftleft(c["t"].cast("long"), START_BITS) + c["start"])

    met = functools.reduce(F.array_intersect, [posting_list(rank) for rank in range(ANCHORS)])
    candidates = F.transform("met", lambda code: F.struct(
        F.shiftright(code, START_BITS).cast("int").alias("t"),
        code.bitwiseAND(F.lit((1 << START_BITS) - 1)).cast("int").alias("start")))
    described = F.transform(candidates, lambda c: F.struct(
        c["start"].alias("start"), F.get(catalog, c["t"]).alias("d")))
    verified = F.filter(described, lambda c: F.slice(
        w, c["start"] + 1, F.size(c["d"]["key_words"])) == c["d"]["key_words"])

    def share(c: Column) -> Column:
        begin = c["start"] - c["d"]["key_offset"]
        here = F.transform(c["d"]["words"], lambda x, i: F.when(
            (begin + i >= 0) & F.get(w, F.greatest(begin + i, F.lit(0))).eqNullSafe(x),
            F.get(c["d"]["idf"], i)).otherwise(F.lit(0.0)))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
        return total(here) / total(c["d"]["idf"])

    places = F.transform(verified, lambda c: F.struct(
        c["d"]["label"].alias("label"), c["d"]["base"].alias("base"), c["start"].alias("start"),
        F.size(c["d"]["key_words"]).alias("size"), share(c).alias("share")))
    none = F.array().cast("array<struct<t:int,rank:int,start:int>>")
    split = docs.select(F.col(id_col).alias("doc_id"), item_words(F.col(text_col)).alias("w"))
    hits = split.select("doc_id", "w", F.when(F.arrays_overlap("w", _literal(first)), posted).otherwise(none).alias("posted"))
    found = hits.select("doc_id", "w", met.alias("met")) \
        .select("doc_id", F.size("w").cast("long").alias("n_words"), places.alias("places"))
    score = F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0))
    return found.withColumn("score", F.round(score, 4))


def license_digest(found: DataFrame) -> DataFrame:
    """Counts, first and last base place, and label strings of :func:`scan_licenses`."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform("base_places", lambda p: p["start"].cast("long"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    return found.withColumn("base_places", base).select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("base_places").alias("base_labels"), labels("places").alias("labels"), "score")

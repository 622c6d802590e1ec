"""License scans: exact set-similarity join of text blocks with the parts of license templates, in DataFrame operations alone.

Templates are cut into parts of at most PART words, documents into blocks of BLOCK words at every STEP, so that any passage of PART words lies in a block. Tokens are
ordered by their document frequency in the whole corpus, rarest first; the first tokens of a part in that order, its prefix, hold one of every block that contains
enough of the part. Blocks without a prefix token of some part go first; the tokens of the rest meet the prefix index in a join, pairs pass a length and a positional
filter, and what is left is verified on the complete sets."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquest.llm.common import ascii_lower, saved

# Phrases of the base rule and their labels.
PHRASES = {"apache": ["apache", "license"], "gpl": ["general", "public", "license"], "mit": ["mit", "license"]}
# Public licenses in full where they are short, else the notice that their texts say to use; label and wording.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "Released under the MIT License"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License."""),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
        received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/"""),
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
        of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of
        the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
        WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
        this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
        the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software
        in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must
        not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
        either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
        author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
        large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
        this software under copyright law."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/."""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]
THRESHOLD = 0.9
BLOCK = 64
STEP = PART = BLOCK // 2
#: Parts of templates at most; the prefix index of so many is a few MB and is broadcast.
MOST_PARTS = 20_000
#: Rows of matches that are joined to their documents by a broadcast, at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
GAP_CHARS = "".join(chr(c) for c in range(0x80) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A))


def tokens(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters a-z and characters from U+0080 on."""
    trimmed = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(GAP_CHARS))
    return F.when(trimmed != "", F.split(trimmed, GAP)).otherwise(F.array().cast("array<string>"))


def words_of(text: str) -> list[str]:
    """tokens() of one text."""
    return "".join(c if c >= "\x80" or c.isalnum() else " " for c in text.translate({c: c + 32 for c in range(65, 91)})).split(" ")


def parts(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """label and distinct words, sorted, of every part of at most PART words; parts of a template are about even."""
    out = []
    for label, text in templates:
        w = [x for x in words_of(text) if x]
        n = -(-len(w) // PART)
        out += [(label, sorted(set(w[len(w) * i // n : len(w) * (i + 1) // n]))) for i in range(n)]
    if len(out) > MOST_PARTS:
        raise ValueError(f"{len(out)} parts of templates; {MOST_PARTS} at most")
    return out


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in values])


def frequencies(tokenised: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each word of the templates, over all rows; at most one count a word comes to the driver."""
    held = F.array_distinct(F.filter("__w", lambda x: x.isin(vocabulary)))
    counts = tokenised.select(F.explode(held).alias("w")).groupBy("w").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["count"] for r in counts}


def _starts(phrase: list[str]) -> Column:
    """Places of a phrase in __w, looked for only where the joined words hold it."""
    at = F.filter(F.sequence(F.lit(0), F.size("__w") - 1), lambda i: reduce(lambda a, b: a & b, [F.get("__w", i + k) == w for k, w in enumerate(phrase)]))
    return F.when(F.contains("__joined", F.lit(" " + " ".join(phrase) + " ")), at).otherwise(F.array().cast("array<int>"))


def _blocks(order: list[str], prefix: list[str], least: int) -> Column:
    """Of __w, the blocks that hold a prefix token and at least so many words of the templates: word, and own, those words in the global order."""
    places = F.filter(F.transform("__w", lambda w, i: F.when(w.isin(prefix), i)), lambda i: i.isNotNull())
    k = F.transform(places, lambda i: F.floor(i / STEP).cast("int"))
    # each place lies in two blocks
    k = F.array_distinct(F.concat(F.filter(F.transform(k, lambda b: b - 1), lambda b: b >= 0), k))
    own = lambda b: F.array_intersect(_strings(order), F.slice("__w", b * STEP + 1, F.lit(BLOCK)))
    return F.filter(F.transform(k, lambda b: F.struct((b * STEP).alias("word"), own(b).alias("own"))), lambda b: F.size(b["own"]) >= least)


def matches(blocks: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    """The join: blocks (row, word, own) with the prefix index (token, place, part, label, words, need). Rows: row, word, part, label, containment, those at or above the
    threshold, each once."""
    tokens_of = blocks.select("row", "word", "own", F.posexplode("own").alias("at", "token"))
    met = tokens_of.join(index, "token")
    # From the first token that both hold on, neither may have fewer tokens left than are needed.
    left = F.least(F.size("own") - F.col("at"), F.size("words") - F.col("place"))
    met = met.where((F.size("own") >= F.col("need")) & (left >= F.col("need")))
    share = F.size(F.array_intersect("words", "own")) / F.size("words")
    return met.select("row", "word", "part", "label", share.alias("containment")).where(F.col("containment") >= threshold - 1e-9).distinct()


RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]


def scanned(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (those in keep, where it is given) with n_words, n_base, first_word, last_word, base_labels, labels, score, and blocks:
    array<struct<word,part,label,containment>>, the pairs of a block and a template's part at or above the threshold (word is where the block starts). Input columns of
    these names are replaced; other names may clash with anything but __w, __joined and __row.

    score is the largest containment of a part, 1 where a base phrase stands, else 0. Null and empty texts have no words and empty labels; long texts are scanned whole;
    repeated rows are scanned alike; an empty table gives an empty one."""
    spark, keep = docs.sparkSession, [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    d = docs.select(*keep, tokens(F.col(text)).alias("__w"))
    rows = parts(templates)
    df = frequencies(d.select("__w"), sorted({w for _, p in rows for w in p}))
    order = sorted(df, key=lambda w: (df[w], w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for i, (label, p) in enumerate(rows):
        own, need = sorted(p, key=rank.get), max(1, math.ceil(threshold * len(p) - 1e-9))
        index += [(w, place, i, label, own, need) for place, w in enumerate(own[: len(own) - need + 1])]
    prefix, least = sorted({r[0] for r in index}, key=rank.get), min((r[5] for r in index), default=1)
    d = d.withColumn("__joined", F.concat(F.lit(" "), F.array_join("__w", " "), F.lit(" ")))
    starts = F.flatten(F.array(*[_starts(p) for p in PHRASES.values()]))
    base = F.array_sort(F.filter(F.array(*[F.when(F.contains("__joined", F.lit(" " + " ".join(p) + " ")), F.lit(label)) for label, p in PHRASES.items()]), lambda x: x.isNotNull()))
    # Documents are read once more, and what is left of them is narrow: counts, places and the few blocks that may match.
    thin = d.select(*keep, F.monotonically_increasing_id().alias("__row"), F.size("__w").cast("long").alias("n_words"), starts.alias("__starts"), base.alias("__base"), _blocks(order, prefix, least).alias("__blocks"))
    thin = saved(thin, "blocks")
    table = spark.createDataFrame(index, "token string, place int, part int, label string, words array<string>, need int")
    blocks = thin.select(F.col("__row").alias("row"), F.explode("__blocks").alias("b")).select("row", "b.word", "b.own")
    found = matches(blocks, F.broadcast(table), threshold)
    found = saved(found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("word", "part", "label", "containment"))).alias("blocks")), "matches")
    few = found.count() <= BROADCAST_ROWS
    out = thin.drop("__blocks").join(F.broadcast(found) if few else found, F.col("__row") == F.col("row"), "left")
    hits = F.coalesce("blocks", F.array().cast("array<struct<word:int,part:int,label:string,containment:double>>"))
    return out.select(
        *keep,
        "n_words",
        F.size("__starts").cast("long").alias("n_base"),
        F.array_min("__starts").cast("long").alias("first_word"),
        F.array_max("__starts").cast("long").alias("last_word"),
        F.array_join("__base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("__base", F.transform(hits, lambda x: x["label"]))), ",").alias("labels"),
        F.when(F.size("__starts") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(hits, lambda x: x["containment"])), F.lit(0.0))).alias("score"),
        hits.alias("blocks"),
    )

"""License scans in DataFrame operations only.

Words are runs of ASCII letters and digits, lowered.  A template is the set of
its runs of five words; one of fewer words is a single run of that many.  A
document matches a template if some window of it contains at least
``containment`` of those runs.

1. A template with containment c must have one of any ``n - ceil(c n) + 1`` of
   its n runs in the text.  For each template the runs around its rarest-looking
   words are taken; texts with none of those words are done (no loss).
2. Other texts are cut into overlapping windows.  For templates of more than
   half of 2**e and at most 2**e runs, windows hold 2**(e + 1) runs and begin
   every 2**e, so that any 2**e consecutive runs lie inside one.
3. MinHash bands retrieve templates: each window and template has ``bands``
   bands of one minimum each, and a window is compared with the templates it
   shares a band with.  At containment 0.8 the similarity of template and window
   is at least 0.19, so 64 bands miss a match with probability 2e-6 at most.
   Windows without any run of a template have no band in common with one and
   aren't hashed.
4. The exact share of the template's runs in the window decides.

Templates are a list in the program, so what is broadcast has the size of that
list, never of the data.

Nulls: a null or empty text matches nothing; a row with a null id gives its
matches with it.  Repeated rows give theirs each.  Of windows that tie in
containment ``first_word`` names the first.  Texts of any length are read whole,
window by window.  Extra columns are ignored, whatever their names.  An empty
table, or a list without templates, gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, partitions

SHINGLE, CONTAINMENT, BANDS = 5, 80, 64

# License texts and the notices that stand for longer ones, by SPDX identifier and wording.
_MIT_CONDITION = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_AS_IS_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_AS_IS_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_AS_IS_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, version: str, later: str = "(at your option) any later version") -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or {later}."


_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}

TEMPLATES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-plain": "Licensed under the Apache License 2.0",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-code": "This code is licensed under the MIT License",
    "mit": f"{_MIT_GRANT}, subject to the following conditions: {_MIT_CONDITION} {_AS_IS_MIT}",
    "mit-notice": f"{_MIT_GRANT}, subject to the following conditions: {_MIT_CONDITION}",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        f"above copyright notice and this permission notice appear in all copies. {_AS_IS_ISC}"
    ),
    "0bsd": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_AS_IS_ISC}",
    "bsd-notice": f"{_BSD_GRANT} {_BSD_TWO.partition('Redistributions in binary')[0]}",
    "bsd-2-clause": f"{_BSD_GRANT} {_BSD_TWO} {_AS_IS_BSD}",
    "bsd-3-clause": f"{_BSD_GRANT} {_BSD_TWO} {_BSD_THIRD} {_AS_IS_BSD}",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so"
    ),
    "bsl-1.0-short": "Distributed under the Boost Software License, Version 1.0.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-or-later": _gnu("GNU General Public License", "2"),
    "gpl-notice": _gnu("GNU General Public License", "3"),
    "lgpl-2.1-or-later": _gnu("GNU Lesser General Public License", "2.1"),
    "lgpl-3.0-or-later": _gnu("GNU Lesser General Public License", "3"),
    "agpl-3.0-or-later": _gnu("GNU Affero General Public License", "3"),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-1.0-short": "This work is dedicated to the public domain under CC0 1.0.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    **{f"cc-{code}-4.0": f"This work is licensed under a Creative Commons {name} 4.0 International License." for code, name in _CC.items()},
    "all-rights-reserved": "All rights reserved.",
}


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def shingles_of(words: list[str], size: int) -> list[tuple[str, ...]]:
    return list(dict.fromkeys(tuple(words[i : i + size]) for i in range(len(words) - size + 1)))


def gate_words(templates: dict[str, str], containment: int) -> list[str]:
    """Words of which a text must have one to match anything.

    In each template the longest words are taken until the runs that hold one
    of them are more than may be missing.
    """
    out: set[str] = set()
    for text in templates.values():
        words = words_of(text)
        runs = shingles_of(words, min(SHINGLE, len(words)))
        need = len(runs) - -(-containment * len(runs) // 100) + 1
        for word in sorted(set(words), key=lambda w: (w not in out, -len(w), w)):
            if sum(bool(out & set(r)) for r in runs) >= need:
                break
            out.add(word)
    return sorted(out)


def gate_pattern(words: list[str]) -> str:
    """A pattern for a text that has one of the words, which are sorted and put into a trie: most places fail at the first character."""

    def branch(tails: list[str]) -> str:
        if tails == [""]:
            return ""
        by: dict[str, list[str]] = {}
        for tail in tails:
            if tail:
                by.setdefault(tail[0], []).append(tail[1:])
        inner = "|".join(head + branch(rest) for head, rest in by.items())
        return f"(?:{inner})" + "?+" * ("" in tails) if len(by) > 1 or "" in tails else inner

    return f"(?<![a-z0-9])(?:{branch(words)})(?![a-z0-9])" if words else "(?!)"


def _shingles(hashes: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words in order, from the words' hashes; empty for shorter texts."""
    runs = F.transform(F.sequence(F.lit(1), F.size(hashes) - (size - 1)), lambda i: F.xxhash64(F.slice(hashes, i, size)))
    return F.when(F.size(hashes) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(bands: int) -> list[int]:
    """Fixed 64-bit numbers, as signed ones."""
    return [int.from_bytes(hashlib.sha256(str(k).encode()).digest()[:8], "big", signed=True) for k in range(bands)]


def _minima(shingles: Column, bands: int) -> Column:
    """The minima of hashes under ``bands`` orders; each order is that of the hashes xor a number, which makes any hash of a set least equally likely."""
    return F.array(*[F.array_min(F.transform(shingles, lambda x: x.bitwiseXOR(F.lit(seed)))) for seed in _seeds(bands)])  # noqa: B023


MATCH_SCHEMA = "doc_id long, license string, containment double, n_windows long, first_word long"


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, containment: int = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """One row per document row and license found: doc_id, license, the best containment, how many windows match and where the first begins."""
    templates = {name: words for name, text in (TEMPLATES if templates is None else templates).items() if (words := words_of(text))}
    spark = docs.sparkSession
    if not templates:
        return spark.createDataFrame([], MATCH_SCHEMA)
    kinds: dict[tuple[int, int], int] = {}
    listed = []
    for name, words in templates.items():
        size = min(SHINGLE, len(words))
        power = (len(shingles_of(words, size)) - 1).bit_length()
        listed.append(F.struct(F.lit(kinds.setdefault((size, power), len(kinds))).alias("kind"), F.lit(size).alias("size"), F.lit(1 << power).alias("step"), F.lit(name).alias("license"), F.lit(" ".join(words)).alias("body")))
    sizes = sorted({size for size, _ in kinds})
    pick = lambda column: F.coalesce(*[F.when(F.col("size") == size, column(size)) for size in sizes])

    # a row per kind of template, as long as the list in the code: its templates with their runs and minima
    known = spark.range(1).select(F.inline(F.array(*listed)))
    known = known.select("kind", "size", "step", "license", pick(lambda size: F.array_distinct(_shingles(_hashes(F.split("body", " ")), size))).alias("runs"))
    member = F.struct("license", "runs", _minima(F.col("runs"), bands).alias("minima"))
    known = known.groupBy("kind", "size", "step").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("table"), F.collect_list(member).alias("members"))

    gate = gate_pattern(gate_words({k: " ".join(v) for k, v in templates.items()}, containment))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    gated = plain.where(F.col("text").rlike(gate)).select("doc_id", F.monotonically_increasing_id().alias("row"), _hashes(F.filter(F.split("text", "[^a-z0-9]+"), lambda w: w != "")).alias("hashes"))
    # few texts pass, from anywhere in the table: they are dealt to all tasks anew
    texts = Workspace(spark, "licenses").write(gated.repartition(partitions(spark, 0), "row"), "texts")
    rows = texts.select("doc_id", "row", *[_shingles(F.col("hashes"), size).alias(f"runs_{size}") for size in sizes])
    each = rows.select("*", F.explode(F.array(*map(F.lit, kinds.values()))).alias("kind")).join(F.broadcast(known), "kind")
    each = each.select("doc_id", "row", "step", "table", "members", pick(lambda size: F.col(f"runs_{size}")).alias("runs")).where(F.size("runs") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.size("runs") - 1, F.col("step")), lambda b: F.struct(b.cast("long").alias("begin"), F.slice("runs", b + 1, 2 * F.col("step")).alias("runs")))
    some = each.select("doc_id", "row", "members", F.explode(F.filter(cut, lambda w: F.arrays_overlap(w["runs"], F.col("table")))).alias("w"))
    windows = some.select("doc_id", "row", "members", "w.begin", F.array_distinct("w.runs").alias("window"))
    signed = windows.select("*", _minima(F.col("window"), bands).alias("minima"))
    agree = lambda t: F.exists(F.zip_with("minima", t["minima"], lambda x, y: x == y), lambda same: same)
    met = signed.select("doc_id", "row", "begin", "window", F.explode(F.filter("members", agree)).alias("t"))
    shared = F.size(F.array_intersect("window", "t.runs"))
    found = met.select("doc_id", "row", "begin", F.col("t.license").alias("license"), shared.alias("shared"), F.size("t.runs").alias("all")).where(100 * F.col("shared") >= containment * F.col("all"))
    return found.groupBy("doc_id", "row", "license").agg(F.max(F.col("shared") / F.col("all")).alias("containment"), F.countDistinct("begin").alias("n_windows"), F.min("begin").alias("first_word")).drop("row")

"""Licence scans of files: similarity to templates, then inheritance from directories.

The notices of a file are its lines and paragraphs (blocks of lines without a blank one between them) that hold one of
the words TELLING, which every template has, and the runs of neighbouring such paragraphs, however frequent they are.
Each is compared with all templates (headings of licence texts, whole short licences, notices, identifiers) by the cosine
of sparse TF-IDF vectors, whose document frequencies come from all files; the holder and years of a copyright line are
set aside. The best one of LEAST or more is the file's own licence (of equal ones the first in the text). What licences
that read alike differ by decides between them: the number that a notice gives, if the family has such a version (else
it is <family>-unknown), clauses that are there or not, and the identifier behind an SPDX mark (unknown, if it is none
of IDENTIFIERS; expressions stay expressions). Rights that are reserved right behind the name of a holder, as many
licences open, count only where no other licence is found. The margin is the distance to the best template of
another licence. A file named like LICENSE or COPYING gives its licence to its directory. A file
without a licence of its own has that of the nearest directory above it (its own included) which has one; of several in
one directory the most similar counts, then the smallest path.

Files with null text have no licence of their own; a null path inherits nothing; files with one path or one id are each
answered; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise as B
from .common import prepare

LEAST = 0.6
# Words of which a line or paragraph has one if it is looked at.
TELLING = frozenset(
    "license licence licensed licences licenses copyright copyrights reserved permission permissions permitted granted warranty warranties redistribution redistributions redistribute redistributed "
    "gnu gpl lgpl agpl apache mit bsd isc mozilla mpl eclipse boost zlib unlicense unencumbered cc cc0 commons spdx".split()
)
#: Judged parts that a task remembers (headers repeat), and the letters of one that is remembered, at most.
REMEMBERED, SHORT = 4096, 4000

# The parts that licence texts share, and the notices and whole texts of licences.
AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} General Public License for more details. "
    "You should have received a copy of the GNU {0} General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
GNU_SHORT = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
GNU_LINE = "This work is licensed under the GNU {0} General Public License, version {1}."
GNU_KINDS = (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser", "2.1"), ("LGPL-3.0", "Lesser", "3"), ("AGPL-3.0", "Affero", "3"))
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
CC = "This work is licensed under a Creative Commons {0} 4.0 International License."
BSD_4 = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4." + BSD_3[2:]
GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
NO_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
VERBATIM = " Copyright. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
HEADINGS = (
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"), ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"), ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"), ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
)
VERSIONS = {
    "GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.0", "2.1", "3.0"), "GFDL": ("1.1", "1.2", "1.3"), "AGPL": ("1.0", "3.0"), "Apache": ("1.0", "1.1", "2.0"), "MPL": ("1.0", "1.1", "2.0"), "EPL": ("1.0", "2.0"), "BSL": ("1.0",), "CC0": ("1.0",),
    **{f"CC-{kind}": ("1.0", "2.0", "2.5", "3.0", "4.0") for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
}
IDENTIFIERS = ("MIT", "MIT-0", "0BSD", "ISC", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Zlib", "Unlicense", *(f"{family}-{v}" for family, versions in VERSIONS.items() for v in versions))
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See the LICENSE file in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "MIT License. Copyright. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + AS_IS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", APACHE),
    ("Apache-2.0", APACHE + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *((name, text.format(kind, version)) for name, kind, version in GNU_KINDS for text in (GNU_LINE, GNU_SHORT, GNU)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSD-2-Clause", BSD + BSD_AS_IS),
    ("BSD-3-Clause", BSD + BSD_3 + BSD_AS_IS),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", CC.format("Attribution")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", CC.format("Attribution-ShareAlike")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", CC.format("Attribution-NonCommercial")),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-ND-4.0", CC.format("Attribution-NoDerivatives")),
    ("CC-BY-NC-SA-4.0", CC.format("Attribution-NonCommercial-ShareAlike")),
    ("CC-BY-NC-ND-4.0", CC.format("Attribution-NonCommercial-NoDerivatives")),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. " + AS_IS),
    ("0BSD", GRANT + "."),
    ("0BSD", GRANT + ". " + NO_WARRANTY),
    ("BSD-4-Clause", BSD + BSD_4 + BSD_AS_IS),
    *HEADINGS,
    *((name, text + VERBATIM) for name, text in HEADINGS),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    *((name, f"SPDX-License-Identifier: {name}") for name in (*IDENTIFIERS, "unknown")),
)
#: Templates that count only for texts with an SPDX mark.
MARKED = range(len(TEMPLATES) - len(IDENTIFIERS) - 1, len(TEMPLATES))
KNOWN = {x.lower(): x for x in IDENTIFIERS}
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
#: A licence's family and version, by its name; the version that a text gives.
VERSIONED = re.compile(r"^(.*)-(\d+\.\d+)$")
VERSION = re.compile(r"(?:\bv(?:ersion)?\.?|license,?|licence,?|\bcc0|\bby(?:-[a-z]+)*|international|attribution(?:-[a-z]+)*)\s*(\d{1,2}(?:\.\d+)?)(?!\d)")
#: The expression behind an SPDX mark.
SPDX = re.compile(r"(?i)spdx-license-identifier:[ \t]*\(?((?:[a-z0-9.+-]+)(?:[ \t]+(?:or|and|with)[ \t]+[a-z0-9.+-]+)*)")
ONLY = re.compile(r"(?i)(-only|-or-later|\+)$")
#: Holder and years of a copyright line (with the word itself, where all rights are reserved behind it); one that names anybody.
HOLDER = re.compile(r"(?i)\bcopyright\b(?:[ \t]*(?:\(c\)|\u00a9))?[ \t]*\d{4}[^\n]*?(?:(?=(\ball rights reserved))|\n|$)")
HELD = re.compile(r"(?i)copyright\W+\w")
#: Licences that read alike: names; words that tell that it is one of them; what tells each from those behind it.
CLAUSES = (
    (("BSD-4-Clause", "BSD-3-Clause", "BSD-2-Clause"), "redistributions in binary form", (("BSD-4-Clause", "all advertising materials"), ("BSD-3-Clause", "neither the name"), ("BSD-2-Clause", ""))),
    (("ISC", "0BSD"), "permission to use copy modify", (("ISC", "provided that the above copyright notice"), ("0BSD", ""))),
    (("MIT", "MIT-0"), "to deal in the software", (("MIT", "following conditions"), ("MIT", "shall be included"), ("MIT-0", ""))),
)


def words_of(text: str) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


TERMS = sorted({w for _, t in TEMPLATES for w in words_of(t)} | TELLING)


def _term_hashes() -> np.ndarray:
    data = [t.encode() for t in TERMS]
    off = np.concatenate(([0], np.cumsum([len(x) for x in data])))
    return B.Words(np.frombuffer(b"".join(data), np.uint8), off, B.ALNUM).hash


def _frequencies(files: DataFrame) -> tuple[int, np.ndarray]:
    """Number of files with text, and of those that have each of TERMS."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(batches):
        terms = _term_hashes()
        order = np.argsort(terms)
        counts = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            texts = B.column(batch, "text")
            counts[-1] += len(texts) - texts.null_count
            for lo, hi, buf, off in B.chunks(texts):
                words = B.Words(buf, off, B.ALNUM)
                at = order[np.minimum(np.searchsorted(terms, words.hash, sorter=order), len(terms) - 1)]
                found = np.flatnonzero(terms[at] == words.hash)
                counts[:-1] += np.bincount(np.unique(words.doc[found] * len(terms) + at[found]) % len(terms), minlength=len(terms))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], schema=schema)

    out = np.zeros(len(TERMS) + 1, np.int64)
    for row in files.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term
        out[row["term"]] = row["n"]
    return int(out[-1]), out[:-1]


def _identifier(expression: str) -> str:
    """An SPDX expression with names as here: only and later versions are not told apart."""
    parts = expression.split()  # at odd places are or, and, with; behind with stands an exception
    return " ".join(p.upper() if i % 2 else p if i and parts[i - 1].lower() == "with" else KNOWN.get(ONLY.sub("", p.lower()), "unknown") for i, p in enumerate(parts))


def compared(text: str) -> str:
    """What of text is compared: copyright lines without holder and years, the first name only behind an SPDX mark,
    or `unknown`."""
    text = HOLDER.sub(lambda m: "" if m[1] else "copyright ", text)
    return SPDX.sub(lambda m: "SPDX-License-Identifier: " + _identifier(m[1].split()[0]), text)


def told_version(name: str, text: str) -> str:
    """name as the text itself settles it: by the one SPDX expression that it has, by the clauses that licences which
    read alike differ by, and by the one version that it gives, if name's family has versions."""
    if told := {_identifier(x) for x in SPDX.findall(text)}:
        return told.pop() if len(told) == 1 else name
    for names, common, marks in CLAUSES:
        if name in names and common in (said := " ".join(words_of(text))):
            return next(n for n, mark in marks if mark in said)
    m = VERSIONED.match(name)
    given = {v if "." in v else f"{v}.0" for v in VERSION.findall(text.lower())}
    if not m or len(given) != 1:
        return name
    version = given.pop()
    return f"{m[1]}-{version if version in VERSIONS[m[1]] else 'unknown'}"


def reserved_by_holder(text: str) -> bool:
    """Whether all rights are reserved in or right behind a copyright line that names a holder."""
    return any(HELD.search("\n".join(text[max(0, m.start() - 300) : m.start()].split("\n")[-2:])) for m in re.finditer("(?i)all rights reserved", text))


class Matcher:
    def __init__(self, n: int, df: np.ndarray):
        self.idf = {t: math.log((n + 1) / (d + 1)) + 1 for t, d in zip(TERMS, df.tolist(), strict=True)}
        self.rare = math.log(n + 1) + 1  # of words that no template has
        self.names = [name for name, _ in TEMPLATES]
        vectors = [self.vector(Counter(words_of(t))) for _, t in TEMPLATES]
        self.norms = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
        self.having: dict[str, list[tuple[int, float]]] = {}  # word -> templates that have it, and its weight there
        for i, v in enumerate(vectors):
            for w, x in v.items():
                self.having.setdefault(w, []).append((i, x))
        self.short = lru_cache(REMEMBERED)(self._best)

    def vector(self, counts: Counter) -> dict[str, float]:
        return {w: (1 + math.log(c)) * self.idf.get(w, self.rare) for w, c in counts.items()}

    def best(self, text: str) -> tuple[float, str | None, float]:
        """Similarity and licence of the most similar template (of equal ones the first), and the similarity of the
        most similar one of another licence."""
        return self.short(text) if len(text) <= SHORT else self._best(text)

    def _best(self, text: str) -> tuple[float, str | None, float]:
        v = self.vector(Counter(words_of(compared(text))))
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        dots = [0.0] * len(self.names)
        for w, x in v.items():
            for i, y in self.having.get(w, ()):
                dots[i] += x * y
        found = [round(d / (norm * n), 9) for d, n in zip(dots, self.norms, strict=True)]  # equal ones are equal however summed up
        if not SPDX.search(text):
            found[MARKED.start :] = [0.0] * len(MARKED)
        first = max(range(len(found)), key=lambda i: (found[i], -i))
        name = told_version(self.names[first], text)
        return found[first], name, max((x for x, other in zip(found, self.names, strict=True) if other not in (name, self.names[first])), default=0.0)


def notices(buf: np.ndarray, off: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) of the lines and paragraphs that hold a word of the sorted hashes, and of the runs of
    neighbouring such paragraphs; each span once."""
    words = B.Words(buf, off, B.ALNUM)
    if not len(words.hash) or not len(hashes):
        return []
    known = hashes[np.minimum(np.searchsorted(hashes, words.hash), len(hashes) - 1)] == words.hash
    if not known.any():
        return []
    ends = np.union1d(np.flatnonzero(buf == 10) + 1, off[1:][off[1:] > 0])
    starts = np.concatenate(([0], ends[:-1]))
    doc = np.searchsorted(off, starts, "right") - 1
    solid = np.concatenate(([0], np.cumsum(B.SOLID[buf])))
    blank = solid[ends] == solid[starts]
    # a paragraph begins at the first line of a text and behind a blank line; blank lines belong to the one before
    begins = np.ones(len(starts), bool)
    begins[1:] = (doc[1:] != doc[:-1]) | (blank[:-1] & ~blank[1:])
    paragraph = np.cumsum(begins) - 1
    line = np.unique(np.searchsorted(ends, words.start[known], "right"))
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(starts)) - 1
    out = {(int(doc[i]), int(starts[i]), int(ends[i])) for i in line}
    run: list[int] = []
    for p in [*np.unique(paragraph[line]).tolist(), -1]:
        if run and (p != run[-1] + 1 or doc[first[p]] != doc[first[run[-1]]]):
            out.add((int(doc[first[run[0]]]), int(starts[first[run[0]]]), int(ends[last[run[-1]]])))
            run = []
        if p >= 0:
            out.add((int(doc[first[p]]), int(starts[first[p]]), int(ends[last[p]])))
            run.append(p)
    return sorted(out)


def own_licences(files: DataFrame) -> DataFrame:
    """doc_id, path, licence, similarity, margin of each file by its own notices (null: none)."""
    prepare(files.sparkSession)
    shared = files.sparkSession.sparkContext.broadcast(_frequencies(files))  # a number for each of TERMS
    schema = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("licence", pa.string()), ("similarity", pa.float64()), ("margin", pa.float64())])

    def run(batches):
        match = Matcher(*shared.value)
        hashes = np.sort(_term_hashes()[[t in TELLING for t in TERMS]])
        for batch in batches:
            ids, paths = B.column(batch, "doc_id"), B.column(batch, "path")
            for lo, hi, buf, off in B.chunks(B.column(batch, "text")):
                best: list[tuple[float, str | None, float]] = [(0.0, None, 0.0)] * (hi - lo)
                other = list(best)  # without reserved rights
                for doc, start, end in notices(buf, off, hashes):
                    found = match.best(bytes(buf[start:end]).decode())
                    if found[0] >= LEAST and found[0] > best[doc][0]:
                        best[doc] = found
                    if found[0] >= LEAST and found[0] > other[doc][0] and found[1] != "proprietary":
                        other[doc] = found
                for i, x in enumerate(other):
                    if x[1] and best[i][1] == "proprietary" and reserved_by_holder(bytes(buf[off[i] : off[i + 1]]).decode()):
                        best[i] = x
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), paths.slice(lo, hi - lo), pa.array([b[1] for b in best], pa.string()), *(pa.array([round(x, 6) if b[1] else None for b, x in zip(best, xs, strict=True)], pa.float64()) for xs in ([b[0] for b in best], [b[0] - b[2] for b in best]))], schema=schema
                )

    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "text")
    return files.mapInArrow(run, "doc_id long, path string, licence string, similarity double, margin double")


def inherit(own: DataFrame) -> DataFrame:
    """doc_id, path, licence, similarity, margin (of what is its own), origin (own, inherited, none), source_path of rows
    (doc_id, path, licence, similarity, margin)."""
    rows = own.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit(""))))
    given = rows.where(F.col("licence").isNotNull() & F.col("path").rlike(FILE)).groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("rank"), "path", "licence", "similarity")).alias("g"))
    given = given.select(F.col("dir").alias("above"), "g.licence", "g.similarity", F.col("g.path").alias("source_path"))
    parts = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    dirs = rows.where("dir is not null").select("dir").distinct().select("dir", F.posexplode(F.array_distinct(above)).alias("depth", "above"))
    nearest = dirs.join(given, "above").groupBy("dir").agg(F.max(F.struct("depth", "licence", "similarity", "source_path")).alias("near")).select("dir", "near")
    out = rows.join(nearest, "dir", "left")
    mine = F.col("licence").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("licence", "near.licence").alias("licence"), F.when(mine, F.col("similarity")).otherwise(F.col("near.similarity")).alias("similarity"), "margin",
        F.when(mine, F.lit("own")).when(F.col("near").isNotNull(), F.lit("inherited")).otherwise(F.lit("none")).alias("origin"), F.when(mine, F.col("path")).otherwise(F.col("near.source_path")).alias("source_path"),
    )


def scan(files: DataFrame) -> DataFrame:
    """The licence of each file (doc_id, path, text)."""
    prepare(files.sparkSession)
    return inherit(own_licences(files).checkpoint())


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source / ten thousands / hundreds / name. A document that opens with the word of a licence's
    notice is named LICENSE, others after their id."""
    opening = F.lower(F.substring_index("text", "\n", 1))
    name = F.when(opening.rlike(r"licen[cs]ed?\b") & (F.length(opening) <= 200), F.concat(F.lit("LICENSE-"), "doc_id")).otherwise(F.concat(F.lit("doc-"), "doc_id"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.expr("cast(doc_id div 10000 as string)"), F.expr("cast(doc_id div 100 as string)"), name)
    return docs.select("doc_id", path.alias("path"), "text")


def as_pages(pages: DataFrame) -> DataFrame:
    """Web pages (page_id, url, html) as files: the path is host and path of the address, without a query; the text is
    what stands between tags, each tag a line's end. So a host's licence page answers for the pages below its directory."""
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", "\n"), r"<[^>]*>", "\n")
    path = F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1), F.lit(""))
    return pages.select(F.col("page_id").alias("doc_id"), path.alias("path"), plain.alias("text"))

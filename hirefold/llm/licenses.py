"""License scans by canonical digest lookup.

A text is made canonical - lower case, copyright lines out, punctuation out,
white space collapsed, equivalent spellings unified - and its digest is
hash-joined to the digests of known licences. The whole text of a document is
one unit (is this document a licence?); each of its lines, and each paragraph
of several lines, is one (does it carry a known notice?). Paragraphs end at
lines without words, so headers in comments are paragraphs, however they are
wrapped. Nothing is matched by substring.

The known licences are the texts below, under any of their headings and in the
wordings that their copies differ in, and the digests of longer ones.

Null and empty texts have the digest of the empty text, which no licence has.
Repeated rows stay rows.

An empty table gives an empty table. A very long text is digested whole, in
the Arrow batch that holds it.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirefold.llm.common import keyed_text, large
from hirefold.llm.license_digests import DIGESTS

# Texts of well-known licences (the copyright line varies and
# is ignored) and one-line notices.
LICENSES: dict[str, str] = {
    "MIT": """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "0BSD": """Copyright (C) <year> by <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "BSD-2-Clause": """Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """Copyright (c) <year> <owner>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
}
# Headings above a licence's text.
TITLES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "The MIT License (Expat)",
            "Expat License", "License", "Licensed under the MIT License", "Released under the MIT License",
            "This software is released under the MIT license:", "This project is free software released under the MIT license:"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC", "License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD License", "0BSD", "License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause", "The BSD License", "BSD License",
                     "Simplified BSD License", "License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause", "The BSD License", "BSD License",
                     "New BSD License", "Modified BSD License", "License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License", "zlib/libpng license", "License"),
}
# Fixed values: (canonical) wordings that copies of a licence differ in.
_UNNUMBERED = ((r"\b[123] (?=redistributions |neither )", ""),)
_PARTIES = tuple(((r"copyright holders (?=and contributors)", f"{x} "), (r"copyright holder (?=or contributors)", f"{x} "))
                 for x in ("author", "authors", "regents"))
WORDINGS: dict[str, tuple[tuple[tuple[str, str], ...], ...]] = {
    "ISC": (((r"\bauthor\b", "copyright holder"),), ((r"\bauthor disclaims", "authors disclaim"), (r"\bauthor\b", "authors")),
            ((r"\band or distribute", "and distribute"),)),
    "BSD-2-Clause": (_UNNUMBERED, *_PARTIES, *(_UNNUMBERED + x for x in _PARTIES)),
    "BSD-3-Clause": (_UNNUMBERED, *_PARTIES, *(_UNNUMBERED + x for x in _PARTIES)),
}
_APACHE = ("{0}, Version 2.0 (the \"License\"); you may not use {1} except in compliance with the License. "
           "You may obtain a copy of the License at")
_APACHE_URLS = tuple(f"http://{w}apache.org/licenses/LICENSE-2.0{x}" for w in ("www.", "") for x in ("", ".txt", ".html"))
_APACHE_REST = ("Unless required by applicable law or agreed to in writing, {0} distributed under the License is distributed "
                "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
                "License for the specific language governing permissions and limitations under the License.")
_ASF = ("Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file "
        "distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you "
        "under the Apache License")


def _apache() -> tuple[str, ...]:
    """The header notice: its first paragraph, with and without the address and
    what follows, and its first line as it is usually broken."""
    starts = [_APACHE.format(x, y) for x in ("Licensed under the Apache License", _ASF)
              for y in ("this file", "these files", "this software", "this work")]
    rests = [_APACHE_REST.format(x) for x in ("software", "this software", "the software")]
    return (*starts, *(f"{s} {u}" for s in starts for u in _APACHE_URLS),
            *(f"{s} {u} {r}" for s in starts for u in _APACHE_URLS for r in rests),
            'Licensed under the Apache License, Version 2.0 (the "License");',
            'Licensed under the Apache License, Version 2.0 (the "License"); you may',
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not',
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file',
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
            'with the License.')


def _gnu(kind: str, *versions: str) -> tuple[str, ...]:
    """The first paragraph of a GNU header notice."""
    return tuple(f"{x} is free software: you can redistribute it and/or modify it under the terms of {y}GNU {kind} as published "
                 f"by the Free Software Foundation, {v}."
                 for x in ("This program", "This file", "This library", "This software", "This package", "This code", "This", "It")
                 for y in ("the ", "") for v in versions)


def _spdx(*names: str) -> tuple[str, ...]:
    return tuple(f"SPDX-License-Identifier: {x}" for x in names)


def _later(v: str) -> tuple[str, ...]:
    return (f"either version {v} of the License, or (at your option) any later version",
            f"either version {v}, or (at your option) any later version", f"version {v} or later")


def _only(v: str) -> tuple[str, ...]:
    return f"version {v} of the License", f"version {v}", f"version {v} only"


_MPL = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.")
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", *_apache(), *_spdx("Apache-2.0")),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.",
            "This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source "
            "tree.", *_spdx("MIT")),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "Licensed under the GNU General Public License, version 3.", *_gnu("General Public License", *_only("3")),
                *_spdx("GPL-3.0-only", "GPL-3.0")),
    "GPL-3.0-or-later": (*_gnu("General Public License", *_later("3")), *_spdx("GPL-3.0-or-later", "GPL-3.0+")),
    "GPL-2.0": (*_gnu("General Public License", *_only("2")), *_spdx("GPL-2.0-only", "GPL-2.0")),
    "GPL-2.0-or-later": (*_gnu("General Public License", *_later("2")), *_spdx("GPL-2.0-or-later", "GPL-2.0+")),
    "LGPL-2.0-or-later": (*_gnu("Library General Public License", *_later("2")), *_spdx("LGPL-2.0-or-later", "LGPL-2.0+")),
    "LGPL-2.1": (*_gnu("Lesser General Public License", *_only("2.1")), *_spdx("LGPL-2.1-only", "LGPL-2.1")),
    "LGPL-2.1-or-later": (*_gnu("Lesser General Public License", *_later("2.1")), *_spdx("LGPL-2.1-or-later", "LGPL-2.1+")),
    "LGPL-3.0": (*_gnu("Lesser General Public License", *_only("3")), *_spdx("LGPL-3.0-only", "LGPL-3.0")),
    "LGPL-3.0-or-later": (*_gnu("Lesser General Public License", *_later("3")), *_spdx("LGPL-3.0-or-later", "LGPL-3.0+")),
    "AGPL-3.0": (*_gnu("Affero General Public License", *_only("3")), *_spdx("AGPL-3.0-only", "AGPL-3.0")),
    "AGPL-3.0-or-later": (*_gnu("Affero General Public License", *_later("3")), *_spdx("AGPL-3.0-or-later", "AGPL-3.0+")),
    "MPL-2.0": (_MPL, _MPL.replace("http://", "http://www."), *_spdx("MPL-2.0")),
    "BSD-2-Clause": _spdx("BSD-2-Clause"), "BSD-3-Clause": _spdx("BSD-3-Clause"), "ISC": _spdx("ISC"), "0BSD": _spdx("0BSD"),
    "Zlib": _spdx("Zlib"), "Unlicense": _spdx("Unlicense"), "OFL-1.1": _spdx("OFL-1.1"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC0-1.0": ("Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
}
# Spellings that count as the same word in a licence.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense",
    "acknowledgement": "acknowledgment", "authorisation": "authorization", "authorised": "authorized",
    "centre": "center", "colour": "color", "favour": "favor", "fulfil": "fulfill", "initialise": "initialize",
    "judgement": "judgment", "merchantibility": "merchantability", "organisation": "organization",
    "organisations": "organizations", "owner": "holder", "owners": "holders", "percent": "pc", "practise": "practice",
    "programme": "program", "recognised": "recognized", "utilisation": "utilization", "whilst": "while",
    "wilful": "willful", "https": "http",
}
COPYRIGHT = re.compile(r"^[^\w\n]*(?:copyright\b(?=[^\n]*(?:\d|\(c\)|©|<|by\b))|\(c\)\s|©|all rights reserved\b)[^\n]*$",
                       re.I | re.M)
APART = re.compile(r"[\W_]+")
#: Whose name may not endorse (BSD-3-Clause) varies like the copyright line.
NAMED = re.compile(r"\bneither the names? (?:of )?(?:\S+ ){1,20}?nor the names of\b")
#: Known digests travel in a broadcast hash table; a longer list is refused.
MOST_KNOWN = 10_000


def canonical(text: str) -> str:
    words = APART.split(COPYRIGHT.sub(" ", text).lower())
    text = " ".join([SPELLINGS.get(w, w) for w in words if w])
    return NAMED.sub("neither the name of the copyright holder nor the names of", text) if "neither the name" in text else text


def _hash(words: str) -> str:
    return hashlib.blake2b(words.encode(), digest_size=16).hexdigest()


def digest(text: str) -> str:
    return _hash(canonical(text))


def variants(name: str, text: str) -> set[str]:
    """Digests of a licence under each of its headings, in each wording."""
    titles = sorted({canonical(x) for x in TITLES.get(name, ())}, key=len, reverse=True)
    body = canonical(text)
    body = body.removeprefix(next((f"{x} " for x in titles if body.startswith(f"{x} ")), ""))
    bodies = {body}
    for pairs in WORDINGS.get(name, ()):
        other = body
        for a, b in pairs:
            other = re.sub(a, b, other)
        bodies.add(other)
    return {_hash(f"{x} {y}".strip()) for x in ("", *titles) for y in bodies}


def _units(batches):
    for b in batches:
        whole, lines, blocks = [], [], []
        for t in large(b.column("text")).to_pylist():
            whole.append(digest(t))
            kept = [(x, canonical(x)) for x in t.split("\n")]
            lines.append([_hash(c) for x, c in kept if x.strip()])
            # For each line the digest of its paragraph, empty if it is alone.
            of, at = [], 0
            while at < len(kept):
                end = at
                while end < len(kept) and kept[end][1]:
                    end += 1
                h = _hash(" ".join(c for _, c in kept[at:end])) if end - at > 1 else ""
                of += [h] * max(1, end - at)
                at = max(end, at + 1)
            blocks.append([h for (x, _), h in zip(kept, of, strict=True) if x.strip()])
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(whole, pa.string()), pa.array(lines, pa.list_(pa.string())),
             pa.array(blocks, pa.list_(pa.string()))], ["doc_id", "digest", "line_digests", "block_digests"])


def known_digests(licenses: dict[str, str], notices: dict[str, tuple[str, ...]],
                  more: dict[str, tuple[str, ...]] | None = None) -> tuple[dict[str, str], dict[str, str]]:
    whole = {d: name for name, ds in (more or {}).items() for d in ds}
    whole |= {d: name for name, text in licenses.items() for d in variants(name, text)}
    lines = {digest(text): name for name, texts in notices.items() for text in texts}
    if len(whole) + len(lines) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known texts: join them as a table instead")
    return whole, lines


def scan_licenses(docs: DataFrame, licenses: dict[str, str] | None = None,
                  notices: dict[str, tuple[str, ...]] | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, digest, license_id (the licence that
    the whole text is, or null), notices (ids of the known notices among its
    lines and paragraphs, sorted), n_notice_lines (lines that are one or lie in
    a paragraph that is one)."""
    spark = docs.sparkSession
    whole, lines = known_digests(LICENSES if licenses is None else licenses, NOTICES if notices is None else notices,
                                 DIGESTS if licenses is None else None)
    # The notices are whole texts too: a document may consist of one.
    table = spark.createDataFrame(sorted({**lines, **whole}.items()), "digest string, license_id string")
    units = keyed_text(docs, id_col, text_col).mapInArrow(
        _units, "doc_id long, digest string, line_digests array<string>, block_digests array<string>")
    # Each line with its paragraph's digest; what is known stays.
    pairs = F.zip_with("line_digests", "block_digests", lambda a, b: F.array(a, b))
    known = F.create_map(*[F.lit(x) for kv in sorted(lines.items()) for x in kv]) if lines else None
    hits = (F.filter(F.transform(pairs, lambda p: F.filter(p, lambda d: d.isin(*sorted(lines)))), lambda p: F.size(p) > 0)
            if lines else F.array().cast("array<array<string>>"))
    ids = F.transform(F.flatten("hits"), lambda d: F.element_at(known, d)) if lines else F.flatten("hits")
    return (units.join(F.broadcast(table), "digest", "left")  # at most MOST_KNOWN short rows
            .withColumn("hits", hits)
            .select("doc_id", "digest", "license_id",
                    F.array_join(F.array_sort(F.array_distinct(ids)), ",").alias("notices"),
                    F.size("hits").cast("long").alias("n_notice_lines")))

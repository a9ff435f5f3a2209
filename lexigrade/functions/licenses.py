"""Predicates on comment bodies and lines: license wording and structured data."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from lexigrade.functions.text import let

# --- fixed values: patterns and the public license texts --------------------------------

LICENSE = r"(?i)\b(?:copyright|licen[cs]ed?|spdx-license-identifier)\b|\(c\)|©"
BOILERPLATE = r"""(?i)\bspdx-license-identifier\b|\bpermission\s+is\s+hereby\s+granted\b|\bwithout\s+warranties\s+or\s+conditions\b|\bprovided\s+["“]?as\s+is["”]?|\blicensed\s+under\s+the\b"""
NOTICE = r"(?i)\bcopyright\s*(?:\(c\)|©|\d{4})|©\s*\d{4}"
NAME = (
    r"(?i)\b(?:MIT|Apache|BSD|GNU|L?GPL|AGPL|MPL|Mozilla\s+Public|ISC|Unlicense|Creative\s+Commons|Eclipse\s+Public)\b[\s\S]{0,40}?\blicen[cs]e\b"
    r"|\blicen[cs]e\b[\s\S]{0,20}?\b(?:MIT|Apache|BSD|L?GPL|AGPL|MPL|ISC)\b|\ball\s+rights\s+reserved\b"
)

TEXTS = [
    # MIT
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
    associated documentation files (the "Software"), to deal in the Software without restriction, including
    without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
    copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
    following conditions: The above copyright notice and this permission notice shall be included in all
    copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
    KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
    PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
    ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
    OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    # BSD 2- and 3-clause
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided
    that the following conditions are met: Redistributions of source code must retain the above copyright
    notice, this list of conditions and the following disclaimer. Redistributions in binary form must
    reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution. Neither the name of the copyright
    holder nor the names of its contributors may be used to endorse or promote products derived from this
    software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
    CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
    WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
    COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
    CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
    USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
    CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
    OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    # Apache 2.0 header
    """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See
    the NOTICE file distributed with this work for additional information regarding copyright ownership. The
    ASF licenses this file to you under the Apache License, Version 2.0 (the "License"); you may not use this
    file except in compliance with the License. You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
    software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
    CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
    permissions and limitations under the License.""",
    # GPL and LGPL headers
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
    General Public License as published by the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version. This program is distributed in the hope that it will be useful, but
    WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
    PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
    General Public License along with this program. If not, see https://www.gnu.org/licenses/. This library is
    free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
    License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
    option) any later version.""",
    # MPL 2.0 header
    """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
    MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    # ISC
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
    hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
    THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
    INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
    FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
    OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
    OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    # Boost
    """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or
    copy at http://www.boost.org/LICENSE_1_0.txt)""",
    # zlib
    """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
    be held liable for any damages arising from the use of this software. Permission is granted to anyone to
    use this software for any purpose, including commercial applications, and to alter it and redistribute it
    freely, subject to the following restrictions: The origin of this software must not be misrepresented; you
    must not claim that you wrote the original software. If you use this software in a product, an
    acknowledgment in the product documentation would be appreciated but is not required. Altered source
    versions must be plainly marked as such, and must not be misrepresented as being the original software.
    This notice may not be removed or altered from any source distribution.""",
]

# --- derived ----------------------------------------------------------------------------


def _corpus() -> tuple[list[str], list[str]]:
    texts = [re.findall("[a-z0-9]+", t.lower()) for t in TEXTS]
    triples = {" ".join(w[k : k + 3]) for w in texts for k in range(len(w) - 2)}
    return sorted({x for w in texts for x in w}), sorted(triples)


WORDS, TRIGRAMS = _corpus()
MARKER = r"^__[A-Z][A-Z0-9_]*__(?:\z|\s+[\"{\[])"
DATA_LINE = r"""(?i)^(?:"[^"]*"\s*:|[\[\]{}(),;\s]+\z|(?:"[^"]*"|-?\d+(?:\.\d+)?(?:e[+-]?\d+)?|true|false|null)\s*,?\s*\z)"""


def lines_of(body: Column) -> Column:
    """Lines that aren't empty, without gutter and indentation."""
    bare = F.transform(F.split(body, "\n", -1), lambda s: F.regexp_replace(F.regexp_replace(s, r"^[\s*]*", ""), r"\s+\z", ""))
    return F.filter(bare, lambda s: s != "")


def ascii_edges(pattern: str) -> str:
    """The pattern for Java, whose word boundary would heed letters beyond ASCII."""
    opened = re.sub(r"\\b(?=(?:\(\?:)?[A-Za-z])", "(?<![A-Za-z0-9_])", pattern)
    return opened.replace(r"\b", "(?![A-Za-z0-9_])")


def is_license_text(body: Column) -> Column:
    return body.rlike(ascii_edges(BOILERPLATE)) | (body.rlike(ascii_edges(NOTICE)) & body.rlike(ascii_edges(NAME)))


def has_license_word(body: Column) -> Column:
    """The weak test, for a file's first comment only."""
    return body.rlike(ascii_edges(LICENSE))


def is_license_line(line: Column) -> Column:
    """A notice by pattern, or wording of the license texts: by share of trigrams or a run of them."""
    said = line.rlike(ascii_edges(NOTICE)) | line.rlike(ascii_edges(BOILERPLATE)) | line.rlike(ascii_edges(NAME))
    return said | let(F.regexp_extract_all(F.lower(line), F.lit("[a-z0-9]+"), F.lit(0)), _is_wording)


def _is_wording(words: Column) -> Column:
    n = F.size(words)
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    known = F.transform(places, lambda k: F.concat_ws(" ", F.get(words, k), F.get(words, k + 1), F.get(words, k + 2)).isin(TRIGRAMS))
    zero = F.struct(F.lit(0).alias("found"), F.lit(0).alias("run"), F.lit(0).alias("longest"))

    def step(s: Column, k: Column) -> Column:
        return let(F.when(k, s.run + 1).otherwise(F.lit(0)), lambda run: F.struct((s.found + k.cast("int")).alias("found"), run.alias("run"), F.greatest(s.longest, run).alias("longest")))

    short = (n > 0) & F.forall(words, lambda w: w.isin(WORDS))
    long = let(F.aggregate(known, zero, step), lambda end: (F.try_divide(end.found.cast("double"), n - 2) >= 0.6) | (end.longest >= 4))
    return F.when(n < 3, short).otherwise(long)


def is_data_line(line: Column) -> Column:
    return line.rlike(MARKER) | line.rlike(DATA_LINE)


def is_structured(body: Column) -> Column:
    """A marker line first, or three lines or more of which 60 % are data."""

    def tested(lines: Column) -> Column:
        data = F.size(F.filter(lines, lambda s: s.rlike(DATA_LINE)))
        share = F.coalesce(F.try_divide(data.cast("double"), F.size(lines)), F.lit(0.0))
        return F.coalesce(F.get(lines, F.lit(0)).rlike(MARKER), F.lit(False)) | ((F.size(lines) >= 3) & (share >= 0.6))

    return let(lines_of(body), tested)

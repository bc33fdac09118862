"""Operator 8, licence scans: TF-IDF cosine of header lines and licence files to templates, inherited from the nearest directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.shared import scratch, stored

#: Usual wordings by SPDX identifier. The longer ones also stand for whole licence files.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software under the MIT License"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license.", "Released under the 3-Clause BSD License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC0-1.0": ("Released under the CC0 1.0 public domain license.",),
}
#: How the texts of licences begin (fixed wordings): compared with the first lines of licence files, since texts of one family share most of their words.
TITLES = {
    "AFL-3.0": ("Academic Free License (AFL) v. 3.0",),
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "Apache-2.0": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",),
    "Artistic-1.0": ('The "Artistic License"', 'The "Artistic License" Preamble'),
    "Artistic-2.0": ("The Artistic License 2.0", "Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation."),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International Public License", "Attribution 4.0 International"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International Public License", "Attribution-NonCommercial 4.0 International"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International Public License", "Attribution-ShareAlike 4.0 International"),
    "CC0-1.0": ("Creative Commons Legal Code CC0 1.0 Universal", "CC0 1.0 Universal"),
    "CDDL-1.0": ("COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0",),
    "EPL-1.0": ("Eclipse Public License - v 1.0",),
    "EPL-2.0": ("Eclipse Public License - v 2.0",),
    "EUPL-1.2": ("EUROPEAN UNION PUBLIC LICENCE v. 1.2", "EUROPEAN UNION PUBLIC LICENCE v. 1.2 EUPL (c) the European Union 2007, 2016"),
    "GFDL-1.1": ("GNU Free Documentation License Version 1.1, March 2000",),
    "GFDL-1.2": ("GNU Free Documentation License Version 1.2, November 2002",),
    "GFDL-1.3": ("GNU Free Documentation License Version 1.3, 3 November 2008",),
    "GPL-1.0": ("GNU GENERAL PUBLIC LICENSE Version 1, February 1989",),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "LGPL-2.0": ("GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "MPL-1.1": ("MOZILLA PUBLIC LICENSE Version 1.1", "Mozilla Public License 1.1"),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"),
    "OFL-1.1": ("SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007",),
    "PostgreSQL": ("PostgreSQL License",),
    "WTFPL": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004",),
}
#: Identifiers and exceptions that an "SPDX-License-Identifier:" line may name, besides those of the wordings (fixed names).
IDENTIFIERS = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause "
    "BSL-1.0 BlueOak-1.0.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.1 GFDL-1.2 GFDL-1.3 "
    "GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later "
    "LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL PostgreSQL Python-2.0 Ruby Unicode-DFS-2016 Unlicense Vim W3C WTFPL X11 ZPL-2.1 Zlib "
    "Autoconf-exception-3.0 Bison-exception-2.2 Classpath-exception-2.0 Font-exception-2.0 GCC-exception-3.1 LLVM-exception Linux-syscall-note"
).split()
_NO_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program."
#: Bodies of licences and their usual file headers, compared with header blocks and whole files (fixed wordings).
BODIES = {
    "MIT": "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _NO_WARRANTY,
    "ISC": "ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.",
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_3 + _BSD_END,
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-2.0": _GNU.format("General Public License", 2),
    "GPL-3.0": _GNU.format("General Public License", 3),
    "LGPL-3.0": _GNU.format("Lesser General Public License", 3),
    "AGPL-3.0": _GNU.format("Affero General Public License", 3),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
}
#: A whole text with one of these is compared as a licence file.
BODY_KEYS = ("redistribution and use in source", "permission is hereby granted", "permission to use, copy", "provided 'as-is'", "free and unencumbered", "is free software", "may not use this file except", "general public license")
#: A line, or file, without any of these words is no notice.
KEYS = ("licen", "copyright", "public domain", "spdx", "permission is hereby granted")


def _has_key(text, keys: tuple[str, ...] = KEYS):
    found = F.lit(False)
    for key in keys:
        found = found | F.contains(text, F.lit(key))
    return found


def expression(text):
    """The licence expression that an SPDX line in ``text`` states: identifiers that are known, with AND, OR, WITH and parentheses; null without one."""
    name = r"(?:\([ \t]*)*[A-Za-z0-9.+-]+(?:[ \t]*\))*"
    found = F.trim(F.regexp_replace(F.regexp_extract(text, rf"SPDX-License-Identifier:[ \t]*({name}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{name})*)", 1), r"\s+", " "))
    names = F.filter(F.split(found, r"[ ()]+"), lambda w: ~w.isin("", "AND", "OR", "WITH"))
    known = sorted({*IDENTIFIERS, *TEMPLATES, *BODIES, *TITLES})
    return F.when(F.contains(text, F.lit("SPDX-License-Identifier:")), F.when((F.size(names) > 0) & F.forall(names, lambda w: F.regexp_replace(w, r"\+$", "").isin(known)), found))


def terms(text):
    """The lower-case words of a text in order, an array."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def cosines(notices: DataFrame, templates: DataFrame) -> DataFrame:
    """(key, license, score): the best template of each distinct notice (key, notice), of equals the least license.

    Weights are tf * (ln((n + 1) / (df + 1)) + 1), where n and df count the distinct notices and templates. Texts go by their keys, so the
    rows of a long one are small.
    """
    both = notices.select("key", F.lit(None).cast("string").alias("license"), F.col("notice").alias("text")).unionByName(templates.select(F.md5("text").alias("key"), "license", "text"))
    words = both.select("key", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("key", "license", "term").agg(F.count("*").alias("tf"))
    words = stored(words, "words")
    df = stored(words.groupBy("term").agg(F.count("*").alias("df")), "df")
    n = both.count()
    weighted = words.join(df, "term").select("key", "license", "term", (F.col("tf") * (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1)).alias("weight"))
    weighted = stored(weighted, "weights")
    norms = weighted.groupBy("key", "license").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    of = weighted.filter("license IS NOT NULL")
    of = of.join(norms.filter("license IS NOT NULL"), ["key", "license"]).select(F.col("key").alias("template"), F.col("license").alias("found"), "term", (F.col("weight") / F.col("norm")).alias("unit"))
    dots = weighted.filter("license IS NULL").join(of, "term").groupBy("key", "template", "found").agg(F.sum(F.col("weight") * F.col("unit")).alias("dot"))
    scored = dots.join(norms.filter("license IS NULL").select("key", "norm"), "key").select("key", "found", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    best = scored.groupBy("key").agg(F.min_by(F.struct("found", "score"), F.struct(-F.col("score"), "found")).alias("x"))
    return best.select("key", F.col("x.found").alias("license"), "x.score")


def scan_licenses(files: DataFrame, spark: SparkSession, at_least: float = 0.6, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per distinct id of ``files`` (id, path, text): id, path, license, score, line, how ('own', 'inherited' or null), from_id.

    Compared with the templates are each line of the whole text that has a key word, the header block (all up to the first blank line) and,
    of licence files and texts that quote a licence's body, the whole text and its title, which is the first one, two or three lines with text: the texts of one family share
    most of their words, so the title tells them apart. A file's own licence is that of the unit with the highest score from ``at_least`` on, then the first line; a
    line "SPDX-License-Identifier: X" scores 1 for an expression X of known identifiers, and the licence is that expression (see ``expression``). A word is a run of letters and
    digits, so one of a script without spaces is a whole stretch; very long texts are taken whole, as one row for each of their words. A licence file is one named license*, licence* or copying*, or one whose first
    line with text is its notice; its licence holds for its directory, that of the least id where there are several. A file without
    its own inherits that of the nearest directory above it. Null or empty texts have no own licence; a null path is at the root.
    Rows repeated with the same id are one; a null id is an id like any other. Native expressions only.
    """
    with scratch(spark) as keep:
        every, given, named, folder = _own_licenses(files, spark, at_least, templates)
        keep(every, given)
    # every directory above a file, the nearest first: a path join for each
    folders = F.expr("transform(sequence(0, size(parts)), k -> struct(k AS depth, array_join(slice(parts, 1, k), '/') AS folder))")
    above = every.filter("license IS NULL").select("file", F.filter(F.split(folder, "/"), lambda x: x != "").alias("parts")).select("file", F.explode(folders).alias("x"))
    passed = above.select("file", "x.*").join(given, "folder").groupBy("file").agg(F.max_by("given", "depth").alias("given"))
    out = every.join(passed, "file", "left")
    return out.select(
        "id",
        "path",
        F.coalesce("license", F.col("given.license")).alias("license"),
        "score",
        "line",
        F.when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").alias("how"),
        F.when(F.col("license").isNotNull(), F.col("id")).otherwise(F.col("given.id")).alias("from_id"),
    )


def _own_licenses(files: DataFrame, spark: SparkSession, at_least: float, templates: dict[str, tuple[str, ...]] | None):
    """(each file with its own licence, the licence given for each folder, whether a path is named as a licence file, its folder)."""
    wordings = {k: [*TEMPLATES.get(k, ()), *TITLES.get(k, ()), *([BODIES[k]] if k in BODIES else [])] for k in {**TEMPLATES, **TITLES, **BODIES}}
    every_text = wordings if templates is None else templates
    known = spark.createDataFrame([(k, t) for k, texts in every_text.items() for t in texts], "license string, text string")
    asked = files.select(F.struct(F.col("id").isNull().alias("none"), "id").alias("file"), F.coalesce("path", F.lit("")).alias("path"), "text")
    name, folder = F.regexp_extract("path", r"[^/]*$", 0), F.regexp_extract("path", r"^/*(.*?)/+[^/]*$", 1)
    named = F.lower(name).rlike(r"^(licen[cs]e|copying)")
    keyed = stored(asked.filter(_has_key(F.lower("text"), KEYS + BODY_KEYS) | named), "keyed")  # the one scan of all texts
    lines = keyed.select("file", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line", "notice"))
    # the first line with text: whether all before it are blank
    firsts = stored(lines.filter(F.trim("notice") != "").groupBy("file").agg(F.min("line").alias("first")), "firsts")
    head = keyed.select("file", F.regexp_extract("text", r"(?s)^\s*(.*?)(?:(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)|\z)", 1).alias("notice")).filter(_has_key(F.lower("notice"), KEYS + BODY_KEYS))
    files_ = keyed.filter(named | _has_key(F.lower("text"), BODY_KEYS))
    whole = files_.select("file", F.col("text").alias("notice"))
    start = F.filter(F.split(F.regexp_extract("text", r"\A(?:\s*[^\r\n]*\S[^\r\n]*){0,3}", 0), r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    titles = files_.select("file", start.alias("start")).select("file", F.explode(F.expr("transform(sequence(1, greatest(size(start), 1)), k -> array_join(slice(start, 1, k), ' '))")).alias("notice"))
    blocks = head.unionByName(whole).unionByName(titles).join(firsts, "file").select("file", F.col("first").alias("line"), "notice")
    found = lines.filter(_has_key(F.lower("notice"))).select("file", "line", "notice").unionByName(blocks).withColumn("key", F.md5("notice"))
    found = stored(found.withColumn("spdx", expression(F.col("notice"))), "notices")
    scored = stored(cosines(found.select("key", "notice").dropDuplicates(["key"]), known), "cosines")
    judged = found.join(scored, "key", "left").select("file", "line", F.coalesce("spdx", "license").alias("license"), F.when(F.col("spdx").isNotNull(), 1.0).otherwise(F.col("score")).alias("score"))
    own = judged.filter(F.col("score") >= at_least).groupBy("file").agg(F.min_by(F.struct("license", "score", "line"), F.struct(-F.col("score"), "line", "license")).alias("x"))
    own = stored(own.join(firsts, "file").select("file", "x.*", "first"), "own")
    paths = asked.select("file", "path").groupBy("file").agg(F.min("path").alias("path"))
    every = stored(paths.join(own, "file", "left").select("file.id", "file", "path", "license", "score", "line", "first"), "files")
    given = every.filter(F.col("license").isNotNull() & (named | (F.col("line") == F.col("first")))).groupBy(folder.alias("folder")).agg(F.min_by(F.struct("id", "license"), "file").alias("given"))
    return every, stored(given, "folders"), named, folder

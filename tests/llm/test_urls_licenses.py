import collections
import math
import pathlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siltworks.llm.licenses import BODIES, TEMPLATES, TITLES, cosines, expression, scan_licenses
from siltworks.llm.queries import RULES
from siltworks.llm.urls import filter_urls

URLS = [None, "", "nothing", "http://", "HTTP://Example.NET/en/1", "http://example.net", "http://example.net/", "http://a.EXAMPLE.net/en/x?y#z", "http://badexample.net/en/", "http://x.org/fr/1", "http://x.org/frr", "http://xorg/fr/",
        "https://example.com/de/#a", "https://sub.example.com/de/q", "https://example.com/de", "a://b://c/d", "http://h?q=/x", "http://h#/x", "x://Ä.net/é\nz", "http://example.net/en"]
URLS += [f"http://{h}.{d}/{p}/{i}" for i, (h, d, p) in enumerate((h, d, p) for h in ("good", "spam", "w") for d in ("example.net", "example.com", "site.org", "other.io") for p in ("en", "de", "fr"))]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]


def rule(host, path):
    fits = [(len(r), r, v) for v, r in RULES for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def model(urls, order):
    n, total, kinds = defaultdict(int), defaultdict(int), defaultdict(set)
    for u in urls:
        p = "\x02" * (order - 1) + u + "\x03"
        for i in range(len(p) - order + 1):
            for k in range(1, order + 1):
                g = p[i + order - k : i + order]
                n[g] += 1
                total[g[:-1], k] += 1
                kinds[g[:-1], k].add(g[-1])

    def prob(g):
        low = prob(g[1:]) if len(g) > 1 else 1 / 256
        key = g[:-1], len(g)
        return (n[g] + len(kinds[key]) * low) / (total[key] + len(kinds[key])) if total[key] else low

    return prob


def test_urls(spark):
    rows = list(enumerate(URLS)) + [(7, URLS[7])]
    held = [zlib.crc32((u or "").encode()) % 5 == 0 for _, u in rows]
    ruled = [rule(*parts(u)) for _, u in rows]
    a, r = (model([u for (_, u), h, (_, v) in zip(rows, held, ruled) if v == w and not h], 5) for w in ("allow", "block"))
    scores = []
    for _, u in rows:
        p = "\x02" * 4 + (u or "") + "\x03"
        s = [math.log(a(p[i : i + 5]) / r(p[i : i + 5])) for i in range(len(p) - 4)]
        scores.append(sum(s) / len(s))
    got = filter_urls(spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "1 AS host", "2 AS row"), RULES).collect()
    assert sorted((x.page_id, x.host, x.path, x.rule) for x in got) == sorted(((i, *parts(u), f[0]) for (i, u), f in zip(rows, ruled)), key=str) or sorted((x.page_id, x.host, x.path, str(x.rule)) for x in got) == sorted((i, *parts(u), str(f[0])) for (i, u), f in zip(rows, ruled))
    by_id = dict(zip([i for i, _ in rows], scores))
    for x in got:
        assert x.score == pytest.approx(by_id[x.page_id], abs=1e-6)
        if x.rule:
            assert x.verdict == dict((q, v) for v, q in RULES)[x.rule]
    assert filter_urls(spark.createDataFrame([], "page_id bigint, url string"), RULES).count() == 0


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "a/LICENSE", f"x\n{mit}\ny"), (2, "a/f", "text"), (3, "a/b/f", None), (4, "a/b/c/g", f"code\n{gpl.upper()}\nmore"), (5, "a/b/c/h", ""), (6, "z/f", "licence to kill the dragon in the tower"),
        (7, None, "plain"), (8, "q/r/start", f"\n{gpl}\nrest"), (9, "q/r/s/t/deep", "words"), (10, "q/other", "words"), (1, "a/LICENSE", f"x\n{mit}\ny"), (11, "/a/k", "words"), (12, "m/n", "word " * 20000 + "\n" + mit),
    ]
    files = spark.createDataFrame(rows, "id bigint, path string, text string").selectExpr("*", "1 AS license", "2 AS notice")
    got = {r.id: (r.license, r.how, r.from_id) for r in scan_licenses(files, spark).collect()}
    assert got == {
        1: ("MIT", "own", 1), 2: ("MIT", "inherited", 1), 3: ("MIT", "inherited", 1), 4: ("GPL-3.0", "own", 4), 5: ("MIT", "inherited", 1), 6: (None, None, None), 7: (None, None, None),
        8: ("GPL-3.0", "own", 8), 9: ("GPL-3.0", "inherited", 8), 10: (None, None, None), 11: ("MIT", "inherited", 1), 12: ("MIT", "own", 12),
    }
    assert scan_licenses(files.limit(0), spark).count() == 0


def test_verdicts_of_the_models(spark):
    rows = list(enumerate(URLS))
    got = {x.page_id: x for x in filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), RULES).collect()}
    held = [i for i, u in rows if zlib.crc32((u or "").encode()) % 5 == 0]
    of = {v: [got[i].score for i in held if rule(*parts(URLS[i]))[1] == v] for v in ("allow", "block")}
    assert of["allow"] and of["block"]
    (m, d), (n, e) = ((sum(s) / len(s), (sum((x - sum(s) / len(s)) ** 2 for x in s) / len(s)) ** 0.5 + 1e-9) for s in (of["allow"], of["block"]))
    threshold = (m * e + n * d) / (d + e)
    free = [x for x in got.values() if x.rule is None]
    assert len(free) > 15 and all(x.verdict == ("allow" if x.score >= threshold else "block") for x in free)
    assert {x.verdict for x in free} == {"allow", "block"}


def test_licence_bodies_headers_and_identifiers(spark):
    wrap = lambda t: "\n".join(" * " + " ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    texts = {k: f"Copyright (c) 2020 Some One\n\n{b}\n" for k, b in BODIES.items()}
    rows = [(i, f"d{i}/LICENSE", t) for i, t in enumerate(texts.values())]
    rows += [(100, "x/a.c", "/*\n" + wrap(BODIES["GPL-2.0"]) + "\n */\n\nint main;"), (101, "y/b.c", "// SPDX-License-Identifier: BSD-2-Clause\ncode"), (102, "y/c.c", "code"), (None, "z/LICENSE", texts["ISC"]), (103, "z/k", "code"), (104, "w/k", "// SPDX-License-Identifier: Unheard-Of")]
    got = {r.id: (r.license, r.how) for r in scan_licenses(spark.createDataFrame(rows, "id bigint, path string, text string"), spark).collect()}
    assert [got[i] for i in range(len(texts))] == [(k, "own") for k in texts]
    assert (got[100], got[101], got[102], got[None], got[103], got[104]) == (("GPL-2.0", "own"), ("BSD-2-Clause", "own"), ("BSD-2-Clause", "inherited"), ("ISC", "own"), ("ISC", "inherited"), (None, None))


BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software.
"""
REAL = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def real_licences():
    out = {"BSL-1.0": BOOST, "BSL-1.0 untitled": BOOST.split("\n\n", 1)[1]}
    for name in REAL:
        path = pathlib.Path("/usr/share/common-licenses", name)
        if path.exists():
            out[name] = path.read_text()
    return out


def test_real_licence_files(spark):
    texts = real_licences()
    rows = [(i, f"p{i}/COPYING", t) for i, t in enumerate(texts.values())] + [(100 + i, f"p{i}/src/x.c", "int main;") for i in range(len(texts))]
    rows += [(900, "long/COPYING", texts["BSL-1.0"] + "\nand more words\n" * 30000), (901, "part/NOTICE", "\n".join(next(t for n, t in texts.items() if n in ("GPL-2", "BSL-1.0")).splitlines()[:40]))]
    got = {r.id: (r.license, r.from_id) for r in scan_licenses(spark.createDataFrame(rows, "id bigint, path string, text string"), spark).collect()}
    for i, name in enumerate(texts):
        want = REAL.get(name, "BSL-1.0")
        assert (got[i], got[100 + i]) == ((want, i), (want, i)), name
    assert got[900][0] == "BSL-1.0"


def test_cosines_as_by_definition(spark):
    notices = {i: t[:4000] for i, t in enumerate([*real_licences().values(), *BODIES.values(), "no such words", ""])}
    templates = [(k, t) for k, texts in {**TEMPLATES, **TITLES}.items() for t in texts] + list(BODIES.items())
    words = lambda t: collections.Counter(w for w in re.split(r"[\W_]+", t.lower()) if w)
    every = [words(t) for t in notices.values()] + [words(t) for _, t in templates]
    df = collections.Counter(w for x in every for w in x)
    weights = [{w: n * (math.log((len(every) + 1) / (df[w] + 1)) + 1) for w, n in x.items()} for x in every]
    norm = lambda x: math.sqrt(sum(v * v for v in x.values()))
    want = {}
    for i, x in enumerate(weights[: len(notices)]):
        scores = [(-round(sum(v * y.get(w, 0) for w, v in x.items()) / norm(x) / norm(y), 6) if x else 0, k) for (k, _), y in zip(templates, weights[len(notices) :])]
        if min(scores)[0] < 0:
            want[i] = (-min(scores)[0],)
    got = cosines(spark.createDataFrame([(str(i), t) for i, t in notices.items()], "key string, notice string"), spark.createDataFrame(templates, "license string, text string")).collect()
    assert {int(r.key): (round(r.score, 6),) for r in got} == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}


def test_expressions(spark):
    lines = ["// SPDX-License-Identifier: BSL-1.0", "/* SPDX-License-Identifier: MIT OR Apache-2.0 */", "# SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR  BSD-3-Clause", "<!-- SPDX-License-Identifier: GPL-2.0+ -->", "SPDX-License-Identifier: MIT OR Nothing-Known", "SPDX-License-Identifier:", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(expression(F.col("t"))).collect()]
    assert got == ["BSL-1.0", "MIT OR Apache-2.0", "(GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause", "GPL-2.0+", None, None, None]

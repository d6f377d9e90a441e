import math
import re
from collections import Counter
from pathlib import Path

import pytest

from lexmill.llm import common
from lexmill.llm.license_texts import TEXTS
from lexmill.llm.licenses import HINT, NEGATED, TEMPLATES, scan_licenses


def brute(rows, threshold=0.6, file_threshold=0.9):
    terms = lambda t: Counter(re.findall("[a-z0-9]+", t.lower()))
    df = Counter(w for _, t in TEMPLATES for w in terms(t))
    df = Counter(w for _, t in TEMPLATES for w in set(terms(t)))
    idf = lambda w: math.log((1 + len(TEMPLATES)) / (1 + df[w])) + 1
    vec = lambda t: {w: n * idf(w) for w, n in terms(t).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1

    def best(text, least, rank):
        v = vec(text)
        got = []
        for name, t in TEMPLATES:
            u = vec(t)
            c = round(sum(x * u.get(w, 0) for w, x in v.items()) / norm(v) / norm(u), 6)
            if c >= least:
                got.append((name == "Proprietary", -c, name, rank))
        return got

    hinted = re.compile(HINT)
    hint = type("Header", (), {"search": staticmethod(lambda x: hinted.search(x) and not re.search(NEGATED, x))})
    name = re.compile(r"^(licen[sc]e|copying|copyright|unlicense)([-._].*)?$", re.I)
    own = []
    for _, path, text in rows:
        text = text or ""
        named = bool(path and name.search(path.split("/")[-1]))
        got = []
        if named or hinted.search(text):
            parts = [p for p in re.split(r"\n(?:[^\w\n]*\n)+", text) if hint.search(p)]
            got = best(text, threshold if named else file_threshold, 1)
            for unit in {x for x in text.split("\n") if hint.search(x)} | set(parts) | {"\n".join(parts)}:
                got += best(unit, threshold, 2)
        first = min(got, default=None)
        own.append(first and (first[1], first[2], "file" if named or first[3] == 1 else "header"))
    place = lambda p: re.sub("/?[^/]*$", "", p)
    dirs = {}
    for (_, path, _), got in zip(rows, own, strict=True):
        if got and got[2] == "file" and path is not None:
            dirs[place(path)] = min(dirs.get(place(path), got[:2]), got[:2])
    out = []
    for (i, path, _), got in zip(rows, own, strict=True):
        if not got and path is not None:
            at = place(path).split("/")
            got = next(((*dirs[d], "inherited") for n in range(len(at), -1, -1) if (d := "/".join(at[:n])) in dirs), None)
        out.append((str(i), path, got and got[1], got and -got[0], got and got[2]))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    mit, apache, gpl = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "a/LICENSE", mit + "\nPermission text."), (2, "a/x.txt", "plain"), (3, "a/b/c/y.txt", "plain\n" + apache), (4, "a/b/z.txt", None), (5, "a/b/COPYING", gpl), (6, "a/b/d/e.txt", ""),
        (7, "top.txt", "nothing"), (8, "other/q.txt", mit), (9, "other/deep/r.txt", "x"), (10, None, mit), (11, None, "x"), (None, "a/n.txt", "x"), (12, "ab/x.txt", "prefix of no directory"),
        (13, "a/LICENSE.md", "unrelated words"), (14, "z/LICENSE", ""), (15, "h/h.txt", "words " * 5000 + "\n# " + gpl + "\n" + mit), (16, "t/t.txt", "licence of some kind"), (2, "a/x.txt", "plain"), (17, "/abs/LICENSE", apache), (18, "/abs/f/g", "x"), (19, "/root", "x"),
    ]
    files = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, license string")
    got = sorted(((str(r.doc_id), r.path, r.license, r.score, r.origin) for r in scan_licenses(files).collect()), key=str)
    assert got == brute(rows)
    assert scan_licenses(files.limit(0)).collect() == []


def scan(spark, files):
    rows = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id long, path string, text string")
    return [(r.license, r.origin) for r in scan_licenses(rows).orderBy("doc_id").collect()]


def test_every_template_finds_itself(spark):
    assert scan(spark, [(f"{i}/f", t) for i, (_, t) in enumerate(TEMPLATES)]) == [(n, "file") for n, _ in TEMPLATES]


def test_texts_that_are_no_templates(spark):
    mit = dict(reversed(TEXTS))["MIT"].replace("MIT License. Copyright (c).", "The MIT License\n\nCopyright (c) 2021 Some One. All rights reserved.\n\n").replace(": The above", ":\n\nThe above").replace(" THE SOFTWARE", "\n\nTHE SOFTWARE")
    bsd = Path("/usr/share/common-licenses/BSD")
    bsd = bsd.read_text() if bsd.exists() else dict(TEXTS)["BSD-3-Clause"].replace("copyright holder", "University")
    apache = '/*\n * Copyright 2020 Some One\n *\n * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License.\n */\nint main() {}\n' + "int x = 1;\n" * 200
    gnu = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + "Everyone is permitted to copy and distribute verbatim copies of this license document. " * 30
    got = scan(spark, [
        ("r/LICENSE", mit), ("r/src/a.py", "print(1)"), ("b/COPYING", bsd), ("b/x.c", "/*\n * " + bsd.replace("\n", "\n * ") + "\n */\n" + "code();\n" * 300), ("p/a.c", apache), ("p/b.rs", "// SPDX-License-Identifier: GPL-3.0-or-later\nfn main() {}"),
        ("g/LICENSE.txt", gnu), ("g/deep/er/x", "x"), ("q/x", "words\nAll rights reserved.\nmore"), ("q/y", "words\nLicensed under CC BY-NC 4.0.\nmore"), ("q/z", "a licence of some kind"), ("q/w", "Copyright 2020 X. All rights reserved.\nReleased under the MIT License.\n" + "word " * 300),
    ])
    assert got == [("MIT", "file"), ("MIT", "inherited"), ("BSD-3-Clause", "file"), ("BSD-3-Clause", "header"), ("Apache-2.0", "header"), ("GPL-3.0-or-later", "header"), ("GPL-3.0", "file"), ("GPL-3.0", "inherited"), ("Proprietary", "header"), ("CC-BY-NC-4.0", "header"), (None, None), ("MIT", "header")]


PUBLIC = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause",
}


def test_public_texts_name_themselves_or_nothing(spark):
    there = [(f, want) for f, want in PUBLIC.items() if Path("/usr/share/common-licenses", f).exists()]
    if not there:
        pytest.skip("no public licence texts on this machine")
    got = scan(spark, [(f"{f}/LICENSE", Path("/usr/share/common-licenses", f).read_text(errors="replace")) for f, _ in there])
    named = {f: g[0] for (f, _), g in zip(there, got, strict=True)}
    assert {f: n for f, n in named.items() if n not in (None, PUBLIC[f])} == {}
    assert sum(n is not None for n in named.values()) >= len(there) - 2


def test_negated_lines_give_none(spark):
    got = scan(spark, [("a/x", "This code is not licensed under the MIT License."), ("b/x", "It is not made available under the Apache License, Version 2.0."), ("c/x", "Not released under GPL.\nReleased under the MIT License.")])
    assert got == [(None, None), (None, None), ("MIT", "header")]


def test_hot_directories(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 1)
    assert scan(spark, [("a/LICENSE", "MIT License"), ("a/x", ""), ("a/y", None), ("a/b/z", ""), ("c/d", "")]) == [("MIT", "file"), ("MIT", "inherited"), ("MIT", "inherited"), ("MIT", "inherited"), (None, None)]


def test_no_python_on_executors(spark):
    files = spark.createDataFrame([(1, "a", "b")], "doc_id long, path string, text string")
    plan = scan_licenses(files)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

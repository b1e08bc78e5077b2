"""Licence scans against plain TF-IDF over generated files, and files that name two things."""

import math
import random
import re
from pathlib import Path

from linewatch.llm import licences

TEXTS = Path(licences.__file__).parent / "licence_texts"
ACME = "Copyright (c) 2024, Acme Inc.\nAll rights reserved.\n\n"
APACHE = [h for h in licences.HEADERS if h[0] == "Apache-2.0"][-1][2]


def test_a_reservation_of_rights_yields_to_a_licence(spark):
    apache = "\n".join("# " + APACHE[k:k + 70] for k in range(0, len(APACHE), 70))
    files = [("b/LICENSE", ACME + (TEXTS / "BSD-3-Clause.txt").read_text(), "BSD-3-Clause"), ("b/x.c", "int x;", None),
             ("a.py", "# Copyright (c) 2024 Acme Inc. All rights reserved.\n" + apache, "Apache-2.0"),
             ("g.go", "// Copyright 2024 The Go Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n"
              "// license that can be found in the LICENSE file.\npackage main", "BSD-3-Clause"),
             ("only.c", "// Copyright 2024 Acme Inc. All rights reserved.\nint y;", "Proprietary"),
             ("no.md", "Not licensed under the MIT License.", None), ("never.md", "It was never released under the MIT License.", None),
             ("yes.md", "Released under the MIT License. Do not remove this line.", "MIT"),
             ("in.c", "/*\n" + (TEXTS / "MIT.txt").read_text().split("\n", 3)[-1] + "*/\nint z;", "MIT")]
    filler = spark.range(500).selectExpr("concat('x/', id) path", "concat('this code is not in the file of rights, see word', id) text")
    found = licences.scanned(spark.createDataFrame([f[:2] for f in files], "path string, text string").unionByName(filler))
    got = {r["path"]: r for r in found.where("path not like 'x/%'").collect()}
    assert {p: got[p]["own_licence"] for p, _, _ in files} == {p: want for p, _, want in files}
    assert got["b/x.c"]["licence"] == "BSD-3-Clause" and got["b/x.c"]["inherited_from"] == "b"


def plain(files):
    """Best match of every path by plain arithmetic: (licence, score, line)."""
    words = lambda t: frozenset(w for w in re.split("[^a-z0-9]+", t.lower()) if w)
    seen, n = {}, len(files)
    for _, text in files:
        for w in words(text):
            seen[w] = seen.get(w, 0) + 1
    weight = lambda w: math.log((1 + n) / (1 + seen.get(w, 0))) + 1
    templates = [(name, must, t, sum(weight(w) ** 2 for w in t)) for name, must, t in licences._templates()]
    rare = set(licences.distinctive({w: weight(w) for _, _, t, _ in templates for w in t}))
    out = {}
    for path, text in files:
        lines = text.split("\n")
        hits = [i for i, x in enumerate(lines) if words(x) & rare]
        units = [(i, u) for i in hits for u in [lines[i], *re.split(r"(?<=[.!?;])\s+", lines[i])]]
        starts = {max(i - k, 0) for i in hits for k in range(3)}
        units += [(s, " ".join(lines[s:s + w])) for s in starts for w in licences.WINDOWS]
        units = [(i, words(u)) for i, u in units if words(u) & rare]
        if re.search(licences.LICENCE_FILE, path.split("/")[-1]):
            units.append((-1, words(text)))
        best = []
        for line, unit in units:
            square = sum(weight(w) ** 2 for w in unit)
            for name, must, t, norm in templates:
                if (must and must not in unit) or not unit or (set(licences.DENIALS) & unit and not set(licences.DENIALS) & t):
                    continue
                score = round(sum(weight(w) ** 2 for w in unit & t) / math.sqrt(square * norm), 9)
                if score >= licences.LEAST:
                    best.append((name == "Proprietary", line >= 0, -score, line, name))
        if best:
            _, _, score, line, name = min(best)
            out[path] = (name, -score, line)
    return out


def test_against_plain_tf_idf(spark, monkeypatch):
    monkeypatch.setattr(licences, "FREQUENT", 40)
    chance = random.Random(4)
    notices = [*licences.TEMPLATES.values(), *(h[2] for h in licences.HEADERS)]
    common = "the of a to this file code is under license and for with version see public all".split()
    files = []
    for i in range(250):
        lines = []
        for _ in range(chance.randint(1, 8)):
            notice = chance.choice(notices).split()
            kind = chance.random()
            if kind < 0.25:
                notice = [w for w in notice if chance.random() < 0.8]
            elif kind < 0.4:
                notice = [chance.choice(["Not", "never", "This is", "(c) 2024."]), *notice]
            elif kind < 0.8:
                notice = chance.choices(common + [f"word{chance.randint(0, 300)}"], k=chance.randint(1, 9))
            cut = chance.randint(1, max(1, len(notice)))
            lines += [" ".join(notice[:cut]), " ".join(notice[cut:])] if chance.random() < 0.3 else [" ".join(notice)]
        files.append((f"d{i % 7}/{'LICENSE' if i % 9 == 0 else 'f'}{'.' + str(i)}", "\n".join(lines)))
    rows = licences.scanned(spark.createDataFrame(files, "path string, text string")).collect()
    got = {r["path"]: (r["own_licence"], r["own_score"], r["own_line"]) for r in rows if r["own_licence"]}
    want = plain(files)
    assert len(want) > 100 and {p: v[::2] for p, v in got.items()} == {p: v[::2] for p, v in want.items()}
    assert all(abs(got[p][1] - want[p][1]) < 1e-8 for p in want)

import math
import random
from collections import Counter

from tablewright.llm import license_scan as ls
from tablewright.llm.queries import op6_license_scan

NOTICE = "Licensed under the Apache License, Version 2.0."


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_declaration_and_inheritance(spark):
    prose = "words of prose that say nothing about it at all\n" * 5
    rows = [
        ("LICENSE", "Released under the MIT License."), ("a.txt", prose), ("lib/x/y/deep.txt", prose),
        ("lib/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("lib/x/own.txt", prose + "// " + NOTICE + "\n" + prose), ("lib2/b.txt", prose), ("other/NOTICE.md", prose),
        ("other/c.txt", None), (None, prose), ("cc/only.txt", "Licensed under CC BY-NC 4.0."), ("cc/d.txt", ""),
    ]
    got = {r.path: (r.license, r.inherited_license, r.inherited_from) for r in ls.scan_licenses(files(spark, rows)).collect()}
    assert got["LICENSE"] == ("MIT", "MIT", "") and got["a.txt"] == (None, "MIT", "")
    assert got["lib/x/y/deep.txt"] == (None, "GPL-3.0", "lib") and got["lib/x/own.txt"] == ("Apache-2.0", "GPL-3.0", "lib")
    assert got["lib2/b.txt"] == got["other/NOTICE.md"] == got["other/c.txt"] == (None, "MIT", "")
    assert got[None] == (None, None, None)
    assert got["cc/only.txt"][0] == "CC-BY-NC-4.0" and got["cc/d.txt"] == (None, "MIT", "")


def brute(texts):
    """Every line and every block against every template, with plain dictionaries."""
    n = len(texts)
    df = Counter(t for x in texts for t in set(ls.terms(x or "")))
    weight = lambda t: 0 if t in ls.COMMON else math.log((1 + n) / (1 + df[t])) + 1 if t in ls.VOCABULARY else math.log(1 + n) + 1
    vec = lambda ws: {t: k * weight(t) for t, k in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    templates = [(name, vec(ls.terms(x)), set(ls.terms(x))) for name, xs in ls.TEMPLATES.items() for x in xs]
    out = []
    for text in texts:
        lines = [w for x in (text or "").split("\n") if (w := ls.terms(x))]
        blocks, run = [], []
        for w in [*lines, []]:
            if any(t in ls.VOCABULARY for t in w):
                run.append(w)
            else:
                blocks += [sum(run, [])] if len(run) > 1 else []
                run = []
        best = (-ls.LEAST, None)
        for unit in lines + blocks:
            v, have = vec(unit), set(unit)
            for name, t, said in templates:
                contradicted = not ls.numbers(said) <= ls.numbers(have) or not said & ls.VARIANTS <= have
                more = (have - said) & ls.VARIANTS
                contradicted = contradicted or bool(more) and not ls.Model.harmless(frozenset(more), name)
                if name in ls.ELSEWHERE and not ls.numbers(said):
                    word, wanted = ls.ELSEWHERE[name]
                    contradicted = contradicted or (word in ls.terms(text)) != wanted
                if norm(v) and not contradicted:
                    score = sum(w * t.get(k, 0) for k, w in v.items()) / norm(v) / norm(t)
                    best = min(best, (-round(score, 9), name), key=lambda b: (b[0], b[1] or "~"))
        out.append(best[1] and (best[1], round(-best[0], 4)))
    return out


def test_query_against_brute_force(spark, docs_of, table_dir):
    rnd = random.Random(3)
    notices = [x for xs in ls.TEMPLATES.values() for x in xs]
    texts = [None, "", "\n\n"]
    for _ in range(150):
        lines = [" ".join(rnd.choices("river stone public version work the of 2.0 code".split(), k=rnd.randint(1, 12))) for _ in range(rnd.randint(0, 6))]
        if rnd.random() < 0.6:
            words = rnd.choice(notices).split()
            cut = rnd.randint(0, len(words))
            lines.insert(rnd.randint(0, len(lines)), rnd.choice([" ".join(words), " ".join(words[:cut]) + "\n" + " ".join(words[cut:])]))
        texts.append("\n".join(lines))
    rows = {r.doc_id: r for r in op6_license_scan(spark, table_dir(docs_of(texts))).collect()}
    want = brute(texts)
    assert len(rows) == len(texts) and sum(w is not None for w in want) > 50
    for i, w in enumerate(want):
        assert (rows[i].license and (rows[i].license, round(rows[i].score, 4))) == w, texts[i]


def test_empty_and_clashing_columns(spark):
    df = files(spark, [("a", "x")]).selectExpr("*", "1 as score", "2 as inherited_license", "3 as extra")
    out = ls.scan_licenses(df)
    assert out.collect()[0].asDict() == {
        "path": "a", "extra": 3, "license": None, "score": None, "is_license_file": False, "inherited_license": None,
        "inherited_from": None, "effective_license": None,
    }
    assert ls.scan_licenses(df.limit(0)).count() == 0


PROBES = {
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public\n"
    "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any\nlater version.": "GPL-2.0-or-later",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n1. x": "BSD-2-Clause",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met\n"
    "Neither the name nor its contributors may be used to endorse products": "BSD-3-Clause",
    "This file is not licensed under the Apache License, Version 2.0.": None,
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.": "ISC",
    "Licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1", "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
    "Licensed under CC BY 3.0.": None, "Licensed under the Mozilla Public License, version 2.0.": "MPL-2.0",
}


def test_versions_variants_and_denials():
    model = ls.Model({}, 200_000)
    assert {t: model.scan(t)[0] for t in PROBES} == PROBES
    for name, texts in ls.TEMPLATES.items():
        for text in texts:
            found = model.scan(text + ("\nmay not be used to endorse" if name == "BSD-3-Clause" else ""))[0]
            assert found == name, text


def test_columns_named_like_inner_ones(spark):
    df = spark.createDataFrame([("d/LICENSE", "Released under the MIT License.", 1, 2, 3), ("d/x", "y", 1, 2, 3)], "path string, text string, __dir int, dir int, License int")
    out = ls.scan_licenses(df)
    assert out.columns[:3] == ["path", "__dir", "dir"] and [r.effective_license for r in out.collect()] == ["MIT", "MIT"]


def test_query_hands_down_what_a_folder_says(spark, tmp_path):
    """documents without names inherit from those that are licence statements."""
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    prose = "river stone and nothing else\n" * 3
    rows = [
        (0, mit, "en", "a"), (1, prose, "en", "a"), (2, prose + NOTICE, "en", "a"), (3, None, "en", "a"),
        (4, prose, "de", "a"), (5, "\nMay.\n" + gpl, "en", "b"), (6, prose, "en", "b"),
        (7, mit, "en", "c"), (8, gpl, "en", "c"), (9, prose, "en", "c"), (10, prose + mit, "en", "d"), (11, prose, "en", "d"),
        (12, mit, None, None), (13, "", None, None),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.inherited_license, r.inherited_from, r.effective_license) for r in op6_license_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert got[0] == got[1] == got[3] == ("MIT", "a/en", "MIT") and got[2] == ("MIT", "a/en", "Apache-2.0")
    assert got[4] == (None, None, None) and got[6] == ("GPL-3.0", "b/en", "GPL-3.0")
    assert got[7][2] == "MIT" and got[8][2] == "GPL-3.0" and got[9] == (None, None, None)  # the folder's files disagree
    assert got[10] == (None, None, "MIT") and got[11] == (None, None, None)  # a line in prose speaks for its own document
    assert got[13] == ("MIT", "_/_", "MIT")

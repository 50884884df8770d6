import re
from pathlib import Path

from gleanwork.llm import license_scan as L


def test_whole_texts_and_lines(spark):
    known = L.known_licenses(spark)
    mit = dict(L.LICENSES[::-1])["MIT"]
    full = L.LICENSES[-1][1]
    rows = [
        (1, full.upper().replace("(c) 2020 A. Holder", "(C) 1999 Somebody Else, Inc.")), (2, "some words.\nReleased under the MIT license\n"), (3, None), (4, "..."),
        (5, "Licenced under the Apache Licence, version 2.0!\nx\nreleased under THE mit licence"), (6, mit), (6, mit), (7, "Released under the MIT License. And more."),
    ]
    got = {r.doc_id: (r.license, r.n_license_lines, r.line_licenses) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert got == {1: ("MIT", 0, ""), 2: (None, 1, "MIT"), 3: (None, 0, ""), 4: (None, 0, ""), 5: (None, 2, "Apache-2.0,MIT"), 6: ("MIT", 1, "MIT"), 7: (None, 0, "")}


def test_joins_without_broadcast_agree(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = L.known_licenses(spark)
    first = sorted(map(tuple, L.scan(docs, known).collect()), key=str)
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, L.scan(docs, known).collect()), key=str) == first


def test_sql(spark):
    import oracle

    assert oracle.difference(L.op5_license_scan(spark, "/root/testdata/sf0.001"), oracle.connect("/root/testdata/sf0.001"), L.ORACLE) == ""


def test_empty_table_and_cases(spark, docs, no_docs):
    known = L.known_licenses(spark)
    assert L.scan(no_docs, known).count() == 0
    assert L.scan(docs, known).where("license is not null or n_license_lines > 0").count() == 0
    plan = L.scan(docs, known)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_every_licence_line_of_the_tables(spark):
    """By a plain search for words, from no list of the operator."""
    names = {"GNU General Public License, version 3": "GPL-3.0", "MIT License": "MIT", "Apache License, Version 2.0": "Apache-2.0", "CC BY-NC 4.0": "CC-BY-NC-4.0"}
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text rlike '(?i)licen[sc]ed? under|released under|general public'")
    lines = {r.doc_id: [x for x in r.text.split("\n") if "icense" in x] for r in docs.collect()}
    assert len(lines) == 262
    want = {i: ",".join(sorted({next(v for k, v in names.items() if k in x) for x in found})) for i, found in lines.items()}
    assert "GPL-3.0" in want.values()
    assert {r.doc_id: r.line_licenses for r in L.scan(docs, L.known_licenses(spark)).collect()} == want


def test_whole_texts_of_the_usual_licences(spark):
    long = ["GPL-3.0", "GPL-2.0", "LGPL-3.0", "Apache-2.0", "MPL-2.0", "CC0-1.0"]
    texts = [(name, (Path(L.__file__).parent / "licenses" / f"{name}.txt").read_text(encoding="utf-8")) for name in [*long, "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "MIT-0", "Zlib", "Unlicense", "BSL-1.0"]]
    isc = "Copyright (c) 1999, Nobody\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    texts += [("ISC", isc), ("ISC", "The ISC License\n" + isc), ("MIT", "The MIT License (MIT)\n" + L.LICENSES[-1][1].partition("\n")[2])]
    got = {r.doc_id: r.license for r in L.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string"), L.known_licenses(spark)).collect()}
    assert got == {i: name for i, (name, _) in enumerate(texts)}


def test_copyright_lines_behind_marks(spark):
    import duckdb

    full = L.LICENSES[-1][1]
    own = "Copyright (c) 2020 A. Holder"
    holders = ["© 2020 Holder", "# Copyright 2020 Holder", "// Copyright (c) 2020 Holder", " * Copyright © 2020 Holder", "\t-- © Holder", "* (C) 2020 Holder\n * All rights reserved.", "<!-- Copyright 2020 Holder -->"]
    rows = [full.replace(own, h) for h in holders]
    rows += ["\n".join(f"# {line}" for line in full.split("\n")), full.replace(" COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS").replace(" copyright notice", "\n * copyright notice")]
    got = {r.doc_id: r.license for r in L.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), L.known_licenses(spark)).collect()}
    assert got == dict.fromkeys(range(len(rows)), "MIT")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(rows)))
    assert {r[0]: r[2] for r in con.execute(L.ORACLE).fetchall()} == got
    # A line of words before the sign is no copyright line.
    left = [r.x for r in spark.createDataFrame([("see © 2020\n© y",), ("été © x",)], "t string").select(L.canonical_lines(L.F.lower("t")).alias("x")).collect()]
    assert [x.split() for x in left] == [["see", "2020"], ["été", "x"]]


def test_other_scripts_are_words(spark):
    rows = [(1, "이 문서는 개에 관한 글이다.\nReleased under the MIT License."), (2, "Текст о собаках\nReleased under the MIT License."), (3, "안녕하세요"), (4, "Привет")]
    got = {r.doc_id: (r.license, r.line_licenses) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string"), L.known_licenses(spark)).collect()}
    assert got == {1: (None, "MIT"), 2: (None, "MIT"), 3: (None, ""), 4: (None, "")}


def test_every_whole_text_in_other_clothes(spark):
    """Each known text with its paragraphs broken anew, in capitals, with other spellings and other copyright lines."""
    import textwrap

    def broken(text, width):
        out = []
        for part in text.split("\n\n"):
            head = any(x.strip().lower().startswith(("copyright (", "copyright ©", "portions copyright")) for x in part.split("\n"))
            out.append(part if head else textwrap.fill(" ".join(part.split()), width, break_long_words=False, break_on_hyphens=False))
        return "\n\n".join(out)

    texts = [(f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(L.__file__).parent / "licenses").glob("*.txt"))]
    mit = L.LICENSES[-1][1]
    texts.append(("MIT", mit))
    rows, want = [], {}
    for name, text in texts:
        forms = [text.upper(), broken(text, 61), broken(text, 97), text.replace("license", "licence").replace("authoriz", "authoris"), "Portions Copyright (c) 2001 Somebody\n" + text, "# (c) 2019-2020, The Holders\n" + text]
        for t in forms:
            want[len(rows)] = name
            rows.append((len(rows), t))
    rows.append((len(rows), mit.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS OR\nCOPYRIGHT HOLDERS")))
    want[len(rows) - 1] = "MIT"
    got = {r.doc_id: r.license for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string"), L.known_licenses(spark)).collect()}
    assert {i: (n, got[i]) for i, n in want.items() if got[i] != n} == {}


def test_notices_of_any_wording(spark):
    """On one line with its title, without a year, over two lines, in front of the text: for every short licence."""
    import duckdb

    texts = {name: (Path(L.__file__).parent / "licenses" / f"{name}.txt").read_text(encoding="utf-8") for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "MIT-0", "Zlib")}
    rows, want = [], []
    for name, text in texts.items():
        starts = [re.search(r"\s+".join(x.split()), text, re.I) for x in ("Permission is hereby", "Permission to use", "Redistribution and use", "This software is provided")]
        body = text[min(m.start() for m in starts if m) :]
        title = L.TITLES[name][0]
        rows += [f"{title} Copyright (c) 2020 A. Holder {' '.join(body.split())}", f"Copyright (c) 2020 A. Holder. {' '.join(body.split())}", f"Copyright A. Holder and contributors\n\n{body}", f"Copyright (c) 2020 A. Holder,\nB. Holder <b@holder.org>\nand others\n\n{body}", f"{title}\n\n(c) A. Holder\n{body}", f"My notes.\nCopyright A. Holder\n{body}", f"{body} Copyright A. Holder"]
        want += [name] * 5 + [None] * 2
    got = {r.doc_id: r.license for r in L.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), L.known_licenses(spark)).collect()}
    assert {i: (w, got[i], rows[i][:60]) for i, w in enumerate(want) if got[i] != w} == {}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(rows)))
    assert {r[0]: r[2] for r in con.execute(L.ORACLE).fetchall()} == got


def test_a_notice_does_not_hide_a_line(spark):
    rows = [(1, "Copyright A. Holder\nReleased under the MIT License.\nPermission to use, copy and sell it."), (2, "On copyright.\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."), (3, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.")]
    got = {r.doc_id: r.line_licenses for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string"), L.known_licenses(spark)).collect()}
    assert got == {1: "MIT", 2: "0BSD", 3: "GPL-1.0-or-later"}

import textwrap

from pyspark.sql import functions as F

from tallyflow.llm.known_licenses import LICENSES, NOTICES
from tallyflow.llm.license_scan import SPELLINGS, canonical, scan_licenses, scan_texts


def test_known_texts_are_found_in_other_dress(spark):
    dressed = []
    for k, (name, text) in enumerate(sorted(LICENSES.items())):
        other = text.upper().replace("LICENSE", "LICENCE").replace("\n", "  \r\n").replace(",", " ,")
        dressed.append((k, "Copyright 2021 Some Body\n(c) others\n" + other, name))
    docs = spark.createDataFrame(dressed, "doc_id bigint, text string, name string")
    got = {r.doc_id: r.license for r in scan_licenses(docs).collect()}
    assert got == {k: name for k, _, name in dressed}


def test_spellings_and_copyright_lines(spark):
    pairs = [
        ("The Copyright Owner shall authorise sub-licences.", "the copyright HOLDER shall authorize sublicenses"),
        ("Copyright (c) 2020 A\nText", "text"),
        ("© B\n  copyright C\nText!", "text"),
        ("See https://x.org", "see http x org"),
    ]
    frame = spark.createDataFrame(pairs, "a string, b string").select(canonical(F.col("a")), canonical(F.col("b")))
    for a, b in frame.collect():
        assert a == b


def test_known_texts_are_found_at_any_width(spark):
    rows = []
    for name, text in sorted(LICENSES.items()):
        paragraphs = text.split("\n\n")
        for width in (20, 33, 47, 60, 79, 120, 100_000):
            wrapped = "\n\n".join(textwrap.fill(x, width, break_long_words=False) for x in paragraphs)
            whole = textwrap.fill(text, width, break_long_words=False)
            rows += [(name, wrapped), (name, whole), (name, textwrap.indent(wrapped, " * ")), (name, textwrap.indent(whole, "# "))]
            if "(without title)" in name or "BSD" in name and "title" not in name or name == "0BSD":
                rows += [(name, textwrap.fill(f"Copyright (c) 2020 John Doe. All rights reserved. {text}", width))]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: r.license for r in scan_licenses(docs).collect()}
    assert [(k, name) for k, (name, _) in enumerate(rows) if got[k] != name] == []


def test_only_lines_that_name_a_holder_go(spark):
    gone = ["# Copyright (c) 2020 A", " * © 2021 B", "// copyright 1999 C", "Copyright The Authors", "(c) D", "Copyright [yyyy] E"]
    kept = ["copyright notice and", "# copyright holders be liable", "(c) You must retain", "copyright", "copyright law applies"]
    frame = spark.createDataFrame([(x,) for x in gone + kept], "a string").select("a", canonical(F.col("a")).alias("c"))
    got = {r.a: r.c for r in frame.collect()}
    assert all(got[x] == "" for x in gone) and all(got[x] for x in kept)


def test_edge_rows(spark):
    mit = LICENSES["MIT"]
    rows = [(None, 1), ("", 2), ("...\ncopyright me", 3), (mit, None), (mit, 4), (mit, 4), (mit + " more", 5)]
    rows += [(f"words\n{NOTICES['MIT'].upper()}\n{NOTICES['MIT']}\n{NOTICES['GPL-3.0']}", 6), ("x " * 100_000, 7)]
    docs = spark.createDataFrame([(t, d, "q") for t, d in rows], "text string, doc_id bigint, license string")
    got = sorted((str(r.doc_id), r.license, r.n_notices, tuple(r.notices)) for r in scan_licenses(docs).collect())
    want = [(str(d), "MIT" if t == mit else None, 0, ()) for t, d in rows if d != 6]
    assert got == sorted([*want, ("6", None, 3, ("GPL-3.0", "MIT"))], key=str) or sorted(got, key=str) == sorted(
        [*want, ("6", None, 3, ("GPL-3.0", "MIT"))], key=str
    )
    assert scan_texts(docs).columns == ["digest", "text", "doc_id", "license"]
    assert scan_licenses(docs.limit(0)).count() == 0


def test_own_tables_of_known_texts(spark):
    docs = spark.createDataFrame([(1, "My Terms.\nline"), (2, "other\nnote one")], "doc_id bigint, text string")
    known = spark.createDataFrame([("T", "my terms line"), ("U", "MY TERMS, LINE"), ("E", "")], "name string, text string")
    got = {r.doc_id: (r.license, list(r.notices)) for r in scan_licenses(docs, known, known.limit(0)).collect()}
    assert got == {1: ("T", []), 2: (None, [])}


def test_no_python_in_the_plan(spark, data):
    plan = scan_licenses(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_long_statements_and_odd_lines(spark):
    mit = LICENSES["MIT (without title)"] if "MIT (without title)" in LICENSES else LICENSES["MIT"]
    holders = ", ".join(f"{1990 + i} Holder Number {i}" for i in range(30))
    texts = [f"Copyright (c) {holders}\nand others {mit}", f"Copyright (c) 2020 {'Some Name and ' * 150} Sons. {mit}"]
    texts += [f"Copyright (c) 2020 {'Name ' * 200_000}\n{mit}"]
    odd = ["-" * 100_000 + "x", "# " * 50_000, "copyright (c) 2001 a. " * 20_000, "1. " * 20_000, "permission is hereby " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts + odd)), "doc_id bigint, text string")
    got = {r.doc_id: r.license for r in scan_licenses(docs).collect()}
    assert all((got[k] or "").startswith("MIT") for k in range(len(texts)))
    assert all(got[k] is None for k in range(len(texts), len(got)))


def test_every_spelling_inside_a_sentence(spark):
    pairs = []
    for new, old, ends in SPELLINGS:
        endings = ["", "s"] if "*" in ends or ends == "s?" else [e for e in ends.split("|")] if "+" not in ends else ["ement"]
        for end in endings:
            pairs.append((f"you {old.replace(chr(92) + 'b', '')}{end} the work", f"you {new}{end} the work"))
    pairs += [("they fulfilled it", "they fulfilled it"), ("a paper cent counts", "a paper cent counts"), ("programmed whilstling", "programmed whilstling")]
    frame = spark.createDataFrame(pairs, "a string, b string").select("a", "b", canonical(F.col("a")).alias("c"))
    assert [(r.a, r.c) for r in frame.collect() if r.c != r.b] == []


def test_sql_has_the_same_rule(spark):
    import duckdb

    from tallyflow.llm.native_sql import _canonical

    texts = [t for t in LICENSES.values()]
    texts += [textwrap.indent(textwrap.fill(t, 50), " * ") for t in LICENSES.values()]
    texts += [f"Copyright (c) 2020 A, B and a. Sons\n{t}" for t in LICENSES.values()]
    texts += ["# Copyright A. B", "copyright a.b", "copyright a work", "(c) You must", "© x", "1. (c) 2020 z", "sub-licence, per cent; fulfils HTTPS", None, ""]
    ours = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(canonical(F.col("t")).alias("c")).collect()]
    con = duckdb.connect()
    theirs = [con.execute(f"SELECT {_canonical('t')} FROM (SELECT CAST(? AS VARCHAR) AS t)", [t]).fetchone()[0] for t in texts]
    assert [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b] == []

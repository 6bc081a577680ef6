import random
import re
from pathlib import Path

import duckdb
import pytest

from sievework.llm import license
from sievework.llm.queries import op4_license


def found(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as digest", "'y' as license_id").write.parquet(f"{tmp_path}/documents.parquet")
    return op4_license(spark, str(tmp_path)).collect()


def test_entire_texts_however_they_are_set(spark, tmp_path):
    rows, want = [], {}
    for i, (name, text) in enumerate(license.LICENCES.items()):
        for k, own in enumerate(
            [
                text,
                "Copyright (c) 2020 Some One <a@b.c>\n\n" + text,
                "\n".join("# " + w for w in text.upper().split()) + "\n",
                re.sub(r"\blicense\b", "licence", text.replace(", ", " ,  ")).replace("acknowledgment", "Acknowledgement").replace('"', "“"),
                "/*\n * (C) 1999 X\n * All rights reserved.\n */\n" + text,
            ]
        ):
            rows.append((10 * i + k, own))
            want[10 * i + k] = name
    rows.append((900, "Preface. " + license.LICENCES["MIT"]))
    got = {r.doc_id: r.license_id for r in found(spark, tmp_path, rows)}
    assert got == want | {900: None}


def test_notices_and_edges(spark, tmp_path):
    rows = [
        (1, "Text here\nreleased under the MIT licence!\nmore"),
        (2, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."),
        (3, None),
        (4, ""),
        (5, "!!! \n --"),
        (6, "Copyright 2020 Me"),
        (7, "word " * 300_000),
        (8, "x"),
        (8, "x"),
        (None, "x"),
    ]
    got = found(spark, tmp_path, rows)
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[1].notices, by[1].n_notice_lines) == ("MIT", 1)
    assert (by[2].notices, by[2].n_notice_lines) == ("Apache-2.0,CC-BY-NC-4.0", 2)
    assert [by[i].digest for i in (3, 4, 5, 6)] == [None] * 4
    assert by[None].digest == by[8].digest and by[7].digest and by[7].n_notice_lines == 0


def test_licences_are_told_apart(spark):
    known = license.known_digests(spark)
    assert known.count() == known.select("digest").distinct().count() == len(license.LICENCES) + len(license.DIGESTS)


#: Where systems of one family keep public licence texts.
SHELF = Path("/usr/share/common-licenses")
SHELVED = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not SHELF.exists(), reason="no licence texts here")
def test_long_licences(spark, tmp_path):
    rows, want = [], {}
    for i, (file, name) in enumerate(SHELVED.items()):
        text = (SHELF / file).read_text()
        ends = text.find("END OF TERMS AND CONDITIONS")
        for k, own in enumerate([text, "\n".join("# " + x for x in text.split("\n")), text[:ends] if ends > 0 else text, text[: len(text) // 2]]):
            rows.append((10 * i + k, own))
            want[10 * i + k] = name if k < 3 else None
    assert {r.doc_id: r.license_id for r in found(spark, tmp_path, rows)} == want


def by_hand(text):
    """The canonical form, word by word, without the module's patterns."""
    lines = []
    for line in (text or "").split("\n"):
        own = line.lower().lstrip(" \t*#/;%!-")
        rest = own.removeprefix("copyright").lstrip(" \t") if own.startswith("copyright") else None
        said = rest is not None and (rest.startswith(("(c)", "©", ":", "<", "[")) or re.match(r"\d{4}|by\b", rest))
        lines.append("" if said or own.startswith(("©", "all rights reserved")) or re.match(r"\(c\)[ \t]*(copyright\b|\d{4})", own) else line)
    words = "".join(c if c.isalnum() else " " for c in "\n".join(lines).lower()).split()
    for old, new in license.SPELLINGS.items():
        old, out = old.split(), []
        while words:
            if words[: len(old)] == old:
                out, words = out + new.split(), words[len(old) :]
            else:
                out.append(words.pop(0))
        words = out
    return " ".join(words)


def test_canonical_form_by_hand_and_in_sql(spark):
    rng = random.Random(3)
    words = ["licence", "License", "https://x", "FAVOUR", "favour", "copyright", "Copyright", "(c)", "©", "2020", "holder", "owner", "sub", "non-infringement", "é", "a_b", "\n", "\n# ", "\n", "\r\n", "all rights reserved"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for i in range(400)] + [(900, None), (901, "MIT License\n\nsome text"), (902, "MIT License\n"), (903, license.LICENCES["MIT"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in docs.select("doc_id", license.canonical(docs.text).alias("form")).collect()}
    for i, text in rows[:401]:
        assert got[i].form == (by_hand(text) or None), (text, got[i].form)
    assert got[901].form == "some text" and got[902].form == "mit license"
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    con.register("documents", documents)
    want = sorted(map(str, con.execute(license.ORACLE).fetchall()))
    columns = [c[0] for c in con.description]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in license.scan(docs).collect()))) == want


def test_further_digests(spark):
    docs = spark.createDataFrame([(1, "Our own, quite short LICENCE."), (2, license.LICENCES["MIT"])], "doc_id int, text string")
    own = docs.where("doc_id = 1").select(license.digest(docs.text).alias("digest")).selectExpr("digest", "'Own' as license_id")
    assert {r.doc_id: r.license_id for r in license.scan(docs, more=own).collect()} == {1: "Own", 2: "MIT"}


def test_driver_table(spark):
    """Against a plain reading of the notices' lines."""
    path = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for r in op4_license(spark, path).collect():
        lines = [x.strip().rstrip(".").lower() for x in docs[r.doc_id].split("\n")]
        want = sorted({v for k, v in license.NOTICES.items() if k.lower() in lines})
        assert r.notices == ",".join(want)


@pytest.mark.parametrize("schema", ["doc_id int, text string"])
def test_empty_table(spark, schema):
    assert license.scan(spark.createDataFrame([], schema)).count() == 0


def test_titles_and_padded_notices(spark):
    heads = {"MIT": "MIT License\n\nCopyright (c) 2020 A\n\n", "BSD-3-Clause": "Copyright 2020 A\n\nBSD 3-Clause License\n\n", "ISC": "# ISC License (ISC)\n\n", "Zlib": "The zlib License\n"}
    texts = [(k, h + license.LICENCES[k]) for k, h in heads.items()]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id int, text string")
    assert {r.doc_id: r.license_id for r in license.scan(docs).collect()} == {i: k for i, (k, _) in enumerate(texts)}
    lines = ["/" + "*" * 300 + " Released under the MIT License " + "*" * 300 + "/", "This file is in the public-domain", "MIT License"]
    got = license.scan(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id int, text string")).collect()
    assert {r.doc_id: (r.notices, r.digest is None) for r in got} == {0: ("MIT", False), 1: ("public-domain", False), 2: ("", False)}

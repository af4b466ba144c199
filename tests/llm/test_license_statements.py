"""Licences told by a statement, a title line, the head of a full text or a tag's expression; and texts that tell none."""

from __future__ import annotations

from dialoom.llm import licenses

TELL = [
    ("This project is licensed under the MIT License.", "MIT"),
    ("Intro.\n\nThis library is released under the Apache License, Version 2.0. More text", "Apache-2.0"),
    ("BSD 3-Clause License\n\nCopyright (c) 2020, Someone", "BSD-3-Clause"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", "GPL-3.0"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n", "Apache-2.0"),
    ("This work is licensed under CC BY 4.0 International.", "CC-BY-4.0"),
    ("This work is licensed under a\nlicence.\nThis file is distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("Boost Software License - Version 1.0 - August 17th, 2003", "BSL-1.0"),
    ("Released under the Eclipse Public License 2.0", "EPL-2.0"),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;", "Apache-2.0,MIT"),
    ("# SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause", "BSD-3-Clause,GPL-2.0"),
    ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later OR MIT\n" + "word " * 50_000 + "\nThis code is licensed under the ISC license!", "ISC,LGPL-2.1,MIT"),
    ("We talked about the MIT License and others.", ""),
    ("SPDX-License-Identifier: Foo OR Bar", ""),
    ("Version 3, 29 June 2007\n\nGNU GENERAL PUBLIC LICENSE", ""),
    ("MIT or Apache 2.0", ""),
    ("CC BY 4.0", ""),
    ("", ""),
    (None, ""),
]


def test_statements_titles_heads_and_expressions(spark):
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(TELL)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["licences"] for r in licenses.scan(frame).collect()}
    assert {k: (t[:60] if t else t, found[k]) for k, (t, _) in enumerate(TELL)} == {k: (t[:60] if t else t, w) for k, (t, w) in enumerate(TELL)}
    assert len(licenses.SENTENCES) == len(set(licenses.SENTENCES.values()))


def test_rules_of_one_and_of_more(spark):
    """A sentence that is two rules of one, a rule that names a sentence twice, and rules of one alone."""
    texts = [(1, "a a. b b."), (2, "b b. b b."), (3, "c c")]
    own = {"x": "a a", "y": "b b"}
    got = licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string"), own, [("One", ["x"]), ("Two", ["x"]), ("Both", ["x", "y"]), ("Twice", ["y", "y"])])
    assert {r["doc_id"]: r["licences"] for r in got.collect()} == {1: "Both,One,Two", 2: "Twice", 3: ""}
    alone = licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string"), own, [("One", ["x"])])
    assert {r["doc_id"]: r["licences"] for r in alone.collect()} == {1: "One", 2: "", 3: ""}

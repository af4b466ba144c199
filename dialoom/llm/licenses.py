r"""Operator 7: licence scans by sentence rules.

A text splits into sentences, which are normalised (lower case, letters and digits only,
single spaces) and looked up among known licence sentences; each hit is an identifier.
Texts are split in several ways, whose hits are merged by their place in the text.  A
rule is an ordered list of identifiers (a statement such as "This project is licensed under the MIT License." is a
rule of one; a tag line's expression is a tag for each of its names); a licence is found where a rule's identifiers occur
in order, other sentences between them allowed.  Texts without any word of a set that every
dictionary sentence holds one of can have no hit and are not split.  Sentences that may be known are
exploded and joined with the dictionary by hash (a table given by the caller or fixed in this file,
so its broadcast is bounded), and only hits are grouped by row.

Edge cases: null text is empty; a text without hits has an empty result; very long texts are split whole; hits at one place
are ordered by identifier; extra columns are not read, whatever their names; repeated rows are judged alike; no rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import materialize, text_of

# Sentences of well-known licences, by identifier, in normalised form.
SENTENCES = {
    "apache-ref": "licensed under the apache license version 2 0",
    "apache-grant": "you may not use this file except in compliance with the license",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-ref": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    # Standard notices break at : ; and v., so their pieces are sentences too.
    "gpl-software": "this program is free software",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl3-version": "either version 3 of the license or at your option any later version",
    "gpl2-version": "either version 2 of the license or at your option any later version",
    "gpl-useful": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-version": "2 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "bsd-neither": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl21-version": "either version 2 1 of the license or at your option any later version",
    "lgpl21-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "agpl3-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
}
# Names that follow a tag line's "SPDX-License-Identifier:", and the licence told by them.
TAGS = {
    "Apache-2.0": "Apache-2.0", "MIT": "MIT", "BSD-2-Clause": "BSD", "BSD-3-Clause": "BSD-3-Clause", "ISC": "ISC", "MPL-2.0": "MPL-2.0", "Unlicense": "Unlicense",
    "GPL-2.0": "GPL-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0": "GPL-3.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0",
    "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0",
    "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0", "CC0-1.0": "CC0-1.0", "EPL-2.0": "EPL-2.0", "BSL-1.0": "BSL-1.0", "Zlib": "Zlib",
}
SENTENCES |= {f"tag-{name.lower()}": re.sub(r"[^a-z0-9]+", " ", f"spdx license identifier {name.lower()}") for name in TAGS}
# Names by which statements and title lines tell a licence.
NAMES = {
    "MIT": ["mit license"],
    "Apache-2.0": ["apache license 2 0", "apache license version 2 0", "apache license v2 0", "apache 2 0 license"],
    "BSD": ["bsd 2 clause license", "2 clause bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license"],
    "ISC": ["isc license"],
    "MPL-2.0": ["mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v2 0"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2 0", "gnu gpl v2", "gplv2 license"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license v3 0", "gnu gpl v3", "gplv3 license"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "gnu lesser general public license v3 0"],
    "AGPL-3.0": ["gnu affero general public license version 3", "gnu affero general public license v3 0"],
    "BSL-1.0": ["boost software license 1 0", "boost software license version 1 0"],
    "EPL-2.0": ["eclipse public license 2 0", "eclipse public license v2 0", "eclipse public license version 2 0"],
    "CC-BY-4.0": ["cc by 4 0", "cc by 4 0 international", "cc by 4 0 license", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "cc by sa 4 0 international", "cc by sa 4 0 license", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "cc by nc 4 0 international", "cc by nc 4 0 license", "creative commons attribution noncommercial 4 0 international license"],
    "Zlib": ["zlib license"],
    "Unlicense": ["unlicense"],
}
SUBJECTS = ["project", "software", "program", "work", "library", "package", "code", "repository", "file"]
VERBS = ["licensed", "released", "distributed"]
# Heads of full licence texts, by licence, as the lines that follow one another.
HEADS = {
    "Apache-2.0": ["apache license", "version 2 0 january 2004"],
    "GPL-2.0": ["gnu general public license", "version 2 june 1991"],
    "GPL-3.0": ["gnu general public license", "version 3 29 june 2007"],
    "LGPL-2.1": ["gnu lesser general public license", "version 2 1 february 1999"],
    "LGPL-3.0": ["gnu lesser general public license", "version 3 29 june 2007"],
    "AGPL-3.0": ["gnu affero general public license", "version 3 19 november 2007"],
    "BSL-1.0": ["boost software license version 1 0 august 17th 2003"],
    "CC-BY-4.0": ["creative commons attribution 4 0 international public license"],
    "CC-BY-SA-4.0": ["creative commons attribution sharealike 4 0 international public license"],
    "CC-BY-NC-4.0": ["creative commons attribution noncommercial 4 0 international public license"],
}


def statements(name: str) -> list[str]:
    """How a text says that it is under the licence of this name, as sentences of their own."""
    under = [f"{verb} under {the}{name}" for verb in VERBS for the in ("", "the ")]
    return [*under, *[f"this {subject} is {u}" for subject in SUBJECTS for u in under]]


def titles(name: str) -> list[str]:
    """Names that say license make a title line; bare tokens such as cc by 4 0 don't."""
    return [name, f"the {name}"] if "license" in name.split() else []


KNOWN = set(SENTENCES.values())
STATED = {licence: sorted({x for name in names for x in statements(name) + titles(name)} - KNOWN) for licence, names in NAMES.items()}
SENTENCES |= {f"states-{licence.lower()}-{k}": x for licence, found in STATED.items() for k, x in enumerate(found)}
HEAD_IDS = {x: f"head-{x.replace(' ', '-')}" for lines in HEADS.values() for x in lines if x not in SENTENCES.values()}
SENTENCES |= {i: x for x, i in HEAD_IDS.items()}
GPL_HOPES = (["gpl-hope"], ["gpl-useful", "gpl-implied"])
# Licence and the identifiers that must occur in order.
RULES = [
    ("Apache-2.0", ["apache-ref"]),
    ("Apache-2.0", ["apache-grant", "apache-asis", "apache-see"]),
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    ("BSD", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0", ["gpl3-ref"]),
    *[("GPL-3.0", free + hope) for free in (["gpl-free"], ["gpl-software", "gpl3-terms"], ["gpl-software", "gpl-terms", "gpl3-version"]) for hope in GPL_HOPES],
    *[("GPL-2.0", free + hope) for free in (["gpl2-free"], ["gpl-software", "gpl2-terms"], ["gpl-software", "gpl-terms", "gpl2-version"]) for hope in GPL_HOPES],
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl-ref"]),
    ("MPL-2.0", ["mpl-form", "mpl-version"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("Unlicense", ["unlicense"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-neither"]),
    ("LGPL-2.1", ["lgpl21-terms"]),
    ("LGPL-2.1", ["lgpl-terms", "lgpl21-version"]),
    ("LGPL-3.0", ["lgpl3-terms"]),
    ("LGPL-3.0", ["lgpl-terms", "gpl3-version"]),
    ("AGPL-3.0", ["agpl3-terms"]),
    ("AGPL-3.0", ["agpl-terms", "gpl3-version"]),
    *[(licence, [f"tag-{name.lower()}"]) for name, licence in TAGS.items()],
    *[(licence, [HEAD_IDS[x] for x in lines]) for licence, lines in HEADS.items()],
    *[(licence, [f"states-{licence.lower()}-{k}"]) for licence, found in STATED.items() for k in range(len(found))],
]
#: a sentence ends at . ! ? : ; before white space or the end, at a blank line, or at a list mark
SENTENCE_END = r"[.!?:;]+(?=\s|$)|\n\s*\n|\n\s*(?:[*-]|\(?\d+[.)])\s|\n"
PARAGRAPH_END = r"[.!?:;]+(?=\s|$)|\n\s*\n|\n\s*(?:[*-]|\(?\d+[.)])\s"
#: in comments a line may begin with signs alone (*, //, #, ;;), which are no list mark and no sentence's end
COMMENT_END = r"(?<=[\p{L}\p{N}\p{Pe}\p{Pf}\"'])[.!?:;]+(?=\s|$)|\n[^\p{L}\p{N}\n]*(?=\n)|\n[^\p{L}\p{N}\n]*\d+[.)]\s"
#: a tag is a line of its own, whatever signs it holds
LINE_END = r"\n"


#: between the names of a normalised tag; "or later" is part of a name
EXPRESSION = " (?:or(?! later)|and|with) "
WAYS = {"line": SENTENCE_END, "wrapped": PARAGRAPH_END, "comment": COMMENT_END, "tag": LINE_END}
#: set around ends, which stay pieces of their own, so that places can be counted
MARK = "\u0001"


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def needed_words(sentences: Iterable[str]) -> str:
    """A pattern of few words, for lower-case texts: each sentence holds one, so a text without any has no hit.

    Words of six and more letters are picked by how many sentences still hold none; a sentence
    without such words is looked for as a whole.
    """
    gap = r"[^\p{L}\p{N}]+"
    left, chosen = [s.split() for s in sorted(set(sentences))], []
    while left:
        counts = Counter(w for s in left for w in {*s} if len(w) >= 6)
        word = max(counts, key=lambda w: (counts[w], len(w), w), default=None)
        if word is None:
            chosen += [gap.join(s) for s in left if s]
            break
        chosen.append(word)
        left = [s for s in left if word not in " ".join(s)]
    return "|".join(chosen) or "(?!)"


def placed(pieces: Column, known: list[str]) -> Column:
    """(at, sentence) of the known sentences among a text's pieces; at: letters and digits before it, alike in all ways."""
    before = lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(F.translate(x, " ", "")))
    found = F.filter(F.transform(pieces, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"].isin(known))
    return F.transform(found, lambda p: F.struct(before(p["i"]).alias("at"), p["x"].alias("sentence")))


TAG = "spdx license identifier "


def placed_tags(pieces: Column, known: list[str]) -> Column:
    """As ``placed``, for lines whose tag is an expression: each name of it as a tag line of its own, at the line's place and in its order."""
    before = lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(F.translate(x, " ", "")))
    lines = F.filter(F.transform(pieces, lambda x, i: F.struct(i.alias("i"), F.split(F.substring_index(F.concat(F.lit(" "), x), " " + TAG, -1), EXPRESSION, -1).alias("names"), F.contains(F.concat(F.lit(" "), x), F.lit(" " + TAG)).alias("tag"))), lambda p: p["tag"] & (F.size(p["names"]) > 1))
    named = F.transform(lines, lambda p: F.transform(p["names"], lambda y, j: F.struct((before(p["i"]) + j).alias("at"), F.concat(F.lit(TAG), F.trim(y)).alias("sentence"))))
    return F.filter(F.flatten(named), lambda h: h["sentence"].isin(known))


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """A row per document: doc_id, n_sentences (hits), sentence_ids in order, licences sorted.
    ``sentences`` are normalised, ``rules`` name identifiers of letters, digits and hyphens or dots."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    spark = docs.sparkSession
    told = F.when(F.regexp_like(F.lower("text"), F.lit(needed_words(sentences.values()))), F.translate("text", MARK, " "))
    rows = docs.select("doc_id", text_of().alias("text")).select("doc_id", told.alias("told"))
    # Sentences that are lines of their own, wrapped over lines, and wrapped over lines of a comment are all tried.
    for way, end in WAYS.items():
        rows = rows.withColumn(way, F.transform(F.split(F.regexp_replace("told", f"({end})", f"{MARK}$1{MARK}"), MARK, -1), normal))
    known = sorted(set(sentences.values()))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.array_distinct(F.concat(*[placed(F.col(way), known) for way in WAYS], placed_tags(F.col("tag"), known))).alias("known"))
    rows = materialize(rows, "licence-rows")  # row numbers are fixed from here on
    # Rules of one identifier are told by the join; only longer ones look at the order.
    alone = {i: sorted({name for name, r in rules if r == [i]}) for i in {r[0] for _, r in rules if len(r) == 1}}
    table = spark.createDataFrame([(i, x, alone.get(i, [])) for i, x in sentences.items()], "id string, sentence string, alone array<string>")
    exploded = rows.filter("size(known) > 0").select("_row", F.explode("known").alias("x")).select("_row", "x.at", "x.sentence")
    hits = exploded.join(F.broadcast(table), "sentence").select("_row", "at", "id", "alone")
    per_row = hits.groupBy("_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids"), F.flatten(F.collect_list("alone")).alias("alone"))
    out = rows.select("doc_id", "_row").join(per_row, "_row", "left")
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    code = F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))
    found = F.array(*[F.when(F.regexp_like(code, F.lit("," + ",(?:.*,)?".join(map(re.escape, r)) + ",")), F.lit(name)) for name, r in rules if len(r) != 1]).cast("array<string>")
    licences = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.concat(found, F.coalesce("alone", F.array().cast("array<string>")))))), ",")
    return out.select("doc_id", F.size(ids).cast("long").alias("n_sentences"), F.array_join(ids, ",").alias("sentence_ids"), licences.alias("licences"))

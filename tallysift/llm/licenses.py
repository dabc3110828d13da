"""Licence scan by sentences, with DataFrame functions only.

Texts are cut into sentences, normalised (lower case, runs of other characters than a to z and 0 to 9 become
a space) and mapped to identifiers of known licence sentences. A sentence may be wrapped over lines, with comment
prefixes; it may also begin or end at any line end. The identifiers of a document, in
order, are matched against ordered rules: a rule is a sequence of identifiers; rules come longest
first, and what a rule has matched is not matched again.

There is no shuffle: a document is a row of its own, and the tables are literals.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysift.session import table

# The sentences of public licence texts and notices that are recognised, by identifier.
SENTENCES = {
    "arr": "All rights reserved.",
    "mit-rel": "Released under the MIT License.",
    "mit-lic": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-title2": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "apache-lic": "Licensed under the Apache License, Version 2.0.",
    "apache-the": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-may": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-redist": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "bsd-redist": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ccbync4": "Licensed under CC BY-NC 4.0.",
    "ccby4": "Licensed under CC BY 4.0.",
    "ccbysa4": "Licensed under CC BY-SA 4.0.",
    "cc0": "Licensed under CC0 1.0.",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-title": "ISC License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-title": "Apache License Version 2.0, January 2004",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl2-redist": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-redist": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-redist": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "agpl3-redist": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "bsl": "Boost Software License - Version 1.0 - August 17th, 2003",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "mit-under": "This project is licensed under the MIT License.",
    "apache-under": "This project is licensed under the Apache License 2.0.",
    "gpl-v3": "Licensed under the GNU General Public License v3.0.",
    "gpl-v2": "Licensed under the GNU General Public License v2.0.",
    "ccby4-int": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa4-int": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbync4-int": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl2": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx-gpl2p": "SPDX-License-Identifier: GPL-2.0-or-later",
    "spdx-gpl3p": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-lgpl21": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "spdx-mpl2": "SPDX-License-Identifier: MPL-2.0",
    "spdx-bsd2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-cc0": "SPDX-License-Identifier: CC0-1.0",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
}
# The licence that a sequence of sentences names.
RULES = (
    ("BSD-3-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-name")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-asis", "mit-liable")),
    ("MIT", ("mit-title2", "mit-grant", "mit-notice", "mit-asis", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liable")),
    ("Apache-2.0", ("apache-the", "apache-may", "apache-obtain", "apache-unless")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-title2", "mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("BSD-2-Clause", ("bsd-redist", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-the", "apache-may", "apache-obtain")),
    ("GPL-3.0-or-later", ("gpl-redist", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-redist", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl3-redist", "gpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl21-redist", "lgpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl3-redist", "lgpl-hope")),
    ("MPL-2.0", ("mpl2-notice", "mpl2-copy")),
    ("ISC", ("isc-title", "isc-grant")),
    ("Zlib", ("zlib-asis", "zlib-grant")),
    ("Apache-2.0", ("apache-title", "apache-terms")),
    ("Apache-2.0", ("apache-the", "apache-may")),
    ("Apache-2.0", ("apache-lic",)),
    ("MIT", ("mit-rel",)),
    ("MIT", ("mit-lic",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("CC-BY-NC-4.0", ("ccbync4",)),
    ("CC-BY-4.0", ("ccby4",)),
    ("CC-BY-SA-4.0", ("ccbysa4",)),
    ("CC0-1.0", ("cc0",)),
    ("GPL-3.0-or-later", ("gpl-redist",)),
    ("GPL-2.0-or-later", ("gpl2-redist",)),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("AGPL-3.0-or-later", ("agpl3-redist",)),
    ("LGPL-2.1-or-later", ("lgpl21-redist",)),
    ("LGPL-3.0-or-later", ("lgpl3-redist",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("ISC", ("isc-grant",)),
    ("EPL-2.0", ("epl2",)),
    ("Unlicense", ("unlicense",)),
    ("BSL-1.0", ("bsl",)),
    ("WTFPL", ("wtfpl",)),
    ("MIT", ("mit-under",)),
    ("Apache-2.0", ("apache-under",)),
    ("GPL-3.0", ("gpl-v3",)),
    ("GPL-2.0", ("gpl-v2",)),
    ("CC-BY-4.0", ("ccby4-int",)),
    ("CC-BY-SA-4.0", ("ccbysa4-int",)),
    ("CC-BY-NC-4.0", ("ccbync4-int",)),
    ("GPL-2.0-only", ("spdx-gpl2",)),
    ("GPL-2.0-or-later", ("spdx-gpl2p",)),
    ("GPL-3.0-or-later", ("spdx-gpl3p",)),
    ("LGPL-2.1-or-later", ("spdx-lgpl21",)),
    ("MPL-2.0", ("spdx-mpl2",)),
    ("BSD-2-Clause", ("spdx-bsd2",)),
    ("ISC", ("spdx-isc",)),
    ("CC0-1.0", ("spdx-cc0",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("GPL-3.0-only", ("spdx-gpl3",)),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("All-rights-reserved", ("arr",)),
)


def plain(sentence: str) -> str:
    """Normal form of a sentence, as the columns have it."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


#: Marks of sentence ends that no known sentence goes over, and of single line ends.
END, WRAP = "\x01", "\n"


def pattern() -> str:
    """Regular expression of all known sentences between marks, longer ones first; blanks in them may be line ends."""
    forms = []
    for s in sorted(SENTENCES.values(), key=lambda s: (-len(plain(s)), s)):
        # a sentence may itself hold a stop before a blank, where the text is cut as well
        parts = [plain(x).replace(" ", f"[ {WRAP}]") for x in re.split("[.!?;:][ \t]+", s)]
        forms.append(f"[ {WRAP}{END}]".join(parts))
    return f"(?<=[{WRAP}{END}])(?:{'|'.join(forms)})(?=[{WRAP}{END}])"


def marked(text: Column) -> Column:
    """Normal form of a text: words, with ``END`` at .!?;: before a blank or line end and at empty lines, ``WRAP`` at other line ends."""
    bare = F.regexp_replace(F.lower(text), "(^|\n)[ \t]*(?:;+|!+|:+|rem|dnl)[ \t]+", "$1")
    # a line without letters a to z and digits is empty
    cut = F.regexp_replace(bare, "[.!?;:](?=[ \t\r\f\x0b\n]|$)|\n[^a-z0-9\n]*(?=\n)", END)
    words = F.regexp_replace(cut, f"[^a-z0-9{WRAP}{END}]+", " ")
    ends = F.regexp_replace(words, f" ?{WRAP}? ?{END}[ {WRAP}{END}]*", END)
    return F.concat(F.lit(END), F.regexp_replace(F.trim(ends), f" ?{WRAP} ?", WRAP), F.lit(END))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order. Of sentences that begin at one place the longest counts."""
    known = F.create_map(*[F.lit(x) for name, s in SENTENCES.items() for x in (plain(s), name)])
    found = F.regexp_extract_all(marked(text), F.lit(pattern()), F.lit(0))
    return F.transform(found, lambda s: F.element_at(known, F.translate(s, WRAP + END, "  ")))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licences, sentences, first) for rows of (doc_id, text) with a known sentence.

    licences holds the matched rules' licences, distinct and in order of name, joined by commas ('' if the known
    sentences fit no rule); sentences counts known sentences; first is the identifier of the first one.
    Null and empty texts give no row; repeated rows give a row each. Columns of the input
    other than doc_id and text are not read.
    """
    rules = F.array(*[F.struct(F.lit("," + ",".join(ids) + ",").alias("ids"), F.lit(name).alias("name")) for name, ids in RULES])
    start = F.struct(F.col("line").alias("line"), F.array().cast("array<string>").alias("names"))

    def match(state: Column, rule: Column) -> Column:
        hit = F.contains(state["line"], rule["ids"])
        return F.struct(
            F.replace(state["line"], rule["ids"], F.lit(",;,")).alias("line"),
            F.when(hit, F.array_append(state["names"], rule["name"])).otherwise(state["names"]).alias("names"),
        )

    found = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids")).filter(F.size("ids") > 0)
    # every identifier has commas of its own on both sides
    lined = found.withColumn("line", F.concat(F.lit(","), F.array_join("ids", ","), F.lit(",")))
    matched = lined.withColumn("names", F.aggregate(rules, start, match)["names"])
    return matched.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct("names")), ",").alias("licences"),
        F.size("ids").cast("long").alias("sentences"),
        F.element_at("ids", 1).alias("first"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The scan of the documents table in DuckDB SQL, from the same tables of sentences and rules."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(plain(s))}, {quote(name)})" for name, s in SENTENCES.items())
    step = "select doc_id, rid, ids, ',' || array_to_string(ids, ',') || ',' as line, []::varchar[] as names from d"
    for name, ids in RULES:
        pattern = quote("," + ",".join(ids) + ",")
        step = (
            f"select doc_id, rid, ids, replace(line, {pattern}, ',;,') as line, "
            f"case when contains(line, {pattern}) then list_append(names, {quote(name)}) else names end as names from ({step})"
        )
    return f"""
with known(norm, name) as (values {known}),
rows as (select doc_id, text, row_number() over () as rid from documents),
s as (
  select doc_id, rid, unnest(string_split(regexp_replace(text, '([.!?;:])[ \\t\\r\\f\\v]+', '\\1' || chr(10), 'g'), chr(10))) as line,
    generate_subscripts(string_split(regexp_replace(text, '([.!?;:])[ \\t\\r\\f\\v]+', '\\1' || chr(10), 'g'), chr(10)), 1) as pos
  from rows
),
d as (
  select doc_id, rid, list(name order by pos) as ids
  from s join known on known.norm = trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g'))
  group by doc_id, rid
)
select doc_id, array_to_string(list_sort(list_distinct(names)), ',') as licences, len(ids)::bigint as sentences, ids[1] as first from ({step})
"""

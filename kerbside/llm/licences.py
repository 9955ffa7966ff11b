"""Licence scans by sentence rules.

A text is cut into sentences, each is normalised (A-Z lowered, every run of
other characters than a-z and 0-9 a space) and looked up among known licence
sentences.  The identifiers found, in order, are matched against the licence
rules one after the other; what a rule matches is taken out before the next
rule looks.  Sentences that are not known stand in no rule's way.

Comment marks, bullets and numbers at the start of a line are no part of a
sentence.  A sentence ends at a mark before white space, at a colon that ends
a line, and at a blank line; a single line end inside it is a space, as
licences are published wrapped.  A stretch that is not known as a whole is
read line by line, as one-line statements often have no mark at their end.

Sentences and rules are arguments: pairs of (identifier, sentence), where
several sentences may share an identifier as its variants, and of (licence,
identifiers in order).  They go into the plan as literals, so they are meant
for some hundreds of entries.

A null or empty text has no sentences.  Each input row has a result row;
repeated rows have equal ones.  Other columns than doc_id and text are not
read.  An empty table gives no rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Sentences = Sequence[tuple[str, str]]
Rules = Sequence[tuple[str, Sequence[str]]]

# Known sentences (identifier, sentence), in normal spelling and as ENDS cuts them ("v." ends one).
SENTENCES = [
    ("AsIs", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("ApacheLic", "Licensed under the Apache License, Version 2.0"),
    ("ApacheLicYou", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("ApacheCopy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheAsIs", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("ApacheSee", "See the License for the specific language governing permissions and limitations under the License"),
    ("BSDGrant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSDSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSDBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSDName", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("CCBY", "Licensed under CC BY 4.0"),
    ("CCBYSA", "Licensed under CC BY-SA 4.0"),
    ("CCBYNC", "Licensed under CC BY-NC 4.0"),
    ("CCZero", "This work is dedicated to the public domain under CC0 1.0"),
    ("GPLFree", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPLHope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("GPLSee", "See the GNU General Public License for more details"),
    ("GPLWork", "This work is licensed under the GNU General Public License, version 3"),
    ("MITGrant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MITNotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MITRelease", "Released under the MIT License"),
    ("Reserved", "All rights reserved"),
    ("AGPLFree", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPLSee", "See the GNU Affero General Public License for more details"),
    ("ApacheCopy", "You may obtain a copy of the License at"),
    ("ApacheCopy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("BSDAsIs", "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("BSDDamage", "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage"),
    ("BSDDamage", "In no event shall the copyright owner or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage"),
    ("BoostSee", "Distributed under the Boost Software License, Version 1.0"),
    ("EPLTerms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL2Free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL2Only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPLReceived", "You should have received a copy of the GNU General Public License along with this program"),
    ("ISCGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISCAsIs", "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("LGPL21Free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL3Free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPLHope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("LGPLSee", "See the GNU Lesser General Public License for more details"),
    ("MITDamage", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("MPLSubject", "This Source Code Form is subject to the terms of the Mozilla Public License, v"),
    ("MPLCopy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("MPLCopy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("UnlicenseFree", "This is free and unencumbered software released into the public domain"),
    ("UnlicenseAnyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("ZlibAsIs", "This software is provided 'as-is', without any express or implied warranty"),
    ("ZlibGrant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("ISCGrantNoNotice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]
# Rules (licence, identifiers in order); the first that fits wins.
RULES = [
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDName", "BSDAsIs", "BSDDamage"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDAsIs", "BSDDamage"]),
    ("MIT", ["MITGrant", "MITNotice", "AsIs", "MITDamage"]),
    ("AGPL-3.0-or-later", ["AGPLFree", "GPLHope", "AGPLSee"]),
    ("AGPL-3.0-or-later", ["AGPLFree"]),
    ("GPL-2.0-or-later", ["GPL2Free", "GPLHope", "GPLSee"]),
    ("GPL-2.0-or-later", ["GPL2Free"]),
    ("GPL-2.0-only", ["GPL2Only", "GPLHope", "GPLSee"]),
    ("GPL-2.0-only", ["GPL2Only"]),
    ("LGPL-2.1-or-later", ["LGPL21Free", "LGPLHope", "LGPLSee"]),
    ("LGPL-2.1-or-later", ["LGPL21Free"]),
    ("LGPL-3.0-or-later", ["LGPL3Free", "GPLHope", "LGPLSee"]),
    ("LGPL-3.0-or-later", ["LGPL3Free"]),
    ("ISC", ["ISCGrant", "ISCAsIs"]),
    ("0BSD", ["ISCGrantNoNotice", "ISCAsIs"]),
    ("MPL-2.0", ["MPLSubject", "MPLCopy"]),
    ("Unlicense", ["UnlicenseFree", "UnlicenseAnyone"]),
    ("Unlicense", ["UnlicenseFree"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant"]),
    ("BSL-1.0", ["BoostSee"]),
    ("EPL-2.0", ["EPLTerms"]),
    ("Apache-2.0", ["ApacheLicYou", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheLicYou", "ApacheCopy"]),
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDName"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary"]),
    ("GPL-3.0-or-later", ["GPLFree", "GPLHope", "GPLSee"]),
    ("GPL-3.0-or-later", ["GPLFree"]),
    ("MIT", ["MITGrant", "MITNotice", "AsIs"]),
    ("MIT", ["MITGrant", "MITNotice"]),
    ("Apache-2.0", ["ApacheLic"]),
    ("CC-BY-4.0", ["CCBY"]),
    ("CC-BY-SA-4.0", ["CCBYSA"]),
    ("CC-BY-NC-4.0", ["CCBYNC"]),
    ("CC0-1.0", ["CCZero"]),
    ("GPL-3.0-only", ["GPLWork"]),
    ("MIT", ["MITRelease"]),
]
# Identifiers that a one-line tag may name.
TAGGED = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
SENTENCES += [(f"Tag:{x}", f"SPDX-License-Identifier: {x}") for x in TAGGED]
RULES += [(x, [f"Tag:{x}"]) for x in TAGGED]

#: What stands at the start of a line beside its text: comment marks, then a bullet's number or letter.
MARKS = r"(^|\n)[-/*#;>% \t\r]*([(]?[0-9a-z][.)][ \t]+)?"
#: Where a sentence ends: marks before white space or the end, a colon that ends a line, a blank line.
ENDS = r"[.!?]+([ \t\r\n\f]+|\z)|:[ \t\r]*\n|\n[ \t\r\n\f]*\n"
OTHER = r"[^a-z0-9]+"


def normal(sentence: str) -> str:
    low = sentence.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return re.sub(OTHER, " ", low).strip(" ")


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, OTHER, " "))


def _cut(text: Column, known: Column) -> Column:
    """A text's sentences, normalised: stretches that are known as a whole, else their lines."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    stretches = F.transform(F.split(F.regexp_replace(low, MARKS, "$1"), ENDS), lambda c: F.struct(_normal(c).alias("n"), c.alias("c")))
    lines = F.transform(stretches, lambda x: F.when(known[x.n].isNotNull(), F.array(x.n)).otherwise(F.transform(F.split(x.c, "\n"), _normal)))
    return F.filter(F.flatten(lines), lambda s: s != "")


def scan(docs: DataFrame, sentences: Sentences = SENTENCES, rules: Rules = RULES) -> DataFrame:
    """doc_id, n_sentences, n_known, sentence_ids, places (numbers of the known sentences, from 0), licences and left_over."""
    by_sentence = {normal(s): i for i, s in sentences}
    known = F.create_map(*[F.lit(x) for pair in by_sentence.items() for x in pair])
    d = docs.select("doc_id", _cut(F.col("text"), known).alias("s"))
    hits = F.filter(F.transform("s", lambda x, i: F.struct(known[x].alias("id"), i.alias("place"))), lambda x: x.id.isNotNull())
    d = d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), hits.alias("hits"))
    d = d.withColumn("rest", F.concat_ws("", F.transform("hits.id", lambda x: F.concat(F.lit("<"), x, F.lit(">")))))
    found = []
    for i, (licence, ids) in enumerate(rules):
        pattern = F.lit("".join(f"<{x}>" for x in ids))
        found.append(F.when(F.col(f"has{i}"), F.lit(licence)))
        d = d.withColumn(f"has{i}", F.contains("rest", pattern)).withColumn("rest", F.replace("rest", pattern, F.lit("")))
    licences = F.concat_ws(",", F.array_distinct(F.array_compact(F.array(*found))))
    left = F.regexp_replace(F.regexp_replace("rest", "><", ","), "[<>]", "")
    return d.select(
        "doc_id",
        "n_sentences",
        F.size("hits").cast("long").alias("n_known"),
        F.concat_ws(",", "hits.id").alias("sentence_ids"),
        F.concat_ws(",", F.col("hits.place").cast("array<string>")).alias("places"),
        licences.alias("licences"),
        left.alias("left_over"),
    )


def scan_sql(sentences: Sentences = SENTENCES, rules: Rules = RULES) -> str:
    """DuckDB's form of ``scan``."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"('{s}', {quoted(i)})" for s, i in {normal(s): i for i, s in sentences}.items())
    steps, prev, found = [], "found", []
    for i, (licence, ids) in enumerate(rules):
        pattern = quoted("".join(f"<{x}>" for x in ids))
        steps.append(f"r{i} AS (SELECT *, contains(rest{i}, {pattern}) AS has{i}, replace(rest{i}, {pattern}, '') AS rest{i + 1} FROM {prev})")
        found.append(f"CASE WHEN has{i} THEN {quoted(licence)} END")
        prev = f"r{i}"
    n = len(rules)
    low = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    norm = f"trim(regexp_replace({{}}, '{OTHER}', ' ', 'g'), ' ')"
    # the first place of each licence gives the order
    return f"""
WITH known(sentence, id) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_split_to_array(regexp_replace({low}, '{MARKS}', '\\1', 'g'), '{ENDS}') AS s FROM documents),
stretches AS (SELECT r, i, c, {norm.format("c")} AS n FROM (SELECT r, unnest(s) AS c, unnest(range(len(s))) AS i FROM docs)),
judged AS (SELECT r, i, c, n, id FROM stretches LEFT JOIN known ON n = sentence),
lines AS (SELECT r, i, j, {norm.format("l")} AS n FROM (SELECT r, i, unnest(string_split(c, chr(10))) AS l, unnest(range(len(string_split(c, chr(10))))) AS j FROM judged WHERE id IS NULL)),
pieces AS (SELECT r, i, 0 AS j, n FROM judged WHERE id IS NOT NULL UNION ALL SELECT r, i, j, n FROM lines WHERE n <> ''),
numbered AS (SELECT r, n, row_number() OVER (PARTITION BY r ORDER BY i, j) - 1 AS place FROM pieces),
totals AS (SELECT r, count(*) AS n_sentences FROM pieces GROUP BY r),
hits AS (SELECT r, count(*) AS n_known, string_agg(id, ',' ORDER BY place) AS sentence_ids, string_agg(place::VARCHAR, ',' ORDER BY place) AS places, string_agg('<' || id || '>', '' ORDER BY place) AS seq FROM numbered JOIN known ON n = sentence GROUP BY r),
found AS (SELECT doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_known, 0)::BIGINT AS n_known, coalesce(sentence_ids, '') AS sentence_ids, coalesce(places, '') AS places, coalesce(seq, '') AS rest0 FROM docs LEFT JOIN totals USING (r) LEFT JOIN hits USING (r)),
{", ".join(steps)}
SELECT doc_id, n_sentences, n_known, sentence_ids, places, array_to_string(list_filter([{", ".join(found)}], lambda x, i: x IS NOT NULL AND list_position([{", ".join(found)}], x) = i), ',') AS licences, replace(replace(replace(rest{n}, '><', ','), '<', ''), '>', '') AS left_over FROM {prev}
"""

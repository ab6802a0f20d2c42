"""License scan by sentence rules, in built-in functions only.

A text is cut into sentences, each is normalised and looked up among the parts of known licence sentences (a sentence
with a mark inside has several, which count where they follow each other); the identifiers, in text order, are then
matched against ordered rules (a rule's sentences must occur in its order, others may stand between). All of that
happens within a row: no shuffle, no Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.text import ascii_lower, whole

# Sentences of public licence texts and of the customary notices.
SENTENCES = {
    "S01": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "S02": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "S03": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "S04": "Released under the MIT License.",
    "S05": "Licensed under the MIT License.",
    "S06": "Licensed under the Apache License, Version 2.0.",
    "S07": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "S08": "You may not use this file except in compliance with the License.",
    "S09": "You may obtain a copy of the License at",
    "S10": "See the License for the specific language governing permissions and limitations under the License.",
    "S11": "This work is licensed under the GNU General Public License, version 3.",
    "S12": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "S13": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "S14": "See the GNU General Public License for more details.",
    "S15": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "S16": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "S17": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "S18": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "S19": "Licensed under CC BY-NC 4.0.",
    "S20": "Licensed under CC BY 4.0.",
    "S21": "Licensed under CC BY-SA 4.0.",
    "S22": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "S23": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "S24": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "S25": "All rights reserved.",
    "S26": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "S27": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "S28": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "S29": "See the GNU Lesser General Public License for more details.",
    "S30": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "S31": "See the GNU Affero General Public License for more details.",
    "S32": "This is free and unencumbered software released into the public domain.",
    "S33": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "S34": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "S35": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "S36": "This software is provided 'as-is', without any express or implied warranty.",
    "S37": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "S38": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "S39": "SPDX-License-Identifier: MIT",
    "S40": "SPDX-License-Identifier: Apache-2.0",
    "S41": "SPDX-License-Identifier: GPL-2.0-only",
    "S42": "SPDX-License-Identifier: GPL-2.0-or-later",
    "S43": "SPDX-License-Identifier: GPL-3.0-only",
    "S44": "SPDX-License-Identifier: GPL-3.0-or-later",
    "S45": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "S46": "SPDX-License-Identifier: AGPL-3.0-only",
    "S47": "SPDX-License-Identifier: BSD-2-Clause",
    "S48": "SPDX-License-Identifier: BSD-3-Clause",
    "S49": "SPDX-License-Identifier: MPL-2.0",
    "S50": "SPDX-License-Identifier: EPL-2.0",
    "S51": "SPDX-License-Identifier: ISC",
    "S52": "SPDX-License-Identifier: Unlicense",
    "S53": "SPDX-License-Identifier: CC0-1.0",
    "S54": "SPDX-License-Identifier: CC-BY-4.0",
}
# Rule, licence, class and its sentences in order. A rule that matched hides the later ones whose sentences
# all stand among its own in the same order.
RULES = [
    ("mit-text", "MIT", "permissive", ["S01", "S02", "S03"]),
    ("apache-2.0-header", "Apache-2.0", "permissive", ["S07", "S08", "S09", "S10"]),
    ("gpl-3.0-header", "GPL-3.0-or-later", "copyleft", ["S12", "S13", "S14"]),
    ("gpl-2.0-header", "GPL-2.0-or-later", "copyleft", ["S26", "S13", "S14"]),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", "copyleft", ["S27", "S28", "S29"]),
    ("agpl-3.0-header", "AGPL-3.0-or-later", "copyleft", ["S30", "S13", "S31"]),
    ("bsd-3-clause-text", "BSD-3-Clause", "permissive", ["S15", "S16", "S17", "S18"]),
    ("bsd-2-clause-text", "BSD-2-Clause", "permissive", ["S15", "S16", "S17"]),
    ("zlib-text", "Zlib", "permissive", ["S36", "S37", "S38"]),
    ("isc-text", "ISC", "permissive", ["S24"]),
    ("unlicense", "Unlicense", "permissive", ["S32"]),
    ("epl-2.0-notice", "EPL-2.0", "copyleft", ["S33"]),
    ("mpl-2.0-notice", "MPL-2.0", "copyleft", ["S23"]),
    ("apache-2.0-notice", "Apache-2.0", "permissive", ["S06"]),
    ("mit-released", "MIT", "permissive", ["S04"]),
    ("mit-licensed", "MIT", "permissive", ["S05"]),
    ("gpl-3.0-work", "GPL-3.0-only", "copyleft", ["S11"]),
    ("cc-by-nc-4.0", "CC-BY-NC-4.0", "non-commercial", ["S19"]),
    ("cc-by-sa-4.0", "CC-BY-SA-4.0", "copyleft", ["S21"]),
    ("cc-by-4.0", "CC-BY-4.0", "permissive", ["S20"]),
    ("cc-by-sa-4.0-work", "CC-BY-SA-4.0", "copyleft", ["S34"]),
    ("cc-by-nc-4.0-work", "CC-BY-NC-4.0", "non-commercial", ["S35"]),
    ("cc-by-4.0-work", "CC-BY-4.0", "permissive", ["S22"]),
    ("spdx-mit", "MIT", "permissive", ["S39"]),
    ("spdx-apache-2.0", "Apache-2.0", "permissive", ["S40"]),
    ("spdx-gpl-2.0-only", "GPL-2.0-only", "copyleft", ["S41"]),
    ("spdx-gpl-2.0-or-later", "GPL-2.0-or-later", "copyleft", ["S42"]),
    ("spdx-gpl-3.0-only", "GPL-3.0-only", "copyleft", ["S43"]),
    ("spdx-gpl-3.0-or-later", "GPL-3.0-or-later", "copyleft", ["S44"]),
    ("spdx-lgpl-2.1-or-later", "LGPL-2.1-or-later", "copyleft", ["S45"]),
    ("spdx-agpl-3.0-only", "AGPL-3.0-only", "copyleft", ["S46"]),
    ("spdx-bsd-2-clause", "BSD-2-Clause", "permissive", ["S47"]),
    ("spdx-bsd-3-clause", "BSD-3-Clause", "permissive", ["S48"]),
    ("spdx-mpl-2.0", "MPL-2.0", "copyleft", ["S49"]),
    ("spdx-epl-2.0", "EPL-2.0", "copyleft", ["S50"]),
    ("spdx-isc", "ISC", "permissive", ["S51"]),
    ("spdx-unlicense", "Unlicense", "permissive", ["S52"]),
    ("spdx-cc0-1.0", "CC0-1.0", "permissive", ["S53"]),
    ("spdx-cc-by-4.0", "CC-BY-4.0", "permissive", ["S54"]),
    ("reserved", "proprietary", "restricted", ["S25"]),
]
#: Every known sentence holds one of these; texts without any are not cut into sentences at all.
CUES = "licen|permission|warrant|redistribut|free software|copyright|rights reserved|public domain|held liable"
#: A sentence that ends where white space follows; in the second reading lines that wrap are one sentence.
BREAKS = {"lines": r"[.!?;:]+[ \t\r\n]+|[\r\n]+", "wrapped": r"[.!?;:]+[ \t\r\n]+|[\r\n][ \t\r]*[\r\n]+"}


def known_parts() -> dict[str, list[str]]:
    """Identifier to the normalised parts into which either reading cuts its sentence: one, or more if it has a mark inside."""
    parts = {k: [re.sub("[^a-z0-9]+", " ", x).strip() for x in re.split(BREAKS["lines"], s.lower())] for k, s in SENTENCES.items()}
    return {k: [x for x in v if x] for k, v in parts.items()}


def part_names() -> dict[str, str]:
    """Each distinct part to its name, all of one length, so that names joined by commas can be searched as text."""
    return {x: f"P{i:03d}" for i, x in enumerate(dict.fromkeys(x for v in known_parts().values() for x in v))}


def sentence_names() -> list[tuple[str, str]]:
    """The parts' names of each sentence with the sentence's identifier; sentences of more parts come first."""
    names = part_names()
    return sorted(((",".join(names[x] for x in v), k) for k, v in known_parts().items()), key=lambda x: (-len(x[0]), x[1]))


def hidden_by(rule: int) -> list[int]:
    """The earlier rules whose sentences hold those of a rule in the same order."""

    def within(few: list[str], many: list[str]) -> bool:
        rest = iter(many)
        return all(x in rest for x in few)

    return [i for i in range(rule) if within(RULES[rule][3], RULES[i][3])]


def _texts(values: Iterable[str]) -> Column:
    """A constant array, parsed at once: that takes far less time than a column for each value."""
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")")


def _named(text: Column, breaks: str) -> Column:
    """Names of the known parts among a text's sentences, in order, joined by commas; - for any other sentence."""
    names = F.map_from_arrays(_texts(part_names()), _texts(part_names().values()))
    sentences = F.split(F.regexp_replace(F.concat(text, F.lit("\n")), breaks, "\u0001"), "\u0001")
    plain = F.filter(F.transform(sentences, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))), lambda s: s != "")
    return F.array_join(F.transform(plain, lambda s: F.coalesce(F.try_element_at(names, s), F.lit("-"))), ",")


def _ids(named: Column) -> Column:
    """The sentences that the parts of _named() make up where they follow each other."""
    parts, ids = zip(*sentence_names(), strict=True)
    known = F.arrays_zip(_texts(parts).alias("parts"), _texts(ids).alias("k"))
    found = F.aggregate(known, named, lambda text, s: F.replace(text, s["parts"], s["k"]))
    return F.when(named.contains("P"), F.array_join(F.filter(F.split(found, ","), lambda s: s.startswith("S")), ",")).otherwise("")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_sentences (int), sentence_ids, rules, licenses, license_class (strings).

    sentence_ids lists the known sentences in text order, from the reading (lines or wrapped) that
    recognises more; on a tie, lines. rules, licenses and classes are comma-joined in rule order without
    repeats; a rule that matched hides those that are part of it. Null and empty texts, and texts without licence
    sentences, give 0 and empty strings; a text of any length is read whole, in time in proportion to it; repeated
    rows give repeated rows; an empty table gives an empty result; other columns of `docs` are ignored.
    """
    low = F.when(F.col("t").rlike(f"(?i){CUES}"), ascii_lower(F.col("t"))).otherwise(F.lit(""))
    out = docs.select(F.col(id_col).alias("i"), whole(F.col(text_col)).alias("t")).select("i", low.alias("t"))
    blank = F.col("t") == ""
    out = out.select("i", *[F.when(blank, "").otherwise(_named(F.col("t"), p)).alias(k) for k, p in BREAKS.items()])
    out = out.select("i", *[_ids(F.col(k)).alias(k) for k in BREAKS])
    out = out.select("i", F.when(F.length("wrapped") > F.length("lines"), F.col("wrapped")).otherwise(F.col("lines")).alias("s"))
    # Each rule's sentences are looked for once, one after the other; atomic groups keep the engine from going back.
    patterns = ["^" + "".join(f"(?>.*?{k},)" for k in r[3]) for r in RULES]
    found = F.expr("array(" + ", ".join(f"concat(s, ',') rlike '{p}'" for p in patterns) + ")")
    hidden = F.expr("array(" + ", ".join(f"cast(array({', '.join(map(str, hidden_by(i)))}) as array<int>)" for i in range(len(RULES))) + ")")
    names = F.arrays_zip(*[_texts(r[k] for r in RULES).alias(f"c{k}") for k in range(3)])
    hits = F.filter(F.transform(names, lambda r, i: F.when(F.get("m", i) & ~F.exists(F.get(hidden, i), lambda h: F.get("m", h)), r)), lambda r: r.isNotNull())
    out = out.select("i", "s", F.when(F.col("s") == "", F.array().cast("array<boolean>")).otherwise(found).alias("m"))
    out = out.select("i", "s", F.when(F.col("s") != "", hits).alias("r"))
    listed = lambda k: F.when(F.col("s") == "", "").otherwise(F.array_join(F.array_distinct(F.transform("r", lambda r: r[f"c{k}"])), ","))
    n = F.when(F.col("s") == "", 0).otherwise(F.size(F.split("s", ",")))
    return out.select(F.col("i").alias(id_col), n.cast("int").alias("n_sentences"), F.col("s").alias("sentence_ids"), listed(0).alias("rules"), listed(1).alias("licenses"), listed(2).alias("license_class"))


def licenses_sql() -> str:
    """The same in DuckDB, over its view of documents."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    names = "map {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in part_names().items()) + "}"

    def seq(breaks: str) -> str:
        cut = f"list_filter(list_transform(string_split(regexp_replace(t || chr(10), {q(breaks)}, chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '')"
        found = f"array_to_string(list_transform({cut}, lambda s: coalesce({names}[s], '-')), ',')"
        for parts, k in sentence_names():
            found = f"replace({found}, {q(parts)}, {q(k)})"
        return f"array_to_string(list_filter(string_split({found}, ','), lambda s: starts_with(s, 'S')), ',')"

    match = ", ".join(f"regexp_matches(s || ',', {q('.*'.join(k + ',' for k in r[3]))})" for r in RULES)
    hits = ", ".join(f"CASE WHEN m[{i + 1}]{''.join(f' AND NOT m[{h + 1}]' for h in hidden_by(i))} THEN {i} END" for i in range(len(RULES)))
    listed = lambda k: f"CASE WHEN s = '' THEN '' ELSE array_to_string(list_transform(list_filter(list_transform(h, lambda x, i: CASE WHEN list_position(list_transform(h, lambda y: [{', '.join(q(r[k]) for r in RULES)}][y + 1]), [{', '.join(q(r[k]) for r in RULES)}][x + 1]) = i THEN x END), lambda x: x IS NOT NULL), lambda x: [{', '.join(q(r[k]) for r in RULES)}][x + 1]), ',') END"
    return f"""
WITH a AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '(?i){CUES}') THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS t FROM documents),
b AS (SELECT doc_id, {', '.join(f"CASE WHEN t = '' THEN '' ELSE {seq(p)} END AS {k}" for k, p in BREAKS.items())} FROM a),
c AS (SELECT doc_id, CASE WHEN length(wrapped) > length(lines) THEN wrapped ELSE lines END AS s FROM b),
d AS (SELECT doc_id, s, CASE WHEN s = '' THEN [] ELSE [{match}] END AS m FROM c),
e AS (SELECT doc_id, s, CASE WHEN s = '' THEN [] ELSE list_filter([{hits}], lambda x: x IS NOT NULL) END AS h FROM d)
SELECT doc_id, (CASE WHEN s = '' THEN 0 ELSE len(string_split(s, ',')) END)::INTEGER AS n_sentences, s AS sentence_ids,
  {listed(0)} AS rules, {listed(1)} AS licenses, {listed(2)} AS license_class FROM e"""

"""Licences by rules over sequences of known sentences (operator 5).

A text is cut into sentences at stops followed by white space. A sentence may be wrapped: each run of at most LINES
of its lines, joined, is normalised to lower-case ASCII letters and digits with single spaces (which takes comment
marks away too) and looked up among known licence sentences; from each line on, the longest run that is known counts.
Only whole known sentences match. The identifiers found, in order, make a sequence; a licence is recognised if the
identifiers of one of its rules come in the rule's order in it, other known sentences in between allowed. All of it is
one projection: no shuffle, no Python. Runs begin only at lines whose first words begin a known sentence. Tags
are read as expressions: each identifier that AND and OR join is a sentence of its own, an exception after WITH names no
licence, a plus means "or later". Notices that name a licence are known by what they say it of and how, put in one way.

Defined results: null and empty texts, and texts without a known sentence, have an empty sequence and no licence;
repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of licences and of their notices, by identifier.
SENTENCES = {
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "apache-title": "Apache License Version 2.0, January 2004",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit0-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-free": "This program is free software",
    "gpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl3-only-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version",
    "gpl2-only-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2",
    "gpl2-only-version": "version 2 of the License",
    "gpl3-version": "either version 3 of the License, or (at your option) any later version",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-merchant": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program",
    "lgpl-free": "This library is free software",
    "lgpl21-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl21-version": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl-title": "Mozilla Public License Version 2.0",
    "epl-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-title": "Eclipse Public License - v 2.0",
    "bsl-header": "Distributed under the Boost Software License, Version 1.0",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-origin": "The origin of this software must not be misrepresented",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "artistic-title": "The Artistic License 2.0",
    "cc0-waive": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc0-title": "CC0 1.0 Universal",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
}
# Rules, each a licence and the identifiers it takes in order.
RULES = [
    ("0BSD", ["0bsd-grant", "isc-as-is"]),
    ("AGPL-3.0", ["agpl3-title"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute"]),
    ("Apache-2.0", ["apache-header"]),
    ("Apache-2.0", ["apache-comply", "apache-copy", "apache-as-is"]),
    ("Apache-2.0", ["apache-title"]),
    ("Artistic-2.0", ["artistic-title"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-4-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse"]),
    ("BSL-1.0", ["bsl-header"]),
    ("BSL-1.0", ["bsl-title"]),
    ("CC0-1.0", ["cc0-title"]),
    ("CC0-1.0", ["cc0-waive"]),
    ("EPL-2.0", ["epl-header"]),
    ("EPL-2.0", ["epl-title"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("GPL-2.0-only", ["gpl-redistribute", "gpl2-only-version"]),
    ("GPL-2.0-only", ["gpl2-only-redistribute"]),
    ("GPL-2.0-or-later", ["gpl-redistribute", "gpl2-version"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("GPL-3.0", ["gpl3-work"]),
    ("GPL-3.0-only", ["gpl3-only-redistribute"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "gpl3-version"]),
    ("GPL-3.0-or-later", ["gpl3-redistribute"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("ISC", ["isc-grant-and", "isc-as-is"]),
    ("LGPL-2.1", ["lgpl21-title"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute", "lgpl21-version"]),
    ("LGPL-3.0", ["lgpl3-title"]),
    ("LGPL-3.0-or-later", ["lgpl3-redistribute"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT-0", ["mit0-grant", "mit-as-is"]),
    ("MPL-2.0", ["mpl-header"]),
    ("MPL-2.0", ["mpl-title"]),
    ("Unlicense", ["unlicense"]),
    ("WTFPL", ["wtfpl-title"]),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant", "zlib-origin"]),
]
# Names of licences in notices of one sentence, by identifier; those without names are known by their tag.
NAMES = {
    "0BSD": ["BSD Zero Clause License", "0BSD license"],
    "AFL-3.0": ["Academic Free License 3.0", "Academic Free License version 3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPLv3", "AGPLv3", "AGPL-3.0 license"],
    "AGPL-3.0-only": [],
    "AGPL-3.0-or-later": [],
    "Apache-1.1": ["Apache License, Version 1.1", "Apache Software License 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache 2.0", "Apache 2.0 License", "Apache License v2.0", "Apache License (Version 2.0)"],
    "Artistic-1.0": ["Artistic License 1.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause license"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause license"],
    "BSD-4-Clause": [],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "BlueOak-1.0.0": ["Blue Oak Model License 1.0.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0", "Common Development and Distribution License, Version 1.0", "CDDL 1.0"],
    "CDDL-1.1": ["Common Development and Distribution License 1.1", "CDDL 1.1"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License, version 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, version 2.0"],
    "EUPL-1.1": ["European Union Public Licence 1.1", "EUPL v1.1", "EUPL 1.1"],
    "EUPL-1.2": ["European Union Public Licence 1.2", "European Union Public License 1.2", "EUPL v1.2", "EUPL 1.2"],
    "GFDL-1.2": ["GNU Free Documentation License, Version 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License, Version 1.3"],
    "GPL-1.0": [],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPLv2", "GNU GPL v2", "GPLv2", "GPL v2", "GPL-2.0 license"],
    "GPL-2.0-only": [],
    "GPL-2.0-or-later": ["GNU General Public License, version 2 or later", "GPLv2 or later"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPLv3", "GNU GPL v3", "GPLv3", "GPL v3", "GPL-3.0 license"],
    "GPL-3.0-only": [],
    "GPL-3.0-or-later": ["GNU General Public License, version 3 or later", "GPLv3 or later"],
    "ISC": ["ISC License", "ISC"],
    "LGPL-2.0": ["GNU Library General Public License, version 2", "GNU Lesser General Public License, version 2"],
    "LGPL-2.0-only": [],
    "LGPL-2.0-or-later": [],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL v2.1"],
    "LGPL-2.1-only": [],
    "LGPL-2.1-or-later": [],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3", "LGPL v3"],
    "LGPL-3.0-only": [],
    "LGPL-3.0-or-later": [],
    "LPPL-1.3c": ["LaTeX Project Public License 1.3c", "LaTeX Project Public License, version 1.3c", "LPPL 1.3c"],
    "MIT": ["MIT License", "MIT", "MIT license terms", "Expat License"],
    "MIT-0": ["MIT No Attribution License", "MIT-0 license"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, version 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License v2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
    "MS-PL": ["Microsoft Public License", "Microsoft Public License (Ms-PL)"],
    "MS-RL": ["Microsoft Reciprocal License"],
    "MulanPSL-2.0": ["Mulan PSL v2", "Mulan Permissive Software License, Version 2"],
    "NCSA": ["University of Illinois/NCSA Open Source License"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "SIL OFL 1.1", "Open Font License 1.1"],
    "OSL-3.0": ["Open Software License 3.0", "Open Software License version 3.0"],
    "PostgreSQL": ["PostgreSQL License"],
    "PSF-2.0": ["Python Software Foundation License", "Python Software Foundation License Version 2", "PSF License"],
    "UPL-1.0": ["Universal Permissive License, Version 1.0", "Universal Permissive License 1.0"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "WTFPL": ["WTFPL"],
    "Zlib": ["zlib License", "zlib/libpng License"],
}
# Parts of the names of one family, and its versions with the words that may follow.
CC_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
CC_KINDS = ["BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"]
CC_VERSIONS = {"2.0": ["Generic"], "2.5": ["Generic"], "3.0": ["Unported"], "4.0": ["International"]}
# What is licensed, and how a notice says so.
THINGS = ["work", "project", "software", "file", "code", "program", "library", "package", "repository", "document", "documentation", "font", "material", "module", "tool"]
WAYS = ["licensed", "released", "distributed", "available", "published", "provided", "made available"]
#: A stop counts before white space only. Longest run of lines that is one sentence.
ENDS, LINES = r"[.;:!?]+\s+|[.;:!?]+$|\n[ \t\r]*\n", 16
# What is taken out before cutting: line comments by words; stops that end no sentence.
WORDS_BEFORE = (r"(?m)^[ \t]*(?:dnl|REM|rem)[ \t]+", "")
ABBREVIATED = (r"\b([vV])\.[ \t\r\n]+([0-9])", "{1} {2}")
# Expressions of tags: "or later" as a mark, exceptions, and what AND and OR join; each that is joined gets a tag of its own.
PLUS = (r"\b((?:A|L)?GPL-[0-9]\.[0-9])\+", "{1}-or-later")
EXCEPTED = (r"(SPDX-License-Identifier:[^\n]*?)[ \t]+(?:WITH|with)[ \t]+[A-Za-z0-9.-]+", "{1}")
JOINED = (r"(SPDX-License-Identifier:)([^\n]*?)[ \t]+(?:AND|OR|and|or)[ \t]+", "{1}{2}\n\n{1} ")
TAGGED = (r"SPDX-License-Identifier:[ \t]*", "SPDX-License-Identifier ")
HEADED = (r"(?m)^([^A-Za-z\n]*)[Ll]icen[cs]e:[ \t]+", "{1}License is ")
REFERRED = (r"[ \t]*\((?:see|cf\.?|the file)\b[^()\n]*\)", "")
#: Operators of an expression that are taken apart, and exceptions, one a pass.
OPERATORS = 4
BEFORE = (WORDS_BEFORE, ABBREVIATED, PLUS, *[EXCEPTED] * OPERATORS, *[JOINED] * OPERATORS, TAGGED, HEADED, REFERRED)
# What normalised sentences leave out or say in one way: an item's number, who is named.
NUMBERED = (r"^[0-9]{1,2} ", "")
NAMED = (r"^neither the names? of .{1,160} nor the names of (?:its|their|any) contributors", "neither the name of the copyright holder nor the names of its contributors")
SAID = (rf"^(?:this (?:{'|'.join(THINGS)}) is )?(?:{'|'.join(WAYS)}) under (?:the terms of )?(?:(?:the|a|an) )?", "licensed under ")
FIRST = "^[^a-z0-9]*(?:[0-9]{1,2}[^a-z0-9]+)?([a-z0-9]+)(?:[^a-z0-9]+([a-z0-9]+))?"


def normal(sentence: str) -> str:
    return re.sub(*SAID, re.sub(*NAMED, re.sub(*NUMBERED, re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" "))))


def all_names() -> dict[str, list[str]]:
    """NAMES and those of the family that has a rule for its names."""
    out = dict(NAMES)
    for kind in CC_KINDS:
        for version, after in CC_VERSIONS.items():
            long = f"Creative Commons {'-'.join(CC_PARTS[p] for p in kind.split('-'))}"
            longs = {long, long.replace("NoDerivatives", "NoDerivs")}
            names = [f"{n} {v}{a}{end}" for n in sorted(longs) for v in (version,) for a in ("", *(f" {x}" for x in after)) for end in ("", " License")]
            out[f"CC-{kind}-{version}"] = [f"CC {kind} {version}", f"CC {kind} {version} license", *names]
    return out


def named() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Sentences and rules of notices that name a licence, and of its tag."""
    sentences, rules = {}, []
    for licence, names in all_names().items():
        own = [f"SPDX-License-Identifier {licence}", f"License is {licence}", *(f"Licensed under {n}" for n in names), *(f"License is {n}" for n in names)]
        for k, s in enumerate(own):
            sentences[f"{licence.lower()}-named-{k}"] = s
            rules.append((licence, [f"{licence.lower()}-named-{k}"]))
    return sentences, rules


def known(sentences: dict[str, str]) -> dict[str, str]:
    """Normalised text to identifier, one each."""
    out: dict[str, str] = {}
    for i, s in sentences.items():
        cut = re.sub(ABBREVIATED[0], r"\1 \2", s)
        if re.search(ENDS, cut):
            raise ValueError(f"{i} is more than one sentence")
        out.setdefault(normal(cut), i)
    return out


def starts(normalised: dict[str, str]) -> list[str]:
    """First two words of known sentences, and the first alone (for lines of one word)."""
    said = [f"{w} under" for w in WAYS] + [f"this {t} is" for t in THINGS]
    return sorted({" ".join(n.split()[:k]) for n in (*normalised, *said) for k in (1, 2)})


def pattern(rule: list[str]) -> str:
    """Of a sequence written ",a,b,c,": the rule's identifiers in order."""
    return "," + ",(?:[a-z0-9.-]+,)*".join(i.replace(".", "[.]") for i in rule) + ","


def _normal(c: Column) -> Column:
    for a, b in (("[^a-z0-9]+", " "), ("^ | $", ""), NUMBERED, NAMED, SAID):
        c = F.regexp_replace(F.lower(c) if b == " " else c, a, b)
    return c


def _first(c: Column) -> Column:
    low = F.lower(c)
    return F.rtrim(F.concat(F.regexp_extract(low, FIRST, 1), F.lit(" "), F.regexp_extract(low, FIRST, 2)))


def all_rules() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    sentences, rules = named()
    return SENTENCES | sentences, RULES + rules


def by_identifier(rules: list[tuple[str, list[str]]]) -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Rules of one identifier, as a map, and the others."""
    return {r[0]: name for name, r in rules if len(r) == 1}, [(name, r) for name, r in rules if len(r) > 1]


def recognise(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """doc_id, sentence_ids (in order, by comma) and licences (sorted, by comma). One row per document."""
    sentences, rules = sentences or all_rules()[0], rules or all_rules()[1]
    normalised = known(sentences)
    table = F.create_map(*[F.lit(x) for pair in normalised.items() for x in pair])
    first = starts(normalised)
    text = F.coalesce("text", F.lit(""))
    for a, b in BEFORE:
        text = F.regexp_replace(text, a, b.format("", "$1", "$2"))

    def runs(lines: Column) -> Column:
        at = F.filter(F.transform(lines, lambda x, i: F.when(_first(x).isin(first), i)), lambda i: i.isNotNull())
        # Of each line where one may begin, the longest run that is known.
        longest = lambda i: F.aggregate(
            F.sequence(F.lit(1), F.least(F.lit(LINES), F.size(lines) - i)),
            F.lit(None).cast("string"),
            lambda best, n: F.coalesce(F.try_element_at(table, _normal(F.array_join(F.slice(lines, i + 1, n), " "))), best),
        )
        return F.transform(at, longest)

    # The lines of a sentence are named before they are used, so that they are cut once.
    cut = F.transform(F.split(text, ENDS), lambda s: F.split(s, r"\n"))
    found = F.filter(F.flatten(F.transform(cut, runs)), lambda i: i.isNotNull())
    out = docs.select("doc_id", F.array_join(found, ",").alias("sentence_ids"))
    single, others = by_identifier(rules)
    sequence = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    alone = F.transform(F.split("sentence_ids", ","), lambda i: F.try_element_at(F.create_map(*[F.lit(x) for pair in single.items() for x in pair]), i)) if single else F.array().cast("array<string>")
    hits = F.concat(alone, F.array(*[F.when(sequence.rlike(pattern(r)), F.lit(name)) for name, r in others]).cast("array<string>"))
    licences = F.when(F.col("sentence_ids") == "", "").otherwise(F.array_join(F.array_sort(F.array_distinct(F.array_compact(hits))), ","))
    return out.select("doc_id", "sentence_ids", licences.alias("licences"))


def sql() -> str:
    sentences, rules = all_rules()
    quote = lambda x: x.replace("'", "''")
    normalised = known(sentences)
    values = ", ".join(f"('{n}', '{i}')" for n, i in normalised.items())
    single, others = by_identifier(rules)
    alone = ", ".join(f"('{i}', '{name}')" for i, name in single.items())
    rows = ", ".join(f"('{name}', '{pattern(r)}')" for name, r in others)
    text = "coalesce(text, '')"
    for a, b in BEFORE:
        text = f"regexp_replace({text}, '{quote(a)}', '{b.format('', chr(92) + '1', chr(92) + '2')}', 'g')"
    norm = "regexp_replace(regexp_replace(lower(%s), '[^a-z0-9]+', ' ', 'g'), '^ | $', '', 'g')"
    for a, b in (NUMBERED, NAMED, SAID):
        norm = f"regexp_replace({norm}, '{a}', '{b}')"
    return f"""
    WITH known(normal, id) AS (VALUES {values}),
    alone(id, licence) AS (VALUES {alone}),
    rules(licence, pattern) AS (VALUES {rows}),
    docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    cut AS (SELECT r, unnest(regexp_split_to_array(t, '{ENDS}')) AS s, generate_subscripts(regexp_split_to_array(t, '{ENDS}'), 1) AS p FROM (SELECT r, {text} AS t FROM docs)),
    lines AS (SELECT r, p, string_split(s, chr(10)) AS ls, generate_subscripts(string_split(s, chr(10)), 1) AS i FROM cut),
    runs AS (SELECT r, p, i, n, array_to_string(ls[i : i + n - 1], ' ') AS t FROM (SELECT *, unnest(range(1, least({LINES}, len(ls) - i + 1) + 1)) AS n FROM lines
      WHERE rtrim(regexp_extract(lower(ls[i]), '{FIRST}', 1) || ' ' || regexp_extract(lower(ls[i]), '{FIRST}', 2)) IN ({", ".join(f"'{x}'" for x in starts(normalised))}))),
    found AS (SELECT r, p, i, max_by(id, n) AS id FROM runs JOIN known ON {norm % "t"} = normal GROUP BY ALL),
    seqs AS (SELECT r, string_agg(id, ',' ORDER BY p, i) AS ids FROM found GROUP BY r),
    hits AS (SELECT r, licence FROM found JOIN alone USING (id) UNION SELECT r, licence FROM seqs JOIN rules ON regexp_matches(',' || ids || ',', pattern)),
    named AS (SELECT r, string_agg(licence, ',' ORDER BY licence) AS licences FROM hits GROUP BY r)
    SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(licences, '') AS licences FROM docs LEFT JOIN seqs USING (r) LEFT JOIN named USING (r)"""

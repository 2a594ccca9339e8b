"""Licence scans by sentences, in Column expressions only.

A text is normalised (ASCII letters in lower case, all else but sentence ends a space) and cut into sentences, once at
line ends as well and once across them, since notices are often wrapped. Stops, colons and semicolons
before a space end a sentence, so no known one holds any. Known sentences become
identifiers, all others vanish. A licence is found if its rule, an ordered list of identifiers, is a subsequence
of one of the two identifier sequences. Texts without any word that all known sentences need are not cut at all.

Known are notices, titles, grants and conditions of some forty public licences, and their identifiers in tags of source files, one licence a tag
(of "A OR B" neither). A text with known sentences, but without a licence, holds a part of one. An empty table gives no rows; texts of any length are
scanned whole.

A NULL or empty text has no sentences and no licences: empty arrays. Repeated sentences give repeated
identifiers and one licence. Rows are judged one by one; columns named like the added ones are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import text_or_empty, without

# Sentences of public licences and of their notices, as written.
SENTENCES = {
    "apache2.notice": "Licensed under the Apache License, Version 2.0",
    "apache2.notice_the": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache2.not_use": "you may not use this file except in compliance with the License",
    "apache2.as_is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "mit.notice": "Released under the MIT License",
    "mit.notice_licensed": "Licensed under the MIT License",
    "mit.title": "The MIT License (MIT)",
    "mit.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit.copies": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit.as_is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd.endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3.notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl.program": "This program is free software",
    "gpl.3_later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl.2_notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl.2_later": "either version 2 of the License, or (at your option) any later version",
    "lgpl.notice": "This library is free software",
    "lgpl.terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl2.terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "ccbync4.notice": "Licensed under CC BY-NC 4.0",
    "ccby4.notice": "Licensed under CC BY 4.0",
    "ccbysa4.notice": "Licensed under CC BY-SA 4.0",
    "ccby4.work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0.notice": "This work is dedicated to the public domain under the CC0 1.0 Universal License",
    "apache2.title": "Apache License",
    "apache2.version": "Version 2.0, January 2004",
    "mit0.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "0bsd.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "bsd.advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "gpl.title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl.title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl.title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "gpl.v2": "Version 2, June 1991",
    "lgpl.v21": "Version 2.1, February 1999",
    "gpl.v3": "Version 3, 29 June 2007",
    "agpl.v3": "Version 3, 19 November 2007",
    "lgpl.21_later": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl.3_later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl.3_later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl2.title": "Mozilla Public License Version 2.0",
    "epl2.terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https",
    "epl2.terms_http": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http",
    "bsl1.notice": "Distributed under the Boost Software License, Version 1.0",
    "bsl1.title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "zlib.as_is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib.grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense.title": "This is free and unencumbered software released into the public domain",
    "wtfpl.title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
}

# A licence and the sentences that show it, in their order; each list is one way to show it.
RULES = [
    ("Apache-2.0", ["apache2.notice"]),
    ("Apache-2.0", ["apache2.notice_the", "apache2.not_use", "apache2.as_is"]),
    ("Apache-2.0", ["apache2.notice_the", "apache2.as_is"]),
    ("MIT", ["mit.notice"]),
    ("MIT", ["mit.notice_licensed"]),
    ("MIT", ["mit.title", "mit.grant"]),
    ("MIT", ["mit.grant", "mit.copies"]),
    ("MIT", ["mit.grant", "mit.as_is"]),
    ("ISC", ["isc.grant"]),
    ("BSD-3-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse"]),
    ("BSD-2-Clause", ["bsd.grant", "bsd.source", "bsd.binary"]),
    ("GPL-3.0", ["gpl3.notice"]),
    ("GPL-3.0-or-later", ["gpl.program", "gpl.3_later"]),
    ("GPL-2.0-or-later", ["gpl.2_notice", "gpl.2_later"]),
    ("LGPL", ["lgpl.notice", "lgpl.terms"]),
    ("MPL-2.0", ["mpl2.terms"]),
    ("CC-BY-NC-4.0", ["ccbync4.notice"]),
    ("CC-BY-4.0", ["ccby4.notice"]),
    ("CC-BY-4.0", ["ccby4.work"]),
    ("CC-BY-SA-4.0", ["ccbysa4.notice"]),
    ("CC0-1.0", ["cc0.notice"]),
    ("Apache-2.0", ["apache2.notice_the"]),
    ("Apache-2.0", ["apache2.title", "apache2.version"]),
    ("MIT-0", ["mit0.grant"]),
    ("0BSD", ["0bsd.grant"]),
    ("BSD-4-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.advert"]),
    ("GPL-2.0", ["gpl.title", "gpl.v2"]),
    ("GPL-3.0", ["gpl.title", "gpl.v3"]),
    ("LGPL-2.1", ["lgpl.title", "lgpl.v21"]),
    ("LGPL-3.0", ["lgpl.title", "gpl.v3"]),
    ("AGPL-3.0", ["agpl.title", "agpl.v3"]),
    ("LGPL-2.1-or-later", ["lgpl.terms", "lgpl.21_later"]),
    ("LGPL-3.0-or-later", ["lgpl.3_later"]),
    ("AGPL-3.0-or-later", ["agpl.3_later"]),
    ("MPL-2.0", ["mpl2.title"]),
    ("EPL-2.0", ["epl2.terms"]),
    ("EPL-2.0", ["epl2.terms_http"]),
    ("BSL-1.0", ["bsl1.notice"]),
    ("BSL-1.0", ["bsl1.title"]),
    ("Zlib", ["zlib.as_is", "zlib.grant"]),
    ("Unlicense", ["unlicense.title"]),
    ("WTFPL", ["wtfpl.title"]),
]
# Found only where the first is not: the longer rule contains the shorter one.
WITHIN = [
    ("BSD-4-Clause", "BSD-3-Clause"),
    ("BSD-4-Clause", "BSD-2-Clause"),
    ("BSD-3-Clause", "BSD-2-Clause"),
    ("LGPL-2.1-or-later", "LGPL"),
]

# Creative Commons licences of two versions, and identifiers of licences as source files carry them.
CC_TERMS = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = {"4.0": "4.0 International", "3.0": "3.0 Unported"}
TAG = "SPDX-License-Identifier"
TAGGED = """0BSD AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0
    CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later
    GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later
    MIT MIT-0 MPL-1.1 MPL-2.0 NCSA OFL-1.1 PostgreSQL PSF-2.0 Unlicense WTFPL Zlib""".split()

# Every known sentence holds one of these.
NEEDED = "(?i)licen|permission|warrant|redistribut|software|version[^a-z0-9]+[23]|advertising"
KEPT = "[^a-z0-9.;:!?\n]+"
LINE_ENDS = "[.;:!?]+ |[.;:!?]*\n"
SENTENCE_ENDS = "[.;:!?]+ "
# The colon of a tag ends no sentence.
TAG_COLON, TAG_KEPT = "(spdx license identifier) ?: ?", "spdx license identifier "


def normalised(sentence: str) -> str:
    """A sentence as the scan sees it, for the table of known ones."""
    clean = re.sub(TAG_COLON, TAG_KEPT, re.sub(KEPT, " ", sentence.lower()))
    return re.sub("[.;:!?]+$", "", clean.strip()).strip()


def _generated() -> dict[str, tuple[str, str]]:
    """Sentences that follow a pattern, by name, with the licence that each shows alone."""
    found = {f"spdx.{name}": (f"{TAG}: {name}", name) for name in TAGGED}
    for terms, words in CC_TERMS.items():
        for version, long in CC_VERSIONS.items():
            key, licence = f"cc-{terms.lower()}-{version}", f"CC-{terms}-{version}"
            found[f"{key}.short"] = f"Licensed under CC {terms} {version}", licence
            found[f"{key}.short_work"] = f"This work is licensed under CC {terms} {version}", licence
            found[f"{key}.work"] = f"This work is licensed under a Creative Commons {words} {long} License", licence
        found[f"cc-{terms.lower()}-4.0.legal"] = f"Creative Commons {words} 4.0 International Public License", f"CC-{terms}-4.0"
    written = {normalised(text) for text in SENTENCES.values()}
    return {name: pair for name, pair in found.items() if normalised(pair[0]) not in written}


for _name, (_text, _licence) in _generated().items():
    SENTENCES[_name] = _text
    RULES.append((_licence, [_name]))

KNOWN = {normalised(text): name for name, text in SENTENCES.items()}
ALONE = {names[0]: licence for licence, names in RULES if len(names) == 1}


def _identifiers(sentences: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    return F.filter(F.transform(sentences, lambda s: F.try_element_at(known, F.regexp_replace(F.trim(s), "[ .;:!?]+$", ""))), lambda i: i.isNotNull())


def rule_expression(names: list[str]) -> str:
    """Of a rule: the regular expression over identifiers, each between bars."""
    return ".*".join(re.escape(f"|{n}|") for n in names)


def _licences(identifiers: Column) -> Column:
    alone = F.create_map(*(F.lit(x) for pair in ALONE.items() for x in pair))
    joined = F.concat(F.lit("|"), F.array_join(identifiers, "||"), F.lit("|"))
    found = [F.when(joined.rlike(rule_expression(names)), F.lit(licence)) for licence, names in RULES if len(names) > 1]
    both = F.concat(F.array(*found), F.transform(identifiers, lambda i: F.try_element_at(alone, i)))
    return F.filter(both, lambda x: x.isNotNull())


def scan_licences(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with sentence_ids (in their order in the text) and licences (sorted, distinct)."""
    raw = text_or_empty(text)
    clean = F.regexp_replace(F.regexp_replace(F.lower(raw), KEPT, " "), TAG_COLON, TAG_KEPT)
    by_line = _identifiers(F.split(clean, LINE_ENDS))
    across = _identifiers(F.split(F.regexp_replace(clean, "\\s+", " "), SENTENCE_ENDS))
    none = F.array().cast("array<string>")
    source = without(df, "sentence_ids", "licences", "__lines", "__across")
    cut = source.withColumns({"__lines": F.when(raw.rlike(NEEDED), by_line), "__across": F.when(raw.rlike(NEEDED), across)})
    # The sequence that knows more of the text; the one by lines if both know as much.
    ids = F.when(F.size("__across") > F.size("__lines"), F.col("__across")).otherwise(F.col("__lines"))
    found = F.array_sort(F.array_union(_licences(F.col("__lines")), _licences(F.col("__across"))))
    for longer, shorter in WITHIN:
        found = F.when(F.array_contains(found, longer), F.array_remove(found, shorter)).otherwise(found)
    return cut.withColumns({"sentence_ids": F.coalesce(ids, none), "licences": F.coalesce(found, none)}).drop("__lines", "__across")


def document_licences(documents: DataFrame) -> DataFrame:
    """One row per document: its licences and sentence identifiers as text, and how many sentences were known."""
    scanned = scan_licences(documents.select("doc_id", text_or_empty().alias("text")))
    return scanned.select(
        "doc_id",
        F.array_join("licences", " ").alias("licences"),
        F.array_join("sentence_ids", " ").alias("sentence_ids"),
        F.size("sentence_ids").cast("bigint").alias("n_known"),
    )

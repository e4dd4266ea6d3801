"""Licence recognition by sentence rules (operator 8), DataFrame functions only.

A text is cut into sentences at line ends and at a full stop, exclamation or question mark
before white space. A sentence in normal form (lower case, runs of other characters than a-z
and 0-9 as one blank) that is a known licence sentence becomes that sentence's identifier, and so
does a run of lines that is one when their ends are blanks: texts are wrapped, and comment marks at
the starts of lines are other characters. The longest known sentence goes first. The
identifiers of a text in their order (unknown sentences between them do not count) are matched against the rules in theirs: a rule takes the
longest run of its sentences that earlier rules left, so a full licence text comes before the
short notices that it contains. All of it happens in the row: documents are not shuffled.

Cases: null and empty texts have no sentences and no licences; a null id is kept; repeated
rows give repeated rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.tables import column, text_of

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "mit-notice": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mit-as-is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "mit-liability": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "mit-ref": ["Released under the MIT License.", "Licensed under the MIT License.", "MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT"],
    "bsd-grant": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "bsd-source": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "bsd-endorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "bsd-2-ref": ["Licensed under the BSD 2-Clause License.", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "bsd-3-ref": ["Licensed under the BSD 3-Clause License.", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "isc-ref": ["ISC License", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "apache-2-ref": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "apache-2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache-2-basis": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl-3-ref": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "gpl-2-ref": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "gpl-3-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2-later": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "gpl-hope": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "gpl-details": ["See the GNU General Public License for more details."],
    "lgpl-3-ref": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "agpl-3-ref": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "mpl-2-ref": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "mpl-2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "unlicense-1": ["This is free and unencumbered software released into the public domain."],
    "unlicense-2": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "cc0-ref": ["Licensed under CC0 1.0.", "Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "cc-by-ref": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa-ref": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc-ref": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-nd-ref": ["Licensed under CC BY-ND 4.0.", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "cc-by-nc-sa-ref": ["Licensed under CC BY-NC-SA 4.0.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "rights": ["All rights reserved."],
}

#: Ordered rules: licence and its sentence identifiers. "a?" may be missing, "a+" may repeat.
RULES = [
    ("MIT", "mit-ref? mit-grant mit-notice? mit-as-is mit-liability?"),
    ("BSD-3-Clause", "bsd-3-ref? bsd-grant bsd-source bsd-binary bsd-endorse"),
    ("BSD-2-Clause", "bsd-2-ref? bsd-grant bsd-source bsd-binary"),
    ("ISC", "isc-ref? isc-grant"),
    ("Apache-2.0", "apache-2-ref+ apache-2-copy? apache-2-basis?"),
    ("GPL-3.0-or-later", "gpl-3-later gpl-hope? gpl-details?"),
    ("GPL-2.0-or-later", "gpl-2-later gpl-hope? gpl-details?"),
    ("GPL-3.0-only", "gpl-3-ref+ gpl-hope? gpl-details?"),
    ("GPL-2.0-only", "gpl-2-ref+ gpl-hope? gpl-details?"),
    ("LGPL-3.0-only", "lgpl-3-ref+"),
    ("AGPL-3.0-only", "agpl-3-ref+"),
    ("MPL-2.0", "mpl-2-ref+ mpl-2-copy?"),
    ("Unlicense", "unlicense-1 unlicense-2?"),
    ("MIT", "mit-ref+"),
    ("BSD-3-Clause", "bsd-3-ref+"),
    ("BSD-2-Clause", "bsd-2-ref+"),
    ("ISC", "isc-ref+"),
    ("CC0-1.0", "cc0-ref+"),
    ("CC-BY-4.0", "cc-by-ref+"),
    ("CC-BY-SA-4.0", "cc-by-sa-ref+"),
    ("CC-BY-NC-4.0", "cc-by-nc-ref+"),
    ("CC-BY-ND-4.0", "cc-by-nd-ref+"),
    ("CC-BY-NC-SA-4.0", "cc-by-nc-sa-ref+"),
    ("LicenseRef-all-rights-reserved", "rights+"),
]

END = r"[.!?][^a-z0-9\s]*\s+"
# No capital is left in a text in lower case, so one can stand for the end of a sentence.
MARK = "E"
OTHER = r"[^a-z0-9\n\rE]+"
GAP = r"[ \n\r]+"


def normal(sentence: str) -> str:
    """Normal form of one known sentence."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def known_sentences(table: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Normal form to identifier."""
    return {normal(s): key for key, variants in (table or SENTENCES).items() for s in variants}


def rule_pattern(rule: str) -> str:
    """A rule as a pattern over identifiers, each written as ``[identifier]``."""
    parts = []
    for word in rule.split():
        name, sign = (word[:-1], word[-1]) if word[-1] in "?+" else (word, "")
        parts.append(rf"(?:\[{name}\]){sign}")
    return "".join(parts)


def sentence_pattern(known: dict[str, str]) -> str:
    """The known sentences between ends of sentences or lines, longest first, over line ends inside."""
    ordered = sorted(known, key=lambda s: (-len(s), s))
    return rf"(?:^|[\n\rE]) ?({'|'.join(s.replace(' ', GAP) for s in ordered)})(?= ?(?:[\n\rE]|\z))"


def sentences(text: Column, known: dict[str, str]) -> Column:
    """Known sentences of a text in normal form, in order."""
    cut = F.regexp_replace(F.lower(text), END, MARK)
    found = F.regexp_extract_all(F.regexp_replace(cut, OTHER, " "), F.lit(sentence_pattern(known)), F.lit(1))
    return F.transform(found, lambda s: F.regexp_replace(s, GAP, " "))


def recognise(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    table: dict[str, list[str]] | None = None,
    rules: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``sentence_ids`` and ``licences``, both in text order."""
    known = known_sentences(table)
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    ids = F.transform(sentences(text_of(docs, text_col), known), lambda s: F.try_element_at(names, s))
    found = docs.select(column(docs, id_col).alias("doc_id"), ids.alias("sentence_ids"))
    marked = F.transform("sentence_ids", lambda s: F.concat(F.lit("["), s, F.lit("]")))
    matched = F.array_join(marked, "")
    for licence, rule in rules or RULES:
        matched = F.regexp_replace(matched, rule_pattern(rule), f"<{licence}>")
    return found.select("doc_id", "sentence_ids", F.regexp_extract_all(matched, F.lit("<([^>]+)>"), F.lit(1)).alias("licences"))

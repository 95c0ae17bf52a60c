"""Licence recognition by sentence identifiers and ordered rules over their sequence.

A text is normalised (A-Z lower-cased, every run of other characters than a-z 0-9 one space), so that line ends, comment
marks and quotes do not matter, and known licence sentences in it, at whole words, become one-letter identifiers, the
leftmost first and of those the longest. A document is then the string of its identifiers, in order. Rules are identifier
sequences, longest first; matches are taken from the left and do not overlap. Everything is DataFrame operations, row by
row: no shuffle at all.

Null or empty text: no identifiers and no licences, empty strings. Very long texts are scanned whole. Repeated rows are
scanned alike; equal sentences count each time. Ties cannot arise: sentences of equal length differ. Columns besides
doc_id and text are not read. Empty input: no rows.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Licence sentences as normalised text, by identifier.
SENTENCES = {
    "a": "licensed under the apache license version 2 0",
    "b": "licensed under the apache license version 2 0 the license",
    "c": "you may not use this file except in compliance with the license",
    "d": "you may obtain a copy of the license at",
    "e": "released under the mit license",
    "f": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "g": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "h": "this work is licensed under the gnu general public license version 3",
    "i": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "j": "you should have received a copy of the gnu general public license along with this program",
    "k": "licensed under cc by nc 4 0",
    "l": "licensed under cc by 4 0",
    "m": "licensed under cc by sa 4 0",
    "n": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "o": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "p": "this work is licensed under a creative commons attribution 4 0 international license",
    "q": "all rights reserved",
    "r": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "s": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "t": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "u": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "v": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "w": "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "x": "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "y": "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "z": "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "A": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    "B": "this is free and unencumbered software released into the public domain",
    "C": "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "D": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "E": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "F": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "G": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}

# Identifiers of licences in "SPDX-License-Identifier: ..." lines.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
    "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
_SPDX = {chr(0xC0 + i): name for i, name in enumerate(SPDX)}
SENTENCES |= {k: "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower()) for k, name in _SPDX.items()}

# Rules in order, (identifiers, licence). Of two rules that match at a place, the first one counts.
RULES = (
    ("nrso", "BSD-3-Clause"),
    ("bcd", "Apache-2.0"),
    ("nrs", "BSD-2-Clause"),
    ("ij", "GPL-3.0-or-later"),
    ("Cj", "GPL-3.0-or-later"),
    ("zj", "GPL-2.0-or-later"),
    ("no", "BSD-3-Clause"),
    ("fg", "MIT"),
    ("uv", "MPL-2.0"),
    ("bc", "Apache-2.0"),
    ("cd", "Apache-2.0"),
    ("a", "Apache-2.0"),
    ("b", "Apache-2.0"),
    ("e", "MIT"),
    ("f", "MIT"),
    ("h", "GPL-3.0-only"),
    ("i", "GPL-3.0-or-later"),
    ("k", "CC-BY-NC-4.0"),
    ("l", "CC-BY-4.0"),
    ("m", "CC-BY-SA-4.0"),
    ("p", "CC-BY-4.0"),
    ("n", "BSD-2-Clause"),
    ("t", "ISC"),
    ("u", "MPL-2.0"),
    ("w", "LGPL-2.1-or-later"),
    ("x", "LGPL-3.0-or-later"),
    ("y", "AGPL-3.0-or-later"),
    ("z", "GPL-2.0-or-later"),
    ("A", "CC0-1.0"),
    ("B", "Unlicense"),
    ("C", "GPL-3.0-or-later"),
    ("D", "EPL-2.0"),
    ("E", "BSL-1.0"),
    ("F", "CC-BY-SA-4.0"),
    ("G", "CC-BY-NC-4.0"),
    ("q", "LicenseRef-All-Rights-Reserved"),
    *_SPDX.items(),
)

#: Every known sentence has one of these stems, so only texts that have one are searched.
STEMS = "licen|permission|copyright|redistribut|reserved|unencumbered|mpl"

# Words two spaces apart and a space at either end: sentences then have bounds of their own.
_WIDE = {v.replace(" ", "  "): k for k, v in SENTENCES.items()}
PATTERN = " (" + "|".join(sorted(_WIDE, key=lambda v: (-len(v), v))) + ") "

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_licenses): identifiers in order; licences found, in order, joined by commas."""
    known = F.create_map(*chain.from_iterable((F.lit(v), F.lit(k)) for v, k in _WIDE.items()))
    rule = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in RULES))
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    wide = F.concat(F.lit(" "), F.regexp_replace("_lower", "[^a-z0-9]+", "  "), F.lit(" "))
    names = F.transform(F.regexp_extract_all("_wide", F.lit(PATTERN), F.lit(1)), lambda s: F.try_element_at(known, s))
    found = F.regexp_extract_all("sentence_ids", F.lit("|".join(k for k, _ in RULES)), F.lit(0))
    return (
        docs.select(F.col(doc_id).alias("doc_id"), lower.alias("_lower"))
        .withColumn("_wide", F.when(F.col("_lower").rlike(STEMS), wide).otherwise(F.lit("")))
        .select("doc_id", F.array_join(names, "").alias("sentence_ids"))
        .withColumn("_licenses", F.transform(found, lambda k: F.element_at(rule, k)))
        .select("doc_id", "sentence_ids", F.array_join("_licenses", ",").alias("licenses"), F.size("_licenses").cast("long").alias("n_licenses"))
    )


def oracle(table: str = "documents") -> str:
    """The same in DuckDB SQL."""
    known = "MAP {" + ", ".join(f"'{v}': '{k}'" for v, k in _WIDE.items()) + "}"
    rules = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in RULES) + "}"
    return f"""
    WITH wide AS (
      SELECT doc_id, ' ' || regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9]+', '  ', 'g') || ' ' AS w FROM {table}),
    ids AS (
      SELECT doc_id, array_to_string(list_transform(regexp_extract_all(w, '{PATTERN}', 1), lambda x: {known}[x]), '') AS sentence_ids FROM wide),
    found AS (
      SELECT doc_id, sentence_ids, list_transform(regexp_extract_all(sentence_ids, '{"|".join(k for k, _ in RULES)}'), lambda k: {rules}[k]) AS l FROM ids)
    SELECT doc_id, sentence_ids, array_to_string(l, ',') AS licenses, CAST(len(l) AS BIGINT) AS n_licenses FROM found
    """

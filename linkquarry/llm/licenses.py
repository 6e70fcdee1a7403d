"""Licence scanning: normalised text against licence templates by the Dice coefficient of word bigrams.

Only DataFrame functions are used. A document's segments are its lines and its paragraphs (blocks between blank
lines). A segment with b bigrams can reach a coefficient t with a template of b' bigrams only if b lies between
b' t / (2 - t) and b' (2 - t) / t. Bigrams that repeat count as often as they stand there, so b is the number of words less
one: the bound is exact and known before any bigram is built, and most segments are never compared. All of it happens
row by row: the templates are literals of a fixed size, and only matches are shuffled, to be reported once for each document.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICE = 0.8

# Well-known licence notices and short licence texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}


def normalised_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def _bigram_list(words: list[str]) -> list[str]:
    """The bigrams, sorted; a repeat is marked by the number of equal ones before it, so common entries of two lists count as those of bags."""
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return sorted(x if (k := pairs[:i].count(x)) == 0 else f"{x}#{k}" for i, x in enumerate(pairs))


def _size_bounds(dice: float, bigrams: int) -> tuple[int, int]:
    """Least and most bigrams, with repeats, of a segment that can reach ``dice`` with a template of ``bigrams`` bigrams."""
    return math.ceil(bigrams * dice / (2 - dice) - 1e-9), math.floor(bigrams * (2 - dice) / dice + 1e-9)


def licences(docs: DataFrame, dice: float = DICE, templates: dict[str, str] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each document id and licence: doc_id, licence, dice (the best segment's, to 6 places) and n_segments.

    A null or empty text, and segments of fewer than two words, match nothing. Rows with one id are reported
    together, as are those whose id is null. A segment counts for the licence nearest to it, ties to the first by name. A line that is a paragraph by itself counts once.
    """
    known = {k: normalised_words(v) for k, v in (templates or TEMPLATES).items()}
    sizes = {k: _size_bounds(dice, len(v) - 1) for k, v in known.items()}
    low, high = min(a for a, _ in sizes.values()), max(b for _, b in sizes.values())
    every = sorted({b for v in known.values() for b in _bigram_list(v)})

    def count(segment: Column) -> Column:
        """Words less one of a segment whose words are parted by single spaces."""
        return F.length(segment) - F.length(F.replace(segment, F.lit(" "), F.lit("")))

    docs = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(F.lower(F.col(text_col)), r"[^a-z0-9\n]+", " ").alias("text"))
    text = F.col("text")
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, "\n ?\n"), lambda p: F.contains(p, F.lit("\n")))
    segments = F.concat(lines, F.transform(paragraphs, lambda p: F.regexp_replace(p, "[ \n]+", " ")))
    fitting = F.filter(F.transform(segments, lambda s: F.trim(s)), lambda s: (count(s) >= max(1, low)) & (count(s) <= high))
    found = docs.select("doc_id", F.explode(fitting).alias("segment"))

    def bigrams(segment: Column) -> Column:
        words = F.split(segment, " ")
        return F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))

    def marked(pairs: Column) -> Column:
        """Repeats told apart, as in ``_bigram_list``."""
        nth = lambda x, i: F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda y: y == x))
        each = F.transform(pairs, lambda x, i: F.when(F.array_position(pairs, x) == i + 1, x).otherwise(F.concat(x, F.lit("#"), nth(x, i).cast("string"))))
        return F.when(F.size(F.array_distinct(pairs)) == F.size(pairs), pairs).otherwise(each)

    # The explode keeps the bigrams of a segment as a value; inside the comparison they'd be built for each template.
    found = found.select("doc_id", F.explode(F.array(bigrams(F.col("segment")))).alias("pairs")).filter(F.arrays_overlap("pairs", F.array(*map(F.lit, every))))
    found = found.select("doc_id", F.size("pairs").alias("n"), F.explode(F.array(marked(F.col("pairs")))).alias("own"))
    literal = F.array(*[F.struct(F.lit(k).alias("licence"), F.lit(sizes[k][0]).alias("low"), F.lit(sizes[k][1]).alias("high"), F.array(*map(F.lit, _bigram_list(v))).alias("bigrams")) for k, v in known.items()])
    scored = F.transform(F.filter(literal, lambda t: (F.col("n") >= t["low"]) & (F.col("n") <= t["high"])), lambda t: F.struct((F.lit(-2.0) * F.size(F.array_intersect(F.col("own"), t["bigrams"])) / (F.size("own") + F.size(t["bigrams"]))).alias("less"), t["licence"].alias("licence")))
    hits = found.select("doc_id", F.array_min(scored).alias("hit")).filter(-F.col("hit.less") >= dice)
    return hits.groupBy("doc_id", F.col("hit.licence").alias("licence")).agg(F.round(F.max(-F.col("hit.less")), 6).alias("dice"), F.count("*").alias("n_segments"))


def licences_sql(dice: float = DICE, templates: dict[str, str] | None = None) -> str:
    """The same in DuckDB SQL over ``documents``."""
    known = {k: normalised_words(v) for k, v in (templates or TEMPLATES).items()}
    sizes = {k: _size_bounds(dice, len(v) - 1) for k, v in known.items()}
    low, high = min(a for a, _ in sizes.values()), max(b for _, b in sizes.values())
    rows = [f"('{k}', {sizes[k][0]}, {sizes[k][1]}, [{', '.join(repr(b) for b in _bigram_list(v))}])" for k, v in known.items()]
    return f"""
WITH templates(licence, low, high, bigrams) AS (VALUES {', '.join(rows)}),
texts AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9\\n]+', ' ', 'g') AS t FROM documents),
segments AS (
  SELECT doc_id, trim(unnest(string_split(t, chr(10)))) AS segment FROM texts
  UNION ALL
  SELECT doc_id, trim(regexp_replace(p, '[ \\n]+', ' ', 'g')) FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '\\n ?\\n')) AS p FROM texts) WHERE contains(p, chr(10))
),
words AS (SELECT doc_id, string_split(segment, ' ') AS w FROM segments WHERE segment <> ''),
pairs AS (
  SELECT row_number() OVER () AS segment_id, doc_id, len(w) - 1 AS n, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] AS p
  FROM words WHERE len(w) - 1 BETWEEN {max(1, low)} AND {high}
),
single AS (SELECT segment_id, doc_id, n, unnest(p) AS b, generate_subscripts(p, 1) AS i FROM pairs),
numbered AS (SELECT segment_id, doc_id, n, b, row_number() OVER (PARTITION BY segment_id, b ORDER BY i) - 1 AS k FROM single),
own AS (SELECT segment_id, doc_id, n, list(CASE WHEN k = 0 THEN b ELSE b || '#' || k END) AS own FROM numbered GROUP BY ALL),
best AS (
  SELECT doc_id, licence, 2.0::DOUBLE * len(list_intersect(own, bigrams)) / (len(own) + len(bigrams)) AS dice
  FROM own JOIN templates ON n BETWEEN low AND high
  QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY dice DESC, licence) = 1
)
SELECT doc_id, licence, round(max(dice), 6) AS dice, count(*) AS n_segments FROM best WHERE dice >= {dice} GROUP BY doc_id, licence
"""

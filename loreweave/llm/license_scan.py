"""License scans (operator 4): word windows of texts against licence templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Notices by which public licences are named or granted.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}
_WORD = re.compile(r"[^\W_]+")


def normalised(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Templates:
    """An index from bigram to the templates that have it, so that texts without any are passed over."""

    def __init__(self, templates: dict[str, str], threshold: float) -> None:
        self.threshold = threshold
        self.words = {k: normalised(v) for k, v in sorted(templates.items())}
        self.grams = {k: Counter(zip(w, w[1:])) for k, w in self.words.items()}
        self.at: dict[tuple[str, str], list[str]] = defaultdict(list)
        for k, own in self.grams.items():
            for gram in own:
                self.at[gram].append(k)

    def found(self, words: list[str]) -> list[tuple[str, float, int, int]]:
        """(template, Dice, first word, end word) of the best window of each template that reaches the threshold, best first.

        By the size bound, a window with Dice t has t / (2 - t) to (2 - t) / t times the template's bigrams and shares at
        least t / (2 - t) of them. The best begins and ends with a bigram of the template, as others only add to its size.
        """
        hits: dict[str, list[int]] = defaultdict(list)
        at = self.at
        for i, gram in enumerate(zip(words, words[1:])):
            if gram in at:
                for k in at[gram]:
                    hits[k].append(i)
        out = []
        for k, own in hits.items():
            grams = self.grams[k]
            size = grams.total()
            need = ceil(self.threshold / (2 - self.threshold) * size - 1e-9)
            most = floor((2 - self.threshold) / self.threshold * size + 1e-9)
            best = (0.0, 0, 0)
            for x in range(len(own) - need + 1):
                start = own[x]
                if own[x + need - 1] - start >= most:
                    continue
                left, shared = dict(grams), 0
                for i in own[x : x + most]:
                    if i - start >= most:
                        break
                    gram = (words[i], words[i + 1])
                    if left[gram]:
                        left[gram] -= 1
                        shared += 1
                        score = 2 * shared / (i - start + 1 + size)
                        if score > best[0] + 1e-12:
                            best = (score, start, i + 2)
            if best[0] >= self.threshold:
                out.append((k, *best))
        return sorted(out, key=lambda x: (-x[1], x[0]))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license (best template or null), dice, and matches (license, dice, first_word, end_word; best first): a row per row of docs.

    Words are letters and digits, lower-cased; windows of every length that can reach the threshold are compared with a
    template by the Dice coefficient of their word bigrams, repeats included. Ties go to the template first by name and its first window.
    Null and empty texts match nothing; equal rows match alike; an empty table gives no rows; other columns play no part.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    match = T.StructType([T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("first_word", T.IntegerType()), T.StructField("end_word", T.IntegerType())])
    schema = T.StructType([d.schema["doc_id"], T.StructField("matches", T.ArrayType(match))])
    arrow = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32())]))
    own = dict(TEMPLATES if templates is None else templates)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(own, threshold)
        for batch in batches:
            rows = [[dict(zip(("license", "dice", "first_word", "end_word"), m)) for m in index.found(normalised(x.as_py()))] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, arrow)], schema.names)

    out = d.mapInArrow(scanned, schema)
    return out.select("doc_id", F.get("matches", F.lit(0))["license"].alias("license"), F.coalesce(F.get("matches", F.lit(0))["dice"], F.lit(0.0)).alias("dice"), "matches")

"""Licence scans: a trained classifier of paragraphs, confirmed by comparison with templates.

Paragraphs (lines of a text) are bags of word n-grams. A sparse multinomial logistic regression gives probabilities of the
licence families and of ``unknown``; it is trained on notices of the families, of licences without a family of their
own, and on other prose. A temperature is fitted on variants that it was not trained on, among them licences of which it
has seen nothing. A prediction is confirmed if the paragraph shares enough word pairs with a notice of that family; pairs
that stand in notices of several licences hardly count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.blocks import ALPHANUMERIC, Splitter, Words, mix, slices, text_bytes

UNKNOWN = "unknown"
BUCKETS = 1 << 20
GRAMS = (1, 2, 3)
#: Share of the smaller side's word pairs that a paragraph has in common with a notice that confirms it.
CONFIRM_AT = 0.5
#: Weight of a word pair that stands in notices of several licences.
SHARED_WEIGHT = 0.1

# Short notices of public licences.
NOTICES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "SPDX-License-Identifier: MIT",
        "This file is licensed under the MIT license.",
        "The MIT License (MIT)",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is distributed under the Apache License 2.0.",
        "This file is licensed under the Apache license.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU GPL v3.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General"
        " Public License",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "This file is licensed under the BSD license.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "Public domain": (
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0.",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Copyright 2020 by the authors. All rights reserved. No part of this publication may be reproduced without permission.",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
    ),
}
# Notices of licences that are no family here. Those in the second table only calibrate.
FOREIGN = (
    "Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Licensed under the GNU General Public License, version 2.",
    "Released under the GNU GPL v2.", "SPDX-License-Identifier: GPL-2.0-only", "This program is licensed under the GPL version 2 only.",
    "Licensed under the zlib License.", "This software is provided 'as-is', without any express or implied warranty.",
    "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0",
    "Licensed under the Artistic License 2.0.", "This program is free software; you can redistribute it under the terms of the Artistic License.",
    "Licensed under the European Union Public License, version 1.2.", "SPDX-License-Identifier: EUPL-1.2",
    "Licensed under the Common Development and Distribution License.", "SPDX-License-Identifier: CDDL-1.0",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the PostgreSQL License.",
    "Licensed under the Microsoft Public License.", "SPDX-License-Identifier: MS-PL",
)
FOREIGN_CALIBRATION = (
    "Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0",
    "Do What The Fuck You Want To Public License, version 2.", "Released under the WTFPL.", "Licensed under the Academic Free License, version 3.0.",
    "Licensed under the Open Software License 3.0.", "SPDX-License-Identifier: OSL-3.0", "Licensed under the Python Software Foundation License, version 2.",
)
# Prose with words of notices that is none.
OTHER = (
    "The driver must show a valid license at the counter.", "A fishing license costs ten dollars a year.",
    "The general public is invited to the opening of the library.", "Version 3 of the engine was released in May.",
    "They moved to the software business under new terms.", "The work was published by a small foundation.",
    "All seats are reserved for members.", "She has the right to a copy of the file.", "The school reserved all rooms.",
    "Commercial use of the land is not permitted here.", "Apache helicopters flew over the valley.", "The source of the river is free to visit.",
    "He studied at MIT and released a record in 1999.", "Creative people share common ideas.", "The public domain of the king was large.",
    "You may use this path with permission of the owner.", "Notice to all readers of the paper.", "The following conditions were met at the border.",
    "It is what it is, and the rest is as it was.", "This is the first part of the story about a copy of a painting.",
    "Distribution of food in the north began under the new law.", "The general gave the order at version two of the plan.",
    "in the of and to a is that for with by on as at from", "under the bridge the water is free and the way is open",
)


def line_words(column: pa.Array, split: Splitter) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of the lines of a block of texts, the text of each line, and its number in the text."""
    data, offsets = text_bytes(column)
    words = split(column)
    cuts = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets[:-1]])) if len(data) else np.zeros(0, np.int64)
    cuts = cuts[cuts < len(data)]
    owner = np.searchsorted(offsets, cuts, "right") - 1
    number = np.arange(len(cuts)) - np.searchsorted(cuts, offsets)[owner]
    first = np.append(np.searchsorted(words.start, cuts), len(words.start))
    return words._replace(first=first), owner, number


def n_grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words inside lines, and their lines."""
    line = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    h = words.hash[words.first[0] : words.first[-1]] if len(words.first) else words.hash
    n = max(0, len(h) - size + 1)
    joined = np.full(n, size, np.uint64)
    for k in range(size):
        joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    same = line[:n] == line[size - 1 :] if n else np.zeros(0, bool)
    return joined[same], line[:n][same]


@dataclass
class LicenceModel:
    families: list[str]  # the last one is UNKNOWN
    row: np.ndarray  # for each bucket its row of weights, -1 if no known n-gram falls into it
    weights: np.ndarray  # rows x families
    bias: np.ndarray
    temperature: float
    pairs: list[list[np.ndarray]]  # of each family but the last, the word pairs of its notices
    shared: np.ndarray  # word pairs that stand in notices of several licences, sorted

    def probabilities(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Lines with known n-grams, and their probabilities; all other lines are unknown.

        An n-gram counts once in a line, by the share it has among all of the line's.
        """
        lines = len(words.first) - 1
        count, hits = np.zeros(lines), []
        for size in GRAMS:
            grams, line = n_grams(words, size)
            count += np.bincount(line, minlength=lines)
            row = self.row[(grams % np.uint64(BUCKETS)).astype(np.int64)]
            hits.append(line[row >= 0] * len(self.weights) + row[row >= 0])
        hits = np.unique(np.concatenate(hits))
        line, row = hits // len(self.weights), hits % len(self.weights)
        some, place = np.unique(line, return_inverse=True)
        sums = np.zeros((len(some), len(self.families)))
        np.add.at(sums, place, self.weights[row])
        z = (sums / np.sqrt(np.maximum(count[some], 1))[:, None] + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return some, p / p.sum(axis=1, keepdims=True)

    def similarity(self, words: Words, line: int, family: int) -> float:
        """Largest share of common word pairs with a notice of the family, of the smaller side's; shared pairs weigh little."""

        def weight(pairs: np.ndarray) -> float:
            return float(np.where(np.isin(pairs, self.shared, assume_unique=True), SHARED_WEIGHT, 1.0).sum())

        own = np.unique(_pairs(words.hash[words.first[line] : words.first[line + 1]]))
        whole = weight(own)
        shares = [weight(np.intersect1d(own, t, assume_unique=True)) / max(SHARED_WEIGHT, min(whole, weight(t))) for t in self.pairs[family]]
        return max(shares, default=0.0)


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; of a single word itself."""
    if len(hashes) < 2:
        return hashes
    return mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])


def _variants(notice: str, random: np.random.Generator, n: int) -> list[str]:
    """The notice, and copies with words dropped at either end or something said before and behind."""
    before = ("", "This file is ", "Copyright 2021 the authors. ", "Note: ", "The code is ")
    behind = ("", " See the file.", " Thank you.", " More below.")
    out, words = [notice], notice.split()
    for _ in range(n):
        a, b = (int(random.integers(0, max(1, len(words) // 5) + 1)) for _ in range(2))
        kept = " ".join(words[a : len(words) - b]) if len(words) > 6 else notice
        out.append(str(random.choice(before)) + kept + str(random.choice(behind)))
    return out


def fit_licences(
    notices: dict[str, Sequence[str]] | None = None, other: Sequence[str] = OTHER, turns: int = 150, rate: float = 12.0,
    penalty: float = 1e-5, seed: int = 11, foreign: Sequence[str] | None = None, unseen: Sequence[str] = FOREIGN_CALIBRATION,
) -> LicenceModel:
    """Train on variants of the notices and of other prose; every third variant, and ``unseen``, only calibrate."""
    notices = NOTICES if notices is None else notices
    foreign = [*other, *(FOREIGN if foreign is None else foreign)]
    random = np.random.default_rng(seed)
    families = [*notices, UNKNOWN]
    rows = [(v, k) for k, f in enumerate(notices) for t in notices[f] for v in _variants(t, random, 6)]
    rows += [(v, len(families) - 1) for t in foreign for v in _variants(t, random, 4)]
    n_seen = len(rows)
    rows += [(t, len(families) - 1) for t in unseen]
    split = Splitter(ALPHANUMERIC)
    words = split(pa.array([t for t, _ in rows], pa.string()))
    y = np.array([k for _, k in rows])
    held = np.arange(len(rows)) % 3 == 2
    held[: 0 if len(rows) > 3 else len(rows)] = False
    held[n_seen:] = True
    parts = [n_grams(words, size) for size in GRAMS]
    bucket = np.concatenate([(g % np.uint64(BUCKETS)).astype(np.int64) for g, _ in parts])
    line = np.concatenate([x for _, x in parts])
    scale = 1 / np.sqrt(np.maximum(np.bincount(line, minlength=len(rows)), 1))
    used, place = np.unique(bucket, return_inverse=True)
    x = np.zeros((len(rows), len(used)))
    x[line, place] = 1.0
    x *= scale[:, None]
    weights, bias = np.zeros((len(used), len(families))), np.zeros(len(families))
    bias[-1] = 2.0
    target = np.eye(len(families))[y]
    fit = ~held
    for _ in range(turns):
        z = x[fit] @ weights + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = (target[fit] - p / p.sum(axis=1, keepdims=True)) / fit.sum()
        weights += rate * (x[fit].T @ error - penalty * weights)
    z = x[held] @ weights + bias

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s - np.log(np.exp(s).sum(axis=1, keepdims=True)))[np.arange(len(s)), y[held]].mean())

    temperature = min(np.geomspace(0.4, 5, 60), key=loss) if held.any() else 1.0
    row = np.full(BUCKETS, -1, np.int32)
    row[used] = np.arange(len(used))
    pairs = [
        [np.unique(_pairs(split(pa.array([t], pa.string())).hash)) for t in notices[f]] for f in families[:-1]
    ]
    each = [np.unique(np.concatenate(p)) for p in pairs if p] + [np.unique(_pairs(split(pa.array([t], pa.string())).hash)) for t in foreign]
    found, times = np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint64), np.zeros(0, int))
    return LicenceModel(families, row, weights, bias, float(temperature), pairs, found[times > 1])


def licence_scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: LicenceModel | None = None, confirm_at: float = CONFIRM_AT
) -> DataFrame:
    """Licence paragraphs of each row: ``doc_key, n_paragraphs long, found array<struct>``.

    ``found`` has, in order, ``line`` (number from 0), ``family``, ``probability``, ``similarity`` (to the nearest notice of the
    family) and ``confirmed`` for each paragraph whose most probable class is a family; ties go to the first family. Whole
    texts are read. Null and empty texts have no paragraphs; repeated rows and null keys give a row each; an empty
    input gives no rows. Other columns are not read, whatever their names.
    """
    model = model or fit_licences()
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    item = pa.struct(
        [("line", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(ALPHANUMERIC)
        for batch in slices(batches, "text"):
            words, owner, number = line_words(batch.column("text"), split)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            lines, p = model.probabilities(words)
            best = p.argmax(axis=1) if len(lines) else np.zeros(0, np.int64)
            for k in np.flatnonzero(best < len(model.families) - 1).tolist():
                line, family = int(lines[k]), int(best[k])
                similar = model.similarity(words, line, family)
                found[owner[line]].append(
                    {
                        "line": int(number[line]), "family": model.families[family], "probability": float(p[k, family]),
                        "similarity": similar, "confirmed": similar >= confirm_at,
                    }
                )
            counts = pa.array(np.bincount(owner, minlength=batch.num_rows), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), counts, pa.array(found, pa.list_(item))], names=["doc_key", "n_paragraphs", "found"]
            )

    kind = source.schema["key"].dataType.simpleString()
    struct = "struct<line:bigint,family:string,probability:double,similarity:double,confirmed:boolean>"
    return source.mapInArrow(run, f"doc_key {kind}, n_paragraphs long, found array<{struct}>")

"""License scans with a trained paragraph classifier.

A paragraph is a line with a word. Sparse word 1- and 2-grams feed a multinomial logistic regression
over licence families and an unknown class, trained here on the notices below with words dropped,
doubled and framed by other words, and on mentions made of what families are called and of how speech says that
something is licensed, against sentences that use the same words for other things. The
class probabilities are calibrated on held-out examples by a temperature and a shift of the unknown
class. A predicted family counts only if a comparison with its notices confirms it: enough of
a notice's word 2-grams stand in the paragraph, those that name the family among them; a notice
without such words needs the same share of the 2-grams that no other family's notice has. A mention, which is
short, must stand in the paragraph word by word.

A notice may be wrapped: runs of lines between blank ones are searched for spans, over any number of
lines, that hold enough of a notice's 2-grams, and each span is judged as a line is. It counts as
the paragraph it begins in.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import base
from lumenfold.llm.base import flat, mix, spread, word_spans

# The usual notices of public licences, and how their texts begin, by family.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "MIT License",
        "License: MIT",
        "Licensed under MIT",
        "This project is MIT licensed.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "License: Apache 2.0",
        "Apache-2.0 licensed",
        "Apache License Version 2.0, January 2004",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GPL version 2 or later.",
        "Distributed under the GPLv3 license.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "GNU General Public License v3.0",
        "Distributed under GPLv3",
        "GNU General Public License Version 3, 29 June 2007",
    ],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the LGPL version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later", "GNU Lesser General Public License v2.1"],
    "AGPL": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "GNU Affero General Public License v3.0"],
    "BSD": [
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0"],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC", "ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, version 1.0.", "SPDX-License-Identifier: EPL-2.0", "Eclipse Public License - v 2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "Released under the Unlicense."],
    "Zlib": ["Released under the zlib License.", "zlib License", "SPDX-License-Identifier: Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "Creative Commons Attribution 4.0 International", "CC BY 4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International", "CC BY-SA 4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International", "CC BY-NC 4.0"],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Universal"],
    "OFL": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1", "SIL Open Font License Version 1.1"],
    "Proprietary": ["All rights reserved. No part of this work may be reproduced without written permission.", "This software is proprietary and confidential; unauthorized copying is prohibited."],
}
# Words that name a family; one of them (or, where there is none, the whole notice) must stand in a confirmed paragraph.
NAMES = {
    "MIT": ["mit"],
    "Apache-2.0": ["apache"],
    "GPL": ["gpl", "gnu", "gplv3", "gplv2"],
    "LGPL": ["lgpl", "lesser"],
    "AGPL": ["agpl", "affero"],
    "BSD": ["bsd"],
    "MPL-2.0": ["mozilla", "mpl"],
    "ISC": ["isc"],
    "EPL": ["eclipse", "epl"],
    "BSL-1.0": ["boost", "bsl"],
    "Unlicense": ["unencumbered", "unlicense"],
    "Zlib": ["zlib"],
    "CC-BY": ["by", "attribution"],
    "CC-BY-SA": ["sa", "sharealike"],
    "CC-BY-NC": ["nc", "noncommercial"],
    "CC0": ["cc0"],
    "OFL": ["ofl", "sil"],
    "Proprietary": ["reserved", "proprietary"],
}
# Sentences with a licence's words that grant none.
OTHERS = ["She passed her driving test and got a license.", "The free library is open to the public from nine.", "The version of the story that the school published.", "The general said that the work is not for sale.", "Permission to leave was granted at noon.", "The source of the river is subject to the terms of the treaty.", "A copy of the software was sent by the foundation.", "He works at MIT and lives near the apache reservation.", "The university is licensed to sell beer under the law.", "This is the work of the public and the common people."]

# What families are called in speech; first those that also name other things, then those that name nothing else.
ALIASES = {
    "MIT": (["MIT"], []),
    "Apache-2.0": (["Apache", "Apache 2", "Apache Software"], ["Apache 2.0", "Apache v2", "Apache License 2"]),
    "GPL": ([], ["GPL", "GPLv2", "GPLv3", "GPL 2", "GPL 3", "GPL v2", "GPL v3", "GPL-2.0", "GPL-3.0", "GNU GPL", "GNU General Public"]),
    "LGPL": ([], ["LGPL", "LGPLv2", "LGPLv3", "LGPL 2.1", "LGPL v2.1", "LGPL 3", "GNU LGPL", "Lesser GPL", "Lesser General Public"]),
    "AGPL": ([], ["AGPL", "AGPLv3", "AGPL 3", "AGPL v3", "AGPL-3.0", "GNU AGPL", "Affero GPL", "Affero General Public"]),
    "BSD": (["BSD", "new BSD", "modified BSD", "simplified BSD"], ["3-clause BSD", "2-clause BSD", "BSD 3-clause", "BSD 2-clause", "three-clause BSD", "two-clause BSD"]),
    "MPL-2.0": (["Mozilla", "MPL"], ["MPL 2.0", "MPL v2", "MPLv2", "Mozilla Public"]),
    "ISC": (["ISC"], []),
    "EPL": (["Eclipse", "EPL"], ["EPL 2.0", "EPL v2", "EPL 1.0", "Eclipse Public"]),
    "BSL-1.0": (["Boost", "BSL"], ["Boost Software", "BSL 1.0"]),
    "Unlicense": (["Unlicense"], []),
    "Zlib": (["zlib"], ["zlib/libpng"]),
    "CC-BY": ([], ["CC BY", "CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution", "Creative Commons BY"]),
    "CC-BY-SA": ([], ["CC BY-SA", "CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike", "Creative Commons BY-SA"]),
    "CC-BY-NC": ([], ["CC BY-NC", "CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial", "Creative Commons BY-NC"]),
    "CC0": ([], ["CC0", "CC0 1.0"]),
    "OFL": (["OFL"], ["SIL OFL", "SIL Open Font", "Open Font"]),
    "Proprietary": ([], []),
}
# How a mention says that something is licensed, about any name and about names of nothing else.
SPEECH = ["{} license", "{} licence", "{} licensed", "{} licenced", "{}-style license", "{} style licence", "license {}", "licence {}", "license is {}", "licensed {}", "licenced {}", "licensed as {}", "licensed under {}", "licensed under the {}", "licence is the {}", "licenses {}", "{} licenses"]
SPEECH_OF_NAMES = ["under {}", "under the {}", "{} or later", "{} only", "terms of {}", "terms of the {}", "released as {}", "{} compatible", "available as {}", "uses {}", "covered by the {}"]

FAMILIES = ("unknown", *NOTICES)
TRAIN_EXAMPLES, SEED = 16_000, 11
#: Least calibrated probability of a family, and share of a notice's word pairs that must stand in the paragraph.
CERTAIN, CONFIRMED = 0.5, 0.6

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_WORDS = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def _tokens(line: str) -> list[str]:
    return _WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line))


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word 1- and 2-grams, and the text of each."""
    gaps = np.where(_TOKEN[_LOWER[data]], _LOWER[data], 0x20).astype(np.uint8)
    starts, ends, first = word_spans(gaps, offsets)
    one = base.word_hashes(gaps, starts, ends)
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    pairs = np.maximum(n - 1, 0)
    at = spread(first[:-1], pairs)
    two = mix(one[at] * np.uint64(3) + mix(one[at + 1]))
    return np.concatenate([one, two]), np.concatenate([of, np.repeat(np.arange(len(n)), pairs)])


def _as_column(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return flat(pa.array(lines, pa.string()))


class Classifier:
    """Weights of known n-grams (sorted hashes) for FAMILIES, calibrated."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float, shift: float):
        self.features, self.weights, self.bias, self.temperature, self.shift = features, weights, bias, temperature, shift
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(features >> np.uint64(44)).astype(np.int64)] = True

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold a known 2-gram at all, and their logits; all others are unknown."""
        h, of = _grams(data, offsets)
        some = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.features, h[some]), len(self.features) - 1)
        hit = self.features[at] == h[some]
        at, rows = at[hit], of[some[hit]]
        which, k = np.unique(rows, return_inverse=True)
        out = np.zeros((len(which), len(FAMILIES)))
        for c in range(len(FAMILIES)):
            out[:, c] = np.bincount(k, self.weights[at, c], len(which))
        return which, out + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z[:, 0] += self.shift
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _mentions(family: str) -> list[str]:
    common, own = ALIASES[family]
    return [pattern.format(name) for names, patterns in ((common, SPEECH), (own, SPEECH + SPEECH_OF_NAMES)) for name in names for pattern in patterns]


MENTIONS = {family: _mentions(family) for family in NOTICES}


def examples(n: int, seed: int, speech: bool = False) -> tuple[list[str], np.ndarray]:
    """Labelled paragraphs: notices altered at random, and unknown ones made of the same and of foreign words. With
    `speech`, most of the former are mentions among other words, and names without a licence are among the latter."""
    rng = np.random.default_rng(seed)
    pool = sorted({w for texts in NOTICES.values() for t in texts for w in t.split()} | {w for t in OTHERS for w in t.split()})
    all_names = {x for xs in NAMES.values() for x in xs}
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    foreign = lambda: "".join(rng.choice(letters, rng.integers(2, 10)))
    lines, labels = [], []
    for i in range(n):
        k = 0 if i % 2 else 1 + (i // 2) % len(NOTICES)
        if k:
            texts = NOTICES[FAMILIES[k]]
            names = NAMES[FAMILIES[k]]
            whole = texts[rng.integers(len(texts))].split()
            words = [w for w in whole if rng.random() > 0.08 or any(x in _tokens(w) for x in names)]
            if similarity(" ".join(words), FAMILIES[k]) < CONFIRMED:  # too little is left to be a notice
                words = whole
            if speech and MENTIONS[FAMILIES[k]] and rng.random() < 0.75:
                said = MENTIONS[FAMILIES[k]]
                around = [pool[j] for j in rng.integers(0, len(pool), rng.integers(0, 7))]
                around = [w for w in around if not all_names & set(_tokens(w))]
                cut = int(rng.integers(0, len(around) + 1))
                words = around[:cut] + said[rng.integers(len(said))].split() + around[cut:]
        elif (kind := rng.integers(4)) == 0:
            words = OTHERS[rng.integers(len(OTHERS))].split()
        elif speech and kind == 3 and rng.random() < 0.6:  # names without a licence
            named = ALIASES[FAMILIES[rng.integers(1, len(FAMILIES))]][0] or ["reserved"]
            words = named[rng.integers(len(named))].split() + [pool[j] for j in rng.integers(0, len(pool), rng.integers(1, 9))]
            rng.shuffle(words)
        elif kind == 1:
            words = [pool[j] for j in rng.integers(0, len(pool), rng.integers(2, 20))]
        else:
            words = [foreign() if rng.random() < 0.8 else pool[rng.integers(len(pool))] for _ in range(rng.integers(2, 25))]
        if not k and any(similarity(" ".join(words), f) >= CONFIRMED for f, xs in NAMES.items() if set(xs) & set(_tokens(" ".join(words)))):
            words = [w for w in words if not all_names & set(_tokens(w))]  # a notice by chance
        if rng.random() < 0.3:
            words = [foreign() for _ in range(rng.integers(1, 6))] + words
        if rng.random() < 0.3:
            words += [foreign() for _ in range(rng.integers(1, 6))]
        lines.append(" ".join(words))
        labels.append(k)
    return lines, np.array(labels)


@functools.cache
def fit(n: int = TRAIN_EXAMPLES, seed: int = SEED, steps: int = 600) -> Classifier:
    """Train on n examples and calibrate on as many others; some seconds, always the same result."""
    (lines, y), more = examples(n // 2, seed), examples(n - n // 2, seed + 2, speech=True)
    lines, y = lines + more[0], np.concatenate([y, more[1]])
    known = np.unique(_grams(*_as_column([t for texts in (*NOTICES.values(), *MENTIONS.values()) for t in texts] + OTHERS))[0])
    h, of = _grams(*_as_column(lines))
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = known[at] == h
    x = np.zeros((n, len(known)), np.float32)
    np.add.at(x, (of[hit], at[hit]), 1)
    x = np.minimum(x, 1)
    w, b = np.zeros((len(known), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    target = np.eye(len(FAMILIES), dtype=np.float32)[y]
    for _ in range(steps):
        z = x @ w + b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = z / z.sum(axis=1, keepdims=True) - target
        w -= 2.0 * (x.T @ error / n + 1e-4 * w)
        b -= 2.0 * error.mean(axis=0)
    w[np.abs(w) < 0.02] = 0
    model = Classifier(known, w.astype(float), b.astype(float), 1.0, 0.0)
    (held, truth), more = examples(n // 2, seed + 1), examples(n - n // 2, seed + 3, speech=True)
    held, truth = held + more[0], np.concatenate([truth, more[1]])
    which, logits = model.logits(*_as_column(held))
    truth, best = truth[which], np.inf
    for temperature in (0.5, 0.7, 1.0, 1.4, 2.0):
        for shift in (-1.0, 0.0, 1.0, 2.0):
            trial = Classifier(known, model.weights, model.bias, temperature, shift)
            loss = -np.log(np.maximum(trial.probabilities(logits.copy())[np.arange(len(which)), truth], 1e-12)).mean()
            if loss < best:
                best, model.temperature, model.shift = loss, temperature, shift
    return model


def _pairs(tokens: list[str]) -> set:
    return set(zip(tokens, tokens[1:], strict=False)) or set(tokens)


_TEMPLATES = {family: [_pairs(_tokens(t)) for t in texts] for family, texts in NOTICES.items()}
#: Of each notice without a name, the word pairs that no other family's notice has.
_DISTINCTIVE = {family: [None if {w for p in t for w in p} & set(NAMES[family]) else t - {p for other, us in _TEMPLATES.items() if other != family for u in us for p in u} for t in ts] for family, ts in _TEMPLATES.items()}


_SAID = {family: {tuple(_tokens(t)) for t in texts} for family, texts in MENTIONS.items()}
_SAID_LENGTHS = {family: sorted({len(t) for t in texts}) for family, texts in _SAID.items()}


def mentioned(tokens: list[str], family: str) -> bool:
    """Whether a mention of the family stands in the words."""
    return any(tuple(tokens[i : i + n]) in _SAID[family] for n in _SAID_LENGTHS[family] for i in range(len(tokens) - n + 1))


def similarity(line: str, family: str) -> float:
    """Largest share of a notice's word pairs that stand in the line, 1 for a mention. Where nothing names the family, a
    notice with a name must be whole, and of one without the share of distinctive pairs counts, if less."""
    tokens = _tokens(line)
    if mentioned(tokens, family):
        return 1.0
    mine = _pairs(tokens)
    named, best = bool(set(NAMES[family]) & set(tokens)), 0.0
    for t, own in zip(_TEMPLATES[family], _DISTINCTIVE[family], strict=True):
        share = len(t & mine) / len(t)
        if not named and share <= 0.95:
            share = min(share, len(own & mine) / len(own)) if own else 0.0
        best = max(best, share)
    return best


class Spans:
    """Where texts hold enough of a notice's word pairs close together."""

    def __init__(self, confirmed: float):
        self.confirmed = confirmed
        texts = [t for ts in NOTICES.values() for t in ts]
        pairs = [self._hashes(*_as_column([t]))[0] for t in texts]
        self.known = np.unique(np.concatenate(pairs))
        self.member = np.stack([np.isin(self.known, p) for p in pairs], axis=1)
        self.total = self.member.sum(axis=0)
        #: Words that a notice's span may have: half as many again, and some.
        self.reach = [len(_tokens(t)) * 3 // 2 + 6 for t in texts]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of word pairs, each one's first word and text, and starts and ends of words."""
        gaps = np.where(_TOKEN[_LOWER[data]], _LOWER[data], 0x20).astype(np.uint8)
        starts, ends, first = word_spans(gaps, offsets)
        one = base.word_hashes(gaps, starts, ends)
        pairs = np.maximum(np.diff(first) - 1, 0)
        at = spread(first[:-1], pairs)
        return mix(one[at] * np.uint64(3) + mix(one[at + 1])), at, np.repeat(np.arange(len(pairs)), pairs), starts, ends

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """First and end byte of spans, in order, each once."""
        h, word, of, starts, ends = self._hashes(data, offsets)
        some = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, h[some]), len(self.known) - 1)
        hit = self.known[at] == h[some]
        pair, word, of = at[hit], word[some[hit]], of[some[hit]]
        texts = np.unique(of * len(self.known) + pair)
        rows, each = np.unique(texts // len(self.known), return_inverse=True)
        held = np.zeros((len(rows), len(self.total)), np.int64)
        np.add.at(held, each, self.member[texts % len(self.known)])
        out = set()
        for row, k in np.argwhere(held >= self.confirmed * self.total).tolist():
            s, t = np.searchsorted(of, rows[row], "left"), np.searchsorted(of, rows[row], "right")
            mine = self.member[pair[s:t], k]
            for a, b in self._close(word[s:t][mine].tolist(), pair[s:t][mine].tolist(), k):
                out.add((int(starts[a]), int(ends[b])))
        return sorted(out)

    def _close(self, words: list[int], pairs: list[int], k: int) -> list[tuple[int, int]]:
        """First and last words of spans within reach that hold enough of notice k; of spans that overlap, the fullest."""
        out, begin, i, times = [], 0, 0, {}
        best = (0, 0, 0)
        while i < len(words):
            times[pairs[i]] = times.get(pairs[i], 0) + 1
            while words[i] - words[begin] >= self.reach[k]:
                times[pairs[begin]] -= 1
                if not times[pairs[begin]]:
                    del times[pairs[begin]]
                begin += 1
            if best[0] and words[i] - best[1] >= self.reach[k]:
                out.append(best[1:])
                best = (0, 0, 0)
                begin = next(j for j in range(begin, i + 1) if words[j] >= out[-1][1])
                times = {}
                for p in pairs[begin : i + 1]:
                    times[p] = times.get(p, 0) + 1
            if len(times) >= self.confirmed * self.total[k] and len(times) > best[0]:
                best = (len(times), words[begin], words[i] + 1)
            i += 1
        return [*out, best[1:]] if best[0] else out


FOUND = "doc_id bigint, n_paragraphs bigint, n_license bigint, families array<string>, found array<struct<paragraph:int,family:string,probability:double,similarity:double>>"


def scan(docs: DataFrame, certain: float = CERTAIN, confirmed: float = CONFIRMED) -> DataFrame:
    """doc_id, n_paragraphs, n_license (paragraphs of a known family), families (sorted, distinct) and
    found (index of the paragraph, family, calibrated probability, similarity), a row a document.

    A map over rows: nothing is shuffled. Null, empty and blank texts have no paragraphs, texts of any
    length are read whole, an empty table gives no rows, rows that repeat an id are scanned each on
    its own, and columns other than doc_id and text may have any name."""
    model, spans = fit(), Spans(confirmed)

    def run(batches):
        for batch in batches:
            for part in base.pieces(batch, 4 << 20):
                data, offsets = flat(part.column("text"))
                raw = data.tobytes()
                cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
                starts, ends = cuts[:-1], cuts[1:]
                word_starts, _, first = word_spans(data, cuts) if len(data) else (0, 0, np.zeros(1, np.int64))
                full = np.diff(first) > 0
                starts, ends = starts[full], ends[full]
                of = np.searchsorted(offsets, starts, "right") - 1
                at = np.searchsorted(starts, offsets)
                hits: list[list] = [[] for _ in range(part.num_rows)]
                if len(starts):
                    # lines lie one after another: their bytes are a column as they are, blank ones aside
                    edges = np.append(starts, len(data))
                    which, logits = model.logits(data[starts[0] :], edges - starts[0])
                    p = model.probabilities(logits)
                    best = p[:, 1:].argmax(axis=1) + 1
                    for i in np.flatnonzero(p[np.arange(len(best)), best] >= certain).tolist():
                        line, family = which[i], FAMILIES[best[i]]
                        near = similarity(raw[starts[line] : ends[line]].decode("utf-8", "replace"), family)
                        if near >= confirmed:
                            hits[of[line]].append({"paragraph": int(line - at[of[line]]), "family": family, "probability": round(float(p[i, best[i]]), 4), "similarity": round(near, 4)})
                    # runs end where a text does, or a blank line stands
                    breaks = np.flatnonzero(~full)
                    runs = np.unique(np.concatenate([offsets, cuts[breaks], cuts[breaks + 1]]))
                    found = [(a, b, np.searchsorted(starts, a, "right") - 1) for a, b in spans.find(data, runs)]
                    found = [(a, b, int(line), int(np.searchsorted(starts, b, "left"))) for a, b, line in found]
                    found = [x for x in found if x[3] - x[2] > 1]  # lines alone were judged above
                    if found:
                        which, logits = model.logits(*flat(pa.array([raw[a:b].replace(b"\n", b" ").decode("utf-8", "replace") for a, b, _, _ in found])))
                        p = model.probabilities(logits)
                        best = p[:, 1:].argmax(axis=1) + 1
                        likely = []
                        for i in np.flatnonzero(p[np.arange(len(best)), best] >= certain).tolist():
                            a, b, line, end = found[which[i]]
                            family = FAMILIES[best[i]]
                            near = similarity(raw[a:b].decode("utf-8", "replace"), family)
                            if near >= confirmed:
                                likely.append((-near, a, b, line, end, family, float(p[i, best[i]])))
                        for near, a, b, line, end, family, sure in sorted(likely):
                            mine, first_line = hits[of[line]], at[of[line]]
                            # of a line that is mostly a part of the span, the fuller reading holds
                            part_of = [k for k in range(line, end) if 2 * (min(b, ends[k]) - max(a, starts[k])) > ends[k] - starts[k]]
                            mine[:] = [x for x in mine if x["paragraph"] + first_line not in part_of or x["similarity"] >= round(-near, 4)]
                            if not any(line <= x["paragraph"] + first_line < end and x["family"] == family for x in mine):
                                mine.append({"paragraph": int(line - first_line), "family": family, "probability": round(sure, 4), "similarity": round(-near, 4)})
                    for x in hits:
                        x.sort(key=lambda y: (y["paragraph"], y["family"]))
                columns = [part.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array([len(x) for x in hits], pa.int64()), pa.array([sorted({y["family"] for y in x}) for x in hits], pa.list_(pa.string()))]
                kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, kind)], names=["doc_id", "n_paragraphs", "n_license", "families", "found"])

    return base.documents(docs).mapInArrow(run, FOUND)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in `documents`: doc_id, n_paragraphs, n_license, families, found."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""License scan by conditional compression (operator 2).

Candidate blocks are runs of sentences of one paragraph (lines without a blank
line between) that hold license words.  A block is read in windows: sentences in a
row that start inside it and may go on behind it by the length of a template.
A window is compressed alone and with each license template as a zstandard raw
dictionary; templates are ranked by the reduction in size, as a share of the
window's or the template's own compressed size, whichever is less.  Those that
save ``LEAST_REDUCTION`` are then confirmed by exact wording: the words of the
template are aligned with the window, and the template wins only if its
distinguishing words (names, numbers, clauses) all stand in the window in order,
the share of its other words that differ is at most ``MOST_DIFFERENT``, and no
negation stands in its sentence before or within it.  A title (``MIT License``)
counts only where it is all of the window.  What differs is part of the
result.  Of windows that overlap the one with the most words of its template
stands; what it holds before and after its template is scanned again, so a
block yields each of its licenses.

A pasted license body is known by its title paragraph, a source file by its SPDX
line (templates made from the list of identifiers).

Defined cases: a null text is an empty one; a null doc_id is kept; repeated
rows are each scanned; an empty table gives an empty result; texts are never
cut; other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from upkeep.llm.common import map_arrow, slices

LEVEL = 12
LEAST_REDUCTION = 0.15
MOST_DIFFERENT = 0.34

# The wording of public licenses and of the usual notices.  Each
# entry: identifier, words that must stand in the text, wording.
TEMPLATES: list[tuple[str, str, str]] = [
    ("MIT", "MIT license", "Released under the MIT License."),
    ("MIT", "MIT license", "Licensed under the MIT License. See the LICENSE file for details."),
    ("MIT", "permission hereby granted without restriction substantial portions",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software."),
    ("ISC", "permission use copy modify distribute with or without fee hereby granted",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Apache license 2 0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache license 2 0",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "GNU general public license 3",
     "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "GNU general public license 3 or later",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("GPL-2.0", "GNU general public license 2",
     "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", "GNU general public license 2 or later",
     "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
     "option) any later version."),
    ("LGPL-3.0", "GNU lesser general public license 3",
     "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "GNU lesser general public license 2 1",
     "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "GNU affero general public license 3",
     "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Mozilla public license 2 0",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla public license 2 0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("BSD-2-Clause", "redistribution source binary forms permitted provided following conditions",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
     "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
     "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
     "materials provided with the distribution."),
    ("BSD-3-Clause", "redistribution source binary forms permitted neither name endorse promote",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
     "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
     "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
     "materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
     "contributors may be used to endorse or promote products derived from this software without specific prior "
     "written permission."),
    ("BSD-2-Clause", "BSD 2 clause license", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "BSD 3 clause license", "Licensed under the BSD 3-Clause License."),
    ("CC0-1.0", "CC0 1 0", "To the extent possible under law, the author has dedicated this work under CC0 1.0."),
    ("CC-BY-4.0", "CC BY 4 0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "creative commons attribution 4 0 international",
     "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "CC BY SA 4 0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "creative commons attribution sharealike 4 0 international",
     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "CC BY NC 4 0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "creative commons attribution noncommercial 4 0 international",
     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "CC BY NC SA 4 0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "CC BY ND 4 0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "CC BY NC ND 4 0", "Licensed under CC BY-NC-ND 4.0."),
    ("LGPL-3.0-or-later", "GNU lesser general public license 3 or later",
     "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("LGPL-2.1-or-later", "GNU lesser general public license 2 1 or later",
     "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
     "Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your "
     "option) any later version."),
    ("AGPL-3.0-or-later", "GNU affero general public license 3 or later",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("GPL-3.0", "GNU general public license version 3 29 june 2007",
     "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is "
     "permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "GNU lesser general public license version 3 29 june 2007",
     "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
     "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not "
     "allowed."),
    ("AGPL-3.0", "GNU affero general public license version 3 19 november 2007",
     "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
     "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not "
     "allowed."),
    ("GPL-2.0", "GNU general public license version 2 june 1991",
     "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 "
     "Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim "
     "copies of this license document, but changing it is not allowed."),
    ("LGPL-2.1", "GNU lesser general public license version 2 1 february 1999",
     "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, "
     "Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute "
     "verbatim copies of this license document, but changing it is not allowed."),
    ("Apache-2.0", "Apache license version 2 0 january 2004 terms conditions",
     "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
     "REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-2.0", "Mozilla public license version 2 0 definitions contributor",
     "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity "
     "that creates, contributes to the creation of, or owns Covered Software."),
    ("Unlicense", "free unencumbered software released public domain",
     "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "all rights reserved", "All rights reserved."),
    ("Proprietary", "all rights reserved", "Copyright (c) the author. All rights reserved."),
    ("MIT", "MIT licensed", "This project is MIT licensed."),
    ("Apache-2.0", "Apache 2 0 licensed", "This project is Apache 2.0 licensed."),
    ("BSL-1.0", "boost software license 1 0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "eclipse public license 2 0",
     "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("EUPL-1.2", "EUPL 1 2", "Licensed under the EUPL, Version 1.2."),
    ("Zlib", "provided as is without express or implied warranty in no event authors held liable",
     "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
     "liable for any damages arising from the use of this software."),
]
# Titles that stand alone on a line, and SPDX identifiers.
TITLES = [("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("Zlib", "zlib License"),
          ("Apache-2.0", "Apache License 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
          ("BSL-1.0", "Boost Software License - Version 1.0")]
SPDX = ["MIT", "ISC", "Zlib", "Unlicense", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "MPL-2.0", "EPL-2.0", "EUPL-1.2",
        "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
        "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0"]
NEGATIONS = frozenset(["not", "never", "nor", "no", "cannot", "neither", "isn", "aren", "wasn", "without"])

CUES = ("licen", "copyright", "spdx", "permission is hereby", "permission to use", "redistribution and use",
        "redistribute it and", "public domain", "rights reserved", "creative commons", "cc by", "cc-by", "cc0",
        "warranty")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t\r\f\v]+(?=[^\s])|\n")
_BLANK = re.compile(r"\n[ \t\r\f\v]*\n")
_WORDS = re.compile(r"[a-z]+|[0-9]+")


def words_of(text: str) -> list[str]:
    """Lower-case words and numbers; ``licence`` counts as ``license`` and
    ``v`` before a number as ``version``."""
    out = _WORDS.findall(text.lower())
    return ["license" if w == "licence" else "licensed" if w == "licenced" else
            "version" if w == "v" and i + 1 < len(out) and out[i + 1].isdigit() else w for i, w in enumerate(out)]


def lowered(text: str) -> str:
    """Lower case of the same length, so that places stay."""
    low = text.lower()
    # Lower-casing may change lengths; spans then come from the text itself.
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def sentences(text: str, start: int, end: int | None = None) -> Iterator[tuple[int, int]]:
    """Start and end of the sentences and lines with words, from ``start`` on."""
    done, end = start, len(text) if end is None else end
    for m in chain(_SENTENCE.finditer(text, start, end), [None]):
        s, e = done, m.start() if m else end
        done = m.end() if m else end
        if text[s:e].strip():
            yield s, e


def candidate_blocks(text: str) -> list[tuple[int, int]]:
    """Start and end of every run of sentences with license words."""
    low = text.lower()
    if not any(c in low for c in CUES):
        return []
    low = lowered(text)
    out, run, done = [], None, 0
    edges = {m.start() for m in _BLANK.finditer(text)}
    for m in [*_SENTENCE.finditer(text), None]:
        s, e = done, m.start() if m else len(text)
        done = m.end() if m else len(text)
        if any(c in low[s:e] for c in CUES):
            run = (run[0] if run else s, e)
        elif run:
            out.append(run)
            run = None
        if run and m and m.start() in edges:
            out.append(run)
            run = None
    return out + [run] if run else out


class Scanner:
    """Compressors with each template as a dictionary."""

    def __init__(self) -> None:
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.models, self.sizes = [], []
        lines = [(name, f"SPDX license identifier {name}", f"SPDX-License-Identifier: {name}") for name in SPDX]
        for name, must, wording in [*TEMPLATES, *lines, *((name, title, title) for name, title in TITLES)]:
            data = zstandard.ZstdCompressionDict(wording.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.models.append((name, words_of(must), words_of(wording), zstandard.ZstdCompressor(
                level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)))
            self.sizes.append(len(self.alone.compress(wording.encode())))
        self.titles = range(len(self.models) - len(TITLES), len(self.models))
        self.most_words = int((1 + MOST_DIFFERENT) * max(len(m[2]) for m in self.models)) + 1

    def reductions(self, block: str) -> list[tuple[float, int]]:
        """Share of the compressed size (of the block or the template, the
        lesser one) that each template saves, best first (ties: as listed)."""
        data = block.encode()
        size = len(self.alone.compress(data))
        return sorted((((size - len(m[3].compress(data))) / min(size, self.sizes[i]), i) for i, m in enumerate(self.models)),
                      key=lambda x: (-x[0], x[1]))

    @staticmethod
    def negated(block: str, first: int, adds: list[str]) -> bool:
        """Whether a negation stands among the words that a template does not
        have, or in its sentence before its first word."""
        place = next(islice(_WORDS.finditer(lowered(block)), first, None)).start()
        before = re.split(r"[.!?\n]", block[:place])[-1]
        return not NEGATIONS.isdisjoint(adds) or not NEGATIONS.isdisjoint(words_of(before))

    def differences(self, block: str, model: int) -> tuple[list[str], list[str], float, int, int] | None:
        """Words that the block lacks and adds inside the template's wording,
        their share, and the first and last word of the block that it takes;
        None if a distinguishing word is missing."""
        _, must, wording, _ = self.models[model]
        have = words_of(block)
        at = 0
        for w in must:
            try:
                at = have.index(w, at) + 1
            except ValueError:
                return None
        same = [m for m in difflib.SequenceMatcher(None, wording, have, autojunk=False).get_matching_blocks() if m.size]
        if not same:
            return None
        first, last = same[0].b, same[-1].b + same[-1].size
        kept_a = {i for m in same for i in range(m.a, m.a + m.size)}
        kept_b = {i for m in same for i in range(m.b, m.b + m.size)}
        lacks = [w for i, w in enumerate(wording) if i not in kept_a]
        adds = [w for i, w in enumerate(have[first:last], first) if i not in kept_b]
        return lacks, adds, (len(lacks) + len(adds)) / len(wording), first, last - 1

    def winner(self, block: str) -> dict | None:
        """The confirmed template of a block: of those with a sufficient
        reduction the one with the fewest differing words (ties: the larger
        wording, then the larger reduction)."""
        found, n = [], len(words_of(block))
        for reduction, i in self.reductions(block):
            if reduction < LEAST_REDUCTION:
                break
            diff = self.differences(block, i)
            if not diff or diff[2] > MOST_DIFFERENT or self.negated(block, diff[3], diff[1]):
                continue
            if i not in self.titles or (diff[3] == 0 and diff[4] == n - 1):
                found.append((len(diff[0]) + len(diff[1]), -len(self.models[i][2]), -reduction, i, diff))
        if not found:
            return None
        _, _, reduction, i, (lacks, adds, _, first, last) = min(found, key=lambda x: x[:4])
        return {"license": self.models[i][0], "reduction": -reduction, "lacks": " ".join(lacks), "adds": " ".join(adds),
                "same": len(self.models[i][2]) - len(lacks) - len(adds), "first": first, "last": last}

    def licenses(self, text: str, start: int, end: int, most: int) -> list[dict]:
        """What is confirmed in windows that start in ``start..end`` and end
        at ``most`` at the latest, in text order."""
        units, words, behind = [], [], 0
        for s, e in sentences(text, start, most):
            n = max(1, len(_WORDS.findall(text[s:e].lower())))
            if s >= end:
                if behind > self.most_words:
                    break
                behind += n
            units.append((s, e))
            words.append(n)
        seen = []
        for i, (s, _) in enumerate(units):
            if s >= end:
                break
            inner = 0
            for j in range(i, len(units)):
                inner += words[j - 1] if j > i + 1 else 0
                if inner > self.most_words:
                    break
                if got := self.winner(text[s:units[j][1]]):
                    seen.append((-got["same"], j - i, i, j, got))
        taken, out = set(), []
        for _, _, i, j, got in sorted(seen, key=lambda x: x[:4]):
            if not taken.isdisjoint(range(i, j + 1)):
                continue
            taken.update(range(i, j + 1))
            s, e = units[i][0], units[j][1]
            places = list(_WORDS.finditer(lowered(text[s:e])))
            a, b = s + places[got.pop("first")].start(), s + places[got.pop("last")].end()
            before, after = self.licenses(text, s, a, a), self.licenses(text, b, e, e)
            del got["same"]
            out += [*before, {"start": a if before else s, "end": b if after else e, **got}, *after]
        return sorted(out, key=lambda x: x["start"])

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """Number of candidate blocks, and what was confirmed in them."""
        spans, out, done = candidate_blocks(text), [], 0
        for s, e in spans:
            if max(s, done) < e:
                got = self.licenses(text, max(s, done), e, len(text))
                out += got
                done = max([done, *(x["end"] for x in got)])
        return len(spans), out


_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()),
                             ("reduction", pa.float64()), ("lacks", pa.string()), ("adds", pa.string())]))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_blocks, found`` for every row of ``docs`` (``doc_id, text``);
    ``found`` has the span, license, size reduction and differing words of
    every confirmed window, in text order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for lo, hi in slices([len(x) for x in texts]):
                got = [scanner.scan(x) for x in texts[lo:hi]]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array([n for n, _ in got], pa.int64()),
                    pa.array([f for _, f in got], _FOUND)], ["doc_id", "n_blocks", "found"])

    return map_arrow(
        docs.select("doc_id", "text"), run, "doc_id bigint, n_blocks bigint, found array<struct<start:int,end:int,license:string,reduction:double,"
             "lacks:string,adds:string>>")

import pytest

from upkeep.llm import licenses

SCANNER = licenses.Scanner()


@pytest.mark.parametrize("text, name", [
    ("Released under the MIT License.", "MIT"),
    ("released under the  MIT licence.", "MIT"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-NC 3.0.", None),
    ("Licensed under the Apache License, Version 1.1.", None),
    ("The driver has a license to drive.", None),
    ("All rights reserved.", "Proprietary"),
])
def test_notices(text, name):
    for before, after in (("", ""), ("Some words stand here. ", " More of them follow it."), ("x\n\n", "\ny")):
        n, found = SCANNER.scan(before + text + after)
        assert n == 1 and [f["license"] for f in found] == [name] * (name is not None)
        assert all((before + text + after)[f["start"]:f["end"]] == text for f in found)


def test_every_template_wins_its_own_wording():
    for name, _, wording in licenses.TEMPLATES:
        assert SCANNER.winner(wording)["license"] == name
        assert SCANNER.winner(wording)["lacks"] == SCANNER.winner(wording)["adds"] == ""


def test_differences_are_exact():
    got = SCANNER.winner("Released today under the MIT License.")
    assert (got["license"], got["lacks"], got["adds"]) == ("MIT", "", "today")


def test_spans_survive_lower_casing_that_changes_lengths():
    text = "İİİ words. Released under the MIT License."
    _, found = SCANNER.scan(text)
    assert text[found[0]["start"]:found[0]["end"]] == "Released under the MIT License."


def names(text):
    return [f["license"] for f in SCANNER.scan(text)[1]]


def test_every_notice_of_a_block_is_found():
    third_party = "\n".join(f"{lib} copyright 20{10 + i} {lib} authors. {notice}" for i, (lib, notice) in enumerate([
        ("alpha", "Released under the MIT License."), ("beta", "Licensed under the Apache License, Version 2.0."),
        ("gamma", "Released under the MIT License."), ("delta", "Licensed under the BSD 3-Clause License."),
        ("epsilon", "Licensed under CC BY 4.0."), ("zeta", "Licensed under the Mozilla Public License, Version 2.0.")]))
    assert names(third_party) == ["MIT", "Apache-2.0", "MIT", "BSD-3-Clause", "CC-BY-4.0", "MPL-2.0"]
    assert names("Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.") == ["Apache-2.0", "MIT"]
    assert names("licensed under the Apache License, Version 2.0, or released under the MIT License") == ["Apache-2.0", "MIT"]


def test_titles_of_pasted_bodies():
    end = ("\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and "
           "distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n  Preamble\n")
    assert names(f"  GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007{end}") == ["GPL-3.0"]
    assert names(f"  GNU LESSER GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007{end}") == ["LGPL-3.0"]
    assert names(f"  GNU AFFERO GENERAL PUBLIC LICENSE\n  Version 3, 19 November 2007{end}") == ["AGPL-3.0"]
    assert names("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser "
                 "General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, "
                 "or (at your option) any later version.") == ["LGPL-2.1-or-later"]


@pytest.mark.parametrize("text, want", [
    ("SPDX-License-Identifier: MIT", ["MIT"]), ("// SPDX-License-Identifier: Apache-2.0\ncode", ["Apache-2.0"]),
    ("# SPDX-License-Identifier: GPL-2.0-only", ["GPL-2.0-only"]), ("/* SPDX-License-Identifier: LGPL-2.1-or-later */", ["LGPL-2.1-or-later"]),
    ("This project is MIT licensed.", ["MIT"]), ("MIT License\n\nCopyright (c) 2020 A. Body", ["MIT"]),
    ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]), ("Licensed under the EUPL, Version 1.2.", ["EUPL-1.2"]),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", ["EPL-2.0"]),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
     "damages arising from the use of this software.", ["Zlib"]),
    ("This is not released under the MIT License.", []), ("This work was never licensed under the Apache License, Version 2.0.", []),
    ("It is no longer released under the MIT License. Released under the MIT License.", ["MIT"]),
    ("The MIT License is one that many people like to read about.", [])])
def test_short_forms_and_negations(text, want):
    assert names(text) == want


def test_exact_notices_of_the_tables_by_search(spark):
    """Every verbatim notice in the documents is reported at its place, and nothing elsewhere."""
    import re

    from ..conftest import SF_MID
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text")
    found = {r["doc_id"]: r["found"] for r in licenses.scan_licenses(docs).collect()}
    wordings = sorted({(w, n) for n, _, w in licenses.TEMPLATES}, key=lambda x: -len(x[0]))
    seen = 0
    for r in docs.where("text is not null").collect():
        taken, want = [], set()
        for wording, name in wordings:
            for m in re.finditer(re.escape(wording), r["text"]):
                if not any(a < m.end() and m.start() < b for a, b in taken):
                    taken.append(m.span())
                    want.add((name, *m.span()))
        assert {(f["license"], f["start"], f["end"]) for f in found[r["doc_id"]] if not f["lacks"] and not f["adds"]} >= want
        seen += len(want)
        assert bool(found[r["doc_id"]]) == bool(want)
    assert seen > 10

import math
import re

import pytest

from plexweave.llm import licences

CODE = "\n".join(f"int value{k} = compute{k}(argument{k}, other{k});" for k in range(30))
FILES = "doc_id long, path string, text string, key string"
GPL2 = """/*
 * This program is free software; you can redistribute it
 * and/or modify it under the terms of the GNU General Public
 * License as published by the Free Software Foundation;
 * either version 2 of the License, or (at your option) any
 * later version.
 */
int main() { return 0; }
""" + CODE
APACHE = """# Copyright 2020 somebody
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the
# License. You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
import os
""" + CODE
ISC = """Permission to use, copy, modify, and/or distribute this
software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this
permission notice appear in all copies."""
GPL3_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
""" + "\n\n".join(f"  {k}. Terms and more terms of a long text." for k in range(200))
ROWS = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "nothing here"), (3, "a/b/d.py", "some code that goes on and on for more words than that\nLicensed under the Apache License, Version 2.0."),
    (4, "z/e.py", "text"), (5, None, None), (6, "a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (7, "ab/f", ""), (8, "a/b/x/y/z/deep.c", "int x;"), (9, "g/two.c", GPL2),
    (10, "g/apache.py", APACHE), (11, "g/isc", ISC), (12, "top/COPYING", GPL3_FILE), (13, "top/src/lib/a/b.c", "none"), (14, "top/src/lib/a/b.c", "no licence is named"), (15, "g/prose", "we took out a licence for the dog. " * 3000),
    (16, "g/same.c", GPL2), (16, "g/same.c", GPL2), (None, "g/null", None), (17, "r/x", "Released under the ISC License"), (18, "LICENSES/x", "All rights reserved"),
]


def plain(text):
    """(licence, cosine, whether the whole file has one) by plain loops over the same segments."""
    lower = text.lower()
    stemmed = lambda s: any(x in s for x in licences.STEMS)
    if not stemmed(lower):
        return None
    units = re.split(licences._UNIT, lower)
    paragraphs = [p for p in re.split(licences._PARAGRAPH.replace("\\p{L}\\p{N}", "a-zà-öø-ÿ0-9"), lower) if stemmed(p)]
    pieces = [lower, *paragraphs]
    for i, u in enumerate(units):
        if stemmed(u):
            for first, n in licences.WINDOWS:
                start = i + first
                pieces.append(" ".join(units[max(start, 0) : max(start, 0) + n + min(start, 0)]))
    sets = [set(licences.tokens(t)) for _, t in licences.TEMPLATES]
    idf = lambda w: math.log((1 + len(sets)) / (1 + sum(w in s for s in sets))) + 1
    known = {w: idf(w) for w in set().union(*sets)}
    best, whole = (0, 0, None), False
    for k, piece in enumerate(dict.fromkeys(pieces)):
        words = set(licences.tokens(piece))
        norm = math.sqrt(sum(known.get(w, idf("")) ** 2 for w in words))
        for t, s in enumerate(sets):
            cosine = round(sum(known[w] ** 2 for w in words & s) / norm / math.sqrt(sum(known[w] ** 2 for w in s)), 9) if norm else 0
            if cosine >= licences.THRESHOLD:
                best, whole = max(best, (cosine, -t, licences.TEMPLATES[t][0])), whole or k == 0
    return (best[2], best[0], whole) if best[2] else None


@pytest.fixture(scope="module")
def found(spark):
    return licences.licence_scan(spark.createDataFrame([(*r, "x") for r in ROWS], FILES)).collect()


def test_cosines_against_plain_loops(found):
    assert len(found) == len(ROWS)
    texts = {(i, p): t for i, p, t in ROWS}
    for r in found:
        own = plain(texts[r["doc_id"], r["path"]] or "")
        assert (r["origin"] in ("file", "header")) == (own is not None), r
        if own:
            assert r["licence"] == own[0] and r["cosine"] == pytest.approx(own[1], abs=1e-8), r


def test_licences_and_inheritance(found):
    by = {r["doc_id"]: (r["licence"], r["origin"], r["from_path"]) for r in found}
    assert by[1] == ("MIT", "file", "a/LICENSE") and by[2] == ("GPL-3.0", "inherited", "a/b/LICENSE") and by[3] == ("Apache-2.0", "header", "a/b/d.py")
    assert by[4] == by[5] == by[7] == (None, "none", None) and by[None] == ("ISC", "inherited", "g/isc") and by[6] == ("GPL-3.0", "file", "a/b/LICENSE")
    assert by[8] == ("GPL-3.0", "inherited", "a/b/LICENSE")  # the nearest of two above
    assert by[9] == by[16][:2] + ("g/two.c",) and by[9][:2] == ("GPL-2.0", "header") and by[10][:2] == ("Apache-2.0", "header")
    assert by[11] == ("ISC", "file", "g/isc") and by[12] == ("GPL-3.0", "file", "top/COPYING")
    assert by[13] == by[14] == ("GPL-3.0", "inherited", "top/COPYING") and by[15] == ("ISC", "inherited", "g/isc")
    assert by[17] == ("ISC", "file", "r/x") and by[18] == ("Proprietary", "file", "LICENSES/x")


def test_empty_table(spark):
    assert licences.licence_scan(spark.createDataFrame([], FILES)).count() == 0

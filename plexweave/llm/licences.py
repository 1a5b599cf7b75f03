"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory above.

DataFrame operations only. Texts that name none of a few stems (STEMS) are passed by after one look; this is part of the
rule, as every template names one. Of the others, the segments compared are the whole file, its paragraphs (lines up to
one without letters, so comment blocks come joined), and short windows of lines and sentences around each that has a
stem, which catch notices wrapped over several lines inside other text. A word counts once in a segment, so norms and
dot products are plain sums over the words of a row: they are taken before anything is shuffled, and no text ever is.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cosine from which on a segment carries a template's licence.
THRESHOLD = 0.7
#: A file is a licence file if all of it carries a licence, or by its name.
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
#: Windows around a unit with a stem: first unit, counted from that one, and number of units.
WINDOWS = ((0, 1), (0, 2), (-1, 2), (-1, 3), (0, 4), (-2, 4), (0, 8))
_TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_UNIT = r"[\r\n]+|(?<=[.!?;])[ \t]+"
_PARAGRAPH = r"\r?\n(?:[^\p{L}\p{N}\r\n]*\r?\n)+"

# Stems of words in notices, and licences with the notices, headers and paragraphs of files that announce them.
STEMS = ("licen", "copyright", "permission", "permitted", "redistribut", "public domain", "rights reserved")
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "MIT License Copyright"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("ISC", "Released under the ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved"),
)


def tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


class TemplateWeights:
    """Inverse document frequencies over the templates, and each template's weights with norm 1."""

    def __init__(self, templates=TEMPLATES):
        self.names = [name for name, _ in templates]
        sets = [set(tokens(text)) for _, text in templates]
        words = sorted(set().union(*sets))
        self.idf = {w: math.log((1 + len(sets)) / (1 + sum(w in s for s in sets))) + 1 for w in words}
        #: the weight of a word in no template
        self.other = math.log(1 + len(sets)) + 1
        norms = [math.sqrt(sum(self.idf[w] ** 2 for w in s)) for s in sets]
        self.weights = {w: [self.idf[w] / n if w in s else 0.0 for s, n in zip(sets, norms)] for w in words}

    def table(self, spark: SparkSession) -> DataFrame:
        """token, idf, weights: as many rows as the fixed templates have words."""
        return spark.createDataFrame([(w, self.idf[w], self.weights[w]) for w in sorted(self.idf)], "token string, idf double, weights array<double>")


def _stemmed(text: Column) -> Column:
    out = F.lit(False)
    for stem in STEMS:
        out = out | F.contains(text, F.lit(stem))
    return out


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), F.lit(1)))


def segments(files: DataFrame) -> DataFrame:
    """key, segment, words: the distinct words of each segment to compare of `files` (key, text). Segment 0 is the whole file."""
    found = files.select("key", F.lower("text").alias("text")).where(_stemmed(F.col("text")))
    paragraphs = F.filter(F.split("text", _PARAGRAPH), _stemmed)
    units = F.split("text", _UNIT)
    near = found.select("key", "text", paragraphs.alias("paragraphs"), units.alias("units"))
    places = F.filter(F.transform("units", lambda u, i: F.when(_stemmed(u), i)), lambda i: i.isNotNull())

    def windows(i: Column) -> Column:
        # a window that would start before the text or reach beyond it is as one cut there
        cut = lambda first, n: F.slice("units", F.greatest(i + first + 1, F.lit(1)), F.lit(n) + F.least(i + first, F.lit(0)))
        return F.transform(F.array(*(cut(first, n) for first, n in WINDOWS)), lambda w: F.array_join(w, " "))

    pieces = F.array_distinct(F.concat("paragraphs", F.flatten(F.transform(places, windows))))
    return near.select("key", F.posexplode(F.concat(F.array("text"), pieces)).alias("segment", "piece")).select("key", "segment", _words(F.col("piece")).alias("words"))


def segment_licences(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """key, segment, licence, cosine: the best template of each segment of `files` (key, text) that reaches the threshold."""
    weights = TemplateWeights()
    template = F.broadcast(weights.table(files.sparkSession))
    each = segments(files).select("key", "segment", F.posexplode("words").alias("place", "token")).join(template, "token", "left")
    value = F.coalesce("idf", F.lit(weights.other))
    times = F.sum((F.col("place") == 0).cast("int")).alias("times")  # rows alike have one key
    dots = [F.sum(F.col("idf") * F.col("weights")[k]).alias(f"dot{k}") for k in range(len(weights.names))]
    summed = each.groupBy("key", "segment").agg(times, F.sum(value * value).alias("squares"), *dots)
    cosines = F.array(*(F.struct(F.round(F.coalesce(F.col(f"dot{k}"), F.lit(0.0)) / F.sqrt(F.col("squares") * F.col("times")), 9).alias("cosine"), F.lit(-k).alias("k"), F.lit(name).alias("licence")) for k, name in enumerate(weights.names)))
    best = summed.select("key", "segment", F.array_max(cosines).alias("b"))
    return best.where(F.col("b.cosine") >= threshold).select("key", "segment", "b.licence", "b.cosine", (-F.col("b.k")).alias("template"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def licence_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, licence, cosine, origin, from_path: the licence of each row of `files`.

    origin is `header` where a segment of the file itself carries a licence (the best cosine counts, ties go to the
    earlier template), `file` where the file is a licence file, `inherited` where the nearest directory at or above
    the file's own has a licence file (the best cosine, then the smallest path), and otherwise `none` with nulls.
    Null and empty texts have no licence of their own but inherit; a null path has no directory and inherits nothing.
    Rows that repeat a path and id are alike only if their texts are; an empty table gives an empty result; other columns
    are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(path_col), F.lit("")), text)
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), key.alias("key"))
    found = segment_licences(files.select(key.alias("key"), text.alias("text")), threshold)
    own = found.groupBy("key").agg(
        F.min_by(F.struct("licence", "cosine"), F.struct(-F.col("cosine"), F.col("template"), F.col("segment"))).alias("own"), (F.min("segment") == 0).alias("whole")
    )
    is_file = F.col("own").isNotNull() & (F.col("whole") | F.regexp_extract("path", "([^/]*)$", 1).rlike(FILE_NAME))
    narrow = rows.join(own, "key", "left").select("doc_id", "path", "own", F.coalesce(is_file, F.lit(False)).alias("is_file"), _directory(F.col("path")).alias("dir"))
    of_dir = narrow.where("is_file and path is not null").groupBy("dir").agg(F.min_by(F.struct("own", "path"), F.struct(-F.col("own.cosine"), F.col("path"))).alias("law"))
    # each directory that holds files, with all directories at or above it
    dirs = rows.where("path is not null").select(_directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n))))).alias("up")).distinct()
    nearest = above.join(of_dir.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by("law", F.length("up")).alias("law"))
    given = narrow.join(nearest, "dir", "left")
    has_own, inherits = F.col("own").isNotNull(), F.col("law").isNotNull()
    return given.select(
        "doc_id",
        "path",
        F.when(has_own, F.col("own.licence")).otherwise(F.col("law.own.licence")).alias("licence"),
        F.when(has_own, F.col("own.cosine")).otherwise(F.col("law.own.cosine")).alias("cosine"),
        F.when(has_own & F.col("is_file"), "file").when(has_own, "header").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(has_own, F.col("path")).otherwise(F.col("law.path")).alias("from_path"),
    )

"""Licence scans: TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

A notice is a line of a file or a window over the terms of the whole file, wherever it stands; a licence file is a file whose base name says so. The idf is
that of the template collection, ln((1 + templates) / (1 + df)) + 1, and words of no template weigh like words of df 0, so foreign words in a line lower
its cosine. Lines are held against all templates by a sparse join on terms.

Windows run over line ends and comment marks (these hold no term), so wrapped notices, headers, titles of licence files and notices amid other words of a line are found.
Every window that starts at a term of a template, holds an anchor term of it and has up to twice its terms is scored against it; cosines of all ends of a
start come from running sums. A window is chosen to fit, so it also must hold the names and version numbers in the template and two thirds of its distinct terms
(all, if there are five or fewer). An SPDX-License-Identifier with a known identifier scores 1. "All rights reserved" amid other words counts where nothing else is found.

Which lines need comparing follows from the weights: of each template the longest terms are its key terms (long ones are rare in texts), so many that what the others
could add stays below the threshold. A line without a key term of any template cannot reach it, so the regular expression over key terms loses nothing.

A file without a notice of its own takes the licence of the nearest ancestor directory (its own first) that has a licence file with a recognised notice.
Directories are joined by path: each distinct directory meets its ancestors, not each file.

Everything is built-in column functions. What is broadcast is the table of template terms, fixed by the templates.

Edge cases: null or empty texts have no notice. Of several notices the highest cosine wins, then the template's name, then the earliest line. Of several licence files in one
directory the smallest (path, licence) speaks. A null path has no directory and inherits nothing. Rows that share an id (or have none) share the best notice found under it. Files in no
directory belong to the root, ''. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import materialize
from .skew import heavy_keys, join_by_key

#: The short notices by which these public licences are commonly granted.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "All-Rights-Reserved": ["All rights reserved."],
}
#: Titles, headers and paragraphs of licence texts, for windows.
HEADERS = {
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": ["Apache License Version 2.0, January 2004", "Apache License 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "BSD-3-Clause": ["BSD 3-Clause License", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2", "This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": ["MIT License", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
}
#: Words of templates that name a licence; a window must hold those of its template.
NAMES = {"affero", "apache", "bsd", "cc", "creative", "gnu", "lesser", "mit", "mozilla", "nc", "noncommercial", "sa", "sharealike"}
#: SPDX identifiers in lower case.
SPDX = {x.lower(): name for name in {*TEMPLATES, *HEADERS} - {"All-Rights-Reserved"} for x in ([name, f"{name}-only", f"{name}-or-later", f"{name}+"] if "GPL" in name else [name])}
RESERVED = "All-Rights-Reserved"
#: Words so frequent in texts that they are taken as key terms last.
COMMON = {"and", "any", "are", "by", "in", "is", "of", "that", "the", "this", "to", "under", "with"}
THRESHOLD = 0.75
TERM = r"[\p{L}\p{N}]+(?:[.][0-9]+)*"
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)([.][^/]*)?$"


def _terms(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.][0-9]+)*", text.lower())


def template_vectors(templates: dict[str, list[str]] = TEMPLATES) -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """(licence, template number, term, unit weight) rows, idf by term, idf of other words."""
    texts = [(name, k, Counter(_terms(t))) for name, ts in sorted(templates.items()) for k, t in enumerate(ts)]
    df = Counter(t for *_, c in texts for t in c)
    idf = {t: math.log((1 + len(texts)) / (1 + d)) + 1 for t, d in df.items()}
    rows = []
    for name, k, c in texts:
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(name, k, t, n * idf[t] / norm) for t, n in sorted(c.items())]
    return rows, idf, math.log(1 + len(texts)) + 1


def key_terms(rows: list[tuple[str, int, str, float]], threshold: float) -> list[str]:
    """Terms one of which any line of a cosine of ``threshold`` or more must have."""
    keys = set()
    for template in {r[:2] for r in rows}:
        left = 1.0
        for _, t, w in sorted(((t in COMMON, -len(t), t), t, w) for *k, t, w in rows if tuple(k) == template):
            if left < (threshold - 1e-6) ** 2:
                break
            keys.add(t)
            left -= w * w
    return sorted(keys)


def window_templates(templates: dict[str, list[str]], threshold: float) -> list[tuple[str, str, int, int, int, list[str], list[str]]]:
    """(anchor term, licence, template number, terms, distinct terms needed, distinct terms, terms that must be there) rows; a window of ``threshold`` or more has one of the anchors."""
    rows, *_ = template_vectors(templates)
    out = []
    for name, k in sorted({r[:2] for r in rows}):
        own = sorted(t for n, i, t, _ in rows if (n, i) == (name, k))
        names = set(own) & NAMES
        must = names | {t for t in own if names and re.fullmatch(r"\d(\.\d)*", t)} | ({"license"} & set(own) if "mit" in names else set())
        anchors = [max(must, key=lambda t: (len(t), t))] if must else key_terms([r for r in rows if r[:2] == (name, k)], threshold)
        need = len(own) if len(own) <= 5 else math.ceil(2 * len(own) / 3)
        out += [(a, name, k, len(_terms(templates[name][k])), need, own, sorted(must)) for a in anchors]
    return out


def window_notices(files: DataFrame, id_col: str, text_col: str, templates: dict[str, list[str]], threshold: float) -> DataFrame:
    """``(id, license, score, line_no)`` of the windows of whole files that hold a template."""
    spark = files.sparkSession
    rows, idf, other = template_vectors(templates)
    table = window_templates(templates, threshold)
    reach = 2 * max(r[3] for r in table)
    anchors = sorted({r[0] for r in table})
    pattern = r"(?iU)(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, anchors)) + r")(?![\p{L}\p{N}])"
    every = F.flatten(F.transform(F.split(text_col, "\n", -1), lambda line, n: F.transform(F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0)), lambda t: F.struct(t.alias("term"), n.alias("line")))))
    # The same text under the same id gives the same windows; its hash tells apart the texts of one id.
    tokens = files.filter(F.col(text_col).rlike(pattern)).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), every.alias("ts"))
    at = F.filter(F.transform("ts", lambda t, i: F.struct(t["term"].alias("anchor"), i.alias("at"))), lambda t: t["anchor"].isin(anchors))
    near = F.transform(at, lambda a: F.struct(a["anchor"].alias("anchor"), a["at"].alias("at"), F.greatest(a["at"] - reach, F.lit(0)).alias("first"), F.slice("ts", F.greatest(a["at"] - reach, F.lit(0)) + 1, F.lit(2 * reach)).alias("near")))
    known = F.broadcast(spark.createDataFrame(table, "anchor string, license string, template int, n int, need int, own array<string>, must array<string>"))  # a row for each anchor of a template
    found = tokens.select("id", "h", F.explode(near).alias("a")).select("id", "h", "a.*").join(known, "anchor")
    lo = F.greatest(F.col("at") - 2 * F.col("n") + 1, F.lit(0))
    around = F.slice("near", (lo - F.col("first") + 1).cast("int"), 4 * F.col("n"))
    found = found.select("id", "h", "at", "license", "template", "n", "need", "own", "must", lo.alias("lo"), around.alias("ts"))
    found = found.filter((F.size(F.array_intersect(F.col("ts.term"), "own")) >= F.col("need")) & (F.size(F.array_except("must", F.col("ts.term"))) == 0))
    starts = found.select("*", F.posexplode("ts").alias("k", "t")).filter((F.col("lo") + F.col("k") <= F.col("at")) & F.array_contains("own", F.col("t.term")))
    starts = starts.select("id", "h", "license", "template", "need", "must", (F.col("lo") + F.col("k")).alias("start"), F.col("t.line").alias("line_no"), F.slice("ts", F.col("k") + 1, 2 * F.col("n")).alias("ts"))
    starts = starts.filter((F.size(F.array_except("must", F.col("ts.term"))) == 0)).dropDuplicates(["id", "h", "license", "template", "start"])
    words = starts.select("id", "h", "license", "template", "need", "must", "start", "line_no", F.posexplode("ts.term").alias("k", "term"))
    weights = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))  # a row for each term of the templates
    vectors = F.broadcast(spark.createDataFrame(rows, "license string, template int, term string, w double"))
    words = words.join(weights, "term", "left").join(vectors, ["license", "template", "term"], "left").withColumn("idf", F.coalesce("idf", F.lit(other)))
    one = ["id", "h", "license", "template", "start"]
    words = words.withColumn("c", F.row_number().over(Window.partitionBy(*one, "term").orderBy("k")) - 1)
    to_here = Window.partitionBy(*one).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    new = (F.col("c") == 0) & F.col("w").isNotNull()
    sums = words.select(
        "id", "license", "line_no", "need", F.size("must").alias("musts"),
        F.sum(F.col("idf") * F.coalesce("w", F.lit(0.0))).over(to_here).alias("dot"), F.sum(F.col("idf") * F.col("idf") * (2 * F.col("c") + 1)).over(to_here).alias("squares"),
        F.sum(new.cast("int")).over(to_here).alias("held"), F.sum((new & F.array_contains("must", F.col("term"))).cast("int")).over(to_here).alias("held_must"),
    ).withColumn("score", F.col("dot") / F.sqrt("squares"))
    return sums.filter((F.col("score") >= threshold) & (F.col("held") >= F.col("need")) & (F.col("held_must") == F.col("musts"))).select("id", "license", F.round("score", 6).alias("score"), "line_no")


def spdx_notices(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, license, score, line_no)`` of lines with a known SPDX identifier."""
    mark = r"(?i)SPDX-License-Identifier:[ \t(]*([A-Za-z0-9.+-]+)"
    lines = files.filter(F.col(text_col).rlike(mark)).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    name = F.create_map(*(F.lit(x) for kv in sorted(SPDX.items()) for x in kv))[F.lower(F.regexp_extract("line", mark, 1))]
    return lines.filter(F.col("line").rlike(mark)).select("id", name.alias("license"), F.lit(1.0).alias("score"), "line_no").filter("license is not null")


def notices(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(id, license, score, line_no)`` of the best notice of each id that has one."""
    spark = files.sparkSession
    rows, idf, other = template_vectors(templates)
    pattern = r"(?iU)(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, key_terms(rows, threshold))) + r")(?![\p{L}\p{N}])"
    lines = files.filter(F.col(text_col).rlike(pattern)).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    terms = lines.filter(F.col("line").rlike(pattern)).select("id", "line_no", F.xxhash64("line").alias("line"), F.explode(F.regexp_extract_all(F.lower("line"), F.lit(TERM), F.lit(0))).alias("term"))
    counts = terms.groupBy("id", "line_no", "line", "term").agg(F.count("*").alias("n"))
    weights = F.broadcast(spark.createDataFrame([(t, w) for t, w in idf.items()], "term string, idf double"))  # a row for each term of the templates
    vectors = F.broadcast(spark.createDataFrame(rows, "license string, template int, term string, w double"))
    weighed = counts.join(weights, "term", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(other)))
    norms = weighed.groupBy("id", "line_no", "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "x"))).alias("known"))
    dots = norms.select("id", "line_no", "line", "norm", F.explode("known").alias("k")).select("*", "k.term", "k.x").join(vectors, "term")
    scores = dots.groupBy("id", "line_no", "line", "norm", "license", "template").agg((F.sum(F.col("x") * F.col("w")) / F.col("norm")).alias("score"))
    good = scores.filter(F.col("score") >= threshold).select("id", "license", F.round("score", 6).alias("score"), "line_no", F.lit(0).alias("last"))
    both = {name: [*templates.get(name, []), *(HEADERS.get(name, []) if templates is TEMPLATES else [])] for name in ({*templates, *HEADERS} if templates is TEMPLATES else templates)}
    wide = window_notices(files, id_col, text_col, both, threshold).union(spdx_notices(files, id_col, text_col))
    good = good.union(wide.withColumn("last", (F.col("license") == RESERVED).cast("int")))
    best = good.groupBy("id").agg(F.min(F.struct("last", (-F.col("score")).alias("s"), "license", "line_no")).alias("b"))
    return best.select("id", "b.license", (-F.col("b.s")).alias("score"), "b.line_no")


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), "")


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", **options) -> DataFrame:
    """``(id, path, license, origin, score, line_no, license_dir)`` of every file; origin is own, inherited or none."""
    found = materialize(notices(files, id_col, text_col, **options), "notices")
    own = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), directory(F.col(path_col)).alias("dir"))
    own = own.join(found.withColumnRenamed("id", "found_id"), F.col("id").eqNullSafe(F.col("found_id")), "left").drop("found_id")

    speakers = own.filter(F.col("license").isNotNull() & F.col("path").rlike(LICENSE_FILE))
    granted = speakers.groupBy(F.col("dir").alias("up")).agg(F.min(F.struct("path", "license")).alias("g")).select("up", F.col("g.license").alias("granted"))
    dirs = own.filter("license is null and dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("up")))
    ups = dirs.select("dir", F.explode(chain).alias("c")).select("dir", "c.depth", "c.up")
    near = ups.join(granted, "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "granted")).alias("g")).select("dir", F.col("g.up").alias("up"), F.col("g.granted").alias("granted"))
    counts = materialize(own.filter("dir is not null").groupBy("dir").agg(F.count("*").alias("m")), "directories")
    out = join_by_key(own, near, "dir", "id", heavy_keys(counts, "dir"), "left")
    taken = F.col("license").isNull() & F.col("granted").isNotNull()
    return out.select(
        F.col("id").alias(id_col), F.col("path").alias(path_col), F.coalesce("license", "granted").alias("license"),
        F.when(F.col("license").isNotNull(), "own").when(taken, "inherited").otherwise("none").alias("origin"), "score", "line_no", F.when(taken, F.col("up")).alias("license_dir"),
    )

"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Header statements (every line, and every run of lines between empty ones, that speaks of licensing) and
licence files (the whole text) become sparse TF-IDF vectors; their cosine to each template is a join on
terms and a grouped sum.  Templates are statements, and the full texts in ``license_texts``, each group with
its own document frequencies.  An SPDX tag counts as a statement of score 1.  Of what is over the threshold,
full texts come before statements and "All rights reserved" comes last; the best is a file's own licence.  A file without one takes that of the nearest ancestor
directory that holds a licence file with one: directories are exploded into their ancestors, joined
to the licensed directories, and the nearest wins.

Scale: the templates are a fixed list, so their term table is broadcast.  Only texts with a
licensing word are taken apart.  Inheritance works on distinct directories (grouped before the
shuffle); the join back to files is left to AQE, which splits a directory with a third of all files.

Defined results: null and empty texts have no licence of their own; a null path is the root's
nameless file; equal rows get equal results; ties go to the earlier template, then the smaller id.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az, text_of

THRESHOLD = 0.7
NO_ID = -(1 << 62)  # stands for a null id in joins; the lowest bit of a row's hash tells it from a real one
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
CUE = r"licen[cs]e|copyright|spdx|rights reserved|hereby granted|redistribut|public domain|cc by|cc0"
LICENSE_FILE = r"(^|/)([Ll][Ii][Cc][Ee][Nn][CScs][Ee]|COPYING|NOTICE)([._-][^/]*)?$"

# Fixed template statements, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
]

# Full texts, by SPDX identifier.  Headers repeat the paragraphs of the shortest one.
FULL_TEXTS = [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
LONG_TEMPLATES = [*FULL_TEXTS, *((n, q) for n, t in FULL_TEXTS if n == "MIT" for q in t.strip().split("\n\n"))]
SPDX_TAG = r"(?i)spdx-license-identifier:[ \t]*([a-z0-9.+(-][a-z0-9.+()-]*(?:[ \t]+(?:and|or|with)[ \t]+[a-z0-9.+()-]+)*)"
SPDX_NAMES = {n.lower(): n for n, _ in [*TEMPLATES, *FULL_TEXTS]}
DECORATION = r"(?m)^[\s&&[^\n]]*[#/*;!%<>\"'-]*[\s&&[^\n]]*|[\s&&[^\n]]*[*/#>-]*[\s&&[^\n]]*$"


def spdx_license(tag: Column) -> Column:
    """The licence of an SPDX tag: a known identifier in its usual spelling, with or without version range, or the tag's own words."""
    known = F.create_map(*[F.lit(x) for kv in SPDX_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.regexp_replace(F.lower(tag), r"(-only|-or-later|\+)$", "")), tag)


def template_vectors(templates=TEMPLATES):
    """(rows template, license, term, weight of its unit vector; idf by term; idf of a term in no template)."""
    counts = [Counter(re.findall(TERM, text.lower())) for _, text in templates]
    seen = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in seen.items()}
    rows = []
    for i, ((name, _), c) in enumerate(zip(templates, counts)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(i, name, t, n * idf[t] / norm) for t, n in sorted(c.items())]
    return rows, idf, math.log(1 + len(templates)) + 1


def own_licenses(files: DataFrame, *, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, h, license, score of every file (doc_id, path, h, text) with a licence of its own."""
    low = lower_az(F.col("text"))
    speaks = files.where(low.rlike(CUE)).withColumn("low", low)
    runs = F.split(F.regexp_replace("low", DECORATION, ""), "\n{2,}")
    units = speaks.withColumn("units", F.concat(F.filter(F.split("low", "\n"), lambda x: x.rlike(CUE)), F.filter(runs, lambda x: x.rlike(CUE)),
                                                F.when(F.col("path").rlike(LICENSE_FILE), F.array("low")).otherwise(F.array())))
    key = ["doc_id", "path", "h"]
    # equal units of a file count once
    units = units.select(*key, F.explode(F.array_distinct("units")).alias("unit"))
    units = units.select(*key, F.xxhash64("unit").alias("unit"), F.explode(F.regexp_extract_all("unit", F.lit(TERM), F.lit(0))).alias("term"))
    tf = units.groupBy(*key, "unit", "term").agg(F.count("*").alias("tf"))
    scored = [_scores(tf, key, templates, 0), _scores(tf, key, LONG_TEMPLATES, len(FULL_TEXTS))]
    tags = speaks.select(*key, F.explode(F.regexp_extract_all("text", F.lit(SPDX_TAG), F.lit(1))).alias("tag"))
    scored.append(tags.select(*key, F.lit(0).alias("full"), F.lit(0).alias("template"), spdx_license(F.col("tag")).alias("license"),
                              F.lit(1.0).alias("score")))
    scored = reduce(DataFrame.unionByName, scored).where(F.col("score") >= threshold)
    best = scored.groupBy(*key).agg(F.max(F.struct((F.col("license") != "Proprietary").alias("specific"), "full", "score",
                                                   (-F.col("template")).alias("t"), "license")).alias("b"))
    return best.select(*key, "b.license", "b.score")


def _scores(tf: DataFrame, key: list[str], templates: list, full: int) -> DataFrame:
    """key, full (1 for one of the first ``full`` templates), template, license, score: cosines of the units in ``tf``
    (key, unit, term, tf) to the templates they share a term with."""
    spark = tf.sparkSession
    rows, idf, other = template_vectors(templates)
    vectors = spark.createDataFrame(rows, "template int, license string, term string, weight double")
    weights = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    # both tables hold the fixed templates' terms only
    tf = tf.join(F.broadcast(weights), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norms = tf.groupBy(*key, "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
                                         F.collect_list(F.struct("term", "w")).alias("terms"))
    dots = norms.select(*key, "unit", "norm", F.explode("terms").alias("x")).select(*key, "unit", "norm", "x.term", "x.w").join(
        F.broadcast(vectors), "term")
    dots = dots.groupBy(*key, "unit", "template", "license", "norm").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    return dots.select(*key, (F.col("template") < full).cast("int").alias("full"), "template", "license",
                       F.round(F.col("dot") / F.col("norm"), 6).alias("score"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, **options) -> DataFrame:
    """doc_id, path, own_license, own_score, license, origin (own, inherited, none), license_dir of every row of
    ``files`` (doc_id, path, text)."""
    f = files.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("doc_id").isNull().cast("long").alias("none"), F.coalesce("path", F.lit("")).alias("path"), text_of("text").alias("text"))
    f = f.withColumns({"h": F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("none")), "dir": directory(F.col("path"))})
    own = own_licenses(f.select("doc_id", "path", "h", "text"), **options)
    given = own.where(F.col("path").rlike(LICENSE_FILE)).withColumn("dir", directory(F.col("path")))
    given = given.groupBy(F.col("dir").alias("g_dir")).agg(F.max(F.struct("score", F.bitwise_not("doc_id").alias("i"), "license")).alias("g"))
    dirs = f.select("dir").distinct()
    # a/b/c -> a/b/c, a/b, a, (root): nearest first
    parts = F.split("dir", "/")
    up = dirs.withColumn("a", F.explode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))))
    near = up.join(given, F.col("a") == F.col("g_dir")).groupBy("dir").agg(
        F.max(F.struct(F.length("a").alias("n"), "a", F.col("g.license").alias("license"))).alias("near"))
    out = (f.drop("text", "none").join(own, ["doc_id", "path", "h"], "left").join(near, "dir", "left"))
    return out.select(
        F.when(F.col("h").bitwiseAND(F.lit(1)) == 0, F.col("doc_id")).alias("doc_id"), "path", F.col("license").alias("own_license"), F.col("score").alias("own_score"),
        F.coalesce("license", "near.license").alias("license"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNull(), F.col("near.a")).alias("license_dir"))


def document_paths(docs: DataFrame) -> DataFrame:
    """``documents`` as a file tree: source/lang/thousand/name, every fiftieth id a licence file."""
    name = F.when(F.col("doc_id") % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), name).alias("path"))

"""License scans: TF-IDF cosine to templates and inheritance along directories, in DataFrame expressions.

A file's segments are its sentences and lines, its runs of as many words as a
template has, each held against that template (across line and sentence ends, so
a wrapped notice is found whole; comment marks are no words), and the whole
file.  A segment's cosine to a template uses term counts times the inverse
document frequency over all files (terms of no template weigh as if one file
held them).  A file whose
whole text is close enough to a template is a licence file and speaks for its
directory; a file with a close segment has a licence header; any other file
takes the licence of its nearest ancestor directory that has one.

The templates are a fixed, small list, so their vectors are literals.  A
cosine is at most the length of that part of a template's unit vector whose
terms the text holds, so a text whose terms make up too little of every
template is out of reach; this is tested before anything is exploded.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.shared import materialize

# fixed values: public licence notices
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
HEADER = 0.75      # least cosine of a header segment
SALT = 32          # parts of a directory in the join to its licence
LICENCE_FILE = 0.5  # least cosine of a whole licence file


def terms_of(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def _terms(text: Column) -> Column:
    return F.split(F.lower(text), "[^a-z0-9]+")


def idf(n: int, df: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


def document_frequencies(files: DataFrame, templates=TEMPLATES) -> tuple[int, dict[str, int]]:
    """(files, files that hold each template term), over whole texts of all files."""
    vocabulary = sorted({t for _, x in templates for t in terms_of(x)})
    seen = F.array_intersect(_terms(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, vocabulary)))
    rows = files.select(F.explode_outer(F.concat(seen, F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()
    found = {r["term"]: r["count"] for r in rows}  # at most one row per template term
    return found.pop("", 0), {t: found.get(t, 0) for t in vocabulary}


def heavy_terms(vectors: list[dict[str, float]], least: float) -> list[str]:
    """Terms one of which any segment of cosine ``least`` or more must hold: the light ones left out
    of a template's unit vector have length below ``least`` together."""
    out = set()
    for v in vectors:
        short = 0.0
        for t, x in sorted(v.items(), key=lambda i: (i[1], i[0])):
            short += x * x
            if math.sqrt(short) >= least - 1e-9:
                out.add(t)
    return sorted(out)


def _closest(segments: DataFrame, keys: list[str], table: DataFrame, other: float, names: list[str]) -> DataFrame:
    """``keys`` and best (far = -cosine, license_id) of each segment's ``text``: one row per distinct term
    of a segment, met with the terms' weights (a table of template terms only).  A segment whose key ``only``
    is a template's number is held against that one alone."""
    counts = segments.select(*keys, F.explode(_terms(F.col("text"))).alias("term")).filter("term != ''").groupBy(
        *keys, "term").agg(F.count(F.lit(1)).alias("n"))
    weighed = counts.join(F.broadcast(table), "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(other)))
    dots = weighed.groupBy(*keys).agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"),
        *(F.sum(F.col("w") * F.coalesce(f"v{k}", F.lit(0.0))).alias(f"d{k}") for k in range(len(names))))
    near = F.array(*(F.struct((-F.round(F.col(f"d{k}") / F.col("length"), 6)).alias("far"), F.lit(name).alias("license_id"))
                     for k, name in enumerate(names)))
    return dots.select(*keys, F.when(F.col("only").isNull(), F.array_min(near)).otherwise(F.get(near, F.col("only"))).alias("best"))


def _shares(text: Column, vectors: list[dict[str, float]]) -> Column:
    """For each template, the squared length of the part of its unit vector whose terms ``text`` holds."""
    squares = {t: [v.get(t, 0.0) ** 2 for v in vectors] for t in sorted({t for v in vectors for t in v})}
    known = F.map_from_arrays(F.array(*map(F.lit, squares)), F.array(*(F.array(*map(F.lit, x)) for x in squares.values())))
    held = F.array_intersect(_terms(text), F.array(*map(F.lit, squares)))
    return F.aggregate(held, F.array(*(F.lit(0.0) for _ in vectors)), lambda a, t: F.zip_with(a, F.try_element_at(known, t), lambda x, y: x + y))


def _reached(share: Column, least: float) -> Column:
    return share >= (least - 1e-6) ** 2  # scores are rounded to six digits


def _runs(text: Column, shares: Column, vectors: list[dict[str, float]], sizes: list[int], weight: dict[str, float], other: float,
          least: float) -> tuple[Column, Column]:
    """(words, runs): the words of ``text`` with their weights, and, of a column ``words`` that holds them, the runs of
    words that can reach ``least``, each with its template's number.

    A template's runs have as many words as the template, or all if there are fewer.  Each word adds its share to the
    product with the template, and its squared weight to the squared length, which repeats only make longer."""
    known = F.map_from_arrays(F.array(*map(F.lit, weight)), F.array(*(
        F.struct(F.lit(x * x).alias("square"), F.array(*(F.lit(x * v.get(t, 0.0)) for v in vectors)).alias("dots")) for t, x in weight.items())))
    rare = F.struct(F.lit(other * other).alias("square"), F.array(*(F.lit(0.0) for _ in vectors)).alias("dots"))
    terms = F.filter(_terms(text), lambda t: t != "")
    words = F.transform(terms, lambda t: F.struct(t.alias("t"), F.coalesce(F.try_element_at(known, t), rare).alias("w")))
    n, runs = F.size("words"), []
    for k, size in enumerate(sizes):  # Spark's functions call the inner ones at once
        def within(p: Column) -> Column:
            return F.sequence(p, F.least(p + size, n) - 1)

        def close(p: Column) -> Column:
            total = F.aggregate(within(p), F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("square")), lambda a, i: F.struct(
                (a.dot + F.col("words")[i].w.dots[k]).alias("dot"), (a.square + F.col("words")[i].w.square).alias("square")))
            return F.aggregate(F.array(total), F.lit(False), lambda _, x: x.dot >= (least - 1e-6) * F.sqrt(x.square))

        starts = F.when(_reached(shares[k], least) & (n > 0), F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))))
        starts = F.filter(F.coalesce(starts, F.array().cast("array<int>")), close)
        runs.append(F.transform(starts, lambda p: F.struct(
            F.lit(True).alias("header"), F.lit(k).alias("only"), F.array_join(F.transform(within(p), lambda i: F.col("words")[i].t), " ").alias("text"))))
    return words, F.concat(*runs)


def scan(files: DataFrame, templates=TEMPLATES, header: float = HEADER, licence_file: float = LICENCE_FILE) -> DataFrame:
    """The columns of ``files`` (with path and text) but text, plus license_id, score and origin
    ('file', 'header') of the file's own licence, null where it has none.

    The best template wins, whole files before headers, ties by license_id.  Null texts have none;
    rows that repeat a path and text repeat the result."""
    n, df = document_frequencies(files, templates)
    weight = {t: idf(n, d) for t, d in df.items()}
    names, vectors = [k for k, _ in templates], []
    for _, text in templates:
        own = terms_of(text)
        v = {t: own.count(t) * weight[t] for t in set(own)}
        length = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / length for t, x in v.items()})
    # term, idf and the term's weight in each template: at most one row per template term
    table = files.sparkSession.createDataFrame(
        [(t, x, *(v.get(t, 0.0) for v in vectors)) for t, x in sorted(weight.items())],
        "term string, idf double, " + ", ".join(f"v{k} double" for k in range(len(vectors))))
    some, other = F.array(*map(F.lit, heavy_terms(vectors, header - 1e-6))), idf(n, 1)

    keyed = files.select("path", F.xxhash64("text").alias("key"), "text", _shares(F.col("text"), vectors).alias("shares")).filter(
        F.exists("shares", lambda x: _reached(x, min(header, licence_file))))
    lines = F.filter(F.split(F.regexp_replace("text", r"([.!?])[ \t\r]+", "$1\n"), "\n"), lambda s: F.arrays_overlap(_terms(s), some))
    words, runs = _runs(F.col("text"), F.col("shares"), vectors, [len(terms_of(x)) for _, x in templates], weight, other, header)
    none = F.lit(None).cast("int").alias("only")
    lines = F.transform(lines, lambda s: F.struct(F.lit(True).alias("header"), none, s.alias("text")))
    heads = F.array_distinct(F.concat(lines, runs))
    whole = F.filter(F.array(F.struct(F.lit(False).alias("header"), none, F.col("text").alias("text"))),
                     lambda _: F.exists("shares", lambda x: _reached(x, licence_file)))
    # a generator keeps the words from being split anew at every use
    keyed = keyed.select("path", "key", "text", "shares", F.inline(F.array(F.struct(words.alias("words")))))
    segments = keyed.select("path", "key", F.inline(F.concat(heads, whole))).withColumn("segment", F.xxhash64("text"))
    # rows that repeat a path and text multiply all counts of a segment alike, which leaves its cosine
    near = _closest(segments, ["path", "key", "header", "only", "segment"], table, other, names)
    near = near.filter(-F.col("best.far") >= F.when(F.col("header"), header).otherwise(licence_file))
    own = near.groupBy(F.col("path").alias("_path"), F.col("key").alias("_key")).agg(F.min(F.struct("header", "best")).alias("_own"))
    keep = [c for c in files.columns if c != "text"]
    rows = files.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(keep)], "path", F.xxhash64("text").alias("key"))
    found = rows.join(own, rows.path.eqNullSafe(own._path) & (rows.key == own._key), "left")
    return found.select(
        *[F.col(f"_c{k}").alias(c) for k, c in enumerate(keep)], F.col("_own.best.license_id").alias("license_id"),
        (-F.col("_own.best.far")).alias("score"),
        F.when(F.col("_own").isNotNull(), F.when(F.col("_own.header"), "header").otherwise("file")).alias("origin"))


def parent(path: Column) -> Column:
    """The directory of a path; '' is the root."""
    return F.when(F.instr(path, "/") == 0, "").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def inherit(scanned: DataFrame) -> DataFrame:
    """``scanned`` with licences inherited: license_id, score, origin ('inherited' where taken over) and
    licensed_by (the directory whose licence file spoke, null for own licences or none).

    A directory's licence is that of its closest licence file, ties by license_id.  A null path
    inherits nothing.  Directories are joined to their ancestors, never files to files."""
    at = scanned.withColumn("_dir", parent(F.col("path")))
    spoken = at.filter("origin = 'file' AND _dir IS NOT NULL").groupBy("_dir").agg(
        F.min(F.struct((-F.col("score")).alias("far"), "license_id")).alias("best")).select(
        F.col("_dir").alias("ancestor"), F.col("best.license_id").alias("theirs"), (-F.col("best.far")).alias("their_score"))
    parts = F.split("_dir", "/")
    up = F.concat(F.array(F.lit("")), F.when(F.col("_dir") == "", F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))
    dirs = at.filter("_dir IS NOT NULL").select("_dir").distinct().select("_dir", F.posexplode(up).alias("depth", "ancestor"))
    nearest = dirs.join(spoken, "ancestor").groupBy("_dir").agg(F.max(F.struct("depth", "ancestor", "theirs", "their_score")).alias("near"))
    own = F.col("license_id").isNotNull()
    # a directory may hold a third of all files: its one row is repeated, and its files are dealt by path as well
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt")
    at = at.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALT)).cast("int"))
    return at.join(nearest.select("*", salt), ["_dir", "_salt"], "left").select(
        *[c for c in scanned.columns if c not in ("license_id", "score", "origin")],
        F.coalesce("license_id", "near.theirs").alias("license_id"), F.coalesce("score", "near.their_score").alias("score"),
        F.when(own, F.col("origin")).when(F.col("near").isNotNull(), "inherited").alias("origin"),
        F.when(~own, F.col("near.ancestor")).alias("licensed_by"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, path, license_id, score, origin, licensed_by of every row; a document's path is
    source/lang/doc_id, null parts left out."""
    files = docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return inherit(materialize(scan(files), "licence-scan"))

"""Licence notices found by MinHash bands over overlapping windows, then checked by exact containment.

Texts and templates are lower-cased and split at white space and ASCII punctuation; shingles are five words. A template
of T shingles is looked for in windows of T + s shingles that start at every multiple of s = ceil(T / 4), so every
passage of its length lies in one window whole. Band k of a set is its shingle that is nearest to the k-th of BANDS fixed
numbers, by exclusive or of the hashes: a min-wise choice. A window is a candidate for a template if one of their bands
is the same shingle. A window that holds 80% of a template's shingles has a Jaccard similarity of at least
0.8 T / (T + s + 0.2 T), 0.36 or more, and each band misses it with a probability of at most 1 - 0.36: all BANDS of them
do with one below 1e-6 at 32.

Only windows around the shingle that is a template's band can have it as theirs, so bands are looked up by their shingle
first, and the bands of those windows are then worked out: the same candidates as if all windows had been banded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.storage import materialize

WIDTH = 5
BANDS = 32
LEAST = 80  # percent
SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bands of up to this many templates are looked up as a set in the program and broadcast; more are joined by shuffles.
TEMPLATES_AT_ONCE = 2_000
#: Shingles of a text that are looked at in one row, at least.
PIECE = 1024
#: Public notices by licence; fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MIT", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "waived all copyright and related or neighboring rights to this work"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPLIT), lambda w: w != "")


_SHINGLES = f"case when size(_words) < {WIDTH} then cast(array() as array<bigint>) else transform(sequence(0, size(_words) - {WIDTH}), i -> xxhash64({', '.join(f'get(_words, i + {k})' for k in range(WIDTH))})) end"
#: The fixed number of band k.
_POINT = "xxhash64({k}, 'band')"


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, notice string")


def template_table(templates: DataFrame) -> DataFrame:
    """license, shingles, t (distinct shingles), step of templates (license, notice). Those shorter than a shingle, and null ones, find nothing."""
    rows = templates.select(F.col("license").cast("string").alias("license"), _words(F.col("notice")).alias("_words"))
    rows = rows.select("license", F.expr(f"array_distinct({_SHINGLES})").alias("shingles")).filter("size(shingles) > 0")
    return rows.select("license", "shingles", F.size("shingles").alias("t"), F.ceil(F.size("shingles") / 4).cast("int").alias("step"))


def band(shingles: str, k: str) -> Column:
    """The distance of the nearest shingle to the point of band k: the smallest of the shingles mixed with it, as unsigned numbers would be."""
    return F.expr(f"array_min(transform({shingles}, x -> (x ^ {_POINT.format(k=k)})))")


def _pieces(docs: DataFrame, widest: int) -> DataFrame:
    """doc_id, _row, base, lo, h: each text's shingles in rows of bounded size, with the widest window's margin on both sides.

    h begins with shingle base of the text, and the piece's own begin at lo in h.
    """
    own = max(PIECE, 4 * widest)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _words(F.col("text")).alias("_words"))
    # A row's own number tells repeated rows apart, and as it isn't deterministic no filter is moved below it, where
    # Spark would put the words' expression into the shingles' and split the text again for each of them.
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.expr(_SHINGLES).alias("_h"))

    def cut(i: Column) -> Column:
        base = F.greatest(i - widest, F.lit(0))
        return F.struct(base.alias("base"), (i - base).alias("lo"), F.slice("_h", base + 1, i - base + own + widest).alias("h"))

    starts = F.sequence(F.lit(0), F.greatest(F.size("_h") - 1, F.lit(0)), F.lit(own))
    # Of an outer explode Spark infers no filter on the array's size, which would make the array twice.
    return rows.select("doc_id", "_row", F.explode_outer(F.transform(starts, cut)).alias("p")).select("doc_id", "_row", "p.base", "p.lo", "p.h")


def _with_places(pieces: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """pieces with places: where in h a wanted shingle stands."""
    if few:
        known = [r["shingle"] for r in wanted.collect()]  # BANDS for each of TEMPLATES_AT_ONCE at most
        places = F.filter(F.transform("h", lambda x, i: F.when(x.isin(known), i).otherwise(-1)), lambda i: i >= 0)
        return pieces.withColumn("places", places)
    pieces = materialize(pieces, "licence-pieces")
    found = pieces.select("_row", "base", F.posexplode("h").alias("at", "shingle")).join(wanted, "shingle", "left_semi")
    return pieces.join(found.groupBy("_row", "base").agg(F.collect_list("at").alias("places")), ["_row", "base"])


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, license, n_windows (windows that hold a template of the licence), n_common (most shingles found of one).

    templates: license, notice; by default the notices above. One row for each doc_id and licence found; rows that share
    a doc_id count together. Null, empty and short texts find nothing, nor do empty tables. Other columns are ignored.
    """
    known = materialize(template_table(default_templates(docs.sparkSession) if templates is None else templates), "licence-templates")
    count, widest = known.agg(F.count("*"), F.coalesce(F.max(F.col("t") + F.col("step")), F.lit(1))).first()
    banded = known.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).withColumn("least", band("shingles", "k"))
    banded = banded.select("license", "shingles", "t", "step", "k", "least", F.expr(f"least ^ {_POINT.format(k='k')}").alias("shingle"))
    few = count <= TEMPLATES_AT_ONCE
    pieces = _with_places(_pieces(docs, widest), banded.select("shingle").distinct(), few)
    inside = F.filter("places", lambda i: (i >= F.col("lo")) & (i < F.col("lo") + max(PIECE, 4 * widest)))
    hits = pieces.select("doc_id", "_row", "base", "h", F.explode_outer(inside).alias("at")).filter("at is not null")
    around = F.slice("h", F.greatest(F.col("at") - widest, F.lit(0)) + 1, F.lit(2 * widest))
    hits = hits.select("doc_id", "_row", F.get("h", F.col("at")).alias("shingle"), (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.greatest(F.col("at") - widest, F.lit(0))).alias("base"), around.alias("h"))
    hits = hits.join(F.broadcast(banded) if few else banded, "shingle")
    # The windows that hold the place, each with its own shingles only.
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - (F.col("t") + F.col("step") - 1)) / F.col("step"))).cast("int")
    numbers = F.sequence(first, F.floor(F.col("at") / F.col("step")).cast("int"))
    cut = F.transform(numbers, lambda i: F.struct((i * F.col("step")).alias("start"), F.slice("h", i * F.col("step") - F.col("base") + 1, F.col("t") + F.col("step")).alias("_w")))
    windows = hits.select("doc_id", "_row", "license", "shingles", "t", "k", "least", F.explode_outer(cut).alias("w")).select("*", "w.start", "w._w")
    candidates = windows.filter(band("_w", "k") == F.col("least"))
    common = F.size(F.array_intersect(F.array_distinct("_w"), "shingles"))
    checked = candidates.withColumn("common", common).filter(100 * F.col("common") >= LEAST * F.col("t"))
    once = checked.groupBy("doc_id", "_row", "license", "t", "start").agg(F.max("common").alias("common"))
    return once.groupBy("doc_id", "license").agg(F.count("*").alias("n_windows"), F.max("common").cast("long").alias("n_common"))

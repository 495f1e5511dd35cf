"""Licence scan: normalised texts and lines against licence templates by the Dice coefficient of word bigrams.

Each text gives itself and its lines as units. A unit whose number of bigrams lies outside the bounds
that the threshold sets for every template cannot match and is dropped before its bigrams are spread.
The rest meet the templates through an inverted index of template bigrams, a table of fixed size.
Bounds on the number of words spare the bigrams of most whole texts. Everything is SQL functions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Notices as their licences give them.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-1.0": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: Column) -> Column:
    """The normalised words of a text: runs of ASCII letters and digits of the text in lower case."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def bigrams(own: Column) -> Column:
    """64-bit hashes of the distinct pairs of neighbouring words."""
    n = F.greatest(F.size(own) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(own, 1, n), F.slice(own, 2, n), lambda a, b: F.xxhash64(a, b)))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, size, bigram): one row per template and distinct bigram."""
    rows = spark.createDataFrame(list(templates.items()), "license string, template string")
    rows = rows.select("license", bigrams(words(F.col("template"))).alias("own"))
    return rows.select("license", F.size("own").alias("size"), F.explode("own").alias("bigram"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, score, n_units): per document the best template, its Dice coefficient and the units that match any.

    Documents without a match have a null licence, score 0.0 and n_units 0. Rows of one doc_id (a null
    one too) are one document; null texts are empty; ties of score go to the smaller licence name. A unit
    with one word or none never matches. Columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    table = template_table(spark, TEMPLATES if templates is None else templates)
    sizes = [r["size"] for r in table.select("license", "size").distinct().collect()]  # one per template
    ratio = (2 - threshold) / threshold

    def possible(own: Column) -> Column:
        fits = F.lit(False)
        for size in sorted(set(sizes)):
            fits = fits | F.size(own).between(size / ratio - 1e-9, size * ratio + 1e-9)
        return fits

    low, high = min(sizes, default=0) / ratio, max(sizes, default=0) * ratio

    def bounded(own: Column) -> Column:
        # A unit has at most as many bigrams as words and, up to one, at least as many as distinct words.
        return (F.size(own) > low - 1e-9) & ((F.size(own) <= high + 1) | (F.size(F.array_distinct(own)) <= high + 1))

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), words)
    # Filtering a one-element array names a value, so that it is computed once.
    parts = F.transform(F.array(lines), lambda x: F.when(F.size(x) > 1, F.concat(F.array(F.flatten(x)), x)).otherwise(x))[0]
    numbered = F.filter(F.transform(parts, lambda own, unit: F.struct(unit.alias("unit"), own.alias("own"))), lambda u: bounded(u["own"]))
    units = docs.select("doc_id", F.explode(numbered).alias("u")).select("doc_id", F.col("u.unit").alias("unit"), F.col("u.own").alias("words"))
    units = units.select("doc_id", "unit", F.explode(F.filter(F.array(bigrams(F.col("words"))), possible)).alias("own"))
    spread = units.select("doc_id", "unit", F.size("own").alias("n"), F.explode("own").alias("bigram"))
    joined = spread.join(F.broadcast(table), "bigram").where(
        (F.col("n") >= F.col("size") / ratio - 1e-9) & (F.col("n") <= F.col("size") * ratio + 1e-9)
    )
    scored = (
        joined.groupBy("doc_id", "unit", "license", "n", "size").agg(F.count("*").alias("common"))
        .select("doc_id", "unit", "license", (2.0 * F.col("common") / (F.col("n") + F.col("size"))).alias("score"))
        .where(F.col("score") >= threshold)
    )
    best = scored.groupBy("doc_id").agg(
        F.max("score").alias("score"),
        F.min(F.struct((-F.col("score")).alias("s"), "license")).getField("license").alias("license"),
        F.countDistinct("unit").alias("n_units"),
    )
    ids = docs.select("doc_id").distinct()
    return ids.join(best, ids["doc_id"].eqNullSafe(best["doc_id"]), "left").select(
        ids["doc_id"], "license", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"),
    )

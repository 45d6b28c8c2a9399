"""License scans, in DataFrame functions only.

Overlapping windows of a text's five-word shingles are min-hashed; bands of one minimum
each retrieve templates, and exact shingle containment in the document verifies them.

A template of m shingles is sought in windows of W shingles, the power of two from 2m to
4m, at strides of W / 2, so one window holds the whole of it and has a similarity of m / W >=
1/4 with it. `MINIMA` = 48 bands of one minimum each then collide with a probability of at
least 1 - (3/4)**48 = 0.999999, and with four fifths of the template's shingles left
1 - (4/5)**48 = 0.99998.

A window's minimum can only equal a template's where the window holds the very shingle that
attains the template's. So only windows that hold such a shingle are min-hashed: the others
collide in no band. A row is decided where it is read, without a join or a shuffle.

Edge cases: null, empty and short texts hold no license, and a text of fewer than five words
is one shingle, as is such a template; repeated rows and rows that repeat an id or have none
are decided one by one; a template that stands twice is one license, at its first window;
very long texts are scanned whole; names are sorted, which settles ties; other columns of the
table are never read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
MINIMA = 48
#: Public license notices, as their stewards word them.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-2.0": "licensed under the GNU General Public License, version 2",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "CC-BY-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
}
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _CAPITALS, _SMALL), F.lit("[a-z0-9]+"), F.lit(0))


def shingle_hashes(w: Column) -> Column:
    """Hashes of all runs of SHINGLE words; the whole text where it has fewer."""
    n = F.size(w)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))
    return F.when(n > 0, many).otherwise(F.array().cast("array<bigint>"))


def minima(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(MINIMA)), lambda k: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, k))))


def _library(spark, templates: dict[str, str]) -> list:
    """(template, t: its shingles, w: size of its windows, m: its minima, top: the shingles that attain them); a constant of the program."""
    size = F.size("t")
    table = spark.createDataFrame(list(templates.items()), "template string, text string")
    table = table.select("template", F.array_distinct(shingle_hashes(words(F.col("text")))).alias("t"))
    table = table.select("template", "t", F.pow(F.lit(2.0), F.ceil(F.log2(2 * size))).cast("int").alias("w"), minima(F.col("t")).alias("m"))
    attains = F.filter("t", lambda x: F.exists(F.sequence(F.lit(1), F.lit(MINIMA)), lambda k: F.xxhash64(x, k) == F.element_at("m", k)))
    return table.select("*", attains.alias("top")).orderBy("template").collect()


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: tuple[int, int] = (4, 5)) -> DataFrame:
    """Per document row: doc_id, matches (array of template, word: start of the first window that retrieved it), by template."""
    num, den = containment
    library = _library(docs.sparkSession, templates or TEMPLATES)
    longs = lambda x: F.array(*[F.lit(v).cast("long") for v in x])
    known = F.array(*[F.struct(F.lit(r["template"]).alias("template"), longs(r["t"]).alias("t"), F.lit(r["w"]).alias("w"), longs(r["m"]).alias("m")) for r in library])
    wanted, top = sorted({x for r in library for x in r["t"]}), sorted({x for r in library for x in r["top"]})

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.select("doc_id", words(F.col("text")).alias("words")).select("doc_id", shingle_hashes(F.col("words")).alias("s"))
    at = F.filter(F.transform("s", lambda x, i: F.when(x.isin(top), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "s", at.alias("at"))

    def starts(w: int) -> Column:
        """Windows of w shingles that hold a place, at strides of half of w."""
        half = max(w // 2, 1)
        own = F.flatten(F.transform("at", lambda p: F.array(F.floor(p / half), F.floor(p / half) - 1)))
        return F.transform(F.array_distinct(F.filter(own, lambda g: g >= 0)), lambda g: F.struct(F.lit(w).alias("w"), (g * half).cast("int").alias("from")))

    hashed = F.transform(F.concat(*[starts(w) for w in sorted({r["w"] for r in library})]), lambda x: F.struct(x["w"].alias("w"), x["from"].alias("from"), minima(F.slice("s", x["from"] + 1, x["w"])).alias("m")))
    held = F.array_distinct(F.filter("s", lambda x: x.isin(wanted)))
    some = F.size("at") > 0
    rows = rows.select("doc_id", F.when(some, hashed).alias("windows"), F.when(some, held).alias("held"))

    def collides(x: Column, t: Column) -> Column:
        return (x["w"] == t["w"]) & F.exists(F.zip_with(x["m"], t["m"], lambda a, b: a == b), lambda e: e)

    def match(t: Column) -> Column:
        retrieved = F.filter("windows", lambda x: collides(x, t))
        verified = den * F.size(F.array_intersect(t["t"], "held")) >= num * F.size(t["t"])
        return F.when((F.size(retrieved) > 0) & verified, F.struct(t["template"].alias("template"), F.array_min(F.transform(retrieved, lambda x: x["from"])).alias("word")))

    found = F.filter(F.transform(known, match), lambda x: x.isNotNull())
    none = F.array().cast("array<struct<template:string,word:int>>")
    return rows.select("doc_id", F.coalesce(F.when(F.col("windows").isNotNull(), found), none).alias("matches"))


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, template, word: verified matches only, one row per document row and template."""
    return license_matches(docs, templates, id_col, text_col, containment).select("doc_id", F.inline("matches"))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_licenses, licenses (template names, sorted, comma-joined; empty if none)."""
    names = F.array_sort(F.transform("matches", lambda x: x["template"]))
    return license_matches(docs, templates, id_col, text_col).select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"))

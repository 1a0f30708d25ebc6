"""Licence scans: TF-IDF cosine of passages to licence templates, then inheritance along directories.

A passage is a line that holds a word of the licence trade. Its words' TF-IDF vector is compared with each template's,
all within the row, in DataFrame functions. A file's own licence is that of its best passage at or above LEAST. Where no
line reaches it, the file is read across lines: an SPDX identifier, a licence's title at its head, or the best window of a
template's length, laid over the text's words so that a trade word meets one of the template's. A file is
a licence file if its name says so, or if its best passage makes up FILE_SHARE of its words; a directory's licence is that
of its licence file (the first by path, if there are several). Files without their own take the licence of the nearest
ancestor directory that has one: their directories are exploded without texts and joined to the licensed ones.

IDF counts templates, so scores depend on no other file. Versions of one licence share their wording: a passage counts for
a version only if it holds the version's number. A passage is judged in time linear in its words (but for a sort), however
long a line is. Defined cases: a null or empty text has no licence of its own but
inherits; a null path has no directories; equal scores go to the earlier template; rows with equal paths are judged each;
other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: How licences are named in notices and how their texts begin.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0, a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright: CC0 1.0 Universal, public domain"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "Copyright, all rights reserved"),
)
#: Licences whose versions share their wording, so a passage must hold the version's number.
VERSIONS = {"GPL-3.0": "3", "GPL-2.0": "2", "LGPL-3.0": "3", "AGPL-3.0": "3"}
#: A passage holds one of these.
TRADE = r"(?i)licen[cs]e|copyright|permission|redistribut|public domain|spdx"
NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"
#: Words of the trade by themselves; where windows are laid.
ANCHOR = r"licen[cs]e|copyright|permission|redistribut|^domain$"
#: How whole licence texts are headed, as words.
TITLES = (
    ("Apache-2.0", "apache license version 2 0"),
    ("MIT", "mit license copyright"),
    ("BSD-3-Clause", "bsd 3 clause license"),
    ("GPL-3.0", "gnu general public license version 3"),
    ("GPL-2.0", "gnu general public license version 2"),
    ("LGPL-3.0", "gnu lesser general public license version 3"),
    ("AGPL-3.0", "gnu affero general public license version 3"),
    ("MPL-2.0", "mozilla public license version 2 0"),
    ("ISC", "isc license copyright"),
    ("CC-BY-4.0", "attribution 4 0 international"),
    ("CC-BY-SA-4.0", "attribution sharealike 4 0 international"),
    ("CC-BY-NC-4.0", "attribution noncommercial 4 0 international"),
    ("CC0-1.0", "cc0 1 0 universal"),
)
#: Titles that hold no word of the trade.
HEADS = r"(?i)^\W*(creative commons\W+)?(attribution|cc0)\b"
SPDX = r"(?i)spdx-license-identifier:([^\n]*)"
LEAST = 0.7
FILE_SHARE = 0.25
WORD = r"[a-z0-9]+"


def template_vectors() -> tuple[list[dict[str, float]], dict[str, float], float]:
    """Unit vectors of the templates, the IDF of their words, and the IDF of any other word."""
    words = [re.findall(WORD, t.lower()) for _, t in TEMPLATES]
    held = Counter(w for ws in words for w in set(ws))
    idf = {w: math.log((1 + len(words)) / (1 + n)) + 1 for w, n in held.items()}
    out = []
    for ws in words:
        v = {w: n * idf[w] for w, n in Counter(ws).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({w: round(x / norm, 12) for w, x in sorted(v.items())})
    return out, {w: round(x, 12) for w, x in sorted(idf.items())}, round(math.log(1 + len(words)) + 1, 12)


def _literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _of_version(words: Column, name: Column) -> Column:
    """Whether words hold the number that a licence's name calls for, if any."""
    return F.coalesce(F.array_contains(words, _literal_map(VERSIONS)[name]), F.lit(True))


def _squares(words: Column) -> Column:
    """The sum of squared frequencies, from the runs of the sorted words: linear but for the sort."""
    step = F.struct(F.lit("").alias("w"), F.lit(0.0).alias("n"), F.lit(0.0).alias("total"))

    def add(s: Column, w: Column) -> Column:
        same = s["w"] == w
        return F.struct(w.alias("w"), F.when(same, s["n"] + 1).otherwise(1.0).alias("n"), (s["total"] + F.when(same, 2 * s["n"] + 1).otherwise(1.0)).alias("total"))

    return F.aggregate(F.array_sort(words), step, add, lambda s: s["total"])


def best_passage(text: Column) -> Column:
    """(score, -template, words) of the text's best passage, null without passages."""
    vectors, idf, other = template_vectors()
    weight = _literal_map(idf)
    vocabulary = F.array(*(F.lit(w) for w in idf))
    templates = F.array(*(F.struct(_literal_map(v).alias("v"), F.lit(n).alias("name")) for v, (n, _) in zip(vectors, TEMPLATES, strict=True)))

    def of_words(words: Column) -> Column:
        known = F.filter(words, lambda w: F.array_contains(vocabulary, w))
        # as many terms as the templates have words, at most, however long the passage
        terms = _let(known, lambda ks: F.transform(F.array_distinct(ks), lambda w: F.struct(w.alias("w"), ((F.size(ks) - F.size(F.array_remove(ks, w))) * weight[w]).alias("v"))))
        strange = _squares(F.filter(words, lambda w: ~F.array_contains(vocabulary, w))) * (other * other)
        norm = _let(terms, lambda ts: F.sqrt(strange + F.aggregate(ts, F.lit(0.0), lambda s, t: s + t["v"] * t["v"])))

        def scored(x: Column) -> Column:
            met = F.transform(templates, lambda m, i: F.struct(F.round(F.try_divide(F.aggregate(x["terms"], F.lit(0.0), lambda s, t: s + t["v"] * F.coalesce(m["v"][t["w"]], F.lit(0.0))), x["norm"]), 6).alias("score"), (-i).alias("order"), F.size(words).alias("words"), m["name"].alias("name")))
            best = F.array_max(F.transform(F.filter(met, lambda m: _of_version(words, m["name"])), lambda m: F.struct(m["score"].alias("score"), m["order"].alias("order"), m["words"].alias("words"))))
            return best

        return _let(F.struct(terms.alias("terms"), norm.alias("norm")), scored)

    def judged(passage: Column) -> Column:
        return _let(F.regexp_extract_all(F.lower(passage), F.lit(WORD), F.lit(0)), of_words)

    passages = F.filter(F.split(text, "\n"), lambda p: F.rlike(p, F.lit(TRADE)))
    return F.when(F.rlike(text, F.lit(TRADE)), F.array_max(F.transform(passages, judged)))


def _first(name: str) -> int:
    return next(i for i, (n, _) in enumerate(TEMPLATES) if n == name)


def _identified(text: Column) -> Column:
    """(1, -template, words) of the first SPDX identifier that has a template, else null."""
    order = _literal_map({n.lower(): -_first(n) for n in dict(TEMPLATES)})
    said = F.regexp_extract_all(F.lower(F.array_join(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), " ")), F.lit(r"[a-z0-9.+-]+"), F.lit(0))
    known = F.array_compact(F.transform(said, lambda w: order[F.regexp_replace(w, r"(-only|-or-later|\+)$", "")]))
    return F.when(F.size(known) > 0, F.struct(F.lit(1.0).alias("score"), F.element_at(known, 1).alias("order"), F.lit(4).alias("words")))


def _titled(words: Column) -> Column:
    """(1, -template, words) of the title that the words begin with, else null."""
    head = F.regexp_replace(F.concat(F.array_join(F.slice(words, 1, 12), " "), F.lit(" ")), "^(the |creative commons )", "")
    return F.coalesce(*(F.when(F.startswith(head, F.lit(t + " ")), F.struct(F.lit(1.0).alias("score"), F.lit(-_first(n)).alias("order"), F.lit(len(t.split())).alias("words"))) for n, t in TITLES))


def _windowed(words: Column) -> Column:
    """(score, -template, words) of the best window, null without trade words."""
    vectors, idf, other = template_vectors()
    weight, templates = _literal_map(idf), F.array(*map(_literal_map, vectors))
    parts = [re.findall(WORD, t.lower()) for _, t in TEMPLATES]
    places = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(o).alias("o"), F.lit(len(ws)).alias("n")) for i, ws in enumerate(parts) for o, w in enumerate(ws) if re.search(ANCHOR, w)))

    def judged(window: Column, i: Column) -> Column:
        def score(terms: Column) -> Column:
            vector = F.element_at(templates, i + 1)
            norm = F.sqrt(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["v"] * t["v"]))
            return F.round(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["v"] * F.coalesce(vector[t["w"]], F.lit(0.0))) / norm, 6)

        terms = F.transform(F.array_distinct(window), lambda w: F.struct(w.alias("w"), (F.size(F.filter(window, lambda x: x == w)) * F.coalesce(weight[w], F.lit(other))).alias("v")))
        of = _of_version(window, F.element_at(F.array(*(F.lit(n) for n, _ in TEMPLATES)), i + 1))
        return F.struct(F.when(of, _let(terms, score)).alias("score"), (-i).alias("order"), F.size(window).alias("words"))

    def over(at: Column) -> Column:
        return F.array_max(F.transform(places, lambda p: _let(F.slice(words, F.greatest(F.lit(1), at - p["o"]), p["n"]), lambda window: judged(window, p["i"]))))

    anchors = F.filter(F.transform(words, lambda w, k: F.when(F.rlike(w, F.lit(ANCHOR)), k + 1)), lambda k: k.isNotNull())
    return F.array_max(F.transform(anchors, over))


def beyond_lines(text: Column) -> Column:
    """(score, -template, words) of what a text says across lines, null if nothing."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.coalesce(_identified(text), _let(words, lambda ws: F.coalesce(_titled(ws), _windowed(ws))))


def licensed(files: DataFrame) -> DataFrame:
    """Rows (doc_id, path, license, how, score, license_dir) for files (doc_id, path, text)."""
    text = common.text_of()
    names = F.array(*(F.lit(n) for n, _ in TEMPLATES))
    size = F.when(F.rlike(text, F.lit(TRADE)), F.size(F.split(F.trim(text), r"\s+")))
    judged = files.select("doc_id", "path", text.alias("text"), best_passage(text).alias("line"), size.alias("words"))
    wider = F.rlike("text", F.lit(TRADE)) | F.rlike("text", F.lit(HEADS))
    best = F.when(F.col("line.score") >= LEAST, F.col("line")).when(wider, beyond_lines(F.col("text")))
    judged = judged.select("doc_id", "path", best.alias("best"), "words")
    own = F.col("best.score") >= LEAST
    judged = judged.select(
        "doc_id",
        "path",
        F.when(own, F.element_at(names, 1 - F.col("best.order"))).alias("own"),
        F.when(own, F.col("best.score")).alias("score"),
        F.coalesce(own & (F.rlike("path", F.lit(NAMES)) | (F.col("best.words") >= FILE_SHARE * F.col("words"))), F.lit(False)).alias("licence_file"),
    )
    judged = common.stored(judged, "own-licences")
    parts = F.split("path", "/")
    place = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    given = judged.filter("licence_file AND path IS NOT NULL").groupBy(place.alias("dir")).agg(F.min_by("own", F.struct("path", "own")).alias("given"))
    bare = judged.filter("own IS NULL")
    levels = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))
    homes = bare.filter("path IS NOT NULL").select(place.alias("home"), F.explode(levels).alias("at")).select("home", "at.depth", "at.dir").distinct()
    nearest = homes.join(given, "dir").groupBy("home").agg(F.max_by(F.struct("given", "dir"), "depth").alias("near"))
    heirs = bare.withColumn("home", place).join(nearest, "home", "left")
    heirs = heirs.select("doc_id", "path", F.col("near.given").alias("license"), F.when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("how"), F.lit(None).cast("double").alias("score"), F.col("near.dir").alias("license_dir"))
    owners = judged.filter("own IS NOT NULL").select("doc_id", "path", F.col("own").alias("license"), F.lit("own").alias("how"), "score", F.lit(None).cast("string").alias("license_dir"))
    return owners.unionByName(heirs)


def document_files(docs: DataFrame) -> DataFrame:
    """documents as files in directories of one to five levels: source/language, then up to three decimal parts of the id."""
    deep = F.pmod(F.col("doc_id"), F.lit(4))
    parts = [F.when(deep > k, F.floor(F.col("doc_id") / size).cast("string")) for k, size in enumerate((10_000, 1000, 100))]
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), *parts, F.col("doc_id").cast("string")).alias("path"), "text")

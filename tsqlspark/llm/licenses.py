"""License scan with a positional index of rare tokens, in DataFrame functions throughout.

The words that few templates have are posted with their positions.  Every place of a posted word in a file is looked
up, each (file position, template position) pair votes for the place where the template would begin, and every place on
which enough distinct rare words agree is a candidate.  It counts once the
template's mandatory key phrases stand where the place puts them, give or take ``SLACK`` words.

The index is a literal of a few hundred words, fixed by the templates.  Files are scanned where they lie, without a
shuffle; those in which no key phrase can stand are told apart by one regular expression.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the templates in which a word may be and still count as rare.
MOST_TEMPLATES = 0.25
#: Votes of distinct words that make a candidate, as a share of the template's rare words, and the least number.
LEAST_SHARE, LEAST_VOTES = 0.3, 3
#: Words by which a key phrase may be off its place.
SLACK = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Phrases of the base scan and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Label, notice or opening text of the licence, key phrases that must stand in it.
TEMPLATES = [
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["gnu affero general public license"]),
    ("apache", "Licensed under the Apache License, Version 2.0", ["under the apache license"]),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', ["apache license version 2 0", "in compliance with the license"]),
    ("apache", 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.', ["as defined by sections 1 through 9 of this document"]),
    ("artistic", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.", ["establishes the terms under which"]),
    ("boost", "Distributed under the Boost Software License, Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["boost software license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ["redistribution and use in source and binary forms", "provided that the following conditions are met"]),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["used to endorse or promote products"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ["creative commons attribution 4 0"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0", ["cc by nc nd"]),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0", ["cc by nc sa"]),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ["cc by nd"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.", ["waived all copyright and related or neighboring rights"]),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", ["eclipse public license"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ["under the gnu general public license"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["terms of the gnu general public license", "published by the free software foundation"]),
    ("gpl", "GNU General Public License Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it.", ["gnu general public license version 2 june 1991", "designed to take away your freedom to share and change it"]),
    ("gpl", "GNU General Public License Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.", ["gnu general public license version 3 29 june 2007", "copyleft license for software and other kinds of works"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["permission to use copy modify and or distribute this software for any purpose"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ["gnu lesser general public license"]),
    ("lgpl", "GNU Lesser General Public License Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.", ["gnu lesser general public license version 3 29 june 2007", "supplemented by the additional permissions listed below"]),
    ("mit", "Released under the MIT License.", ["under the mit license"]),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so', ["permission is hereby granted free of charge to any person obtaining a copy", "to deal in the software without restriction"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ["mozilla public license"]),
    ("mpl", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.', ["each individual or legal entity that creates contributes to the creation of or owns covered software"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ["free and unencumbered software released into the public domain"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications", ["in no event will the authors be held liable"]),
]


def words_of(text: str) -> list[str]:
    return re.findall(WORD + "+", text.translate(str.maketrans(UPPER, LOWER)))


class Index:
    """Postings of the rare words and key phrases of the templates."""

    def __init__(self, templates: list[tuple[str, str, list[str]]] = TEMPLATES):
        self.labels = [t[0] for t in templates]
        self.words = [words_of(t[1]) for t in templates]
        self.phrases = [[(p.split(), self._place(w, p.split())) for p in t[2]] for t, w in zip(templates, self.words, strict=True)]
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, words in enumerate(self.words):
            for q, w in enumerate(words):
                self.postings[w].append((n, q))
        # only rare words are posted
        self.postings = {w: p for w, p in self.postings.items() if len({n for n, _ in p}) <= MOST_TEMPLATES * len(templates)}
        self.rare = [len(set(words) & self.postings.keys()) for words in self.words]

    @staticmethod
    def _place(words: list[str], phrase: list[str]) -> int:
        return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)

    def literal(self) -> Column:
        """Map from word to postings."""
        entries = ", ".join(f"struct('{w}', array({', '.join(f'struct({n} as t, {q} as q)' for n, q in p)}))" for w, p in sorted(self.postings.items()))
        return F.expr(f"map_from_entries(array({entries}))")

    def possible(self) -> str:
        """A regular expression that every text with a key phrase of a template or of the base scan meets."""
        keys = set()
        for phrase in [p for ps in self.phrases for p, _ in ps] + [b[0].split() for b in BASE]:
            longest = max(phrase, key=len)
            keys.add(longest if len(longest) >= 6 else f"{GAP}+".join(phrase[:2]))
        return "(?i)" + "|".join(sorted(keys))


def _before(items: Column, at: Column) -> Column:
    """The item before index ``at``, null for the first."""
    return F.get(items, at - 1)


def _best_place(index: Index, n: int) -> Column:
    """Of the ``places`` of template ``n`` with enough votes and all key phrases the one with most votes: (votes, -place)."""
    least = min(index.rare[n], max(LEAST_VOTES, math.ceil(LEAST_SHARE * index.rare[n])))

    def stands(x: Column) -> Column:
        holds = (x["t"] == n) & (x["votes"] >= least)
        for phrase, q in index.phrases[n]:
            low = F.greatest(x["place"] + (q - SLACK), F.lit(0))
            near = F.concat(F.lit(" "), F.array_join(F.slice("words", low + 1, F.greatest(x["place"] + (q + SLACK + len(phrase)) - low, F.lit(0))), " "), F.lit(" "))
            holds = holds & F.contains(near, F.lit(f" {' '.join(phrase)} "))
        return holds

    return F.array_max(F.transform(F.filter("places", stands), lambda x: F.struct(x["votes"].alias("votes"), (-x["place"]).alias("back"))))


def scan(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) for each row (doc_id, text).

    ``matches``: (label, start word, share of the template's words that agree) of the templates found, each at the place
    with the most votes of those where its key phrases stand, the earliest on a tie.  Labels are distinct and sorted.
    ``score`` is the largest share, 0 without a match.  Null texts have no words; rows that repeat a document are scanned
    alike; other columns are ignored; an empty table gives an empty result.
    """
    index = index or Index()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(ANY_CASE_WORD + "+")).cast("long").alias("n_words"), F.when(F.col("text").rlike(index.possible()), F.translate("text", UPPER, LOWER)).alias("low"))
    # the pieces between a phrase's places tell their number and the words before the first and after the last
    patterns = [f"(?<!{WORD}){f'{GAP}+'.join(phrase.split())}(?!{WORD})" for phrase, _ in BASE]
    rows = rows.select("*", *[F.split("low", pattern, -1).alias(f"p{n}") for n, pattern in enumerate(patterns)])
    count = F.lit(WORD + "+")
    columns = [F.col("doc_id"), F.col("n_words"), F.col("low")]
    for n, (phrase, _) in enumerate(BASE):
        pieces = F.col(f"p{n}")
        some = F.size(pieces) > 1
        columns += [
            F.when(some, F.size(pieces) - 1).otherwise(0).cast("long").alias(f"n{n}"),
            F.when(some, F.regexp_count(F.element_at(pieces, 1), count)).cast("long").alias(f"f{n}"),
            F.when(some, F.col("n_words") - len(phrase.split()) - F.regexp_count(F.element_at(pieces, -1), count)).cast("long").alias(f"l{n}"),
        ]
    rows = rows.select(*columns).withColumn("words", F.regexp_extract_all("low", count, F.lit(0)))
    looked_up = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("p"), F.try_element_at(index.literal(), w).alias("at"))), lambda x: x["at"].isNotNull())
    cast_votes = F.flatten(F.transform(looked_up, lambda x: F.transform(x["at"], lambda y: F.struct(y["t"].alias("t"), (x["p"] - y["q"]).alias("place"), x["w"].alias("w")))))
    # each column below is named more than once where it is used, so the optimizer doesn't move it into a lambda
    rows = rows.withColumn("cast", F.array_sort(cast_votes))
    rows = rows.withColumn("votes", F.filter("cast", lambda v, i: ~v.eqNullSafe(_before(F.col("cast"), i))))
    # where the votes for a place begin; the next beginning tells how many they are
    agree = lambda v, u: v["t"].eqNullSafe(u["t"]) & v["place"].eqNullSafe(u["place"])
    begins = F.filter(F.transform("votes", lambda v, i: F.when(~agree(v, _before(F.col("votes"), i)), F.struct(v["t"].alias("t"), v["place"].alias("place"), i.alias("at")))), lambda x: x.isNotNull())
    rows = rows.withColumn("begins", begins)
    rows = rows.withColumn("places", F.transform("begins", lambda x, i: F.struct(x["t"].alias("t"), x["place"].alias("place"), (F.coalesce(F.get("begins", i + 1)["at"], F.size("votes")) - x["at"]).alias("votes"))))
    best = [_best_place(index, n) for n in range(len(index.words))]
    rows = rows.withColumn("best", F.when(F.size("places") > 0, F.array(*best)))
    found = []
    for n, distinct in enumerate(index.rare):
        at = F.col("best")[n]
        found.append(F.when(at.isNotNull(), F.struct(F.lit(index.labels[n]).alias("label"), F.greatest(-at["back"], F.lit(0)).cast("long").alias("start"), (at["votes"] / float(distinct)).alias("share"))))
    rows = rows.withColumn("matches", F.coalesce(F.when(F.col("best").isNotNull(), F.array_compact(F.array(*found))), F.expr("cast(array() as array<struct<label:string,start:bigint,share:double>>)")))
    base = F.array_compact(F.array(*[F.when(F.col(f"n{n}") > 0, F.lit(label)) for n, (_, label) in enumerate(BASE)]))
    rows = rows.withColumn("base", F.array_sort(F.array_distinct(base)))
    every = F.array_sort(F.array_union("base", F.transform("matches", lambda m: m["label"])))
    return rows.select(
        "doc_id", "n_words",
        sum((F.col(f"n{n}") for n in range(1, len(BASE))), F.col("n0")).alias("n_base"),
        F.least(*[f"f{n}" for n in range(len(BASE))]).alias("first_word"),
        F.greatest(*[f"l{n}" for n in range(len(BASE))]).alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
        "matches",
    )

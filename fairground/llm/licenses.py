"""Licence scanning by a positional rare-token index over licence notices. Columns only."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairground.llm.common import scratch

#: Phrases whose every place is reported, with their labels (fixed values). No two can overlap.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices of public licences (fixed values): label, words of the notice, key phrases that must occur.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "to any person obtaining a copy"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["except in compliance with the license", "apache org licenses license 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ["attribution noncommercial"]),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ["attribution sharealike"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee is hereby granted"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission is hereby granted free of charge", "merge publish distribute sublicense and or sell copies"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions of source code must retain", "redistributions in binary form must reproduce"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ["for any purpose with or without fee is hereby granted", "disclaims all warranties"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ["alter it and redistribute it freely"]),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", ["person or organization obtaining a copy", "use reproduce display distribute execute and transmit"]),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["governing permissions and limitations under the license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license", "free software foundation"]),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["mozilla public license", "mozilla org mpl 2 0"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["anyone is free to copy modify publish use compile sell or distribute"]),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ["changing it is allowed as long as the name is changed"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
]

#: Share of a notice's weight that must align.
COVERAGE = 0.6

_WORD, _GAP = r"[0-9A-Za-z\x{80}-\x{10FFFF}]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _as_pattern(phrases: list[str]) -> str:
    """Where one of the phrases stands as whole consecutive words, A-Z as a-z."""
    return rf"(?i)(?<!{_WORD})(?:" + "|".join(p.replace(" ", f"{_GAP}++") for p in phrases) + rf")(?!{_WORD})"


def _n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{_WORD}++"))


def _vocabulary() -> list[str]:
    """The words that are looked up: those of the notices, but for very short ones outside of key phrases."""
    keys = {w for _, _, phrases in TEMPLATES for p in phrases for w in p.split()}
    return sorted({w for _, notice, _ in TEMPLATES for w in notice.split() if len(w) > 3} | keys | {w for p in PHRASES for w in p.split()})


def postings(weights: dict[str, float]) -> list[tuple[str, int, int, float, bool]]:
    """word, template, at, weight, rare: where the notices have their words.

    Of each notice, the words of highest inverse document frequency are its rare ones, so many that the
    others weigh less than COVERAGE of it: a file that holds that much of a notice holds a rare one."""
    out = []
    for t, (_, notice, _) in enumerate(TEMPLATES):
        placed = [(w, at) for at, w in enumerate(notice.split()) if w in weights]
        whole, left = sum(weights[w] for w, _ in placed), sum(weights[w] for w, _ in placed)
        for w, at in sorted(placed, key=lambda x: (-weights[x[0]], x[1])):
            rare = left >= COVERAGE * whole * (1 - 1e-9)
            left -= weights[w]
            out.append((w, t, at, weights[w] / whole, rare))
    return out


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of every row, from one pass over its text: doc_id, place (a number of its own), n_words, spots
    (word and pos of the words that are looked up), and first, last and labels of the places of PHRASES."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("place"), text.alias("text"))
    # lower() may turn a sign outside of ASCII into a letter, never a word into two
    rows = rows.withColumn("words", F.split(F.lower("text"), f"{_GAP}+", -1))
    lead = (F.get("words", F.lit(0)) == "").cast("int")
    trail = ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")
    spots = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), (i - lead).alias("pos"))), lambda s: s["word"].isin(_vocabulary()))
    rows = rows.select("doc_id", "place", "text", (F.size("words") - lead - trail).cast("long").alias("n_words"), spots.alias("spots"))
    # every phrase holds one of these words
    pattern, told = _as_pattern(list(PHRASES)), ["mit", "apache", "nc"]
    likely = F.exists("spots", lambda s: s["word"].isin(told))
    places = F.when(likely, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    rows = rows.withColumn("places", F.when(F.size(places) > 0, places))
    pieces = F.when(F.col("places").isNotNull(), F.split("text", pattern, -1))
    rows = rows.withColumn("ends", F.when(F.col("places").isNotNull(), F.struct(F.get(pieces, F.lit(0)).alias("first"), F.element_at(pieces, -1).alias("last"))))
    return rows.select(
        "doc_id", "place", "n_words", "spots", F.greatest(F.size("places"), F.lit(0)).cast("long").alias("n_base"), _n_words(F.col("ends.first")).cast("long").alias("first_word"),
        (F.col("n_words") - _n_words(F.col("ends.last")) - _n_words(F.element_at("places", -1))).cast("long").alias("last_word"),
        F.coalesce(F.sort_array(F.array_distinct(F.transform("places", _by_label))), F.array().cast("array<string>")).alias("base"),
    )


def _by_label(match: Column) -> Column:
    """The label of a place of a phrase, told by its first word."""
    label = F.lit(None).cast("string")
    for phrase, name in PHRASES.items():
        label = F.when(F.startswith(F.lower(match), F.lit(phrase.split()[0])), F.lit(name)).otherwise(label)
    return label


def word_weights(scanned: DataFrame) -> dict[str, float]:
    """The inverse document frequency of every word that is looked up: one number for each, whatever the
    size of the table."""
    present = F.array_distinct(F.transform("spots", lambda s: s["word"]))
    counted = scanned.select(F.explode(F.concat(present, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("files")).collect()
    files = {r["word"]: r["files"] for r in counted}
    total = files.pop("", 0)
    # about 1 for a word of all files, never 0: no notice loses its words by how many files hold it
    return {w: log2(1 + (total + 1) / (files.get(w, 0) + 0.5)) for w in _vocabulary()}


def _has_phrase(spots: Column, phrase: str) -> Column:
    """Whether the words of a phrase follow one another; all of them are among the spots."""
    first, *others = phrase.split()
    starts = F.filter(F.transform(spots, lambda s, i: F.struct(s["word"].alias("word"), s["pos"].alias("pos"), i.alias("i"))), lambda s: s["word"] == first)

    def follows(s: Column) -> Column:
        ok = F.lit(True)
        for n, word in enumerate(others, 1):
            after = F.get(spots, s["i"] + n)
            ok = ok & F.coalesce((after["word"] == word) & (after["pos"] == s["pos"] + n), F.lit(False))
        return ok

    return F.exists(starts, follows)


def _aligned(scanned: DataFrame, weights: dict[str, float]) -> DataFrame:
    """place, found (labels), share: the rows in which notices stand.

    A row's words are looked up in the postings of the notices' rare words; where a word of the row and
    one of a notice meet, their positions differ by where the notice begins. Of the notices so named, all
    words that agree on that beginning are weighed, and what weighs enough must hold its key phrases."""
    spark = scanned.sparkSession
    rows = postings(weights)
    index = spark.createDataFrame(rows, "word string, template int, at int, weight double, rare boolean")
    rare = sorted({w for w, _, _, _, is_rare in rows if is_rare})
    found = scanned.where(F.exists("spots", lambda s: s["word"].isin(rare))).select("place", F.inline("spots"))
    meets = found.join(F.broadcast(index), "word").select("place", "template", (F.col("pos") - F.col("at")).alias("begin"), "weight", "rare")
    votes = meets.groupBy("place", "template", "begin").agg(F.sum("weight").alias("share"), F.bool_or("rare").alias("named"))
    likely = votes.where(F.col("named") & (F.col("share") >= COVERAGE)).groupBy("place", "template").agg(F.max("share").alias("share"))
    held = likely.join(scanned.select("place", "spots"), "place")
    sure = F.lit(False)
    for t, (_, _, phrases) in enumerate(TEMPLATES):
        sure = F.when(F.col("template") == t, _all([_has_phrase(F.col("spots"), p) for p in phrases])).otherwise(sure)
    names = F.array(*[F.lit(name) for name, _, _ in TEMPLATES])
    kept = held.where(sure).groupBy("place").agg(F.sort_array(F.collect_set(F.get(names, F.col("template")))).alias("found"), F.max("share").alias("share"))
    return kept.withColumn("share", F.least("share", F.lit(1.0)))


def _all(conditions: list[Column]) -> Column:
    whole = conditions[0]
    for c in conditions[1:]:
        whole = whole & c
    return whole


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Words are runs of digits, letters and anything outside of ASCII, in the whole text, A-Z as a-z.
    n_base counts the places of PHRASES, first_word and last_word are where the first and the last
    begin, base_labels their labels; labels has those of the notices found by their words as well.
    score is 1 with a phrase, else the largest share of a notice's weight that was found.

    Texts are read once; what is looked up of them is kept in a scratch table. Null and empty texts have
    no words and no labels. Rows come as often as they are in the table, a null id stays null, an empty
    table gives no rows, other columns are ignored."""
    scanned = scratch(_scanned(docs, id_col, text_col), "licence_words")
    out = scanned.join(_aligned(scanned, word_weights(scanned)), "place", "left")
    labels = F.sort_array(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )

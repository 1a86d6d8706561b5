"""Licence scan with a positional rare-token index.  All JVM-side.

A template is a run of a licence's words with a mandatory key phrase in it.  Document frequencies of the key phrases' words are
counted over the corpus.  The index maps the two words of each phrase with the highest inverse document frequency to postings (template,
place in the phrase).  A file's words are looked up once; each posting of a word that stands at i votes for
its template beginning at i less the place.  Where both words of a template vote for one beginning, the phrase is
verified there, and its template is compared word by word.  Files without such words cost one hash lookup a word; nothing is
shuffled but the words' counts.

Defined results: a null text is empty; places may overlap and all are reported; repeated rows each get their result; ties of
rare words go to the first in the phrase; a very long text costs in proportion to its words; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fingerprints import BETWEEN_WORDS

#: Fixed values: (label, phrase) of the base.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Fixed values: (label, phrase) that the method adds.
MORE = (
    ("agpl-3", "gnu affero general public license version 3"),
    ("apache", "licensed under the apache license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("cc0", "cc0 1 0 universal"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software"),
    ("lgpl-3", "gnu lesser general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl-2", "mozilla public license version 2"),
    ("reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
)
#: Longer texts of which a phrase above is the key phrase, by the phrase.
TEXTS = {
    "licensed under the apache license": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "redistribution and use in source and binary forms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "permission to use copy modify and or distribute this software": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "permission is hereby granted free of charge to any person obtaining a copy": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without "
        "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
    ),
    "this is free and unencumbered software": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    "gnu general public license as published by the free software foundation either version 2 of the license": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"
    ),
    "gnu general public license as published by the free software foundation either version 3 of the license": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ),
    "subject to the terms of the mozilla public license v 2 0": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters; only A-Z are lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BETWEEN_WORDS), lambda w: w != "")


def _template(phrase: str) -> tuple[list[str], int]:
    """(words of the phrase's template, place of the phrase in it)."""
    text = TEXTS.get(phrase, phrase)
    return text.split(), len(text[: text.index(phrase)].split())


def rare_places(docs: DataFrame, phrases: list[list[str]], text_col: str = "text", most: int = 2) -> list[list[int]]:
    """Places of each phrase's ``most`` rarest words in the corpus."""
    known = sorted({w for p in phrases for w in p})
    found = docs.select(F.explode(F.array_intersect(words(F.col(text_col)), F.array(*map(F.lit, known)))).alias("w"))
    count = {r[0]: r[1] for r in found.groupBy("w").count().collect()}  # at most a row for each word of the phrases
    return [sorted(range(len(p)), key=lambda k: (count.get(p[k], 0), k))[:most] for p in phrases]


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value found once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(docs: DataFrame, base=BASE, more=MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, coverage.

    ``score`` is 1 - 2^-(verified places of any phrase), ``coverage`` the largest share of a template's words that stand
    where its phrase says.
    """
    templates = (*base, *more)
    phrases = [phrase.split() for _, phrase in templates]
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, places in enumerate(rare_places(docs, phrases, text_col)):
        for place in places:
            postings.setdefault(phrases[t][place], []).append((t, place))
    index = F.create_map(*(x for w, each in sorted(postings.items()) for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(k).alias("place")) for t, k in each)))))
    strings = lambda each: F.array(*(F.array(*map(F.lit, x)) for x in each))
    phrase_of, whole = strings(phrases), strings(_template(p)[0] for _, p in templates)
    before, votes_needed = F.array(*(F.lit(_template(p)[1]) for _, p in templates)), F.array(*(F.lit(min(2, len(p))) for p in phrases))

    def votes(ws):
        at = F.filter(F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.size(ws) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(ws, i).isin(*sorted(postings)))
        each = F.flatten(F.transform(at, lambda i: F.transform(F.element_at(index, F.get(ws, i)), lambda p: F.struct(p["t"].alias("t"), (i - p["place"]).alias("start")))))
        return F.array_sort(F.filter(each, lambda v: v["start"] >= 0))

    def agreed(found):
        """Beginnings for which as many votes stand next to one another as the template has words in the index."""
        run = lambda v, k: F.get(found, k + F.get(votes_needed, v["t"]) - 1)
        return F.filter(found, lambda v, k: F.coalesce(run(v, k) == v, F.lit(False)) & ~((k > 0) & F.coalesce(F.get(found, k - 1) == v, F.lit(False))))

    def verified(ws, found):
        return F.filter(found, lambda v: _let(F.get(phrase_of, v["t"]), lambda p: F.slice(ws, v["start"] + 1, F.size(p)) == p))

    def coverage(ws, v):
        return _let(F.get(whole, v["t"]), lambda p: F.size(F.filter(F.transform(p, lambda w, k: F.get(ws, v["start"] - F.get(before, v["t"]) + k) == w), lambda same: same)) / F.size(p))

    def look(ws):
        found = _let(votes(ws), agreed)
        return _let(verified(ws, found), lambda hits: F.struct(F.size(ws).cast("long").alias("n_words"), hits.alias("hits"), F.array_max(F.transform(hits, lambda v: coverage(ws, v))).alias("coverage")))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _let(words(F.col(text_col).cast("string")), look).alias("r"))
    rows = rows.select("doc_id", "r.n_words", "r.hits", "r.coverage")
    of_base = F.transform(F.filter("hits", lambda v: v["t"] < len(base)), lambda v: v["start"])
    label_of = F.array(*(F.lit(label) for label, _ in templates))

    def labels(hits):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda v: F.get(label_of, v["t"])))), ",")

    return rows.select(
        "doc_id", "n_words", F.size(of_base).cast("long").alias("n_base"), F.array_min(of_base).cast("long").alias("first_word"), F.array_max(of_base).cast("long").alias("last_word"),
        labels(F.filter("hits", lambda v: v["t"] < len(base))).alias("base_labels"), labels(F.col("hits")).alias("labels"), (F.lit(1.0) - F.pow(F.lit(0.5), F.size("hits"))).alias("score"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def scan_sql(base=BASE, more=MORE) -> str:
    """The same in DuckDB's SQL, by comparing every phrase at every place."""
    templates = (*base, *more)

    def at(phrase):
        return " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(phrase.split()))

    columns = ", ".join(f"list_filter(range(0, len(w)), lambda i: {at(phrase)}) AS p{k}" for k, (_, phrase) in enumerate(templates))
    joined = lambda count: "list_concat(" + ", ".join(f"p{k}" for k in range(count)) + ")"
    labels = lambda count: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{x}' END" for k, (x, _) in enumerate(templates[:count])) + "], lambda x: x IS NOT NULL))), ',')"
    nested = joined(len(base))

    def shares(k, phrase):
        text, before = _template(phrase)
        return f"list_transform(p{k}, lambda i: (" + " + ".join(f"CASE WHEN i + {n - before + 1} > 0 AND w[i + {n - before + 1}] = '{word}' THEN 1 ELSE 0 END" for n, word in enumerate(text)) + f") / {len(text)}::DOUBLE)"

    coverage = "list_concat(" + ", ".join(shares(k, phrase) for k, (_, phrase) in enumerate(templates)) + ")"
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, {columns} FROM t)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len({nested}) AS BIGINT) AS n_base, CAST(list_min({nested}) AS BIGINT) AS first_word, CAST(list_max({nested}) AS BIGINT) AS last_word,
  {labels(len(base))} AS base_labels, {labels(len(templates))} AS labels, 1.0::DOUBLE - power(0.5::DOUBLE, len({joined(len(templates))})) AS score,
  coalesce(list_max({coverage}), 0.0::DOUBLE) AS coverage
FROM p"""

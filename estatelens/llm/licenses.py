"""License scan by diagonal voting.

Every rolling k-gram of a document's words is hashed and the hashes are joined to the places of their grams in the templates. A hit of
document word p on template word t votes for the diagonal p - t. A phrase stands where one diagonal has all its votes;
a longer notice is found by merging diagonals that lie a few words apart (inserted or lost words) and measuring how many
of its words they cover. A hit counts only if the words behind both hashes are equal, so no span rests on a hash.

The templates are a small list of bounded length; only they are broadcast. Votes are combined before the shuffle, so a
task sends one row per document and vote, and a text without a hit sends one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm.common import saved

# Phrases and labels that must be found wherever their words stand in a row.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]

# Opening words of public license notices, as their publishers print them, without punctuation.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
MOST_TEMPLATE_GRAMS = 50_000  # bound of what is broadcast
GRAM = 3  # words of a gram; a template of two words is one gram of two
_WORDS = bytes(x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x >= 0x80 else x + 32 if 0x41 <= x <= 0x5A else 0x20 for x in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z lower-cased; none for a null text. Separators are ASCII, so bytes tell words apart."""
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word codes; one per place."""
    n = max(0, len(codes) - k + 1)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ codes[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def codes_of(words: list[bytes], known: dict[bytes, int] | None = None) -> np.ndarray:
    """64-bit codes of words; with ``known``, zero for the words that no template has."""
    if known is None:
        return np.array([xxhash.xxh64_intdigest(w) | 1 for w in words], np.uint64)
    return np.fromiter(map(known.get, words, repeat(0)), np.uint64, len(words))


def template_grams(phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]]) -> list[tuple]:
    """(k, h, gram, template, label, exact, length, t): each place of each gram of the templates."""
    rows = []
    for i, (exact, (label, text)) in enumerate([(True, p) for p in phrases] + [(False, n) for n in notices]):
        words = words_of(text)
        if len(words) < (2 if exact else 5):
            raise ValueError("a phrase needs two words, a notice five")
        k = min(GRAM, len(words))
        h = rolling(codes_of(words), k).view(np.int64).tolist()
        rows += [(k, x, b" ".join(words[t:t + k]).decode(), i, label, exact, len(words), t) for t, x in enumerate(h)]
    if len(rows) > MOST_TEMPLATE_GRAMS:
        raise ValueError(f"templates of more than {MOST_TEMPLATE_GRAMS} grams")
    return rows


def votes(docs: DataFrame, id_col: str, text: str, phrases, notices) -> DataFrame:
    """(_doc, _key, n_words, copies, template, label, exact, length, k, diagonal, at): distinct verified hits, and one row
    with a null template per document that says how many equal rows it has.

    All rolling grams of all texts are hashed. A gram with a word that no template has cannot be joined and stays in its task.
    """
    grams = template_grams(phrases, notices)
    known = {w: int(c) for g in grams for w, c in zip(g[2].encode().split(), codes_of(g[2].encode().split()))}
    sizes = sorted({g[0] for g in grams})
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            doc, out = [], [[] for _ in range(6)]
            for i, t in enumerate(b.column(1)):
                raw = t.as_py()
                words = words_of(raw)
                key = xxhash.xxh64_intdigest((raw or "").encode("utf-8", "replace")) - (1 << 63)
                rows = [(key, len(words), 0, -1, None, None)]
                codes = codes_of(words, known)
                lit = codes > 0
                for k in sizes:
                    h = rolling(codes, k)
                    full = lit[:len(h)].copy()
                    for j in range(1, k):
                        full &= lit[j:j + len(h)]
                    rows += [(key, len(words), k, at, int(h[at]) - (1 << 64 if h[at] >> np.uint64(63) else 0), b" ".join(words[at:at + k]).decode()) for at in np.flatnonzero(full).tolist()]
                doc += [i] * len(rows)
                for o, x in zip(out, zip(*rows)):
                    o.extend(x)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), *(pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())))], names=["_doc", "_key", "n_words", "k", "at", "h", "gram"])

    all_grams = docs.select(F.col(id_col).alias("_doc"), F.col(text).alias("t")).mapInArrow(run, f"_doc {kind}, _key long, n_words long, k int, at int, h long, gram string")
    places = docs.sparkSession.createDataFrame(grams, "k int, h long, gram string, template int, label string, exact boolean, length int, t int")
    met = all_grams.join(F.broadcast(places), ["k", "h", "gram"], "left").where("k = 0 or template is not null")
    return met.groupBy("_doc", "_key", "n_words", "template", "label", "exact", "length", "k", (F.col("at") - F.col("t")).alias("diagonal"), F.when(F.col("k") > 0, F.col("at")).alias("at")).agg(F.count_if(F.col("k") == 0).alias("copies"))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", phrases=PHRASES, notices=NOTICES, slack: int = 3, least: float = 0.75) -> DataFrame:
    """All votes of each document, merged: one row per document and found span, and one per document without a template.

    Columns: _doc, _key (hash of the text), n_words, copies (null but in the row without a template), label, exact,
    first and last (first word and the word after the last), covered (share of the template's words).
    A phrase (exact) is a place where one diagonal holds every gram. A notice's diagonals are merged while they
    lie within ``slack`` words of each other; what covers less than ``least`` of the template, or spreads over more than
    its length plus a quarter and ``slack``, stays in the result with ``exact`` null: it counts for a score only.
    """
    v = saved(votes(docs, id_col, text, phrases, notices))
    doc = ["_doc", "_key", "n_words"]
    whole = [*doc, "template", "label", "exact", "length", "k"]
    lines = v.where("template is not null").groupBy(*whole, "diagonal").agg(F.count("*").alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.collect_set(F.col("at") - F.col("diagonal")).alias("ts"))
    places = lines.where("exact and votes = length - k + 1").select(*doc, "label", "exact", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("length")).alias("last"), F.lit(1.0).alias("covered"))
    w = Window.partitionBy("_doc", "_key", "template").orderBy("lo", "diagonal")
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(w)) > slack) | (F.col("lo") > F.lag("hi").over(w) + F.col("k") + slack)
    islands = lines.where("not exact").withColumn("_new", F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w))
    merged = islands.groupBy(*whole, "_island").agg(F.min("lo").alias("first"), (F.max("hi") + F.first("k")).alias("last"), F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"))
    share = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + F.col("k") - 1))))) / F.col("length")
    sound = (share >= least) & (F.col("last") - F.col("first") <= F.col("length") * 1.25 + slack)
    found = merged.select(*doc, "label", F.when(sound, F.lit(False)).alias("exact"), "first", "last", share.alias("covered"))
    alone = v.where("template is null").select(*doc, F.col("label"), F.col("exact"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), F.lit(None).cast("double").alias("covered"), "copies")
    return places.unionByName(found).withColumn("copies", F.lit(None).cast("long")).unionByName(alone)


def license_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of docs.

    n_base counts the places of all phrases, first_word and last_word are the least and greatest of them (null for none),
    base_labels their labels and labels those and the notices', both distinct, sorted and joined by commas. score is
    the greatest covered share of any template, so 1 where a phrase stands and 0 where nothing was met.
    A null or empty text has no words and no label. Null ids pass by; rows that share an id keep their own result,
    equal rows give equal results. An empty table gives an empty result, and extra columns are ignored.
    """
    spans = license_spans(docs, id_col, text, **options)
    named = F.coalesce(F.col("exact"), F.lit(False))
    out = spans.groupBy("_doc", "_key", "n_words").agg(
        F.max("copies").alias("copies"), F.count_if(named).alias("n_base"), F.min(F.when(named, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(named, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(named, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("exact").isNotNull(), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max("covered"), F.lit(0.0)).alias("score"))
    cols = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return out.select(F.col("_doc").alias("doc_id"), *cols, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")

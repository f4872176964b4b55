"""Spelling variants by reduced-alphabet generation.

Each letter is hashed to one of a few symbols, so a word becomes a reduced word. Words one edit apart have reduced words
that are equal or one edit apart. The one-edit neighbourhoods of the reduced words are generated in full and joined to the
reduced vocabulary; whoever meets there is verified on the original strings, inside the join, so false meetings are
never rows. The neighbourhood relation is symmetric: a pair of reduced words is met at the one that comes later by length
and text, so insertions, which lead to a longer word, are met as the deletions of that word.

A bucket of one reduced word holds the words that differ only in letters of equal symbols. Its size falls with the number
of symbols while the neighbourhoods grow with it; nothing is capped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import LOWER, saved
from estatelens.session import cut_lineage

LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
SYMBOLS = "01234567"
HELD = 200_000  # distinct words that a task counts before it sends them on


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", damage: int | None = 97) -> DataFrame:
    """(word, n): occurrences of the runs of Latin letters in all texts, A-Z lower-cased.

    With ``damage``, a run whose crc32 of "<id>:<run>" it divides loses one code point, as in a text with typing errors;
    a null id counts as empty. Null texts have no runs. Counts are combined in the task, in a table of bounded size.
    """
    def run(batches):
        find = re.compile("[a-zÀ-ÿ]+").findall
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = t.as_py()
                if not raw:
                    continue
                runs = Counter(find(raw.encode("utf-8", "replace").lower().decode()))
                if damage is None:
                    seen.update(runs)
                else:
                    start = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for w, n in runs.items():
                        h = zlib.crc32(w.encode(), start)
                        if h % damage == 0:
                            k = h % len(w)
                            w = w[:k] + w[k + 1:]
                        seen[w] += n
                if len(seen) > HELD:
                    yield flush()
        yield flush()

    counted = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text).alias("t")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def reduced(word: str) -> Column:
    """The word in symbols: a letter's symbol is its code point modulo their number."""
    return F.translate(F.col(word), LETTERS, "".join(SYMBOLS[ord(x) % len(SYMBOLS)] for x in LETTERS))


def neighbourhood(r: str) -> Column:
    """The reduced word and its one-edit neighbours that come before it: all deletions, and replacements by a lesser symbol."""
    at = F.sequence(F.lit(1), F.length(r))
    head, tail = (lambda i: F.substring(F.col(r), F.lit(1), i - 1)), (lambda i: F.substring(F.col(r), i + 1, F.length(r)))
    deleted = F.transform(at, lambda i: F.concat(head(i), tail(i)))
    lesser = lambda i: F.filter(F.array(*map(F.lit, SYMBOLS)), lambda s: s < F.substring(F.col(r), i, F.lit(1)))
    replaced = F.flatten(F.transform(at, lambda i: F.transform(lesser(i), lambda s: F.concat(head(i), s, tail(i)))))
    return F.array_distinct(F.concat(F.array(F.col(r)), deleted, replaced))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each unordered pair of distinct words (word, n) exactly one edit apart, once."""
    v = words.withColumn("r", reduced("word"))
    left = v.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("r").alias("a_r"), F.explode(neighbourhood("r")).alias("r"))
    right = v.select(F.col("word").alias("b"), F.col("n").alias("b_n"), "r")
    once = (F.col("a_r") != F.col("r")) | (F.col("a") < F.col("b"))
    return left.join(right, "r").where(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form or null, ...) with root: the last of the chain of forms, the word itself without one.

    Pointers are doubled until none moves. A form occurs at least twice as often as its word, so chains are short.
    """
    to = cut_lineage(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        step = to.join(to.select(F.col("word").alias("root"), F.col("root").alias("next")), "root")
        moved = cut_lineage(step.select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("_moved")))
        to = moved.drop("_moved")
        if not moved.where("_moved").limit(1).count():
            break
    return forms.join(to, "word")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", damage: int | None = 97, shortest: int = 5, least: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of at least ``shortest`` code points and ``least`` occurrences.

    Two words are near if one code point is inserted, deleted or replaced. The form of a word is its near word of most
    occurrences (ties: the least by code points) if that has at least ``ratio`` times its own; else null. Null and empty texts
    add no words, repeated rows count as often as they stand, an empty table gives an empty result, and other
    columns are ignored.
    """
    words = saved(word_counts(docs, id_col, text, damage).where((F.length("word") >= shortest) & (F.col("n") >= least)))
    pairs = near_pairs(words)
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best"))
    rows = words.join(best, "word", "left")
    has = -F.col("best.m") >= ratio * F.col("n")
    forms = saved(rows.select("word", F.when(has, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.m")).alias("form_n")))
    return roots(forms).select("word", "form", "root", "n", "n_near", "form_n")

"""Spelling variants: frequent words, each with the much more frequent word that is one code point away.

No pair of near words is ever made. Words that differ in one place are in one wildcard group, keyed by the word
with that place blanked out (so by place, prefix and suffix); a group keeps its size and its two most frequent words, which
is all that a member needs: how many others there are, and the best of them. For insertions and deletions, each word's
deletions are looked up in the vocabulary: a word sees its shorter neighbours through its own deletions, and its longer
ones through what their deletions have left at its own spelling, counted and reduced to the best. A group has at
most one word for each letter, and a word as many groups as letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.text import LOWER, UPPER
from tramline.session import cut

LEAST_LETTERS, LEAST_COUNT, TIMES, SLIP = 6, 5, 5, 199
SLICE, HELD = 1 << 20, 200_000  # characters that are read at a time, words that a task counts before it passes them on
RUN, GAP = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")
_LOW = str.maketrans(UPPER, LOWER)


def word_of(doc_id: str, run: str) -> str:
    """The run in lower case (A-Z only), without one of its code points where the digest of id and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode("utf-8", "surrogatepass"))
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: Counter[str] = Counter()

    def out() -> pd.DataFrame:
        return pd.DataFrame({"word": pd.Series(list(total), dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})

    for frame in frames:
        for doc_id, text in zip(frame["i"], frame["text"], strict=True):
            at = 0
            while at < len(text):  # a slice ends where a run does
                gap = GAP.search(text, at + SLICE)
                end = gap.start() if gap else len(text)
                for run, n in Counter(RUN.findall(text[at:end].translate(_LOW))).items():
                    total[word_of(doc_id, run)] += n
                at = end
                if len(total) > HELD:
                    yield out()
                    total.clear()
    yield out()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n of every word with LEAST_LETTERS code points and LEAST_COUNT occurrences; counted in each task before the shuffle."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("text")).filter("text is not null")
    words = texts.mapInPandas(_counted, "word string, n bigint").filter(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _rank(word: str = "word", n: str = "n") -> Column:
    """Orders words by falling n, then by code points."""
    return F.struct((-F.col(n)).alias("m"), F.col(word).alias("w"))


def _places() -> Column:
    return F.sequence(F.lit(1), F.length("word"))


def _around(i: Column, mark: str) -> Column:
    return F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.lit(mark), F.substring(F.col("word"), i + 1, F.length("word")))


def replacements(words: DataFrame) -> DataFrame:
    """word, near (how many words differ from it in one place), best (the first of them by rank)."""
    each = words.select("word", _rank().alias("r"), F.explode(F.transform(_places(), lambda i: _around(i, "*"))).alias("key"))  # no word has the mark
    groups = each.groupBy("key").agg(F.count("*").alias("size"), F.slice(F.sort_array(F.collect_list("r")), 1, 2).alias("two")).filter("size > 1")
    other = F.when(F.col("two")[0]["w"] == F.col("word"), F.col("two")[1]).otherwise(F.col("two")[0])
    return each.join(groups, "key").groupBy("word").agg(F.sum(F.col("size") - 1).alias("near"), F.min(other).alias("best"))


def indels(words: DataFrame) -> DataFrame:
    """word, near, best among words with one code point less, and in other rows among words with one more."""
    # A run of one letter gives one spelling, whichever of its places is left out.
    each = words.select("word", _rank().alias("r"), F.explode(F.array_distinct(F.transform(_places(), lambda i: _around(i, "")))).alias("short"))
    each = cut(each.filter(F.length("short") >= LEAST_LETTERS))
    shorter = each.join(words.select(F.col("word").alias("short"), _rank().alias("s")), "short").groupBy("word").agg(F.count("*").alias("near"), F.min("s").alias("best"))
    longer = each.groupBy(F.col("short").alias("word")).agg(F.count("*").alias("near"), F.min("r").alias("best")).join(words.select("word"), "word", "left_semi")
    return shorter.unionByName(longer)


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word with a form: forms are followed to the last. They grow TIMES over at each step, so few rounds do."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = cut(at.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = far.drop("moved")
        if far.filter("moved").isEmpty():
            return at


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: form (its near word of largest n, if TIMES its own n; ties: smallest), root, n, n_near, form_n.

    A null text has no words, a null id counts as an empty one; texts of any length are read whole; repeated rows count
    each; an empty table gives an empty result; other columns are ignored.
    """
    words = cut(vocabulary(docs, id_col, text_col))
    near = replacements(words).unionByName(indels(words)).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    wins = -F.col("best.m") >= TIMES * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(wins, F.col("best.w")).alias("form"), F.when(wins, -F.col("best.m")).alias("form_n"))
    rows = cut(rows)
    last = roots(rows.filter("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

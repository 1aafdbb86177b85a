"""Spelling variants: words one edit apart, found through a positional q-gram index under a count filter.

A word of m code points is cut into p disjoint positional grams, p = min(8, m div 2). One edit destroys
one of them at most, so two words one edit apart share p - 1 of the shorter word's grams, and they share
them at the same position, or, behind an inserted code point, one further right: the count filter's
overlap bound, and its length and position limits. Postings are filed under what the bound asks for, the
grams but one, so that a pair below the bound never meets. A sort-merge join walks the sorted postings of
a word's own length and those of the words that are one longer, and the edit is verified inside the join.
Few words share all grams but one of about two code points, so candidates grow with the vocabulary
and not with its square.

Words: maximal runs of `[A-Za-z\\u00C0-\\u00FF]`, A-Z in lower case, one code point of a run left out where
the hash of `doc_id:run` is divisible by 199.

Defined cases: null and empty texts have no words; a null doc_id is hashed as an empty one; repeated rows
count as often as they stand there; an empty table gives no rows; words without a near one have a null
form, themselves as the root and n_near 0. A long text is one array of words in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heathgrid.shared import cut

RUN = "([A-Za-z\\u00C0-\\u00FF]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EVERY = 199
SHORTEST, RAREST = 6, 5
#: How many times as frequent a word's form must be.
TIMES = 5
GRAMS = 8


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of every run of at least SHORTEST code points, left-out code points considered."""
    of = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(of.alias("of"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), 1)).alias("run"))
    runs = runs.where(F.char_length("run") >= SHORTEST)
    h = F.crc32(F.concat("of", F.lit(":"), "run"))
    at = (h % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(h % EVERY == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n"))


def postings(words: DataFrame, length: Column, shift: int) -> DataFrame:
    """word, m, key: the word filed as one of m code points (length), or as one that has `shift` more.

    key: the number of the gram left out and the grams around it.
    """
    p = F.least(F.lit(GRAMS), F.floor(F.col("m") / 2).cast("int"))
    start = lambda j: F.floor(j * F.col("m") / p).cast("int")
    around = lambda j: F.concat(j.cast("string"), F.lit(":"), F.substring("word", F.lit(1), start(j)), F.lit(":"), F.substring("word", start(j + 1) + 1 + shift, F.char_length("word")))
    filed = words.select("word", length.alias("m")).where(F.col("m") >= 2)
    return filed.select("word", "m", F.explode(F.transform(F.sequence(F.lit(0), p - 1), around)).alias("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair (a, b) of distinct words one edit apart, once; a is the shorter one or else the smaller one."""
    size = F.char_length("word")
    own = postings(words, size, 0)
    longer = postings(words, size - 1, 1)
    left = own.select(F.col("word").alias("a"), "m", "key")
    right = own.select(F.col("word").alias("b"), "m", "key", F.lit(True).alias("same")).union(longer.select(F.col("word").alias("b"), "m", "key", F.lit(False).alias("same")))
    near = (~F.col("same") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    # an inserted code point can stand at the border of two grams or next to its like: such a pair meets twice
    return left.join(right, ["m", "key"]).where(near).select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every row (word, form): the last word that forms lead to.

    Every form is TIMES as frequent as its word, so there are no rings and chains are short;
    each round halves what is left of them.
    """
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("last"))
        step = cut(at.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return at


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word with at least RAREST occurrences."""
    words = cut(word_counts(docs).where(F.col("n") >= RAREST))
    pairs = cut(near_pairs(words.select("word")))
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = sides.join(counts, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    good = -F.col("best.less") >= TIMES * F.col("n")
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n"))
    told = cut(told)
    last = roots(told.where("form is not null").select("word", "form"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

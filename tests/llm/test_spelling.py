import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heathgrid.llm import registry, spelling

LOWER = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    """By comparing all words with all others."""
    n = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= 5}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, size):
    r = random.Random(seed)
    letters = "abéÿcX"
    stems = ["".join(r.choice(letters) for _ in range(r.randint(5, 12))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "×÷aaaa"]
    words = []
    for w in stems:
        words += [w] * r.choice((1, 5, 6, 30, 160))
        for _ in range(4):
            at, kind = r.randrange(len(w)), r.randrange(3)
            v = w[:at] + ("" if kind == 0 else r.choice(letters)) + w[at + (kind != 1) :]
            words += [v] * r.choice((1, 5, 6, 30))
    r.shuffle(words)
    return [(i, r.choice((" ", "\n", "-", "7")).join(words[k : k + 25])) for i, k in enumerate(range(0, min(size, len(words)), 25))]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    rows = corpus(seed, 10**6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(spelling.variants(docs))
    assert got == plain(rows)
    assert sum(x[1] is not None for x in got) > 3


def test_chains_lead_to_the_last_form(spark):
    rows = [(0, " ".join(["abcdef"] * 5 + ["abcdeg"] * 25 + ["abcdhg"] * 125 + ["abcihg"] * 625))]
    got = {x[0]: x[2] for x in found(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == dict.fromkeys(("abcdef", "abcdeg", "abcdhg", "abcihg"), "abcihg") and found(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_long_words_and_all_single_edits(spark):
    r = random.Random(5)
    w = "".join(r.choice("abcd") for _ in range(70))
    edits = {w[:i] + w[i + 1 :] for i in range(70)} | {w[:i] + "b" + w[i:] for i in range(71)} | {w[:i] + "z" + w[i + 1 :] for i in range(70)}
    words = spark.createDataFrame([(x,) for x in edits | {w}], "word string")
    pairs = {frozenset(x) for x in spelling.near_pairs(words).collect()}
    assert pairs == {frozenset((a, b)) for a in edits | {w} for b in edits | {w} if a < b and one_edit(a, b)}


def test_defined_cases(spark):
    kind = "doc_id string, text string, word int, N int"
    rows = [(None, "Banana banana BANANA banana bananas", 1, 1), ("x", None, 1, 1), ("y", "", 1, 1), ("y", "banana " * 40 + "bananb " * 5, 1, 1), ("y", "banana " * 40 + "bananb " * 5, 1, 1)]
    docs = spark.createDataFrame(rows, kind)
    assert found(spelling.variants(docs)) == plain([x[:2] for x in rows])
    assert spelling.variants(docs.where("false")).count() == 0
    long = spark.createDataFrame([(1, "zwanzig zwanzik " * 200_000)], "doc_id long, text string")
    assert found(spelling.variants(long)) == plain([(1, "zwanzig zwanzik " * 200_000)])


def test_query(spark, tmp_path):
    rows = corpus(9, 4000)
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    df = registry.op11_spelling_variants(spark, str(tmp_path))
    assert found(df) == plain(rows)
    assert df.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]

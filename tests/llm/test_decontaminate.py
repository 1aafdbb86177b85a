import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from heathgrid.llm import decontaminate as d

ITEMS = "item_id long, text string"


def slow_align(item, text):
    best, table = 0, [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (d.MATCH if a == b else d.MISMATCH), table[i - 1][j] + d.GAP, table[i][j - 1] + d.GAP)
            best = max(best, table[i][j])
    return best


def test_alignment_equals_the_plain_table():
    rng = random.Random(1)
    for _ in range(200):
        item = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 12))], np.uint64)
        text = np.array([rng.randint(0, 4) for _ in range(rng.randint(0, 25))], np.uint64)
        points, start, end = d.align(item, text)
        assert points == slow_align(item.tolist(), text.tolist())
        if points:
            assert slow_align(item.tolist(), text[start:end].tolist()) == points
            assert 0 <= start < end <= len(text)


def corpus(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randint(8, 40)) for _ in range(25)]
    rows, want = [], set()
    for i in range(150):
        words = text(rng.randint(0, 200))
        if i % 3 == 0:
            k = rng.randrange(len(items))
            copy = [w if rng.random() > (0.12 if i % 2 else 0) else rng.choice(vocabulary) for w in items[k]]
            at = rng.randint(0, len(words))
            words[at:at] = copy
            want.add((i, k))
        rows.append((i, " ".join(words).capitalize() + ".", "en", "s"))
    return items, rows, want


def test_equals_alignment_of_every_pair(spark, documents):
    items, rows, want = corpus()
    benchmark = spark.createDataFrame([(i, ", ".join(x)) for i, x in enumerate(items)], ITEMS)
    found = {(r.doc_id, r.item_id): r.score for r in d.find(documents(*rows), benchmark).collect()}
    brute = {}
    for i, text, *_ in rows:
        words = text.lower().replace(".", "").split()
        for k, item in enumerate(items):
            score = slow_align(item, words) / (d.MATCH * len(item))
            if score >= d.THRESHOLD:
                brute[i, k] = score
    assert found == brute
    assert len(want & set(found)) >= 0.95 * len(want)


def test_the_block_size_makes_no_difference(spark, documents, monkeypatch):
    items, rows, _ = corpus(3)
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], ITEMS)
    whole = sorted(map(tuple, d.find(documents(*rows), benchmark).collect()))
    monkeypatch.setattr(d, "BLOCK_ITEMS", 7)
    assert sorted(map(tuple, d.find(documents(*rows), benchmark).collect())) == whole and whole


def test_nulls_empties_repeats_and_extra_columns(spark, documents):
    item = "one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (1, "a b c d e f g")], ITEMS).withColumn("doc_id", F.lit(7))
    docs = documents((0, f"x {item.upper()}!", "en", "s"), (0, f"x {item.upper()}!", "en", "s"), (1, None, "en", "s"), (2, "", "en", "s"), (3, "too short", "en", "s"), (4, "y " * 60_000 + item, None, None), (5, "a b c d e f g", "en", "s"), (6, "one two three and no more of it", "en", "s")).withColumn("item_id", F.lit("clash")).withColumn("score", F.lit(1))
    found = sorted((r.doc_id, r.item_id, r.score, r.first_word) for r in d.find(docs, benchmark).collect())
    assert found == [(0, 1, 1.0, 1), (0, 1, 1.0, 1), (4, 1, 1.0, 60_000), (5, 1, 1.0, 0)]
    left = d.clean(docs, benchmark)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 6]
    assert d.find(docs, benchmark.limit(0)).count() == 0 and d.find(docs.limit(0), benchmark).count() == 0
    assert d.clean(docs, benchmark.limit(0)).count() == docs.count()


def test_seeds_are_the_rarer_grams():
    items = d.Items([1], [" ".join(f"w{i}" for i in range(40))])
    counts = np.arange(len(items.all.wanted))
    items.seed(counts)
    rare = np.sort(items.all.wanted[np.argsort(counts)][: int(np.ceil(d.SEEDS * 38))])
    assert items.seeds.wanted.tolist() == rare.tolist()
    assert d.words_of(pa.array(["a b", None]))[1].tolist() == [0, 2, 2]


def edited(rng, words, share, fresh):
    """A copy in which so large a share of words is replaced, dropped or has a new word before it."""
    out = []
    for w in words:
        kind = rng.choice("rrrdi") if rng.random() < share else ""
        out += [fresh()] if kind == "r" else [] if kind == "d" else [fresh(), w] if kind == "i" else [w]
    return out


def test_edited_copies_equal_alignment_of_every_pair(spark, documents):
    rng, new = random.Random(4), iter(range(10**9))
    fresh = lambda: f"new{next(new)}"
    lengths = [5, 6, 7, 9, 12, 16, 24, 24, 40, 40, 60, 60]
    items = [[rng.choice(["the", "of", f"i{k}w{j}"]) if rng.random() < 0.3 else f"i{k}w{j}" for j in range(n)] for k, n in enumerate(lengths)]
    docs = [[fresh(), *edited(rng, items[k], share, fresh), fresh()] for k in range(len(items)) for share in (0.2, 0.2, 0.25, 0.25, 0.35)]
    # every fourth word replaced, every third one, the middle of five, and a new word after each word
    docs += [[fresh() if j % 4 == 3 else w for j, w in enumerate(items[8])], [fresh() if j % 3 == 2 else w for j, w in enumerate(items[10])]]
    docs += [[fresh() if j == 2 else w for j, w in enumerate(items[0])], [x for w in items[9] for x in (w, fresh())]]
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], ITEMS)
    brute = {(i, k): slow_align(item, words) / (d.MATCH * len(item)) for i, words in enumerate(docs) for k, item in enumerate(items)}
    brute = {k: v for k, v in brute.items() if v >= d.THRESHOLD}
    found = {(r.doc_id, r.item_id): r.score for r in d.find(documents(*(" ".join(x) for x in docs)), benchmark).collect()}
    assert found == brute
    assert {(len(docs) - 4, 8), (len(docs) - 3, 10), (len(docs) - 2, 0), (len(docs) - 1, 9)} <= set(found)


def test_a_match_has_at_least_so_many_pairs():
    rng = random.Random(5)
    for _ in range(3000):
        n, letters = rng.randint(5, 14), rng.choice((3, 8, 30))
        item = np.array([rng.randrange(letters) for _ in range(n)], np.uint64)
        text = np.array(edited(rng, item.tolist(), rng.choice((0.2, 0.4, 0.6)), lambda: rng.randrange(letters)), np.uint64)
        if slow_align(item.tolist(), text.tolist()) >= d.THRESHOLD * d.MATCH * n:
            there = np.concatenate([d.pairs_of(text, 1), d.pairs_of(text, 2)])
            hits = np.isin(d.pairs_of(item, 1), there)
            hits[:-1] |= np.isin(d.pairs_of(item, 2), there)
            assert hits.sum() >= d.least_pairs(n)

import random

import pytest
from pyspark.sql import functions as F

from heathgrid.llm import simhash
from heathgrid.llm.common import components


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = set(base) | {0, 2**64 - 1, 1, 3, 2**63}
    for x in base:
        for _ in range(12):
            y = x
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << bit
            values.add(y)
    values = sorted(map(signed, values))
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    found = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in values], "fp long")).collect()]
    assert len(found) == len(set(found))
    assert set(found) == want and len(want) > 300


def test_components_chain_hub_loop_and_empty(spark):
    edges = [(i, i + 1) for i in range(100, 300)] + [(1, i) for i in range(2, 30)] + [(400, 400), (5, 5)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    groups = {}
    for node, label in found.items():
        groups.setdefault(label, set()).add(node)
    assert sorted(map(sorted, groups.values())) == [list(range(1, 30)), list(range(100, 301)), [400]]
    assert all(label in group for label, group in groups.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_nulls_empties_ties_and_extra_columns(spark, documents):
    text = " ".join(f"w{i}" for i in range(200))
    docs = documents(text, text.upper(), "", None, "x" * 50_000, "a b", (0, text, "en", "s")).withColumn("fp", F.lit("clash")).withColumn("label", F.lit(1))
    found = sorted((r.doc_id, r.component_id) for r in simhash.group(docs).collect())
    assert found == [(0, 0), (0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 5)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 0, 2, 4, 5]
    assert simhash.group(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text,want", [("", 0), ("   \n\t", 0)])
def test_no_words(text, want):
    assert simhash.fingerprint(text) == want


def test_fingerprint_is_the_majority_of_shingle_bits():
    import xxhash

    text = "The Quick brown fox été jumps\tover the lazy dog the quick brown fox"
    words = text.replace("T", "t").replace("Q", "q").split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == signed(want)

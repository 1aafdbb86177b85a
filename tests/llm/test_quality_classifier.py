import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from heathgrid.llm import byte_features as b
from heathgrid.llm import quality_classifier as q
from heathgrid.llm.common import bytes_of


def naive_buckets(text):
    flat, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    return [found.tolist() for _, found in q.buckets(flat, offsets)]


def test_words_match_split_and_borders_hold():
    texts = ["ab  cd\tef", "", "gh", "ij kl", " ", "x"]
    flat, offsets = bytes_of(pa.array(texts))
    starts, ends = b.spans(flat, offsets, ~b.WHITE)
    assert [bytes(flat[i:j]).decode() for i, j in zip(starts, ends, strict=True)] == [w for x in texts for w in x.split()]
    found = b.hashes(flat, starts, ends)
    alone = [int(b.hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]) for x in texts for w in x.split()]
    assert found.tolist() == alone


def test_many_texts_at_once_score_as_each_alone():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "abc", "é", "x", "longer"]) for _ in range(rng.randint(0, 30))) for _ in range(50)] + [None, ""]
    model = q.Model(np.random.default_rng(0).normal(size=q.GRAMS + (1 << q.PAIR_BITS)), 0.3)
    together = model.score(*bytes_of(pa.array(texts)))
    for text, got in zip(texts, together, strict=True):
        own = naive_buckets(text or "")
        want = 1 / (1 + np.exp(-(sum(sum(model.weights[i] for i in x) / max(1, len(x)) for x in own) / len(own) + 0.3)))
        assert abs(got - want) < 1e-9


def test_learns_and_leaves_the_held_out_fold_alone(spark, documents):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(60)]
        junk = i % 5 == 0
        rows.append((i, " ".join(w + "$$$" for w in words) if junk and i % 2 else " ".join([words[0]] * 60) if junk else " ".join(words), "en", "s"))
        labels.append((i, int(not junk)))
    rows += [(300, "", "en", "s"), (301, None, "en", "s"), (301, None, "en", "s")]
    docs = documents(*rows).withColumn("score", F.lit(9)).withColumn("label", F.lit("clash"))
    table = spark.createDataFrame([*labels, (999, 1), (1, None)], "doc_id long, quality int")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = q.fit(docs, table, "quality", fold != 0)
    found = {r.doc_id: (r.score, r.held) for r in q.score(docs, model).withColumn("held", fold == 0).collect()}
    held = [i for i in range(300) if found[i][1]]
    assert len(held) > 30 and np.mean([(found[i][0] >= 0.3) == labels[i][1] for i in held]) > 0.95
    assert 0 <= found[300][0] == found[301][0] <= 1
    flipped = table.withColumn("quality", F.when(fold == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(q.fit(docs, flipped, "quality", fold != 0).weights, model.weights)
    assert q.score(docs.limit(0), model).count() == 0
    nothing = q.fit(docs, table.limit(0), "quality", fold != 0)
    assert {r.score for r in q.score(docs, nothing).collect()} == {0.5}

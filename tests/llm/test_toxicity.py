import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from heathgrid.llm import toxicity as t
from heathgrid.llm.common import bytes_of


def test_windows_cover_every_word_and_overlap():
    texts = [" ".join(f"w{i}x{k}" for i in range(n)) for k, n in enumerate((0, 1, 15, 16, 17, 32, 33, 48, 49, 200))] + [None, "!!"]
    words = t.Words(*bytes_of(pa.array(texts)))
    which, text = words.windows()
    at = np.cumsum(words.count) - words.count
    for i, n in enumerate(words.count):
        rows = which[text == i]
        assert len(rows) >= 1
        own = words.which[at[i] : at[i] + n].tolist()
        assert {x for r in rows for x in r if x >= 0} == set(own)
        assert all(r[r >= 0].tolist() == own[16 * k : 16 * k + 32] for k, r in enumerate(rows))


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = t.Network(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items() if k not in ("word", "gram")}
    vectors, which = rng.normal(size=(6, t.WIDTH)), rng.integers(-1, 6, (5, 7))
    y, weight = np.array([0, 1, 1, 0, 1]), rng.random(5) + 0.5

    def loss():
        p = t.squash(net.forward(vectors, which))
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    found = net.gradients(vectors, which, y, weight)
    for name, held in [*net.p.items(), ("x", vectors)]:
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in held.shape)
            was, ends = held[i], []
            for step in (1e-2, -1e-2):
                held[i] = was + step
                ends.append(loss())
            held[i] = was
            assert abs((ends[0] - ends[1]) / 2e-2 - found[name][i]) < 2e-3


def test_learns_words_and_stems_and_leaves_the_held_out_fold_alone(spark, documents):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["Zugg!", "bezzok", "zuggish", "zuggen"])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(toxic)))
    rows += [(400, "", "en", "s"), (401, None, "en", "s"), (401, None, "en", "s"), (402, "!!! ...", None, None)]
    docs = documents(*rows).withColumn("score", F.lit(9)).withColumn("label", F.lit("clash"))
    table = spark.createDataFrame([*labels, (999, 1), (1, None)], "doc_id long, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    net = t.fit(docs, table, "toxic", fold != 1)
    found = {r.doc_id: (r.score, r.held) for r in t.score(docs, net).withColumn("held", fold == 1).collect()}
    held = [i for i in range(400) if found[i][1]]
    right = [(found[i][0] >= 0.7) == labels[i][1] for i in held]
    assert len(held) > 60 and np.mean(right) > 0.9
    assert found[400][0] == found[401][0] == found[402][0]
    assert t.score(docs.limit(0), net).count() == 0
    assert {r.score for r in t.score(docs, t.fit(docs, table.limit(0), "toxic", fold != 1)).collect()} == {0.5}

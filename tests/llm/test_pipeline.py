import random

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import test_decontaminate
import test_line_dedup
import test_quality_rules
import tiktoken
from pyspark.sql import functions as F

from heathgrid.llm import byte_bpe, decontaminate, simhash


def brute(rows, items):
    kept = test_quality_rules.brute(rows)
    new = test_line_dedup.brute(kept)
    kept = [(doc, new[doc][0], *rest) for doc, _, *rest in kept]
    prints = {doc: simhash.fingerprint(text, 5) for doc, text, *_ in kept}
    root = {doc: doc for doc in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    kept = [r for r in kept if root[r[0]] == r[0]]
    words = lambda x: "".join(c if c.isalnum() else " " for c in x.lower()).split()
    return {
        doc: text for doc, text, *_ in kept
        if not any(test_decontaminate.slow_align(words(x), words(text)) >= decontaminate.THRESHOLD * decontaminate.MATCH * len(words(x)) for x in items)
    }


def test_equals_plain_python(spark, documents, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared, items = [line(12) for _ in range(4)], [line(15) for _ in range(3)]
    rows = []
    for i in range(36):
        parts = [line(rng.randint(10, 25)) for _ in range(4)]
        if i % 3 == 0:
            parts.insert(1, test_line_dedup.edited(rng, rng.choice(shared), rng.randint(0, 2)))
        if i % 7 == 0:
            parts[2] += " " + rng.choice(items)
        text = "\n".join(parts)
        if i % 5 == 4:
            text = " ".join(w + "$$" for w in text.split(" "))
        if i % 6 == 5:
            text = rows[i - 1][1].replace("\n", "  \n")
        rows.append((i, text, "en" if i % 2 else "fr", "s"))
    rows += [(40, None, "en", "s"), (41, "", None, None), (42, "too few words", "en", "s")]
    documents(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = byte_bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(rows, items)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in found} == {k: library.encode_ordinary(v) for k, v in want.items()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) // 4 for r in found) and 5 < len(want) < 30


def test_stages_keep_the_columns(spark, documents, tmp_path):
    docs = documents("a", None).limit(0)
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_stages_take_further_columns_of_any_name(spark, documents, tmp_path):
    names = ["its_doc", "its_first", "its_near", "its_zip", "its_parts", "its_lines", "measures", "kept", "in_lang", "fp", "first", "label", "component_id", "item_id", "score"]
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(6))
    docs = documents((1, text, "en", "s"), (2, text, "en", "s"), (3, text.replace("w", "v"), None, None), (4, None, "en", "s"))
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    found = docs.collect()
    assert {r.doc_id for r in found} == {1, 2, 3} and all(tuple(r[n] for n in names) == tuple(range(len(names))) for r in found)
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == {1, 2, 3}

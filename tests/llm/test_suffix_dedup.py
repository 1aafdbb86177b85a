import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heathgrid.llm import suffix_dedup as s
from heathgrid.llm.common import bytes_of


def brute(rows):
    least = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - s.LENGTH + 1):
            x = data[i : i + s.LENGTH]
            least[x] = min(least.get(x, doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - s.LENGTH + 1):
            if least[data[i : i + s.LENGTH]] < doc:
                gone[i : i + s.LENGTH] = b"\x01" * s.LENGTH
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(docs):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.strip(docs).collect())


def test_every_window_lies_in_one_phrase_and_equal_windows_in_equal_triggers():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 400))) for _ in range(30)] + ["a" * 300, "ab" * 100, None, "x" * 49, "x" * 50]
    flat, offsets = bytes_of(pa.array(texts))
    found = s.parse(flat, offsets)
    seen, triggers = set(), {}
    for k, a, n, t in zip(found["text"], found["start"], found["size"], found["trigger"], strict=True):
        for i in range(a, a + n - s.LENGTH + 1):
            assert (k, i) not in seen
            seen.add((k, i))
            window = bytes(flat[offsets[k] + i : offsets[k] + i + s.LENGTH])
            assert triggers.setdefault(window, t) == t
    assert seen == {(k, i) for k, x in enumerate(texts) for i in range(len((x or "").encode()) - s.LENGTH + 1)}


def test_triggers_spread_evenly_over_buckets(documents):
    rng = random.Random(5)
    docs = documents(*("".join(rng.choice("abcdefgh ") for _ in range(4000)) for _ in range(40)))
    held = s.places(docs, 64).select("bucket", F.length("data").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    sizes = [r.n for r in held]
    assert len(sizes) == 64 and max(sizes) < 2 * sum(sizes) / 64


def test_sorting_a_bucket_in_parts_changes_nothing(documents, monkeypatch):
    rng = random.Random(6)
    shared = ["".join(rng.choice("abcdef ") for _ in range(120)) for _ in range(6)]
    docs = documents(*(rng.choice(shared) + "".join(rng.choice("ab") for _ in range(60)) + rng.choice(shared) for _ in range(60)))
    bucket = pa.Table.from_pandas(s.places(docs, 1).toPandas(), preserve_index=False)

    def found():
        out = s.settle(bucket).to_pylist()
        cut = lambda x, n: sorted(x[k : k + n] for k in range(0, len(x or b""), n))
        return [(r["group"], cut(r["repeated"], sum(s.SPANS)), cut(r["asked"], sum(s.ASKEDS))) for r in out]

    whole = found()
    assert any(r[1] for r in whole) and any(r[2] for r in whole)
    monkeypatch.setattr(s, "SHARE_BYTES", 1000)
    assert found() == whole


@pytest.mark.parametrize("seed,letters", [(1, "abcdefgh "), (2, "ab"), (3, "aé ")])
def test_equals_brute_force(documents, seed, letters):
    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [draw(rng.randint(40, 160)) for _ in range(8)]
    rows = []
    for i in range(50):
        parts = [rng.choice(passages) if rng.random() < 0.5 else draw(rng.randint(0, 120)) for _ in range(rng.randint(0, 5))]
        text = "".join(parts)
        if rows and rng.random() < 0.3:
            text = rng.choice(rows)[1]
            if rng.random() < 0.5 and text:
                k = rng.randrange(len(text))
                text = text[:k] + rng.choice(letters) + text[k + 1 :]
        rows.append((i * 7 % 50, text))
    docs = documents(*((i, x, "en", "s") for i, x in rows))
    want = brute(rows)
    assert result(docs) == want and sum(r[2] for r in want) > 500


def test_a_long_text_in_parts(documents, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcd") for _ in range(700))
    flat = np.frombuffer(text.encode(), np.uint8)
    whole = s.parse(flat, np.array([0, len(flat)]))
    monkeypatch.setattr(s, "PART", 128)
    found = s.parse(flat, np.array([0, len(flat)]))
    windows = lambda x: sorted(i for a, n in zip(x["start"], x["size"], strict=True) for i in range(a, a + n - s.LENGTH + 1))
    assert windows(found) == windows(whole) == list(range(len(flat) - s.LENGTH + 1))


def test_ranks_are_the_order_of_suffixes():
    rng = np.random.default_rng(3)
    flat = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(0, 400 - s.LENGTH + 1)
    texts = [bytes(flat[i : i + s.LENGTH]) for i in starts]
    order = {x: i for i, x in enumerate(sorted(set(texts)))}
    assert s.window_ranks(flat, starts).tolist() == [order[x] for x in texts]


def test_packing():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 40, 33).astype(np.uint64), rng.integers(0, 256, 33).astype(np.uint64)
    assert all(np.array_equal(x, y) for x, y in zip((a, b), s.unpack(s.pack([(a, 5), (b, 1)]), [5, 1]), strict=True))
    assert all(np.array_equal(x, y) for x, y in zip((a, b), s.of_records(s.records([a, b], [5, 1]).tobytes(), [5, 1]), strict=True))


def test_dictionary_parts_make_no_difference(documents, monkeypatch):
    rng = random.Random(6)
    passages = ["".join(rng.choice("abc") for _ in range(90)) for _ in range(6)]
    rows = [(i, "".join(rng.choice(passages)[rng.randint(0, 30) :] for _ in range(3))) for i in range(30)]
    monkeypatch.setattr(s, "SORTED", 200)
    assert result(documents(*((i, x, "en", "s") for i, x in rows))) == brute(rows)


def test_nulls_empties_repeats_and_extra_columns(documents):
    line = "The quick brown fox jumps over the lazy dog, and then it rests under a tree. "
    rows = [(3, line * 3), (3, line * 3), (1, None), (2, ""), (9, "y" * 60_000), (10, "y" * 60_000 + line), (4, "short"), (11, "short")]
    docs = documents(*((i, x, "en", "s") for i, x in rows)).withColumn("spans", F.lit("clash")).withColumn("bucket", F.lit(0))
    assert result(docs) == brute([r for r in rows])
    assert s.strip(docs.limit(0)).count() == 0

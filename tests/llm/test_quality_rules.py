import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heathgrid.llm import quality_rules as q

CLEAN = " ".join(f"word{i}" for i in range(80)) + "."


def rates(text):
    n_words, chars, symbols, dup, repeat, n_lines, capitals = q.measure(text)
    per = lambda a, b: min(10_000, 10_000 * a // max(1, b))
    return {"symbols": per(symbols, chars), "dup_lines": per(dup, n_lines), "repeats": per(repeat, n_words), "capitals": per(capitals, n_words)}


def passes_base(text):
    n_words, *_, repeat, _, _ = q.measure(text)
    return n_words >= 50 and 100 * repeat <= 50 * n_words


def tail(bins, rate):
    seen, total = 0, sum(bins.values())
    for b in sorted(bins):
        seen += bins[b]
        if 1000 * seen >= q.LEVELS[rate] * total:
            return q.MARGIN * q.RESOLUTION * q.GROWTH**b


def drawn(own, parent):
    total = sum(parent.values())
    return Counter({b: own[b] * total + q.PRIOR * parent[b] for b in own.keys() | parent.keys()})


def brute(rows):
    """Rows (doc_id, text, lang, source) that the rules keep."""
    rows = [(i, x or "", *rest) for i, x, *rest in rows]
    groups, langs, corpus = {}, {}, {k: Counter() for k in q.LEVELS}
    for _, text, lang, source in rows:
        if passes_base(text):
            for k, r in rates(text).items():
                b = 0 if r <= q.RESOLUTION else math.ceil(math.log(r / q.RESOLUTION) / math.log(q.GROWTH))
                for counts in (groups.setdefault((lang, source, k), Counter()), langs.setdefault((lang, k), Counter()), corpus[k]):
                    counts[b] += 1

    def ceiling(lang, source, k):
        mid = min(tail(drawn(langs[lang, k], corpus[k]), k), q.ALLOWANCE * tail(corpus[k], k))
        return min(tail(drawn(groups[lang, source, k], langs[lang, k]), k), q.ALLOWANCE * mid)

    return [(i, x, lang, source) for i, x, lang, source in rows if passes_base(x) and all(r <= ceiling(lang, source, k) for k, r in rates(x).items())]


def test_measures():
    assert q.measure("a b c a b c\nx\nx\n\n") == (8, 8, 0, 1, 6, 3, 0)
    assert q.measure("A$ #b <c>") == (3, 7, 4, 0, 0, 1, 1)
    assert q.measure("") == (0, 0, 0, 0, 0, 0, 0)


def test_repeated_windows_equal_brute_force():
    rng = random.Random(1)
    for n in range(0, 60):
        words = [rng.choice("abcd") for _ in range(n)]
        wins = [tuple(words[i : i + 3]) for i in range(max(0, n - 2))]
        want = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(3)}
        assert q.repeated(words) == len(want)


def test_judgement_with_nulls_and_a_junk_document(spark, documents):
    junk = " ".join(f"w{i}$$$" for i in range(80))
    rows = [(i, CLEAN + f" n{i}", "en", "s") for i in range(20)] + [(20, junk, "en", "s"), (21, None, "en", "s"), (22, "", None, None), (23, CLEAN, None, None), (23, CLEAN, None, None)]
    docs = documents(*rows).withColumn("kept", F.lit("clash")).withColumn("most_symbols", F.lit(0))
    found = {r.doc_id: (r.base_failed, r.kept) for r in q.judge(docs).collect()}
    assert all(found[i] == (False, True) for i in [*range(20), 23])
    assert found[20] == (False, False) and found[21] == found[22] == (True, False)
    left = q.rejects(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [*range(20), 23, 23]
    assert q.judge(docs.limit(0)).count() == 0


def test_sketches_merge_to_the_sketch_of_the_union(spark, documents):
    docs = documents(*(CLEAN + " $" * (i % 7) for i in range(30)))
    measured = q.measures(docs)
    halves = q.sketch(measured.where("doc_id % 2 = 0")).union(q.sketch(measured.where("doc_id % 2 = 1")))
    merged = halves.groupBy("lang", "source", "rate", "bin").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, q.sketch(measured).collect()))


def text_with(rng, symbols, capitals=0, repeats=0):
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    for k in range(symbols):
        words[k] += "$"
    for k in range(capitals):
        words[-1 - k] = words[-1 - k].upper()
    return " ".join(words + words[:repeats])


def test_judgement_equals_brute_force(spark, documents):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["web", "web", "web", "code", None])
        text = text_with(rng, min(60, int(rng.expovariate(1 / (20 if source == "code" else 2)))), rng.choice([0, 0, 1, 5, 30]), rng.choice([0, 0, 0, 4, 30]))
        rows.append((i, rng.choice([text] * 30 + [None, "", "few words"]), lang, source))
    want = {i for i, *_ in brute(rows)}
    found = {r.doc_id for r in q.judge(documents(*rows)).where("kept").collect()}
    assert found == want and 100 < len(want) < 390


def test_a_text_is_judged_by_its_group(spark, documents):
    rng = random.Random(5)
    rows = [(i, text_with(rng, 0 if i % 2 else 24), "en", "news" if i % 2 else "code") for i in range(1200)]
    text = text_with(rng, 20)
    rows += [(2000, text, "en", "news"), (2001, text, "en", "code")]
    found = {r.doc_id: r.kept for r in q.judge(documents(*rows)).where("doc_id >= 2000").collect()}
    assert found == {2000: False, 2001: True}


def test_long_texts_and_equal_ids(spark, documents):
    rows = [(0, CLEAN + " " + " ".join(f"v{i}" for i in range(300_000)), "en", "s"), (7, CLEAN, "en", "s"), (7, "few words", "en", "s")]
    left = q.rejects(documents(*rows).withColumn("in_lang", F.lit(1)).withColumn("most", F.lit(2)))
    assert sorted((r.doc_id, r.text[:5], r.in_lang, r.most) for r in left.collect()) == [(0, "word0", 1, 2), (7, "word0", 1, 2)]


@pytest.mark.parametrize("name", ["op5_quality_rules"])
def test_registered_query(spark, documents, tmp_path, name):
    from heathgrid.llm import registry

    documents(CLEAN, None, "").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()[name](spark, str(tmp_path))
    assert found.dtypes[:2] == [("doc_id", "bigint"), ("n_words", "bigint")] and {"base_failed", "kept", "n_symbols"} <= set(found.columns)
    assert sorted((r.doc_id, r.base_failed, r.kept) for r in found.collect()) == [(0, False, True), (1, True, False), (2, True, False)]

import hashlib
import random

from pyspark.sql import functions as F

from heathgrid.llm import line_dedup as d


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
    return row[-1]


def edited(rng, line, edits):
    for _ in range(edits):
        k, how = rng.randrange(len(line)), rng.randrange(3)
        line = line[:k] + (rng.choice("abé ") if how else "") + line[k + (how != 1) :]
    return line


def brute(rows):
    """kept text, n_lines, n_exact, n_close by doc_id."""
    seen, out = [], {}
    for doc, text, *_ in sorted(rows):
        kept, n, exact, close = [], 0, 0, 0
        for line in text.split("\n"):
            if not line.strip(" \t\n\v\f\r"):
                kept.append(line)
                continue
            n += 1
            if line in seen:
                exact += 1
                continue
            near = len(line) >= d.LEAST_CHARS and any(len(x) >= d.LEAST_CHARS and abs(len(x) - len(line)) <= 2 and distance(x, line) <= d.MOST_EDITS for x in seen)
            seen.append(line)
            close += near
            if not near:
                kept.append(line)
        out[doc] = ("\n".join(kept), n, exact, close)
    return out


def test_equals_brute_force(documents):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdeé t") for _ in range(rng.randint(20, 60))) for _ in range(30)]
    rows = []
    for i in range(60):
        lines = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 4])) if rng.random() < 0.7 else rng.choice(["", "  ", "short"]) for _ in range(rng.randint(0, 6))]
        rows.append((i, "\n".join(lines), "en", "s"))
    want = brute(rows)
    found = {r.doc_id: r for r in d.report(documents(*rows)).collect()}
    assert {i: (r.kept_md5, r.n_lines, r.n_exact, r.n_close) for i, r in found.items()} == {i: (hashlib.md5(x[0].encode()).hexdigest(), *x[1:]) for i, x in want.items()}
    assert sum(x[3] for x in want.values()) > 10


def test_banded_distance_equals_the_plain_one(spark):
    rng, rows = random.Random(8), []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(3, 40)))
        b = edited(rng, a, rng.randint(0, 5))
        if abs(len(a) - len(b)) <= d.MOST_EDITS:
            rows.append((a, b, distance(a, b) <= d.MOST_EDITS))
    found = spark.createDataFrame(rows, "a string, b string, want boolean").select("want", F.expr(d.within("a", "b")).alias("got")).collect()
    assert all(r.want == r.got for r in found) and 50 < sum(r.want for r in found) < 350


def test_every_close_pair_shares_a_key(spark):
    rng, rows = random.Random(9), []
    for _ in range(600):
        a = "".join(rng.choice("abcdefg ") for _ in range(rng.randint(34, 70)))
        b = edited(rng, a, rng.randint(0, 2))
        if len(b) >= d.LEAST_CHARS:
            rows.append((min(a, b, key=len), max(a, b, key=len)))
    frame = spark.createDataFrame(rows, "short string, long string")
    own = frame.withColumn("line", F.col("short")).withColumn("n", F.length("line")).select("short", "long", F.expr(d.keys()).alias("own"))
    asked = frame.withColumn("line", F.col("long")).withColumn("n", F.length("line")).select("short", "long", F.expr(d.keys()).alias("asked"))
    missed = asked.join(own, ["short", "long"]).where(~F.arrays_overlap("asked", "own"))
    assert missed.count() == 0


def test_nulls_empties_repeats_and_extra_columns(documents):
    line = "The quick brown fox jumps over the lazy dog today"
    rows = [(0, line, "en", "s"), (0, line, "en", "s"), (1, f"{line}\n{line}!\nx\n\nx", "en", "s"), (2, None, "en", "s"), (3, "", "en", "s"), (4, " \n\t", None, None), (5, "y" * 100_000 + "\n" + line.replace("quick", "quack"), "en", "s")]
    docs = documents(*rows).withColumn("near", F.lit("clash")).withColumn("at", F.lit(1))
    out = d.dedup(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert texts == {0: (line, len(line)), 1: ("x\n", 2), 2: (None, None), 3: ("", 0), 4: (" \n\t", 3), 5: ("y" * 100_000, 100_000)}
    assert out.count() == 7 and d.report(docs.limit(0)).count() == 0
    counts = {r.doc_id: (r.n_lines, r.n_exact, r.n_close) for r in d.report(docs).collect()}
    assert counts == {0: (1, 0, 0), 1: (4, 2, 1), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0), 5: (2, 0, 1)}

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from heathgrid.llm import byte_bpe, token_files
from heathgrid.shared import shared_folder

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, "Hello  world's été\n\n  ", "漢字🙂 0129 %%$$", "a" * 3000, " " * 500 + "x", "The the THE\tthe"]


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.encoder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


def test_equal_to_the_library_on_random_texts(encoder, library):
    rng = random.Random(3)
    letters = "aé \n\t  $%'sß漢🙂0129tTheingons"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(800)]
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        assert numbers(ids) == library.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def merged(encoder, piece):
    """Merging by rank, one pair at a time."""
    parts = [bytes([x]) for x in piece]
    while True:
        ranks = [(encoder.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        if not ranks or min(ranks)[0] == 1 << 60:
            return [encoder.ranks[x] for x in parts]
        i = min(ranks)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_appends_and_edits_keep_the_exact_tokens(encoder):
    rng = random.Random(4)
    piece = byte_bpe.Piece(encoder)
    for _ in range(60):
        if rng.random() < 0.5 or not piece.text:
            piece.append("".join(rng.choice("theingos") for _ in range(rng.randint(1, 9))).encode())
        else:
            start = rng.randrange(len(piece.text))
            piece.replace(start, min(len(piece.text), start + rng.randint(0, 4)), rng.choice([b"", b"t", b"ing"]))
        assert piece.tokens() == merged(encoder, piece.text)


def test_an_edit_computes_only_near_prefixes(encoder):
    piece = byte_bpe.Piece(encoder, b"thering" * 200)
    assert piece.replace(300, 301, b"zz") < 20 * encoder.longest
    assert piece.tokens() == merged(encoder, piece.text)


def test_round_trip_query_form(documents, library):
    docs = documents(*TEXTS).withColumn("ids", F.lit("clash"))
    found = {r.doc_id: r for r in byte_bpe.round_trip(docs, PATH, P.PATTERN).collect()}
    for i, text in enumerate(x or "" for x in TEXTS):
        ids = library.encode_ordinary(text)
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    coded = byte_bpe.encode(docs, PATH, P.PATTERN, ["doc_id"])
    back = byte_bpe.decode(coded, PATH, P.PATTERN, ["doc_id"]).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == {i: x or "" for i, x in enumerate(TEXTS)}
    assert byte_bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0


def flat_counts(tokens, eod):
    found, n = [], 0
    for x in tokens:
        if x == eod:
            found.append((n, True))
            n = 0
        else:
            n += 1
    return found + [(n, False)] * (n > 0)


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_token_counts_in_blocks(spark, block):
    rng, rows, want = random.Random(block), [], {}
    for file in range(5):
        tokens = [rng.choice([9, 9, 1, 2, 3, 4]) if file != 3 else 1 for _ in range(rng.randint(0, 60))]
        want |= {(file, i): x for i, x in enumerate(flat_counts(tokens, 9))}
        rows += [(file, k // block, bytearray(np.array(tokens[k : k + block], "<u2").tobytes())) for k in range(0, len(tokens), block)] or [(file, 0, None)]
    found = token_files.count(spark.createDataFrame(rows, "file long, block long, data binary"), 9, "<u2").collect()
    assert {(r.file, r.ordinal): (r.n_tokens, r.complete) for r in found} == want


def test_token_counts_of_real_files(spark, tmp_path):
    np.array([5, 6, 9, 9, 7, 7, 7, 9, 1], "<u2").tofile(tmp_path / "a.bin")
    np.array([], "<u2").tofile(tmp_path / "b.bin")
    blocks = token_files.read_files(spark, str(tmp_path), 4)
    found = token_files.count(blocks, 9, "<u2").orderBy("ordinal").collect()
    assert [(r.n_tokens, r.complete) for r in found] == [(2, True), (0, True), (3, True), (1, False)]


def test_token_counts_of_documents(spark, documents, library, monkeypatch):
    docs = documents(*TEXTS, (2, TEXTS[2], "en", "s"))
    found = token_files.count_documents(docs, shared_folder(spark), PATH, P.PATTERN, 50_256)
    want = sorted((i, len(library.encode_ordinary(x or ""))) for i, x in [*enumerate(TEXTS), (2, TEXTS[2])])
    assert sorted((r.doc_id, r.n_tokens) for r in found.collect()) == want
    blocks = token_files.write_blocks(docs, PATH, P.PATTERN, 50_256, block_tokens=5)
    assert sorted((r.doc_ids, r.n_tokens) for r in token_files.count(blocks, 50_256, "<u2", "doc_ids").collect()) == want


@pytest.mark.parametrize(("block", "span"), [(1, 1), (1, 3), (2, 4), (5, 2)])
def test_token_counts_in_spans_of_ranges(spark, tmp_path, block, span):
    rng, want = random.Random(block * 10 + span), {}
    for file in range(4):
        tokens = [rng.choice([9, 1, 2, 3, 4, 5]) if file != 3 else 1 for _ in range(rng.randint(0, 70))]
        np.array(tokens, "<u2").tofile(tmp_path / f"{file}.bin")
        want |= {(f"{file}.bin", i): x for i, x in enumerate(flat_counts(tokens, 9))}
    found = token_files.count(token_files.read_files(spark, str(tmp_path), 2 * block), 9, "<u2", span=span).collect()
    assert {(r.file.rsplit("/", 1)[-1], r.ordinal): (r.n_tokens, r.complete) for r in found} == want


def test_token_files_with_other_keys_and_without_rows(spark, documents, library, tmp_path):
    docs = documents(*TEXTS).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.concat(F.lit("d"), F.col("doc_id")))).withColumn("file", F.lit("clash"))
    found = token_files.count_documents(docs, str(tmp_path), PATH, P.PATTERN, 50_256, 6)
    want = {f"d{i}" if i else None: len(library.encode_ordinary(x or "")) for i, x in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in found.collect()} == want
    assert not token_files.count_documents(docs.limit(0), str(tmp_path), PATH, P.PATTERN, 50_256).collect()
    assert not list(tmp_path.iterdir())  # the files are gone

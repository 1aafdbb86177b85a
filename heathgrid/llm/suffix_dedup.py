"""Long repeated byte strings across documents, by prefix-free parsing.

Parsing. A rolling hash of every TRIGGER bytes is taken; in each window of LENGTH bytes the place of the
smallest hash (the first, if several) is the window's trigger. A phrase is a longest run of windows
with one trigger, with all bytes that they cover. Neighbouring phrases overlap by LENGTH - 1 bytes, so
each window lies in exactly one phrase, and equal windows have equal triggers at equal places, wherever
they stand: all windows of the corpus in order are those of the phrases.

Corpus order. The parse lists each phrase's places in the corpus. Places are grouped by trigger; equal
phrases of a group become one entry of the dictionary, whose smallest doc_id is known, and all its other
documents repeat it whole: for them nothing is left to compare. This settles the inside of copies and of
shared passages without looking at their bytes again. Only where a trigger has several phrases, which is
at the ends of shared passages and around edits, are the phrases' bytes fetched, once for each entry.
A suffix array of those dictionary entries, sorted to LENGTH bytes by prefix doubling, puts equal windows
next to each other; with the smallest doc_id of each entry from the parse this is the corpus order of
the windows, and tells for each window the smallest doc_id that has it.

Phrases are told apart by 112 bits of hashes of trigger and whole phrase, beside the bucket; windows by their bytes.

Distribution: triggers are dealt by hash into buckets, packed as byte columns, so a task holds the places
of one bucket, and a document's phrases spread over all buckets. Texts move twice, by doc_id: to fetch
phrases and to take out what is repeated. Results between are written to the shared folder.

Defined cases: null and empty texts have no bytes; texts shorter than LENGTH repeat nothing; rows with
the same doc_id are one document to each other (they don't repeat one another) and rows of equal bytes
stay alike; an empty table gives no rows; further columns stay unused. doc_id must be a whole number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heathgrid.llm.byte_features import BASE, hashes, mixed
from heathgrid.llm.common import bytes_of, shuffle_partitions, slices
from heathgrid.shared import written

LENGTH, TRIGGER = 50, 16
#: Bytes of a text that are parsed at once; longer texts are parsed in parts, which only cuts some phrases in two.
PART = 8 << 20
PLACE_BITS = 24


def rolling(flat: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each place on, by doubling."""
    out = np.zeros(max(0, len(flat) - size + 1), dtype=np.uint64)
    run, width, done = flat.astype(np.uint64) + np.uint64(1), 1, 0
    while size:
        factor = np.uint64(pow(int(BASE), width, 1 << 64))
        if size & 1:
            out = out * factor + run[done : done + len(out)]
            done += width
        size >>= 1
        if size:
            run = run[:-width] * factor + run[width:]
            width *= 2
    return mixed(out)


def smallest(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each `size` neighbours."""
    n, width = len(values) - size + 1, 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[:n], values[size - width : size - width + n])


def parse(flat: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of every phrase: text (number), start and size in its text, trigger and phrase (hashes)."""
    if len(offsets) == 2 and len(flat) > PART:
        parts = []
        for a in range(0, len(flat) - LENGTH + 1, PART):
            own = flat[a : a + PART + LENGTH - 1]
            parts.append(parse(own, np.array([0, len(own)])) if len(own) <= PART else parse_part(own, np.array([0, len(own)])))
            parts[-1]["start"] += a
        return {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}
    return parse_part(flat, offsets)


def parse_part(flat: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    if len(flat) < LENGTH:
        none = np.zeros(0, dtype=np.int64)
        return {"text": none, "start": none, "size": none, "trigger": none.astype(np.uint64), "phrase": none.astype(np.uint64)}
    rolled = rolling(flat, TRIGGER)
    keep = np.uint64((1 << PLACE_BITS) - 1)
    # a window's smallest value tells its trigger's place in the low bits, the first place among equals
    least = smallest((rolled & ~keep) | np.arange(len(rolled), dtype=np.uint64), LENGTH - TRIGGER + 1)
    inside = np.zeros(len(flat) + 1, dtype=np.int64)
    ends = np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])
    np.add.at(inside, offsets[:-1], 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[: len(least)]) > 0
    least[~inside] = np.uint64(0xFFFFFFFFFFFFFFFF)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    real = inside[first]
    first, last = first[real], last[real]
    text = np.searchsorted(offsets, first, side="right") - 1
    return {
        "text": text, "start": first - offsets[text], "size": last - first + LENGTH,
        # a smallest value is near zero, so its bits are mixed again before they deal triggers into buckets
        "trigger": mixed(rolled[(least[first] & keep).astype(np.int64)]), "phrase": hashes(flat, first, last + LENGTH),
    }


def pack(columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Unsigned numbers, each column as so many planes of one byte, which compress well where high bytes repeat."""
    return b"".join(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() for x, width in columns)


def unpack(data: bytes, widths: list[int], some: np.ndarray | None = None, first: int = 0, last: int | None = None) -> list[np.ndarray]:
    """Columns first to last, of all rows or of some."""
    n, out = len(data) // sum(widths), []
    for k in range(first, len(widths) if last is None else last):
        planes = np.frombuffer(data, dtype=np.uint8, count=n * widths[k], offset=n * sum(widths[:k])).reshape(widths[k], n)
        planes = planes if some is None else planes[:, some]
        full = np.zeros((planes.shape[1], 8), dtype=np.uint8)
        full[:, : widths[k]] = planes.T
        out.append(full.view("<u8").reshape(-1))
    return out


def cuts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin, and the length."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, dtype=np.int64)


#: Byte widths in packed form: trigger and phrase hashes, number in the row's list of documents, start, size.
PLACE = [6, 8, 3, 5, 1]
#: Start, size; the same with the trigger's rest; with the low bits of doc_id before them, for rows of several documents.
SPAN, ASKED = [5, 1], [5, 1, 6]
GROUP_BITS = 7
SPANS, ASKEDS = [1, *SPAN], [1, *ASKED]


def places(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, ids, data: the phrases of a slice of documents that belong to a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 19):
            found = parse(*bytes_of(batch.column("text")))
            ids = np.array(batch.column("doc_id").to_pylist(), dtype=np.int64)
            bucket = (found["trigger"] >> np.uint64(48)).astype(np.int64) * buckets >> 16
            # of the trigger's hash the bits that the bucket doesn't fix, and the phrase's whole hash
            columns = [found["trigger"] & np.uint64((1 << 48) - 1), found["phrase"], found["text"], found["start"], found["size"]]
            order = np.argsort(bucket, kind="stable")
            bucket, columns = bucket[order], [x[order] for x in columns]
            edges = cuts(bucket)
            rows = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                texts, number = np.unique(columns[2][a:b], return_inverse=True)
                rows.append((bucket[a], ids[texts].tobytes(), pack([(x, w) for x, w in zip([columns[0][a:b], columns[1][a:b], number, columns[3][a:b], columns[4][a:b]], PLACE, strict=True)])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "ids", "data"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "bucket long, ids binary, data binary")


def records(columns: list[np.ndarray], widths: list[int]) -> np.ndarray:
    """Unsigned numbers as rows of so many bytes a column."""
    return np.hstack([np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :w] for x, w in zip(columns, widths, strict=True)])


def of_records(data: bytes, widths: list[int]) -> list[np.ndarray]:
    rows, out, at = np.frombuffer(data, dtype=np.uint8).reshape(-1, sum(widths)), [], 0
    for w in widths:
        full = np.zeros((len(rows), 8), dtype=np.uint8)
        full[:, :w] = rows[:, at : at + w]
        out.append(full.view("<u8").reshape(-1).astype(np.int64))
        at += w
    return out


def by_doc(docs: np.ndarray, columns: list[np.ndarray], widths: list[int]) -> tuple[np.ndarray, pa.Array]:
    """Distinct docs in order, and the records of each."""
    order = np.argsort(docs, kind="stable")
    rows = records([x[order] for x in columns], widths)
    ids, first = np.unique(docs[order], return_index=True)
    ends = np.append(first, len(rows)) * rows.shape[1]
    return ids, pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


#: Bytes of packed places that are sorted together; a larger bucket is sorted in parts of about so many.
SHARE_BYTES = 8 << 20


def settle(table: pa.Table) -> pa.Table:
    """bucket, group (of neighbouring doc_ids), repeated, asked: of one bucket's places, those of phrases that a smaller doc_id has, and those of dictionary entries to compare."""
    held = [(np.frombuffer(ids, dtype=np.int64), data) for ids, data in zip(table["ids"].to_pylist(), table["data"].to_pylist(), strict=True)]
    shares = 1 + sum(len(data) for _, data in held) // SHARE_BYTES
    share = [(unpack(data, PLACE, last=1)[0] % np.uint64(shares)).astype(np.uint32) if shares > 1 else None for _, data in held]
    repeats, questions = [], []
    for k in range(shares):
        parts = []
        for (ids, data), own in zip(held, share, strict=True):
            trigger, phrase, number, start, size = unpack(data, PLACE, None if own is None else np.flatnonzero(own == k))
            parts.append((trigger, phrase, ids[number.astype(np.int64)], start, size))
        found = settle_share(*(np.concatenate([p[i] for p in parts]) for i in range(5)))
        repeats.append(found[0])
        questions.append(found[1])
    low = (1 << GROUP_BITS) - 1
    spans = lambda c, widths: by_doc(c[0] >> GROUP_BITS, [c[0] & low, *c[1:]], widths)
    whole = spans([np.concatenate([r[i] for r in repeats]) for i in range(3)], SPANS)
    some = spans([np.concatenate([q[i] for q in questions]) for i in range(4)], ASKEDS)
    ids = np.union1d(whole[0], some[0])
    place = lambda x: pa.array(np.searchsorted(x[0], ids), mask=~np.isin(ids, x[0]))
    return pa.table([pa.array(np.full(len(ids), table["bucket"][0].as_py())), pa.array(ids), whole[1].take(place(whole)), some[1].take(place(some))], names=["bucket", "group", "repeated", "asked"])


def gather(table: pa.Table) -> pa.Table:
    """doc_id, repeated, asked (list of bucket and records): what all buckets found of the documents of one group."""
    high = table["group"][0].as_py() << GROUP_BITS
    repeated: dict[int, list[bytes]] = {}
    asked: dict[int, list[dict]] = {}
    for bucket, spans, questions in zip(*(table[k].to_pylist() for k in ("bucket", "repeated", "asked")), strict=True):
        for data, widths in ((spans, SPANS), (questions, ASKEDS)):
            if not data:
                continue
            rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, sum(widths))
            order = np.argsort(rows[:, 0], kind="stable")
            rows = rows[order]
            edges = cuts(rows[:, 0])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                doc, own = high + int(rows[a, 0]), rows[a:b, 1:].tobytes()
                if widths is SPANS:
                    repeated.setdefault(doc, []).append(own)
                else:
                    asked.setdefault(doc, []).append({"bucket": bucket, "data": own})
    ids = sorted(repeated.keys() | asked.keys())
    kind = pa.list_(pa.struct([("bucket", pa.int64()), ("data", pa.binary())]))
    return pa.table([pa.array(ids, pa.int64()), pa.array([b"".join(repeated[i]) if i in repeated else None for i in ids], pa.binary()), pa.array([asked.get(i) for i in ids], kind)], names=["doc_id", "repeated", "asked"])


def settle_share(trigger: np.ndarray, phrase: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(doc, start, size) of repeated places and (doc, start, size, trigger) of those to compare, from whole groups of a trigger."""
    if not len(trigger):
        return [doc, start, size], [doc, start, size, trigger]
    order = np.lexsort((doc, phrase, trigger))
    trigger, phrase, doc = trigger[order], phrase[order], doc[order]
    new_trigger = np.concatenate([[True], trigger[1:] != trigger[:-1]])
    new_entry = new_trigger | np.concatenate([[True], phrase[1:] != phrase[:-1]])
    entry = np.cumsum(new_entry) - 1
    least = doc[new_entry]  # of each entry the smallest doc_id
    repeated = doc > least[entry]
    group = np.cumsum(new_trigger) - 1
    entries = np.bincount(group[new_entry])
    first = np.flatnonzero(new_trigger[new_entry])
    several = (entries > 1) & (np.minimum.reduceat(least, first) < np.maximum.reduceat(least, first))
    asked = ~repeated & several[group]
    a, b = order[repeated], order[asked]
    narrow = lambda x, at: [x, start[at].astype(np.uint64 if len(start) and start.max() >> 32 else np.uint32), size[at].astype(np.uint8)]
    return narrow(doc[repeated], a), [*narrow(doc[asked], b), trigger[asked]]


def fetch(asked: DataFrame) -> DataFrame:
    """bucket, data, bytes: the phrases that documents (doc_id, text, asked: list of structs of bucket and data) were asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, offsets = bytes_of(batch.column("text"))
            held: dict[int, list] = {}
            for i, (doc, rows) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
                for r in rows:
                    start, size, trigger = of_records(r["data"], ASKED)
                    fits = start + size <= offsets[i + 1] - offsets[i]  # rows of one doc_id may hold other texts
                    held.setdefault(r["bucket"], []).append((start[fits] + offsets[i], start[fits], size[fits], trigger[fits], np.full(fits.sum(), doc)))
            rows = []
            for bucket, parts in held.items():
                at, start, size, trigger, doc = (np.concatenate([p[k] for p in parts]) for k in range(5))
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at, size)
                rows.append((bucket, doc.tobytes(), pack([(start, 5), (size, 1), (trigger, 6)]), flat[place].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["bucket", "ids", "data", "bytes"])

    return asked.mapInArrow(run, "bucket long, ids binary, data binary, bytes binary")


def ranked(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of ranks, or of numbers."""
    key = keys[0] if len(keys) == 1 else keys[0] * np.uint64(keys[1].max() + 1 if len(keys[1]) else 1) + keys[1]
    return np.unique(key, return_inverse=True)[1].astype(np.uint64)


def window_ranks(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks in suffix order, to LENGTH bytes, of the suffixes of flat at starts; each must have LENGTH bytes before flat ends."""
    padded = np.concatenate([flat, np.zeros(LENGTH, dtype=np.uint8)])
    word = np.zeros(len(padded) - 7, dtype=np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : len(word) + k]
    rank, width = ranked(word), 8
    while 2 * width <= LENGTH:
        rank = ranked(rank[:-width], rank[width:])
        width *= 2
    return ranked(rank[starts], rank[starts + LENGTH - width])


#: Bytes of dictionary entries that are sorted together.
SORTED = 1 << 20


def compare(table: pa.Table) -> pa.Table:
    """doc_id, repeated: of one bucket's dictionary entries, the stretches whose windows a smaller doc_id has."""
    parts = []
    for ids, data, held in zip(table["ids"].to_pylist(), table["data"].to_pylist(), table["bytes"].to_pylist(), strict=True):
        parts.append((*(x.astype(np.int64) for x in unpack(data, ASKED)), np.frombuffer(ids, dtype=np.int64), np.frombuffer(held, dtype=np.uint8)))
    start, size, trigger, doc = (np.concatenate([p[k] for p in parts]) for k in range(4))
    flat, at = np.concatenate([p[4] for p in parts]), np.cumsum(size) - size
    order = np.argsort(trigger, kind="stable")
    # windows of different triggers differ, so entries can be sorted in parts that each hold whole triggers
    edges = cuts(trigger[order])
    ends = np.cumsum(size[order])[edges[1:] - 1]
    found, a = [], 0
    while a < len(edges) - 1:
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + SORTED, side="right")))
        some = order[edges[a] : edges[b]]
        found.append(compare_part(flat, at[some], start[some], size[some], doc[some]))
        a = b
    columns = [np.concatenate([f[k] for f in found]) for k in range(3)]
    ids, spans = by_doc(columns[0], columns[1:], SPAN)
    return pa.table([pa.array(ids), spans], names=["doc_id", "repeated"])


def compare_part(flat: np.ndarray, at: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start, size of stretches, from entries that lie at `at` in flat."""
    own = np.cumsum(size) - size
    flat = flat[np.arange(size.sum()) - np.repeat(own - at, size)]
    # windows of all entries: their entry, and their place in it
    count = size - LENGTH + 1
    entry = np.repeat(np.arange(len(size)), count)
    shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    rank = window_ranks(flat, own[entry] + shift).astype(np.int64)
    least = np.full(rank.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, rank, doc[entry])
    hit = np.flatnonzero(least[rank] < doc[entry])
    if not len(hit):
        return hit, hit, hit
    # neighbouring windows of an entry make one stretch
    new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (entry[hit[1:]] != entry[hit[:-1]])])
    a, b = hit[new], hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1]
    return doc[entry[a]], start[entry[a]] + shift[a], shift[b] - shift[a] + LENGTH


def merge(parts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that packed spans cover in a text of n bytes."""
    start, size = of_records(b"".join(parts), SPAN)
    end = start + size
    start, end = start[end <= n], end[end <= n]
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.flatnonzero(new)[1:], len(end)) - 1]


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, repeated: packed spans, in one row or several of a document, that a smaller doc_id has."""
    buckets = min(1 << 16, 2 * shuffle_partitions(docs.sparkSession))  # of half a partition's size, as a task holds a whole one
    kinds = "doc_id long, repeated binary, asked array<struct<bucket: bigint, data: binary>>"
    # neighbouring documents share rows until all buckets meet, or each bucket would make a row of each document
    settled = written(places(docs, buckets).groupBy("bucket").applyInArrow(settle, "bucket long, `group` long, repeated binary, asked binary").groupBy("group").applyInArrow(gather, kinds))
    compared = written(compare_asked(docs, settled))
    return settled.where("repeated is not null").select("doc_id", "repeated").union(compared)


def compare_asked(docs: DataFrame, settled: DataFrame) -> DataFrame:
    """doc_id, repeated: what comparing the dictionary entries that settle() asked for finds."""
    asked = settled.where("asked is not null").select(F.col("doc_id").alias("its_doc"), "asked")
    fetched = fetch(docs.select("doc_id", "text").join(asked, F.col("doc_id") == F.col("its_doc")).select("doc_id", "text", "asked"))
    return fetched.groupBy("bucket").applyInArrow(compare, "doc_id long, repeated binary")


def strip(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) of every row."""
    spans = repeats(docs).groupBy(F.col("doc_id").alias("its_doc")).agg(F.collect_list("repeated").alias("spans"))
    joined = docs.select("doc_id", "text").join(spans, F.col("doc_id") == F.col("its_doc"), "left").select("doc_id", "text", "spans")
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, offsets = bytes_of(batch.column("text"))
            rows = []
            for i, (doc, parts) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                own = flat[offsets[i] : offsets[i + 1]]
                start, end = merge(parts or [], len(own))
                stays = np.concatenate([[0], end]), np.concatenate([start, [len(own)]])
                kept = b"".join(own[a:b].tobytes() for a, b in zip(*stays, strict=True))
                rows.append((doc, len(own), len(own) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

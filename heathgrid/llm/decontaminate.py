"""Training texts that hold test items, whole, edited or paraphrased.

Each test item is cut into pairs of words that stand next to each other or have one word between them.
A first pass over the corpus counts in how many texts each pair stands; an item's rarer pairs, by these
counts, are its seeds. A second pass joins texts to items that share a seed, and aligns the item's words
with the text's words around the seeds by Smith-Waterman. An alignment's score is its points as a share
of those of the whole item. No alignment that reaches THRESHOLD is without a seed (least_pairs).

Words are runs of letters, digits and non-ASCII characters, with A-Z in lower case. The test set is
read in blocks of a bounded size, and each block goes to all texts; the join can't grow a hot key, as
texts don't move.

Defined cases: null and empty texts hold no item; null items and items of fewer than SHORTEST words
prove nothing and match nothing; repeated texts are reported each time, repeated item ids for each of
their texts; empty tables give no rows; further columns stay unused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heathgrid.llm.byte_features import LETTERS, LOWER, hashes, mixed, spans
from heathgrid.llm.common import bytes_of, slices
from heathgrid.shared import fresh

GRAM = 3
SHORTEST = 5
#: Of an item's n-grams so large a share, the rarest, and so many at least, are its seeds.
SEEDS, LEAST_SEEDS = 2 / 3, 12
MATCH, MISMATCH, GAP = 2, -1, -1
#: The least share of an item's points that makes a text contaminated.
THRESHOLD = 0.5
#: Characters and items of the test set that travel to the executors together.
BLOCK_CHARS, BLOCK_ITEMS = 4 << 20, 20_000


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, and each text's first word in them."""
    flat, offsets = bytes_of(texts)
    flat = LOWER[flat]
    starts, ends = spans(flat, offsets, LETTERS)
    return hashes(flat, starts, ends), np.searchsorted(starts, offsets)


def grams_of(words: np.ndarray) -> np.ndarray:
    if len(words) < GRAM:
        return np.zeros(0, dtype=np.uint64)
    n = len(words) - GRAM + 1
    code = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        code = mixed(code * np.uint64(0x2545F4914F6CDD1D) + words[k : n + k])
    return code


def pairs_of(words: np.ndarray, apart: int) -> np.ndarray:
    """Each word with the one `apart` words on; the number doesn't depend on `apart`."""
    return mixed(mixed(words[:-apart] * np.uint64(0x2545F4914F6CDD1D)) + words[apart:])


def least_pairs(n: int) -> int:
    """Of how many words, at least, an item of n words has its pair in each text that it matches.

    m matches less a penalty of at least 1 for each fault make THRESHOLD * 2 n points, so at most
    2 m - THRESHOLD * 2 n faults lie in the m - 1 steps from a match to the next one, and at least
    THRESHOLD * n - 1 steps have one fault or none: they are pairs, in the item as in the text.
    """
    return max(1, int(np.ceil(THRESHOLD * n - 1)))


class Finder:
    """Places of a fixed set of 64-bit numbers in long arrays."""

    def __init__(self, wanted: np.ndarray):
        self.wanted = np.unique(wanted)
        self.bits = max(10, int(np.ceil(np.log2(len(self.wanted) + 1))) + 5)
        self.maybe = np.zeros(1 << self.bits, dtype=bool)
        self.maybe[self.wanted >> np.uint64(64 - self.bits)] = True

    def __call__(self, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and the index in `wanted` of what stands there."""
        at = np.flatnonzero(self.maybe[among >> np.uint64(64 - self.bits)])
        which = np.searchsorted(self.wanted, among[at])
        right = which < len(self.wanted)
        right[right] = self.wanted[which[right]] == among[at][right]
        return at[right], which[right]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Points of the best local alignment, and the text's words [start, end) that it spans."""
    n = len(text)
    rise = -GAP * np.arange(n + 1)
    row, begin = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        across = row[:-1] + np.where(text == word, MATCH, MISMATCH)
        new, start = np.maximum(row + GAP, 0), np.where(row + GAP > 0, begin, np.arange(n + 1))
        better = across > new[1:]
        new[1:][better] = across[better]
        start[1:][better] = begin[:-1][better]
        # a gap in the item runs along the row: the highest start less what the way from it costs
        lifted = new + rise
        top = np.maximum.accumulate(lifted)
        fresh = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        row, begin = top - rise, start[fresh]
        j = int(row.argmax())
        if row[j] > best[0]:
            best = int(row[j]), int(begin[j]), j
    return best


class Items:
    """A block of test items and, once counts are known, their seeds: the rarer n-grams, which an edited copy may lack."""

    def __init__(self, ids: list, texts: list[str]):
        words, first = words_of(pa.array(texts, type=pa.large_string()))
        own = [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        kept = [i for i, x in enumerate(own) if len(x) >= SHORTEST]
        self.ids, self.words = [ids[i] for i in kept], [own[i] for i in kept]
        self.grams = [grams_of(x) for x in self.words]
        self.all = Finder(np.concatenate([*self.grams, np.zeros(0, np.uint64)]))

    def seed(self, counts: np.ndarray) -> None:
        """Choose seeds by the number of texts that hold each of all.wanted."""
        chosen = []
        for i, x in enumerate(self.grams):
            often = counts[np.searchsorted(self.all.wanted, x)]
            order = np.lexsort((np.arange(len(x)), often))[: max(LEAST_SEEDS, int(np.ceil(SEEDS * len(x))))]
            chosen += [(x[k], i, k) for k in order]
        self.seeds = Finder(np.array([x for x, _, _ in chosen], dtype=np.uint64))
        at = np.searchsorted(self.seeds.wanted, np.array([x for x, _, _ in chosen], dtype=np.uint64))
        self.of: list[list[tuple[int, int]]] = [[] for _ in self.seeds.wanted]
        for k, (_, i, place) in zip(at.tolist(), chosen, strict=True):
            self.of[k].append((i, place))

    def matches(self, words: np.ndarray, places: np.ndarray, which: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, last word) of the items that a text holds; places and which are its seeds."""
        lines: dict[int, set[int]] = {}
        for p, k in zip(places.tolist(), which.tolist(), strict=True):
            for i, q in self.of[k]:
                lines.setdefault(i, set()).add(p - q)
        found = []
        for i, starts in lines.items():
            item, best = self.words[i], (0, 0, 0)
            n, run = len(item), []
            for s in [*sorted(starts), None]:
                if run and (s is None or s - run[-1] > n):
                    a, b = max(0, run[0] - n), min(len(words), run[-1] + 2 * n)
                    part = words[a:b]
                    if self.likely(i, part):
                        points, start, end = align(item, part)
                        best = max(best, (points, a + start, a + end - 1))
                    run = []
                if s is not None:
                    run.append(s)
            score = best[0] / (MATCH * n)
            if score >= THRESHOLD:
                found.append((i, score, best[1], best[2]))
        return found

    def likely(self, i: int, part: np.ndarray) -> bool:
        # an item's word can only match where the text has it
        return np.isin(self.words[i], part).sum() >= THRESHOLD * len(self.words[i])


class Paired(Items):
    """A block of test items whose seeds are pairs of words: no match is without one."""

    def __init__(self, ids: list, texts: list[str]):
        super().__init__(ids, texts)
        # by the pair's first word: with the next word, and with the one after it where there is one
        self.pairs = []
        for x in self.words:
            near = pairs_of(x, 1)
            self.pairs.append(np.stack([near, np.append(pairs_of(x, 2), near[-1])], axis=1))
        self.all = Finder(np.concatenate([*map(np.ravel, self.pairs), np.zeros(0, np.uint64)]))

    def seed(self, counts: np.ndarray) -> None:
        """Choose seeds by the number of texts that hold each of all.wanted: the pairs of so many words that too few are left for a match."""
        chosen = []
        for i, x in enumerate(self.pairs):
            often = counts[np.searchsorted(self.all.wanted, x)].sum(axis=1)
            order = np.argsort(often, kind="stable")[: len(x) - least_pairs(len(self.words[i])) + 1]
            chosen += [(pair, i, k) for k in order.tolist() for pair in np.unique(x[k])]
        self.seeds = Finder(np.array([x for x, _, _ in chosen], dtype=np.uint64))
        at = np.searchsorted(self.seeds.wanted, np.array([x for x, _, _ in chosen], dtype=np.uint64))
        self.of = [[] for _ in self.seeds.wanted]
        for k, (_, i, place) in zip(at.tolist(), chosen, strict=True):
            self.of[k].append((i, place))

    def likely(self, i: int, part: np.ndarray) -> bool:
        there = np.isin(self.pairs[i], np.concatenate([pairs_of(part, 1), pairs_of(part, 2)]))
        return there.any(axis=1).sum() >= least_pairs(len(self.words[i])) and super().likely(i, part)


def found_pairs(finder: Finder, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place of the first word and index in finder.wanted of each pair that is wanted, in the order of places."""
    out = []
    for apart in (1, 2):
        at, which = finder(pairs_of(words, apart))
        text = np.searchsorted(first, at, side="right") - 1
        inside = at + apart < first[text + 1]
        out.append((text[inside], at[inside], which[inside]))
    text, at, which = map(np.concatenate, zip(*out, strict=True))
    order = np.argsort(at, kind="stable")
    return text[order], at[order], which[order]


def blocks(benchmark: DataFrame) -> Iterator[Paired]:
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if ids and (size + len(r.text) > BLOCK_CHARS or len(ids) >= BLOCK_ITEMS):
            yield Paired(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
    if ids:
        yield Paired(ids, texts)


def pair_counts(docs: DataFrame, items: Paired) -> np.ndarray:
    """In how many texts each of the block's pairs stands."""
    held = docs.sparkSession.sparkContext.broadcast(items.all)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = held.value
        total = np.zeros(len(finder.wanted), dtype=np.int64)
        for batch in slices(batches):
            words, first = words_of(batch.column("text"))
            text, _, which = found_pairs(finder, words, first)
            pairs = np.unique(text * len(total) + which)
            total += np.bincount(pairs % max(1, len(total)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["pair", "n"])

    counts = np.zeros(len(items.all.wanted), dtype=np.int64)
    for pair, n in docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        counts[pair] = n
    return counts


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word: one row for each text and test item that it holds."""
    kinds = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, score double, first_word long, last_word long"
    spark, out = docs.sparkSession, None
    for items in blocks(benchmark):
        items.seed(pair_counts(docs, items))
        held = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = held.value
            for batch in slices(batches):
                words, first = words_of(batch.column("text"))
                text, at, which = found_pairs(own.seeds, words, first)
                rows = []
                for i in np.unique(text):
                    a, b = np.searchsorted(text, (i, i + 1))
                    rows += [(i, *x) for x in own.matches(words[first[i] : first[i + 1]], at[a:b] - first[i], which[a:b])]
                i, item, score, start, end = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(i, pa.int64())), pa.array([own.ids[x] for x in item], pa.int64()), pa.array(score, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                    names=["doc_id", "item_id", "score", "first_word", "last_word"],
                )

        rows = docs.select("doc_id", "text").mapInArrow(run, kinds)
        out = rows if out is None else out.union(rows)
    return spark.createDataFrame([], kinds) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no test item, with docs' own columns."""
    (own,) = fresh(docs, "its_doc")
    dirty = find(docs, benchmark).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(dirty, F.col("doc_id").eqNullSafe(F.col(own)), "left_anti").select(*docs.columns)

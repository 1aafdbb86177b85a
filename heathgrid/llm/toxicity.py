"""Toxicity by a bidirectional gated recurrent network with attention pooling over words and characters.

A word's input is a learned vector of the word plus the mean of learned vectors of its character
n-grams, all hashed. Every text is cut into overlapping windows of words, each one half a window after
the one before, so that all of it is scored. In a window one gated recurrent network reads forwards
and one backwards; attention weighs their joined states, and a logistic unit reads the weighted sum. A
text's score is that of its highest window.

The network is trained in numpy by backpropagation through time. Labels mark whole texts, so in each
round the network scores all windows of the sample and learns from each text's highest one, and from
one more of every clean text. Input vectors start from how much more often toxic texts of the sample
hold a word or n-gram than clean ones do.

The sample is at most `most` rows a class, those with the smallest hashes of doc_id, of the rows that
the training condition allows; every text of the corpus is scored.

Defined cases: null texts, empty texts and texts without a word are one window without words; labels
without a document and null labels teach nothing; without labels of both classes every text scores
0.5; repeated rows score alike; an empty table gives no rows; further columns stay unused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heathgrid.llm.byte_features import LETTERS, LOWER, grams, hashes, spans
from heathgrid.llm.common import bytes_of, slices
from heathgrid.llm.quality_classifier import sample

WORD_BITS, GRAM_BITS, WIDTH, HIDDEN = 14, 13, 10, 8
WINDOW = 32
#: The most labelled rows of each class that training reads.
SAMPLE = 1000
#: Rounds at least, and steps at least: a small sample is gone over more often.
ROUNDS, STEPS, BATCH, RATE = 10, 500, 64, 0.02
#: Share of the words that a training step doesn't see.
DROPPED = 0.1
#: Windows that go through the network together.
TOGETHER = 4096


class Words:
    """The words of some texts: of each word its text, and of each distinct word its hashed inputs."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        flat = LOWER[flat]
        starts, ends = spans(flat, offsets, LETTERS)
        _, first, self.which = np.unique(hashes(flat, starts, ends), return_index=True, return_inverse=True)
        a, b = starts[first], ends[first]
        self.word = (hashes(flat, a, b) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        # each distinct word has its 3-byte runs and its first four and five bytes
        runs = np.maximum(b - a - 2, 0)
        self.of = np.repeat(np.arange(len(a)), runs)
        at = np.arange(len(self.of)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(a, runs)
        found = [grams(flat, 3)[at]] if len(at) else [np.zeros(0, np.uint64)]
        whose = [self.of]
        for size in (4, 5):
            long = np.flatnonzero(b - a >= size)
            whose.append(long)
            found.append(hashes(flat, a[long], a[long] + size))
        self.of = np.concatenate(whose)
        self.gram = (np.concatenate(found) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)
        order = np.argsort(self.of, kind="stable")
        self.of, self.gram = self.of[order], self.gram[order]
        self.per = np.maximum(np.bincount(self.of, minlength=len(a)), 1)
        self.count = np.diff(np.searchsorted(starts, offsets))
        self.n_texts = len(offsets) - 1

    def windows(self, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Of each window the distinct word at each place (-1: none), and its text."""
        step = size // 2
        number = np.maximum(1, -(-(self.count - step) // step))
        text = np.repeat(np.arange(self.n_texts), number)
        start = (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)) * step
        base = (np.cumsum(self.count) - self.count)[text] + start
        place = base[:, None] + np.arange(size)
        inside = start[:, None] + np.arange(size) < self.count[text][:, None]
        if not len(self.which):
            return np.full(place.shape, -1), text
        return np.where(inside, self.which[np.minimum(place, len(self.which) - 1)], -1), text


def squash(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"word": draw(1 << WORD_BITS, WIDTH, scale=0.1), "gram": draw(1 << GRAM_BITS, WIDTH, scale=0.1)}
        for side in "fb":
            self.p |= {f"w{side}": draw(WIDTH, 3 * HIDDEN, scale=0.4), f"u{side}": draw(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"attend": draw(2 * HIDDEN, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
        self.trained = False

    def inputs(self, words: Words, some: slice | np.ndarray = slice(None)) -> np.ndarray:
        sums = np.zeros((len(words.word), WIDTH), np.float32)
        if len(words.of):
            first = np.flatnonzero(np.diff(words.of, prepend=-1))
            sums[words.of[first]] = np.add.reduceat(self.p["gram"][words.gram], first, axis=0)
        return (self.p["word"][words.word] + sums / words.per[:, None])[some]

    def run(self, x: np.ndarray, side: str, there: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (place, window, unit) of one direction, over projected inputs x (place, window, 3 gates)."""
        u, n = self.p[f"u{side}"], HIDDEN
        h, states, kept = np.zeros((x.shape[1], n), np.float32), np.empty((*x.shape[:2], n), np.float32), []
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            before, own = h, h @ u
            gates = squash(x[t, :, : 2 * n] + own[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            new = np.tanh(x[t, :, 2 * n :] + r * own[:, 2 * n :])
            h = (new + z * (before - new)) * there[t][:, None]
            states[t] = h
            if keep:
                kept.append((t, before, own[:, 2 * n :], z, r, new))
        return states, kept

    def forward(self, vectors: np.ndarray, which: np.ndarray, keep: bool = False):
        """Logits of windows, which hold rows of vectors; with keep, what backpropagation needs."""
        places = which.T
        there = (places >= 0).astype(np.float32)
        projected = {s: np.vstack([vectors @ self.p[f"w{s}"] + self.p[f"c{s}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for s in "fb"}
        both = {s: self.run(projected[s][places], s, there, keep) for s in "fb"}
        states = np.concatenate([both["f"][0], both["b"][0]], axis=2)
        weight = states @ self.p["attend"] - 1e4 * (1 - there)
        weight = np.exp(weight - weight.max(axis=0)) * there
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        logits = pooled @ self.p["out"] + self.p["bias"][0]
        return (logits, (places, there, both, states, weight, pooled)) if keep else logits

    def gradients(self, vectors: np.ndarray, which: np.ndarray, y: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss; "x" is that of vectors."""
        logits, (places, there, both, states, weight, pooled) = self.forward(vectors, which, keep=True)
        slope = ((squash(logits) - y) * importance / len(y)).astype(np.float32)
        g = {"out": slope @ pooled, "bias": slope.sum(keepdims=True), "x": np.zeros_like(vectors)}
        back = slope[:, None] * self.p["out"]
        share = np.einsum("bh,tbh->tb", back, states)
        share = weight * (share - (weight * share).sum(axis=0))
        g["attend"] = np.einsum("tb,tbh->h", share, states)
        all_states = weight[:, :, None] * back + share[:, :, None] * self.p["attend"]
        n = HIDDEN
        for s, part in (("f", all_states[:, :, :n]), ("b", all_states[:, :, n:])):
            u, carried, du, dx = self.p[f"u{s}"], np.zeros_like(part[0]), np.zeros_like(self.p[f"u{s}"]), np.empty((*places.shape, 3 * n), np.float32)
            for t, before, own, z, r, new in reversed(both[s][1]):
                dh = (part[t] + carried) * there[t][:, None]
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (before - new) * z * (1 - z)
                dr = dn * own * r * (1 - r)
                dx[t] = np.concatenate([dz, dr, dn], axis=1)
                du_in = np.concatenate([dz, dr, dn * r], axis=1)
                du += before.T @ du_in
                carried = dh * z + du_in @ u.T
            flat, rows = dx.reshape(-1, 3 * n), places.reshape(-1)
            flat, rows = flat[rows >= 0], rows[rows >= 0]
            sums = np.zeros((len(vectors), 3 * n), np.float32)
            np.add.at(sums, rows, flat)
            g[f"u{s}"], g[f"c{s}"], g[f"w{s}"] = du, flat.sum(axis=0), vectors.T @ sums
            g["x"] += sums @ self.p[f"w{s}"].T
        return g

    def logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Of every window its logit and its text."""
        which, text = words.windows()
        vectors = self.inputs(words)
        return np.concatenate([self.forward(vectors, which[k : k + TOGETHER]) for k in range(0, len(which), TOGETHER)] or [np.zeros(0)]), text

    def score(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not self.trained:
            return np.full(n, 0.5)
        found, text = self.logits(Words(flat, offsets))
        most = np.full(n, -np.inf)
        np.maximum.at(most, text, found)
        return 1 / (1 + np.exp(-np.clip(most, -30, 30)))

    def start_from(self, words: Words, y: np.ndarray) -> None:
        """Set the first input of each word and n-gram by how it divides the texts."""
        doc = np.repeat(np.arange(words.n_texts), words.count)
        pairs = np.unique(doc * len(words.word) + words.which)
        doc, distinct = pairs // len(words.word), pairs % len(words.word)
        of_gram = np.searchsorted(words.of, np.arange(len(words.word) + 1))
        size = np.diff(of_gram)[distinct]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(of_gram[distinct], size)
        for name, bits, whose, what in (("word", WORD_BITS, doc, words.word[distinct]), ("gram", GRAM_BITS, np.repeat(doc, size), words.gram[place])):
            once = np.unique(whose * (1 << bits) + what)
            whose, what = once >> bits, once & ((1 << bits) - 1)
            toxic, clean = (np.bincount(what[y[whose] == k], minlength=1 << bits) for k in (1, 0))
            odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / ((1 - y).sum() + 1))
            self.p[name][:, 0] = np.where(toxic + clean >= 3, np.clip(odds, -1, 4), 0) / 4

    def train(self, texts: list[str], labels: list[int], seed: int = 0) -> Network:
        y = np.array(labels, dtype=np.int64)
        if len(set(labels)) < 2:
            return self
        rng = np.random.default_rng(seed)
        self.trained = True
        words = Words(*bytes_of(pa.array(texts, type=pa.large_string())))
        self.start_from(words, y)
        which, text = words.windows()
        of_gram = np.searchsorted(words.of, np.arange(len(words.word) + 1))
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items() if k not in ("word", "gram")}
        squares = {k: np.zeros_like(self.p[k]) for k in ("word", "gram")}
        heavy = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())).clip(0, 6)
        step = 0
        # the first look at a text: the window whose words stand out most
        lead = (self.p["word"][words.word, 0])[which] * (which >= 0)
        lead = np.sort(lead, axis=1)[:, -2:].sum(axis=1)
        trust = min(1.0, len(y) / 1500) ** 2  # few texts would be learnt by heart through their rare words
        rounds = max(ROUNDS, STEPS * BATCH // (2 * len(y)))
        for turn in range(rounds):
            if turn > 1 and turn % 2 == 0:
                lead = np.concatenate([self.forward(vectors, which[k : k + TOGETHER]) for vectors in [self.inputs(words)] for k in range(0, len(which), TOGETHER)])
            order = np.lexsort((lead, text))
            top = order[np.flatnonzero(np.diff(text[order], append=-1))]
            more = order[np.searchsorted(text[order], np.arange(len(y)), side="left") + (rng.random(len(y)) * np.bincount(text, minlength=len(y))).astype(np.int64)]
            chosen = rng.permutation(np.concatenate([top, more[y[text[more]] == 0]]))
            rate = RATE * (1 - 0.9 * turn / rounds)
            for k in range(0, len(chosen), BATCH):
                windows = which[chosen[k : k + BATCH]]
                windows = np.where(rng.random(windows.shape) < DROPPED, -1, windows)  # so that no word is needed
                distinct, local = np.unique(windows, return_inverse=True)
                local = local.reshape(windows.shape) - (distinct[0] < 0)
                distinct = distinct[distinct >= 0]
                sizes = of_gram[distinct + 1] - of_gram[distinct]
                place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(of_gram[distinct], sizes)
                whose = np.repeat(np.arange(len(distinct)), sizes)
                vectors = self.p["word"][words.word[distinct]]
                part = np.zeros_like(vectors)
                np.add.at(part, whose, self.p["gram"][words.gram[place]])
                vectors = vectors + part / words.per[distinct][:, None]
                own = text[chosen[k : k + BATCH]]
                g = self.gradients(vectors, local, y[own], heavy[own])
                step += 1
                for name, (m, v) in moments.items():
                    m += 0.1 * (g[name] - m)
                    v += 0.01 * (g[name] ** 2 - v)
                    self.p[name] -= rate * 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                for name, rows, slopes in (("word", words.word[distinct], g["x"]), ("gram", words.gram[place], (g["x"] / words.per[distinct][:, None])[whose])):
                    once, back = np.unique(rows, return_inverse=True)
                    sums = np.zeros((len(once), WIDTH), np.float32)
                    np.add.at(sums, back, slopes)
                    squares[name][once] += sums * sums
                    self.p[name][once] -= rate * trust * sums / (np.sqrt(squares[name][once]) + 1e-6)
        return self


def fit(docs: DataFrame, labels: DataFrame, column: str, allowed: Column, most: int = SAMPLE) -> Network:
    rows = [
        (r.doc_id, r.text, r.label)
        for k in (0, 1)
        for r in sample(docs, labels.where(F.col(column) == k), column, allowed, most).toLocalIterator()
    ]
    rows.sort()
    return Network().train([r[1] for r in rows], [r[2] for r in rows])


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id and score of every row; the network's size doesn't depend on the data."""
    held = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            found = held.value.score(*bytes_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")

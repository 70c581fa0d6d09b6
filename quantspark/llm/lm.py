"""LM scoring: masked pseudo-likelihood under a bidirectional window network trained in numpy, rare words by their bytes."""

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.common import SPACE_WORDS, WordHasher, bytes_of, cut, drop, groups_of_texts, joined, mix, release, small_batches


@dataclass(frozen=True)
class LMConfig:
    #: Words of the network: this many times the square root of the number of documents, within bounds (a word's row is
    #: held by the driver and every task). Other words are spelled by their bytes.
    growth: float = 16.0
    least_words: int = 127
    most_words: int = 32767
    #: Words on either side; hidden units, one of which is constant.
    side: int = 3
    hidden: int = 16
    #: Least documents of a task, of training and of the speller (whose table is larger); share of the documents that
    #: make the first common network, from which a pass over all then starts.
    docs_per_task: int = 3000
    docs_per_speller: int = 12000
    warm_up: float = 0.1
    batch: int = 4096
    #: Consecutive words of a text that go into a batch together: their contexts overlap, so each is read once, not six times.
    run: int = 16
    #: Inner nodes nearest to the root that are worked on as one matrix; only the cost depends on it.
    near_root: int = 15
    rate: float = 0.25
    fan_in: int = 16
    seed: int = 17
    #: Rows of the speller's table: so many a document, a power of two up to the greatest. Buckets of neighbouring
    #: words; weight of the shorter context.
    rows_per_doc: int = 32
    max_rows: int = 1 << 18
    buckets: int = 1024
    backoff: float = 2.0


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += np.uint8(32)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORDS = WordHasher(SPACE_WORDS)


def token_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every whole word, A-Z folded, and the text of each. Vectorised; whole texts."""
    return _words(texts)[:2]


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: hash, text, start and end; and the buffer they stand in."""
    buf, at = joined(texts)
    start, end, key = _WORDS(buf)
    return key, np.searchsorted(at, start, side="right") - 1, start, end, buf


def corpus_vocabulary(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent ``words`` tokens of all documents, ascending, with their counts, and the count of all others.

    Tasks count their share first; the counts are summed by token, and only the final tokens come to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            texts = bytes_of(batch.column(0))
            for a, b in groups_of_texts(texts):
                k, n = np.unique(token_keys(texts[a:b])[0], return_counts=True)
                keys.append(k)
                counts.append(n)
            if len(keys) >= 16:
                yield flush(keys, counts)
        if keys:
            yield flush(keys, counts)

    def flush(keys: list, counts: list) -> pa.RecordBatch:
        k, back = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)
        keys.clear()
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["token", "n"])

    counted = cut(docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = counted.orderBy(F.desc("n"), "token").limit(words).toArrow()
    drop(counted)
    token, n = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order], int(total - n.sum())


def _salted(level: int, context: np.ndarray) -> np.ndarray:
    return mix(context.astype(np.uint64, copy=False) * _ODD + np.uint64(level))


class Speller:
    """p(word | not in the vocabulary, words beside it), byte by byte to the end of the word.

    A byte is two draws of four bits. Each is counted after the byte before, after the three before and after the whole
    beginning of the word, every context backing off to the shorter one; the first byte instead after a bucket of the
    word on the left and on the right (the mean of both). Contexts share rows of a hashed table, so every row is a
    distribution, and every word has a probability, seen or not. Longest contexts have the upper half of the rows.
    """

    def __init__(self, rows: int, cfg: LMConfig) -> None:
        self.rows, self.cfg = rows, cfg
        self.counts = np.zeros(rows * 16, dtype=np.float64)
        self.totals = np.zeros(rows, dtype=np.float64)

    def load(self, flat: np.ndarray) -> None:
        self.counts = flat.astype(np.float32)
        self.totals = flat.reshape(-1, 16).sum(axis=1).astype(np.float32)

    def cells(self, context: np.ndarray, symbol: np.ndarray, upper: bool = False) -> list[np.ndarray]:
        """Cells of the upper and of the lower four bits of the symbol after the context."""
        half, high = self.rows // 2, symbol >> np.uint8(4)
        out = []
        for h, nibble in ((context, high), (mix(context + high.astype(np.uint64) + np.uint64(1)), symbol & np.uint8(15))):
            cell = (h & np.uint64(half - 1)).view(np.int64)
            cell += half * upper
            cell <<= 4
            cell += nibble
            out.append(cell)
        return out

    def letters(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
        """Symbols of the given words with an end each; the word of each; the first ones; each symbol with the one before;
        cells of the longer contexts, shortest first."""
        size = end - start + 1
        word = np.repeat(np.arange(len(start)), size)
        first = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        place = np.arange(len(word)) - first[word]
        ends = place == size[word] - 1
        symbol = np.where(ends, np.uint8(32), _FOLD[buf[np.minimum(start[word] + place, len(buf) - 1)]])
        _WORDS._grow(len(symbol) + 1)
        total = np.zeros(len(symbol) + 1, dtype=np.uint64)
        np.cumsum(_WORDS.value[symbol] * _WORDS.power[: len(symbol)], dtype=np.uint64, out=total[1:])
        begun = (total[:-1] - total[first][word]) * _WORDS.back[first][word]
        before, last = [], symbol
        for _ in range(3):  # the symbol before, the one before that, and one more; 0 beyond the word's beginning
            last = np.concatenate((last[:1], last[:-1]))
            last[first] = 0
            before.append(last.astype(np.uint64))
        near = before[0] | (before[1] << np.uint64(8)) | (before[2] << np.uint64(16))
        levels = [self.cells(_salted(2, near), symbol), self.cells(_salted(3, begun), symbol, True)]
        pair = (before[0] << np.uint64(8) | symbol).view(np.int64)
        return symbol, word, first, pair, levels

    def after_one(self, pair: np.ndarray) -> list[np.ndarray]:
        """Cells of the shortest context, the symbol before; a text has few such pairs, so each is looked up once."""
        return self.cells(_salted(1, pair >> 8), (pair & 255).astype(np.uint8))

    def beside(self, left: np.ndarray, right: np.ndarray, symbol: np.ndarray) -> list:
        """Cells of the first symbol of words after the word on the left, and before the one on the right."""
        n = np.uint64(self.cfg.buckets)
        return [self.cells(_salted(4, left % n), symbol), self.cells(_salted(5, right % n), symbol)]

    def count(self, spelled: tuple) -> None:
        buf, start, end, back, left, right = spelled
        symbol, word, first, pair, levels = self.letters(buf, start, end)
        times = np.bincount(back, minlength=len(start)).astype(np.float64)[word]
        of_pairs = np.bincount(pair, weights=times)
        met = np.flatnonzero(of_pairs)
        for cell in self.after_one(met):
            np.add.at(self.counts, cell, of_pairs[met])
        for level in levels:
            for cell in level:
                np.add.at(self.counts, cell, times)
        for level in self.beside(left, right, symbol[first][back]):
            for cell in level:
                np.add.at(self.counts, cell, 1.0)

    def after(self, cell: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        return (self.counts[cell] + self.cfg.backoff * shorter) / (self.totals[cell >> 4] + self.cfg.backoff)

    def log_probabilities(self, spelled: tuple) -> np.ndarray:
        buf, start, end, back, left, right = spelled
        symbol, word, first, pair, levels = self.letters(buf, start, end)
        met, p = np.flatnonzero(np.bincount(pair)), []
        for cell in self.after_one(met):
            of_pairs = np.zeros(1 << 16)
            of_pairs[met] = self.after(cell, np.full(len(met), 1 / 16))
            p.append(of_pairs.take(pair))
        for level in levels:
            p = [self.after(cell, q) for cell, q in zip(level, p, strict=True)]
        own = np.log(p[0] * p[1])
        own[first] = 0  # the first byte depends on the words beside it
        rest = np.bincount(word, weights=own, minlength=len(start))[back]
        sides = self.beside(left, right, symbol[first][back])
        for i in range(2):
            shorter = p[i][first][back]
            rest += np.log(sum(self.after(side[i], shorter) for side in sides) / 2)
        return rest


def code_lengths_and_paths(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman's tree over the leaves: of every leaf, where its path starts in the flat lists, of inner nodes and of
    turns (+1, -1). With one leaf there is no node; frequent leaves have short paths."""
    n = len(counts)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    up, turn = np.zeros(2 * n - 1, dtype=np.int64), np.zeros(2 * n - 1, dtype=np.float32)
    for new in range(n, 2 * n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x] = up[y] = new
        turn[x], turn[y] = 1, -1
        heapq.heappush(heap, (a + b, new))
    start, node, sign = np.zeros(n + 1, dtype=np.int64), [], []
    for leaf in range(n):
        at = leaf
        while at != 2 * n - 2:
            sign.append(turn[at])
            at = up[at]
            node.append(at - n)
        start[leaf + 1] = len(node)
    return start, np.array(node, dtype=np.int64), np.array(sign, dtype=np.float32)


class WordIds:
    """Ids of hashed words: 1.. in ascending order of hash, 0 for all others; a few table look-ups a word."""

    def __init__(self, vocabulary: np.ndarray) -> None:
        self.bits = max(4, (4 * len(vocabulary)).bit_length())
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        left = np.arange(len(vocabulary))
        while len(left):  # words whose slot is taken go to the next table
            slot = self.slot(vocabulary[left], len(self.tables))
            _, first = np.unique(slot, return_index=True)
            held, ids = np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits, dtype=np.int32)
            held[slot[first]], ids[slot[first]] = vocabulary[left[first]], left[first] + 1
            self.tables.append((held, ids))
            left = np.delete(left, first)

    def slot(self, key: np.ndarray, level: int) -> np.ndarray:
        return (key >> np.uint64(7 * level)) & np.uint64((1 << self.bits) - 1) if level < 6 else mix(key + np.uint64(level)) >> np.uint64(64 - self.bits)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), dtype=np.int32)
        for level, (held, ids) in enumerate(self.tables):
            at = self.slot(key, level)
            out += np.where((held[at] == key) & (ids[at] > 0), ids[at], 0)
        return out


def falls(s: np.ndarray, high: np.ndarray | float) -> np.ndarray:
    """high / (1 + e^s); s is overwritten."""
    np.minimum(s, 60, out=s)
    np.exp(s, out=s)
    s += 1
    return np.divide(high, s, out=s)


def costs(s: np.ndarray) -> np.ndarray:
    """log(1 + e^-s); s is overwritten."""
    np.negative(s, out=s)
    np.minimum(s, 60, out=s)
    np.exp(s, out=s)
    s += 1
    return np.log(s, out=s)


class WindowNet:
    """Embeddings of the words on both sides, weighed by a gate for each place, summed; tanh; hierarchical softmax.

    The word itself is masked: it has no place among the inputs. Ids: 0 other, 1.. the vocabulary; one more, as input
    only, stands for the places beyond the text. The output is a Huffman tree over other and the vocabulary: a word's
    probability is the product of the turns on its path, so all probabilities sum to one at a cost of a path.

    All parameters are rows of one table: inputs, inner nodes, gates, and the hidden bias. The last hidden unit is always
    1, so the last column of the inner nodes is their bias.
    """

    def __init__(self, vocabulary: np.ndarray, counts: np.ndarray, others: int, cfg: LMConfig) -> None:
        self.cfg, self.vocabulary, self.speller = cfg, vocabulary, None
        v, h = len(vocabulary), cfg.hidden
        self.ids, self.beside = WordIds(vocabulary), np.delete(np.arange(-cfg.side, cfg.side + 1), cfg.side)
        self.start, self.node, self.turn = code_lengths_and_paths(np.concatenate(([others], counts)))
        self.far = max(0, v - cfg.near_root)  # later nodes are nearer to the root, so paths begin with the ones before
        far = np.concatenate(([0], np.cumsum(self.node < self.far)))
        self.steps = far[self.start[1:]] - far[self.start[:-1]]
        leaf, near = np.repeat(np.arange(v + 1), np.diff(self.start)), self.node >= self.far
        self.near = np.zeros((v + 1, v - self.far), dtype=np.int8)
        self.near[leaf[near], self.node[near] - self.far] = self.turn[near]
        self.at = np.cumsum([0, v + 2, v, 2 * cfg.side, 1])
        rng = np.random.default_rng(cfg.seed)
        self.rows = rng.normal(0, 0.3, (self.at[-1], h)).astype(np.float32)
        self.rows[self.at[1] : self.at[2]] = 0
        self.rows[self.at[2] : self.at[3]] = 1 + rng.normal(0, 0.3, (2 * cfg.side, h))
        self.rows[self.at[3] :] = 0

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Views of the inputs, the inner nodes, the gates and the hidden bias."""
        at = self.at
        return self.rows[: at[1]], self.rows[at[1] : at[2]], self.rows[at[2] : at[3]], self.rows[at[3]]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token ids, their contexts, the text of each)."""
        key, doc = token_keys(texts)
        ids = self.ids(key)
        line, place = self.line(ids, doc)
        return ids, line[place[:, None] + self.beside], doc

    def line(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts on one line, with places beyond the text before, between and after them; the place of each word."""
        side = self.cfg.side
        place = np.arange(side, side + len(ids))
        place[1:] += side * np.cumsum(doc[1:] != doc[:-1])
        line = np.full(place[-1] + side + 1 if len(ids) else 0, len(self.vocabulary) + 1, dtype=np.int64)
        line[place] = ids
        return line, place

    def apart(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A line of contexts that don't overlap, whatever they hold; the place of the word of each."""
        side = self.cfg.side
        line = np.insert(context.astype(np.int64), side, len(self.vocabulary) + 1, axis=1)
        return line.reshape(-1), np.arange(side, line.size, 2 * side + 1)

    def stretches(self, line: np.ndarray, place: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parts of the line that hold the words begin:end of every pair and what is beside them, one after the other;
        the places of these words there, and the words."""
        side = self.cfg.side
        size, words = place[end - 1] - place[begin] + 1 + 2 * side, end - begin
        shift = np.cumsum(size) - size - place[begin] + side
        at = np.arange(size.sum()) - np.repeat(shift, size)
        word = np.arange(words.sum()) + np.repeat(begin - np.cumsum(words) + words, words)
        return line.take(at), place.take(word) + np.repeat(shift, words), word

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple | None]:
        """Token ids; the text of each; which words are outside the vocabulary; and those words, each once, as the speller
        reads them: buffer, starts, ends, the word of each place, the hashes of the words on its left and right."""
        key, doc, start, end, buf = _words(texts)
        ids = self.ids(key)
        rare = np.flatnonzero(ids == 0)
        if not len(rare):
            return ids, doc, rare, None
        _, at, back = np.unique(key[rare], return_index=True, return_inverse=True)
        side = []
        for to in (rare - 1, rare + 1):
            inside = np.clip(to, 0, len(key) - 1)
            side.append(np.where((to == inside) & (doc[inside] == doc[rare]), key[inside], np.uint64(0)))
        return ids, doc, rare, (buf, start[rare[at]], end[rare[at]], back, *side)

    def hidden(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hidden units of every place on the line that has all places beside it, and the inputs of all places; both
        (unit, place)."""
        words, _, gates, bias = self.parts()
        inputs = np.ascontiguousarray(words.take(line, axis=0).T)
        n, first = len(line) - 2 * self.cfg.side, self.beside + self.cfg.side
        z = np.repeat(bias[:, None], n, axis=1)
        weighed = np.empty_like(z)
        for gate, a in zip(gates, first, strict=True):
            np.multiply(inputs[:, a : a + n], gate[:, None], out=weighed)
            z += weighed
        z *= 2  # tanh by the exponential, which numpy has in vector code everywhere
        falls(z, -2)
        z += 1
        z[-1] = 1
        return z, inputs

    def descents(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The tokens by falling number of far nodes on their paths; nodes and turns of all steps there, the first ones of
        all tokens before the second ones; and where each step's begin. They belong to the first tokens of that order."""
        size = self.steps.take(ids)
        by = np.argsort((255 - np.minimum(size, 255)).astype(np.uint8), kind="stable")
        left = len(ids) - np.cumsum(np.bincount(size))  # tokens with more far nodes than 0, 1, ...
        if len(left) > 256:  # more steps than the short keys tell apart
            by = np.argsort(-size, kind="stable")
        begin, at = self.start.take(ids.take(by)), np.concatenate(([0], np.cumsum(left[:-1])))
        place = np.empty(at[-1], dtype=np.int64)
        for d, n in enumerate(left[:-1]):
            np.add(begin[:n], d, out=place[at[d] : at[d + 1]])
        return by, self.node.take(place), self.turn.take(place), at

    def agreements(self, h: np.ndarray, node: np.ndarray, turn: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the hidden units favour the turn of each step, and the nodes' parameters."""
        held, s = self.parts()[1].take(node, axis=0), np.empty(len(node), dtype=np.float32)
        for a, b in zip(at[:-1], at[1:], strict=True):
            np.einsum("ij,ij->i", h[: b - a], held[a:b], out=s[a:b])
        s *= turn
        return s, held

    def log_probabilities(self, ids: np.ndarray, context: np.ndarray) -> np.ndarray:
        return self.log_probabilities_on(*self.apart(context), ids)

    def log_probabilities_on(self, line: np.ndarray, place: np.ndarray, ids: np.ndarray, step: int = 4096) -> np.ndarray:
        """Of every word ids at its place, given those beside it on the line."""
        side = self.cfg.side
        out, near_root = np.zeros(len(ids)), self.parts()[1][self.far :]
        for i in range(0, len(ids), step):
            own, to = ids[i : i + step], place[i : i + step]
            by, node, turn, at = self.descents(own)
            h = self.hidden(line[to[0] - side : to[-1] + side + 1])[0].T.take(to.take(by) - to[0], axis=0)
            near = self.near.take(own.take(by), axis=0).astype(np.float32)
            total = -np.einsum("ij,ij->i", costs(h @ near_root.T * near), np.abs(near)).astype(np.float64)
            far = costs(self.agreements(h, node, turn, at)[0])
            for a, b in zip(at[:-1], at[1:], strict=True):
                total[: b - a] -= far[a:b]
            out[i + by] = total
        return out

    def train(self, ids: np.ndarray, context: np.ndarray, seed: int, squares: np.ndarray, seen: np.ndarray) -> None:
        self.train_on(*self.apart(context), ids, 1, seed, squares, seen)

    def train_on(self, line: np.ndarray, place: np.ndarray, ids: np.ndarray, run: int, seed: int, squares: np.ndarray, seen: np.ndarray) -> None:
        """One pass of Adagrad over the words ids at their places on the line, in random order of runs of so many words,
        touching only the rows that a batch uses. squares: what Adagrad has summed; seen: how many tokens have used a row.

        Gradients of rows are summed a hidden unit at a time, as long columns; those of inputs first by place on the line."""
        cfg, side, order = self.cfg, self.cfg.side, np.random.default_rng(seed).permutation(-(-len(ids) // run)) * run
        _, nodes, gates, _ = self.parts()
        begin, near_root = self.at, nodes[self.far :]

        def descend(rows: np.ndarray, gradient: np.ndarray, uses: np.ndarray | float) -> None:
            total = squares.take(rows, axis=0) + gradient * gradient
            squares[rows] = total
            self.rows[rows] -= cfg.rate * gradient / np.sqrt(total)
            seen[rows] += uses

        def descend_summed(first: int, key: np.ndarray, columns: np.ndarray, times: np.ndarray | None = None) -> None:
            """columns: of each hidden unit, gradients of the rows first + key, which repeat; times: the uses of each."""
            uses = np.bincount(key, weights=times)
            used = np.flatnonzero(uses)
            summed = np.empty((cfg.hidden, len(used)), dtype=np.float32)
            for total, column in zip(summed, columns, strict=True):
                total[:] = np.bincount(key, weights=column).take(used)
            descend(first + used, np.ascontiguousarray(summed.T), uses.take(used))

        each = max(1, cfg.batch // run)
        for i in range(0, len(order) if len(nodes) else 0, each):
            first = order[i : i + each]
            words, to, pick = self.stretches(line, place, first, np.minimum(first + run, len(ids)))
            own = ids.take(pick)
            by, node, turn, at = self.descents(own)
            own, to = own.take(by), to.take(by)
            units, inputs = self.hidden(words)
            h = units.T.take(to - side, axis=0)
            near = self.near.take(own, axis=0).astype(np.float32)
            g = falls(h @ near_root.T * near, near * np.float32(-1 / 32))
            back, near_gradient = g @ near_root, g.T @ h
            s, held = self.agreements(h, node, turn, at)
            turn *= np.float32(-1 / 32)
            g = falls(s, turn)
            held *= g[:, None]
            columns, moved = np.ascontiguousarray(h.T), np.empty((cfg.hidden, len(node)), dtype=np.float32)
            for a, b in zip(at[:-1], at[1:], strict=True):
                back[: b - a] += held[a:b]
                np.multiply(columns[:, : b - a], g[a:b], out=moved[:, a:b])
            back *= 1 - h * h  # nothing for the constant unit
            placed, is_word = np.zeros((len(words), cfg.hidden), dtype=np.float32), np.zeros(len(words), dtype=np.int64)
            placed[to], is_word[to] = back, 1
            dz, n = np.ascontiguousarray(placed[side : len(words) - side].T), len(words) - 2 * side
            spread, times, gated = np.zeros_like(inputs), np.zeros(len(words), dtype=np.int64), np.empty_like(gates)
            for j, a in enumerate(self.beside + side):
                np.einsum("ij,ij->i", dz, inputs[:, a : a + n], out=gated[j])
                spread[:, a : a + n] += dz * gates[j][:, None]
                times[a : a + n] += is_word[side : side + n]
            descend_summed(begin[1], node, moved)
            uses = np.einsum("ij,ij->j", near, near)
            met = np.flatnonzero(uses)
            descend(begin[1] + self.far + met, near_gradient[met], uses[met])
            descend_summed(begin[0], words, spread, times)
            descend(np.arange(begin[2], begin[3]), gated / 64, len(own))
            descend(np.arange(begin[3], begin[3] + 1), back.sum(axis=0)[None, :] / 64, len(own))


def train_lm(docs: DataFrame, cfg: LMConfig = LMConfig()) -> WindowNet:
    """Vocabulary, network and speller from all documents; the network by rounds of local passes and averaging.

    Every task passes over its part of the input, in batches. A share of the documents makes a first common network,
    then all tasks start from it and pass over all documents. What tasks return is averaged row by row in a tree, each
    row by how many tokens used it, so the driver reads at most cfg.fan_in models however large the corpus. The
    speller's counts are summed likewise, down to one table. Texts aren't shuffled.

    Null texts count as empty; without any word every probability is 1.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    documents = texts.count()
    words = int(min(cfg.most_words, max(cfg.least_words, cfg.growth * documents**0.5)))
    net = WindowNet(*corpus_vocabulary(texts, words), cfg)
    if not documents:
        return net
    splits = texts.rdd.getNumPartitions()
    parts = lambda share, each: max(1, min(splits, int(documents * share / each)))
    if parts(1, cfg.docs_per_task) > 1:
        train_round(texts.where(F.rand(cfg.seed) < cfg.warm_up), net, 0, parts(cfg.warm_up, cfg.docs_per_task))
    train_round(texts, net, 1, parts(1, cfg.docs_per_task))
    net.speller = train_speller(texts, net, documents, parts(1, cfg.docs_per_speller))
    release(spark)
    return net


def train_round(texts: DataFrame, net: WindowNet, r: int, tasks: int) -> None:
    """Every task passes over its rows from the common network; net takes the average."""
    spark, cfg, schema = texts.sparkSession, net.cfg, "flat binary"
    shared = spark.sparkContext.broadcast(net)
    shape = net.rows.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = shared.value, shared.value.rows.copy()
        squares, seen = np.full(shape, 1e-3, dtype=np.float32), np.zeros(shape[0], dtype=np.float32)
        for i, batch in enumerate(batches):
            texts = bytes_of(batch.column(0))
            for a, b in groups_of_texts(texts, 1 << 20):
                key, doc = token_keys(texts[a:b])
                ids = own.ids(key)
                own.train_on(*own.line(ids, doc), ids, cfg.run, cfg.seed + 31 * r + i, squares, seen)
        made = np.concatenate([own.rows, seen[:, None]], axis=1)
        own.rows[...] = start  # the worker's copy is shared with later tasks
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array([made.tobytes()])], names=["flat"])

    def average(parts: Iterable[np.ndarray]) -> np.ndarray | None:
        total = None
        for x in parts:
            x = x.reshape(shape[0], shape[1] + 1).astype(np.float64)
            x[:, :-1] *= x[:, -1:]
            total = x if total is None else total + x
        if total is not None:
            total[:, :-1] /= np.maximum(total[:, -1:], 1)
        return total

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = average(np.frombuffer(x.as_buffer(), dtype=np.float32) for batch in batches for x in batch.column(0))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()])], names=["flat"])

    found, parts, made = texts.coalesce(tasks).mapInArrow(run, schema), tasks, None
    while parts > cfg.fan_in:
        parts = -(-parts // cfg.fan_in)
        last, made = made, cut(found)
        drop(last)
        found = made.coalesce(parts).mapInArrow(merge, schema)
    total = average(np.frombuffer(x["flat"], dtype=np.float32) for x in found.toArrow().to_pylist())
    drop(made)
    shared.destroy()
    if total is not None:
        used = total[:, -1] > 0
        net.rows[used] = total[used, :-1]


def train_speller(texts: DataFrame, net: WindowNet, documents: int, parts: int) -> Speller:
    """Counts of the bytes of all words outside the vocabulary. A task returns a table as large as the final one."""
    spark, cfg, wide, schema = texts.sparkSession, net.cfg, 4, "flat binary"
    rows = min(cfg.max_rows, 1 << max(10, (cfg.rows_per_doc * documents - 1).bit_length()))
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, speller = shared.value, Speller(rows, cfg)
        for batch in batches:
            texts = bytes_of(batch.column(0))
            for a, b in groups_of_texts(texts):
                spelled = net.read(texts[a:b])[-1]
                if spelled:
                    speller.count(spelled)
        yield pa.RecordBatch.from_arrays([pa.array([speller.counts.astype(np.float32).tobytes()])], names=["flat"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rows * 16)
        for batch in batches:
            for flat in batch.column(0):
                total += np.frombuffer(flat.as_buffer(), dtype=np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()])], names=["flat"])

    found = texts.coalesce(parts).mapInArrow(run, schema)
    made = None
    while parts > 1:
        parts = -(-parts // wide)
        last, made = made, cut(found)
        drop(last)
        found = made.coalesce(parts).mapInArrow(merge, schema)
    speller = Speller(rows, cfg)
    speller.load(sum(np.frombuffer(x["flat"], dtype=np.float32).astype(np.float64) for x in found.toArrow().to_pylist()))
    drop(made)
    shared.destroy()
    return speller


def score_lm(docs: DataFrame, net: WindowNet) -> DataFrame:
    """(doc_id, n_tokens, pll, mean_pll): the sum and the mean of log p(word | words on both sides) over all words.

    A word outside the vocabulary has the probability of "other" times that of its spelling. (Spellings of words in the
    vocabulary keep their share of it, so the sum over all words is a little below 1.)

    Null, empty and wordless texts: 0 tokens, pll 0, mean_pll null. Repeated rows repeat; other columns aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = bytes_of(batch.column(1))
            count, total = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
            for a, b in groups_of_texts(texts, 1 << 20):
                ids, doc, rare, spelled = net.read(texts[a:b])
                p = net.log_probabilities_on(*net.line(ids, doc), ids)
                if spelled and net.speller:
                    p[rare] += net.speller.log_probabilities(spelled)
                count[a:b] = np.bincount(doc, minlength=b - a)
                total[a:b] = np.bincount(doc, weights=p, minlength=b - a)
            mean = pa.array(total / np.maximum(count, 1), mask=count == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array(total), mean], names=["doc_id", "n_tokens", "pll", "mean_pll"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, pll double, mean_pll double")

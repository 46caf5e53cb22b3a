"""A gated recurrent language model in numpy that scores whole documents.

Counts of all training tokens give the base model and the vocabulary: the `words` most frequent ones are predicted
one by one, all others by tail classes of similar spelling (k-means over letter pairs), inside which they keep
their counts' shares. The output is factored: a softmax over classes, then one over the words of the class.
One pass turns texts into model ids (two bytes a token), which training and scoring read.

Training starts at the counts' own probabilities and runs truncated backpropagation over all training documents, each
in one of the rounds. A round deals its documents to trainers by their hash, so many that each gets about
`trainer_tokens` tokens, in the order of that hash: how the table is split into files and tasks changes nothing.
Trainers start from the same model, their copies are averaged by tokens in a tree of fixed fan-in, and the next round
starts there. Documents of more than `piece` tokens are trained on in pieces of that length.
Scoring packs documents into lanes and goes through them window by window with the state carried over, and reset
where a document begins, so a document's log-likelihood is complete whatever its length.

What is broadcast has a fixed size: the model, and the counts of the `known` most frequent words. Rarer words
join the full table of counts instead.

Null and empty texts hold one token, their end. A null doc_id counts as an empty one: a training document.
Very long texts are one lane of their task. Repeated rows are counted, trained on and scored each. Without training
documents, and in an empty table, the base is 0 for every token and the model is untrained. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import Table

END = b"\n"  # no word holds white space
PAIRS = 1 << 11
LN10 = np.log(10.0)


@dataclass
class Settings:
    words: int = 4096
    known: int = 1 << 18
    tails: int = 16
    hidden: int = 16
    class_words: int = 64
    rounds: int = 2
    trainer_tokens: int = 2_000_000
    piece: int = 512
    lanes: int = 512  # in the first round at first a quarter of that, doubled every `ramp` tokens
    ramp: int = 150_000
    window: int = 20
    rate: float = 0.1
    score_lanes: int = 1024
    score_window: int = 32
    text_bytes: int = 1 << 24  # of texts split into words at once
    flush: int = 400_000
    train_flush: int = 2_000_000
    score_flush: int = 6_000_000


def is_held_out():
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 5 == 1


def words_of(text: bytes) -> list[bytes]:
    """The tokens of one text, plainly; `_split` does a batch."""
    return [*text.lower().split(), END]


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of up to `most` bytes of text, or one row."""
    total, first = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while first < batch.num_rows:
        n = max(1, int(np.searchsorted(total, (total[first - 1] if first else 0) + most, "right")) - first)
        yield batch.slice(first, n)
        first += n


def _split(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The words of a batch of texts, one after the other, and how many each text has; ends are left out. Arrow's white space is the contract's."""
    text = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(batch.column(0), "")))
    lists = pc.ascii_split_whitespace(text)
    words, size = lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    empty = pc.equal(text, "").to_numpy(zero_copy_only=False)
    if empty.any():  # such a text comes out as one empty word
        size[empty] = 0
        words = words.filter(pc.not_equal(words, ""))
    return words.cast(pa.binary()), size


def _counter(most: int):
    def run(batches):
        for batch in batches:
            for piece in _pieces(batch, most):
                words, size = _split(piece)
                found = words.value_counts()
                word = pa.concat_arrays([found.field("values"), pa.array([END], pa.binary())])
                n = pa.concat_arrays([found.field("counts"), pa.array([len(size)], pa.int64())])
                yield pa.RecordBatch.from_arrays([word, n], ["word", "n"])

    return run


def _letter_pairs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed pairs of neighbouring bytes, blanks around, and where each word's begin."""
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return (b[:-1] * 257 + b[1:]) * 40503 % 65537 % PAIRS, np.cumsum(size) - size


class Spelling:
    """Tail classes: k-means over normalised counts of letter pairs, fitted on the most frequent words."""

    def __init__(self, words: list[bytes], weights: np.ndarray, k: int, seed: int = 1):
        self.centres = np.zeros((PAIRS, k), np.float32)
        if not words:
            return
        rng, (pair, start) = np.random.default_rng(seed), _letter_pairs(words)
        x = np.zeros((len(words), PAIRS), np.float32)
        np.add.at(x, (np.repeat(np.arange(len(words)), np.diff(np.r_[start, len(pair)])), pair), 1)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centres = x[rng.choice(len(words), k, replace=len(words) < k)]
        weights = np.sqrt(weights).astype(np.float32)
        for _ in range(15):
            best = (x @ centres.T).argmax(axis=1)
            for j in range(k):
                own = best == j
                if own.any():
                    c = (x[own] * weights[own, None]).sum(axis=0)
                    centres[j] = c / np.linalg.norm(c)
        self.centres = np.ascontiguousarray(centres.T)

    def of(self, words: list[bytes]) -> np.ndarray:
        out = []
        for a in range(0, len(words), 20_000):
            pair, start = _letter_pairs(words[a : a + 20_000])
            out.append(np.add.reduceat(self.centres[pair], start, axis=0).argmax(axis=1))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Vocabulary:
    """The fixed-size part: frequent words, their counts and classes."""

    index: pa.Array  # the known words, the end last
    counts: np.ndarray
    ids: np.ndarray  # of each known word: a predicted word, or `first_tail` + its tail
    spelling: Spelling
    total: int
    distinct: int
    class_start: np.ndarray  # predicted words are numbered class by class
    word_counts: np.ndarray
    tail_mass: np.ndarray
    static: np.ndarray = field(default=None)  # log10 share of a known word inside its tail

    @property
    def first_tail(self) -> int:
        return len(self.word_counts)

    @property
    def begin(self) -> int:
        return self.first_tail + len(self.tail_mass)

    def places(self, words: pa.Array) -> np.ndarray:
        """Places among the known words, -1: rare. Each call hashes all known words."""
        return pc.fill_null(pc.index_in(words, value_set=self.index), -1).to_numpy()

    def lookup(self, words: pa.Array | list[bytes], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Model ids of words, places of the rare ones, and these words; known are the words' `places`."""
        words = pa.array(words, pa.binary()) if isinstance(words, list) else words
        known = self.places(words) if known is None else known
        ids = self.ids.take(known, mode="wrap")
        rare = np.flatnonzero(known < 0)
        words = words.take(pa.array(rare))
        if len(words):
            distinct = words.dictionary_encode()
            ids[rare] = self.first_tail + self.spelling.of(distinct.dictionary.to_pylist())[distinct.indices.to_numpy()]
        return ids, rare, words


def build_vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    top = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(s.known).toArrow()
    words, c = top.column("word").to_pylist(), top.column("c").to_numpy()
    end = counts.where(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    spelling = Spelling(words[:20_000], c[:20_000], s.tails)
    tail = spelling.of(words)
    # Classes: the predicted words of one spelling, by frequency, up to `class_words` in each; the end has its own.
    own = tail[: s.words]
    order = np.lexsort((np.arange(len(own)), own))
    sizes = []
    for k in range(s.tails):
        n = int((own == k).sum())
        sizes += [min(s.class_words, n - a) for a in range(0, n, s.class_words)]
    starts = np.r_[0, np.cumsum([1, *sizes])].astype(np.int64)
    n_words = len(order) + 1
    ids = n_words + tail
    ids[order] = np.arange(1, n_words)
    word_counts = np.r_[end, c[order]].astype(np.float64)
    v = Vocabulary(pa.array([*words, END], pa.binary()), np.r_[c, end].astype(np.float64), np.r_[ids, 0].astype(np.int64), spelling, total or 0, distinct, starts, word_counts, np.zeros(s.tails))
    shared = counts.sparkSession.sparkContext.broadcast((set(words[: s.words]) | {END}, spelling))

    def masses(batches):
        predicted, spell = shared.value
        sums = np.zeros(s.tails)
        for batch in batches:
            w, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            rest = [i for i, x in enumerate(w) if x not in predicted]
            sums += np.bincount(spell.of([w[i] for i in rest]), n[rest] + 0.5, s.tails)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(s.tails)), pa.array(sums)], ["tail", "mass"])

    for r in counts.select("word", "c").mapInArrow(masses, "tail long, mass double").groupBy("tail").agg(F.sum("mass").alias("mass")).collect():
        v.tail_mass[r["tail"]] = r["mass"]
    v.tail_mass += 0.5  # for words not met in training
    v.static = np.where(v.ids < v.first_tail, 0.0, np.log10((v.counts + 0.5) / v.tail_mass[np.maximum(v.ids - v.first_tail, 0).clip(max=s.tails - 1)]))
    return v


#: Targets whose classes are computed at once: few enough for a cache.
CHUNK = 2048


class Model:
    """Gated recurrent units, and a class-factored softmax."""

    def __init__(self, v: Vocabulary, s: Settings, seed: int = 7):
        rng, h = np.random.default_rng(seed), s.hidden
        self.hidden, self.first_tail, self.class_start = h, v.first_tail, v.class_start
        self.n_word_classes = len(v.class_start) - 1
        self.class_of = np.r_[np.repeat(np.arange(self.n_word_classes), np.diff(v.class_start)), self.n_word_classes + np.arange(len(v.tail_mass))]
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        mass = np.r_[np.add.reduceat(v.word_counts + 0.5, v.class_start[:-1]), v.tail_mass]
        inner = (v.word_counts + 0.5) / mass[self.class_of[: v.first_tail]]
        self.p = {
            "input": f(v.begin + 1, 3 * h, scale=0.1),
            "state": f(h, 3 * h, scale=1 / np.sqrt(h)),
            "class": f(len(mass), h + 1, scale=0.05),  # the last column is the bias
            "word": f(v.first_tail, h + 1, scale=0.05),
        }
        self.p["input"][:, :h] += 1  # remember at first
        self.p["class"][:, h], self.p["word"][:, h] = np.log(mass / mass.sum()), np.log(inner)

    def copy(self) -> Model:
        out = copy(self)
        out.p = {k: a.copy() for k, a in self.p.items()}
        return out

    def steps(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, store: bool = False):
        """States after each step of a window, and the last; x and keep are steps by lanes. With store, also what went in
        and the gates: the state before, remember and reset gates, candidate, and its part that the reset gate scales."""
        n, p = self.hidden, self.p
        # Both gates and candidates have an array each, so that operations run over whole arrays; the gates' signs are turned, for exp(-x).
        weights = p["state"].reshape(n, 3, n).transpose(1, 0, 2) * np.array([-1, -1, 1], h.dtype)[:, None, None]
        pre = p["input"].reshape(-1, n).take(x.astype(np.intp) * 3 + np.arange(3)[:, None, None], axis=0)
        gates, cs = pre[:2], pre[2]
        out = np.empty_like(cs)
        parts = np.empty((3, len(x) if store else 1, *h.shape), h.dtype)
        before, begins = h[None], (keep == 0).any(axis=(1, 2)).tolist()
        for t in range(len(x)):
            if begins[t]:
                h = h * keep[t]
            u, g, c = parts[:, t if store else 0], gates[:, t], cs[t]
            np.matmul(h, weights, out=u)
            np.subtract(u[:2], g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            c += g[1] * u[2]
            np.tanh(c, out=c)
            h = np.subtract(h, c, out=out[t])
            h *= g[0]
            h += c
        if not store:
            return out, h, None
        before = np.concatenate([before, out[:-1]])
        before *= keep
        return out, h, (before, *gates, cs, parts[2])

    def outputs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None):
        """Natural log-probability of each target: of its class and, if it is predicted, its word. With grads the
        gradient for h instead, and those of the weights into grads. States lie within 1, so exponentials stay small.

        Targets are numbered class by class, so in their order each class is one slice.
        """
        p, n, first = self.p, self.hidden, self.class_start.tolist()
        order = np.argsort(y.astype(np.uint16), kind="stable")
        y, at = y.take(order), np.arange(len(y))
        one = np.ones((len(y), n + 1), h.dtype)
        one[:, :n] = h.take(order, axis=0)
        cls, ones = self.class_of.take(y), np.ones(max(len(p["class"]), len(p["word"])), h.dtype)

        def shares(own, w, k):
            """Exponentials by choice, their sums, and where in the flat exponentials the targets k are."""
            exp = own @ w.T
            np.exp(exp, out=exp)
            return exp, exp @ ones[: len(w)], at[: len(k)] * len(w) + k

        def errors(own, w, k):
            """Probabilities, less 1 for the targets."""
            exp, total, hit = shares(own, w, k)
            exp *= np.reciprocal(total, out=total)[:, None]
            exp.reshape(-1)[hit] -= 1
            return exp

        chunks = [slice(i, i + CHUNK) for i in range(0, len(y), CHUNK)]
        cut = np.searchsorted(cls, np.arange(self.n_word_classes + 1)).tolist()
        # The word of a class that has no other is certain.
        classes = [(slice(i, j), a, b) for i, j, a, b in zip(cut, cut[1:], first, first[1:], strict=False) if i < j and b - a > 1]
        if grads is None:
            prob = np.empty(len(y))
            for c in chunks:
                exp, total, hit = shares(one[c], p["class"], cls[c])
                np.divide(exp.take(hit), total, out=prob[c])
            for c, a, b in classes:
                exp, total, hit = shares(one[c], p["word"][a:b], y[c] - a)
                prob[c] *= exp.take(hit) / total
            out = np.empty_like(prob)
            out[order] = np.log(prob)
            return out
        back, grads["class"], grads["word"] = np.empty((len(y), n), h.dtype), np.zeros_like(p["class"]), np.zeros_like(p["word"])
        for c in chunks:
            error = errors(one[c], p["class"], cls[c])
            np.matmul(error, p["class"][:, :n], out=back[c])
            grads["class"] += error.T @ one[c]
        for c, a, b in classes:
            error = errors(one[c], p["word"][a:b], y[c] - a)
            back[c] += error @ p["word"][a:b, :n]
            np.matmul(error.T, one[c], out=grads["word"][a:b])
        place = np.empty_like(order)
        place[order] = at
        return back.take(place, axis=0)

    def gradients(self, x, y, keep, h):
        """Truncated backpropagation through one window: how many targets, gradients, states. y is -1 where a lane is idle."""
        n, p, grads = self.hidden, self.p, {}
        out, last, (before, z, r, c, uc) = self.steps(x, keep, h, True)
        live = np.flatnonzero(y >= 0)
        d_out = np.zeros_like(out)
        d_out.reshape(-1, n)[live] = self.outputs(out.reshape(-1, n).take(live, axis=0), y.ravel().take(live), grads)
        # What does not depend on later steps, for the whole window at once.
        to_c = (1 - z) * (1 - c * c)
        to_z = (before - c) * z * (1 - z)
        to_r = uc * r * (1 - r)
        d_c, d_u = np.empty_like(out), np.empty((3, *out.shape), out.dtype)  # of the candidates' sums; of what the state gives to gates and candidates
        back, dh = np.ascontiguousarray(p["state"].reshape(n, 3, n).transpose(1, 2, 0)), np.zeros_like(h)
        for t in range(len(x) - 1, -1, -1):
            dh += d_out[t]
            np.multiply(dh, to_z[t], out=d_u[0, t])
            dc = np.multiply(dh, to_c[t], out=d_c[t])
            np.multiply(dc, to_r[t], out=d_u[1, t])
            np.multiply(dc, r[t], out=d_u[2, t])
            dh *= z[t]
            for part in d_u[:, t] @ back:
                dh += part
            dh *= keep[t]
        grads["state"] = np.hstack([before.reshape(-1, n).T @ d.reshape(-1, n) for d in d_u])
        flat = x.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        ids, start = np.unique(flat.take(order), return_index=True)
        grads["input"] = (ids, np.hstack([_sums(d.reshape(-1, n).take(order, axis=0), start) for d in (d_u[0], d_u[1], d_c)]))
        return len(live), grads, last


def _sums(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the rows from each start to the next. Two columns count as one complex number: half as many short sums."""
    if rows.shape[1] % 2:
        return np.add.reduceat(rows, start, axis=0)
    return np.add.reduceat(rows.view(np.result_type(rows, np.complex64)), start, axis=0).view(rows.dtype)


class Lanes:
    """Documents packed into lanes, the longest lane first; it holds a few bytes a token, however uneven they are."""

    def __init__(self, docs: list[np.ndarray], lanes: int, begin: int):
        lanes = max(1, min(lanes, len(docs)))
        heap, own = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            n, k = heapq.heappop(heap)
            own[k].append(i)
            heapq.heappush(heap, (n + len(docs[i]), k))
        heap.sort(reverse=True)
        self.begin, self.size = begin, np.array([n for n, _ in heap])
        order = [i for _, k in heap for i in own[k]]
        sizes = np.array([len(docs[i]) for i in order])
        self.ids, self.doc = np.concatenate([docs[i] for i in order]), np.repeat(np.array(order, np.int32), sizes)
        self.first = np.zeros(len(self.ids), bool)
        self.first[np.cumsum(sizes) - sizes] = True
        self.start = np.cumsum(self.size) - self.size

    def __len__(self) -> int:
        return int(self.size[0])

    def live(self, t: int) -> int:
        return int((self.size > t).sum())

    def window(self, t: int, steps: int):
        """Inputs, targets (-1 where a lane has ended), keep and document numbers from step t on, steps by the live lanes."""
        live = self.live(t)
        step = np.arange(t, min(t + steps, len(self)))[:, None]
        ended = step >= self.size[:live]
        at = np.minimum(self.start[:live] + step, len(self.ids) - 1)
        y, new = self.ids.take(at).astype(np.int32), self.first.take(at)
        y[ended] = -1
        x = np.where(new | ended, self.begin, self.ids.take(at - 1))
        return x, y, (~new).astype(np.float32)[:, :, None], self.doc.take(at)


def train_on(model: Model, docs: list[np.ndarray], s: Settings, begin: int, squares: dict, lanes: int | None = None) -> int:
    """Adagrad over the windows of some documents; how many tokens it saw."""
    docs = [d[a : a + s.piece] for d in docs for a in range(0, len(d), s.piece)]
    packed = Lanes(docs, lanes or s.lanes, begin)
    h, seen = np.zeros((len(packed.size), s.hidden), model.p["state"].dtype), 0
    for t in range(0, len(packed), s.window):
        x, y, keep, _ = packed.window(t, s.window)
        n, grads, h = model.gradients(x, y, keep, h[: x.shape[1]])
        seen += n
        scale = 1 / np.sqrt(n)
        for name, g in grads.items():
            rows = ...
            if name == "input":
                rows, g = g
            g *= scale
            np.clip(g, -1, 1, out=g)
            total = squares[name][rows]
            total += g * g
            if rows is not ...:
                squares[name][rows] = total
            g *= s.rate
            g /= np.sqrt(total + 1e-2)
            model.p[name][rows] -= g
    return seen


PART = 1 << 16
COPIES = "part int, trainer long, seen long, values binary"
#: Model copies that meet in one row of the tree of averages.
FAN = 32


def _copies(parts: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in parts], kinds[i]) for i in range(4)], [x.split()[0] for x in COPIES.split(", ")])


def _trainer(shared):
    """Rows (trainer, ids), by trainer, to the trainers' models in parts."""

    def run(batches):
        first, s, begin, fresh = shared.value
        model, squares, held, tokens, seen, own = None, {}, [], 0, 0, None

        def learn():
            nonlocal model, squares, tokens, seen
            if model is None:
                model = first.copy()
                squares = {k: np.zeros_like(a) for k, a in model.p.items()}
            lanes = min(s.lanes, max(1, s.lanes // 4) << min(seen // s.ramp, 2)) if fresh else s.lanes
            seen += train_on(model, held, s, begin, squares, lanes)
            held.clear()
            tokens = 0

        def done():
            nonlocal model, seen
            if held:
                learn()
            flat = np.concatenate([model.p[k].ravel() for k in sorted(model.p)])
            out = _copies([(i // PART, own, seen, flat[i : i + PART].tobytes()) for i in range(0, len(flat), PART)])
            model, seen = None, 0
            return out

        for batch in batches:
            for trainer, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if trainer != own and own is not None:
                    yield done()
                own = trainer
                held.append(np.frombuffer(ids, np.uint16))
                tokens += len(held[-1])
                if tokens >= (s.ramp if fresh and seen < 2 * s.ramp else s.train_flush):
                    learn()
        if own is not None:
            yield done()

    return run


def _average(batches):
    """Sorted rows (part, group, seen, values): the mean of each part and group, weighted by tokens."""
    own, total, weight = None, None, 0

    def mean():
        return _copies([(*own, weight, (total / weight).astype(np.float32).tobytes())])

    for batch in batches:
        for r in batch.to_pylist():
            x = np.frombuffer(r["values"], np.float32).astype(np.float64) * r["seen"]
            if (r["part"], r["trainer"]) == own:
                total, weight = total + x, weight + r["seen"]
                continue
            if own is not None:
                yield mean()
            own, total, weight = (r["part"], r["trainer"]), x, r["seen"]
    if own is not None:
        yield mean()


def train(encoded: DataFrame, v: Vocabulary, s: Settings) -> Model:
    """encoded: doc_id and ids of the training documents."""
    model, sc = Model(v, s), encoded.sparkSession.sparkContext
    h = F.xxhash64("doc_id", "ids")
    n_trainers = max(1, round(v.total / s.rounds / s.trainer_tokens))
    for k in range(s.rounds):
        own = encoded.where(F.pmod(h, F.lit(s.rounds)) == k).select(F.pmod(F.shiftright(h, 8), F.lit(n_trainers)).alias("trainer"), "ids", h.alias("h"))
        own = own.repartition(n_trainers, "trainer").sortWithinPartitions("trainer", "h").drop("h")
        shared = sc.broadcast((model, s, v.begin, k == 0))
        copies, left = Table(own.mapInArrow(_trainer(shared), COPIES), "model-copies").read(), n_trainers
        shared.unpersist()
        while True:
            left = -(-left // FAN)
            group = F.floor(F.col("trainer") / FAN).cast("long")
            rows = copies.select("part", group.alias("group"), "seen", "values", "trainer").repartition("part", "group").sortWithinPartitions("part", "group", "trainer")
            copies = rows.select("part", F.col("group").alias("trainer"), "seen", "values").mapInArrow(_average, COPIES)
            if left <= 1:
                break
            copies = Table(copies, "model-copies").read()
        rows = sorted(copies.collect(), key=lambda r: r["part"])
        if not rows:  # no document fell into this round
            continue
        flat, at, model = np.concatenate([np.frombuffer(bytes(r["values"]), np.float32) for r in rows]), 0, model.copy()
        for name in sorted(model.p):
            a = model.p[name]
            model.p[name] = flat[at : at + a.size].reshape(a.shape).copy()
            at += a.size
    return model


def log_probs(model: Model, docs: list[np.ndarray], s: Settings, begin: int) -> np.ndarray:
    """Each document's log10-probability of its classes and predicted words."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    packed = Lanes(docs, s.score_lanes, begin)
    h, t = np.zeros((len(packed.size), model.hidden), np.float32), 0
    while t < len(packed):
        # Where few lanes are left a window has more steps, so that it holds as many tokens.
        x, y, keep, doc = packed.window(t, s.score_window * max(1, s.score_lanes // packed.live(t)))
        t += len(x)
        out, h, _ = model.steps(x, keep, h[: x.shape[1]])
        live = np.flatnonzero(y >= 0)
        total += np.bincount(doc.ravel().take(live), model.outputs(out.reshape(-1, model.hidden).take(live, axis=0), y.ravel().take(live)), len(docs))
    return total / LN10


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, static double, ids binary, rare array<binary>"
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _encoder(shared):
    """Texts to model ids, with what the counts alone give: base terms, shares inside tail classes, and the rare words."""

    def run(batches):
        v, most, flush = shared.value
        base, tail_share = np.log10(v.counts + 0.5), np.log10(v.tail_mass)
        at = TaskContext.get().partitionId() << 33

        def rows(part, words, known, size):
            n, cut = len(size), np.cumsum(size)
            ids, rare, rare_words = v.lookup(words, known)
            doc, hit = np.repeat(np.arange(n), size), np.flatnonzero(known >= 0)
            place, by, rare_by = known.take(hit), doc.take(hit), doc.take(rare)
            # An end, which is the last known word and predicted, follows each text.
            met = np.bincount(by, v.counts.take(place) > 0, n).astype(np.int64) + int(v.counts[-1] > 0)
            static = v.static[-1] + np.bincount(by, v.static.take(place), n) - np.bincount(rare_by, tail_share.take(ids.take(rare) - v.first_tail), n)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(rare_by, minlength=n))], pa.int32()), rare_words)
            flat = np.insert(ids.astype(np.uint16), cut, v.ids[-1])
            ends = (np.r_[0, cut + np.arange(1, n + 1)] * flat.itemsize).astype(np.int32)
            packed = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at, at + n)), part.column(1), part.column(2), pa.array(size + 1), pa.array(met), pa.array(np.bincount(by, base.take(place), n) + base[-1]), pa.array(static), packed, lists],
                _names(ENCODED),
            )

        for batch in batches:
            for piece in _pieces(batch, most):
                words, size = _split(piece)
                known, cut, first = v.places(words), np.r_[0, np.cumsum(size)], 0
                while first < len(size):
                    n = max(1, int(np.searchsorted(cut, cut[first] + flush, "right")) - 1 - first)
                    a, b = int(cut[first]), int(cut[first + n])
                    yield rows(piece.slice(first, n), words.slice(a, b - a), known[a:b], size[first : first + n])
                    at, first = at + n, first + n

    return run


def _scorer(shared):
    """Encoded rows with the model's score of their classes and words added to what the counts give."""

    def run(batches):
        model, s, begin = shared.value
        for whole in batches:
            size, first = whole.column(3).to_numpy(), 0
            while first < whole.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(size[first:]), s.score_flush, "right")))
                part = whole.slice(first, n)
                score = part.column(6).to_numpy() + log_probs(model, [np.frombuffer(x.as_buffer(), np.uint16) for x in part.column(7)], s, begin)
                yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(score)], _names(SCORED))
                first += n

    return run


def score_documents(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text)."""
    s = settings or Settings()
    share = docs.sparkSession.sparkContext.broadcast
    docs = docs.select("text", "doc_id", is_held_out().alias("held_out"))
    counts = docs.where(~F.col("held_out")).select("text").mapInArrow(_counter(s.text_bytes), "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    counts = Table(counts, "token-counts").read()
    v = build_vocabulary(counts, s)
    words = share((v, s.text_bytes, s.flush))
    encoded = Table(docs.mapInArrow(_encoder(words), ENCODED), "encoded").read()
    words.unpersist()
    model = train(encoded.where(~F.col("held_out")).select("doc_id", "ids"), v, s)
    scored = Table(encoded.drop("rare").mapInArrow(_scorer(share((model, s, v.begin))), SCORED), "scored").read()
    rare = encoded.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy(F.col("row").alias("__row")).agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("sum"), F.count("c").alias("met"))
    out = scored.join(rare, F.col("row") == F.col("__row"), "left")
    base = F.col("base") + F.coalesce("sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(v.total + 0.5 * (v.distinct + 1))))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("sum", F.lit(0.0))).alias("score"))


def op1_language_model(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Language-model scores: a causal self-attention model in numpy over subword ids, beside a smoothed word unigram.

The model reads the lower-cased words of a text, each encoded with a leading blank by a public tokenizer. Subword ids map to
SYMBOLS symbols: the frequent ids have one each, the others share one by frequency and are told apart by smoothed counts. The
next symbol's distribution is a class of 32 and then a member of it; the logits of both add a direct path from the current
symbol (smoothed bigram log probabilities of the training texts) and a learned map of the attention output. Attention has one
head, learned tables of queries, keys and values by symbol, and a learned bias by distance. Windows of WIDTH symbols start
every STRIDE, so they overlap; each scores its last STRIDE symbols, so that every one is scored once, with at least
WIDTH - STRIDE before it (as far as the text has them).

All documents that are not held out teach the model, whatever their number: word counts, counts of ids (and so the symbols) and
bigrams of symbols are sums over all of them, and the weights are fitted by Adam on all their windows. The windows are gone
through in the ROUNDS, each of which takes the windows of its own: in each round every task moves a copy of the weights through
the windows of its share of the documents, and the next round starts from the mean of the tasks', by windows seen. Tables with
fewer than LEAST windows are gone through several times. Every text is encoded once, to a table that the rounds and the scoring
read. The HEAVY most frequent words, about, are sent to every task, the rest are joined by word.

Null and empty texts are an end alone. Null doc_ids (held out, since the crc of the empty text is 0) and
repeated rows are rows like others; equal texts get equal scores; texts of any length are read whole; an empty table gives an
empty result, and without training texts every symbol is equally likely. Other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import cut, id_remainder
from .tokens import gathered, parts_of, runs

SYMBOLS, CLASSES, DIM = 1024, 32, 16
MEMBERS = SYMBOLS // CLASSES
#: Of the symbols, those that several ids share.
SHARED = 32
WIDTH, STRIDE = 32, 16
#: Of every 16 windows in a row: from which to which a round goes through, its batch, and its first and last rate.
ROUNDS = ((0, 2, 128, 0.03, 0.03), (2, 6, 256, 0.025, 0.02), (6, 16, 256, 0.015, 0.0005))
#: Windows that the rounds see at least.
LEAST = 250_000
#: Pieces in which the weights are averaged.
PIECES = 32
#: Logits are kept in powers of two, since those are found faster.
LOG2E, LN2 = math.log2(math.e), math.log(2)
#: The distance of each key of a window from each query (of the last STRIDE), and where the key is not ahead.
FAR = (WIDTH - STRIDE + np.arange(STRIDE))[None] - np.arange(WIDTH)[:, None]
SEEN = FAR >= 0
#: Targets whose logits are made at once.
ROWS = 1024
WEIGHTS = ("q", "k", "v", "u1", "u2", "r")
HEAVY, HEAVY_BYTES = 100_000, 64
END_SYMBOL, PAD = 0, SYMBOLS
IDS = 50257
#: Stands for the end of a text; words, in which special strings count as ordinary text, never have this id.
END_ID = IDS - 1
#: Words whose ids a task keeps.
CACHED = 100_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def flat_encoder(path: str):
    """A function from words to the ids (unsigned 16-bit integers) of each with a blank before it, one word after another, and how many
    each has.

    Words are encoded together: the tokenizer parts a text before each blank, so only the first id of a word begins with one. Words with
    white space of their own, which it could join with the blank, are encoded one by one."""
    import base64
    import re

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    blank, odd = np.zeros(max(ranks.values()) + 1, bool), re.compile(r"[^\S ]")
    blank[[k for b, k in ranks.items() if b.startswith(b" ")]] = True

    def run(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = b" ".join(words).decode("utf-8", "replace")
        if odd.search(text):
            texts = [w.decode("utf-8", "replace") for w in words]
            alone = [k for k, w in enumerate(texts) if odd.search(w)]
            held = set(alone)
            out = iter(split(*run([w for k, w in enumerate(words) if k not in held])))
            coded = [array("H", encode(" " + w)).tobytes() if k in held else next(out) for k, w in enumerate(texts)]
            return np.frombuffer(b"".join(coded), np.uint16), np.fromiter(map(len, coded), np.int64, len(coded)) // 2
        ids = np.frombuffer(array("H", encode(" " + text) if words else []), np.uint16)
        return ids, np.diff(np.flatnonzero(blank[ids]), append=len(ids))

    return run


def split(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    edges, flat = [0, *(2 * np.cumsum(sizes)).tolist()], ids.tobytes()
    return [flat[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def word_encoder(path: str):
    """A function from words to the ids of each, as flat_encoder() has them, in bytes."""
    encode = flat_encoder(path)
    return lambda words: split(*encode(words))


class Model:
    """symbol and extra by id: its symbol, and the log probability of the id among those that share it."""

    def __init__(self, counts: np.ndarray, ends: int):
        counts = counts[:END_ID]
        order = np.argsort(-counts, kind="stable")
        self.symbol = np.full(IDS, END_SYMBOL, np.uint16)
        own = SYMBOLS - SHARED - 1
        self.symbol[order[:own]] = np.arange(1, own + 1)
        rest = order[own:]
        self.symbol[rest] = own + 1 + np.arange(len(rest)) * SHARED // len(rest)
        smooth = counts + 0.5
        total = np.bincount(self.symbol[:END_ID], weights=smooth, minlength=SYMBOLS)
        total[END_SYMBOL] = ends + 0.5
        self.extra = np.append(np.log(smooth / total[self.symbol[:END_ID]]), 0.0)
        self.extra[order[:own]] = 0
        self.unigram = total / total.sum()

    def bigrams(self, pairs: np.ndarray, strength: float = 8.0) -> None:
        """The direct path: log probabilities of the class, and of the member in its class, by the symbol before."""
        p = (pairs + strength * self.unigram) / (pairs.sum(axis=1, keepdims=True) + strength)
        by_class = p.reshape(SYMBOLS, CLASSES, MEMBERS)
        sums = by_class.sum(axis=2)
        pad = lambda x: np.concatenate((x, np.zeros((1, *x.shape[1:])))).astype(np.float32)
        self.b1, self.b2 = pad(np.log(sums)), pad(np.log(by_class / sums[:, :, None]))

    def start(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        table = lambda *shape, s=0.3: (rng.standard_normal(shape) * s).astype(np.float32)
        self.q, self.k, self.v = (table(SYMBOLS + 1, DIM) for _ in range(3))
        self.u1, self.u2 = table(DIM, CLASSES, s=0.05), table(CLASSES, MEMBERS, DIM, s=0.05)
        self.r = (-0.1 * np.arange(WIDTH)).astype(np.float32)  # by distance

    def tables(self) -> tuple[np.ndarray, ...]:
        """What attend() reads: by symbol queries (scaled, so that logits are in powers of two), keys and values with a column of ones
        (padding has zeros); and by key and query (of the last STRIDE) the exponential of the bias of their distance, 0 where the key is ahead."""
        ones = np.ones((SYMBOLS + 1, DIM + 1), self.v.dtype)
        ones[:, :DIM] = self.v
        ones[PAD] = 0
        return self.q * np.float32(LOG2E / math.sqrt(DIM)), self.k, ones, (np.exp(self.r)[np.maximum(FAR, 0)] * SEEN).astype(np.float32)

    def attend(self, x: np.ndarray, tables: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """Queries, keys, values with a column of ones, exponentials by key and query, and their sums of values and ones.

        One product so gives sums and normalisers; padding takes no part in either.
        """
        q, k, v = tables[0].take(x[:, -STRIDE:], axis=0), tables[1].take(x, axis=0), tables[2].take(x, axis=0)
        a = np.matmul(k, np.ascontiguousarray(q.transpose(0, 2, 1)))
        np.exp2(a, out=a)
        a *= tables[3]
        return q, k, v, a, np.matmul(a.transpose(0, 2, 1), v)

    def maps(self) -> tuple[np.ndarray, np.ndarray]:
        return self.u1, np.ascontiguousarray(self.u2.transpose(0, 2, 1))

    def direct(self) -> tuple[np.ndarray, np.ndarray]:
        """The direct path to classes by the symbol before, and to members, a row for each class and symbol before; in powers of two."""
        return self.b1 * np.float32(LOG2E), np.ascontiguousarray(self.b2.transpose(1, 0, 2)).reshape(-1, MEMBERS) * np.float32(LOG2E)

    def heads(self, h: np.ndarray, x: np.ndarray, y: np.ndarray, direct: tuple[np.ndarray, np.ndarray], maps: tuple) -> tuple:
        """For the targets that are real, in order of their class so that its weights meet them in runs: all places in that order (those
        that are not real come last), 1 / normaliser, h, and one stretch of whole classes after another, of about ROWS targets (so that what
        is made of them stays in the cache): from where to where, runs (class, from, to, in the stretch), class, member, and the logits of
        all classes and of the members of their class, in powers of two. h has sums and normalisers; maps are maps()."""
        c = (y // MEMBERS).astype(np.uint8)  # 255 where there is no target
        order = np.argsort(c, kind="stable")
        edges = np.searchsorted(c[order], np.arange(CLASSES + 1)).tolist()
        n = edges[-1]
        real = order[:n]
        target, before, own = y.take(real), x[:, -STRIDE:].reshape(-1).take(real), h.take(real, axis=0)
        by_sum = 1 / own[:, DIM:]
        own = own[:, :DIM] * by_sum
        c, member, scaled = target // MEMBERS, target % MEMBERS, own * np.float32(LOG2E)

        def stretches() -> Iterator[tuple]:
            s, some = 0, []
            for j in range(CLASSES):
                e = edges[j + 1]
                if edges[j] < e:
                    some.append((j, edges[j] - s, e - s))
                if not some or (e - s < ROWS and e < n):
                    continue
                part, ahead, l2 = scaled[s:e], before[s:e], np.empty((e - s, MEMBERS), own.dtype)
                l1 = part @ maps[0]
                l1 += direct[0].take(ahead, axis=0)
                for i, a, b in some:
                    np.dot(part[a:b], maps[1][i], l2[a:b])
                l2 += direct[1].take(c[s:e] * (SYMBOLS + 1) + ahead, axis=0)
                yield s, e, some, c[s:e], member[s:e], l1, l2
                s, some = e, []

        return order, by_sum, own, stretches()

    def laid(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Views of the inputs (WIDTH) and targets (STRIDE; -1 beyond a document's end) from every place on; where windows start, and
        their document numbers. Only what is taken from the views is copied."""
        n = np.array([len(d) for d in docs])
        count = -(-n // STRIDE)
        lead = WIDTH - STRIDE
        size = lead + count * STRIDE
        offset = np.concatenate(([0], np.cumsum(size)))
        x = np.full(offset[-1], PAD, np.int32)
        y = np.full(offset[-1], -1, np.int32)
        for o, d in zip((offset[:-1] + lead).tolist(), docs, strict=True):
            x[o], x[o + 1 : o + len(d)], y[o : o + len(d)] = END_SYMBOL, d[:-1], d
        doc = np.repeat(np.arange(len(docs)), count)
        first = (offset[:-1] - (np.cumsum(count) - count) * STRIDE)[doc] + np.arange(len(doc)) * STRIDE
        view = np.lib.stride_tricks.sliding_window_view
        return view(x, WIDTH), view(y[lead:], STRIDE), first, doc

    def windows(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs (windows by WIDTH), targets and document numbers (windows by STRIDE)."""
        xs, ys, first, doc = self.laid(docs)
        return xs[first], ys[first], doc

    def score(self, docs: list[np.ndarray], chunk: int = 256) -> np.ndarray:
        """The natural log probability of each document's symbols; each symbol counts in one window."""
        out, direct, one = np.zeros(len(docs)), self.direct(), np.ones(MEMBERS, np.float32)
        tables, maps = self.tables(), self.maps()
        xs, ys, first, doc = self.laid(docs)
        for i in range(0, len(first), chunk):
            x, y = xs[first[i : i + chunk]].astype(np.intp), ys[first[i : i + chunk]].reshape(-1)
            h = self.attend(x, tables)[-1].reshape(-1, DIM + 1)
            order, _, _, stretches = self.heads(h, x, y, direct, maps)
            for s, e, _, c, member, l1, l2 in stretches:
                at = np.arange(0, (e - s) * MEMBERS, MEMBERS)
                got = l1.reshape(-1).take(at + c) + l2.reshape(-1).take(at + member)
                np.exp2(l1, out=l1)
                np.exp2(l2, out=l2)
                got -= np.log2((l1 @ one) * (l2 @ one))
                out += np.bincount(doc[i + order[s:e] // STRIDE], weights=got, minlength=len(docs))
        return out * LN2


def model_of(state: dict) -> Model:
    """A model from its attributes, which are what tasks are sent: a broadcast object would need the package there."""
    model = Model.__new__(Model)
    model.__dict__.update(state)
    return model


def summed(rows: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The sum of the 32-bit rows of each symbol, 0 for padding. Two columns are added at once, as parts of a complex number.

    Symbols are sorted with their places below them in one integer, which is faster than to sort places by them."""
    bits = max(1, (len(symbols) - 1).bit_length())
    kind = np.uint32 if bits <= 21 else np.uint64
    key = symbols.astype(kind)
    key <<= kind(bits)
    key |= np.arange(len(symbols), dtype=kind)
    key.sort()
    found = key >> kind(bits)
    key &= kind((1 << bits) - 1)
    first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    out = np.zeros((SYMBOLS + 1, rows.shape[1]), np.float32)
    out[found[first]] = np.add.reduceat(rows.take(key, axis=0).view(np.complex64), first, axis=0).view(np.float32)
    out[PAD] = 0
    return out


class Adam:
    """Moves the weights of a model by the gradient of the cross entropy of what a batch of windows scores."""

    def __init__(self, model: Model):
        self.model, self.steps = model, 0
        self.flat = np.concatenate([getattr(model, n).reshape(-1) for n in WEIGHTS])
        self.m1, self.m2 = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.direct, self.one = model.direct(), np.ones(MEMBERS, np.float32)

    def gradient(self, x: np.ndarray, y: np.ndarray, measured: bool = True) -> tuple[dict[str, np.ndarray], float]:
        """By weight, and the mean loss (0 if that isn't measured)."""
        model, n, x = self.model, len(x), x.astype(np.intp)
        q, k, v, p, h = model.attend(x, model.tables())
        maps = model.maps()
        order, by_sum, own, stretches = model.heads(h.reshape(-1, DIM + 1), x, y, self.direct, maps)
        share, loss, back_map = np.float32(1 / max(len(own), 1)), 0.0, np.ascontiguousarray(model.u1.T)
        grad = {"u1": np.zeros_like(model.u1), "u2": np.zeros_like(model.u2)}
        back = np.empty_like(own)
        for s, e, runs_of_class, c, member, l1, l2 in stretches:
            at, mine, to = np.arange(0, (e - s) * MEMBERS, MEMBERS), own[s:e], back[s:e]
            for d, target in ((l1, at + c), (l2, at + member)):  # from logits to the gradient by them
                flat = d.reshape(-1)
                if measured:
                    loss -= float(flat.take(target).sum(dtype=np.float64))
                np.exp2(d, out=d)
                total = d @ self.one
                if measured:
                    loss += float(np.log2(total).sum())
                d *= (share / total)[:, None]
                flat[target] -= share
            grad["u1"] += mine.T @ l1
            for j, a, b in runs_of_class:
                np.dot(l2[a:b].T, mine[a:b], grad["u2"][j])
                np.dot(l2[a:b], model.u2[j], to[a:b])
            to += l1 @ back_map
        # the mean that a softmax takes off is one more column, as the values have a column of ones; what p lacks to sum to one is here too
        rows, place = np.zeros((n * STRIDE, DIM + 1), np.float32), np.empty(n * STRIDE, np.intp)
        back *= by_sum
        rows[: len(own), :DIM] = back
        back *= own
        rows[: len(own), DIM] = back @ np.full(DIM, -1, np.float32)
        place[order] = np.arange(n * STRIDE)
        dh = rows.take(place, axis=0).reshape(n, STRIDE, DIM + 1)
        ds = np.matmul(v, np.ascontiguousarray(dh.transpose(0, 2, 1)))  # 0 for padding, as v is
        ds *= p
        by_distance = (np.ones(n, np.float32) @ ds.reshape(n, -1)).reshape(WIDTH, STRIDE)
        grad["r"] = np.bincount(FAR[SEEN], weights=by_distance[SEEN], minlength=WIDTH).astype(np.float32)
        both = np.empty((n, WIDTH, 2 * DIM), np.float32)
        np.matmul(ds, q, out=both[:, :, :DIM])
        np.matmul(p, dh[:, :, :DIM], out=both[:, :, DIM:])
        both = summed(both.reshape(-1, 2 * DIM), x.reshape(-1))
        grad["k"], grad["v"] = both[:, :DIM] * np.float32(LN2), both[:, DIM:]
        own = np.matmul(ds.transpose(0, 2, 1), k).astype(np.float32, copy=False)
        grad["q"] = summed(own.reshape(-1, DIM), x[:, -STRIDE:].reshape(-1)) * np.float32(1 / math.sqrt(DIM))
        return grad, loss * LN2 * float(share)

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        grad, _ = self.gradient(x, y, measured=False)
        self.steps += 1
        length, width = np.float32(rate / (1 - 0.9**self.steps)), np.float32(1 / (1 - 0.99**self.steps))
        g, m1, m2 = np.concatenate([grad[n].reshape(-1) for n in WEIGHTS]), self.m1, self.m2
        t = g - m1
        t *= np.float32(0.1)
        m1 += t
        g *= g
        g -= m2
        g *= np.float32(0.01)
        m2 += g
        np.multiply(m2, width, out=t)
        np.sqrt(t, out=t)
        t += np.float32(1e-8)
        np.divide(m1, t, out=t)
        t *= length
        self.flat -= t
        set_weights(self.model, self.flat)


class Tour:
    """One task's way through a round: its windows of a run of documents after another, in batches drawn at random without repeats."""

    def __init__(self, model: Model, turn: tuple, times: int, expected: float, seed: int):
        self.model = model_of(model.__dict__)
        self.adam, self.turn, self.times, self.expected = Adam(self.model), turn, times, max(expected, 1.0)
        self.rng, self.seen = np.random.default_rng(seed), 0

    def run(self, docs: list[np.ndarray]) -> None:
        low, high, batch, first, last = self.turn
        xs, ys, starts, _ = self.model.laid(docs)
        number = np.arange(len(starts)) % 16
        own = starts[(number >= low) & (number < high)]
        for _ in range(self.times):
            order = self.rng.permutation(own)
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                self.adam.step(xs[pick], ys[pick].reshape(-1), first + (last - first) * min(1.0, self.seen / self.expected))
                self.seen += len(pick)

    def weights(self) -> np.ndarray:
        return self.adam.flat


def set_weights(model: Model, flat: np.ndarray) -> None:
    at = 0
    for n in WEIGHTS:
        old = getattr(model, n)
        setattr(model, n, flat[at : at + old.size].astype(np.float32, copy=False).reshape(old.shape))
        at += old.size


def times_through(symbols: int) -> int:
    """How often the rounds go through the windows of so many symbols."""
    return max(1, -(-LEAST * STRIDE // max(symbols, 1))) if symbols else 1


def pairs_of(docs: list[np.ndarray]) -> np.ndarray:
    """How often each symbol follows each, by 1024 * before + after, in documents that end with the end symbol."""
    every = np.concatenate([np.zeros(0, np.int64), *docs]).astype(np.int64)
    before = np.concatenate(([END_SYMBOL], every))[:-1]  # each document ends, and so the next one starts, with the end symbol
    return np.bincount(before * SYMBOLS + every, minlength=SYMBOLS * SYMBOLS)


def begin(model: Model, pairs: np.ndarray) -> Model:
    # the direct path alone would know its own texts by heart; a strong prior leaves room for what generalises
    model.bigrams(pairs.reshape(SYMBOLS, SYMBOLS))
    model.start()
    return model


def train(texts: list[bytes | None], path: str) -> Model:
    """A model of a few texts, each of which ends with an end symbol, on the driver alone."""
    docs = [words_of(t) for t in texts]
    vocabulary = list(dict.fromkeys(w for d in docs for w in d))
    ids = dict(zip(vocabulary, word_encoder(path)(vocabulary), strict=True))
    flat = [np.frombuffer(b"".join(map(ids.__getitem__, d)), np.uint16) for d in docs]
    model = Model(np.bincount(np.concatenate([np.zeros(0, np.uint16), *flat]), minlength=IDS), len(docs))
    symbols = [np.append(model.symbol[d], END_SYMBOL).astype(np.int32) for d in flat]
    begin(model, pairs_of(symbols))
    n = sum(map(len, symbols))
    for turn in ROUNDS:
        tour = Tour(model, turn, times_through(n), n / STRIDE * (turn[1] - turn[0]) / 16 * times_through(n), 13)
        tour.run(symbols)
        set_weights(model, tour.weights())
    return model


def id_counts(counts: DataFrame, path: str) -> np.ndarray:
    """How often each id occurs, from the counts of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sums = flat_encoder(path), np.zeros(IDS, np.int64)
        for batch in batches:
            coded, sizes = encode(batch.column(0).to_numpy(zero_copy_only=False).tolist())
            sums += np.bincount(coded, weights=np.repeat(batch.column(1).to_numpy(), sizes), minlength=IDS).astype(np.int64)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], names=["id", "c"])

    return _sums(counts.select("word", "c").mapInArrow(run, "id long, c long"), "id", IDS)


def pair_counts(symbols: DataFrame) -> np.ndarray:
    """pairs_of() all documents (doc: 16-bit symbols)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            for _, docs in runs(batch, 0, 1 << 22):
                sums += pairs_of([np.frombuffer(d, np.uint16) for d in docs])
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], names=["pair", "c"])

    return _sums(symbols.select("doc").mapInArrow(run, "pair long, c long"), "pair", SYMBOLS * SYMBOLS)


def _sums(rows: DataFrame, key: str, n: int) -> np.ndarray:
    found = rows.groupBy(key).agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(n, np.int64)
    out[found[key].to_numpy()] = found["c"].to_numpy()
    return out


def go_through(symbols: DataFrame, model: Model, n_symbols: int) -> list[int]:
    """Fit the model on all documents (doc) in the ROUNDS. The number of windows seen, by round.

    Per round, each task sends its weights in PIECES, whose weighted sums are made by piece in other tasks; the driver gets these.
    """
    times, seen = times_through(n_symbols), []
    tasks = max(symbols.rdd.getNumPartitions(), 1)
    for turn in ROUNDS:
        sent = symbols.sparkSession.sparkContext.broadcast((dict(model.__dict__), turn, times, n_symbols / STRIDE * (turn[1] - turn[0]) / 16 * times / tasks))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            state, *rest = sent.value
            tour = Tour(model_of(state), *rest, 13)
            for batch in batches:
                for _, docs in runs(batch, 0, 1 << 20):
                    tour.run([np.frombuffer(d, np.uint16) for d in docs])
            if tour.seen:
                pieces = [p.tobytes() for p in np.array_split(tour.weights(), PIECES)]
                yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([tour.seen] * PIECES), pa.array(pieces, pa.binary())], names=["piece", "seen", "weights"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for piece, n, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held = sums.setdefault(piece, [0, 0.0])
                    held[0] += n
                    held[1] = held[1] + n * np.frombuffer(weights, np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1].tobytes() for x in sums.values()], pa.binary())], names=["piece", "seen", "weights"])

        kind = "piece int, seen long, weights binary"
        parts = sorted(symbols.select("doc").mapInArrow(run, kind).repartition(PIECES, "piece").mapInArrow(add, kind).collect())
        if parts:
            set_weights(model, np.concatenate([np.frombuffer(w, np.float64) / n for _, n, w in parts]))
        seen.append(parts[0][1] if parts else 0)
    return seen


def learn(symbols: DataFrame, model: Model) -> Model:
    """Complete a model, whose symbols are known, from the symbols of all training documents (doc)."""
    pairs = pair_counts(symbols)
    begin(model, pairs)
    model.seen = go_through(symbols, model, int(pairs.sum()))
    return model


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over all words of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            sums = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")])
            return pa.table({"word": sums["word"].cast(pa.binary()), "c": sums["c_sum"]}) if sums.num_rows else pa.table({"word": pa.array([], pa.binary()), "c": pa.array([], pa.int64())})

        for batch in batches:
            for start, stop in parts_of(batch.column(0), 1 << 22):
                seen = split_words(batch.column(0).slice(start, stop - start))[0].value_counts()
                held.append(pa.table({"word": seen.field(0), "c": seen.field(1)}))
                if sum(t.num_rows for t in held) > 1_000_000:
                    yield from merged().combine_chunks().to_batches()
                    held = []
        if held:
            yield from merged().combine_chunks().to_batches()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def heavy_words(counts: DataFrame, most: int = HEAVY) -> dict[bytes, int]:
    """The most frequent words and their counts: as many, up to ``most``, as a least count lets in.

    The least count is found from the number of words by the 12 leading bits of their count, of which there are less than 2^18.
    """
    bits = F.length(F.bin("c")) - 12
    held = counts.withColumn("lead", F.when(bits > 0, F.call_function("shiftleft", F.call_function("shiftright", "c", bits), bits)).otherwise(F.col("c")))
    least, n = 1 << 62, 0
    for c, k in sorted(((r[0], r[1]) for r in held.groupBy("lead").agg(F.count("*")).collect()), reverse=True):
        if n + k > most:
            break
        least, n = c, n + k
    return {bytes(r[0]): r[1] for r in held.filter((F.col("lead") >= least) & (F.octet_length("word") <= HEAVY_BYTES)).select("word", "c").collect()}


def coded_words(words: list[bytes], encode, kept: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after another, and how many each has; those of words in kept are known, and new ones are put there."""
    if len(kept) > CACHED:
        kept.clear()
    new = [w for w in words if w not in kept]
    kept.update(zip(new, encode(new), strict=True))
    coded = list(map(kept.__getitem__, words))
    return np.frombuffer(b"".join(coded), np.uint16), np.fromiter(map(len, coded), np.int64, len(coded)) // 2


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, one after another, and how many each text has."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return flat.filter(real), upto[edges[1:]] - upto[edges[:-1]]


def encoded(docs: DataFrame, model: Model, often: dict[bytes, int], n_docs: int, scale: float, path: str) -> DataFrame:
    """docs (doc_id, held_out, text) with a number of their own (rid), the number of tokens, and what frequent words give: how
    many tokens are known, their unigram log probability (base); the rare words with their number (rare); the symbols (doc) and the
    log probability of the ids given their symbols (extra). Words not in often are rare; n_docs ends are known.

    What is known of a word is found once for all its places in a run of texts."""
    ids, sizes = coded_words(list(often), word_encoder(path), {})
    sent = docs.sparkSession.sparkContext.broadcast((pa.array(often, pa.binary()), np.array(list(often.values()), np.float64), ids, sizes, model.symbol, model.extra))
    schema = docs.select("doc_id", "held_out").schema
    schema = schema.add("rid", "long").add("n_tokens", "long").add("known", "long").add("base", "double").add("rare", ArrayType(StructType().add("word", "binary").add("n", "integer"))).add("extra", "double").add("doc", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        known, often, often_ids, often_sizes, symbol, extra = sent.value
        encode = flat_encoder(path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start, stop in parts_of(batch.column(2), 1 << 22):
                words, size = split_words(batch.column(2).slice(start, stop - start))
                words = words.dictionary_encode()
                distinct = words.dictionary.cast(pa.binary())
                # words by number: frequent ones, the rare ones of this run, and the end
                number = pc.fill_null(pc.index_in(distinct, known), -1).to_numpy().astype(np.int64)
                new, n = np.flatnonzero(number < 0), len(size)
                end = len(often) + len(new)
                number[new] = np.arange(len(often), end)
                rare = distinct.take(pa.array(new))
                coded, sizes = encode(rare.to_numpy(zero_copy_only=False).tolist())
                coded, sizes = np.concatenate((often_ids, coded, [np.uint16(END_ID)])), np.concatenate((often_sizes, sizes, [1]))
                count = np.concatenate((often, np.full(len(new), -1.0), [n_docs]))
                chance = np.where(count >= 0, np.log10((np.maximum(count, 0) + 0.1) / scale), 0.0)
                given = np.add.reduceat(extra[coded], np.cumsum(sizes) - sizes)
                which = np.insert(number[words.indices.to_numpy()], np.cumsum(size), end)
                size = size + 1
                starts = np.cumsum(size) - size
                spot = np.flatnonzero(count[which] < 0)
                owner = np.searchsorted(starts, spot, "right") - 1
                pairs, times = np.unique(owner * (end + 1) + which[spot], return_counts=True)
                rare_n = np.bincount(pairs // (end + 1), minlength=n)
                own = pa.StructArray.from_arrays([rare.take(pa.array(pairs % (end + 1) - len(often))), pa.array(times, pa.int32())], names=["word", "n"])
                ends = np.cumsum(np.add.reduceat(sizes[which], starts))
                found = {
                    "rid": pa.array(np.arange(row, row + n)),
                    "n_tokens": pa.array(size),
                    "known": pa.array(np.add.reduceat((count > 0).astype(np.int64)[which], starts)),
                    "base": pa.array(np.add.reduceat(chance[which], starts)),
                    "rare": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], rare_n]).cumsum(), pa.int32()), own),
                    "extra": pa.array(np.add.reduceat(given[which], starts)),
                    "doc": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate(([0], 2 * ends)).astype(np.int32).tobytes()), pa.py_buffer(gathered(symbol[coded], sizes, which).tobytes())]),
                }
                row += n
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, n) for k in range(2)), *found.values()], names=["doc_id", "held_out", *found])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def rare_sums(coded: DataFrame, counts: DataFrame, scale: float) -> DataFrame:
    """By rid, how many tokens are known rare words, and the unigram log probability of all rare words. A task hashes its part of the
    counts, of which each word has one, so that the many occurrences need not be sorted."""
    rare = coded.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.n").join(counts.hint("shuffle_hash"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    return rare.groupBy("rid").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10((c + F.lit(0.1)) / F.lit(scale))).alias("plus"))


def scores(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text)."""
    spark, path = docs.sparkSession, path or vocabulary_path()
    held = id_remainder(F.col("doc_id"), 10) == 0
    training = docs.filter(~held)
    counts = cut(word_counts(training), "words")
    n_docs = training.select("doc_id").count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = total + n_docs, distinct + (n_docs > 0)
    scale = total + 0.1 * (distinct + 1)
    often = heavy_words(counts)
    model = Model(id_counts(counts, path), n_docs)
    coded = cut(encoded(docs.select("doc_id", held.alias("held_out"), "text"), model, often, n_docs, scale, path), "symbols")
    learn(coded.filter("not held_out").select("doc"), model)
    sent = spark.sparkContext.broadcast(dict(model.__dict__))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(sent.value)
        for batch in batches:
            for start, some in runs(batch, batch.num_columns - 1, 1 << 20):
                got = model.score([np.frombuffer(d, np.uint16) for d in some])
                part = batch.slice(start, len(some))
                score = (got + part.column("extra").to_numpy()) / math.log(10)
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(score)], names=[*part.schema.names[:-2], "score"])

    plain = coded.select("doc_id", "held_out", "rid", "n_tokens", "known", "base", "extra", "doc")
    scored = plain.mapInArrow(run, StructType(plain.schema.fields[:-2]).add("score", "double"))
    return scored.join(rare_sums(coded, counts, scale), "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("plus", F.lit(0.0))).alias("base_score"), "score",
    )

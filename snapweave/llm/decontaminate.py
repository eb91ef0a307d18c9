"""Benchmark decontamination over a distributed positional inverted index.

The index is sharded by document: a segment holds the documents of a few MB of text, its terms with their sorted positions, and
where each document starts. Segments are written to the shared folder, need no shuffle, and serve any number of test sets. The
items of a test set are rows too, long ones in pieces that overlap by a window. A first pass over the terms of all segments counts
those of the items; each window then has an anchor, its rarest term. A second pass finds the segments that hold an anchor, and a join by
term which pieces are to be looked for in which segments. There the anchor's posting list, moved by its offset, is intersected
with the moved lists of the neighbouring terms, nearest first, until it is empty or a whole window matches. Proximity works alike:
of the words of an item, so many of the rarest are anchors that a match must hold one of them.

Null and empty texts have no words: n_words 0, no hits, not contaminated. Null doc_ids and repeated rows stay rows of their
own; ids may be numbers or texts. An item without words has no window; a null item_id marks words as hit but is not listed. Equal
items and repeated item_ids are listed once. Empty tables give empty results or no hits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole_row
from .tokens import _store, parts_of

WINDOW = 13
#: Bytes of text in a segment (one longer document is a segment of its own).
SEGMENT_BYTES = 4 << 20
#: Windows in a piece of an item.
PIECE = 256
#: Bytes of terms up to which they are sent to all tasks; beyond, they are joined.
SENT_BYTES = 16 << 20
#: Tasks that look into files at once.
MOST_TASKS = 1 << 16

#: Lower-cases A-Z, keeps 0-9, a-z and bytes of non-ASCII characters, and blanks everything else.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (binary), one after another, and how many each text has. As words_of(), for many texts at once."""
    import pyarrow.compute as pc

    texts = pa.concat_arrays([pc.fill_null(texts, b"")])
    _, offsets, data = texts.buffers()
    plain = pa.py_buffer((data.to_pybytes() if data else b"").translate(WORD_BYTES))  # bytes keep their places
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.utf8(), len(texts), [None, offsets, plain], offset=texts.offset))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return flat.filter(real), upto[edges[1:]] - upto[edges[:-1]]


def _segment(texts: pa.Array) -> dict[str, pa.Array]:
    """Positions count through the segment; between documents lies one position without a word."""
    words, sizes = split(texts)
    words = words.dictionary_encode()
    term = words.indices.to_numpy()
    position = np.arange(len(term), dtype=np.int32) + np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    binary = lambda x: pa.array([x.astype(np.int32).tobytes()], pa.binary())
    return {
        "doc_words": pa.array([sizes], pa.list_(pa.int64())),
        "doc_starts": binary(np.concatenate(([0], np.cumsum(sizes + 1)))),
        "terms": pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary.cast(pa.binary())),
        "term_starts": binary(np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(words.dictionary)))))),
        "positions": binary(position[np.argsort(term, kind="stable")]),
    }


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored postings of every word of docs (doc_id, text): a row for each segment, which part and seg identify."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            ids, texts = (pa.concat_arrays([x.column(k) for x in held]) for k in range(2))
            found = {"part": pa.array([part], pa.int32()), "seg": pa.array([seg], pa.int32()), "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), **_segment(texts)}
            return pa.RecordBatch.from_arrays(list(found.values()), names=list(found))

        for batch in batches:
            for a, b in parts_of(batch.column(1), segment_bytes):
                held.append(batch.slice(a, b - a))
                size += held[-1].column(1).nbytes
                if size >= segment_bytes:
                    yield flush()
                    seg, held, size = seg + 1, [], 0
        if held:
            yield flush()

    columns = f"part int, seg int, doc_ids array<{kind}>, doc_words array<long>, doc_starts binary, terms array<binary>, term_starts binary, positions binary"
    return cut(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, columns), "postings")


def pieces_of(items: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """item, no (of the row), at (of the piece's first word), words, for each piece of items (item_id, text) with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1), piece) if words else ():
                    some = [words[at : at + piece + window - 1]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([row + k]), pa.array([at], pa.int32()), pa.array(some, pa.list_(pa.binary()))], names=["item", "no", "at", "words"])
            row += batch.num_rows

    kind = items.schema["item_id"].dataType.simpleString()
    return cut(items.select("item_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"item {kind}, no long, at int, words array<binary>"), "items")


def term_lists(index: DataFrame, terms: DataFrame, summed: bool = False) -> DataFrame:
    """term and n, how often each of terms (term, all different) occurs: in each segment (with part, seg, file), or in all.

    Terms of up to SENT_BYTES are sent to the tasks, which read the lists and drop the rest; more are joined.
    """
    spark = index.sparkSession
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 8), F.lit(0))).first()[0]
    few = [r[0] for r in terms.select("term").collect()] if size <= SENT_BYTES else None
    sent = spark.sparkContext.broadcast(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        chosen = None if sent.value is None else pa.array(sent.value, pa.binary())
        totals = np.zeros(len(chosen or ()), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(2).slice(i, 1).flatten()
                n = np.diff(np.frombuffer(batch.column(3)[i].as_py(), np.int32))
                if chosen is None:
                    found = own
                else:
                    at = pc.index_in(chosen, value_set=own)
                    which = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                    n = n[at.drop_null().to_numpy()]
                    if summed:
                        totals[which] += n
                        continue
                    found = chosen.take(pa.array(which))
                same = [pa.array([batch.column(k)[i].as_py()] * len(found), kind) for k, kind in ((0, pa.int32()), (1, pa.int32()), (4, pa.string()))]
                yield pa.RecordBatch.from_arrays([*same, found, pa.array(n, pa.int64())], names=["part", "seg", "file", "term", "n"])
        if summed and chosen is not None and totals.any():
            which = np.flatnonzero(totals)
            none = pa.nulls(len(which), pa.int32())
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(which), pa.string()), chosen.take(pa.array(which)), pa.array(totals[which])], names=["part", "seg", "file", "term", "n"])

    columns = index.select("part", "seg", "terms", "term_starts", F.col("_metadata.file_name").alias("file"))
    found = columns.mapInArrow(run, "part int, seg int, file string, term binary, n long")
    if few is None:
        found = found.join(terms.select("term"), "term")
    return found.groupBy("term").agg(F.sum("n").alias("n")) if summed else found


def _positions(pieces: DataFrame, index: DataFrame) -> DataFrame:
    """no, at, k, term and n (in the whole index; 0 where it is absent) for each word of the pieces."""
    words = pieces.select("no", "at", F.posexplode("words").alias("k", "term"))
    return words.join(term_lists(index, words.select("term").distinct(), summed=True), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def phrase_anchors(pieces: DataFrame, index: DataFrame, window: int = WINDOW) -> DataFrame:
    """no, at, term: the rarest term of each window of the pieces; none of windows with a term that the index lacks."""
    along = Window.partitionBy("no", "at").orderBy("k")
    span = along.rowsBetween(Window.currentRow, window - 1)
    rare = F.min(F.struct("n", "k", "term")).over(span)
    best = _positions(pieces, index).withColumn("best", rare).withColumn("left", F.count("*").over(Window.partitionBy("no", "at")) - F.col("k"))
    return best.filter((F.col("left") >= window) | (F.col("k") == 0)).filter("best.n > 0").select("no", "at", "best.term").distinct()


def near_anchors(pieces: DataFrame, index: DataFrame, least: int) -> DataFrame:
    """no, at, term: of m different words of a piece the m - least + 1 rarest, one of which lies in every match."""
    words = _positions(pieces, index).select("no", "at", "term", "n").distinct()
    whole = Window.partitionBy("no", "at")
    ranked = words.withColumn("rank", F.row_number().over(whole.orderBy("n", "term"))).withColumn("m", F.count("*").over(whole))
    return ranked.filter("n > 0").filter(F.col("rank") <= F.col("m") - least + 1).select("no", "at", "term")


class Segment:
    """A stored segment, opened for queries."""

    def __init__(self, terms: pa.Array, term_starts: bytes, positions: bytes, doc_starts: bytes):
        self.terms = terms
        self.starts = np.frombuffer(term_starts, np.int32)
        self.positions = np.frombuffer(positions, np.int32)
        self.doc_starts = np.frombuffer(doc_starts, np.int32)
        self.known: dict[bytes, np.ndarray] = {}

    def learn(self, words: set[bytes]) -> None:
        """Find the posting lists of words, all at once."""
        import pyarrow.compute as pc

        new = [w for w in words if w not in self.known]
        if new:
            at = pc.fill_null(pc.index_in(pa.array(new, pa.binary()), value_set=self.terms), -1).to_numpy().tolist()
            self.known.update((w, self.positions[self.starts[t] : self.starts[t + 1]] if t >= 0 else self.positions[:0]) for w, t in zip(new, at, strict=True))

    def lists(self, words: list[bytes]) -> list[np.ndarray]:
        """The posting lists of words, empty where the segment lacks one."""
        self.learn(set(words))
        return [self.known[w] for w in words]

    @staticmethod
    def reach(spots: np.ndarray, lists: list[np.ndarray], step: int) -> np.ndarray:
        """How many further lists, in the direction of step, hold the positions moved by their offset, for each spot."""
        run, alive = np.zeros(len(spots), np.int32), np.arange(len(spots))
        for k, held in enumerate(lists, 1):
            to = spots[alive] + step * k
            if not len(held):
                break
            alive = alive[held[np.minimum(np.searchsorted(held, to), len(held) - 1)] == to]
            if not len(alive):
                break
            run[alive] = k
        return run

    def phrases(self, words: list[bytes], anchors: list[bytes] | None = None, window: int = WINDOW) -> list[tuple[int, int]]:
        """Spans [a, b) of positions, each all in occurrences of windows of the words that hold an anchor (any word, if None)."""
        lists, w, found = self.lists(words), min(window, len(words)), []
        chosen = None if anchors is None else set(anchors)
        for k, word in enumerate(words):
            if len(lists[k]) and (chosen is None or word in chosen):
                spots = lists[k]
                right = self.reach(spots, lists[k + 1 : k + w], 1)
                left = self.reach(spots, lists[max(0, k - w + 1) : k][::-1], -1)
                hit = left + right + 1 >= w
                found += zip((spots - left)[hit].tolist(), (spots + right + 1)[hit].tolist(), strict=True)
        return found

    def doc(self, position: int) -> int:
        return int(np.searchsorted(self.doc_starts, position, "right")) - 1

    def near(self, words: list[bytes], width: int, least: int) -> list[int]:
        """Documents (their number in the segment) where at least ``least`` distinct words lie within ``width`` positions."""
        lists = [x for x in self.lists(list(dict.fromkeys(words))) if len(x)]
        if len(lists) < least:
            return []
        spot = np.concatenate(lists)
        which = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(spot, kind="stable")
        spot, which = spot[order], which[order]
        doc = np.searchsorted(self.doc_starts, spot, "right") - 1
        seen, count, left, out = np.zeros(len(lists), np.int64), 0, 0, []
        for right in range(len(spot)):
            count += seen[which[right]] == 0
            seen[which[right]] += 1
            while spot[right] - spot[left] >= width or doc[left] != doc[right]:
                seen[which[left]] -= 1
                count -= seen[which[left]] == 0
                left += 1
            if count >= least and (not out or out[-1] != doc[right]):
                out.append(int(doc[right]))
        return out


class IndexFile:
    """The segments of one stored file, in their order."""

    def __init__(self, folder: str, name: str):
        import pyarrow.parquet as pq

        store, path = _store(folder)
        self.source = store.open_input_file(f"{path}/{name}")
        self.rows = pq.ParquetFile(self.source).iter_batches(batch_size=1, columns=["seg", "doc_starts", "terms", "term_starts", "positions"])
        self.seg, self.segment = -1, None

    def open(self, seg: int) -> Segment:
        while self.seg < seg:
            row = next(self.rows)
            self.seg = row.column("seg")[0].as_py()
            if self.seg == seg:
                self.segment = Segment(row.column("terms").flatten(), *(row.column(c)[0].as_py() for c in ("term_starts", "positions", "doc_starts")))
        return self.segment


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans [a, b), in order, as spans that don't meet."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def look_up(index: DataFrame, pieces: DataFrame, anchors: DataFrame, find) -> DataFrame:
    """part, seg, ord, item, spans: what find(segment, words, anchor terms) gives, a dict of spans by document, for each piece in each
    segment that holds an anchor of it. Only files with such segments are read, each by one task; nothing of them is shuffled."""
    spark, folder = index.sparkSession, index._cut_path
    anchors = cut(anchors, "anchors")
    pairs = term_lists(index, anchors.select("term").distinct()).join(anchors, "term")
    own = pairs.groupBy("file", "part", "seg", "no", "at").agg(F.collect_set("term").alias("anchors")).join(pieces, ["no", "at"])
    kind = pieces.schema["item"].dataType.simpleString()
    wide = min(MOST_TASKS, 1 + (index.agg(F.max("part")).first()[0] or 0))  # files are numbered from 0
    todo = own.repartitionById(wide, F.pmod("part", F.lit(wide))).sortWithinPartitions("part", "seg").select("file", "part", "seg", "item", "words", "anchors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened = None, None
        spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            out: list[tuple] = []
            rows = enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "part", "seg", "words", "anchors")), strict=True))
            for (file, part, seg), group in groupby(rows, lambda x: x[1][:3]):
                if file != name:
                    name, opened = file, IndexFile(folder, file)
                segment, group = opened.open(seg), list(group)
                segment.learn({w for _, x in group for w in x[3]})
                for k, (_, _, _, words, terms) in group:
                    for doc, spans in find(segment, words, terms).items():
                        out.append((part, seg, doc, k, [{"a": a, "b": b} for a, b in spans]))
            part, seg, doc, k, spans = zip(*out, strict=True) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(seg, pa.int32()), pa.array(doc, pa.int32()), batch.column("item").take(pa.array(k, pa.int64())), pa.array(spans, spans_type)], names=["part", "seg", "ord", "item", "spans"]
            )

    return todo.mapInArrow(run, f"part int, seg int, ord int, item {kind}, spans array<struct<a:int,b:int>>")


def _numbered(index: DataFrame) -> DataFrame:
    """part, seg, ord, doc_id, n_words of every indexed document."""
    both = index.select("part", "seg", F.posexplode(F.arrays_zip("doc_ids", "doc_words")).alias("ord", "d"))
    return both.select("part", "seg", "ord", F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_words").alias("n_words"))


def matches(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """For every indexed document: n_words, the spans of words inside occurrences of windows, and the items that occur."""
    pieces = pieces_of(items, window)

    def find(segment: Segment, words: list[bytes], terms: list[bytes]) -> dict:
        spans: dict[int, list] = {}
        for a, b in segment.phrases(words, terms, window):
            doc = segment.doc(a)
            first = int(segment.doc_starts[doc])
            spans.setdefault(doc, []).append((a - first, b - first))
        return {doc: merged(x) for doc, x in spans.items()}

    found = look_up(index, pieces, phrase_anchors(pieces, index, window), find)
    hits = found.groupBy("part", "seg", "ord").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.collect_set("item").alias("items"))
    rows = _numbered(index).join(hits, ["part", "seg", "ord"], "left").drop("part", "seg", "ord")
    return rows.withColumn("spans", F.coalesce("spans", F.array().cast(hits.schema["spans"].dataType))).withColumn("items", F.coalesce("items", F.array().cast(hits.schema["items"].dataType)))


def proximity(index: DataFrame, items: DataFrame, width: int, least: int) -> DataFrame:
    """(doc_id, item_id) where at least ``least`` distinct words of an item lie within ``width`` words of a document."""
    pieces = pieces_of(items, WINDOW, 1 << 30)  # whole items
    found = look_up(index, pieces, near_anchors(pieces, index, least), lambda segment, words, terms: {d: [] for d in segment.near(words, width, least)})
    return found.join(_numbered(index), ["part", "seg", "ord"]).select("doc_id", F.col("item").alias("item_id"))


def covered(spans: Column) -> Column:
    """The number of positions in the union of spans [a, b)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda x, s: F.struct(F.greatest(x["end"], s["b"]).alias("end"), (x["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(x["end"], s["a"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), start, step, lambda x: x["n"])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (item_ids), contaminated: n_hit > 0 and 20 * n_hit >= n_words."""
    found = matches(build_index(docs), items)
    counted = found.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), "items")
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated; the columns of docs.

    The index knows a row by a hash of doc_id and text. Contaminated rows may be any number, so this is an ordinary anti join.
    """
    key = F.xxhash64("doc_id", "text")
    bad = contamination(docs.select(key.alias("doc_id"), "text"), items).filter("contaminated").select(F.col("doc_id").alias("_k")).distinct()
    return docs.select(whole_row(docs), key.alias("_k")).join(bad, "_k", "left_anti").select("row.*")

"""Token ids: an encoder with a bounded cache, Arrow stream files of equal-length sequences, and a separator scan of flat files.

Every file lies in a folder that all executors share and is complete before it gets its final name, so that a task can run
again, or twice at once. Null and empty texts are documents of their end id alone; null doc_ids and repeated rows are
documents like others; equal doc_ids are in the order of a hash of their texts, so that reruns agree; an empty table gives no
files and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir

TOKENIZER = "byte_bpe_50k.json"
END = 2
#: In flat files, an id that no text encodes to (special strings count as ordinary text there).
SEPARATOR = 50256
SEQUENCE = 1024
ROWS = 64
#: Bytes of ids in a block of the separator scan.
BLOCK = 8 << 20
#: Bytes of text that a file holds, about (one longer document more); beyond MOST_PARTS files, they grow.
PART_BYTES = 32 << 20
MOST_PARTS = 1 << 16
#: Rows in a range of the sort that finds where files begin.
RANGE_ROWS = 100_000
#: Pieces whose ids a task keeps.
CACHED = 800_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Marks that may end a piece after its letters.
TAILS = ".,;:!?%#&*$|"


def library_of(path: str, plain: bool):
    """The tokenizer. Tasks already run in parallel, so its own threads are switched off."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = plain
    return library


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones their own, the others those from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}


class PieceEncoder:
    """The ids of pieces; None for those that are empty or have white space at an edge.

    Letters alone are one unit of the library's pre-tokenizer, and so are the marks of TAILS after them (an apostrophe might
    not be). So letters go straight to the library's BPE model, as byte letters; everything else goes through the library.
    """

    def __init__(self, library):
        self.library, self.model = library, library.model.tokenize
        self.table = byte_letters()
        self.blank = self.table[32]
        self.tails: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {}

    def full(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, pieces: list[str], lead: str) -> list[bytes | None]:
        out: list[bytes | None] = []
        odd = []
        if len(self.stems) > CACHED // 2:
            self.stems.clear()
        start, table, model, tails, stems = lead and self.blank, self.table, self.model, self.tails, self.stems
        for p in pieces:
            stem = p.rstrip(TAILS)
            if not stem.isalpha():
                if p and not p[0].isspace() and not p[-1].isspace():
                    odd.append(len(out))
                out.append(None)
                continue
            letters = stem if stem.isascii() else stem.encode().decode("latin-1").translate(table)
            tail = p[len(stem) :]
            if tail not in tails:
                if len(tails) > 10_000:
                    tails.clear()
                    tails[""] = b""
                tails[tail] = self.full([tail])[0]
            key = start + letters
            ids = stems.get(key)
            if ids is None:
                ids = stems[key] = array("H", [t.id for t in model(key)]).tobytes()
            out.append(ids + tails[tail] if tail else ids)
        for i in range(0, len(odd), 5000):
            some = odd[i : i + 5000]
            for k, ids in zip(some, self.full([lead + pieces[k] for k in some]), strict=True):
                out[k] = ids
        return out


def parts_of(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """From where to where runs of texts of about ``most`` bytes reach."""
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    start = 0
    while start < len(texts):
        done = upto[start - 1] if start else 0
        end = min(len(texts), int(np.searchsorted(upto, done + most)) + 1)
        yield start, end
        start = end


def gathered(rows: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The pieces ``which`` of rows, one after another; sizes are those of the pieces."""
    first, own = np.cumsum(sizes) - sizes, sizes[which]
    return rows[np.repeat(first[which] - (np.cumsum(own) - own), own) + np.arange(own.sum())]


class Encoder:
    """Ids (unsigned 16-bit integers) of whole texts, equal to the library's, each text followed by an end id.

    A byte-level BPE never joins what stands on both sides of a single space between two other characters, so each piece up
    to there is encoded once and kept, and its ids are copied to all its places in a run of texts. Texts with other spacing
    go to the library whole.
    """

    def __init__(self, path: str, end: int, plain: bool = False):
        self.library = library_of(path, plain)
        self.pieces = PieceEncoder(self.library)
        self.end = np.array([end], "<u2").tobytes()
        self.later: dict[str, bytes | None] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's ids end."""
        import pyarrow.compute as pc

        if len(self.later) > CACHED:
            self.later.clear()
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        count = np.diff(lists.offsets.to_numpy()).astype(np.int64)  # at least one piece each
        starts = np.cumsum(count) - count
        words = lists.flatten().dictionary_encode()
        distinct, which = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
        new = [p for p in distinct if p not in self.later]
        self.later.update(zip(new, self.pieces.encode(new, " "), strict=True))
        known = [self.later[p] for p in distinct]
        odd = np.fromiter((x is None for x in known), bool, len(known))
        begin, first = np.unique(which[starts], return_inverse=True)
        opening = self.pieces.encode([distinct[k] for k in begin.tolist()], "")
        # odd pieces inside a text, or a first one that is none, send the whole text to the library
        inner = odd[which]
        inner[starts] = np.fromiter((x is None for x in opening), bool, len(opening))[first]
        whole = np.logical_or.reduceat(inner, starts)
        texts_whole = self.pieces.full([x or "" for x in texts.filter(pa.array(whole)).to_pylist()])
        which[starts] = len(known) + first
        base = len(known) + len(opening)
        size = np.where(whole, 1, count) + 1
        ends = np.cumsum(size)
        order = np.full(ends[-1] if len(ends) else 0, -1, np.int64)
        order[ends - 1] = base + len(texts_whole)
        order[(ends - size)[whole]] = base + np.arange(len(texts_whole))
        order[order < 0] = which[np.repeat(~whole, count)]
        every = [x or b"" for x in (*known, *opening)] + texts_whole + [self.end]
        sizes = np.fromiter(map(len, every), np.int64, len(every)) // 2
        for p in [p for p, x in zip(distinct, known, strict=True) if x is None]:
            del self.later[p]
        return gathered(np.frombuffer(b"".join(every), "<u2"), sizes, order), np.cumsum(np.add.reduceat(sizes[order], ends - size)) if len(ends) else ends


def runs(batch: pa.RecordBatch, text: int, most: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Start and texts of runs of rows with about ``most`` characters."""
    start, size, part = 0, 0, []
    for x in batch.column(text).to_pylist():
        part.append(x)
        size += len(x or "")
        if size >= most:
            yield start, part
            start, size, part = start + len(part), 0, []
    if part:
        yield start, part


def _store(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri.removeprefix("file:/").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _publish(uri: str, name: str, fill: Callable) -> None:
    """Have fill(stream) write a file under a name of its own, then rename it."""
    store, path = _store(uri)
    store.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        fill(out)
    store.move(own, f"{path}/{name}")


def _sequences(length: int) -> pa.Schema:
    fixed = lambda kind: pa.list_(kind, length)
    return pa.schema([("ids", fixed(pa.uint16())), ("valid", fixed(pa.bool_())), ("ends", fixed(pa.bool_()))])


class SequenceWriter:
    """Packs documents into sequences of one length, ``rows`` a batch. ends marks the last id of each document, valid what isn't padding."""

    def __init__(self, out, length: int, rows: int):
        self.length, self.step, self.schema = length, length * rows, _sequences(length)
        self.writer = pa.ipc.new_stream(out, self.schema)
        self.ids: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Some documents: their ids, one after another, and where each ends."""
        last = np.zeros(len(ids), bool)
        last[ends - 1] = True
        self.ids.append(ids)
        self.ends.append(last)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.step:
            ids, last = np.concatenate(self.ids), np.concatenate(self.ends)
            whole = self.held // self.step * self.step
            for k in range(0, whole, self.step):
                self._write(ids[k : k + self.step], last[k : k + self.step], self.step)
            self.ids, self.ends, self.held = [ids[whole:]], [last[whole:]], self.held - whole

    def _write(self, ids: np.ndarray, ends: np.ndarray, count: int) -> None:
        valid = np.arange(len(ids)) < count
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, valid, ends)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            fill = -self.held % self.length
            ids, ends = np.concatenate(self.ids), np.concatenate(self.ends)
            self._write(np.pad(ids, (0, fill)), np.pad(ends, (0, fill)), self.held)
        self.writer.close()


class SequenceFile:
    """A stream file, mapped: sequence(i) gives ids and masks without copying them. All batches but the last have equal rows."""

    def __init__(self, uri: str, name: str):
        store, path = _store(uri)
        local = store.type_name == "local"
        self.source = pa.memory_map(f"{path}/{name}") if local else store.open_input_file(f"{path}/{name}")
        self.batches = list(pa.ipc.open_stream(self.source))
        self.rows = self.batches[0].num_rows if self.batches else 0
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> dict[str, pa.Array]:
        batch, k = self.batches[i // self.rows], i % self.rows
        return {c: batch.column(c).slice(k, 1).flatten() for c in ("ids", "valid", "ends")}

    def flat(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """ids and ends of each batch, without padding."""
        for b in self.batches:
            ids, valid, ends = (b.column(k).flatten().to_numpy(zero_copy_only=not k) for k in range(3))
            n = int(valid.sum())
            yield ids[:n], ends[:n]


def file_starts(docs: DataFrame, part_bytes: int = PART_BYTES) -> tuple[int, DataFrame]:
    """How many files docs (doc_id, th, place, size) fill in order of doc_id, th and place, and one row: the keys at which each begins.

    Bytes before a row are a prefix sum: over ranges of the order, then inside each range. Reaches the driver: a row a range and file.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.col("th"), F.col("place")]
    keys = cut(docs, "keys")
    total, n = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = max(1, min(MOST_PARTS, max(-(-total // part_bytes), min(spark.sparkContext.defaultParallelism, total >> 20))))
    each = max(1, -(-total // parts))
    if parts > 1:
        ranged = cut(keys.repartitionByRange(max(1, -(-n // RANGE_ROWS)), *order).withColumn("range", F.spark_partition_id()), "ranges")
        before, starts = 0, []
        for r, size in sorted(tuple(x) for x in ranged.groupBy("range").agg(F.sum("size")).collect()):
            starts.append((r, before))
            before += size
        along = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        prior = F.coalesce(F.sum("size").over(along), F.lit(0))
        placed = ranged.withColumn("own", prior).join(F.broadcast(spark.createDataFrame(starts, "range int, before long")), "range")
        key = F.struct("doc_id", "th", "place")
        firsts = placed.groupBy(F.floor((F.col("own") + F.col("before")) / each).alias("part")).agg(F.min(key).alias("key"))
    else:
        firsts = keys.agg(F.min(F.struct("doc_id", "th", "place")).alias("key")).filter("key is not null")
    return parts, firsts.agg(F.array_sort(F.collect_list("key")).alias("firsts")).withColumn("one", F.lit(1))


def write_sequences(docs: DataFrame, length: int = SEQUENCE, rows: int = ROWS, path: str | None = None, end: int = END, part_bytes: int = PART_BYTES) -> tuple[str, DataFrame]:
    """Write docs in ascending order of doc_id (nulls first) as stream files. The folder, and a row (part, docs, ids) for each file."""
    spark, folder, path = docs.sparkSession, shared_dir(docs.sparkSession, "sequences"), path or tokenizer_path()
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("place"))
    parts, firsts = file_starts(keyed.select("doc_id", "th", "place", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")), part_bytes)
    mine = F.struct("doc_id", "th", "place")
    # the number of files that begin at or before a row, by bisection; the one row of firsts has at most MOST_PARTS keys
    upto = F.aggregate(
        F.array(*(F.lit(1 << k) for k in reversed(range(parts.bit_length())))), F.lit(0), lambda n, step: F.when(F.coalesce(F.get("firsts", n + step - 1) <= mine, F.lit(False)), n + step).otherwise(n)
    )
    placed = keyed.withColumn("one", F.lit(1)).join(F.broadcast(firsts), "one").select("doc_id", "text", "th", "place", F.greatest(F.lit(0), upto - 1).alias("part"))
    ordered = placed.repartitionById(parts, "part").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "th", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), Encoder(path, end)
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        told = {"docs": 0}
        schema = pa.schema([first.schema.field(0).with_name("doc_id")])

        def fill(out) -> None:
            def names(ids_out) -> None:
                writer, batch = SequenceWriter(out, length, rows), first
                with pa.ipc.new_stream(ids_out, schema) as w:
                    while batch is not None:
                        w.write_batch(pa.RecordBatch.from_arrays([batch.column(0)], schema=schema))
                        told["docs"] += batch.num_rows
                        for a, b in parts_of(batch.column(1), 1 << 22):
                            writer.add(*encoder.encode(batch.column(1).slice(a, b - a)))
                        batch = next(batches, None)
                writer.close()
                told["total"] = writer.total

            _publish(folder, f"part-{part:06d}.ids", names)

        _publish(folder, f"part-{part:06d}.arrows", fill)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([told["docs"]], pa.int64()), "ids": pa.array([told["total"]], pa.int64())})

    return folder, cut(ordered.select("doc_id", "text").mapInArrow(run, "part int, docs long, ids long"), "files")


def read_sequences(folder: str, files: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files, of which there are at most MOST_PARTS; a task for each."""
    todo, at = [], 0
    for part, n in sorted((r.part, r.ids) for r in files.collect()):
        todo.append((len(todo), part, at))
        at += n
    rows = files.sparkSession.createDataFrame(todo, "task int, part int, at long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for which in batches:
            for part, at in zip(which.column(0).to_pylist(), which.column(1).to_pylist(), strict=True):
                store, path = _store(folder)
                with store.open_input_stream(f"{path}/part-{part:06d}.ids") as f:
                    names = pa.ipc.open_stream(f).read_all().column(0).combine_chunks()
                begin, count, crc = [], [], []
                n = c = 0
                for ids, ends in SequenceFile(folder, f"part-{part:06d}.arrows").flat():
                    wide, a = ids.astype("<u4"), 0
                    for b in (np.flatnonzero(ends) + 1).tolist():
                        begin.append(at)
                        count.append(n + b - a)
                        crc.append(zlib.crc32(wide[a:b], c))
                        at, n, c, a = at + n + b - a, 0, 0, b
                    n, c = n + len(ids) - a, zlib.crc32(wide[a:], c)
                yield pa.RecordBatch.from_arrays([names, pa.array(begin, pa.int64()), pa.array(count, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.repartitionById(max(1, len(todo)), "task").select("part", "at").mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def encode_to_files(docs: DataFrame) -> DataFrame:
    """Write the sequences of docs and read every document back from them."""
    return read_sequences(*write_sequences(docs), docs.schema["doc_id"].dataType.simpleString())


def write_flat(docs: DataFrame, path: str | None = None) -> tuple[str, DataFrame]:
    """Write ids and separators, nothing else, as flat files, one a task. The folder, and (file, ord, doc_id) in writing order."""
    folder, path = shared_dir(docs.sparkSession, "flat"), path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), Encoder(path, SEPARATOR, plain=True)
        ids: list[pa.Array] = []

        def fill(out) -> None:
            for batch in batches:
                ids.append(batch.column(0))
                for a, b in parts_of(batch.column(1), 1 << 22):
                    out.write(encoder.encode(batch.column(1).slice(a, b - a))[0].tobytes())

        _publish(folder, f"tokens-{part:06d}.bin", fill)
        n = 0
        for some in ids:
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int32()), pa.array(np.arange(n, n + len(some))), some], names=["file", "ord", "doc_id"])
            n += len(some)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return folder, cut(docs.select("doc_id", "text").mapInArrow(run, f"file int, ord long, doc_id {kind}"), "names")


def scan_separators(spark, folder: str, block: int = BLOCK) -> DataFrame:
    """file (its number), ord, start (in its file), n_tokens (with the separator), complete, for each document in the flat files of folder.

    Each block of a file is searched on its own and gives a row for each separator, with the one before it in the block, and a row of
    its own. The last separator of the blocks before, and their number of separators, are running values over the file's blocks'
    rows, which stitch documents that cross blocks.
    What follows the last separator of a file is a document that isn't complete.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.bin").load(folder).select("path", "length")
    number = F.regexp_extract("path", r"tokens-(\d+)\.bin$", 1).cast("int")
    blocks = listed.filter("length > 0").select(number.alias("file"), "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long"))).alias("at"))
    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(f"{path}/tokens-{r['file']:06d}.bin") as f:
                    f.seek(r["at"])
                    ids = np.frombuffer(f.read(min(block, r["length"] - r["at"])), "<u2")
                hits = np.flatnonzero(ids == SEPARATOR) + r["at"] // 2
                # the block's own row has k = the number of its separators and hit = the last one (-1: none)
                spots = np.append(hits, hits[-1] if len(hits) else -1)
                n = len(spots)
                prior = np.concatenate(([-1], hits)) if n > 1 else np.array([-1])
                yield pa.RecordBatch.from_pydict(
                    {"file": pa.array([r["file"]] * n, pa.int32()), "at": pa.array([r["at"]] * n, pa.int64()), "total": pa.array([r["length"] // 2] * n, pa.int64()), "k": pa.array(np.arange(n)), "hit": pa.array(spots), "prior": pa.array(prior), "own": pa.array(np.arange(n) == n - 1)}
                )

    found = cut(blocks.repartition(wide, "file", "at").mapInArrow(run, "file int, at long, total long, k long, hit long, prior long, own boolean"), "hits")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.filter("own").select(
        "file", "at", "total", "k", "hit",
        F.coalesce(F.last(F.when(F.col("hit") >= 0, F.col("hit")), ignorenulls=True).over(before), F.lit(-1)).alias("carry"),
        F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"),
        F.max("at").over(Window.partitionBy("file")).alias("end"),
    )
    prior = F.when(F.col("k") > 0, F.col("prior")).otherwise(F.col("carry"))
    done = found.filter("not own").join(stitched.select("file", "at", "carry", "first"), ["file", "at"])
    done = done.select("file", (F.col("first") + F.col("k")).alias("ord"), (prior + 1).alias("start"), (F.col("hit") - prior).alias("n_tokens"), F.lit(True).alias("complete"))
    final = F.when(F.col("hit") >= 0, F.col("hit")).otherwise(F.col("carry")) + 1
    open_ = stitched.filter("at = end").select("file", (F.col("first") + F.col("k")).alias("ord"), final.alias("start"), (F.col("total") - final).alias("n_tokens"), F.lit(False).alias("complete"))
    return done.unionByName(open_.filter("n_tokens > 0"))


def file_bases(files: DataFrame, width: int = 1024) -> DataFrame:
    """file, base: the sum of ``all`` over the files before, from sums of ``width`` files each, which reach the driver."""
    spark = files.sparkSession
    grouped = files.withColumn("group", F.floor(F.col("file") / width).cast("int"))
    starts, at = [], 0
    for g, n in sorted(tuple(r) for r in grouped.groupBy("group").agg(F.sum("all")).collect()):
        starts.append((g, at))
        at += n
    along = Window.partitionBy("group").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    own = grouped.withColumn("own", F.coalesce(F.sum("all").over(along), F.lit(0)))
    return own.join(F.broadcast(spark.createDataFrame(starts, "group int, at long")), "group").select("file", (F.col("own") + F.col("at")).alias("base"))


def count_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, file (its number), ord, start (over all files, by number), n_tokens: counted from the flat files of docs alone."""
    folder, names = write_flat(docs)
    found = cut(scan_separators(docs.sparkSession, folder), "counts")
    base = file_bases(found.groupBy("file").agg(F.sum("n_tokens").alias("all")))
    both = found.join(names, ["file", "ord"]).join(base, "file")
    return both.select("doc_id", "file", "ord", (F.col("base") + F.col("start")).alias("start"), "n_tokens")

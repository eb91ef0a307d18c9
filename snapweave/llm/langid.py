"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, the first rotated by
two places and the second by one; a text's vector bundles (adds) those of all its trigrams; a language's prototype bundles the
unit vectors of its training texts. A text gets the language whose prototype has the largest cosine. Two random vectors have a cosine of
about 1 / sqrt(DIM); a text of some length that is no more like any prototype than three times that is in no language that was learned.

Null texts and texts without letters are ``und`` with score 0. Ties go to the language that is first by code point. Where no
labelled text exists, everything is ``und``. Texts of any length are read whole; repeated rows are predicted alike; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, whole_row

DIM = 1024
SEED = 20240229
#: Letters share item vectors by code point modulo this prime; 0 stands for what lies between words.
SYMBOLS = 4093
#: Training rows of each language, about; the rest of a larger language is left out by a hash of the row.
TRAIN_DOCS = 5000
#: A model has a row for each language and goes to every task; more labels than this are an error.
MOST_LANGUAGES = 10_000
UNKNOWN = "und"
#: Trigrams from which on a text's profile can be told from chance, and how many deviations of chance its cosine must pass.
TOLD_FROM, DEVIATIONS = 30, 3.0


class Encoder:
    def __init__(self, dim: int = DIM, seed: int = SEED):
        items = np.random.default_rng(seed).integers(0, 2, (SYMBOLS + 1, dim), np.int8) * 2 - 1
        self.items = [np.roll(items, 2, axis=1), np.roll(items, 1, axis=1), items]
        self.dim = dim
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes and counts of the trigrams of lower-cased letters; runs of other characters are one blank."""
        point = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        is_letter = self.letter[np.minimum(point, 0xFFFF)]
        for i in np.flatnonzero(point > 0xFFFF).tolist():
            is_letter[i] = chr(point[i]).isalpha()
        if not is_letter.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        symbol = np.where(is_letter, point % SYMBOLS + 1, 0).astype(np.int64)
        symbol = np.concatenate(([0], symbol, [0]))
        symbol = symbol[np.concatenate(([True], (symbol[1:] != 0) | (symbol[:-1] != 0)))]
        return np.unique((symbol[:-2] * (SYMBOLS + 1) + symbol[1:-1]) * (SYMBOLS + 1) + symbol[2:], return_counts=True)

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of each text, and how many trigrams it has; none if it has no letters."""
        grams = [self.trigrams(t or "") for t in texts]
        codes, where = np.unique(np.concatenate([g[0] for g in grams]), return_inverse=True)
        out = np.zeros((len(texts), self.dim), np.float32)
        if len(codes):
            base, row = SYMBOLS + 1, np.repeat(np.arange(len(texts)), [len(g[0]) for g in grams])
            count = np.concatenate([g[1] for g in grams]).astype(np.float32)
            for i in range(0, len(codes), 4096):
                part = codes[i : i + 4096]
                bound = self.items[0][part // base**2] * self.items[1][part // base % base] * self.items[2][part % base]
                dense, own = np.zeros((len(texts), len(part)), np.float32), (where >= i) & (where < i + len(part))
                dense[row[own], where[own] - i] = count[own]
                out += dense @ bound.astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norm, 1e-9), np.array([g[1].sum() for g in grams], np.int64)

    def batches(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Start, vectors and numbers of trigrams of runs of at most 64 texts or about 500,000 characters."""
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if i + 1 - start == 64 or size > 500_000 or i + 1 == len(texts):
                yield start, *self.vectors(texts[start : i + 1])
                start, size = i + 1, 0


def learn(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from text and lang of labelled.

    The sample of a large language is drawn row by row, by a hash of the text and of where the row lies, so that rows which agree
    in everything are drawn one by one too (the same files in the same splits give the same sample). One row a language
    reaches the driver.
    """
    spark = labelled.sparkSession
    known = labelled.filter("lang is not null and text is not null").select("lang", "text")
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counted) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sizes = spark.createDataFrame(counted, "lang string, n long")
    seed = F.xxhash64("text", F.monotonically_increasing_id())
    drawn = known.withColumn("u", F.pmod(seed, F.lit(1 << 30))).join(F.broadcast(sizes), "lang").filter(F.col("u") < F.least(F.lit(1.0), train_docs / F.col("n")) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, vectors, _ in encoder.batches(texts):
                for lang in set(langs[start : start + len(vectors)]):
                    own = [k for k in range(len(vectors)) if langs[start + k] == lang]
                    sums[lang] = sums.get(lang, 0) + vectors[own].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "sum"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(part, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "sum"])

    kind = "lang string, sum binary"
    total = {r[0]: np.frombuffer(bytes(r[1]), np.float64) for r in drawn.select("lang", "text").mapInArrow(run, kind).repartition(8, "lang").mapInArrow(add, kind).collect()}
    langs = sorted(total)
    prototypes = np.array([total[x] / max(np.linalg.norm(total[x]), 1e-9) for x in langs], np.float32).reshape(len(langs), DIM)
    return langs, prototypes


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], inside: int | None = None) -> DataFrame:
    """keep, lang_pred, score (the cosine, 0 where negative) and grams, the number of trigrams. inside: the text is that field of the only kept column, a struct."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("grams", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes = sent.value
        encoder = Encoder()
        for batch in batches:
            pred, score, grams = [], [], []
            texts = batch.column("_t") if inside is None else batch.column(0).field(inside)
            for _, vectors, sizes in encoder.batches(texts.to_pylist()):
                cosine = vectors @ prototypes.T if langs else np.zeros((len(vectors), 0))
                grams += sizes.tolist()
                for k, size in enumerate(sizes):
                    best = int(cosine[k].argmax()) if size and langs else -1
                    pred.append(langs[best] if best >= 0 else UNKNOWN)
                    score.append(float(min(1.0, max(0.0, cosine[k][best]))) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(grams, pa.int64())], names=[*keep, "lang_pred", "score", "grams"])

    return docs.select(*keep, *([F.col("text").alias("_t")] if inside is None else [])).mapInArrow(run, schema)


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """keep (doc_id), held_out, lang_pred, score: learned from the documents that are not held out, predicted for all."""
    keep = keep or ["doc_id"]
    held = id_remainder(F.col("doc_id"), 5) == 0
    model = learn(docs.filter(~held).select("doc_id", "lang", "text"))
    return predict(docs, model, keep).withColumn("held_out", held)


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told; the columns of docs. Where no language can be learned, all documents.

    Texts without letters go, and those of TOLD_FROM trigrams or more whose profile is no nearer to any language than chance. Shorter
    ones, of which a profile says little, stay.
    """
    held = id_remainder(F.col("doc_id"), 5) == 0
    model = learn(docs.filter(~held).select("doc_id", "lang", "text"))
    if not model[0]:
        return docs
    told = (F.col("grams") < TOLD_FROM) | (F.col("score") > DEVIATIONS / DIM**0.5)
    return predict(docs.select(whole_row(docs)), model, ["row"], docs.columns.index("text")).filter(told & (F.col("lang_pred") != UNKNOWN)).select("row.*")

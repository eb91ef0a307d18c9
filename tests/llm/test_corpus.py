"""The corpus operators against brute force, on a table with every odd row: nulls, empty and long texts, repeats, clashing names."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snapweave.llm import decontaminate, extract, langid, lm, mixing, quality, resharding, simhash, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, _k string, h long, size string, fp string, shard int, key string"
WORDS = "the of and to in is that it for was on with as be by at der die und das ist nicht ein le la de et est que".split()
LOWER = {c: c + 32 for c in range(65, 91)}


def sentence(rng, n, stem="x"):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.4 else stem + "".join(rng.choice("aeiourstlnmd") for _ in range(rng.randint(2, 9))) for _ in range(n))


def rows():
    rng = random.Random(5)
    out = []

    def add(i, text, lang="en", source="s0"):
        out.append((i, text, lang, source, None if text is None else len(text), 1.5, "r", "k", 7, "z", "f", 3, "q"))

    for i in range(60):
        lang = ("en", "de")[i % 2]
        add(i, sentence(rng, rng.randint(5, 120), "th" if lang == "en" else "sch"), lang, f"s{i % 5}")
    add(60, None)
    add(None, "a text without an id, the one and only of its kind")
    add(None, None, None, None)
    add(61, "")
    add(62, " \t\n ")
    add(63, "12345 !!! ... 67", "de")
    add(64, "Größe ÉTÉ 日本語 текст 😀 <|endoftext|> don't\x00 x  y z", None, None)
    long = sentence(rng, 60_000)
    add(65, long, "en", "s1")
    for i in range(66, 76):
        add(i, out[3][1], "de", "s2")
    for _ in range(3):
        add(76, out[5][1])
    base = out[8][1].split() * 6
    for i in range(77, 87):
        near = list(base)
        near[i] = f"changed{i}"
        add(i, " ".join(near))
    add(87, "same line here\nsame line here\nsame line here\nsame line here\nother words of the text")
    add(88, sentence(rng, 30) + " " + " ".join(f"bench{k}" for k in range(15)) + " " + sentence(rng, 10))
    add(89, "bench0 Bench1, bench2")
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    more = [(0, " ".join(f"Bench{k}" for k in range(15))), (1, "bench0 bench1 bench2"), (2, None), (3, ""), (None, "bench1 bench2"), (1, "bench0 bench1 bench2"), (10, "never occurs here at all")]
    return spark.createDataFrame([(i, t, "x") for i, t in more], "item_id long, text string, segment string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return words((text or "").translate(LOWER))


def remainder(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def by_id(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_language_id(docs, empty):
    out = langid.identify(docs.select(*docs.columns), ["doc_id", "text", "lang"]).collect()
    assert len(out) == docs.count()
    good = 0
    for r in out:
        assert r.held_out == (remainder(r.doc_id, 5) == 0)
        assert 0 <= r.score <= 1
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and r.doc_id < 60:
            good += r.lang_pred == r.lang
    assert good >= 57
    assert langid.identify(empty).count() == 0
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert collections.Counter(r[0] for r in rows() if any(c.isalpha() for c in r[1] or "")) - ids == {64: 1}  # of several scripts
    assert langid.keep_known(empty).columns == docs.columns
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_trigram_vectors_bind_and_bundle():
    encoder = langid.Encoder(dim=64)
    codes, counts = encoder.trigrams("Abab, ab!")
    assert counts.sum() == 7  # of " abab ab "
    vectors, sizes = encoder.vectors(["abab ab", "1 2", None])
    want = np.zeros(64)
    symbols = [0, *(ord(c) % langid.SYMBOLS + 1 if c != " " else 0 for c in "abab ab"), 0]
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        want += encoder.items[0][a].astype(int) * encoder.items[1][b] * encoder.items[2][c]
    assert np.allclose(vectors[0], want / np.linalg.norm(want), atol=1e-5)
    assert sizes.tolist() == [7, 0, 0]


def test_texts_of_no_learned_language_go(spark, docs):
    rng = random.Random(31)
    odd = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(60)) for letters in ("абвгдежзиклмнопрст", "αβγδεζηθικλμνξοπρ", "日本語文字列検査用例")]
    more = spark.createDataFrame([(1000 + k, t, None, "s0", len(t), 1.5, "r", "k", 7, "z", "f", 3, "q") for k, t in enumerate([*odd, "да", "ясно так"])], SCHEMA)
    kept = {r.doc_id for r in langid.keep_known(docs.unionByName(more)).collect() if r.doc_id is not None}
    assert {1000, 1001, 1002}.isdisjoint(kept) and {1003, 1004} <= kept and set(range(60)) <= kept  # two words are too little to tell


def test_training_rows_are_drawn_one_by_one(spark):
    """Many rows of one id, or of none, all teach; the bound holds for them too."""
    some = [((None, 8)[k % 2], f"the word number {k} of them all", "en") for k in range(3000)] + [(k, "das ist ein satz", "de") for k in range(40)]
    df = spark.createDataFrame(some, "doc_id long, text string, lang string").repartition(4)
    langs, prototypes = langid.learn(df, train_docs=500)
    assert langs == ["de", "en"] and np.allclose(np.linalg.norm(prototypes, axis=1), 1, atol=1e-4)


def test_separator_scan(spark, docs, empty):
    library = tokens.library_of(tokens.tokenizer_path(), plain=True)
    want = sorted(((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in rows()), key=repr)
    assert by_id(tokens.count_tokens(docs), "doc_id", "n_tokens") == want
    starts = sorted((r.start, r.n_tokens) for r in tokens.count_tokens(docs).collect())
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:k]) for k in range(len(starts))]
    assert tokens.count_tokens(empty).count() == 0
    # documents cross many small blocks; a file may break off
    folder, _ = tokens.write_flat(docs.coalesce(1))
    whole = by_id(tokens.scan_separators(spark, folder), "ord", "start", "n_tokens", "complete")
    assert by_id(tokens.scan_separators(spark, folder, block=64), "ord", "start", "n_tokens", "complete") == whole
    path = folder.removeprefix("file://") + "/tokens-000000.bin"
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-2])
    broken = by_id(tokens.scan_separators(spark, folder, block=64), "ord", "start", "n_tokens", "complete")
    assert sum(not r[3] for r in broken) <= 1 and len(broken) == len(whole) - (whole[-1][2] == 1)


def fair_shares(sizes, weights=(5, 2, 1)):
    """Water-filling, one source after another."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    goal, left, open_ = {}, 1.5 * sum(sizes.values()), sum(weight.values())
    for s in sorted(order, key=lambda s: sizes[s] / weight[s]):
        goal[s] = min(2.0 * sizes[s], weight[s] * left / open_)
        left, open_ = left - goal[s], open_ - weight[s]
    return goal


def goals(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    return {r.source: r.target for r in mixing.targets(df, len(sizes)).collect()}


def test_mixing(spark, docs, empty, monkeypatch):
    out = mixing.mix(docs, range_rows=2).collect()
    assert len(out) == docs.count()
    size = collections.Counter()
    for _, t, _, s, *_ in rows():
        size[s] += len(words(t))
    goal = fair_shares(size)
    assert abs(sum(goal.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all(goal[s] <= 2 * size[s] for s in size)
    taken = collections.Counter()
    for r in out:
        assert r.source_size == size[r.source] and abs(r.target - goal[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 3 for s in size)  # repeated rows share the cut
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert by_id(mixing.mix(docs), "doc_id", "size", "taken") == by_id(mixing.mix(docs.repartition(7), range_rows=5), "doc_id", "size", "taken")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())
    assert all(r.n_chars == len(r.text) for r in mixed.collect())
    assert mixing.mix(empty).count() == mixing.mixed_documents(empty).count() == 0


def test_water_filling(spark):
    # weights: a 5, b 2, c 1, null 5; a, null and c stop at twice their size
    assert goals(spark, {"a": 10, "b": 1000, None: 10, "c": 0}) == {"a": 20.0, None: 20.0, "c": 0.0, "b": 1490.0}
    assert goals(spark, {}) == {}
    rng = random.Random(15)
    sizes = {f"s{k}": rng.randint(0, 10 ** rng.randint(0, 6)) for k in range(40)} | {None: 5}
    want = fair_shares(sizes)
    assert all(abs(x - want[s]) < 1e-6 * max(1, want[s]) for s, x in goals(spark, sizes).items())


def test_cut_among_many_equal_keys(spark):
    """All rows of a source without an id have one key: no digits divide them."""
    some = [(None, " ".join("w" * (k % 7 + 1))[: 2 * (k % 7) + 1], "a") for k in range(300)] + [(k, "x y z", "b") for k in range(4000)]
    docs = spark.createDataFrame(some, "doc_id long, text string, source string")
    out = mixing.mix(docs, range_rows=20).collect()
    taken = collections.Counter()
    for r in out:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    for s in ("a", "b"):
        target = next(r.target for r in out if r.source == s)
        assert abs(taken[s] - target) <= 50  # repeated rows at the cut share what is left there


def test_sequences(spark, docs, empty):
    library = tokens.library_of(tokens.tokenizer_path(), plain=False)
    got = tokens.encode_to_files(docs).collect()
    assert len(got) == docs.count()
    encoded = collections.defaultdict(list)
    for i, t, *_ in rows():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, tokens.END]
        encoded[i].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    found = collections.defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in encoded.items()}
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == [sum(x.n_tokens for x in order[:k]) for k in range(len(order))]
    ids = [r.doc_id for r in order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert tokens.encode_to_files(empty).count() == 0
    folder, table = tokens.write_sequences(docs, length=8, rows=3, part_bytes=20_000)
    files = sorted(tuple(r) for r in table.collect())
    assert len(files) == 3 and sum(f[1] for f in files) == docs.count()
    one = tokens.SequenceFile(folder, f"part-{files[0][0]:06d}.arrows")
    flat = np.concatenate([a for a, _ in one.flat()])
    assert len(flat) == files[0][2] and len(one) == -(-files[0][2] // 8)
    for k in (0, 4, len(one) - 1):
        s = one.sequence(k)
        assert len(s["ids"]) == 8 and s["ids"].to_numpy()[s["valid"].to_numpy(zero_copy_only=False)].tolist() == flat[8 * k : 8 * k + 8].tolist()


def test_files_are_even_and_ties_in_order(spark, monkeypatch):
    """A third of the rows without an id, a third with one id: files are even in bytes, and reruns agree."""
    monkeypatch.setattr(tokens, "RANGE_ROWS", 100)
    rng = random.Random(14)
    some = [((None, 7, k)[k % 3], sentence(rng, rng.randint(1, 60))) for k in range(900)] + [(7, "one and the same text")] * 300
    rng.shuffle(some)
    docs = spark.createDataFrame(some, "doc_id long, text string")
    total = sum(len(t.encode()) for _, t in some)
    folder, files = tokens.write_sequences(docs.repartition(4), part_bytes=total // 10)
    text = {}
    for part, n, _ in files.collect():
        with pa.ipc.open_stream(folder.removeprefix("file://") + f"/part-{part:06d}.ids") as f:
            assert f.read_all().num_rows == n
        text[part] = n
    assert len(text) == 10 or len(text) == 11
    runs = [sorted((r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_sequences(*tokens.write_sequences(docs.repartition(k), part_bytes=total // (3 * k))).collect()) for k in (2, 5)]
    assert runs[0] == runs[1]
    tokens_each = [r.ids for r in files.collect()]
    assert max(tokens_each) < 1.5 * sum(tokens_each) / len(tokens_each)


def test_piece_encoder_equals_the_library():
    encoder, rng = tokens.Encoder(tokens.tokenizer_path(), 2), random.Random(3)
    marks = ["a", "b", "é", "ñ", "日", " ", "  ", "\n", "\t", " ", ".", ",", "'s", "'", "1", "½", "<|endoftext|>", "!", "|", "\x1c", "the", "ß", "😀", "_", "́"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["", " ", None]
    want = [[*e.ids, 2] for e in encoder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for step in (1, 100, len(texts)):
        got = []
        for i in range(0, len(texts), step):
            ids, ends = encoder.encode(pa.array(texts[i : i + step], pa.string()))
            got += [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == want
    assert len(encoder.encode(pa.array([], pa.string()))[0]) == 0


def test_resharding(spark, docs, empty, tmp_path):
    out = resharding.reshard(docs).collect()
    assert len(out) == docs.count()
    shards = collections.defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
    assert set(shards) <= set(range(16))
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in shards.values())
    size = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in out} == size
    assert resharding.reshard(empty).count() == 0
    assigned = resharding.assign(docs)
    assert assigned.columns == [c for c in docs.columns if c != "shard"] + ["old_shard", "shard"]
    assert by_id(assigned, "doc_id", "shard") == by_id(resharding.reshard(docs), "doc_id", "shard")
    assert resharding.assign(empty).count() == 0


def shard_bytes(out, new=16):
    held = collections.Counter()
    for r in out:
        held[r.shard] += r.size
    return [held[j] for j in range(new)]


def test_resharding_balances_keeps_groups_and_moves_the_least(spark):
    rng = random.Random(12)
    texts = [sentence(rng, rng.randint(1, 60)) for _ in range(3000)] + ["a copied text of some words " * 4] * 200 + ["another one " * 9] * 90 + [None] * 40 + [""] * 30
    big = ["the text that a third of all rows hold, more than a shard has room for"] * 2500
    for some, parted in ((texts, 0), (texts + big, 1)):
        rng.shuffle(some)
        rows = [(rng.choice((None, 1, k)), t, k % 5) for k, t in enumerate(some)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, old int").repartition(3)
        sizes = [len((t or "").encode()) + 1 for t in some]
        out = resharding.reshard(docs).collect()
        held, largest = shard_bytes(out), max(sizes)
        assert sum(held) == sum(sizes) and max(held) - min(held) <= 4 * largest
        shards = collections.defaultdict(set)
        for r in out:
            shards[r.text_crc32, r.size].add(r.shard)
        del shards[0, 1]  # null and empty texts are two groups of these
        assert sum(len(x) > 1 for x in shards.values()) == parted
        old = collections.Counter()
        for r in out:
            old[r.old_shard] += r.size
        least = sum(max(0, n - (sum(sizes) / 16)) for n in old.values())
        assert sum(r.size for r in out if r.shard != r.old_shard) <= least + 12 * 16 * largest
        # a column as the old layout: equal texts lie in several shards; each group counts where most of it lies
        out = resharding.reshard(docs, F.col("old"), 5, 7).collect()
        held = shard_bytes(out, 7)
        assert len(out) == len(some) and max(held) - min(held) <= 4 * largest
        assert all(sorted(r.slot for r in out if r.shard == j) == list(range(sum(r.shard == j for r in out))) for j in range(7))
        shards = collections.defaultdict(set)
        for r in out:
            shards[r.text_crc32, r.size].add(r.shard)
        del shards[0, 1]
        assert sum(len(x) > 1 for x in shards.values()) == parted


def test_rewriting_shards(spark, docs, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/shards"
    key = F.coalesce(F.col("doc_id"), F.lit(3))
    docs.drop("shard").withColumn("shard", F.when(F.col("doc_id") == 7, None).otherwise(F.pmod(key, F.lit(4)))).write.partitionBy("shard").parquet(folder)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    before, files = by_id(docs, *names), {p: p.stat().st_mtime_ns for p in tmp_path.glob("shards/*/*.parquet")}
    size = sum(len((t or "").encode()) + 1 for _, t, *_ in rows())
    step, done = resharding.finish, []

    def breaks(*a):
        done.append(1)
        if len(done) > 1:
            raise RuntimeError("the driver is gone")
        step(*a)

    monkeypatch.setattr(resharding, "finish", breaks)
    with pytest.raises(RuntimeError):
        resharding.rewrite_affected(spark, folder, 6)
    monkeypatch.setattr(resharding, "finish", step)
    assert {p: p.stat().st_mtime_ns for p in tmp_path.glob("shards/*/*.parquet")} == files  # nothing is lost yet
    resharding.finish(spark, folder)
    again = spark.read.parquet(folder)
    assert by_id(again, *names) == before and {r.shard for r in again.select("shard").distinct().collect()} <= set(range(6))
    held = [r[1] for r in again.groupBy("shard").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).collect()]
    assert sum(held) == size
    assert resharding.rewrite_affected(spark, folder, 6)[1] <= size * 0.9  # a text of most bytes keeps shards from being equal
    assert by_id(spark.read.parquet(folder), *names) == before
    few = spark.createDataFrame([(k, f"text number {k}", k % 3) for k in range(300)], "doc_id long, text string, shard int")
    folder = f"file://{tmp_path}/even"
    few.write.partitionBy("shard").parquet(folder)
    untouched, moved = resharding.rewrite_affected(spark, folder, 3)
    assert moved <= 60  # as good as even already
    touched, moved = resharding.rewrite_affected(spark, folder, 4)
    assert 3 in touched and moved <= 1.1 * sum(len(f"text number {k}") + 1 for k in range(300)) / 4
    assert spark.read.parquet(folder).count() == 300


def test_min_cost_flow_is_least():
    rng = random.Random(2)
    for _ in range(30):
        n, m = rng.randint(1, 3), rng.randint(1, 4)
        supply = [rng.randint(0, 4) for _ in range(n)]
        capacity = [rng.randint(0, 5) for _ in range(m)]
        if sum(supply) > sum(capacity):
            with pytest.raises(ValueError):
                resharding.min_cost_flow(supply, capacity, [[0] * m] * n)
            continue
        cost = [[rng.randint(0, 3) for _ in range(m)] for _ in range(n)]
        flow = resharding.min_cost_flow(supply, capacity, cost)
        assert [sum(r) for r in flow] == supply and all(sum(f[j] for f in flow) <= capacity[j] for j in range(m))
        best = {tuple([0] * m): 0}
        for i in range(n):
            for _ in range(supply[i]):
                step = {}
                for used, c in best.items():
                    for j in range(m):
                        if used[j] < capacity[j]:
                            k = (*used[:j], used[j] + 1, *used[j + 1 :])
                            step[k] = min(step.get(k, 1 << 30), c + cost[i][j])
                best = step
        assert sum(flow[i][j] * cost[i][j] for i in range(n) for j in range(m)) == min(best.values())


def test_levels_and_transfers():
    rng = random.Random(4)
    for _ in range(300):
        used, more = [rng.randint(0, 30) for _ in range(rng.randint(1, 6))], rng.randint(0, 60)
        room = resharding.levelled(used, more)
        after = [u + r for u, r in zip(used, room, strict=True)]
        assert sum(room) == more and min(room) >= 0
        assert all(r == 0 or a <= min(after) + 1 for a, r in zip(after, room, strict=True))
    units = [(rng.randint(0, 4), rng.randint(1, 500)) for _ in range(60)]
    blocks = {i: rng.randint(0, 20_000) + 1 for i in range(5)}
    to, sent = resharding.transfers(units, blocks, 8)
    after, old = collections.Counter(), collections.Counter(blocks)
    for (i, n), j in zip(units, to, strict=True):
        after[j] += n
        old[i] += n
    for i, x in sent.items():
        assert sum(n for _, n in x) == blocks[i]
        for j, n in x:
            after[j] += n
    total = sum(old.values())
    assert max(after.values()) - min(after[j] for j in range(8)) <= 1
    moved = sum(n for (i, n), j in zip(units, to, strict=True) if i != j) + sum(n for i, x in sent.items() for j, n in x if i != j)
    assert moved <= sum(max(0, n - total / 8) for n in old.values()) + 500


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad -->
<div class="ad">Buy now.</div><header>Site</header><article><h1>A &amp; B</h1><p><b>First  line<br><p>One.</p><p>With <a href="/">a link</a> &lt;kept&gt;.</p><aside>See also</aside><form>Name <input></form>
<div class="comments"><p>Nice post, I liked the whole of it and will read it again.</p></div></article><footer>&copy; x</footer>"""


LINE = "The quick fox is in the garden of the house and it was seen by all of them with the others there."


def test_two_passes_equal_brute_force():
    rng = random.Random(6)
    for _ in range(3000):
        found, mixed = [], rng.random() < 0.7
        for _ in range(rng.randint(0, 12)):
            n = rng.choice((3, 30, 80, 200))
            text = (LINE if rng.random() < 0.6 else "Xyz " * 30)[:n].strip()
            found.append(extract.Block(text, rng.choice((0, 0, len(text))), rng.choice((0, 0, 0, 1, 2)), mixed and rng.random() < 0.5, rng.choice((0, 0, 0, 1, 2, 3))))
        labels, within = extract.classify(found)
        want = []
        for i, b in enumerate(found):
            if labels[i] != extract.OPEN:
                want.append(labels[i])
                continue
            if b.heading:
                rest = next((k for k in range(i + 1, len(found)) if labels[k] != extract.GOOD and 0 < found[k].heading <= b.heading), len(found))
                if extract.GOOD in labels[i + 1 : rest]:
                    want.append(extract.GOOD)
                    continue
            decided = sorted((abs(k - i), k > i, labels[k]) for k in range(len(found)) if labels[k] != extract.OPEN and within[k] == within[i])
            want.append(decided[0][2] if decided else int(within[i] or not any(within)))
        assert extract.settle(found, labels, within) == want


def test_open_and_odd_elements_lose_no_text():
    page = lambda body: f"<html><head><title>t</title></head><body><nav><a href=1>x</a></nav><article><h1>Title</h1>{body}<p>{LINE}</p></article><footer>f</footer></body></html>"
    whole, twice = f"Title\n{LINE}", f"Title\n{LINE}\n{LINE}"
    for body in ("<svg a=1/>", "<iframe src=x />", "<div><select><option>a</div>", "<div><object>oo</div>", "<div><textarea>oo</div>", '<a href="#">Next page</a>', "<ul><li><a href=1>one</a><li><a href=2>two</a></ul>"):
        assert extract.main_text(page(body)) == whole
    for mark in ('title="the hidden gem"', "title=it's", "class=related-work", "class=share", "class='menuitem-free'", "data-x='a>b'"):
        assert extract.main_text(page(f"<p {mark}>{LINE}</p>")) == twice
    for mark in ("hidden", "class=ad", "id='cookie-notice'", "class='x sideBar'", "style='display: none'", "role=navigation", "class=related-posts><a href=1>More</a> and x<b "):
        assert extract.main_text(page(f"<div {mark}>{LINE if 'related' not in mark else ''}</div>")) == whole
    assert extract.main_text(page(f"<p>{LINE} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> so</p>")) == f"Title\n{LINE} x=1 so\n{LINE}"
    assert extract.main_text(page("<video-player>kept</video-player>")) == f"Title\nkept\n{LINE}"
    assert extract.main_text(f"<html><head><title>t</title><p>{LINE}</p>") == LINE  # no end of the head
    teaser = f"<article><h2><a href=1>Teaser</a></h2></article><p>{LINE} 2</p><p>{LINE} 3</p><p>ok.</p>"
    assert extract.main_text(teaser).endswith(f"{LINE} 2\n{LINE} 3\nok.")
    assert extract.main_text(f"<div>{LINE}</div><article><p>{LINE} 1</p><p>{LINE} 2</p></article><div>{LINE}</div>") == f"{LINE} 1\n{LINE} 2"
    assert extract.main_text("a < b and 3 > 2 <3") == "a < b and 3 > 2 <3"


def test_long_odd_pages_take_linear_time():
    import time

    for part in ("<x ", '<x a="', '<x a=">" ', "<!-- ", "<div>", "</p>", "<a>", "<li><div>", "<p", "<script>", "<textarea>", "&amp", "<", "<section><li>", "='\"<p "):
        for page in ("<div>" * 5000 + part * (300_000 // len(part)), part * (300_000 // len(part)) + ">"):
            began = time.time()
            extract.main_text(page)
            assert time.time() - began < 3, part


def test_main_text(spark):
    assert extract.main_text(PAGE) == "A & B\nFirst line\nOne.\nWith a link <kept>."
    plain = f"<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>Contact us here</a></div><h2>Title</h2><p>{LINE}</p><p>Short.</p><p>{LINE}</p><ul><li><a href=4>one more link</a></li></ul><div>Login</div></body>"
    assert extract.main_text(plain) == f"Title\n{LINE}\nShort.\n{LINE}"
    pages = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "y"), (3, "w", "<article><p>" + "word " * 50_000, "z"), (4, "q", "<<a '<b \"<p>x", "z"), (5, "e", "<article></article>", "")]
    out = extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()
    assert len(out) == 7 and all(r.n_chars == len(r.text) for r in out)
    assert {r.page_id: r.text for r in out}[None] == "" and {r.page_id: r.n_chars for r in out}[3] == 249_999
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_decontamination(docs, items, empty, monkeypatch):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: pattern.findall((t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t, _ in items.collect():
        w = cut(t)
        for k in range(len(w) - min(13, len(w)) + 1) if w else ():
            windows[tuple(w[k : k + 13])].add(i)
    want = []
    for i, t, *_ in rows():
        w, hit, seen = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    seen |= windows[tuple(w[k : k + n])]
        want.append((i, len(w), len(hit), sorted(seen - {None}), bool(hit) and 20 * len(hit) >= len(w)))
    for sent in (1 << 20, 0):
        monkeypatch.setattr(decontaminate, "SENT_BYTES", sent)
        index = decontaminate.build_index(docs, segment_bytes=3000)
        found = decontaminate.matches(index, items)
        got = sorted(((r.doc_id, r.n_words, r.n, sorted(r["items"])) for r in found.withColumn("n", F.when(F.size("spans") > 0, decontaminate.covered(F.col("spans"))).otherwise(0)).collect()), key=repr)
        assert got == sorted((x[:4] for x in want), key=repr)
    out = decontaminate.contamination(docs, items)
    assert sorted(((r.doc_id, r.contaminated) for r in out.collect()), key=repr) == sorted(((x[0], x[4]) for x in want), key=repr)
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(not x[4] for x in want)
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).filter("contaminated").count() == 0
    near = decontaminate.proximity(decontaminate.build_index(docs), items.filter("item_id = 0"), width=14, least=13)
    assert [tuple(r) for r in near.collect()] == [(88, 0)]
    texts = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    named = decontaminate.contamination(texts, items.withColumn("item_id", F.concat(F.lit("i"), "item_id")))
    ids = lambda x: (None if x[0] is None else f"d{x[0]}", x[1], x[2], [f"i{k}" for k in x[3]], x[4])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in named.collect()), key=repr) == sorted(map(ids, want), key=repr)


def test_long_items_in_pieces_and_proximity(spark, monkeypatch):
    rng = random.Random(21)
    monkeypatch.setattr(decontaminate.pieces_of, "__defaults__", (13, 7))
    item = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(150)]
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    for k in range(0, 130, 9):
        texts.append(f"x {' '.join(item[k : k + 10 + k % 11])} y {' '.join(item[k + 3 : k + 17])}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(0, " ".join(item)), (1, "aa bb cc x y")], "item_id long, text string")
    windows = {tuple(item[k : k + 13]) for k in range(138)} | {("aa", "bb", "cc", "x", "y")}
    want = {}
    for i, t in enumerate(texts):
        w = t.split()
        want[i] = len({k + j for x in windows for k in range(len(w) - len(x) + 1) if tuple(w[k : k + len(x)]) == x for j in range(len(x))})
    assert {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, items).collect()} == want and sum(map(bool, want.values())) > 5
    monkeypatch.undo()
    index = decontaminate.build_index(docs, 400)
    for width, least in ((5, 4), (8, 5), (3, 3)):
        near = set()
        for n, words in ((0, set(item)), (1, set("aa bb cc x y".split()))):
            near |= {(i, n) for i, t in enumerate(texts) for w in [t.split()] if any(len(words & set(w[k : k + width])) >= least for k in range(len(w)))}
        assert {tuple(r) for r in decontaminate.proximity(index, items, width, least).collect()} == near


def test_passages_end_with_their_document(spark):
    b = [f"b{i}" for i in range(15)]
    texts = ["x y", " ".join(b[1:]), "x y", "q " + " ".join(b[:14]), "x y", " ".join(b[1:13]), "x y"]  # of items 0, 1; 12 words are no window
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    passage = [*b[:14], "absent"]
    items = spark.createDataFrame([(0, " ".join(["missing", *b[1:]])), (1, " ".join(passage))], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {0: (0, []), 1: (14, [0, 1]), 2: (0, []), 3: (14, [0, 1]), 4: (0, []), 5: (0, []), 6: (0, [])}


def test_quality_ledger(docs, empty):
    book = quality.ledger(docs, ["doc_id", "text"]).collect()
    assert len(book) == docs.count()
    for r in book:
        w = words(r.text)
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        spots = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(spots))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert bool(r.failed & quality.BASE) == (len(w) < 10 or 100 * len(spots) > 20 * len(w))
    assert quality.ledger(empty, ["doc_id"]).count() == 0
    led = quality.ledger(docs, ["doc_id"])
    table = {r.rule: (r.failing, r.only_this) for r in quality.ablation(led).collect()}
    mask = quality.POLICIES[quality.CURRENT]
    for b, name, _ in quality.rules():
        assert table[name] == (sum(bool(r.failed >> b & 1) for r in book), sum(r.failed & mask == 1 << b for r in book))
    assert quality.apply_policy(led, "base-1").filter("kept").count() == sum(not r.failed & quality.BASE for r in book)


def brute_fingerprint(text):
    import xxhash

    w = lowered(text)
    if not w:
        return 0
    parts = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def closure(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                root[find(b)] = find(a) if find(a) < find(b) else root[find(b)]
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash(docs, empty):
    want = [(i, brute_fingerprint(t)) for i, t, *_ in rows()]
    roots = closure(sorted({f for _, f in want}), lambda a, b: (a ^ b).bit_count() <= 2)
    low = {}
    for i, f in want:
        if i is not None:
            low[roots[f]] = min(i, low.get(roots[f], i))
    got = by_id(simhash.near_duplicates(docs).withColumn("x", simhash.hex64(F.col("fp"))), "doc_id", "x", "component_id")
    assert got == sorted(((i, f"{f:016x}", low.get(roots[f])) for i, f in want), key=repr)
    one = simhash.deduplicate(docs)
    assert one.columns == docs.columns
    assert one.count() == len(set(roots.values()))
    assert {r.doc_id for r in one.collect() if r.doc_id is not None} == set(low.values())
    assert simhash.near_duplicates(empty).count() == simhash.deduplicate(empty).count() == 0


def test_links_of_crowded_blocks(spark):
    """Blocks far above the limit are divided and lose no link; what is linked is what brute force links."""
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(150)}
    fps |= {rng.getrandbits(64) for _ in range(50)}
    roots = closure(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(sign(f),) for f in fps], "fp long")
    for hot in (4, 4096):
        found = {r.u: r.root for r in simhash.components(simhash.links(df, hot=hot)).collect()}
        parts = collections.defaultdict(set)
        for f in fps:
            parts[found.get(sign(f), sign(f))].add(f)
        want = collections.defaultdict(set)
        for f, r in roots.items():
            want[r].add(f)
        assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))


def test_bit_sliced_equals_counting():
    rng = np.random.default_rng(1)
    for radius in (0, 1, 2):
        members = np.unique(rng.integers(0, 1 << 10, 200).astype(np.uint64))
        got = simhash.bit_sliced_links(members, radius)
        roots = closure(list(range(len(members))), lambda a, b: int(members[a] ^ members[b]).bit_count() <= radius)
        assert dict(got) == {k: r for k, r in roots.items() if k != r}


def test_language_model(docs, empty, monkeypatch):
    monkeypatch.setattr(lm, "LEAST", 0)
    held = lambda i: remainder(i, 10) == 0
    count = collections.Counter(w for i, t, *_ in rows() if not held(i) for w in [*lowered(t), None])
    n, v = sum(count.values()), len(count)
    p = lambda w: math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1)))
    want = sorted(((i, held(i), len(lowered(t)) + 1, sum(count[w] > 0 for w in [*lowered(t), None]), n, round(sum(map(p, [*lowered(t), None])), 6)) for i, t, *_ in rows()), key=repr)
    for heavy in (0, 10, 100_000):
        monkeypatch.setattr(lm.heavy_words, "__defaults__", (heavy,))
        out = lm.scores(docs).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=repr) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in out)
        by_text = collections.defaultdict(list)
        for r, (_, t, *_) in zip(sorted(out, key=lambda r: repr((r.doc_id, r.n_tokens, round(r.base_score, 6)))), sorted(rows(), key=lambda r: repr((r[0], len(lowered(r[1])) + 1, round(sum(map(p, [*lowered(r[1]), None])), 6)))), strict=True):
            by_text[t].append(r.score)
        assert all(max(x) - min(x) < 1e-3 for x in by_text.values())  # ties
    assert lm.scores(empty).count() == 0
    unseen = docs.filter("doc_id = 60 or doc_id = 3").withColumn("doc_id", F.lit(10).cast("long"))
    assert remainder(10, 10) != 0 or lm.scores(unseen).count() == 2


def test_frequent_words_by_exact_counts(spark):
    counts = [(f"w{k}".encode(), c) for k, c in enumerate([1, 2, 2, 5000, 5001, 1 << 20, 1 << 21, (1 << 40) + 1, 1 << 40, 1 << 41, 3])]
    df = spark.createDataFrame(counts, "word binary, c long")
    for most in (0, 1, 3, 4, 5, 7, 8, 11):
        got = lm.heavy_words(df, most)
        assert len(got) <= most and all(dict(counts)[w] == c for w, c in got.items())
        assert min(got.values(), default=1 << 62) > max((c for w, c in counts if w not in got), default=0)
    assert len(lm.heavy_words(df, 11)) == 11 and len(lm.heavy_words(df, 5)) == 5
    assert lm.heavy_words(df.limit(0)) == {}


def test_model_learns_from_all_documents(spark, monkeypatch):
    rng = random.Random(3)
    texts = [sentence(rng, rng.randint(1, 80)) for _ in range(200)] + ["", None, "zebra " * 300]
    symbols, path = {}, lm.vocabulary_path()
    code = lm.word_encoder(path)
    training = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).withColumn("held_out", F.lit(False))
    counts = lm.word_counts(training)
    ids = lm.id_counts(counts, path)
    for least, times in ((0, 1), (2000, None)):
        monkeypatch.setattr(lm, "LEAST", least)
        want = lm.train([t and t.encode() for t in texts], path)
        model = lm.Model(ids, len(texts))
        coded = lm.encoded(training, model, {}, len(texts), 1.0, path).cache()
        lm.learn(coded.select("doc"), model)
        # equal counts may be ordered either way only where they are equal: the order of ids decides, so all tables agree
        assert np.array_equal(model.symbol, want.symbol) and np.allclose(model.extra, want.extra) and np.allclose(model.unigram, want.unigram)
        assert np.allclose(model.b1, want.b1, atol=1e-5) and np.allclose(model.b2, want.b2, atol=1e-5)
        symbols = [sum(map(len, code(lm.words_of((t or "").encode())))) // 2 + 1 for t in texts]
        times = times or -(-2000 * lm.STRIDE // sum(symbols))
        assert sum(model.seen) == times * sum(-(-n // lm.STRIDE) for n in symbols)  # every window, in one round
        assert all(np.isfinite(getattr(model, n)).all() for n in lm.WEIGHTS)


def naive_score(model, s):
    """Symbol by symbol, with loops and a softmax over all symbols."""
    total, every = 0.0, np.concatenate(([0], s)).astype(int)
    for k in range(len(s)):
        first = max(0, k // lm.STRIDE * lm.STRIDE + lm.STRIDE - lm.WIDTH)  # the window that scores s[k]
        keys = every[first : k + 1]
        a = [model.q[every[k]].astype(float) @ model.k[x] / math.sqrt(lm.DIM) + model.r[k - first - j] for j, x in enumerate(keys)]
        p = np.exp(a) / np.exp(a).sum()
        h = sum(w * model.v[x].astype(float) for w, x in zip(p, keys, strict=True))
        l1 = h @ model.u1 + model.b1[every[k]]
        l2 = np.einsum("cmd,d->cm", model.u2, h) + model.b2[every[k]]
        logp = (l1 - np.log(np.exp(l1).sum()))[:, None] + l2 - np.log(np.exp(l2).sum(axis=1, keepdims=True))
        total += logp.reshape(-1)[s[k]]
    return total


def small_model(seed=4):
    rng = np.random.default_rng(seed)
    model = lm.Model(rng.integers(0, 50, lm.IDS), 9)
    model.bigrams(rng.integers(0, 3, (lm.SYMBOLS, lm.SYMBOLS)))
    model.start()
    model.u1, model.u2 = (rng.standard_normal(x.shape).astype(np.float32) for x in (model.u1, model.u2))
    return model, [rng.integers(0, lm.SYMBOLS, n).astype(np.int32) for n in (1, 2, 15, 16, 17, 32, 33, 75)]


def test_scores_equal_naive_attention():
    model, docs = small_model()
    assert np.allclose(model.score(docs), [naive_score(model, s) for s in docs], rtol=1e-4)
    assert np.allclose(model.score(docs, chunk=2), model.score(docs), rtol=1e-5)


def test_gradient_equals_differences():
    model, docs = small_model()
    xs, ys, _ = model.windows(docs)
    adam, ys = lm.Adam(model), ys.reshape(-1)
    for n in ("q", "k", "v", "u1", "u2"):
        setattr(model, n, getattr(model, n).astype(np.float64))
    grad, loss = adam.gradient(xs, ys)
    assert abs(loss + model.score(docs).sum() / sum(map(len, docs))) < 1e-5
    rng = np.random.default_rng(8)
    for n in lm.WEIGHTS:
        flat = getattr(model, n)
        for at in rng.permutation(np.argwhere(np.abs(grad[n]) > np.abs(grad[n]).max() / 10))[:4]:
            at = tuple(at)
            old, step = flat[at], 1e-2
            flat[at] = old + step
            up = adam.gradient(xs, ys)[1]
            flat[at] = old - step
            down = adam.gradient(xs, ys)[1]
            flat[at] = old
            assert abs((up - down) / (2 * step) - grad[n][at]) <= 0.03 * abs(grad[n][at]) + 1e-5


def test_words_are_encoded_together(monkeypatch):
    import public_tokenizers
    import tiktoken

    calls, path = [], lm.vocabulary_path()
    plain = tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, text: calls.append(text) or plain(self, text))
    encode = lm.word_encoder(path)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    alone = tiktoken.Encoding("alone", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    for letters in ("abcé'’s12٣.,#<|>字ñ", "abé's1.\xa0\u2003\u3000\x85\x1c"):
        for _ in range(60):
            words = ["".join(rng.choices(letters, k=rng.randint(1, 8))).encode() for _ in range(rng.randint(0, 30))] + [b"\xff\xfea"]
            assert encode(words) == [np.array(plain(alone, " " + w.decode("utf-8", "replace")), np.uint16).tobytes() for w in words]
    calls.clear()
    kept = {b"the": b"xy"}
    ids, sizes = lm.coded_words([b"the", b"of", b"zebra", b"of"], encode, kept)
    assert len(calls) == 1 and ids[:1].tobytes() == b"xy" and len(ids) == sizes.sum() and sizes[1] == sizes[3] and set(kept) == {b"the", b"of", b"zebra"}


def test_rare_words_are_not_sorted(spark, capsys):
    counts = spark.createDataFrame([(b"zebra", 3), (b"yak", 1)], "word binary, c long")
    coded = spark.createDataFrame([(1, [(b"zebra", 2), (b"gnu", 1)]), (2, [(b"gnu", 4)]), (3, [])], "rid long, rare array<struct<word:binary,n:int>>")
    got = lm.rare_sums(coded, counts, 10.0)
    p = lambda c: math.log10((c + 0.1) / 10)
    want = {1: (2, 2 * p(3) + p(0)), 2: (0, 4 * p(0))}
    assert {r.rid: (r.more, round(r.plus, 9)) for r in got.collect()} == {k: (n, round(x, 9)) for k, (n, x) in want.items()}
    got.explain()
    plan = capsys.readouterr().out
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_flat_ids_equal_those_of_words():
    path = lm.vocabulary_path()
    for words in ([], [b"the"], [b"the", b"a\xa0b".decode("latin-1").encode(), b"zebra", b"\xff\xfea", b"of"]):
        ids, sizes = lm.flat_encoder(path)(words)
        assert len(sizes) == len(words) and lm.split(ids, sizes) == lm.word_encoder(path)(words)


def test_heads_go_through_whole_classes(monkeypatch):
    model, docs = small_model()
    xs, ys, _ = model.windows(docs)
    y, want = ys.reshape(-1), None
    for most in (1, 40, 100_000):
        monkeypatch.setattr(lm, "ROWS", most)
        h = model.attend(xs, model.tables())[-1].reshape(-1, lm.DIM + 1)
        order, _, own, stretches = model.heads(h, xs, y, model.direct(), model.maps())
        end, classes = 0, []
        for s, e, some, c, member, l1, l2 in stretches:
            assert s == end and e > s and l1.shape == l2.shape == (e - s, 32)
            assert (c * lm.MEMBERS + member == y[order[s:e]]).all() and all((c[a:b] == j).all() for j, a, b in some) and sum(b - a for _, a, b in some) == e - s
            end, classes = e, classes + [j for j, *_ in some]
        assert end == len(own) == (y >= 0).sum() and classes == sorted(set(classes)) and (y[order[end:]] < 0).all()
        grad, loss = lm.Adam(model).gradient(xs, y)
        want = want or (grad, loss)
        assert abs(loss - want[1]) < 1e-5 and all(np.allclose(grad[n], want[0][n], atol=1e-5) for n in lm.WEIGHTS)


def test_windows_are_views_that_equal_slices():
    model, docs = small_model()
    xs, ys, first, doc = model.laid(docs)
    assert not xs.flags.owndata and len(first) == sum(-(-len(d) // lm.STRIDE) for d in docs)
    for at, d in zip(first, doc, strict=True):
        k = (at - first[doc == d][0]) // lm.STRIDE * lm.STRIDE
        before = [lm.PAD] * (lm.WIDTH - lm.STRIDE) + [lm.END_SYMBOL, *docs[d][:-1]] + [lm.PAD] * lm.STRIDE
        assert xs[at].tolist() == before[k : k + lm.WIDTH] and ys[at].tolist() == [*docs[d], *[-1] * lm.STRIDE][k : k + lm.STRIDE]


def test_every_symbol_sees_sixteen_before_it():
    model = lm.Model.__new__(lm.Model)
    xs, ys, _ = model.windows([np.arange(1, 101, dtype=np.int32)])
    for x, y in zip(xs, ys, strict=True):
        for k in np.flatnonzero(y >= 0):
            seen = x[: lm.WIDTH - lm.STRIDE + k + 1]
            assert (seen != lm.PAD).sum() >= min(17, y[k])


def test_model_is_causal_normalised_and_learns():
    rng = random.Random(0)
    texts = [sentence(rng, 80).encode() for _ in range(60)]
    model = lm.train(texts, lm.vocabulary_path())
    symbols = [np.append(model.symbol[np.frombuffer(b"".join(lm.word_encoder(lm.vocabulary_path())(lm.words_of(t))), np.uint16)], 0).astype(np.int32) for t in texts]
    total = model.score(symbols)
    assert np.allclose(total, [model.score([s])[0] for s in symbols], atol=1e-3)  # batches don't matter
    # step by step: each prefix adds one symbol's log probability, and the later symbols change nothing before
    s = symbols[0][:70]
    parts = [model.score([s[:k]])[0] for k in range(1, 71)]
    assert all(a > b for a, b in zip(parts, parts[1:], strict=False))
    other = np.append(s[:40], 5).astype(np.int32)
    assert abs(model.score([other[:40]])[0] - parts[39]) < 1e-4
    # the distribution after a prefix sums to one
    every = [np.append(s[:37], k).astype(np.int32) for k in range(lm.SYMBOLS)]
    mass = np.exp(model.score(every) - parts[36]).sum()
    assert abs(mass - 1) < 1e-3
    share = np.exp(model.extra)[: lm.END_ID]
    assert np.allclose(np.bincount(model.symbol[: lm.END_ID], weights=share, minlength=lm.SYMBOLS)[1:], 1, atol=1e-2)
    untrained = lm.Model.__new__(lm.Model)
    untrained.__dict__.update(model.__dict__)
    untrained.u1, untrained.u2 = model.u1 * 0, model.u2 * 0
    assert total.sum() > untrained.score(symbols).sum()

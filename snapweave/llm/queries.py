"""The registered queries over the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extract, langid, lm, mixing, quality, resharding, simhash, tokens
from .common import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_to_files(table(spark, sf_dir, "documents"))


def op5_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resharding.reshard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op6_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), "contaminated")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents"), ["doc_id"]))
    base = ~quality.passes(quality.BASE)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed", "policy")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_langid, op2_token_counts, op3_mixing, op4_sequences, op5_resharding, op6_extract, op7_decontaminate, op8_quality, op9_simhash, op10_lm)}

OP3_SQL = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
                  md5(coalesce(cast(doc_id as varchar), '')) as key from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select source, source_size, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from s),
r as (select *, sum(source_size) over () as total, 2.0 * source_size / weight as stop from w),
o as (select *, coalesce(sum(2 * source_size) over before, 0) as capped, sum(weight) over () - coalesce(sum(weight) over before, 0) as open_weight
      from r window before as (order by stop, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select arg_min(rate, k) as rate from (select (cast(1.5 * total as double) - cast(capped as double)) / cast(open_weight as double) as rate, stop,
             row_number() over (order by stop, source nulls last) as k from o) where rate <= stop),
t as (select source, source_size, least(cast(2 * source_size as double), weight * coalesce(rate, 0)) as target from r cross join l),
p as (select *, cast(floor(target + 0.5) as bigint) as budget from t),
e as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from p),
b as (select d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size as rest,
             coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id nulls first, d.size rows between unbounded preceding and 1 preceding), 0) as before
      from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, rest - before)) as bigint) as taken from b
"""

OP8_SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
i as (select rid, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5),
g as (select rid, i, count(*) over (partition by rid, array_to_string(w[i:i + 4], ' ')) as n from i),
r as (select rid, count(distinct i + k) as n_repeat_words from g, range(0, 5) as o(k) where n > 1 group by rid),
j as (select rid, doc_id, len(w) as n_words, array_to_string(w, '') as j, len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
      from w left join r using (rid)),
m as (select doc_id, cast(n_words as bigint) as n_words, cast(length(j) as bigint) as word_chars, cast(length(j) - length(regexp_replace(j, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, n_lines, length(j) - length(replace(j, '!', '')) as n_exclaim,
             length(regexp_replace(j, '\P{Lu}', '', 'g')) as n_upper from j),
f as (select *, cast((n_words < 10)::int + 2 * (100 * n_repeat_words > 20 * n_words)::int + 4 * (10 * n_symbols > n_words)::int + 8 * (100 * n_dup_lines > 30 * n_lines)::int
             + 16 * (2 * n_upper > word_chars)::int + 32 * (2 * n_exclaim > n_words)::int + 64 * (word_chars > 20 * n_words)::int + 128 * (word_chars < 2 * n_words)::int as bigint) as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 as base_failed, failed = 0 as kept, failed, 'strict-2' as policy from f
"""

OP7_SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
a as (select distinct item_id, l, array_to_string(w[k:k + l - 1], ' ') as g from (select item_id, w, least(13, len(w)) as l, unnest(range(1, len(w) - least(13, len(w)) + 2)) as k from i where len(w) > 0)),
b as (select rid, l, k, array_to_string(w[k:k + l - 1], ' ') as g from (select rid, w, l, unnest(range(1, len(w) - l + 2)) as k from d cross join (select distinct l from a) where len(w) >= l)),
h as (select rid, k, l, item_id from b join a using (l, g)),
c as (select rid, count(distinct k + o) as n_hit from h, range(0, 13) as r(o) where o < l group by rid),
s as (select rid, list_sort(list(distinct cast(item_id as varchar)) filter (item_id is not null)) as ids from h group by rid),
f as (select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(len(ids), 0) as bigint) as n_items, sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256
      from d left join c using (rid) left join s using (rid))
select *, n_hit > 0 and 20 * n_hit >= n_words as contaminated from f
"""

ORACLES = {"op3_mixing": OP3_SQL, "op7_decontaminate": OP7_SQL, "op8_quality": OP8_SQL}

"""Quality rules as a bitmask ledger: every rule is evaluated once, its failure is a bit; policies and ablations are bit arithmetic.

Only DataFrame functions run here. A null or empty text has no words: every measure is 0 and the rule ``few_words`` fails.
Ties do not occur (every row is judged on its own), repeated rows are judged alike, an empty table gives an empty ledger,
and the ledger keeps only the columns it is asked to carry, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, word_array

GRAM = 5


def _n(x: str) -> Column:
    return F.col(x)


def rules() -> list[tuple[int, str, Column]]:
    """Bit, name and failure condition over the measurements, all in integers."""
    n = _n("n_words")
    return [
        (0, "few_words", n < 10),
        (1, "repeated_grams", 100 * _n("n_repeat_words") > 20 * n),
        (2, "symbols", 10 * _n("n_symbols") > n),
        (3, "repeated_lines", 100 * _n("n_dup_lines") > 30 * _n("n_lines")),
        (4, "upper_case", 2 * _n("n_upper") > _n("word_chars")),
        (5, "exclamation", 2 * _n("n_exclaim") > n),
        (6, "long_words", _n("word_chars") > 20 * n),
        (7, "short_words", _n("word_chars") < 2 * n),
    ]


BASE = 0b11
#: Versioned policies: the bits whose failure rejects a document.
POLICIES = {"base-1": BASE, "strict-1": 0b111111, "strict-2": 0b11111111}
CURRENT = "strict-2"


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and the measurements of each text. The stages are separate projections, so that each array is built once."""
    # always true, but not to the optimizer: a filter on the ledger would else be moved below these projections, and the arrays
    # inside its lambdas be built anew for each element
    fixed = F.monotonically_increasing_id() >= 0
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = docs.select(*keep, text.alias("_t"), word_array(F.col("text")).alias("_w"))
    n = F.size("_w")
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    grams = F.when(n >= GRAM, F.transform(F.slice("_w", 1, n - (GRAM - 1)), lambda _, i: F.xxhash64(F.slice("_w", i + 1, GRAM))))
    parts = tokens.select(*keep, n.cast("long").alias("n_words"), F.array_join("_w", "").alias("_j"), lines.alias("_l"), F.when(fixed, grams).alias("_g"))
    size = lambda c: F.char_length(c).cast("long")
    counted = parts.select(
        *keep,
        "n_words",
        size("_j").alias("word_chars"),
        (size("_j") - size(F.regexp_replace("_j", r"[#*$%&|<>]+", ""))).alias("n_symbols"),
        (size("_j") - size(F.replace("_j", F.lit("!")))).alias("n_exclaim"),
        size(F.regexp_replace("_j", r"\P{Lu}+", "")).alias("n_upper"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(fixed & (F.size(F.array_distinct("_g")) < F.size("_g")), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).alias("_s"),
    )
    equal = lambda x, i, d: x["h"] == F.get("_s", i + d)["h"]
    held = [c for c in counted.columns if c != "_s"]
    spots = F.sort_array(F.transform(F.filter("_s", lambda x, i: equal(x, i, -1) | equal(x, i, 1)), lambda x: x["p"]))
    placed = counted.select(*held, F.when(fixed, spots).alias("_p"))
    cover = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(GRAM), F.coalesce(F.get("_p", i + 1) - p, F.lit(GRAM)))), F.lit(0), lambda a, x: a + x)
    return placed.select(*held, F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, the measurements, and ``failed``: bit b is set where rule b fails."""
    m = measure(docs, keep)
    bits = F.lit(0).cast("long")
    for b, _, bad in rules():
        bits = bits.bitwiseOR(F.when(bad, F.lit(1 << b)).otherwise(F.lit(0)).cast("long"))
    return m.withColumn("failed", bits)


def passes(mask: int) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == 0


def apply_policy(book: DataFrame, version: str = CURRENT) -> DataFrame:
    return book.withColumn("policy", F.lit(version)).withColumn("kept", passes(POLICIES[version]))


def ablation(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects (dropping the rule would keep them).

    The ledger is first counted by its distinct bit patterns (at most 2 to the number of rules), so the texts are not read again.
    """
    mask = POLICIES[version]
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rows = F.explode(F.array(*(F.struct(F.lit(b).alias("bit"), F.lit(name).alias("rule")) for b, name, _ in rules() if mask >> b & 1))).alias("r")
    one = F.expr("shiftleft(1L, bit)")
    return (
        patterns.select("bits", "n", rows)
        .select("bits", "n", "r.bit", "r.rule")
        .groupBy("bit", "rule")
        .agg(F.sum(F.when(F.col("bits").bitwiseAND(one) != 0, F.col("n")).otherwise(0)).alias("failing"), F.sum(F.when(F.col("bits") == one, F.col("n")).otherwise(0)).alias("only_this"))
    )

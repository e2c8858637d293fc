"""Quality rules: every rule is evaluated once into a ledger, policies are applied to the ledger.

A ledger row has the measurements of a text and one bit per failed rule. A policy is a version
and a mask of rules that reject; changing it needs no text. Ablations come from counts per bit
pattern: what a rule rejects alone, and what would be kept without it. Column expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorstep.llm.store import packed

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"


def bind(value: Column, body) -> Column:
    """`body` of `value`, which is worked out once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPLIT, -1), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that are found at least twice, first ones included.

    Windows are compared by a 64-bit hash. Sorted by hash, equal windows are neighbours; their
    places, sorted again, cover three words each less what the next one covers.
    """
    def places(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )
        def twins(s: Column) -> Column:
            n = F.size(s)
            pairs = F.zip_with(
                F.slice(s, 1, n - 1), F.slice(s, 2, n - 1),
                lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
            )
            return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

        return F.when(F.size(windows) < 2, F.array().cast("array<int>")).otherwise(
            bind(F.sort_array(windows), twins)
        )

    def covered(p: Column) -> Column:
        n = F.size(p)
        return F.when(n == 0, F.lit(0)).otherwise(F.lit(3) + F.aggregate(
            F.zip_with(F.slice(p, 1, n - 1), F.slice(p, 2, n - 1), lambda a, b: F.least(b - a, F.lit(3))),
            F.lit(0), lambda s, x: s + x,
        ))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bind(bind(words, places), covered))


@dataclass(frozen=True)
class Rule:
    """A named test that is true where a text fails; `bit` is its place in the ledger for good."""

    bit: int
    name: str
    fails: str


#: Rules over the measurements, as SQL conditions.
RULES = (
    Rule(0, "few words", "n_words < 50"),
    Rule(1, "repeated windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "20 * n_symbols > n_words"),
    Rule(3, "repeated lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "capitals", "10 * n_capitals > 3 * word_chars"),
    Rule(5, "marks of stress", "10 * n_stress > n_words"),
    Rule(6, "word length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule(7, "digits", "10 * n_digits > 2 * word_chars"),
)
BASE = 0b11


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject in it."""

    version: str
    mask: int


POLICIES = (
    Policy("base", BASE),
    Policy("2", 0b111111),
    Policy("3", 0b11111111),
)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` plus the measurements; a null text counts as none.

    Columns of the input that have a measurement's name are replaced, all others pass unchanged.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.trim(x, F.lit(SPACE)) != "")
    rows = packed(docs, body=body, words=words_of(body), lines=lines)
    values = {
        "n_words": F.size("words"),
        "word_chars": F.char_length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("body", F.lit("[" + SYMBOLS + "]")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words(F.col("words")),
        "n_capitals": F.regexp_count("body", F.lit("[A-Z]")),
        "n_stress": F.regexp_count("body", F.lit("!!|[?][?]")),
        "n_digits": F.regexp_count("body", F.lit("[0-9]")),
    }
    return rows.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in values],
        *[v.cast("bigint").alias(n) for n, v in values.items()],
    )


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """`docs` with measurements and `failed`, one bit per failed rule."""
    bits = F.lit(0).cast("bigint")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint"))
    return measured(docs, text).withColumn("failed", bits)


def rejected_by(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) != 0


def ablations(rows: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per policy and rule: texts failing it, rejected by it alone, kept with and without it.

    Texts are first counted per bit pattern, at most 2 ** rules rows however many texts.
    """
    patterns = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    grid = F.array(*[
        F.struct(F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"),
                 F.lit(p.mask).cast("bigint").alias("mask"), F.lit(1 << r.bit).cast("bigint").alias("bit"))
        for p in policies for r in rules if p.mask >> r.bit & 1
    ])
    spread = patterns.select("failed", "n", F.explode(grid).alias("g")).select("failed", "n", "g.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))

    return spread.groupBy("version", "rule").agg(
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("failing"),
        total(hit == F.col("bit")).alias("only_this"),
        total(hit == 0).alias("kept"),
        total(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
    )

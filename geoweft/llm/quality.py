"""Quality rules as a ledger of failure bits.

``ledger`` reads each text once, measures it and evaluates every rule once; a
rule's failure is a bit of ``fail_bits``. Policies are versioned sets of rules,
so applying one, comparing two or leaving a rule out is integer arithmetic on
the ledger and never touches the texts again.

Nulls: a null text measures as an empty one (no words) and fails ``few_words``.
Repeated rows are measured each for itself; an empty table gives an empty
ledger; further columns of the input are ignored (``ledger``) or kept
(``keep_documents``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import BATCH_ROWS, map_columns

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_upper", "n_lower", "n_bangs",
)


@dataclass(frozen=True)
class Rule:
    """``fails`` takes a mapping of measures (integers, arrays or columns)."""

    bit: int
    name: str
    fails: Callable


RULES = (
    Rule(0, "few_words", lambda m: m["n_words"] < 50),
    Rule(1, "repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule(2, "symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule(3, "repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule(4, "shouting", lambda m: m["n_upper"] > m["n_lower"]),
    Rule(5, "exclaiming", lambda m: 10 * m["n_bangs"] > 3 * m["n_words"]),
    Rule(6, "few_letters", lambda m: 2 * m["n_letters"] < m["word_chars"]),
    Rule(7, "short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule(8, "long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
    Rule(9, "many_words", lambda m: m["n_words"] > 1_000_000),
)
BITS = {r.name: 1 << r.bit for r in RULES}


def mask_of(*names: str) -> int:
    return sum(BITS[n] for n in set(names))


#: Policies by name and version: the rules whose failure rejects a text. Versions are never edited.
POLICIES = {
    ("base", 1): mask_of("few_words", "repeated_words"),
    ("prose", 1): mask_of("few_words", "repeated_words", "symbols", "repeated_lines", "shouting", "exclaiming"),
    ("prose", 2): mask_of(
        "few_words", "repeated_words", "symbols", "repeated_lines", "shouting", "exclaiming", "few_letters", "short_words", "long_words"
    ),
}
CURRENT = ("prose", 2)

_SPACE = re.compile(r"[\x20\x09-\x0D]")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 2_000_000:  # the products would leave 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, count = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = count[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at exactly [\x20\x09-\x0D]
    lines = [x for x in text.split("\n") if _SPACE.sub("", x)]
    return (
        len(words),
        len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))),
        sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(str.isalpha, text)),
        len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz")),
        raw.count(b"!"),
    )


def _measure_all(batch: dict[str, list]) -> dict[str, list]:
    rows = list(zip(*map(measure, batch["text"])))
    out = dict(zip(MEASURES, rows))
    m = {k: np.array(v, np.int64) for k, v in out.items()}
    bits = np.zeros(len(batch["text"]), np.int64)
    for r in RULES:
        bits |= r.fails(m).astype(np.int64) << r.bit
    return {**batch, **out, "fail_bits": bits}


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, and fail_bits: the bit of each rule that the text fails."""
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", fail_bits long"
    return map_columns(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _measure_all, schema)


def verdicts(rows: DataFrame, policy: tuple[str, int] = CURRENT) -> DataFrame:
    """Adds base_failed, kept under the policy, and sole_bits: the failure that alone rejects the text (0 if none does)."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long"))
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base", 1]).cast("long")) != 0
    return rows.withColumns(
        {
            "policy": F.lit(f"{policy[0]}/{policy[1]}"),
            "base_failed": base,
            "kept": (failed == 0) & ~base,
            "sole_bits": F.when(F.bit_count(failed) == 1, failed).otherwise(F.lit(0).cast("long")),
        }
    )


def ablation(rows: DataFrame, policy: tuple[str, int] = CURRENT) -> DataFrame:
    """By rule of the policy: texts it fails, texts that only it rejects, and texts kept without it.

    The ledger shrinks to one row for each set of failures before anything else happens.
    """
    mask = POLICIES[policy]
    sets = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("failed")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if mask >> r.bit & 1]
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules)))
    x = sets.withColumn("r", each).select("failed", "n", "r.rule", "r.bit")
    return x.groupBy("rule", "bit").agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_sole"),
        F.sum(F.when(F.col("failed").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def keep_documents(docs: DataFrame, policy: tuple[str, int] = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns: the ledger's bits beside each row, in one pass, against the policy's mask."""
    mask = POLICIES[policy] | POLICIES["base", 1]
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(i, BATCH_ROWS)
                bits = _measure_all({"text": part.column(at).cast(pa.string()).to_pylist()})["fail_bits"]
                yield part.filter(pa.array((bits & mask) == 0))

    return docs.mapInArrow(run, docs.schema)

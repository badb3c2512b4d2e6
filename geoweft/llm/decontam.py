"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive tokens; tokens at its gaps don't count,
so a hit survives substitutions there. Hashes of the benchmark's tokens under
each mask are joined with those of the texts; a hit gives an item and a diagonal,
along which item and text are then compared token by token. The best-scoring
stretch (a match counts 1, a substitution -2) is a leak if it has ``least``
matching tokens; an item below LONG tokens leaks where four fifths of it match.

Most hashes of a text are no item's. A bit table of the items' hashes, of a size
that is bounded whatever the benchmark's, lets the others pass: only these, with
the tokens of their texts, are written and joined. Stretches travel, not texts,
and no hash, item or text of any frequency is one task's.

Tokens are runs of letters, digits and other characters above ASCII, in lower
case. An item of fewer than SHORTEST tokens says too little to be found within a
text; it leaks into texts that consist of it. Items too short for all masks have
shorter ones. Any one substitution leaves a hit. Null and
empty texts and items hold no tokens; repeated rows are each reported, as are
rows without ids; further columns are ignored (``contaminated``) or kept
(``without_contaminated``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import BROADCAST_ROWS, Scratch, lookup, map_columns
from geoweft.llm.shingles import mixed, word_codes

#: Fixed masks; 1 marks tokens that count.
MASKS = ("11011011", "1110010111", "110100110101", "1111101")
SHORT_MASKS = ("1111", "11011", "10111", "11101")
#: Tokens of the shortest item that is looked for within texts, and of the shortest of which a stretch may leak.
SHORTEST, LONG = 8, 16
LEAST = 13
MISMATCH = 2
#: Bits of the table for each hash, the places that a hash sets, and the most bits (32 MB).
BITS, PROBES, MOST_BITS = 64, 4, 1 << 28
#: Bits of a hash that a smaller table, which stays in the processor's cache, knows first.
FIRST = 20

_DROP = bytes(c for c in range(128) if not chr(c).isalnum())
_TABLE = bytes.maketrans(_DROP, b" " * len(_DROP))
_MUL = np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str | None) -> np.ndarray:
    return word_codes((text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split())


def seed_hashes(codes: np.ndarray, mask: str) -> np.ndarray:
    """The hash under a mask at each position where it fits."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, int(mask, 2), np.uint64)
    with np.errstate(over="ignore"):
        for k, bit in enumerate(mask):
            if bit == "1":
                h = h * _MUL + codes[k : k + n]
                h ^= h >> np.uint64(32)
    return mixed(h)


def masks_for(n: int) -> tuple[str, ...]:
    return MASKS if n >= max(map(len, MASKS)) else SHORT_MASKS if n >= SHORTEST else ()


def needed(n: int, least: int = LEAST) -> int:
    """Matching tokens that make a leak of an item of n tokens."""
    return least if n >= LONG else min(least, -(-4 * n // 5))


def seeds(items: DataFrame) -> DataFrame:
    """item, n (its tokens), at, mask, hash: a row for each seed of each item."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("item", "n", "at", "mask", "hash")}
        for item, codes in zip(batch["item"], batch["codes"]):
            codes = np.frombuffer(codes, np.uint64)
            for mask in masks_for(len(codes)):
                h = seed_hashes(codes, mask)
                for c, v in (("item", [item] * len(h)), ("n", [len(codes)] * len(h)), ("at", range(len(h))), ("mask", [mask] * len(h)), ("hash", h.view(np.int64).tolist())):
                    out[c] += v
        return out

    return map_columns(items, run, "item long, n int, at int, mask string, hash long")


class BitTable:
    """Finds hashes that may be an item's: their first bits are known, and all of PROBES bits are set."""

    def __init__(self, bits: int):
        self.bits, self.words, self.known = bits, np.zeros(bits // 64, np.uint64), np.zeros(1 << FIRST, bool)

    def slots(self, h: np.ndarray, probe: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(h + np.uint64(probe) * _MUL) & np.uint64(self.bits - 1)

    def filtered(self, h: np.ndarray) -> np.ndarray:
        """The positions of such hashes."""
        at = np.flatnonzero(self.known[h >> np.uint64(64 - FIRST)])
        for probe in range(PROBES):
            s = self.slots(h[at], probe)
            at = at[self.words[s >> np.uint64(6)] >> (s & np.uint64(63)) & np.uint64(1) != 0]
        return at


def bit_table(rows: DataFrame) -> BitTable:
    """The table of the hashes in ``rows``; its words are united on the executors, and at most MOST_BITS and 2**FIRST numbers reach the driver."""
    n = rows.count()
    table = BitTable(min(MOST_BITS, 1 << max(12, (BITS * n - 1).bit_length())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch["hash"].to_numpy().view(np.uint64)
            s = np.unique(np.concatenate([table.slots(h, probe) for probe in range(PROBES)]))
            word, bit = (s >> np.uint64(6)).astype(np.int64), np.uint64(1) << (s & np.uint64(63))
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.empty(0, np.int64)
            bits = np.bitwise_or.reduceat(bit, first) if len(first) else bit
            yield pa.RecordBatch.from_pydict({"word": word[first], "bits": bits.view(np.int64)}, schema=pa.schema([("word", pa.int64()), ("bits", pa.int64())]))

    words = rows.select("hash").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    first = rows.select(F.shiftrightunsigned("hash", 64 - FIRST).alias("k")).distinct().toPandas()["k"].to_numpy(np.int64)
    table.known[first] = True
    part = words.toPandas()
    table.words[part["word"].to_numpy(np.int64)] = part["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def overlap(same: np.ndarray, n: int) -> tuple[int, int, int]:
    """The start, end and matches of what counts along a diagonal of an item of n tokens."""
    if n >= LONG:
        return stretch(same)
    at = np.flatnonzero(same)
    return (int(at[0]), int(at[-1]) + 1, len(at)) if len(at) else (0, 0, 0)


def stretch(same: np.ndarray) -> tuple[int, int, int]:
    """The stretch of largest score, the first of equals: its start, end and matches."""
    sums = np.concatenate(([0], np.cumsum(np.where(same, 1, -MISMATCH))))
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    start = int(np.argmin(sums[: end + 1]))
    return start, end, int(same[start:end].sum())


def leaks(docs: DataFrame, benchmark: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash, item_id, start_token, end_token, n_matching: each item's best leak into each row that it leaks into."""
    codes = lambda b: {"item": b["item"], "item_id": b["item_id"], "codes": [tokens(t).tobytes() for t in b["text"]]}
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = scratch.write(map_columns(items, codes, "item long, item_id long, codes binary"))
    of_items = scratch.write(seeds(items))
    masks = [r["mask"] for r in of_items.select("mask").distinct().collect()]  # of the fixed ones
    table = docs.sparkSession.sparkContext.broadcast(bit_table(of_items))

    def hits(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("doc_id", "text_hash", "codes", "seeds")}
        own = list(map(tokens, batch["text"]))
        ends = np.cumsum([len(c) for c in own])
        whole = np.concatenate(own)  # hashed in one go; what reaches across texts is none
        found: dict[int, list] = {}
        for mask in masks:
            h = seed_hashes(whole, mask)
            at = table.value.filtered(h)
            k = np.searchsorted(ends, at, "right")
            inside = at + len(mask) <= ends[k]
            at, k = at[inside], k[inside]
            for i, x, p in zip(k.tolist(), h[at].view(np.int64).tolist(), (at - ends[k]).tolist()):
                found.setdefault(i, []).append({"hash": x, "p": p + len(own[i])})
        for i, o in enumerate(own):
            if i in found or 0 < len(o) < SHORTEST:
                for c, v in (("doc_id", batch["doc_id"][i]), ("text_hash", batch["text_hash"][i]), ("codes", o.tobytes()), ("seeds", found.get(i, []))):
                    out[c].append(v)
        return out

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    rows = map_columns(rows, hits, "doc_id long, text_hash long, codes binary, seeds array<struct<hash:long,p:int>>")
    rows = scratch.write(rows.withColumn("row", F.monotonically_increasing_id()))  # written, a row keeps its number
    # what an item's hash is of: a row for each hash, as long as the items are many that share it
    at_hash = of_items.groupBy("hash").agg(F.collect_set(F.struct("item", "n", "at")).alias("of"))
    met = lookup(rows.select("row", F.explode("seeds").alias("s")).select("row", "s.hash", "s.p"), at_hash, "hash", "inner")
    met = met.select("row", "p", F.explode("of").alias("of")).select("row", "of.item", "of.n", (F.col("p") - F.col("of.at")).alias("d")).distinct()

    def along(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("row", "item", "first", "skipped", "part")}
        for row, own, diagonals in zip(batch["row"], batch["codes"], batch["diagonals"]):
            size = len(own) // 8
            for x in diagonals:
                a, b = max(0, x["d"]), min(size, x["d"] + x["n"])
                for c, v in (("row", row), ("item", x["item"]), ("first", a), ("skipped", a - x["d"]), ("part", own[8 * a : 8 * b])):
                    out[c].append(v)
        return out

    diagonals = met.groupBy("row").agg(F.collect_list(F.struct("item", "n", "d")).alias("diagonals"))
    parts = map_columns(rows.select("row", "codes").join(diagonals, "row"), along, "row long, item long, first int, skipped int, part binary")

    def compared(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("row", "item_id", "item", "start_token", "end_token", "n_matching")}
        for row, item, item_id, first, skipped, part, whole in zip(*(batch[c] for c in ("row", "item", "item_id", "first", "skipped", "part", "codes"))):
            x, y = np.frombuffer(part, np.uint64), np.frombuffer(whole, np.uint64)
            start, end, same = overlap(x == y[skipped : skipped + len(x)], len(y))
            if same >= needed(len(y), least):
                for c, v in zip(out, (row, item_id, item, first + start, first + end, same)):
                    out[c].append(v)
        return out

    found = map_columns(lookup(parts, items, "item", "inner"), compared, "row long, item_id long, item long, start_token long, end_token long, n_matching long")
    best = F.min_by(F.struct("item_id", "start_token", "end_token", "n_matching"), F.struct(-F.col("n_matching"), "start_token", "end_token"))
    found = found.groupBy("row", "item").agg(best.alias("b")).join(rows.select("row", "doc_id", "text_hash"), "row")
    found = found.select("doc_id", "text_hash", "b.item_id", "b.start_token", "b.end_token", "b.n_matching")
    few = lambda df: df.where((F.length("codes") > 0) & (F.length("codes") < 8 * SHORTEST))
    size = (F.length("codes") / 8).cast("long")
    # items of one wording are one row, which is small: texts that are short are all told apart by them
    short = few(items).groupBy("codes").agg(F.collect_list("item_id").alias("with_id"), F.count("*").alias("m"))
    short = scratch.write(short)
    whole = lookup(few(rows).select("doc_id", "text_hash", "codes"), short, "codes", "inner")
    each = F.explode(F.concat("with_id", F.array_repeat(F.lit(None).cast("long"), F.col("m").cast("int") - F.size("with_id"))))
    whole = whole.select("doc_id", "text_hash", each.alias("item_id"), F.lit(0).cast("long").alias("start_token"), size.alias("end_token"), size.alias("n_matching"))
    return found.union(whole)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, start_token, end_token, n_matching): each item's best leak into each text that it leaks into."""
    scratch = Scratch(docs.sparkSession)
    return scratch.last(leaks(docs, benchmark, least, scratch).drop("text_hash"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` into which no item leaks."""
    scratch = Scratch(docs.sparkSession)
    leaked = scratch.last(leaks(docs, benchmark, least, scratch).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct())
    leaked = F.broadcast(leaked) if leaked.count() <= BROADCAST_ROWS else leaked
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = {c.lower(): n for c, n in zip(docs.columns, names)}
    same = F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("d")) & (F.xxhash64(F.coalesce(F.col(at["text"]).cast("string"), F.lit(""))) == F.col("h"))
    return docs.toDF(*names).join(leaked, same, "left_anti").toDF(*docs.columns)

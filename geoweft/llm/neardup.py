"""Near duplicates by HyperMinHash sketches.

A text is its set of distinct word shingles. A sketch has BANDS parts; a part has
its own hash, which deals the shingles to four buckets; a bucket keeps the
smallest value as a register: its number of leading zeros and ten mantissa bits.
Four registers, packed in 64 bits, are a part's band key. At a similarity of 0.85
a pair meets in no band with a probability of about 1e-10.

1. Texts with equal sets become one class.
2. Classes that share a band key are a bucket. Its hub is the member whose
   buckets are fullest, the text that the others are copies of, and is tried
   against all others: a group of n near copies costs about n trials.
3. Where a hub's group still has several components, every pair of members of
   different components is tried too: pair by pair in small groups; in large
   ones, what isn't tied to the hub against all, in blocks of BLOCK x BLOCK
   members that multiply as matrices and emit only links that join something.
   A trial of a pair first compares registers (collisions by chance are taken
   off), then the full sets: linked are 100 * intersection >= percent * union.
4. Links and classes give components.

A hub's trials are dealt out in parts of PART pairs and its blocks block by block,
so that no group is one task's.

A null or empty text has an empty set and stands alone. The smallest doc_id names
its component, and a row is kept if it has that doc_id; a component without any
doc_id has no name, and the rows of one text in it, the text of the smallest hash,
are kept, as are all without words. Rows repeated with one doc_id or with none are
classified each for itself; ``keep_one`` keeps one of them. Further columns are
ignored, or kept by ``keep_one``. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import Scratch, lookup, map_columns
from geoweft.llm.components import components
from geoweft.llm.shingles import shingle_set

BANDS, BUCKETS, MANTISSA = 32, 4, 10
EMPTY = 0xFFFF
#: Fixed value: the limit of chance collisions a register at 2**-r, for sets of like size.
CHANCE = 0.169919487159739093975315012348
#: Standard deviations by which an estimate may fall short of the threshold and still be verified.
SIGMAS = 6
#: Members up to which a group's pairs are made; members of a block beyond, and bytes of their sets.
SMALL, BLOCK, BLOCK_BYTES = 32, 512, 4 << 20
#: Pairs of one text that a task takes; rows of a class beyond which its answer is broadcast to them.
PART, MANY = 1_000, 1_000

_rng = np.random.default_rng(20240601)
_XOR = _rng.integers(0, 2**64, BANDS, np.uint64)
_MUL = _rng.integers(0, 2**64, BANDS, np.uint64) | np.uint64(1)
_QUARTER = np.uint64(1) << np.uint64(62)


def registers(codes: np.ndarray) -> np.ndarray:
    """BANDS x BUCKETS registers of 16 bits: leading zeros of the bucket's smallest value, then its mantissa."""
    least = np.full((BANDS, BUCKETS), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(codes), 4096):
            h = (codes[None, i : i + 4096] ^ _XOR[:, None]) * _MUL[:, None]
            for q in range(BUCKETS):
                # values of bucket q come to stand first, from 0 to 2**62
                np.minimum(least[:, q], (h - np.uint64(q) * _QUARTER).min(axis=1), out=least[:, q])
    bits = np.maximum(least, 1).astype(np.float64).view(np.uint64)
    exponent, mantissa = (bits >> np.uint64(52)) - np.uint64(1023), (bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return np.where(least < _QUARTER, ((np.uint64(62) - exponent) << np.uint64(MANTISSA)) | mantissa, EMPTY).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> tuple[float, int]:
    """The Jaccard estimate from two arrays of registers, less chance collisions, and the registers it rests on."""
    used = (a != EMPTY) | (b != EMPTY)
    k = int(used.sum())
    if not k:
        return 0.0, 0
    chance = CHANCE * 4 * n * m / (n + m) ** 2 / (1 << MANTISSA)
    return max(0.0, float((a == b)[used].sum()) / k - chance), k


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, the set's 128-bit digest and its band keys (null for an empty set)."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "n_shingles": [], "digest": [], "bands": []}
        for text in batch["text"]:
            codes = shingle_set(text, width)
            out["n_shingles"].append(len(codes))
            out["digest"].append(hashlib.blake2b(codes.tobytes(), digest_size=16).digest() if len(codes) else None)
            out["bands"].append(registers(codes).view(np.int64)[:, 0].tolist() if len(codes) else None)
        return out

    return map_columns(docs, run, "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>")


def paired(pairs: DataFrame, data: DataFrame) -> DataFrame:
    """The pairs (a, b) with what ``data`` (rep, ...) has of both, as a_... and b_...; a text of many pairs is dealt out in parts."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    x = lookup(pairs, parts, "a").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    side = lambda c: data.select(*(F.col(k).alias(c if k == "rep" else f"{c}_{k}") for k in data.columns))
    left = lookup(side("a"), parts, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return x.join(left, ["a", "part"]).join(side("b"), "b").drop("part")


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose registers allow a similarity of the threshold."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"a": [], "b": []}
        for a, b, n, m, x, y in zip(*(batch[c] for c in ("a", "b", "a_n", "b_n", "a_bands", "b_bands"))):
            if 100 * min(n, m) < percent * max(n, m):
                continue
            j, k = estimate(np.array(x, np.int64).view(np.uint16), np.array(y, np.int64).view(np.uint16), n, m)
            t = percent / 100
            if j + SIGMAS * (t * (1 - t) / max(k, 1)) ** 0.5 >= t:
                out["a"].append(a)
                out["b"].append(b)
        return out

    return map_columns(paired(pairs, reps.select("rep", "n", "bands")), run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that are linked by their full sets (rep, codes)."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"a": [], "b": []}
        for a, b, x, y in zip(*(batch[c] for c in ("a", "b", "a_codes", "b_codes"))):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                out["a"].append(a)
                out["b"].append(b)
        return out

    return map_columns(paired(pairs, sets), run, "a long, b long")


class Texts:
    """The texts behind classes. A class's text is found by a doc_id and a hash, which name one row unless rows repeat."""

    def __init__(self, docs: DataFrame, reps: DataFrame, width: int, repeated: bool):
        self.docs, self.reps, self.width, self.repeated = docs, reps, width, repeated

    def sets(self, ids: DataFrame) -> DataFrame:
        """(rep, codes) of the classes in ``ids`` (rep)."""
        width = self.width

        def run(batch: dict[str, list]) -> dict[str, list]:
            return {"rep": batch["rep"], "codes": [shingle_set(t, width).tobytes() for t in batch["text"]]}

        at = self.reps.join(ids.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("at.doc_id").alias("d"), F.col("at.text_hash").alias("h"))
        texts = self.docs.join(at, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("rep", "text")
        if self.repeated:
            texts = texts.groupBy("rep").agg(F.min("text").alias("text"))
        return map_columns(texts, run, "rep long, codes binary")


def tried(pairs: DataFrame, texts: Texts, percent: int, scratch: Scratch) -> DataFrame:
    """The links among the pairs (a, b)."""
    some = scratch.write(likely(pairs, texts.reps, percent))
    needed = some.select(F.col("a").alias("rep")).union(some.select(F.col("b").alias("rep")))
    links = scratch.write(verified(some, texts.sets(needed), percent))
    scratch.forget(some)
    return links


def across(groups: DataFrame, label: DataFrame, texts: Texts, percent: int, scratch: Scratch) -> DataFrame:
    """Links between components that a hub's trials have left apart, from groups (hub, rep)."""
    named = label.withColumnsRenamed({"id": "rep"})
    all_ = groups.union(groups.select("hub", F.col("hub").alias("rep")).distinct())
    sizes = texts.reps.select("rep", (8 * F.col("n")).alias("bytes"))
    state = scratch.write(all_.join(named, "rep", "left").join(sizes, "rep").select("hub", "rep", F.coalesce("component", "rep").alias("component"), "bytes"))
    about = state.groupBy("hub").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"), F.min("component").alias("x"), F.max("component").alias("y"), F.max(F.when(F.col("rep") == F.col("hub"), F.col("component"))).alias("of"))
    state = scratch.write(lookup(state, about.where("x < y").select("hub", "n", "total", "of"), "hub", "inner"))

    small = state.where(F.col("n") <= SMALL).select("hub", "rep", "component")
    other = small.select("hub", F.col("rep").alias("b"), F.col("component").alias("c"))
    pairs = small.join(other, "hub").where("rep < b and component <> c and rep <> hub and b <> hub").select(F.col("rep").alias("a"), "b").distinct()
    links = tried(pairs, texts, percent, scratch)

    large = state.where(F.col("n") > SMALL)
    if large.isEmpty():
        return links
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_BYTES)).cast("int")
    placed = large.select("hub", "rep", "component", (F.col("component") != F.col("of")).alias("apart"), blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"))
    placed = scratch.write(placed.join(texts.sets(large), "rep"))
    members = F.collect_list(F.struct("rep", "component", "codes"))
    v = placed.groupBy("hub", "block").agg(members.alias("v"))
    u = placed.where("apart").groupBy("hub", F.col("block").alias("own"), "blocks").agg(members.alias("u"))
    u = u.select("hub", "u", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def run(batch: dict[str, list]) -> dict[str, list]:
        found = [x for u, v in zip(batch["u"], batch["v"]) for x in joining(u, v, percent)]
        return {"a": [x[0] for x in found], "b": [x[1] for x in found]}

    return links.union(scratch.write(map_columns(u.join(v, ["hub", "block"]).select("u", "v"), run, "a long, b long")))


def joining(u: list[dict], v: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links between members of two blocks, as many as join their components."""
    x, y = ([np.frombuffer(m["codes"], np.uint64) for m in side] for side in (u, v))
    n, m = (np.array([len(c) for c in side]) for side in (x, y))
    owner = np.repeat(np.arange(len(x) + len(y)), [len(c) for c in (*x, *y)])
    _, at, count = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    both = np.zeros((len(x), len(y)), np.float32)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    at, owner = at[count[at] > 1], owner[count[at] > 1]
    at = np.unique(at, return_inverse=True)[1]
    width = 1 << 12
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        i, j = np.searchsorted(at, [low, low + width])
        part = np.zeros((len(x) + len(y), width), np.float32)
        part[owner[i:j], at[i:j] - low] = 1
        both += part[: len(x)] @ part[len(x) :].T
    linked = 100 * both.astype(np.int64) >= percent * (n[:, None] + m[None, :] - both.astype(np.int64))
    above: dict[int, int] = {}

    def top(c: int) -> int:
        while c in above:
            c = above[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = top(u[i]["component"]), top(v[j]["component"])
        if a != b:
            above[a] = b
            out.append((u[i]["rep"], v[j]["rep"]))
    return out


def classified(docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash, n_shingles, class_id, component_id, component (its number) and keep, the text hash of the rows that stay where no doc_id tells: one row for each of docs (doc_id, text, text_hash)."""
    sketch = scratch.write(sketches(docs, width))
    full = sketch.where(F.col("digest").isNotNull())
    # a class has a number, which stays once it is written
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    reps = full.groupBy("digest").agg(F.min(at).alias("at"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    reps = scratch.write(reps.withColumn("rep", F.monotonically_increasing_id()))
    repeated = not full.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    texts = Texts(docs, reps, width, repeated)

    # two different sets are at most n / (n + 1) alike: very small ones link with none but their equals, and their few registers would meet by chance
    banded = reps.where(100 * F.col("n") >= percent * (F.col("n") + 1)).select("rep", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    met = banded.join(shared, ["band", "key"]).groupBy("rep").agg(F.collect_set(F.xxhash64("band", "key")).alias("buckets"), F.sum("size").alias("score"))
    met = scratch.write(met)
    members = met.select("rep", "score", F.explode("buckets").alias("bucket"))  # a class is in BANDS buckets at most
    hubs = members.groupBy("bucket").agg(F.max_by("rep", F.struct(F.col("score"), -F.col("rep"))).alias("hub"))
    groups = scratch.write(members.join(hubs, "bucket").where("rep <> hub").select("hub", "rep").distinct())

    links = tried(groups.select(F.col("hub").alias("a"), F.col("rep").alias("b")), texts, percent, scratch)
    more = across(groups, components(links, scratch), texts, percent, scratch)
    label = components(links.union(more), scratch).withColumnRenamed("id", "rep")

    tied = reps.select("rep", "digest", "at", "copies").join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    first = label.select("component").distinct().join(tied, "component").groupBy("component").agg(F.min("at").alias("first"))
    tied = tied.join(first, "component", "left").withColumn("first", F.coalesce("first", "at"))
    classes = tied.select(
        "digest", F.col("at.doc_id").alias("class_id"), F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("keep"), "component", "copies"
    )
    # classes of many rows reach them by broadcast, so that none of them is one task's
    out = lookup(sketch.drop("bands"), classes.where(F.col("copies") > MANY).drop("copies"), "digest")
    done = F.col("component").isNotNull() | F.col("digest").isNull()
    known, rest = out.where(done), out.where(~done).drop("class_id", "component_id", "keep", "component")
    out = known.unionByName(rest.join(classes.drop("copies"), "digest"))
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), "component", "keep")


def prepared(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))


KEPT = "coalesce(doc_id = component_id, component_id is null and (keep is null or keep = text_hash))"


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set), component_id, kept: one row for each of (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    found = classified(prepared(docs), width, percent, scratch)
    return scratch.last(found.select("doc_id", "n_shingles", "class_id", "component_id", F.expr(KEPT).alias("kept")))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept, one where rows repeat: the first text by hash of a doc_id, any of equal rows."""
    scratch = Scratch(docs.sparkSession)
    found = classified(prepared(docs), width, percent, scratch).where(KEPT)
    # a doc_id with several texts in one component keeps one of them; texts without words are all kept
    one = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct("text_hash", "doc_id")).alias("x"), F.count("*").alias("rows"))
    one = one.select(F.col("x.doc_id").alias("d"), F.col("x.text_hash").alias("h"), "rows")
    none = found.where(F.col("component").isNull()).groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.lit(1).cast("long").alias("rows"))
    kept = scratch.last(one.union(none))
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c.lower(): n for c, n in zip(docs.columns, names)}
    same = F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("d")) & (F.xxhash64(F.coalesce(F.col(at["text"]).cast("string"), F.lit(""))) == F.col("h"))
    out = plain.join(kept.where("rows = 1"), same, "left_semi")
    several = kept.where("rows > 1")
    if not several.isEmpty():
        twice = plain.join(several, same, "left_semi").withColumn("h", F.xxhash64(at["text"]))
        out = out.union(twice.dropDuplicates([at["doc_id"], "h"]).drop("h"))
    return out.toDF(*docs.columns)

"""The trie of all conversations' prefixes, with what sharing them saves.

Each conversation's turns, by number, are a path from the root; a node is a
distinct sequence of first turns. A sequence goes by 127 bits: the sum of its
turns' digests times powers of a constant, modulo a prime, which is put together
from parts, so a conversation of any length is read by as many tasks as it takes.

Sums over subtrees come by heavy-path decomposition. The child with most members
continues its parent's path, any other begins one; so a conversation meets at most
log2(n) paths. What a path's nodes add up to is attached to the node above its
top, the deepest paths first, one round for each level of paths; then suffix sums
along the paths, as they stand sorted, are the sums of all subtrees.

Sorted rows are read by tasks that know nothing of each other: each starts anew,
and what the tasks before have of a key is added when the rows are read again.
Only one row a task reaches the driver.

Turns without a number come first, and turns of one number in the order of their
digests; repeated rows are turns of their own. A null role or text is empty. Rows
without conv_id belong to no conversation and count nowhere. Further columns are
ignored, and an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from geoweft.llm.common import Scratch, ship, streamed

PRIME, BASE = (1 << 127) - 1, 0x5DEECE66D1B54A32D192ED03A6F1F4A9
ROOT = bytes(16)
#: Ids whose text is one row.
ENDS = 4096
#: Turns that a conversation may take from another one.
SHARED = 6


class Scan:
    """Running states of rows that are sorted by a key and more: ``step(state, row)`` after each row, from ``start``.

    ``join(a, b)`` is the state after rows that alone would lead to a, then rows that alone would lead to b.
    """

    def __init__(self, schema: str, start: tuple, step: Callable[[tuple, dict], tuple], join: Callable[[tuple, tuple], tuple]):
        self.schema, self.start, self.step, self.join = schema, start, step, join
        self.names = [x.split()[0] for x in schema.split(", ")]

    def over(self, df: DataFrame, key: str, order: list[Column], scratch: Scratch) -> DataFrame:
        """``df`` with the columns of the states; the sorted rows are a table of ``scratch``."""
        names, state, start, step, join = df.columns, self.names, self.start, self.step, self.join
        own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
        local = to_arrow_schema(T._parse_datatype_string(f"{own}, {self.schema}, part int, row long"))

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, row, now, at = TaskContext.get().partitionId(), 0, start, None
            for batch in batches:
                states = []
                for r in batch.to_pylist():
                    if r[key] != at:
                        at, now = r[key], start
                    now = step(now, r)
                    states.append(now)
                n = batch.num_rows
                columns = [*batch.columns, *([s[k] for s in states] for k in range(len(state))), [part] * n, range(row, row + n)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, local)], schema=local)
                row += n

        rows = scratch.write(df.orderBy(F.col(key), *order).mapInArrow(alone, f"{own}, {self.schema}, part int, row long"))
        ends = rows.groupBy("part").agg(F.min_by(key, "row").alias("first"), F.max_by(F.struct(key, *state), "row").alias("last")).collect()
        before: dict[int, tuple[object, tuple]] = {}
        open_key, open_state = None, start
        for r in sorted(ends, key=lambda r: r["part"]):
            first, last, ended = r["first"], r["last"][0], tuple(r["last"][1:])
            if first == open_key:
                before[r["part"]] = (first, open_state)
            open_state = join(open_state, ended) if first == last == open_key else ended
            open_key = last
        out = to_arrow_schema(T._parse_datatype_string(f"{own}, {self.schema}"))

        def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = batch["part"].to_pylist()
                columns = [batch[n] for n in names]
                states = list(zip(*(batch[n].to_pylist() for n in state)))
                keys = batch[key].to_pylist()
                for k, p in enumerate(parts):
                    if p in before and keys[k] == before[p][0]:
                        states[k] = join(before[p][1], states[k])
                columns += [pa.array([s[k] for s in states], out.field(n).type) for k, n in enumerate(state)]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

        return rows.mapInArrow(together, f"{own}, {self.schema}")


def _hash(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _of(key: bytes) -> int:
    return int.from_bytes(key, "big")


def _turn(digest: bytes) -> int:
    return _of(digest) % PRIME + 1


#: Turns read, and the sum of their digests times powers of their numbers.
PREFIXES = Scan(
    "i long, key binary",
    (0, ROOT),
    lambda s, r: (s[0] + 1, _hash((_of(s[1]) + _turn(r["digest"]) * pow(BASE, s[0] + 1, PRIME)) % PRIME)),
    lambda a, b: (a[0] + b[0], _hash((_of(a[1]) + pow(BASE, a[0], PRIME) * _of(b[1])) % PRIME)),
)

#: Paths met, the present one's top, and that of the one before.
PATHS = Scan(
    "level long, path binary, above binary",
    (0, None, None),
    lambda s, r: (s[0] + 1, r["key"], s[1]) if r["light"] else s,
    lambda a, b: a if not b[0] else (a[0] + b[0], b[1], a[1] if b[0] == 1 else b[2]),
)

SUMS = Scan("leaves long, saved long", (0, 0), lambda s, r: (s[0] + r["leaf"], s[1] + r["weight"]), lambda a, b: (a[0] + b[0], a[1] + b[1]))


def taken(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its hundred."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def rebuilt(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, d, key, parent, size, last): the first d turns of conversation c as it is rebuilt, from d = 0 on."""
    numbered = PREFIXES.over(turns, "conv_id", [F.asc_nulls_first("turn"), F.col("digest")], scratch)
    head = F.when(F.col("i") < SHARED, F.struct("i", "key", "size"))
    convs = scratch.write(numbered.groupBy("conv_id").agg(F.max("i").alias("m"), F.array_sort(F.collect_list(head)).alias("head")))
    c, h = F.col("conv_id"), F.col("h")
    base = convs.select(c.alias("b"), F.col("head").alias("shared"))
    info = convs.withColumns({"b": c - c % 100, "h": taken(c)}).join(base, "b", "left")
    k = F.least(h, F.coalesce(F.size("shared"), F.lit(0)).cast("long"))
    at = lambda a, n: F.when(n > 0, F.get(a, (n - 1).cast("int"))["key"]).otherwise(F.lit(ROOT))
    info = info.withColumn("k", F.when(F.col("shared").isNotNull(), k).otherwise(0))
    info = info.select(c.alias("c"), "h", "k", "shared", (F.col("k") + F.greatest(F.col("m") - h, F.lit(0))).alias("depth"), at("shared", F.col("k")).alias("from"), at("head", F.least(h, F.col("m"))).alias("off"))
    info = scratch.write(info)
    start = info.select("c", F.lit(0).cast("long").alias("d"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("size"), (F.col("depth") == 0).alias("last"))
    shared = info.select("c", "k", "depth", "shared", F.explode(F.slice("shared", 1, F.col("k").cast("int"))).alias("t"))
    d = F.col("t.i")
    shared = shared.select("c", d.alias("d"), F.col("t.key").alias("key"), at("shared", d - 1).alias("parent"), F.col("t.size").alias("size"), (d == F.col("depth")).alias("last"))
    own = numbered.where(F.col("i") > taken(c)).select(c.alias("c"), "i", "key", "digest", "size").join(info.drop("shared"), "c")

    def moved(rows: Iterator[tuple]) -> Iterator[dict[str, list]]:
        """A conversation's own turns after those it takes: the prefix they had is replaced, and the powers move with their numbers."""
        powers = [pow(BASE, -n, PRIME) for n in range(SHARED)]
        out: dict[str, list] = {n: [] for n in ("c", "d", "key", "parent", "size", "last")}
        for c, i, key, digest, size, h, k, depth, start, off in rows:
            d = i - h + k
            now = (_of(start) + (_of(key) - _of(off)) * powers[h - k]) % PRIME
            before = (now - _turn(digest) * pow(BASE, d, PRIME)) % PRIME
            for name, v in zip(out, (c, d, _hash(now), _hash(before), size, d == depth)):
                out[name].append(v)
            if len(out["c"]) >= 4096:
                yield out
                out = {n: [] for n in out}
        yield out

    own = streamed(own.select("c", "i", "key", "digest", "size", "h", "k", "depth", "from", "off"), moved, "c long, d long, key binary, parent binary, size long, last boolean")
    return scratch.write(start.union(shared).union(own))


def ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256): of the numbers of conversations that end at a node, ascending and comma-joined.

    Ids are sorted and joined by many tasks; the digest of a node reads one row for each few thousand of them, one after the other.
    """

    def joined(rows: Iterator[tuple]) -> Iterator[dict[str, list]]:
        out: dict[str, list] = {"key": [], "first": [], "ids": []}
        at, ids = None, []
        for key, c in rows:
            if ids and (key != at or len(ids) >= ENDS):
                for name, v in zip(out, (at, ids[0], ",".join(map(str, ids)))):
                    out[name].append(v)
                ids = []
                if len(out["key"]) >= 512:
                    yield out
                    out = {n: [] for n in out}
            at = key
            ids.append(c)
        if ids:
            for name, v in zip(out, (at, ids[0], ",".join(map(str, ids)))):
                out[name].append(v)
        yield out

    def digests(rows: Iterator[tuple]) -> Iterator[dict[str, list]]:
        out: dict[str, list] = {"key": [], "ends_sha256": []}
        at, sha = None, None
        for key, _, ids in rows:
            if key == at:
                sha.update(b"," + ids.encode())
                continue
            if sha:
                out["key"].append(at)
                out["ends_sha256"].append(sha.hexdigest())
                if len(out["key"]) >= 4096:
                    yield out
                    out = {n: [] for n in out}
            at, sha = key, hashlib.sha256(ids.encode())
        if sha:
            out["key"].append(at)
            out["ends_sha256"].append(sha.hexdigest())
        yield out

    some = streamed(members.where("last").select("key", "c").orderBy("key", "c"), joined, "key binary, first long, ids string")
    return streamed(some.repartition("key").sortWithinPartitions("key", "first"), digests, "key binary, ends_sha256 string")


def totals(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, leaves, saved) to be added at nodes for the paths attached to them, from ``nodes`` (key, parent, level, path, above, leaf, weight)."""
    paths = nodes.groupBy("path").agg(F.max("level").alias("level"), F.max("above").alias("above"), F.max(F.when(F.col("key") == F.col("path"), F.col("parent"))).alias("at"), F.sum("leaf").alias("leaves"), F.sum("weight").alias("saved"))
    paths = scratch.write(paths)
    deepest = paths.agg(F.max("level")).first()[0] or 0
    done, below = None, None
    for level in range(deepest, 1, -1):
        here = paths.where(F.col("level") == level)
        if below is not None:
            got = below.groupBy(F.col("above").alias("path")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
            here = here.join(got, "path", "left").withColumns({v: F.col(v) + F.coalesce(f"more_{v}", F.lit(0)) for v in ("leaves", "saved")})
        below = scratch.write(here.select("above", "at", "leaves", "saved"), sweep=False)
        done = below if done is None else done.union(below)
    if done is None:
        done = paths.limit(0).select("above", "at", "leaves", "saved")
    return done.groupBy(F.col("at").alias("key")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node.

    A node is named by the smallest conversation that starts with it, and its depth. saved_tokens is what the nodes below and itself save by
    being kept once: code points of their last texts, for each member but one.
    """
    spark = ship(conversations.sparkSession)
    scratch = Scratch(spark)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("r"), text.alias("t")).where("conv_id is not null")
    digest = F.unhex(F.md5(F.concat(F.length("r").cast("string"), F.lit(":"), F.col("r"), F.col("t")).cast("binary")))
    members = rebuilt(turns.select("conv_id", "turn", digest.alias("digest"), F.length("t").cast("long").alias("size")), scratch)
    one = members.groupBy("key").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("d").alias("depth"), F.max("size").alias("size"), F.max("parent").alias("parent"))
    one = scratch.write(one)
    children = one.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.max_by("key", F.struct("n_convs", -F.col("conv_id"))).alias("heavy"))
    children = scratch.write(children)
    heavy = children.select(F.col("heavy").alias("key"), F.lit(False).alias("light"))
    nodes = one.join(children.drop("heavy"), "key", "left").join(heavy, "key", "left")
    nodes = scratch.write(nodes.withColumns({"light": F.coalesce("light", F.lit(True)), "n_children": F.coalesce("n_children", F.lit(0)).cast("long")}))
    flags = nodes.select("key", "light", F.col("conv_id").alias("least"))
    placed = PATHS.over(members.select("c", "d", "key").join(flags, "key").select("c", "d", "key", "light", (F.col("c") == F.col("least")).alias("own")), "c", [F.col("d")], scratch)
    weight = ((F.col("n_convs") - 1) * F.col("size")).alias("weight")
    placed = nodes.join(placed.where("own").select("key", "level", "path", "above"), "key")
    placed = scratch.write(placed.select("key", "conv_id", "depth", "parent", "n_convs", "n_children", "level", "path", "above", (F.col("n_children") == 0).cast("long").alias("leaf"), weight))
    more = totals(placed, scratch).withColumnsRenamed({"leaves": "more_leaves", "saved": "more_saved"})
    weighed = placed.join(more, "key", "left").withColumns({"leaf": F.col("leaf") + F.coalesce("more_leaves", F.lit(0)), "weight": F.col("weight") + F.coalesce("more_saved", F.lit(0))})
    summed = SUMS.over(weighed.select("key", "conv_id", "depth", "parent", "n_convs", "n_children", "path", "leaf", "weight"), "path", [F.desc("depth")], scratch)
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = summed.join(ends(members), "key", "left").join(above, "parent", "left")
    return scratch.last(
        out.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )

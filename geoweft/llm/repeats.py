"""Repeated passages across documents, by suffix arrays.

A byte goes if a string of LENGTH bytes covers it that also starts in a document
with a smaller doc_id. Two equal strings hold the same anchor: the K bytes whose
hash is smallest among the string's, the leftmost of equals. So

1. every document is cut into spans, each the union of the consecutive windows
   of LENGTH bytes that share an anchor. Spans meet by their anchors: as packed
   hashes, a row for each task and bucket of anchors, so that neither texts nor
   rows for each span travel. Equal spans (by 120 bits of hashes) collapse to
   the one of the smallest doc_id, within a task before they travel, so that a
   passage of any frequency is one entry a task; so is an anchor with more than
   WIDE different spans in a task. Anchors with different spans are left, mostly
   the rims of repeated passages;
2. those spans' bytes are gathered by anchor, cut to what each has in common
   with any other, and sorted into suffix arrays, block by block of anchors; runs
   of suffixes that agree on LENGTH bytes give each window's smallest doc_id. An
   anchor with more than BLOCK_SPANS spans would make a block of unbounded size:
   its spans are dealt out again, by a third of the windows and by the bytes that
   these have in common, until no block is large;
3. each document's intervals are united and its other bytes kept.

A span is named by doc_id and its hash, so what is found holds for any row with
that doc_id and text. Null and empty texts, and those shorter than LENGTH, lose
nothing. Rows without a doc_id aren't compared. Rows of equal doc_id don't
remove each other's bytes, and each loses what its own text repeats. Further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import Scratch
from geoweft.llm.suffixes import suffix_array

LENGTH, K = 50, 24
#: Windows that hold an anchor at a place.
REACH = LENGTH - K + 1
#: Spans that a task settles at once; different spans of an anchor that a task sends on.
CHUNK_SPANS, WIDE = 2_000_000, 32
#: Bytes in a suffix array; spans of one anchor that a block may hold.
BLOCK_BYTES, BLOCK_SPANS = 150_000, 1_000
#: Bytes of text for each bucket, and the bounds of the number of buckets.
BUCKET_BYTES, BUCKETS = 2_000_000, (64, 1 << 20)
#: Entries that a task gathers before it sends them on.
ENTRIES = 500_000
#: Large anchors that may be broadcast.
BROADCAST_KEYS = 200_000

AGAIN, RIM, PART = 0, 1, 2

_MUL = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_LOW = np.uint64((1 << 24) - 1)
#: Texts are cut into pieces of this many windows to find their anchors.
PIECE = 1 << 23


def anchor_hashes(raw: bytes) -> np.ndarray:
    """A hash of the K bytes at each place."""
    v = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
    n = len(raw) - K + 1
    with np.errstate(over="ignore"):
        h = v[:n] * _MUL[0]
        h ^= h >> np.uint64(32)
        h = (h + v[8 : 8 + n]) * _MUL[1]
        h ^= h >> np.uint64(29)
        h = (h + v[16 : 16 + n]) * _MUL[2]
        return h ^ (h >> np.uint64(32))


def spans(raw: bytes) -> tuple[np.ndarray, ...]:
    """Of each span of a text: its anchor's hash, its own hash, start, end and its anchor's place."""
    out = []
    for base in range(0, max(0, len(raw) - LENGTH + 1), PIECE):
        part = raw[base : base + PIECE + LENGTH - 1] if len(raw) > PIECE else raw
        h = anchor_hashes(part)
        c = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= REACH:
            c = np.minimum(c[:-width], c[width:])
            width *= 2
        if REACH > width:
            c = np.minimum(c[: -(REACH - width)], c[REACH - width :])
        at = (c & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        end = np.concatenate((first[1:], [len(at)])) - 1 + LENGTH
        with np.errstate(over="ignore"):  # a span is at most twice LENGTH long, and these four cover it
            own = (end - first).astype(np.uint64)
            for place in (first, first + K, np.minimum(first + 2 * K, end - K), end - K):
                own = (own ^ (own >> np.uint64(31))) * _MUL[1] + h[place]
            own ^= own >> np.uint64(29)
        out.append((h[at[first]], own, first + base, end + base, at[first] + base))
    if not out:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


# -- packed entries ------------------------------------------------------------


def packed(docs: np.ndarray) -> bytes:
    """Integers as their first, and differences of the smallest width that holds them."""
    with np.errstate(over="ignore"):
        step = np.diff(docs, prepend=docs[:1])
        zigzag = ((step << 1) ^ (step >> 63)).view(np.uint64)
    kind = np.min_scalar_type(int(zigzag.max())) if len(docs) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + docs[:1].astype("<i8").tobytes() + zigzag.astype(kind).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    zigzag = np.frombuffer(data[9:], f"<u{data[0]}").astype(np.uint64)
    step = (zigzag >> np.uint64(1)).view(np.int64) ^ -(zigzag & np.uint64(1)).view(np.int64)
    if len(step):
        step[0] = np.frombuffer(data[1:9], "<i8")[0]
    with np.errstate(over="ignore"):
        return np.cumsum(step)


def bucket_of_docs(docs: np.ndarray, buckets: int) -> np.ndarray:
    some, back = np.unique(docs, return_inverse=True)
    return np.fromiter((zlib.crc32(str(d).encode()) % buckets for d in some.tolist()), np.int64, len(some))[back]


ENTRY = "bucket long, kind int, docs binary, ids binary, more binary"
_ENTRY = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("docs", pa.binary()), ("ids", pa.binary()), ("more", pa.binary())])


def dealt(bucket: np.ndarray, kind: int, docs: np.ndarray, ids: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each bucket: its entries in order of docs, packed. ``more`` has a row of bytes for each entry."""
    order = np.lexsort((docs, bucket))
    bucket, docs, ids, more = bucket[order], docs[order], ids[order], more[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.array([0])
    for i in range(0, len(cuts) - 1, 64):
        ab = list(zip(cuts[i : i + 64].tolist(), cuts[i + 1 : i + 65].tolist()))
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": [int(bucket[a]) for a, _ in ab],
                "kind": [kind] * len(ab),
                "docs": [packed(docs[a:b]) for a, b in ab],
                "ids": [ids[a:b].tobytes() for a, b in ab],
                "more": [more[a:b].tobytes() for a, b in ab],
            },
            schema=_ENTRY,
        )


def low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n])


def from_low_bytes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()



class Found:
    """Entries (doc_id, a span's hash) to be sent to their documents' buckets."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.n = buckets, {AGAIN: [], RIM: [], PART: []}, 0

    def add(self, kind: int, docs: np.ndarray, ids: np.ndarray, more: np.ndarray | None = None) -> None:
        if len(docs):
            self.held[kind].append((docs, ids, np.empty((len(docs), 0), np.uint8) if more is None else more))
            self.n += len(docs)

    def flush(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.n > least:
            for kind, some in self.held.items():
                if some:
                    docs, ids, more = (np.concatenate(x) for x in zip(*some))
                    yield from dealt(bucket_of_docs(docs, self.buckets), kind, docs, ids, more)
            self.__init__(self.buckets)


def classes(key: np.ndarray, own: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows whose key isn't alone, by key, own and doc: their order, whether a key begins, whether a span begins, whether the row repeats a smaller document's span."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.empty(0, bool)
    alone = new & np.concatenate((new[1:], [True])) if len(k) else new
    order = order[~alone]
    order = order[np.lexsort((doc[order], own[order], key[order]))]
    k, s, d = key[order], own[order], doc[order]
    new_key = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.empty(0, bool)
    new = new_key | np.concatenate(([True], s[1:] != s[:-1])) if len(k) else new_key
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(k) else d
    return order, new_key, new, d > least


# -- 1: spans meet -------------------------------------------------------------


def cut_spans(buckets: int, most: int) -> Callable:
    """A task's spans: entries (6 bytes of the anchor's hash, doc_id, 8 bytes of the span's) by bucket of anchors, and what the task has settled."""

    def settled(key: np.ndarray, own: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = Found(buckets)
        order, new_key, new, again = classes(key, own, doc)
        found.add(AGAIN, doc[order[again]], own[order[again]])
        send = np.ones(len(key), bool)
        send[order[~new]] = False
        reps, of_key = order[new], (np.cumsum(new_key) - 1)[new]
        wide = np.bincount(of_key, minlength=int(new_key.sum()))[of_key] > most if len(reps) else np.empty(0, bool)
        some = reps[wide]
        found.add(RIM, doc[some], own[some])
        first = some[np.concatenate(([True], of_key[wide][1:] != of_key[wide][:-1]))] if len(some) else some
        send[some] = False
        send[first] = True
        own = own.copy()
        own[first] = 0  # stands for an anchor with many spans
        key, own, doc = key[send], own[send], doc[send]
        yield from dealt(((key >> np.uint64(44)).astype(np.int64) * buckets) >> 20, -1, doc, own, low_bytes(key, 6))
        yield from found.flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if doc is None or len(raw) < LENGTH:
                    continue
                key, own, *_ = spans(raw)
                held.append((key, own, np.full(len(key), doc, np.int64)))
                n += len(key)
                if n >= CHUNK_SPANS:
                    yield from settled(*(np.concatenate(x) for x in zip(*held)))
                    held, n = [], 0
        if held:
            yield from settled(*(np.concatenate(x) for x in zip(*held)))

    return run


def meet(buckets: int) -> Callable:
    """Of rows sorted by kind and bucket: what tasks have settled as it is, and the entries of each bucket of anchors settled."""

    def settled(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        doc, own, key = (np.concatenate(x) for x in zip(*((unpacked(d), np.frombuffer(i, "<u8"), from_low_bytes(m, 6)) for d, i, m in rows)))
        lone_wide = own == 0
        order, new_key, new, again = classes(key, own, doc)
        again &= own[order] != 0
        heads = np.flatnonzero(new_key)
        if not len(heads):
            return (np.empty(0, np.int64), np.empty(0, np.uint64)) * 2
        of_key = np.cumsum(new_key) - 1
        d = doc[order]
        several = np.bincount(of_key[new]) > 1
        several |= np.logical_or.reduceat(lone_wide[order], heads)
        apart = np.minimum.reduceat(d, heads) < np.maximum.reduceat(d, heads)
        rim = order[new & (several & apart)[of_key] & ~lone_wide[order]]
        a = order[again]
        return doc[a], own[a], doc[rim], own[rim]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows, last = Found(buckets), [], None
        for batch in batches:
            for bucket, kind, *row in zip(*(batch[c].to_pylist() for c in ("bucket", "kind", "docs", "ids", "more"))):
                if kind >= 0:
                    found.add(kind, unpacked(row[0]), np.frombuffer(row[1], "<u8"))
                else:
                    if bucket != last and rows:
                        a, b, c, d = settled(rows)
                        found.add(AGAIN, a, b)
                        found.add(RIM, c, d)
                        rows = []
                    rows.append(row)
                    last = bucket
                yield from found.flush(ENTRIES)
        if rows:
            a, b, c, d = settled(rows)
            found.add(AGAIN, a, b)
            found.add(RIM, c, d)
        yield from found.flush()

    return run


# -- documents with their entries ----------------------------------------------


def at_documents(docs: DataFrame, entries: DataFrame, buckets: int, fn: Callable, schema: str) -> DataFrame:
    """Runs fn(rows) where rows yields (doc_id, text, {kind: (ids, more)}) of each document, bucket by bucket."""
    bucket = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(buckets))
    texts = docs.select(
        F.coalesce(bucket, F.pmod(F.xxhash64("text"), F.lit(buckets))).alias("bucket"), F.lit(99).alias("kind"), "doc_id", "text",
        *(F.lit(None).cast("binary").alias(c) for c in ("docs", "ids", "more")),
    )
    rows = entries.select("bucket", "kind", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "docs", "ids", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents() -> Iterator[tuple]:
            now, raw, held, index = None, [], None, {}
            for batch in batches:
                for b, kind, doc, text, *row in zip(*(batch[c].to_pylist() for c in ("bucket", "kind", "doc_id", "text", "docs", "ids", "more"))):
                    if b != now:
                        now, raw, held = b, [], None
                    if kind != 99:
                        raw.append((kind, *row))
                        continue
                    if held is None:
                        held, index = gathered(raw), {}
                        raw = []
                    yield doc, text, {k: (ids[i:j], more[i:j]) for k, (d, ids, more) in held.items() if doc is not None for i, j in [np.searchsorted(d, [doc, doc + 1])] if i < j}

        yield from fn(documents())

    return rows.unionByName(texts).repartition(F.col("bucket")).sortWithinPartitions("bucket", "kind").mapInArrow(run, schema)


def gathered(raw: list[tuple]) -> dict[int, tuple[np.ndarray, ...]]:
    """By kind: docs in order, ids and more."""
    out = {}
    for kind in {r[0] for r in raw}:
        some = [(unpacked(d), np.frombuffer(i, "<u8"), np.frombuffer(m, "<u2").reshape(-1, 2) if m else np.empty((0, 2), np.uint16)) for k, d, i, m in raw if k == kind]
        docs, ids = np.concatenate([s[0] for s in some]), np.concatenate([s[1] for s in some])
        more = np.concatenate([s[2] for s in some]) if kind == PART else np.zeros((len(docs), 2), np.uint16)
        order = np.argsort(docs, kind="stable")
        out[kind] = docs[order], ids[order], more[order]
    return out


# -- 2: what is left is sorted ---------------------------------------------------

SEGMENT = "key long, doc_id long, span long, at int, skipped int, segment binary, done boolean"
_SEGMENT = pa.schema(
    [("key", pa.int64()), ("doc_id", pa.int64()), ("span", pa.int64()), ("at", pa.int32()), ("skipped", pa.int32()), ("segment", pa.binary()), ("done", pa.bool_())]
)


def segments_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """The bytes of the spans that are to be sorted; at: the first window's distance from the first that could hold the anchor."""
    out: list[tuple] = []
    for doc, text, entries in rows:
        if RIM not in entries:
            continue
        raw = (text or "").encode("utf-8", "surrogatepass")
        key, own, start, end, place = spans(raw)
        some = np.flatnonzero(np.isin(own, entries[RIM][0]))
        some = some[np.unique(own[some], return_index=True)[1]]
        for k, s, a, b, p in zip(*(x[some].tolist() for x in (key.view(np.int64), own.view(np.int64), start, end, place))):
            out.append((k, doc, s, REACH - 1 - (p - a), 0, raw[a:b], False))
        if len(out) >= 5_000:
            yield pa.RecordBatch.from_pydict(dict(zip(_SEGMENT.names, map(list, zip(*out)))), schema=_SEGMENT)
            out = []
    if out:
        yield pa.RecordBatch.from_pydict(dict(zip(_SEGMENT.names, map(list, zip(*out)))), schema=_SEGMENT)


def split(width: int) -> Callable:
    """Deals segments out by ``width`` consecutive windows and by the bytes that these have in common; of a task's equal ones the smallest document's stays open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, doc, span, at, skipped, segment in zip(*(batch[c].to_pylist() for c in _SEGMENT.names[:-1])):
                n = len(segment) - LENGTH + 1
                for part in range(at // width, (at + n - 1) // width + 1):
                    i, j = max(0, part * width - at), min(n, (part + 1) * width - at)
                    common = segment[max(0, (part + 1) * width - 1 - at) : part * width + LENGTH - at] if width > 1 else segment[i : i + LENGTH]
                    new = hashlib.blake2b(common, digest_size=8, key=f"{key} {width} {part}".encode()).digest()
                    rows.append((int.from_bytes(new, "little", signed=True), doc, span, at + i, skipped + i, segment[i : j + LENGTH - 1]))
            rows.sort(key=lambda r: (r[0], r[5], r[1]))
            out, before = [], None
            for r in rows:
                same = before is not None and (before[0], before[5]) == (r[0], r[5])
                out.append((*r, same and r[1] > before[1]))
                before = before if same else r
            yield pa.RecordBatch.from_pydict(dict(zip(_SEGMENT.names, map(list, zip(*out)))), schema=_SEGMENT)

    return run


def alike(x: bytes, y: bytes) -> int:
    """The length of the common beginning."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if x[:mid] == y[:mid]:
            low = mid
        else:
            high = mid
    return low


def shared(parts: list[bytes]) -> list[int]:
    """The longest beginning that each has in common with any other."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:]):
        n = alike(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def window_owners(segments: list[bytes], docs: list[int]) -> list[np.ndarray]:
    """By segment and window of LENGTH bytes, the smallest document that holds it, from one suffix array of all."""
    text = b"".join(segments)
    sizes = np.array([len(s) for s in segments])
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(segments)), sizes)
    is_start = np.arange(len(text)) - begins[owner] <= sizes[owner] - LENGTH
    order = np.array(suffix_array(text), np.int64)
    order = order[is_start[order]]
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), LENGTH)[order]
    new = np.concatenate(([True], (windows[1:] != windows[:-1]).any(axis=1)))
    own = np.array(docs, np.int64)[owner[order]]
    least = np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]
    found = np.zeros(len(text), np.int64)
    found[order] = least
    return [found[b : b + s - LENGTH + 1] for b, s in zip(begins.tolist(), sizes.tolist())]


def runs(again: np.ndarray) -> list[tuple[int, int]]:
    """The byte ranges that the windows marked cover."""
    at = np.flatnonzero(again)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > LENGTH)
    return list(zip(at[np.concatenate(([0], gap + 1))].tolist(), (at[np.concatenate((gap, [len(at) - 1]))] + LENGTH).tolist()))


def sort_blocks(buckets: int, block_bytes: int) -> Callable:
    """Covered parts of spans from segments sorted by key and doc_id; a block ends where an anchor ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, parts = Found(buckets), []
        # what is sorted: the bytes, and the spans of their smallest document with the number of bytes before them
        block: list[tuple[bytes, int, list[tuple[int, int]]]] = []
        group: dict[tuple[bytes, int], tuple[int, list[tuple[int, int]]]] = {}
        size, last = 0, None

        def join(to: dict, what: tuple, doc: int, spans: list[tuple[int, int]], whole: int) -> None:
            """Equal bytes at equal places: those of larger documents are covered, the smallest's stay."""
            least, own = to.setdefault(what, (doc, []))
            if doc == least:
                own.extend(spans)
            else:
                parts.extend((doc, span, skipped, skipped + whole) for span, skipped in spans)

        def close() -> None:
            """The group's segments, cut to what they share, join the block."""
            nonlocal size
            if len(group) > 1:
                rows = list(group.items())
                at = [REACH - 1 - r[0][1] for r in rows]
                left = shared([s[:p][::-1] for ((s, _), _), p in zip(rows, at)])
                right = shared([s[p + K :] for ((s, _), _), p in zip(rows, at)])
                cut: dict[tuple[bytes, int], tuple[int, list[tuple[int, int]]]] = {}
                for ((s, _), (doc, spans)), p, x, y in zip(rows, at, left, right):
                    if x + K + y >= LENGTH:
                        join(cut, (s[p - x : p + K + y], x), doc, [(span, skipped + p - x) for span, skipped in spans], x + K + y)
                if len(cut) > 1:
                    for (s, _), (doc, spans) in cut.items():
                        block.append((s, doc, spans))
                        size += len(s)
            group.clear()

        def flush() -> None:
            nonlocal size
            if len({r[1] for r in block}) > 1:
                for (_, doc, spans), owners in zip(block, window_owners([r[0] for r in block], [r[1] for r in block])):
                    parts.extend((doc, span, skipped + a, skipped + b) for a, b in runs(owners < doc) for span, skipped in spans)
            block.clear()
            size = 0

        def send(least: int) -> Iterator[pa.RecordBatch]:
            if len(parts) > least:
                a = np.array(parts, np.int64).reshape(-1, 4)
                found.add(PART, a[:, 0], a[:, 1].copy().view(np.uint64), np.ascontiguousarray(a[:, 2:].astype("<u2")).view(np.uint8))
                parts.clear()
                yield from found.flush()

        for batch in batches:
            for key, doc, span, at, skipped, segment in zip(*(batch[c].to_pylist() for c in _SEGMENT.names[:-1])):
                if key != last:
                    close()
                    if size >= block_bytes:
                        flush()
                    last = key
                join(group, (segment, at), doc, [(span, skipped)], len(segment))
            yield from send(50_000)
        close()
        flush()
        yield from send(0)

    return run


def whole_parts(buckets: int) -> Callable:
    """Segments that their tasks have settled, as covered parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = Found(buckets)
                get = lambda c: batch[c].to_numpy(zero_copy_only=False)  # noqa: B023, E731
                a = get("skipped").astype(np.int64)
                b = a + np.array([len(s) for s in batch["segment"].to_pylist()])
                found.add(PART, get("doc_id"), get("span").view(np.uint64), np.stack((a, b), axis=1).astype("<u2").view(np.uint8))
                yield from found.flush()

    return run


def sorted_parts(segments: DataFrame, buckets: int, scratch: Scratch) -> DataFrame:
    """Entries of all covered parts of spans."""
    out, width = None, REACH
    while True:
        more = segments.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_SPANS).select("key") if width > 1 else None
        n = more.count() if more is not None else 0
        if n:
            more = F.broadcast(more) if n <= BROADCAST_KEYS else more
            large = segments.join(more, "key", "left_semi").select(*_SEGMENT.names)
            segments = segments.join(more, "key", "left_anti").select(*_SEGMENT.names)
        blocks = scratch.write(segments.repartition(F.col("key")).sortWithinPartitions("key", "doc_id").mapInArrow(sort_blocks(buckets, BLOCK_BYTES), ENTRY))
        out = blocks if out is None else out.union(blocks)
        if not n:
            return out
        width = -(-width // 3)
        segments = scratch.write(large.mapInArrow(split(width), SEGMENT))
        out = out.union(segments.where("done").mapInArrow(whole_parts(buckets), ENTRY))
        segments = segments.where("not done")


# -- 3: what stays ---------------------------------------------------------------


def ranges_of(raw: bytes, entries: dict) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the united ranges that a document's entries cover."""
    _, own, start, end, _ = spans(raw)
    a = b = np.empty(0, np.int64)
    if AGAIN in entries:
        some = np.isin(own, entries[AGAIN][0])
        a, b = start[some], end[some]
    if PART in entries:
        ids, more = entries[PART]
        order = np.argsort(own, kind="stable")
        low, high = (np.searchsorted(own[order], ids, side) for side in ("left", "right"))
        row = np.repeat(np.arange(len(ids)), high - low)
        at = start[order[np.repeat(low - np.concatenate(([0], np.cumsum(high - low)[:-1])), high - low) + np.arange(len(row))]] if len(row) else np.empty(0, np.int64)
        a, b = np.concatenate((a, at + more[row, 0])), np.concatenate((b, at + more[row, 1]))
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    return a[new], b[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(b) - 1]))]


def deduplicate(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds what is left, as bytes."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scratch = Scratch(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(BUCKETS[0], 1 << (size // BUCKET_BYTES).bit_length()), BUCKETS[1])
    met = scratch.write(docs.mapInArrow(cut_spans(buckets, WIDE), ENTRY).repartition(F.col("bucket"), F.col("kind")).sortWithinPartitions("kind", "bucket").mapInArrow(meet(buckets), ENTRY))
    segments = scratch.write(at_documents(docs, met.where(F.col("kind") == RIM), buckets, segments_of, SEGMENT))
    parts = scratch.write(sorted_parts(segments, buckets, scratch))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text
    )

    def cleaned(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for doc, text, entries in rows:
            raw = (text or "").encode("utf-8", "surrogatepass")
            a, b = ranges_of(raw, entries) if entries else (np.empty(0, np.int64),) * 2
            kept = b"".join([raw[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(raw)])])
            out.append((doc, len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept)[: len(schema)])
            held += len(kept)
            if len(out) >= 2_000 or (with_text and held >= 1 << 24):
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*out)))), schema=schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*out)))), schema=schema)

    entries = met.where(F.col("kind") == AGAIN).unionByName(parts)
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return scratch.last(at_documents(docs, entries, buckets, cleaned, result))

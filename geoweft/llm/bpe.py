"""Byte-pair encoding and decoding with a public tokenizer file.

A word's symbols form a doubly linked list; a heap holds the merge rank of each
adjacent pair, and an entry whose symbols have changed since it was pushed is
skipped when it is popped. Words repeat, so their codes are kept, within a bound.

Letters and numbers are those of the tokenizers library's Unicode data, which is
asked once a worker; characters that Python's older data doesn't know are
normalised by the library too.

Nulls and empty texts have no tokens and decode to an empty text. Special
tokens written out in a text are recognised, as the tokenizer file asks for.
Repeated rows each get their ids, also under one doc_id or none; further columns
are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import map_task

#: Words, and runs without white space, whose codes a task keeps: this many recent ones, and as many from before.
KEPT_WORDS, KEPT_CHUNKS = 150_000, 300_000
#: Code points whose classes are asked for at once.
SLICE = 1 << 14
#: str.split() also splits at these four, which aren't white space in Unicode's sense.
CONTROL = re.compile("[\x1c-\x1f]")
#: Unicode's white space.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WHITE_SPACE = re.compile(f"[{SPACES}]+")
ID_BITS, POS_BITS = 20, 40
ID_MASK, POS_MASK = (1 << ID_BITS) - 1, (1 << POS_BITS) - 1


def ranges(points: list[tuple[int, int]]) -> str:
    """Ranges of code points, ends included, as they stand inside brackets."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in points)


@functools.cache
def classes() -> dict[str, str]:
    """The marks of character classes in a tokenizer's pattern, and the ranges that they stand for inside brackets."""
    from tokenizers import Regex, pre_tokenizers

    points = [*range(0xD800), *range(0xE000, 0x110000)]
    out = {r"\s": SPACES}
    for mark in (r"\p{L}", r"\p{N}"):
        split, found = pre_tokenizers.Split(Regex(mark + "+"), "removed", invert=True), []
        for i in range(0, len(points), SLICE):
            some = points[i : i + SLICE]
            found += [(some[a], some[b - 1]) for _, (a, b) in split.pre_tokenize_str("".join(map(chr, some)))]
        out[mark] = ranges(found)
    return out


@functools.cache
def unassigned() -> re.Pattern:
    """Characters that Python's Unicode data doesn't know."""
    found: list[list[int]] = []
    for i in range(0x110000):
        if unicodedata.category(chr(i)) == "Cn":
            if found and found[-1][1] == i - 1:
                found[-1][1] = i
            else:
                found.append([i, i])
    return re.compile(f"[{ranges(found)}]")


@functools.cache
def normalizer():
    from tokenizers import normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def folded(text: str) -> str:
    """NFC and lower case. Each character is lower-cased for itself, so a capital sigma never takes its final form."""
    if not text.isascii() and unassigned().search(text):
        return normalizer().normalize_str(text)
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else the next code point from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Recent:
    """A bounded map of recent entries: a full generation becomes the old one, and what is used again moves up."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str) -> tuple[bytes, str] | None:
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key: str, value: tuple[bytes, str]) -> None:
        if len(key) <= 64:
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[key] = value


class WordBpe:
    """Encodes and decodes as the tokenizer file says: NFC, lower case, words split by its pattern, byte letters, word ends."""

    def __init__(self, path: str, kept: float = 1.0):
        """kept: the share of KEPT_WORDS and KEPT_CHUNKS whose codes are kept."""
        self.kept = kept
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end = model.get("end_of_word_suffix") or ""
        #: left and right symbol's ids, packed -> rank and the merged symbol's id, packed
        self.table: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            self.table.setdefault(self.vocab[x] << ID_BITS | self.vocab[y], r << ID_BITS | self.vocab[x + y])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        for mark, chars in classes().items():
            pattern = pattern.replace(mark, chars)
        self.word = re.compile(pattern)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.inner = [self.vocab[x] for x in byte_letters()]
        self.final = [self.vocab[x + self.end] for x in byte_letters()]
        self.forget()

    def merge(self, ids: list[int]) -> list[int]:
        """Applies merges by rank, leftmost first among equals, on a linked list."""
        n, get = len(ids), self.table.get
        heap = []
        for i in range(n - 1):
            t = get(ids[i] << ID_BITS | ids[i + 1])
            if t is not None:
                heap.append(t >> ID_BITS << POS_BITS | i)
        if not heap:
            return ids
        heapq.heapify(heap)
        ids.append(-1)  # the end; dead symbols are -1 too
        after, before = list(range(1, n + 2)), list(range(-1, n))
        while heap:
            top = heapq.heappop(heap)
            i = top & POS_MASK
            if ids[i] < 0 or ids[j := after[i]] < 0:
                continue  # stale
            t = get(ids[i] << ID_BITS | ids[j])
            if t is None or t >> ID_BITS != top >> POS_BITS:
                continue  # stale
            ids[i], ids[j] = t & ID_MASK, -1
            k = after[i] = after[j]
            before[k] = i
            if ids[k] >= 0 and (t := get(ids[i] << ID_BITS | ids[k])) is not None:
                heapq.heappush(heap, t >> ID_BITS << POS_BITS | i)
            k = before[i]
            if k >= 0 and (t := get(ids[k] << ID_BITS | ids[i])) is not None:
                heapq.heappush(heap, t >> ID_BITS << POS_BITS | k)
        return [x for x in ids if x >= 0]

    def word_codes(self, word: str) -> tuple[bytes, str]:
        """A word's ids as bytes and its vocabulary strings, from the kept ones if possible."""
        got = self.words.get(word)
        if got is None:
            raw = word.encode("utf-8", "surrogatepass")
            ids = [self.inner[b] for b in raw]
            ids[-1] = self.final[raw[-1]]
            ids = self.merge(ids)
            got = (np.array(ids, "<u4").tobytes(), " ".join([self.strings[i] for i in ids]))
            self.words.put(word, got)
        return got

    def chunk_codes(self, chunk: str) -> tuple[bytes, str]:
        """The same of a run of characters without white space; words never reach across white space."""
        got = self.chunks.get(chunk)
        if got is None:
            out = []
            for part in self.split_special.split(chunk) if "<" in chunk and self.split_special else [chunk]:
                if part in self.special:
                    out.append((np.array([self.special[part]], "<u4").tobytes(), part))
                elif part:
                    out += map(self.word_codes, self.word.findall(folded(part)))
            got = out[0] if len(out) == 1 else (b"".join([x[0] for x in out]), " ".join([x[1] for x in out]))
            self.chunks.put(chunk, got)
        return got

    def forget(self) -> None:
        """Drops the codes kept."""
        self.words, self.chunks = Recent(int(KEPT_WORDS * self.kept)), Recent(int(KEPT_CHUNKS * self.kept))

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        chunks = text.split() if not CONTROL.search(text) else WHITE_SPACE.split(text)
        return [x for x in map(self.chunk_codes, chunks) if x[0]]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(p[0] for p in self.pieces(text or "")), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Joins vocabulary strings; the tokenizer file names no decoder, so a space stands between them."""
        return " ".join(self.strings[i] for i in ids)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, kept: float = 1.0) -> WordBpe:
    return WordBpe(path, kept)


def encode(docs: DataFrame, path: str, with_ids: bool = False, with_text: bool = False, release: bool = False, kept: float = 1.0) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds the ids, with_text the decoded text.

    For the sake of other stages, workers may drop the tokenizer after each task (release) and keep fewer words' codes meanwhile (kept, a share).
    """

    def encoded(t: WordBpe, batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        for text in batch["text"]:
            p = t.pieces(text or "")
            ids, decoded = b"".join([x[0] for x in p]), " ".join([x[1] for x in p])
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            if with_ids:
                out["ids"].append(np.frombuffer(ids, "<i4"))
            if with_text:
                out["decoded"].append(decoded)
        return out

    def run(rows: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        t = tokenizer(path, kept)
        try:
            for batch in rows:
                yield encoded(t, batch)
        finally:
            t.forget()  # workers go on to other stages
            if release:
                tokenizer.cache_clear()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return map_task(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)

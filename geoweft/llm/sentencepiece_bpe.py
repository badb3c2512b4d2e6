"""Encoding and decoding with a sentencepiece model of the BPE kind, exactly as its library does.

The right encoding is the only sequence of tokens in which every two neighbours
stay as they are when the two are merged anew from characters. It is found by
backtracking: the longest token at a place (by Aho-Corasick over all pieces) is
tried first, then its shorter prefixes; a token must fit the one before it and
end at a place that hasn't failed. The tokens up to a place are those of the text
up to there, so a place that fails once fails for good, which a bit for each
place remembers: a text is encoded in time about linear in its length.

Text is cut where no piece reaches across, so that repeated words are encoded
once, within a bound. Characters that are in no piece become byte tokens.

Nulls and empty texts have no tokens and decode to an empty text. Texts are taken
whole, whatever their length. Repeated rows each get their ids, also under one
doc_id or none; further columns are ignored. Models that normalise by a table of
characters, use other types of pieces or lack bytes raise ValueError.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.bpe import Recent
from geoweft.llm.common import map_task

#: Runs of text, parts of them and pairs of tokens whose outcome a worker keeps: this many recent ones, and as many from before.
KEPT_CHUNKS, KEPT_PARTS, KEPT_PAIRS = 300_000, 200_000, 400_000
SPACE = "▁"
#: Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: More than the bits of a token, so that two make one number.
PAIR_BITS = 22


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The numbered fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[at : at + size]
            at += size


class PieceBpe:
    """A model file's pieces with their scores."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(fields(f.read()))
        trainer, rules = (dict(fields(next((v for k, v in message if k == n), b""))) for n in (2, 3))
        if trainer.get(3, 1) != 2 or rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1) or trainer.get(24):
            raise ValueError("the model must be of the BPE kind, without a table of characters or removal of spaces, with a space put before the text")
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        #: id -> what it decodes to, None for bytes
        self.shown: list[str | None] = []
        self.byte_of: dict[int, int] = {}
        self.unknown = -1
        for i, p in enumerate(dict(fields(v)) for k, v in message if k == 1):
            text, kind = p.get(1, b"").decode(), p.get(3, NORMAL)
            if kind == NORMAL:
                self.ids[text], self.score[text] = i, struct.unpack("<f", p.get(2, bytes(4)))[0]
                self.shown.append(text.replace(SPACE, " "))
            elif kind == BYTE:
                self.byte_of[i] = int(text[3:5], 16)
                self.bytes[self.byte_of[i]] = i
                self.shown.append(None)
            elif kind in (UNKNOWN, CONTROL):
                self.unknown = i if kind == UNKNOWN else self.unknown
                self.shown.append(trainer.get(44, " ⁇ ".encode()).decode() if kind == UNKNOWN else "")
            else:
                raise ValueError(f"pieces of type {kind} aren't known")
        if len(self.bytes) != 256:
            raise ValueError("the model has no piece for each byte")
        #: pieces that merging can make, and what they are. A token is such a piece's id, or a character without a piece as -1 - its code
        self.made = {text: i for text, i in self.ids.items() if len(text) == 1 or len(self.merged(text)) == 1}
        self.string = {i: text for text, i in self.made.items()}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.made.items():
            if len(text) > 1:
                self.automaton.add_word(text, (len(text) - 1, i))
        self.automaton.make_automaton()
        #: neighbours within pieces; a text may be cut between any others
        self.tied = {text[k : k + 2] for text in self.ids for k in range(len(text) - 1)}
        joined = {c for pair in self.tied for c in pair} - {SPACE}
        some = "".join(map(re.escape, sorted(joined)))
        inner = any(pair[1] == SPACE != pair[0] for pair in self.tied)
        #: runs of characters that pieces may tie, with the spaces before; others one by one
        self.cut = re.compile(rf"[{SPACE}{some}]+|[^{SPACE}{some}]" if inner else rf"{SPACE}*[{some}]+|{SPACE}+|[^{SPACE}{some}]")
        #: up to the first place within a run where letters end
        self.letters = re.compile(rf"{SPACE}*[{''.join(re.escape(c) for c in sorted(joined) if c.isalpha())}]+")
        self.lesser: dict[int, int | None] = {}
        self.forget()

    def forget(self) -> None:
        """Drops what is kept of texts."""
        self.chunks, self.parts = Recent(KEPT_CHUNKS), Recent(KEPT_PARTS)
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by merging: the best score first, of equal ones the leftmost."""
        out, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(out) - 1):
                s = score.get(out[k] + out[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return out
            out[at : at + 2] = [out[at] + out[at + 1]]

    def of(self, token: int) -> str:
        return self.string[token] if token >= 0 else chr(-1 - token)

    def shorter(self, token: int) -> int | None:
        """The longest prefix of a token, itself not included, that is a token; a single character always is one."""
        if token not in self.lesser:
            text = self.of(token)
            prefixes = (text[:n] for n in range(len(text) - 1, 0, -1))
            self.lesser[token] = next((self.made.get(p, -1 - ord(p[0])) for p in prefixes if len(p) == 1 or p in self.made), None)
        return self.lesser[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens come out again if their text is merged anew."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        x, y = self.of(a), self.of(b)
        got = self.pairs[(a << PAIR_BITS) + b] = self.merged(x + y) == [x, y]
        return got

    def tokens(self, text: str) -> list[int]:
        """The encoding of a text in which spaces stand as pieces have them."""
        made, string, known = self.made, self.string, self.pairs.get
        if text in made:
            return [made[text]]
        n, longest = len(text), list(map(made.get, text))
        if None in longest:
            longest = [-1 - ord(c) if i is None else i for i, c in zip(longest, text)]
        for end, (before, piece) in self.automaton.iter(text):
            longest[end - before] = piece  # of one start, ends come in order
        failed, any_failed = bytearray(n // 8 + 1), False
        path: list[int] = []
        at, last = 0, None
        token = longest[0] if n else None
        while at < n:
            while token is not None:
                end = at + (len(string[token]) if token >= 0 else 1)
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    if last is None or (self.fits(last, token) if (ok := known((last << PAIR_BITS) + token)) is None else ok):
                        break
                token = self.shorter(token)
            if token is None:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                token = path.pop()
                at -= len(self.of(token))
                token = self.shorter(token)
                last = path[-1] if path else None
            else:
                path.append(token)
                at, last = end, token
                token = longest[at] if at < n else None
        return path

    def part_ids(self, part: str) -> list[int]:
        got = self.parts.get(part)
        if got is None:
            got = self.tokens(part)
            if min(got) < 0:
                got = [i for t in got for i in ([t] if t >= 0 else [self.bytes[b] for b in chr(-1 - t).encode("utf-8", "surrogatepass")])]
            self.parts.put(part, got)
        return got

    def chunk_codes(self, chunk: str) -> tuple[str, int, str]:
        """A chunk's ids as decimal numbers, how many they are, and what they decode to."""
        got = self.chunks.get(chunk)
        if got is None:
            head = self.letters.match(chunk)
            k = head.end() if head else len(chunk)
            if k < len(chunk) and chunk[k - 1 : k + 1] not in self.tied:
                ids = self.part_ids(chunk[:k]) + self.part_ids(chunk[k:])
            else:
                ids = self.part_ids(chunk)
            got = (",".join(map(str, ids)), len(ids), self.text_of(ids))
            self.chunks.put(chunk, got)
        return got

    def codes(self, text: str) -> list[tuple[str, int, str]]:
        """The codes of a text's chunks, the space before the text included."""
        recent = self.chunks.young.get
        return [recent(c) or self.chunk_codes(c) for c in self.cut.findall(SPACE + text.replace(" ", SPACE))] if text else []

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for c in self.codes(text or "") for i in c[0].split(",")]

    def text_of(self, ids: list[int]) -> str:
        """What ids stand for, one after the other; bytes in a row are read as UTF-8, each one that can't be as U+FFFD."""
        shown = [self.shown[i] for i in ids]
        if None not in shown:
            return "".join(shown)
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_read(bytes(raw)))
                raw.clear()
            if i is not None:
                out.append(self.shown[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text without the space that was put before it."""
        first = next((i for i in ids if self.shown[i] != ""), None)
        text = self.text_of(ids)
        return text[1:] if first is not None and first != self.unknown and text.startswith(" ") and self.shown[first] else text


def _read(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that belongs to no character."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> PieceBpe:
    return PieceBpe(path)


def encode(docs: DataFrame, path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256; with_ids adds the ids, with_text the decoded text."""

    def encoded(t: PieceBpe, batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        for text in batch["text"]:
            codes = t.codes(text or "")
            ids, decoded = ",".join([c[0] for c in codes]), "".join([c[2] for c in codes])[1:]
            out["n_tokens"].append(sum([c[1] for c in codes]))
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            if with_ids:
                out["ids"].append(np.array(ids.split(","), "<i4") if ids else np.array([], "<i4"))
            if with_text:
                out["decoded"].append(decoded)
        return out

    def run(rows: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        t = tokenizer(path)
        for batch in rows:
            yield encoded(t, batch)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return map_task(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)

"""Uniform numbers that are a function of a seed and row identity.

They don't depend on partitioning, so a lost and repeated task draws the same.
``portable`` uniforms (md5) can be rebuilt by any SQL engine; ``fast`` ones
(xxhash64) cost a fraction of that.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO52 = float(1 << 52)


def uniform(tag: str, seed: int, *ids: Column | str, fast: bool = False) -> Column:
    """A double in [0, 1) for each combination of ids."""
    cols = [F.col(c) if isinstance(c, str) else c for c in ids]
    if fast:
        return F.shiftrightunsigned(F.xxhash64(F.lit(f"{tag}|{seed}"), *cols), 12).cast("double") / F.lit(TWO52)
    key = F.concat_ws("|", F.lit(tag), F.lit(str(seed)), *(c.cast("string") for c in cols))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(TWO52)


def uniform_sql(tag: str, seed: int, *ids: str) -> str:
    """The portable uniform as DuckDB SQL."""
    parts = ", ".join([f"'{tag}'", f"'{seed}'", *(f"({i})::VARCHAR" for i in ids)])
    return f"(('0x' || substr(md5(concat_ws('|', {parts})), 1, 13))::BIGINT / {int(TWO52)}.0::DOUBLE)"


def portable(tag: str, seed: int, *ids: object) -> float:
    """The portable uniform in Python."""
    return int(hashlib.md5("|".join([tag, str(seed), *map(str, ids)]).encode()).hexdigest()[:13], 16) / TWO52


def fast_row(tag: str, seed: int, row: int, n: int) -> np.ndarray:
    """Uniforms for (row, 0..n-1), made in one go."""
    base = np.uint64(int.from_bytes(hashlib.blake2b(f"{tag}|{seed}|{row}".encode(), digest_size=8).digest(), "little"))
    with np.errstate(over="ignore"):
        x = base + (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(12)).astype(np.float64) / TWO52


#: Numbers that are hashed in one go, those so few that each is hashed by itself, and the longest key that one block of md5 holds.
ROW, FEW, ONE_BLOCK = 1 << 15, 400, 55
_STEPS = [
    (int(abs(math.sin(k + 1)) * (1 << 32)), (k, 5 * k + 1, 3 * k + 5, 7 * k)[k // 16] % 16, ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[k // 16][k % 4])
    for k in range(64)
]


class Decimals:
    """Portable uniforms of many numbers at a time, for keys that differ in one number only: ``head``, the number, ``tail``.

    Numbers are sorted and not negative. What their digits put into a key is worked out once.
    """

    def __init__(self, numbers: np.ndarray):
        self.size, self.runs = len(numbers), []
        at = 0
        while at < len(numbers):
            digits = len(str(int(numbers[at])))
            end = min(int(np.searchsorted(numbers, 10**digits)), at + ROW)
            rest, own = numbers[at:end].copy(), []
            for _ in range(digits):
                own.append((48 + rest % 10).astype(np.uint32))
                rest //= 10
            self.runs.append((at, end, own[::-1], {}, [np.empty(end - at, np.uint32) for _ in range(6)]))
            at = end

    def bits(self, head: str, tail: str = "", count: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, high, low) of runs of the first ``count`` numbers: the first 32 bits of each one's uniform, and the next 20.

        The arrays are overwritten by the next run.
        """
        first, last = head.encode(), tail.encode()
        for start, end, digits, parts, room in self.runs:
            if count is not None and start >= count:
                return
            m = (end if count is None else min(end, count)) - start
            size = len(first) + len(digits) + len(last)
            if size > ONE_BLOCK or m <= FEW:
                keys = (b"".join((first, bytes(int(d[k]) for d in digits), last)) for k in range(m))
                found = np.array([int(hashlib.md5(k).hexdigest()[:13], 16) for k in keys], np.uint64)
                yield start, start + m, (found >> np.uint64(20)).astype(np.uint32), (found & np.uint64((1 << 20) - 1)).astype(np.uint32)
                continue
            words = _plain(first, len(digits), last)
            a, b = _md5(self._words(words, first, digits, parts, m, end - start), [r[:m] for r in room])
            yield start, start + m, a.byteswap(), b.byteswap() >> np.uint32(12)

    @staticmethod
    def _words(words: list, first: bytes, digits: list[np.ndarray], parts: dict, m: int, size: int) -> list:
        """The words of the keys of the first ``m`` numbers of a run of ``size``: those that hold digits are arrays."""
        word, shift = divmod(len(first), 4)
        if shift not in parts:
            made = [np.zeros(size, np.uint32) for _ in range((shift + len(digits) + 3) // 4)]
            for k, d in enumerate(digits):
                made[(shift + k) // 4] |= d << np.uint32(8 * ((shift + k) % 4))
            parts[shift] = made
        for k, part in enumerate(parts[shift]):
            words[word + k] = part[:m] | np.uint32(words[word + k])
        return words

    def uniforms(self, head: str, tail: str = "", count: int | None = None) -> np.ndarray:
        """The uniforms of the first ``count`` numbers."""
        out = np.empty(self.size if count is None else min(count, self.size))
        for start, end, high, low in self.bits(head, tail, count):
            out[start:end] = (high * float(1 << 20) + low) / TWO52
        return out

    def below(self, head: str, tail: str, bound: np.ndarray) -> np.ndarray:
        """Places of the numbers whose uniforms are less than their ``bound``."""
        return self.found(head, tail, bound)[0]

    def found(self, head: str, tail: str, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those of the first numbers, as many as bounds, whose uniforms are less than their ``bound``, and these uniforms."""
        first, last, places, values = head.encode(), tail.encode(), [np.empty(0, np.int64)], [np.empty(0)]
        for start, end, digits, parts, room in self.runs:
            if start >= len(bound):
                break
            most = bound[start:end]
            m = len(most)
            if len(first) + len(digits) + len(last) > ONE_BLOCK or m <= FEW:
                keys = (b"".join((first, bytes(int(d[k]) for d in digits), last)) for k in range(m))
                u = np.array([int(hashlib.md5(k).hexdigest()[:13], 16) for k in keys]) / TWO52
                some = np.arange(m)
            else:
                # the first word of a digest stands after 61 of the 64 steps; only numbers that it doesn't decide go on
                words = self._words(_plain(first, len(digits), last), first, digits, parts, m, end - start)
                state = _stepped(words, [r[:m] for r in room], (*BEGIN, 0), 61)
                high = np.add(state[1], np.uint32(BEGIN[0]), out=room[5][:m]).byteswap(inplace=True)
                some = np.flatnonzero(high <= np.minimum(most * float(1 << 32), float((1 << 32) - 1)).astype(np.uint32))
                own = [w if isinstance(w, int) else w[some] for w in words]
                a, b, *_ = _stepped(own, [np.empty(len(some), np.uint32) for _ in range(6)], (*(r[some] for r in state), 61), 64)
                high, low = (a + np.uint32(BEGIN[0])).byteswap(), (b + np.uint32(BEGIN[1])).byteswap() >> np.uint32(12)
                u = (high * float(1 << 20) + low) / TWO52
            less = u < most[some]
            places.append(some[less] + start)
            values.append(u[less])
        return np.concatenate(places), np.concatenate(values)


BEGIN = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476
#: The shifts and the sines of the steps as arrays without an axis, which cost less to pass than numbers.
_SHIFTS = [(np.array(s, np.uint32), np.array(32 - s, np.uint32)) for _, _, s in _STEPS]
_SINES = [np.array(sine, np.uint32) for sine, _, _ in _STEPS]


def _plain(first: bytes, digits: int, last: bytes) -> list:
    """The words of a key of one block, its digits left out."""
    size = len(first) + digits + len(last)
    plain = (first + bytes(digits) + last + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little")
    return [int.from_bytes(plain[k : k + 4], "little") for k in range(0, 64, 4)]


def _md5(words: list, room: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests of messages of one block; ``words`` are numbers or arrays of them."""
    a, b, *_ = _stepped(words, room, (*BEGIN, 0), 64)
    return np.add(a, np.uint32(BEGIN[0]), out=a), np.add(b, np.uint32(BEGIN[1]), out=b)


def _stepped(words: list, room: list[np.ndarray], state: tuple, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, c, d) after the steps up to ``end``, from ``state`` (a, b, c, d, the next step), in the first four arrays of ``room``."""
    *now, k = state
    full = 0xFFFFFFFF
    while k < 16 and k < end and isinstance(now[0], int) and isinstance(words[k], int):  # what all keys begin with is worked out once
        (sine, _, s), (a, b, c, d) = _STEPS[k], now
        a = (a + (d ^ (b & (c ^ d))) + sine + words[k]) & full
        now, k = [d, (((a << s) | (a >> (32 - s))) + b) & full, b, c], k + 1
    a, b, c, d, f, t = room[:6]
    for r, v in zip((a, b, c, d), now):
        r[...] = v
    xor, and_, add, or_, left, right = np.bitwise_xor, np.bitwise_and, np.add, np.bitwise_or, np.left_shift, np.right_shift
    for k in range(k, end):
        if k < 16:
            xor(c, d, f)
            and_(f, b, f)
            xor(f, d, f)
        elif k < 32:
            xor(b, c, f)
            and_(f, d, f)
            xor(f, c, f)
        elif k < 48:
            xor(b, c, f)
            xor(f, d, f)
        else:
            np.invert(d, f)
            or_(f, b, f)
            xor(f, c, f)
        add(a, f, a)
        sine, g, _ = _STEPS[k]
        word = words[g]
        if isinstance(word, int):
            add(a, np.array((sine + word) & full, np.uint32) if word else _SINES[k], a)
        else:
            add(a, _SINES[k], a)
            add(a, word, a)
        up, down = _SHIFTS[k]
        left(a, up, t)
        right(a, down, a)
        or_(a, t, a)
        add(a, b, a)
        a, b, c, d = d, a, b, c
    return a, b, c, d

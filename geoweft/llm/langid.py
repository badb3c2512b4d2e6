"""Language identification with bit-sliced Bloom filters over character n-grams.

Slot ``i`` of the filter holds a bit mask of languages, so one look-up of an
n-gram (the AND of its slots) returns every language whose model holds it. Masks
are as many words of 64 bits as the languages need. A text's score for a language
is the share of its n-grams found there, corrected for the share that its filter
finds by chance; the largest share decides.

A language's model is every n-gram of its rows in a bounded sample of labelled
rows (``sample`` rows a language). The filter grows with what it holds: BITS slots
an n-gram. Null or letterless texts get ``und`` and score 0, as do all texts when
nothing is labelled; empty tables give none. Ties go to the language with more
labelled rows, then to its name. Repeated rows each get their answer, null doc_ids
are kept, further columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import map_columns

SAMPLE = 3000
#: Slots for each n-gram of the language that has most of them: the filter grows with what it holds, which the sample bounds.
BITS = 8
HASHES = 3
LENGTHS = (2, 3, 4)


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def ngrams(text: str) -> np.ndarray:
    """64-bit codes of a text's n-grams: lower case, each run of other characters as one blank, blanks at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _is_letter()[points]
    points = np.where(letters, points, 32)
    points = np.concatenate(([32], points, [32])).astype(np.uint64)
    blank = points == 32
    points = points[~(blank & np.concatenate(([False], blank[:-1])))]
    out = []
    with np.errstate(over="ignore"):
        for n in LENGTHS:
            if len(points) >= n:
                h = np.full(len(points) - n + 1, n, np.uint64)
                for k in range(n):
                    h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                out.append(h)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def slots(codes: np.ndarray, n_slots: int, hashes: int = HASHES) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        a, b = codes * np.uint64(0xD6E8FEB86659FD93), (codes ^ (codes >> np.uint64(32))) * np.uint64(0xCA5A826395121157)
        return [((a + np.uint64(k) * (b | np.uint64(1))) >> np.uint64(20)) % np.uint64(n_slots) for k in range(hashes)]


class BitSliced:
    """masks[w][i] has, of languages 64 w to 64 w + 63, those that set slot i; chance[l] is the rate at which language l's filter finds any n-gram."""

    def __init__(self, languages: list[str], codes: list[np.ndarray], n_slots: int | None = None, hashes: int = HASHES):
        self.languages, self.hashes = languages, hashes
        largest = max(map(len, codes), default=0)
        self.n_slots = n_slots or 1 << max(16, (BITS * largest).bit_length())
        self.masks = np.zeros((-(-len(languages) // 64), self.n_slots), np.uint64)
        self.chance = np.zeros(len(languages))
        for k, own in enumerate(codes):
            word, bit = self.masks[k // 64], np.uint64(1 << k % 64)
            for s in slots(own, self.n_slots, hashes):
                word[s] |= bit
            self.chance[k] = np.mean(word & bit != 0) ** hashes

    def query(self, codes: np.ndarray) -> np.ndarray:
        """The mask words (rows) of languages of each n-gram."""
        found = np.full((len(self.masks), len(codes)), np.iinfo(np.uint64).max, np.uint64)
        for s in slots(codes, self.n_slots, self.hashes):
            found &= self.masks[:, s]
        return found

    def holding(self, codes: np.ndarray) -> list[list[str]]:
        """All languages that hold each n-gram, chance hits among them."""
        found = self.query(codes)
        return [[x for k, x in enumerate(self.languages) if int(found[k // 64, i]) >> k % 64 & 1] for i in range(len(codes))]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        codes = ngrams(text)
        found = self.query(codes)
        hits = [np.count_nonzero(found[k // 64] & np.uint64(1 << k % 64)) for k in range(len(self.languages))]
        share = np.array(hits) / max(1, len(codes))
        share = np.clip((share - self.chance) / np.maximum(1e-9, 1 - self.chance), 0, 1)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best])


def learn(labelled: DataFrame, sample: int = SAMPLE) -> BitSliced:
    """Fits the filter to (doc_id, text, lang). The driver gets a row count and the n-grams of about ``sample`` rows for each language."""
    labelled = labelled.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")).where("lang is not null and text is not null")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    if not counts:
        return BitSliced([], [])
    rate = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(sample / r["n"]))))
    pick = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) < F.element_at(rate, F.col("lang")) * F.lit(float(1 << 30))

    def count(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"lang": [], "gram": []}
        by: dict[str, list] = {}
        for lang, text in zip(batch["lang"], batch["text"]):
            by.setdefault(lang, []).append(ngrams(text))
        for lang, parts in by.items():
            g = np.unique(np.concatenate(parts))
            out["lang"] += [lang] * len(g)
            out["gram"] += g.view(np.int64).tolist()
        return out

    grams = map_columns(labelled.where(pick).select("lang", "text"), count, "lang string, gram long")
    best = grams.select("lang", "gram").distinct().toPandas()
    by = {x: part.gram.to_numpy(np.int64).view(np.uint64) for x, part in best.groupby("lang")}
    languages = [r["lang"] for r in counts]
    return BitSliced(languages, [by.get(x, np.empty(0, np.uint64)) for x in languages])


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: BitSliced) -> DataFrame:
    """doc_id, lang_pred, score. The model takes 8 bytes a slot and 64 languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: dict[str, list]) -> dict[str, list]:
        m = shared.value
        got = [m.predict(t) for t in batch["text"]]
        return {"doc_id": batch["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return map_columns(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, lang_pred string, score double")

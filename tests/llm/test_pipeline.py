"""The corpus pipeline, stage by stage and as a whole, held against brute force on small tables with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from geoweft.llm import bpe, decontam, quality
from geoweft.llm.queries import vocabulary_path
from geoweft.llm.shingles import shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n))


ITEMS = [(k, prose(500 + k, 25)) for k in range(3)] + [(9, None)]
BASE = prose(1, 120)
TEXTS = [
    (0, BASE), (1, BASE), (2, BASE + " one more"), (3, prose(2, 100)), (3, prose(2, 100)), (3, prose(3, 100)), (None, prose(4, 100)), (None, prose(4, 100)), (None, BASE + " end"), (5, None),
    (6, ""), (7, "too short"), (8, "again and again " * 60), (9, prose(5, 60) + " " + ITEMS[1][1] + " " + prose(6, 40)), (None, ITEMS[2][1] + " " + prose(7, 60)),
    (10, prose(8, 70) + " write to some.one@corp.example.com or +1 (017) 555-7713"), (11, "#### $$$$ " * 40), (12, prose(9, 60) + " 10.1.2.3"),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, "clash") for i, t in TEXTS], SCHEMA)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def kept_by_rules(texts):
    mask = quality.POLICIES[quality.CURRENT] | quality.POLICIES["base", 1]
    out = []
    for i, t in texts:
        m = dict(zip(quality.MEASURES, quality.measure(t)))
        if not sum(bool(r.fails(m)) << r.bit for r in quality.RULES) & mask:
            out.append((i, t))
    return out


def one_of_each(texts):
    """One row of each component of texts with a similarity of 0.8 on five words: of the smallest id."""
    sets = [set(shingle_set(t, 5).tolist()) for _, t in texts]
    above = list(range(len(texts)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                above[top(i)] = top(j)
    best = {}
    for k, (i, t) in enumerate(texts):
        best[top(k)] = min(best.get(top(k), (True, 0, "")), (i is None, i or 0, t)) if top(k) in best else (i is None, i or 0, t)
    return [(None if none else i, t) for none, i, t in best.values()]


def uncontaminated(texts):
    out = []
    for i, t in texts:
        own, leak = decontam.tokens(t), False
        for _, u in ITEMS:
            want = decontam.tokens(u)
            for d in range(-len(want), len(own)):
                a, b = max(0, d), min(len(own), d + len(want))
                leak |= b > a and decontam.overlap(own[a:b] == want[a - d : b - d], len(want))[2] >= decontam.needed(len(want))
        if not leak:
            out.append((i, t))
    return out


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    want = TEXTS
    for (name, stage), brute in zip(pipeline.STAGES, (kept_by_rules, one_of_each, uncontaminated)):
        docs, want = stage(spark, docs, tables), brute(want)
        assert rows(docs) == sorted(want, key=repr), name
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert len(want) >= 5 and any(i is None for i, _ in want)
    clean = pipeline.personal_data(spark, docs, tables)
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"]) and not re.search(r"@|555-|10\\.1", r["text"])
    assert clean.count() == len(want)


def test_run(spark, tables):
    out = pipeline.run(spark, tables)
    kept = uncontaminated(one_of_each(kept_by_rules(TEXTS)))
    got = out.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in kept)
    whole = {t for _, t in kept}
    tokenizer = bpe.tokenizer(vocabulary_path())
    plain = {hashlib.sha256(np.array(tokenizer.encode(t), "<u4").tobytes()).hexdigest() for t in whole}
    assert sum(r["ids_sha256"] in plain for r in got) >= len(got) - 3  # all but those that held personal data
    assert all(len(r["ids"]) == r["n_tokens"] and hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() == r["ids_sha256"] for r in got)


def test_run_over_nothing(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_many_copies(spark, tables):
    """A group of copies and near copies that is most of the table leaves one row."""
    docs = spark.createDataFrame([(k, BASE + (f" w{k % 7}" if k % 2 else ""), "en", "s", 0, "") for k in range(400)], SCHEMA).withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id")))
    assert [r["doc_id"] for r in pipeline.near_dedup(spark, docs, tables).collect()] == [1]

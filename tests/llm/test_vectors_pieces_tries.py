"""Whitening, sentencepiece encoding and the trie of prefixes, held against plain versions of the same, on small tables with odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoweft.llm import queries, sentencepiece_bpe, trie, whitening

MODEL = queries.vocabulary_path(queries.PIECES)
PIECES = sentencepiece_bpe.tokenizer(MODEL)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


# -- sentencepiece -------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40) | st.text("  ▁ etaoinshr\n\té😀ﬁ①the in er あ漢\0<>/s01", max_size=60) | st.lists(st.sampled_from(sorted(PIECES.ids)), max_size=8).map("".join))
def test_pieces_are_the_library(text):
    import sentencepiece

    lib = test_pieces_are_the_library.__dict__.setdefault("lib", sentencepiece.SentencePieceProcessor(model_file=MODEL))
    want = lib.encode(text)
    assert PIECES.encode(text) == want
    assert PIECES.decode(want) == lib.decode(want) == "".join(c[2] for c in PIECES.codes(text))[1:]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 262), max_size=10))
def test_any_ids_decode_as_in_the_library(ids):
    import sentencepiece

    lib = test_any_ids_decode_as_in_the_library.__dict__.setdefault("lib", sentencepiece.SentencePieceProcessor(model_file=MODEL))
    assert PIECES.decode(ids) == lib.decode(ids)


def test_backtracking_returns_from_failed_places():
    """Pieces of our own: the longest match first leads astray, at every place anew, and time stays linear."""
    t = sentencepiece_bpe.PieceBpe(MODEL)
    names = ["a", "b", "c", "ab", "bc", "abc", "aa", "aab"]
    t.ids, t.score = {n: i for i, n in enumerate(names)}, dict(zip(names, (-10.0, -11, -12, -3, -1, -9, -4, -5)))
    t.made = {n: i for n, i in t.ids.items() if len(n) == 1 or len(t.merged(n)) == 1}
    t.string = {i: n for n, i in t.made.items()}
    t.automaton = sentencepiece_bpe.ahocorasick.Automaton()
    for n, i in t.made.items():
        if len(n) > 1:
            t.automaton.add_word(n, (len(n) - 1, i))
    t.automaton.make_automaton()
    rng = random.Random(3)
    for n in [*range(1, 30), 300]:
        for _ in range(20):
            text = "".join(rng.choice("aabbc") for _ in range(n))
            assert [t.of(x) for x in t.tokens(text)] == t.merged(text), text
    assert sum(len(t.of(x)) for x in t.tokens("aab" * 50_000)) == 150_000


def test_pieces_of_odd_rows(spark, library):
    texts = [None, "", " ", "\n", "a", "  a  b ", "é😀", "x" * 70_000, " " * 5000 + "y", "words and words " * 9000, "same", "same"]
    rows = [(None if i == 3 else min(i, 10), t, "clashing", "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string").repartition(3)
    got = sentencepiece_bpe.encode(docs, MODEL, with_ids=True, with_text=True).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), ids, library.decode(ids)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sentencepiece_bpe.encode(docs.limit(0), MODEL).isEmpty()


# -- whitening -----------------------------------------------------------------


def whitened(rows, size):
    """By numpy: id -> (n, deviation, whitened, explained)."""
    whole = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in whole}), dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    centred = (n * fit - total).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in whole:
        d = n * np.array(x, dtype=object) - total
        out.append((i, n, int((d * d).sum()), d.astype(float) / n @ vectors[:, :16] / np.sqrt(values[:16]), values[:16] / values.sum()))
    return out


def test_whitening_is_that_of_distinct_vectors(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(20, 20))
    rows = [(k, (rng.normal(size=20) @ mix).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[0][1]) for k in range(200)] + [(5, rows[5][1]), (None, rows[6][1])]
    odd = [(2000, None), (2001, []), (2002, [float("nan")] * 20), (2003, [float("inf"), *[0.0] * 19]), (2004, [None, *[0.0] * 19]), (2005, [1.0, 2.0]), (2006, [1e30] * 20)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, component int, w string").repartition(4)
    got = whitening.whiten(df).toPandas()
    want = whitened(rows, 20)
    assert len(got) == 16 * len(rows) and got.n.eq(300).all() and got.identity_error.max() < 1e-9
    first = got[got.vec_id == 7].set_index("component").whitened
    sign = np.sign([first[k + 1] * next(w for w in want if w[0] == 7)[3][k] for k in range(16)])
    table = {(None if i != i else int(i), c): (d, w, e) for i, c, d, w, e in got[["vec_id", "component", "deviation", "whitened", "explained"]].itertuples(index=False)}
    for i, _, deviation, w, explained in want:
        for k in range(16):
            d, x, e = table[i, k + 1]
            assert d == deviation and abs(x - sign[k] * w[k]) < 1e-8 and abs(e - explained[k]) < 1e-10


def test_whitening_of_flat_and_few_vectors(spark):
    make = lambda vectors: whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>"))
    assert make([[1.0, 2.0]] * 3).where("whitened is null and explained is null and identity_error is null and n = 1 and deviation = 0").count() == 6
    line = make([[float(k), 2.0 * k, 0.0] for k in range(5)]).toPandas()  # one direction only
    assert set(line.component) == {1, 2, 3} and line[line.component > 1].whitened.isna().all() and abs(line[line.component == 1].whitened.pow(2).mean() - 1) < 1e-9
    assert line.identity_error.max() < 1e-9 and abs(line[line.component == 1].explained.iloc[0] - 1) < 1e-9
    far = make([[1e15, 0.0], [-1e15, 1.0], [1e15, 0.0]])
    assert far.where("deviation is null").count() == 6 and far.where("whitened is null").count() == 3  # two points have one direction
    empty = make([[1.0]]).limit(0)
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).dtypes == empty.dtypes


# -- the trie ------------------------------------------------------------------


def trie_of(rows):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node, by dictionaries of whole prefixes."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    own = {c: [v[3:] for v in sorted(o)] for c, o in own.items()}
    members, whole = defaultdict(list), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(first, [])[:h] + turns[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, below = [], {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(below[k][0] for k in children[p]) or 1
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(below[k][1] for k in children[p])
        below[p] = (leaves, saved)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(whole[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string, key string, depth string"


def as_table(spark, rows):
    return spark.createDataFrame([(*r, "clashing", "x") for r in rows], TURNS).repartition(5)


def test_trie_of_odd_rows(spark):
    rng = random.Random(1)
    rows = []
    for c in [*range(40), 100, 101, 102, 205, -3, -100, -105, None]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["u", None, "a"]), rng.choice(["x", "x", "x", None, "é😀"])))
    rows += rows[:10]
    assert sorted((tuple(r) for r in trie.prefix_trie(as_table(spark, rows)).collect()), key=repr) == trie_of(rows)
    assert trie.prefix_trie(as_table(spark, rows).limit(0)).isEmpty()
    assert trie.prefix_trie(as_table(spark, [(None, 1, "u", "x")])).isEmpty()
    assert [tuple(r) for r in trie.prefix_trie(as_table(spark, [(7, 1, "u", "x")])).collect()] == trie_of([(7, 1, "u", "x")])


def test_trie_of_a_conversation_over_many_tasks(spark, monkeypatch):
    """Two conversations hold most rows, and a third of the others are copies: each is read by several tasks, and so are the ends of one node."""
    monkeypatch.setattr(trie, "ENDS", 16)
    rows = [(c, k, "u", "same" if k < 900 else str(c)) for c in (7, 107) for k in range(1500)]
    rows += [(c, k, "u", "hello" * (k + 1)) for c in range(200, 290) for k in range(3)]
    rows += [(c, k, "u", f"{c % 11} {k}") for c in range(300, 360) for k in range(c % 5 + 1)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = trie.prefix_trie(as_table(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got), key=repr) == trie_of(rows)


def test_states_join_as_they_step():
    rng = random.Random(2)
    rows = [{"digest": rng.randbytes(16), "light": k == 0 or rng.random() < 0.3, "key": bytes([k]), "leaf": 1, "weight": k} for k in range(40)]
    for scan in (trie.PREFIXES, trie.PATHS, trie.SUMS):
        for a in range(0, 40, 7):
            whole, first, second = scan.start, scan.start, scan.start
            for k, r in enumerate(rows):
                whole = scan.step(whole, r)
                first, second = (scan.step(first, r), second) if k < a else (first, scan.step(second, r))
            assert scan.join(first, second) == whole


def test_digests_of_the_query(spark):
    got = queries.op13_prefix_trie(spark, "/root/testdata/sf0.001").agg(F.count("*"), F.count_distinct("conv_id", "depth"), F.max("n_convs")).first()
    assert got[0] == got[1] and got[2] > 1

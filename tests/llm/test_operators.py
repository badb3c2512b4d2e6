"""Training-data operators held against brute force, on small tables with odd rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoweft.llm import bpe, common, components, decontam, extract, langid, licenses, neardup, pii, quality, repeats, warc
from geoweft.llm.htmltree import visible_text
from geoweft.llm.queries import vocabulary_path
from geoweft.llm.shingles import shingle_set
from geoweft.llm.suffixes import suffix_array

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ranges string"
ODD = [None, "", " ", "\n\n", "a", "a b", "é ü ß", "😀 a@b.co 😀", "x" * 3000, "word " * 400]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 200)
    words = base.split()
    near = [" ".join(w if i != 7 * k + 3 else "changed" for i, w in enumerate(words)) for k in range(8)]
    texts = [*ODD, base, base, *near, prose(2, 150), prose(3, 60) + " " + base[:400], base[300:] + " " + prose(4, 70), prose(5, 90)]
    rows = [(i, t, "en", "s", len(t or ""), "clashing") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3).persist()


def texts_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_quality_bits_policies_and_ablation(docs, spark):
    rows = quality.verdicts(quality.ledger(docs)).toPandas().set_index("doc_id")
    for i, t in texts_of(docs).items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = defaultdict(list)
        for k in range(len(words) - 2):
            grams[tuple(words[k : k + 3])].append(k)
        covered = {k + d for v in grams.values() if len(v) > 1 for k in v for d in range(3)}
        assert (rows.n_words[i], rows.word_chars[i], rows.n_repeat_words[i]) == (len(words), sum(map(len, words)), len(covered))
        assert rows.base_failed[i] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (rows.kept[i] and rows.base_failed[i])
    kept = {r["doc_id"] for r in quality.keep_documents(docs).collect()}
    assert kept == set(rows.index[rows.kept])
    out = quality.ablation(quality.ledger(docs)).toPandas().set_index("rule")
    mask = quality.POLICIES[quality.CURRENT]
    for name, bit in quality.BITS.items():
        if mask & bit:
            assert out.n_kept_without[name] == sum((b & mask & ~bit) == 0 for b in rows.fail_bits)
    assert quality.ledger(docs.limit(0)).isEmpty()


TOKENIZER = bpe.tokenizer(vocabulary_path())


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40) | st.text("\u1c89\ua7cb\ua7da\U000105c0\U000105d2\u0307\U00010d50\U00011f5a\u0897Aa1 ", max_size=12) | st.text("abc'sdtreΣİ́ \x1c\x85<|endoftext>", max_size=40))
def test_bpe_is_the_library(text):
    from tokenizers import Tokenizer

    lib = test_bpe_is_the_library.__dict__.setdefault("lib", Tokenizer.from_file(vocabulary_path()))
    want = lib.encode(text, add_special_tokens=False).ids
    assert TOKENIZER.encode(text) == want
    assert TOKENIZER.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_bpe_knows_every_character():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 50_000):
        texts = [f"a{c}b1{c}" for c in chars[i : i + 50_000]]
        want = lib.encode_batch(texts, add_special_tokens=False)
        bad = [t for t, w in zip(texts, want) if TOKENIZER.encode(t) != w.ids]
        assert not bad


def test_bpe_query(docs):
    rows = {r["doc_id"]: r for r in bpe.encode(docs, vocabulary_path(), with_ids=True, with_text=True).collect()}
    for i, t in texts_of(docs).items():
        ids = TOKENIZER.encode(t)
        assert rows[i]["ids"] == ids and rows[i]["decoded"] == TOKENIZER.decode(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def linked_components(texts, width, percent):
    sets = {i: set(shingle_set(t, width).tolist()) for i, t in texts.items()}
    above = {i: i for i in sets}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                above[b] = a
    return {i: top(i) for i in sets}


@pytest.mark.parametrize(("small", "part"), [(32, 1000), (2, 2)])
def test_near_duplicates(docs, monkeypatch, small, part):
    """Also with every group taken for a large one, every hub dealt out in parts, and every table too large to broadcast."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "PART", part)
    monkeypatch.setattr(neardup, "MANY", part)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 200_000 if part > 2 else 0)
    rows = {r["doc_id"]: r for r in neardup.near_duplicates(docs, 3, 85).collect()}
    want = linked_components(texts_of(docs), 3, 85)
    assert {i: r["component_id"] for i, r in rows.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in rows.items())


def test_near_duplicates_of_odd_rows(spark):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(3, a), (3, a), (5, a + " end"), (None, a), (3, b), (None, b + " end"), (None, "only here " + prose(9, 30)), (None, "only here " + prose(9, 30)), (7, None), (7, ""), (None, None), (8, "x"), (8, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(1), "digest": F.lit("z"), "kept": F.monotonically_increasing_id()})
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, 3, 85).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(
        [(3, 78, 3, True)] * 3 + [(5, 79, 3, False), (None, 78, 3, False), (None, 79, 3, False)] + [(None, 30, None, True)] * 2 + [(7, 0, 7, True)] * 2 + [(None, 0, None, True)] + [(8, 1, 8, True)] * 2, key=key
    )
    kept = neardup.keep_one(df, 3, 85)
    assert kept.columns == df.columns
    left = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=lambda r: (r[0] or 0, r[1] or ""))
    assert left == sorted([(3, a), (3, b), (7, None), (7, ""), (None, rows[6][1]), (None, None), (8, "x"), (8, "x y")], key=lambda r: (r[0] or 0, r[1] or ""))
    assert neardup.near_duplicates(df.limit(0)).isEmpty() and neardup.keep_one(df.limit(0)).isEmpty()


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    for n, common in ((40, 34), (500, 450), (3000, 1500)):
        x = rng.integers(0, 2**64, n + n - common, np.uint64)
        a, b = x[:n], np.concatenate((x[:common], x[n:]))
        j = common / (2 * n - common)
        got, k = neardup.estimate(neardup.registers(a).ravel(), neardup.registers(b).ravel(), n, n)
        assert k == neardup.BANDS * neardup.BUCKETS or n < 100
        assert abs(got - j) < 5 * (j * (1 - j) / k) ** 0.5


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(edges, common.Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_language(spark):
    rng = random.Random(0)
    letters = {"xx": "abcde", "yy": "cdefg"}
    text = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(40))
    rows = [(i, text("xx" if i % 2 else "yy"), "xx" if i % 2 else "yy") for i in range(200)] + [(900, None, None), (901, "123 !!", "xx"), (902, "", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df.where(~langid.held_out(df.doc_id)))
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:200])
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(r["lang_pred"] == "und" for r in langid.identify(df, langid.learn(df.limit(0))).collect())
    codes = langid.ngrams("abcde")
    model = langid.BitSliced(["a", "b"], [codes, codes[:2]])
    assert all(set(x) == {"a", "b"} for x in model.holding(codes[:2])) and all("a" in x for x in model.holding(codes))


def test_many_languages(spark):
    """More languages than a mask word has bits, each with letters of its own; the filters hold what a set would."""
    letters = [chr(0x4E00 + 7 * k) + chr(0x4E01 + 7 * k) + "e" for k in range(70)]
    rng = random.Random(4)
    rows = [(70 * i + k, " ".join("".join(rng.choice(own) for _ in range(6)) for _ in range(30)), f"l{k:02}") for k, own in enumerate(letters) for i in range(6)]
    df = spark.createDataFrame([*rows, rows[0], (None, rows[1][1], "l00")], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    train = df.where(~langid.held_out(df.doc_id))
    model = langid.learn(train)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(df, model).collect()]
    lang = {i: x for i, _, x in rows} | {None: "l00"}
    assert len(got) == len(rows) + 2 and all(p == lang[i] for i, p in got)
    sets = defaultdict(set)
    for r in train.collect():
        sets[r["lang"]] |= set(langid.ngrams(r["text"]).tolist())
    some = langid.ngrams(rows[5][1])
    for code, found in zip(some.tolist(), model.holding(some)):
        assert {x for x, s in sets.items() if code in s} <= set(found)


def brute_leaks(texts, items):
    """Every diagonal of every pair, whether a seed hits there or not."""
    out = set()
    for i, t in texts:
        own = decontam.tokens(t)
        for k, u in items:
            want = decontam.tokens(u)
            best = 0
            for d in range(-len(want), len(own)) if len(want) >= decontam.SHORTEST else ():
                a, b = max(0, d), min(len(own), d + len(want))
                if b > a:
                    best = max(best, decontam.overlap(own[a:b] == want[a - d : b - d], len(want))[2])
            if best and best >= decontam.needed(len(want)) or 0 < len(want) < decontam.SHORTEST and len(own) == len(want) and (own == want).all():
                out.add((i, k))
    return out


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", most)
    rng = random.Random(3)
    items = [(k, prose(50 + k, 30)) for k in range(5)] + [(7, "tiny item"), (8, None), (9, ""), (None, prose(59, 40)), (10, prose(60, 12)), (11, prose(61, 8)), (12, "The"), (13, "more of a tiny item here"), (4, prose(54, 30))]
    spoilt = [w if rng.random() > 0.12 else "zz" for w in items[0][1].split()]
    one = lambda text, k: " ".join("zz" if j == k else w for j, w in enumerate(text.split()))
    rows = [
        (1, prose(90, 50) + " " + items[1][1].upper() + ". " + prose(91, 20)), (2, " ".join(spoilt)), (3, prose(92, 300)), (4, None), (5, ""), (6, "a tiny item here!"),
        (7, items[2][1][: len(items[2][1]) // 4]), (None, "x " + items[8][1]), (8, "well, " + one(items[9][1], 5) + " then"), (9, one(items[10][1], 3)), (9, "nothing of that"), (10, items[4][1]), (10, items[4][1]), (11, "Tiny, item!"), (12, "the"), (12, "the"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "h": F.lit("x"), "item_id": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("codes", F.lit(1))
    got = [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench).collect()]
    assert set(got) == brute_leaks(rows, items) == {(1, 1), (2, 0), (None, None), (8, 10), (9, 11), (10, 4), (11, 7), (12, 12)} and len(got) == 5 + 4 + 3
    kept = decontam.without_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(((r[0], r[1]) for r in kept.collect()), key=repr) == sorted([r for r in rows if r[0] in (3, 4, 5, 6, 7) or r[1] == "nothing of that"], key=repr)
    assert decontam.contaminated(df, bench.limit(0)).isEmpty() and decontam.contaminated(df.limit(0), bench).isEmpty()


def test_any_one_substitution_is_tolerated():
    for n in range(decontam.SHORTEST, 40):
        codes = np.arange(1, n + 1, dtype=np.uint64)
        for k in range(n):
            other = codes.copy()
            other[k] = 0
            assert any((decontam.seed_hashes(codes, m) == decontam.seed_hashes(other, m)).any() for m in decontam.masks_for(n)), (n, k)
            assert decontam.overlap(codes == other, n)[2] >= decontam.needed(n) or n == decontam.LONG


def test_a_header_that_many_items_and_texts_share(spark):
    head = prose(5, 8)
    items = [(k, f"{head} {prose(100 + k, 20)}") for k in range(300)]
    rows = [(k, f"{head} {prose(900 + k, 40)}") for k in range(200)] + [(1000, items[7][1])]
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert [(r["doc_id"], r["item_id"]) for r in got.collect()] == [(1000, 7)]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            luhn = sum(c if k % 2 == 0 else sum(divmod(2 * c, 10)) for k, c in enumerate(reversed(d))) % 10 == 0
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255) or (kind == "card" and not (12 <= len(d) <= 19 and luhn)) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_personal_data(spark):
    rng = random.Random(9)
    odd = ["a@b.c_d@e.f a@b.c@d.e x..y@z.q.w. 1.2.3.4.5 300.1.1.1 0255.001.2.3 4111 1111-1111 1111 +1 (017) 555-7713", "1" * 2000 + "a" * 2000 + "@b" + ".c" * 900, "+1" + "(" * 99 + "+12345678901", "😀 é a@b.co 10.0.0.1"]
    odd += ["".join(rng.choice("ab@. +-()0123456789") for _ in range(200)) for _ in range(60)]
    shared = [f"text number {w} of many. Write to zelda quixby at zq@corp.example.com or call now" for w in ("one", "two", "six")]
    rows = list(enumerate([None, "", *odd, *shared, *(f"write to the text or call of now {k}" for k in range(400))]))
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.report(pii.find(df)).collect()}
    for i, t in rows:
        found = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert [s for s in found if not s.startswith("term")] == base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()
    first = 2 + len(odd)
    terms = {rows[first][1][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[first]["spans"].split(",")) if k == "term"}
    assert {"zelda", "quixby"} <= terms and "write" not in terms
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[0] is None and "quixby" not in clean[first] and "[EMAIL]" in clean[first] and clean[len(rows) - 1] == rows[-1][1]


def brute_spans(texts):
    """All spans of each text by the definitions: document frequencies over distinct texts, Wilson's bound, PMI against IC."""
    from math import log, sqrt

    kinds = {t: base_spans(t) for t in texts}
    entities, words = {}, {}
    for t, spans in kinds.items():
        rest, entities[t] = list(t), set()
        for s in spans:
            kind, a, b = s.split(":")
            v = t[int(a) : int(b)]
            entities[t].add(f"{kind}:{v.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', v)}")
            rest[int(a) : int(b)] = " " * (int(b) - int(a))
        words[t] = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", "".join(rest))]
    n, z = len(kinds), pii.Z
    df_e, df_t, both = defaultdict(int), defaultdict(int), defaultdict(int)
    for t in kinds:
        own = {w for w, _, _ in words[t] if len(w) >= pii.TERM_LENGTH}
        for e in entities[t]:
            df_e[e] += 1
        for w in own:
            df_t[w] += 1
            for e in entities[t]:
                both[w, e] += 1
    reveal, held = set(), defaultdict(set)
    for t in kinds:
        for e in entities[t]:
            held[e].add(t)
    one = {}  # entities of the same texts are one
    for e in sorted(held):
        one.setdefault(frozenset(held[e]), e)
    most = {e: df_e[e] * (n / df_e[e]) ** (1 - pii.ALPHA) * (1 + 1e-9) for e in held}
    tried = {(w, e): k for (w, e), k in both.items() if one[frozenset(held[e])] == e and df_e[e] < n and df_t[w] <= most[e]}
    for (w, e), k in tried.items():
        share, chance = k / df_t[w], df_e[e] / n
        tail = df_t[w] * (share * log(share / chance) + ((1 - share) * log((1 - share) / (1 - chance)) if share < 1 else 0)) if share > chance else 0
        if tail < log(len(tried) / pii.FAMILY):
            continue
        p, x = k / df_t[w], z * z / df_t[w]
        low = (p + x / 2 - z * sqrt(p * (1 - p) / df_t[w] + x / df_t[w] / 4)) / (1 + x)
        if df_e[e] < n and log(low * n / df_e[e]) >= pii.ALPHA * log(n / df_e[e]):
            reveal.add(w)
    out = {}
    for t, spans in kinds.items():
        rank = list(pii.KINDS)
        every = [s.split(":") for s in spans] + [["term", a, b] for w, a, b in words[t] if w in reveal]
        out[t] = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(every, key=lambda s: (int(s[1]), rank.index(s[0]))))
    return out, reveal


def test_terms_are_those_of_brute_force(spark):
    rng = random.Random(12)
    common_words = [prose(700 + k, 1) for k in range(60)]
    people = [(f"name{chr(97 + k)}x", f"{chr(97 + k)}x@corp.example.com" if k % 2 else f"+1 (017) 555-{7000 + k}") for k in range(12)]
    texts = []
    for k in range(900):
        t = " ".join(rng.choices(common_words, k=rng.randint(5, 30)))
        if rng.random() < 0.3:
            name, address = rng.choice(people)
            t += f" {name} writes from {address} " * (rng.random() < 0.8) + f" so {name.upper()} says" * (rng.random() < 0.5)
        texts.append(t)
    want, reveal = brute_spans(texts)
    df = spark.createDataFrame([*enumerate(texts), (None, texts[3]), (5, texts[5])], "doc_id long, text string")
    got = pii.report(pii.find(df)).collect()
    assert len(got) == len(texts) + 2 and all(r["spans"] == want[texts[3 if r["doc_id"] is None else r["doc_id"]]] for r in got)
    assert 5 <= len(reveal & {n for n, _ in people}) and not reveal & set(common_words)


def test_sanitise_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now", "x", "y"), (None, None, "x", "y"), (1, "", "x", "y"), (1, "mail a@b.co now", "p", "q")], "doc_id long, text string, s string, d string")
    df = df.withColumns({"t": F.lit(1), "h": F.lit(2), "c0": F.lit(3), "_s": F.lit(4), "spans": F.lit(5), "text_id": F.lit(6)})
    got = pii.sanitise(df)
    assert got.columns == df.columns and sorted(("-" if r["text"] is None else r["text"], r["s"]) for r in got.collect()) == [("", "x"), ("-", "x"), ("mail [EMAIL] now", "p"), ("mail [EMAIL] now", "x")]
    assert pii.sanitise(df.limit(0)).isEmpty()


def test_revealing_terms_are_found_wherever_they_stand(spark):
    far = "plain words go on here " * 12
    name = [f"zelda {far} mail zq@corp.example.com, {far} quixby {k}" for k in range(3)]  # far from the address on both sides
    row = [f"odette ann@corp.example.com +1 (017) 555-77{k}3 {far}" for k in range(3)]  # a phone number cuts her off
    texts = [*name, *row, f"{far} it was zelda who said so, Zelda", "here odette", *(f"plain words go on here, mail {k}" for k in range(1500))]
    df = spark.createDataFrame([*enumerate(texts), (None, texts[6])], "doc_id long, text string")
    got = defaultdict(list)
    for r in pii.find(df).collect():
        got[r["doc_id"]] += [texts[6 if r["doc_id"] is None else r["doc_id"]][s["start"] : s["stop"]] for s in r["spans"] if s["kind"] == "term"]
    assert all({"zelda", "quixby"} <= set(got[i]) for i in range(3)) and all("odette" in got[i] for i in range(3, 6))
    assert got[6] == got[None] == ["zelda", "Zelda"] and got[7] == ["odette"] and not any(got[i] for i in range(8, len(texts)))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "elda" not in clean[6] + clean[None] and clean[7] == "here " and clean[8] == texts[8]


def test_entities_of_one_or_two_texts_have_terms(spark):
    texts = ["zelda writes from zq@corp.example.com", "odette calls +1 (017) 555-7713", "odette again, +1 (017) 555-7713 writes", "marten calls 10.0.0.1", "it was marten who calls"]
    texts += [f"text {k} writes and calls from corp, who was it again" for k in range(600)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["stop"]] for s in r["spans"] if s["kind"] == "term"] for r in pii.find(df).collect()}
    assert [got[i] for i in range(3)] == [["zelda"], ["odette"], ["odette"]]  # so few pairs are tried that one text tells
    assert not any(got[i] for i in range(3, len(texts)))  # half of the texts with marten hold no address: too little evidence


def test_planted_names_are_found_and_rare_words_stay(spark):
    """Forty people, each in two to six texts with their address, among texts of which each has words that no other text holds."""
    rng = random.Random(21)
    common_words = [prose(900 + k, 1) for k in range(300)]
    rare = lambda: "".join(rng.choice("klmnoprstuvw") for _ in range(9))
    text = lambda more: " ".join(sorted([*rng.choices(common_words, k=40), *(rare() for _ in range(3)), *more], key=lambda _: rng.random()))
    names = [f"given{rare()}" for _ in range(40)]
    texts = [text([n, f"{n[5:]}@corp.example.com"]) for n in names for _ in range(rng.randint(2, 6))]
    texts += [text([f"lone{k}@corp.example.com"]) for k in range(40)] + [text([]) for _ in range(2000)]
    found, words = set(), set()
    for r in pii.find(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect():
        found |= {texts[r["doc_id"]][s["start"] : s["stop"]] for s in r["spans"] if s["kind"] == "term"}
        words |= set(texts[r["doc_id"]].split())
    recall, lost = len(found & set(names)) / 40, len(found - set(names)) / len(words)
    assert recall >= 0.9 and lost < 0.001


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40) | st.lists(st.sampled_from(b"ab"), max_size=60).map(bytes))
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute_repeats(texts, n=50):
    first = {}
    for i, t in texts.items():
        raw = (t or "").encode()
        for k in range(len(raw) - n + 1):
            first[raw[k : k + n]] = min(i, first.get(raw[k : k + n], i))
    out = {}
    for i, t in texts.items():
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - n + 1):
            if first[raw[k : k + n]] < i:
                gone[k : k + n] = b"\1" * n
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("spans", "wide"), [(1000, 32), (2, 1), (0, 0)])
def test_repeats(docs, spark, monkeypatch, spans, wide):
    """Also with every anchor dealt out again by fewer windows, and with none sent on span by span."""
    monkeypatch.setattr(repeats, "BLOCK_SPANS", spans)
    monkeypatch.setattr(repeats, "WIDE", wide)
    passage = prose(77, 12)
    hot = [(100 + k, f"{prose(200 + k, 12)}{passage}{prose(300 + k, 12)}", "en", "s", 0, "") for k in range(30)]
    more = docs.union(spark.createDataFrame(hot, docs.schema))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.deduplicate(more).collect()}
    assert got == brute_repeats(texts_of(more))


def test_repeats_of_odd_rows(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (1, b), (2, a), (2, "zz " + b), (2, a), (None, a), (None, b), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in repeats.deduplicate(df).collect())
    n, m = len(a), len(b)
    assert got == sorted([(1, n, 0), (1, m, 0), (2, n, n), (2, n, n), (2, m + 3, m), (0, n, 0), (0, m, 0), (3, 0, 0), (4, 0, 0)])
    assert repeats.deduplicate(df.limit(0)).isEmpty()
    kept = {bytes(r["kept"]) for r in repeats.deduplicate(df.where("doc_id = 2 or doc_id = 1"), with_text=True).collect()}
    assert kept == {a.encode(), b.encode(), b"", b"zz "}


def test_pages(spark):
    m = extract.default_model()
    page = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><div class="cookie-notice">We use cookies.</div>
    <nav><a href="/">Home</a></nav><article><h1>Title</h1><p>One &amp;   two.<p>Be.</p><div class="ad">Buy now!</div><p>Text <a href="x">link</a> more.</p></article>
    <section id="comments"><div class="comment"><p>I like this very much.</p></div></section><footer>&copy; me</footer><!-- open"""
    assert m.main_text(page) == "Title\nOne & two.\nBe.\nText link more."
    rows = [(1, "u", page), (2, None, None), (3, "", ""), (4, "v", "<" * 5000 + "<p>x"), (5, "w", "plain"), (6, "w", "<!-- never closed <p>x</p>")]
    got = {r["page_id"]: r for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2]["text"] == got[3]["text"] == got[6]["text"] == "" and got[5]["text"] == "plain" and got[1]["n_chars"] == len(got[1]["text"])
    for x in m.marginals(extract.parse(page)):
        assert abs(sum(x) - 1) < 1e-9


def test_main_text_of_pages_of_other_makes():
    """By words: the article is found whole, and little else."""
    from heldout_pages import PAGES

    model = extract.default_model()
    words = lambda blocks: sum(len(b.split()) for b in blocks)
    wanted = found = right = 0
    for page, want in PAGES:
        got = model.main_text(page).split("\n")
        wanted, found, right = wanted + words(want), found + words(got), right + words([b for b in got if b in want])
    assert right / wanted > 0.95 and right / found > 0.9


def test_rows_of_any_kind(spark):
    """Nulls in every column, repeated rows, clashing columns, long texts and empty tables, through the operators that take a row for a row."""
    names = {n: F.lit("clash") for n in ("ids", "codes", "lang_pred", "n_chars", "digest", "block", "headers", "row", "kept")}
    docs = spark.createDataFrame([(1, "a b", "en"), (1, "a b", "en"), (None, None, None), (2, "", "en"), (3, "wörter " * 30_000, None), (None, "a b", "de")], "doc_id long, text string, lang string").withColumns(names)
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, None, "<p>" + "x " * 100_000)], "page_id long, url string, html string").withColumns({**names, "text": F.lit("clash")})
    model = langid.learn(docs)
    runs = [
        (docs, lambda d: bpe.encode(d, vocabulary_path(), with_ids=True)), (docs, quality.ledger), (docs, quality.keep_documents), (docs, lambda d: langid.identify(d, model)),
        (docs, lambda d: pii.report(pii.find(d))), (docs, repeats.deduplicate), (docs, neardup.near_duplicates), (pages, extract.extract), (pages, warc.responses),
        (pages, lambda p: warc.derivatives(warc.responses(p))),
    ]
    for k, (table, run) in enumerate(runs):
        n = run(table).count()
        assert n == {2: 0, 9: 2 * table.count()}.get(k, table.count()), k
        assert run(table.limit(0)).count() == 0, k


def test_message_passing_is_exact():
    """Marginals of a small page equal those from summing over all assignments."""
    from itertools import product
    from math import exp

    m = extract.default_model()
    tree = extract.parse("<div><p>some words here</p><nav><a href=x>go</a></nav></div>")
    f = extract.evidence(tree)
    total = np.zeros((len(f), 3))
    for states in product(range(3), repeat=len(f)):
        w = exp(m.root[states[0]])
        for i, s in enumerate(states):
            w *= exp(sum(m.features[x][s] for x in f[i] if x in m.features))
            if i:
                w *= m.pair[states[tree.parent[i]]][s]
        for i, s in enumerate(states):
            total[i, s] += w
    total /= total.sum(axis=1, keepdims=True)
    assert np.allclose(total, m.marginals(tree), atol=1e-9)


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x\r\nEvil: 1", "<title>T</title><p>Hi <a href='/l'>there</a></p>"), (2, None, None)], "page_id long, url string, html string")
    records = warc.responses(pages)
    for r in warc.files(records).collect():
        (tmp_path / r["name"]).write_bytes(r["content"])
    again = warc.read_files(spark, str(tmp_path))
    assert sorted(r["record_id"] for r in again.collect()) == sorted(r["record_id"] for r in records.collect())
    made = warc.derivatives(again).collect()
    assert len(made) == 4 and {r["refers_to"] for r in made} == {r["record_id"] for r in records.collect()}
    text = next(r for r in made if r["record_type"] == "conversion" and r["block"])
    assert bytes(text["block"]).decode() == visible_text("<p>Hi <a>there</a></p>") == "Hi there"
    assert warc.digest(bytes(text["block"])) in text["headers"]


def archive(*records):
    return b"".join(b"WARC/1.0\r\n" + head.replace("\n", "\r\n").encode("iso-8859-1") + f"\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n" for head, block in records)


def test_warc_reads_ordinary_archives(spark, tmp_path):
    import gzip

    page = "<title>Ti</title><p>caf\xe9".encode("iso-8859-1")
    http = lambda body, *lines: "\r\n".join(["HTTP/1.1 200 OK", *lines]).encode("iso-8859-1") + b"\r\n\r\n" + body
    chunks = b"5\r\nhello\r\n4;x=1\r\n you\r\n0\r\n\r\n"
    data = archive(
        ("warc-type: response\nwarc-record-id: <urn:a>\nWARC-Date: d1\nWARC-Target-URI: http://x/\xe9", http(page, "content-type: text/html; charset=iso-8859-1", "Set-Cookie: a", "Set-Cookie: b", "X-Long: one", " two")),
        ("WARC-Type: response\nWARC-Record-ID: <urn:b>\nWARC-Date: d2", http(b"<p>hi", "Content-Type: text/html; charset=undefined")),
        ("WARC-Type: response\nWARC-Target-URI: u", http(chunks, "Content-Type: text/plain", "Transfer-Encoding: chunked")),
        ("WARC-Type: response\nWARC-Record-ID: <urn:d>", http(gzip.compress(b"<p>zip</p>"), "Content-Type: text/html", "Content-Encoding: gzip")),
        ("WARC-Type: response\nWARC-Record-ID: <urn:e>", http(b"\x89PNG<p>not text</p>", "Content-Type: image/png")),
        ("WARC-Type: response\nWARC-Record-ID: <urn:f>", http(b"<p>plain", "Content-Type: text/html; charset=hex", "Content-Encoding: gzip", "Transfer-Encoding: chunked")),
        ("WARC-Type: warcinfo\nWARC-Concurrent-To: <urn:g>\nwarc-concurrent-to: <urn:h>", b"x: y"),
        ("WARC-Type: response\nWARC-Record-ID: <urn:i>", b""),
    )
    (tmp_path / "a.warc").write_bytes(data + b"WARC/1.0\r\nContent-Length: 99999999999999\r\n\r\nbroken off")
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, (data[:700], data[700:]))) + gzip.compress(data)[:-300])
    records = warc.read_files(spark, str(tmp_path / "a.warc"))
    assert records.count() == 8 and warc.read_files(spark, str(tmp_path / "b.warc.gz")).count() >= 8
    made = warc.derivatives(records).collect()
    text = {r["refers_to"]: bytes(r["block"]).decode() for r in made if r["record_type"] == "conversion"}
    assert text == {"<urn:a>": "caf\xe9", "<urn:b>": "hi", None: "hello you", "<urn:d>": "zip", "<urn:f>": "plain", "<urn:i>": ""}
    about = {r["refers_to"]: __import__("json").loads(bytes(r["block"])) for r in made if r["record_type"] == "metadata"}
    response = about["<urn:a>"]["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert response["Headers"][1:] == [["Set-Cookie", "a"], ["Set-Cookie", "b"], ["X-Long", "one two"]] and response["HTML-Metadata"]["Head"]["Title"] == "Ti"
    assert len(about) == 7 and "<urn:e>" not in text
    back = [r for f in warc.files(records, rows_a_file=3).collect() for r in warc.read(bytes(f["content"]))]
    assert sorted(r["block"] for r in back) == sorted(bytes(r["block"]) for r in records.collect())
    assert any(r["headers"].get("WARC-Concurrent-To") == ["<urn:g>", "<urn:h>"] for r in back)
    assert warc.files(records, rows_a_file=3).count() >= 3


def test_deep_pages_take_linear_time():
    import time

    for page in ("<b>" * 170_000 + "</i>" * 120_000, "<b>" * 100_000 + "<li>x" * 140_000, "<div>" * 90_000 + "</p>" * 100_000, "<p><b>" * 140_000):
        start = time.process_time()
        assert len(visible_text(page)) >= 0
        assert time.process_time() - start < 20


def test_licenses(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "nothing here"), ("a/b/y.txt", "text\nLicensed under the Apache License, Version 2.0.\nmore"),
        ("a/b/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/z", ""), ("q/z", None), (None, "Released under the MIT License."),
        ("q/long", "the driver's licence is no license of ours " * 50),
    ]
    got = {r["path"]: (r["own_licence"], r["licence"], r["licence_from"]) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/b/x.txt"] == (None, "MIT", "a/LICENSE")
    assert got["a/b/y.txt"] == ("Apache-2.0", "Apache-2.0", "a/b/y.txt")
    assert got["a/b/c/d/z"] == (None, "GPL-3.0", "a/b/c/COPYING.txt")
    assert got["q/z"] == got["q/long"] == (None, None, None) and len(got) == len(rows)
    assert got[None] == ("MIT", "MIT", None)


def test_licenses_of_odd_rows(spark, monkeypatch):
    mit, gpl = "// SPDX-License-Identifier: MIT", "This program is free software; you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."
    rows = [("d/LICENSE", mit, 1), ("d/LICENSE", mit, 2), ("d/x", "", 3), ("d/x", "", 3), ("d/x", gpl, 4), (None, gpl, 5), (None, None, 6), ("e/COPYING", gpl, 7), ("e/f", "  # spdx-license-identifier: Apache-2.0", 8)]
    df = spark.createDataFrame(rows, "path string, text string, text_id long").withColumn("dir", F.lit(1)).withColumn("licence", F.lit(2))
    for most in (200_000, 0):  # broadcast, and salted
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        got = sorted((r["text_id"], r["own_licence"], r["licence"], r["licence_from"]) for r in licenses.scan(df).collect())
        assert got == [
            (1, "MIT", "MIT", "d/LICENSE"), (2, "MIT", "MIT", "d/LICENSE"), (3, None, "MIT", "d/LICENSE"), (3, None, "MIT", "d/LICENSE"), (4, "GPL-2.0", "GPL-2.0", "d/x"),
            (5, "GPL-2.0", "GPL-2.0", None), (6, None, None, None), (7, "GPL-2.0", "GPL-2.0", "e/COPYING"), (8, "Apache-2.0", "Apache-2.0", "e/f"),
        ]
    assert licenses.scan(df.limit(0)).isEmpty()


def test_licence_cosines_are_those_of_brute_force(spark):
    """Every text's best cosine over its lines and paragraphs, computed apart."""
    import math
    from collections import Counter

    rng = random.Random(8)
    sentences = [t for _, t in licenses.TEMPLATES]
    texts = []
    for k in range(60):
        words = licenses.words_of(rng.choice(sentences))
        texts.append(prose(k, 20) + "\n" + " ".join(w for w in words if rng.random() < 0.8) + " " + prose(k + 1, rng.randint(0, 8)) + "\n\n" + rng.choice(("", rng.choice(sentences))))
    df = spark.createDataFrame([(f"p{k}", t) for k, t in enumerate(texts)], "path string, text string")
    got = {r["path"]: (r["own_licence"], r["cosine"]) for r in licenses.scan(df).collect()}
    n = len(texts)
    holds = Counter(w for t in texts for w in set(licenses.words_of(t)) if w in licenses.VOCABULARY)
    idf = lambda w: math.log((n + 1) / (holds[w] + 1)) + 1
    vector = lambda text: {w: c * idf(w) for w, c in Counter(licenses.words_of(text)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for k, t in enumerate(texts):
        best = (0.0, 0, None)
        for unit in [*t.split("\n"), *re.split(r"\n[ \t\r]*\n", t)]:
            if any(c in unit.lower() for c in licenses.CUES) and licenses.words_of(unit):
                v = vector(unit)
                for j, (name, sentence) in enumerate(licenses.TEMPLATES):
                    w = vector(sentence)
                    best = max(best, (round(sum(x * w.get(y, 0) for y, x in v.items()) / norm(v) / norm(w), 9), -j, name), key=lambda b: b[:2])
        assert got[f"p{k}"] == ((best[2], pytest.approx(best[0], abs=2e-9)) if best[0] >= licenses.LEAST else (None, None)), k

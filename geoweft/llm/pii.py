"""Personal data: patterns, and terms that give the same people away.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone
numbers, found by patterns. Each distinct value is a protected entity. A term,
which is a run of letters and digits outside base spans, reveals an entity if
the corpus says so: with document frequencies over whole distinct texts,
IC(e) = log(N / df(e)) is what naming e discloses, and
PMI(t, e) = log(N * df(t, e) / (df(t) * df(e))) what t discloses of it. Terms
with PMI >= alpha * IC are revealing, and each of their occurrences is a
``term`` span, in texts without a base span too. For df(t, e) / df(t), which is
how likely a text with t holds e, PMI takes the lower end of its Wilson interval
(``z`` standard errors): no count is too small to reveal, but the fewer texts
speak for a pair, the fewer may speak against it. And a pair must be more than
chance: if texts with t held e as often as others do, so many of them together
would be less probable than FAMILY shared out among all pairs that are tried
(by Chernoff's bound on the binomial tail). So words that merely happen to stand
in no other text stay; a name in two texts with the same address goes. Sanitising
generalises base spans to their kind and removes terms.

Everything is DataFrame functions. Patterns are written so that Java's matcher
neither recurses nor tries a run from each of its characters: quantifiers are
possessive where nothing can follow, and a match starts where a run starts or
where the last match ended, which is where a leftmost match starts anyway.

A null or empty text has no spans. Copies of a text count once as evidence, and
repeated rows each get their spans; a null doc_id is a value like any other;
further columns are ignored (``find``) or kept (``sanitise``), whatever their
names. An empty table has no spans.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import BROADCAST_ROWS, Scratch

# The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain to be searched for a kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": ""}

ALPHA = 0.9
#: Standard errors below what was counted: the bound of 80 % on one side.
Z = 0.8416
#: The probability that any pair at all passes by chance.
FAMILY = 0.01
#: A term's least length.
TERM_LENGTH = 3
TERM = r"[\p{L}\p{N}]+"
BLOCK = 64


def prefixes(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What ``op`` makes of 0 and all that stands before each element of an array of integers, block by block so that long arrays stay cheap."""
    step = lambda acc, v: F.struct(op(acc["now"], v).alias("now"), F.concat(acc["before"], F.array(acc["now"])).alias("before"))
    zero = F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("before"))
    n_blocks = F.ceil(F.size(values) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.aggregate(F.slice(values, b * BLOCK + 1, BLOCK), zero, step))
    offsets = F.aggregate(blocks, zero, lambda acc, x: step(acc, x["now"]))["before"]
    found = F.flatten(F.zip_with(blocks, offsets, lambda x, o: F.transform(x["before"], lambda v: op(v, o))))
    return F.when(F.size(values) > 0, found).otherwise(F.array().cast("array<int>"))


def lengths(found: Column, gaps: Column) -> Column:
    """The lengths of each gap and the match after it."""
    return F.zip_with(gaps, found, lambda g, m: F.coalesce(F.length(g), F.lit(0)) + F.coalesce(F.length(m), F.lit(0)))


def positions(found: Column, gaps: Column, before: Column) -> Column:
    """array of (start, value) from the matches of a pattern, what splitting by it leaves, and the sums of lengths before each; in code points from 0."""
    at = F.zip_with(found, F.slice(before, 1, F.size(found)), lambda m, s: F.struct(m.alias("value"), s.alias("at")))
    return F.zip_with(at, F.slice(gaps, 1, F.size(found)), lambda x, g: F.struct((x["at"] + F.length(g)).alias("start"), x["value"].alias("value")))


def add(x: Column, y: Column) -> Column:
    return x + y


def luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + F.when((F.length(digits) - i) % 2 == 0, F.substring(digits, i, 1).cast("int")).otherwise(
            F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, i, 1).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        d = digits(value)
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def key(kind: str, value: Column) -> Column:
    """The entity that a value names."""
    plain = F.lower(value) if kind in ("email", "ip") else digits(value)
    return F.concat(F.lit(f"{kind}:"), plain)


def kind_spans(rank: int, kind: str) -> Column:
    """The valid spans of a kind, from the columns of its matches and gaps."""
    found = F.filter(positions(F.col(f"m_{kind}"), F.col(f"g_{kind}"), F.col(f"b_{kind}")), lambda p: valid(kind, p["value"]))
    spans = F.transform(
        found,
        lambda p: F.struct(
            p["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (p["start"] + F.length(p["value"])).alias("stop"), key(kind, p["value"]).alias("entity")
        ),
    )
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int,entity:string>>")
    return F.when(F.size(f"m_{kind}") > 0, spans).otherwise(empty)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, base: array of (start, rank, kind, stop, entity), sorted."""
    strings = "array<string>"
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = F.array().cast(strings)
    for kind, pattern in PATTERNS.items():
        find = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))
        x = x.withColumn(f"m_{kind}", F.when(F.col("text").contains(NEEDS[kind]), find).otherwise(none) if kind in NEEDS else find)
    for kind, pattern in PATTERNS.items():
        x = x.withColumn(f"g_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)).otherwise(none))
    # each step is a projection of its own: what it makes is then used, not made again for each use
    x = x.withColumns({f"l_{k}": lengths(F.col(f"m_{k}"), F.col(f"g_{k}")) for k in PATTERNS})
    x = x.withColumns({f"b_{k}": prefixes(F.col(f"l_{k}"), add) for k in PATTERNS})
    spans = [kind_spans(rank, kind) for rank, kind in enumerate(PATTERNS)]
    return x.select("doc_id", "text", F.array_sort(F.concat(*spans)).alias("base"))


def masked(text: Column, spans: Column, held: Column) -> Column:
    """The text with blanks in place of its spans: what is left stands where it stood."""
    blank = lambda n: F.repeat(F.lit(" "), n)
    part = lambda s, at: F.when(
        s["start"] >= at, F.concat(text.substr(at + 1, s["start"] - at), blank(s["stop"] - s["start"]))
    ).otherwise(blank(F.greatest(s["stop"] - at, F.lit(0))))
    end = F.greatest(F.element_at(held, -1), F.element_at(spans, -1)["stop"])
    return F.concat(F.array_join(F.zip_with(spans, held, part), ""), text.substr(end + 1, F.length(text)))


def outside(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, base, rest: the spans of each row and its text with blanks in their place."""
    x = base_spans(docs).withColumn("stops", F.transform("base", lambda b: b["stop"]))
    x = x.withColumn("held", prefixes(F.col("stops"), F.greatest))  # where all earlier spans end
    rest = F.when(F.size("base") > 0, masked(F.col("text"), F.col("base"), F.col("held"))).otherwise(F.col("text"))
    return x.select("doc_id", F.xxhash64("text").alias("text_id"), "base", rest.alias("rest"))


def small(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it has few rows, so that no text on the other side is shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def words(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and term: each term of each row once."""
    terms = F.array_distinct(F.transform(F.split("rest", r"[^\p{L}\p{N}]+"), F.lower))
    return rows.select(*columns, F.explode(terms).alias("term")).where(F.length("term") >= TERM_LENGTH)


def frequencies(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """term, df_t: the number of distinct texts with a term. A text in n rows counts n times among texts of n rows, so no pair of text and term is shuffled."""
    many = small(copies.where(F.col("n_rows") > 1))
    x = rows.join(many, "text_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(1).cast("long")))
    x = words(x, "n_rows").groupBy("term", "n_rows").agg(F.count("*").alias("n"))
    return x.groupBy("term").agg(F.sum(F.expr("n div n_rows")).alias("df_t"))


def least(part: Column, whole: Column, z: float) -> Column:
    """The lower end of the Wilson interval of a share."""
    p, w = part / whole, F.lit(z * z) / whole
    return (p + w / 2 - z * F.sqrt(p * (1 - p) / whole + w / whole / 4)) / (1 + w)


def beyond_chance(k: Column, of: Column, p: Column) -> Column:
    """Minus the logarithm of Chernoff's bound on how probable at least k of so many are, each with probability p; 0 where no more than expected."""
    share = k / of
    part = lambda q, r: F.when(q > 0, q * F.log(q / r)).otherwise(0.0)
    return F.when((share > p) & (p < 1), of * (part(share, p) + part(1 - share, 1 - p))).otherwise(0.0)


def revealing(rows: DataFrame, scratch: Scratch, alpha: float = ALPHA, z: float = Z) -> DataFrame | None:
    """term: those over the disclosure threshold for some entity; None if no text holds an entity."""
    names = rows.where(F.size("base") > 0).select("text_id", F.explode(F.transform("base", lambda b: b["entity"])).alias("entity")).distinct()
    # entities of the same texts disclose alike: one stands for all, so that a log of many addresses isn't paired with its words for each
    alike = [F.count("*").alias("df_e"), F.bit_xor("text_id").alias("x"), F.bit_xor(F.xxhash64("text_id", F.lit(1))).alias("y")]
    one = names.groupBy("entity").agg(*alike).groupBy("df_e", "x", "y").agg(F.min("entity").alias("entity")).select("entity", "df_e")
    names = scratch.write(names.join(one, "entity"))
    if names.isEmpty():
        return None
    copies = scratch.write(rows.groupBy("text_id").agg(F.count("*").alias("n_rows")))
    n = float(copies.count())
    ic = F.log(F.lit(n) / F.col("df_e"))
    # df_te is at most df_e: terms of more texts than this can't reach the threshold
    names = names.where(ic > 0).withColumn("most", F.col("df_e") * F.exp((1 - alpha) * ic) * (1 + 1e-9))
    held = names.groupBy("text_id").agg(F.max("most").alias("most"))
    df_t = frequencies(rows.select("text_id", "rest"), copies)
    met = words(rows.where(F.size("base") > 0).join(held, "text_id").dropDuplicates(["text_id"]), "text_id", "most")
    met = met.join(df_t, "term").where(F.col("df_t") <= F.col("most")).drop("most")
    pairs = met.join(names, "text_id").where(F.col("df_t") <= F.col("most"))
    pairs = scratch.write(pairs.groupBy("entity", "term").agg(F.count("*").alias("df_te"), F.first("df_t").alias("df_t"), F.first("df_e").alias("df_e")))
    tried = max(1, pairs.count())
    pairs = pairs.where(beyond_chance(F.col("df_te"), F.col("df_t"), F.col("df_e") / n) >= float(log(tried / FAMILY)))
    pmi = F.log(least(F.col("df_te"), F.col("df_t"), z) * n / F.col("df_e"))
    return scratch.write(pairs.where(pmi >= alpha * ic).select("term").distinct())


def term_spans(rows: DataFrame, terms: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_id, terms: every occurrence of ``terms`` in every row."""
    found = words(rows.select("text_id", "rest"), "text_id")
    found = scratch.write(found.join(small(terms), "term", "left_semi").distinct())
    x = rows.select("doc_id", "text_id", "rest").join(small(found.select("text_id").distinct()), "text_id", "left_semi").dropDuplicates(["doc_id", "text_id"])
    x = x.withColumn("m", F.regexp_extract_all("rest", F.lit(TERM), F.lit(0))).withColumn("g", F.split("rest", TERM, -1))
    x = x.withColumn("l", lengths(F.col("m"), F.col("g")))
    x = x.withColumn("b", prefixes(F.col("l"), add))
    x = x.select("doc_id", "text_id", F.explode(positions(F.col("m"), F.col("g"), F.col("b"))).alias("p"))
    stop = F.col("p.start") + F.length("p.value")
    x = x.select("doc_id", "text_id", F.lower("p.value").alias("term"), F.col("p.start").alias("start"), stop.alias("stop")).join(found, ["text_id", "term"])
    span = F.struct("start", F.lit(len(KINDS) - 1).alias("rank"), F.lit("term").alias("kind"), "stop")
    return x.groupBy("doc_id", "text_id").agg(F.collect_list(span).alias("terms"))


def find(docs: DataFrame, alpha: float = ALPHA, z: float = Z) -> DataFrame:
    """doc_id, text_id, spans: every span as (start, rank, kind, stop), sorted; base ones first among equals."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(outside(docs))
    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"), b["kind"].alias("kind"), b["stop"].alias("stop")))
    out = rows.select("doc_id", "text_id", plain.alias("base"))
    found = revealing(rows, scratch, alpha, z)
    if found is None:
        return scratch.last(out.select("doc_id", "text_id", F.col("base").alias("spans")))
    terms = term_spans(rows, found, scratch).withColumnsRenamed({"doc_id": "d", "text_id": "t"})
    out = out.join(terms, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_id") == F.col("t")), "left")
    return scratch.last(out.select("doc_id", "text_id", F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "terms"))).alias("spans")))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select(
        "doc_id", count("email"), count("ip"), count("card"), count("phone"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), count("term"),
    )


def redacted(text: Column, spans: Column, held: Column) -> Column:
    """The text with each span replaced by its kind's label; of overlapping spans the first stands for all. held: where all earlier spans end."""
    label = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    part = lambda s, at: F.when(s["start"] >= at, F.concat(text.substr(at + 1, s["start"] - at), F.element_at(label, s["kind"]))).otherwise("")
    end = F.greatest(F.element_at(held, -1), F.element_at(spans, -1)["stop"])
    return F.concat(F.array_join(F.zip_with(spans, held, part), ""), text.substr(end + 1, F.length(text)))


def sanitise(docs: DataFrame, alpha: float = ALPHA, z: float = Z) -> DataFrame:
    """``docs`` with spans replaced in ``text``; all else, nulls included, stays as it is."""
    found = find(docs, alpha, z).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_id"])
    found = found.withColumn("stops", F.transform("spans", lambda s: s["stop"])).select(
        F.col("doc_id").alias("d"), F.col("text_id").alias("t"), F.col("spans").alias("s"), prefixes(F.col("stops"), F.greatest).alias("h")
    )
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = {c.lower(): n for c, n in zip(docs.columns, names)}
    text = F.col(at["text"])
    same = F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("d")) & (F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))) == F.col("t"))
    done = docs.toDF(*names).join(found, same, "left").withColumn(at["text"], F.when(F.col("s").isNotNull(), redacted(text.cast("string"), F.col("s"), F.col("h"))).otherwise(text))
    return done.select(*names).toDF(*docs.columns)

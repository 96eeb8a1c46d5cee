"""Personal data: patterns, and information-theoretic sanitisation of the terms around them. DataFrame functions only.

Patterns find the protected entities. Over the whole corpus, words near an entity are counted with it and without it, each
distinct text once on all sides, so that copies don't count again. A word whose pointwise mutual information with an
entity reaches ``share`` of the entity's own information content gives it away; it is a span too, wherever a document
holds both. Sanitising replaces entities by their kind and such words by a mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, unused

# The patterns (made possessive, which finds the same and doesn't recurse), and the limits of each kind.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without it holds no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"[^\W\d_]+"
#: Words that give an entity away: seen with it in at least ``SUPPORT`` different texts, at a PMI of ``SHARE`` of its information.
SUPPORT, SHARE, NEAR = 3, 0.9, 60
SPANS = "array<struct<start:int,rank:int,end:int,value:string>>"
#: Elements that are added up at once, and code points of a piece of text: long texts cost in proportion.
BLOCK, CHUNK = 128, 1024


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def holds(kind: str, m: Column) -> Column:
    """Whether a match is one of its kind."""
    if kind == "ip":
        return m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    n = F.length(digits(m))
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), F.call_function("luhn_check", digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def before(values: Column, most: bool = False) -> Column:
    """For each element the sum (or with ``most`` the maximum, 0 at least) of the integers before it.

    By blocks of ``BLOCK``, then over the blocks, as each step of an aggregation copies what it has gathered.
    """
    more = (lambda a, b: F.greatest(a, b)) if most else (lambda a, b: a + b)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, v: F.struct(more(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    # A one-element array binds a value, so that a lambda doesn't compute it again for each element.
    bound = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(bound(values, cut), lambda b: F.aggregate(b, zero, step))
    starts = lambda s: F.aggregate(s, zero, lambda acc, x: step(acc, x["at"]), lambda acc: acc["out"])
    return bound(sums, lambda s: F.flatten(F.zip_with(s, starts(s), lambda x, at: F.transform(x["out"], lambda v: more(v, at)))))


def placed(found: Column, pieces: Column, rank: int) -> Column:
    """Spans of the matches: pieces of text and matches alternate, so a match starts after all pieces and matches before it."""
    both = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("piece"), found.alias("m"))

    def span(x, at):
        start = at + x["piece"]
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x["m"])).alias("end"), x["m"].alias("value"))

    return F.zip_with(both, before(F.transform(both, lambda x: x["piece"] + F.length(x["m"]))), span)


def matches(text: Column, kind: str) -> Column:
    """Array of (start, rank of the kind, end, value): all matches that hold; start and end in code points."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    # An empty mark behind the text keeps the last piece.
    pieces = F.transform(F.split(text, PATTERNS[kind], -1), lambda x: F.length(x))
    spans = F.filter(placed(found, pieces, KINDS.index(kind)), lambda s: holds(kind, s["value"]))
    may = text.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
    return F.when(may & text.rlike(PATTERNS[kind].replace(r"|\G", "")), spans).otherwise(F.array().cast(SPANS))


def chunks(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` code points: a place is found without walking to it from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut_from(c: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of a text in chunks."""
    first = F.floor(start / CHUNK).cast("int")
    whole = F.array_join(F.slice(c, first + 1, F.floor(F.greatest(end, start) / CHUNK).cast("int") - first + 1), "")
    return F.substring(whole, start - first * CHUNK + 1, F.greatest(end - start, F.lit(0)))


def entities(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``base``: the sorted spans of all kinds. A null text is an empty one."""
    t = F.coalesce(F.col(text), F.lit(""))
    every = [matches(t, k) for k in KINDS]
    return docs.withColumn("base", F.array_sort(F.concat(*every)))


def terms_near(found: DataFrame, text: str) -> DataFrame:
    """__k (the text), entity, term: each word that lies within ``NEAR`` code points of an entity. A word cut by the edge is none."""
    def around(c: Column, e: Column) -> Column:
        before_ = cut_from(c, F.greatest(e["start"] - NEAR - 1, F.lit(0)), e["start"])
        before_ = F.when(e["start"] > NEAR, F.regexp_replace(before_, f"(?U)^{TERM}", "")).otherwise(before_)
        after = cut_from(c, e["end"], e["end"] + NEAR + 1)
        after = F.when(F.length(after) > NEAR, F.regexp_replace(after, f"(?U){TERM}$", "")).otherwise(after)
        return F.struct(e["value"].alias("entity"), F.concat(before_, F.lit(" \n "), after).alias("near"))

    every = F.element_at(F.transform(F.array(chunks(F.col(text))), lambda c: F.transform("base", lambda e: around(c, e))), 1)
    one = found.select("__k", F.explode(every).alias("e")).select("__k", "e.entity", "e.near")
    words = F.array_distinct(F.regexp_extract_all(F.lower("near"), F.lit(f"(?U){TERM}"), F.lit(0)))
    return one.select("__k", "entity", F.explode(words).alias("term"))


def disclosing_terms(docs: DataFrame, found: DataFrame, text: str = "text", support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """entity, term, pmi, information: the words that give an entity away. Counts are of distinct texts, over all documents."""
    pairs = terms_near(found, text).distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together"))
    pairs = stored(pairs.filter(F.col("together") >= support), "pairs")
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).distinct()
    n = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit("")))).distinct().count()
    of_entity = found.select("__k", F.explode(F.transform("base", lambda s: s["value"])).alias("entity")).distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(f"(?U){TERM}"), F.lit(0)))
    of_term = texts.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    t = pairs.join(of_entity, "entity").join(of_term, "term")
    information = F.ln(F.lit(float(n)) / F.least(F.col("n_entity"), F.lit(n)))
    pmi = F.ln(F.least(F.col("together"), F.col("n_term"), F.col("n_entity")) * F.lit(float(n)) / (F.col("n_term") * F.col("n_entity")))
    return t.withColumn("information", information).withColumn("pmi", pmi).filter((F.col("pmi") >= share * F.col("information")) & (F.col("pmi") > 0)).select("entity", "term", "pmi", "information")


def personal_data(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """All rows and columns of ``docs`` with ``base`` (entities) and ``terms`` (words that give one of them away).

    Both are arrays of (start, rank, end, value), code points, end exclusive, sorted. Null and empty texts have none;
    repeated rows are rows like any other. Columns of the input with these two names are replaced, others may have any
    name. No rows: no rows.
    """
    docs = docs.drop("base", "terms")
    found = entities(docs, text)
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    key, words = unused("key", found), unused("words", found)
    hits = stored(found.select(F.col(text).alias("t"), "base").filter(F.size("base") > 0).withColumn("__k", F.xxhash64("t")), "entities")
    told = disclosing_terms(docs.select(F.col(text).alias("t")), hits, "t", **options)
    held = hits.select("__k", F.explode(F.array_distinct(F.transform("base", lambda s: s["value"]))).alias("entity")).distinct()
    per_text = stored(held.join(told, "entity").groupBy(F.col("__k").alias(key)).agg(F.array_sort(F.collect_set("term")).alias(words)), "terms")
    none = F.array().cast(SPANS)
    rows = found.withColumn(key, hashed).join(F.broadcast(per_text) if per_text.count() <= 10_000 else per_text, key, "left")
    terms = F.when(F.col(words).isNotNull(), term_spans(F.col(text), F.col(words))).otherwise(none)
    return rows.select(*[F.col(f"`{c}`") for c in found.columns], terms.alias("terms"))


def term_spans(text: Column, terms: Column) -> Column:
    """Where the words occur, as whole words in either case."""
    pattern = F.concat(F.lit(r"(?iU)(?<![^\W\d_])(?:"), F.array_join(terms, "|"), F.lit(r")(?![^\W\d_])"))
    found, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.transform(F.split(text, pattern, F.lit(-1)), lambda x: F.length(x))
    return placed(found, pieces, len(KINDS))


def sanitised(rows: DataFrame, text: str = "text") -> DataFrame:
    """Texts with entities generalised to ``<kind>`` and telling words to ``<term>``; of overlapping spans the first (then the longest) counts."""
    spans = F.array_sort(F.concat("base", "terms"))
    name = lambda rank: F.element_at(F.array(*[F.lit(f"<{k}>") for k in [*KINDS, "term"]]), rank + 1)
    none = F.array().cast("array<struct<start:int,rank:int,at:int>>")

    def put(c: Column) -> Column:
        kept = F.filter(F.zip_with(spans, before(F.transform(spans, lambda s: s["end"]), most=True), lambda s, at: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), at.alias("at"))), lambda s: s["start"] >= s["at"])
        parts = F.transform(F.coalesce(kept, none), lambda s: F.concat(cut_from(c, s["at"], s["start"]), name(s["rank"])))
        return F.concat(F.array_join(parts, ""), cut_from(c, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(F.col(text))))

    whole = F.element_at(F.transform(F.array(chunks(F.col(text))), put), 1)
    return rows.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(F.col(text)))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6(spark, docs: DataFrame) -> DataFrame:
    rows = personal_data(docs.select("doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda s: s["rank"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return rows.select("doc_id", *[count(i) for i in range(4)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "terms"))).alias("spans"))

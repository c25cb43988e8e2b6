"""Information-theoretic sanitisation (DataFrame and SQL functions only).

Protected entities are found by pattern. How strongly a term t of a document reveals an entity e of it is estimated from the
corpus as PMI(t; e) = log2(N n(t, e) / (n(t) n(e))), with n counted in whole documents, against the entity's own information
content IC(e) = log2(N / n(e)) (Sanchez and Batet's C-sanitisation). A term with PMI / IC of at least GENERALISE is
generalised to its kind, from REMOVE on it is removed, wherever it stands in a document of the entity. Entities of one
document are judged like all others. Pairs that chance explains (see unlikely()) disclose nothing.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import written

#: The kinds and their patterns, in Java's syntax. A match starts where a run of its first characters starts or
#: the match before ended, and possessive runs never give back, so each text is passed over once.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"[\p{L}\p{N}]{3,}+"
#: Most probable chance of a pair that is judged, thresholds, and matches summed up at a time.
CHANCE, GENERALISE, REMOVE, STEP = 0.01, 0.8, 0.95, 64


def let(value: Column, use) -> Column:
    """use(value), with value computed once even where lambdas read it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(steps: Column) -> Column:
    """Sums of the steps before each step; in blocks, so that long arrays are not copied for each step."""

    def sums(start, xs):
        return F.aggregate(xs, F.array(start), lambda s, x: F.array_append(s, F.element_at(s, -1) + x))

    def cut(xs, b):
        return F.slice(xs, b * STEP + 1, STEP)

    def inside(xs, blocks):
        total = F.transform(blocks, lambda b: F.aggregate(cut(xs, b), F.lit(0), lambda s, x: s + x))
        own = F.zip_with(blocks, F.slice(sums(F.lit(0), total), 1, F.size(blocks)), lambda b, start: F.slice(sums(start, cut(xs, b)), 1, F.least(F.lit(STEP), F.size(xs) - b * STEP)))
        return F.flatten(own)

    def blocks(xs):
        n = F.size(xs)
        return F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int"))).otherwise(F.array().cast("array<int>"))

    return let(steps, lambda xs: let(blocks(xs), lambda bs: inside(xs, bs)))


def located(df: DataFrame, text: str, pattern: str, to: str) -> DataFrame:
    """df plus column `to`: structs (value, start, end) of the pattern's matches in code points, end exclusive."""
    df = df.withColumn("__m", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    # Only texts with a match are split; Spark's split has no possessive trouble with an empty match, as none is empty.
    gap = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size("__m")), lambda g: F.char_length(g))
    df = df.withColumn("__g", F.when(F.size("__m") > 0, gap).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("__s", running(F.zip_with("__g", "__m", lambda g, m: g + F.char_length(m))))
    both = F.zip_with(F.zip_with("__s", "__g", lambda s, g: s + g), "__m", lambda s, m: F.struct(m.alias("value"), s.alias("start"), (s + F.char_length(m)).alias("end")))
    return df.withColumn(to, both).drop("__m", "__g", "__s")


def valid(kind: str, x: Column) -> Column:
    value = x["value"]
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(value, r"[\x20-]", "")
        return F.char_length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def named(kind: str, x: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.lower(x["value"]))


def spelled(kind: str, x: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"))


def marked(kind: str, x: Column) -> Column:
    return F.struct(x["start"], x["end"], F.lit(f"[{kind.upper()}]").alias("to"))


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), a column per kind with its valid matches, entities (distinct kind:value), and the text
    of rows that have any."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", text.alias("text")).withColumn("h", F.md5("text"))
    for kind, pattern in KINDS.items():
        df = located(df, "text", pattern, kind)
        df = df.withColumn(kind, F.filter(kind, partial(valid, kind)))
    every = F.array_distinct(F.flatten(F.array(*(F.transform(k, partial(named, k)) for k in KINDS))))
    df = df.withColumn("entities", every)
    return df.select("doc_id", "h", *(F.transform(k, lambda x: F.struct(x["start"], x["end"])).alias(k) for k in KINDS), "entities", F.when(F.size("entities") > 0, F.col("text")).alias("text"))


def term_counts(docs: DataFrame) -> DataFrame:
    """term, n_term: the rows of docs that have the term."""
    text = F.coalesce("text", F.lit(""))
    # A text that lower case lengthens may fall apart into other terms.
    words = F.when(F.char_length(F.lower(text)) == F.char_length(text), F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).otherwise(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))
    return docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))


def unlikely(both: Column, one: Column, other: Column, n: Column, chance: float) -> Column:
    """Whether independence gives at least `both` common documents with a probability of at most `chance`, by Hoeffding's bound
    exp(-one KL(both / one || other / n)), in the better of the two roles. For one common document of a term that no other
    document has it is exactly n(e) / n."""

    def bound(one, other):
        a, p = both / one, other / n
        return one * (a * F.ln(a / p) + F.when(a < 1, (1 - a) * F.ln((1 - a) / (1 - p))).otherwise(F.lit(0.0)))

    return F.greatest(bound(one, other), bound(other, one)) >= -math.log(chance) - 1e-9


def disclosing(pairs: DataFrame, chance: float, generalise: float) -> DataFrame:
    """The rows of pairs (n_both, n_term, n_entity, n) whose PMI / IC reaches `generalise`, with that as share."""
    pmi = F.log2(F.col("n_both") * F.col("n") / (F.col("n_term") * F.col("n_entity")))
    content = F.log2(F.col("n") / F.col("n_entity"))
    some = pairs.where((content > 0) & (pmi > 0)).withColumn("share", pmi / content).where(F.col("share") >= generalise)
    return some.where(unlikely(F.col("n_both"), F.col("n_term"), F.col("n_entity"), F.col("n"), chance))


def disclosed(docs: DataFrame, found: DataFrame, chance: float, generalise: float) -> DataFrame:
    """h, terms: structs (start, end, share) of the terms that disclose an entity of the text, sorted by start.

    Equal texts are counted once, by weight. Entities that stand in the same texts have the same counts with every term, so
    they are paired with terms as one; those of a single text need no pairs at all. A text's terms are dealt out by
    (h, term), so no task holds all pairs of a long text.
    """
    some = found.where(F.size("entities") > 0)
    weight = some.select("h", "doc_id").distinct().groupBy("h").agg(F.count("*").alias("w"))
    once = some.dropDuplicates(["h"]).join(weight, "h").select("h", "w", "entities", "text")
    each = once.select("h", "w", F.explode("entities").alias("entity"))
    same = F.bit_xor(F.xxhash64("h")).alias("c1"), F.bit_xor(F.xxhash64(F.lit("again"), "h")).alias("c2")
    per_entity = each.groupBy("entity").agg(F.sum("w").alias("n_entity"), F.count("*").alias("n_texts"), *same)
    groups = written(each.join(per_entity, "entity").select("h", "n_entity", "n_texts", "c1", "c2").distinct(), "groups")
    tokens = located(once.select("h", "w", "text"), "text", TERM, "t").select("h", "w", F.explode("t").alias("t"))
    tokens = tokens.groupBy("h", "w", F.lower("t.value").alias("term")).agg(F.collect_list(F.struct("t.start", "t.end")).alias("places"))
    sizes = docs.agg(F.count("*").alias("n")).crossJoin(groups.agg(F.max("n_entity").alias("most")))
    # As n(t, e) is at most n(e), commoner terms cannot reach the threshold with any entity.
    common = F.pow("n", F.lit(1 - generalise)) * F.pow("most", F.lit(generalise)) * 1.000001
    near = tokens.join(term_counts(docs), "term", "left").withColumn("n_term", F.greatest("n_term", "w")).crossJoin(F.broadcast(sizes)).where(F.col("n_term") <= common)
    near = written(near.select("h", "w", "term", "n_term", "n", "places"), "near")
    own = near.join(groups.where("n_texts = 1"), "h").withColumn("n_both", F.col("n_entity"))
    own = disclosing(own, chance, generalise).select("h", "term", "share")
    shared = near.drop("places").join(groups.where("n_texts > 1").drop("n_texts"), "h")
    pairs = shared.groupBy("c1", "c2", "term", "n", "n_entity").agg(F.sum("w").alias("n_both"), F.max("n_term").alias("n_term"))
    pairs = pairs.withColumn("n_term", F.greatest("n_term", "n_both"))
    pairs = disclosing(pairs, chance, generalise).select("c1", "c2", "term", "share")
    hit = own.unionByName(shared.join(pairs, ["c1", "c2", "term"]).select("h", "term", "share")).groupBy("h", "term").agg(F.max("share").alias("share"))
    hit = near.join(hit, ["h", "term"]).select("h", "share", F.explode("places").alias("x"))
    return hit.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("x.start", "x.end", "share"))).alias("terms"))


def spans(docs: DataFrame, chance: float = CHANCE, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, h, a column per kind with structs (start, end), and terms: structs (start, end, share), sorted by start.

    One row per row of docs. Null text counts as empty; a null doc_id is treated like any other. Rows of the same text get the
    same spans; those that repeat doc_id too count as one document for n(t, e) and n(e). Terms that overlap a base span are
    left out. An entity that all documents have reveals nothing. An empty table gives an empty result.
    """
    found = written(entities(docs), "entities")
    per_text = disclosed(docs, found, chance, generalise)
    base = F.concat(*KINDS)
    free = F.filter("terms", lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    out = found.join(per_text, "h", "left")
    return out.select("doc_id", "h", *KINDS, F.coalesce(free, F.array().cast("array<struct<start:int,end:int,share:double>>")).alias("terms"))


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs; see spans()."""

    def said(kinds):
        return F.array_join(F.flatten(F.array(*(F.transform(c, partial(spelled, k)) for k, c in kinds))), ",")

    base = [(k, k) for k in KINDS]
    return spans(docs).select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(said(base), 256).alias("base_sha256"), said([*base, ("term", "terms")]).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with base spans replaced by their kind in brackets and terms generalised or removed; all columns kept.

    Of overlapping spans the one that starts first gives the replacement, and all their characters go. Null text stays null.
    """
    found = spans(docs)
    marks = [F.transform(k, partial(marked, k)) for k in KINDS]
    terms = F.transform("terms", lambda x: F.struct(x["start"], x["end"], F.when(x["share"] >= REMOVE, F.lit("")).otherwise(F.lit("[TERM]")).alias("to")))
    keyed = found.select(F.col("h").alias("__h"), F.array_sort(F.flatten(F.array(*marks, terms))).alias("__x")).where(F.size("__x") > 0).dropDuplicates(["__h"])
    # How far the spans before reach.
    reach = F.aggregate("__x", F.array(F.lit(0)), lambda s, x: F.array_append(s, F.greatest(F.element_at(s, -1), x["end"])))
    text = F.col("text")
    piece = F.transform("__x", lambda x, i: F.concat(F.substring(text, F.get(F.col("__r"), i) + 1, F.greatest(x["start"] - F.get(F.col("__r"), i), F.lit(0))), F.when(x["start"] >= F.get(F.col("__r"), i), x["to"]).otherwise(F.lit(""))))
    rest = F.substring(text, F.element_at("__r", -1) + 1, F.char_length(text))
    out = docs.withColumn("__h0", F.md5(F.coalesce("text", F.lit("")))).join(keyed, F.col("__h0") == F.col("__h"), "left").withColumn("__r", reach)
    new = F.when(F.col("__x").isNull(), text).otherwise(F.concat(F.array_join(piece, ""), rest))
    return out.select(*(new.alias(c) if c == "text" else F.col(c) for c in docs.columns))

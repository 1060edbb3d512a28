"""Personal data: base patterns and bootstrapped contextual extraction, all in DataFrame expressions.

Base entities are found by pattern. They are the seeds: the words around them make lexical patterns, every identifier-like
token of the corpus is an instance, and a (pattern, instance) graph is scored in rounds. A pattern's confidence in a kind is
the share of its instances' scores, damped by its support; an instance no seed vouches for gets its score from the patterns
it occurs in. Instances above the threshold are added as spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.llm.common import sha256_hex, small_side, stored, text_or_empty

KINDS = ("email", "ip", "card", "phone")

#: As the contract's expressions; lookbehinds and possessive runs only spare starts that can't succeed and deep recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Identifier-like: a token with a digit or an at sign.
SLOT = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
SPAN = "array<struct<s:int,e:int,v:string>>"
#: Characters on either side in which the context words are looked for.
REACH = 80


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with code point offsets, from the pieces between the matches."""
    gaps = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                      lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("v")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.length(x["v"])
        return F.when(x["v"].isNull(), acc).otherwise(F.struct(
            e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v")))).alias("out")))

    return F.aggregate(gaps, zero, step, lambda acc: acc["out"])


def luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def accepted(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind the array of (s, e, v). A cheap look for a needed character spares most texts the pattern."""
    need = {"email": text.contains("@"), "ip": text.contains("."), "card": F.lit(True), "phone": text.contains("+")}
    none = F.array().cast(SPAN)
    return {k: F.when(need[k], F.filter(located(text, PATTERNS[k]), _keeps(k))).otherwise(none) for k in KINDS}


def _keeps(kind: str):
    return lambda x: accepted(kind, x["v"])


def _is(kind: str):
    return lambda x: x["kind"] == kind


def _named(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"))


def _contexts(text: Column, x: Column) -> Column:
    """The two lexical patterns around a span: two words on the left; one word on each side."""
    start = F.greatest(x["s"] - REACH, F.lit(0))
    left = F.lower(F.regexp_extract(F.substring(text, start + 1, x["s"] - start), r"(?:(\S+)\s+)?(\S+)\s*$", 0))
    words = F.filter(F.split(left, r"\s+"), lambda w: w != "")
    right = F.lower(F.regexp_extract(F.substring(text, x["e"] + 1, F.lit(REACH)), r"^\s*(\S+)", 1))
    return F.filter(F.array(
        F.when(F.size(words) == 2, F.concat_ws(" ", words[0], words[1], F.lit("_"))),
        F.when((F.size(words) > 0) & (right != ""), F.concat_ws(" ", F.element_at(words, -1), F.lit("_"), right))), lambda p: p.isNotNull())


def found_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc (the row as it was, as a struct), row (its id within this table), base (array of kind, s, e, v), slots (kind or null, s, e, v, patterns); stored.

    Null texts are empty. Slots are the base spans and the identifier-like tokens that overlap none of them.
    """
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_or_empty(text_col).alias("_text"))
    text = F.col("_text")
    df = df.withColumns({f"_{k}": c for k, c in base_spans(text).items()})
    df = df.withColumn("base", F.concat(*[F.transform(f"_{k}", _named(k)) for k in KINDS]))
    free = F.filter(located(text, SLOT), lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    both = F.concat("base", F.transform(free, lambda x: F.struct(F.lit(None).cast("string").alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"))))
    slots = F.transform(both, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lower(x["v"]).alias("v"), _contexts(text, x).alias("patterns")))
    df = df.withColumn("slots", slots).withColumn("row", F.monotonically_increasing_id())
    return stored(df.drop("_text", *[f"_{k}" for k in KINDS]), "pii-found")


def confident_instances(slots: DataFrame, rounds: int = 3, least: float = 0.8, support: int = 3) -> DataFrame:
    """kind, v, score of the instances no seed vouches for whose score reaches ``least``.

    ``slots``: kind, v, patterns. Seeds score 1. A pattern needs ``support`` distinct seeds of a kind; its confidence is its
    instances' summed score over their number, times s / (s + 1) for s seeds. An instance's score is 1 - product(1 - confidence)
    over its patterns. Rounds alternate between the two.
    """
    edges = stored(slots.select("kind", "v", F.explode("patterns").alias("p")).distinct(), "pii-edges")
    seeds = edges.where("kind is not null").select("kind", "v").distinct()
    sizes = edges.select("p", "v").distinct().groupBy("p").agg(F.count("*").alias("n"))
    known = edges.where("kind is not null").groupBy("kind", "p").agg(F.count_distinct("v").alias("seeds")).where(F.col("seeds") >= support)
    rated = stored(known.join(sizes, "p"), "pii-patterns")  # kind, p, seeds, n
    open_edges = stored(edges.where("kind is null").join(seeds.select("v").distinct(), "v", "left_anti")
                        .join(small_side(rated.select("p").distinct()), "p", "left_semi").select("v", "p"), "pii-open")
    scores = None
    for _ in range(rounds):
        gained = rated.withColumn("more", F.lit(0.0))
        if scores is not None:
            more = open_edges.join(scores, "v").groupBy("kind", "p").agg(F.sum("score").alias("m"))
            gained = rated.join(more, ["kind", "p"], "left").withColumn("more", F.coalesce("m", F.lit(0.0)))
        conf = F.least(F.lit(1.0), (F.col("seeds") + F.col("more")) / F.col("n")) * F.col("seeds") / (F.col("seeds") + 1)
        confidence = gained.select("kind", "p", conf.alias("conf"))
        scores = stored(open_edges.join(small_side(confidence), "p").groupBy("kind", "v").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-12)))))).alias("score")), "pii-scores")
    best = scores.groupBy("v").agg(F.max(F.struct("score", "kind")).alias("b"))
    return best.select(F.col("b.kind").alias("kind"), "v", F.col("b.score").alias("score")).where(F.col("score") >= least)


def detect(docs: DataFrame, text_col: str = "text", rounds: int = 3, least: float = 0.8, support: int = 3) -> DataFrame:
    """doc (the row as it was, as a struct), base and spans: arrays of (kind, s, e, v) by kind as listed, then start; ``spans`` has the base and the learnt ones.

    Offsets are code points, ends exclusive. Null and empty texts have none; repeated rows get equal spans; an empty table
    stays empty. Learnt spans overlap no base span.
    """
    found = found_spans(docs, text_col)
    slots = found.select("row", F.explode("slots").alias("x")).select("row", "x.*")
    learnt = stored(confident_instances(slots, rounds, least, support), "pii-learnt")
    more = slots.where("kind is null").drop("kind").join(small_side(learnt), "v").groupBy("row").agg(
        F.collect_list(F.struct("kind", "s", "e", "v")).alias("more"))
    more = stored(more, "pii-more")
    out = found.join(small_side(more), "row", "left")
    number = lambda k: F.array_position(F.array(*[F.lit(x) for x in KINDS]), k)
    whole = F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,s:int,e:int,v:string>>")))
    order = F.array_sort(F.transform(whole, lambda x: F.struct(number(x["kind"]).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x.alias("x"))))
    return out.withColumn("spans", F.transform(order, lambda x: x["x"])).drop("slots", "more", "row")


def joined(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, n_learnt."""
    d = detect(docs.select(id_col, text_col), text_col)
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return d.select(F.col(f"doc.{id_col}").alias("doc_id"), *counts, sha256_hex(joined("base")).alias("base_sha256"), joined("spans").alias("spans"),
                    (F.size("spans") - F.size("base")).cast("long").alias("n_learnt"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span in ``text_col`` replaced by its kind in brackets; overlapping spans are replaced once, by the first."""
    d = detect(docs, text_col)
    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col(f"doc.{text_col}")

    def step(acc: Column, x: Column) -> Column:
        tag = F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))
        inside = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), tag)
        return F.when(-x["e"] <= acc["at"], acc).otherwise(F.struct((-x["e"]).alias("at"), inside.alias("out")))

    made = F.aggregate(by_start, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    new = F.when(F.size("spans") == 0, text).otherwise(made).alias(text_col)
    return d.select(*[new if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns])

"""Benchmark decontamination with a positional inverted index.

Test terms are ranked by how often they occur in the training corpus. For every window of a test item the two rarest terms
are its drivers. The index stores the corpus's postings (document, position) of all driver terms, each with the words
around it. The rarest term's postings, moved back by the term's place in the window, are intersected with those of the second;
what remains is compared word by word. Exact windows and proximity matches (the drivers within a distance) come from the same
index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.llm.common import lower_ascii, only_stored, sha256_hex, small_side, stored, text_or_empty

#: Everything below 128 but letters and digits separates words.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
POSTING = ("term", "row", "pos", "before", "around")


def words_of(text: Column) -> Column:
    """Lower-cased words; null has none."""
    return F.array_remove(F.split(lower_ascii(text), BREAK), "")


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, words: ``window`` consecutive words; an item of fewer, but not none, is one window."""
    w = F.col("w")
    rows = items.select(F.col(id_col).alias("item_id"), words_of(text_or_empty(text_col)).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size(w) - window, F.lit(0))
    return rows.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(w, i + 1, F.lit(window)))).alias("words"))


def positioned(docs: DataFrame) -> DataFrame:
    """term, row, pos for every word of ``docs`` (row, w)."""
    return docs.select("row", F.posexplode("w").alias("pos", "term"))


def drivers(windows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Distinct windows with their rarest term and the second rarest: words, n, t1, o1, t2, o2 (places in the window).

    Terms rank by corpus frequency, then place; a window of one word, or of one word repeated, has its first two places.
    A window with a term that the corpus doesn't have is left out: it can't occur.
    """
    w = windows.select("words").distinct().withColumn("wid", F.sha2(F.concat_ws(" ", "words"), 256))
    terms = w.select("wid", "words", F.posexplode("words").alias("place", "term")).join(small_side(frequencies), "term", "left")
    ranked = terms.groupBy("wid", "words").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "place", "term"))).alias("r"))
    first, second = F.col("r")[0], F.when(F.size("r") > 1, F.get("r", F.lit(1))).otherwise(F.col("r")[0])
    return ranked.where(first["df"] > 0).select(
        "wid", "words", F.size("words").alias("n"), first["term"].alias("t1"), first["place"].alias("o1"), second["term"].alias("t2"), second["place"].alias("o2"))


def frequencies(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """term, df: occurrences in the corpus (row, w) of every term of the windows."""
    test_terms = stored(windows.select(F.explode("words").alias("term")).distinct(), "decontam-terms")
    return positioned(docs).join(small_side(test_terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))


def build_index(docs: DataFrame, plan: DataFrame, reach: int) -> DataFrame:
    """term, row, pos, around, at: postings of the driver terms; ``around`` has the words from ``reach`` before to ``reach`` after, ``at`` is the term's place in it."""
    terms = stored(plan.select(F.col("t1").alias("term")).union(plan.select("t2")).distinct(), "decontam-drivers")
    start = F.greatest(F.col("pos") - reach, F.lit(0))
    hits = docs.select("row", "w", F.posexplode("w").alias("pos", "term")).join(small_side(terms), "term", "left_semi")
    return hits.select("term", "row", "pos", F.slice("w", start + 1, F.lit(2 * reach + 1)).alias("around"), (F.col("pos") - start).alias("at"))


def exact_matches(index: DataFrame, plan: DataFrame) -> DataFrame:
    """row, start, n, wid: every occurrence of a window in a document."""
    lead = index.join(small_side(plan), index["term"] == plan["t1"]).select(
        "row", (F.col("pos") - F.col("o1")).alias("start"), "wid", "words", "n", "around", (F.col("at") - F.col("o1")).alias("from"))
    lead = lead.where("from >= 0")
    second = index.select("term", "row", "pos").join(small_side(plan.select("t2", "o2", "wid")), F.col("term") == F.col("t2")).select(
        "row", (F.col("pos") - F.col("o2")).alias("start"), "wid")
    both = lead.join(second, ["row", "start", "wid"])
    return both.where(F.slice("around", F.col("from") + 1, F.col("n")) == F.col("words")).select("row", "start", "n", "wid")


def proximity_matches(index: DataFrame, plan: DataFrame, within: int) -> DataFrame:
    """row, wid, pos, distance: places where a window's two driver terms stand at most ``within`` words apart, the nearest pair per place.

    Positions are compared within one bucket of ``within`` words and its neighbours, so the join stays an equi-join.
    """
    width = max(1, within)
    lead = index.select("term", "row", "pos").join(small_side(plan.select("t1", "wid")), F.col("term") == F.col("t1")).select(
        "row", "wid", "pos", F.explode(F.array(*[F.floor(F.col("pos") / width) + d for d in (-1, 0, 1)])).alias("b"))
    second = index.select("term", "row", "pos").join(small_side(plan.select("t2", "wid")), F.col("term") == F.col("t2")).select(
        "row", "wid", F.col("pos").alias("pos2"), F.floor(F.col("pos") / width).alias("b"))
    gap = F.abs(F.col("pos2") - F.col("pos"))
    return lead.join(second, ["row", "wid", "b"]).where(gap <= within).groupBy("row", "wid", "pos").agg(F.min(gap).alias("distance"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """An id per row that a second reading gives again; equal rows share it and are judged alike."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def verdicts(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """row, n_hit, items (sorted ids as text) of the contaminated rows."""
    def judged() -> DataFrame:
        windows = stored(item_windows(items, window, item_col, item_text_col), "decontam-windows")
        keyed = docs.select(row_key(id_col, text_col).alias("row"), words_of(text_or_empty(text_col)).alias("w"))
        plan = stored(drivers(windows, stored(frequencies(keyed, windows), "decontam-df")), "decontam-plan")
        index = stored(build_index(keyed, plan, window - 1), "decontam-index")
        hits = stored(exact_matches(index, plan).distinct(), "decontam-hits")
        cover = hits.groupBy("row").agg(F.collect_set(F.struct("start", "n")).alias("c")).select("row", F.size(F.array_distinct(F.flatten(
            F.transform("c", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1))))).cast("long").alias("n_hit"))
        named = windows.select(F.sha2(F.concat_ws(" ", "words"), 256).alias("wid"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct()
        of = hits.select("row", "wid").distinct().join(small_side(named), "wid").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
        return cover.join(of, "row")

    return only_stored(judged, "decontam-verdict")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    Null and empty texts have no words; items without words have no windows; null item ids count as one item, written as an
    empty string. Repeated rows are judged alike and separately; without items nothing is contaminated. Other columns are ignored.
    """
    verdict = verdicts(docs, items, window, id_col, text_col, item_col, item_text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row"), F.size(words_of(text_or_empty(text_col))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.join(small_side(verdict), "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        sha256_hex(F.concat_ws(",", F.coalesce("items", none))).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of ``items``."""
    bad = verdicts(docs, items, window).select(F.col("row").alias("_row"))
    return docs.join(small_side(bad), row_key() == F.col("_row"), "left_anti")

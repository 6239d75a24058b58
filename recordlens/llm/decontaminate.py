"""Benchmark decontamination by templates: built-in functions only.

Numbers, units and names become typed placeholders, so that a question with other values has the
same template. Windows of template words are hash-joined with those of the benchmark, and what
the placeholders stood for must map consistently from the item to the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.llm.scratch import Scratch

#: Placeholders: private-use characters, which take part in words.
NUMBER, UNIT, NAME = "", "", ""
#: The signs, and those that stand for the characters of ``IN_VALUES`` within a value.
SIGNS = "".join(map(chr, range(0xe000, 0xe00d)))
IN_VALUES = ".,:/%°-'’ "
#: Fixed list of units that count as such behind a number.
UNITS = ("km|cm|mm|m|kg|mg|g|lb|lbs|oz|ml|l|mi|ft|in|yd|s|sec|min|h|hr|hrs|hours?|minutes?|"
         "seconds?|days?|weeks?|months?|years?|meters?|metres?|miles?|feet|inch(?:es)?|grams?|"
         "kilograms?|litres?|liters?|dollars?|euros?|cents?|percent|usd|eur|kmh|mph|kwh|mb|gb|tb")
PATTERNS = (
    (UNIT, rf"(?<=\d)[ ]?(?:%|[°][CF]|(?i:{UNITS})(?![\p{{L}}\p{{N}}]))"),
    (NUMBER, r"\d+(?:[.,:/]\d+)*"),
    # a capital that doesn't begin a sentence or a line
    (NAME, r"\p{Lu}(?<=[\p{Ll}\p{N},;\x{e000}\x{e001}] \p{Lu})[\p{Ll}]+(?:[-'’]\p{Lu}?\p{Ll}+)?"),
)
#: Windows up to this number are broadcast (about 50 MB); beyond it the join shuffles.
BROADCAST_WINDOWS = 1_000_000


def templates(df: DataFrame, text_col: str, width: int, min_literal: int, lengths: list[int],
              *keep: Column) -> DataFrame:
    """``keep`` with ``words``, their number, and ``windows``: key, own and span of every run of
    ``width`` words, and of every run of as many words as ``lengths`` has.

    Each pass replaces one kind of placeholder; its matches are put back behind the signs, so
    that a placeholder is a word that holds its value. A window's key is the hash of its
    words with bare signs, and ``own`` the values; a window with fewer than ``min_literal`` other
    words, and a run of another length, says too little that way: its key is the hash of its
    words with all values in them, and ``own`` is empty.
    """
    names = [f"_keep{i}" for i in range(len(keep))]
    # the signs themselves count as blanks in a text
    current = F.translate(F.coalesce(text_col, F.lit("")), SIGNS, " " * len(SIGNS))
    rows = df.select(*[k.alias(n) for k, n in zip(keep, names, strict=True)],
                     current.alias("_text0"))
    for i, (sign, pattern) in enumerate(PATTERNS):
        rows = rows.withColumns({
            f"_values{i}": F.regexp_extract_all(f"_text{i}", F.lit(pattern), F.lit(0)),
            f"_text{i + 1}": F.regexp_replace(f"_text{i}", pattern, f" {sign} ")})
    filled = F.lower(f"_text{len(PATTERNS)}")
    for i, (sign, _) in enumerate(PATTERNS):
        value = lambda v: F.translate(F.lower(F.trim(v)), IN_VALUES, SIGNS[3:])
        put = F.array_join(F.zip_with(F.split(filled, sign), f"_values{i}", lambda part, v: F.concat(
            part, F.when(v.isNotNull(), F.concat(F.lit(sign), value(v))).otherwise(""))), "")  # noqa: B023
        filled = F.when(F.size(f"_values{i}") > 0, put).otherwise(filled)
    rows = rows.withColumn("_filled", filled)
    rows = rows.withColumn("words", F.array_remove(
        F.split("_filled", rf"[^\p{{L}}\p{{N}}{SIGNS[0]}-{SIGNS[-1]}]+"), ""))
    # every array is a column of its own before a lambda uses it, or it would be computed again
    # for each element
    slots = F.size("_values0") + F.size("_values1") + F.size("_values2")
    is_slot = lambda w: (w >= SIGNS[0]) & (w < SIGNS[3])
    bare = lambda w: F.when(is_slot(w), F.substring(w, 1, 1)).otherwise(w)
    literal = lambda w: F.when(is_slot(w), w.substr(F.lit(2), F.length(w))).otherwise(w)
    none = F.array().cast("array<string>")
    rows = rows.withColumns({
        "_bare": F.when(slots > 0, F.transform("words", bare)).otherwise(F.col("words")),
        "_literal": F.when((slots > 0) if lengths else (slots > width - min_literal),
                           F.transform("words", literal)).otherwise(F.col("words")),
        "_dense": slots > width - min_literal, "_slots": slots})

    def at_width(i: Column) -> Column:
        own = F.when(F.col("_slots") > 0,
                     F.filter(F.slice("words", i, width), is_slot)).otherwise(none)
        plain = F.struct(F.xxhash64(F.slice("_bare", i, width)).alias("key"), own.alias("own"),
                         i.alias("at"), F.lit(width).alias("span"))
        dense = F.struct(F.xxhash64(F.lit(0), F.slice("_literal", i, width)).alias("key"),
                         none.alias("own"), i.alias("at"), F.lit(width).alias("span"))
        return F.when(F.col("_dense") & (F.size(own) > width - min_literal), dense) \
            .otherwise(plain)

    def at_length(n: int) -> Column:
        return F.when(F.size("words") >= n, F.transform(
            F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.struct(
                F.xxhash64(F.lit(n), F.slice("_literal", i, n)).alias("key"), none.alias("own"),
                i.alias("at"), F.lit(n).alias("span"))))

    kind = "array<struct<key:bigint,own:array<string>,at:int,span:int>>"
    empty = F.array().cast(kind)
    windows = F.when(F.size("words") >= width, F.transform(
        F.sequence(F.lit(1), F.size("words") - width + 1), at_width)).otherwise(empty)
    short = [F.coalesce(at_length(n), empty) for n in lengths]
    if short:
        windows = F.concat(windows, *short)
    kept = [F.col(n).alias(df.select(k).columns[0]) for k, n in zip(keep, names, strict=True)]
    return rows.select(*kept, "words", F.size("words").alias("n_words"),
                       windows.cast(kind).alias("windows"))


def item_windows(benchmark: DataFrame, width: int, min_literal: int, min_words: int,
                 id_col: str, text_col: str) -> DataFrame:
    """Windows of the items with what stands in their slots; of an item with fewer than ``width``
    words one, the whole item. Items with fewer than ``min_words`` have none."""
    rows = templates(benchmark, text_col, width, min_literal, [*range(min_words, width)],
                     F.col(id_col).cast("long").alias("item_id"))
    rows = rows.select("item_id", F.col("n_words").alias("item_words"),
                       F.explode_outer("windows").alias("w")).where("w IS NOT NULL")
    whole = F.least(F.col("item_words"), F.lit(width))
    return rows.where(F.col("w.span") == whole).select(
        "item_id", "item_words", F.col("w.at").alias("item_at"), F.col("w.key").alias("key"),
        F.col("w.own").alias("item_own"), F.col("w.span").alias("span"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, min_literal: int = 4,
                 min_coverage: float = 0.5, min_words: int = 4, id_col: str = "doc_id",
                 text_col: str = "text", item_id_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, coverage, n_windows, reparameterised: the documents that hold an item.

    An item is held if windows along consistent alignments cover at least ``min_coverage`` of its
    words; an alignment is consistent if every slot value of the item always meets the same
    value in the document. ``reparameterised``: some value differs. A window of ``width`` words
    with fewer than ``min_literal`` words beside placeholders, and an item of fewer than ``width``
    words as a whole, must occur with the item's own values. Items with fewer than ``min_words``
    words never match: they can't be told from ordinary phrases. Null and empty texts
    match nothing. Equal rows are one document; rows that share an id but not the text are
    judged apart, and the id is reported if one of them matches; so it is with items. Work and
    memory are linear in a text, however long or full of numbers. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = Scratch(spark, "decontaminate").keep(
        item_windows(benchmark, width, min_literal, min_words, item_id_col, item_text_col),
        "windows")
    lengths = sorted(r[0] for r in items.where(F.col("span") < width).select("span").distinct()
                     .collect())  # at most ``width`` numbers
    items = F.broadcast(items) if items.count() <= BROADCAST_WINDOWS else items
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = templates(docs, text_col, width, min_literal, lengths,
                     F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"))
    # outer: else Spark derives a filter that computes every array again below the explode
    found = rows.select("doc_id", "version", F.explode_outer("windows").alias("w")) \
        .select("doc_id", "version", F.col("w.key").alias("key"), F.col("w.own").alias("own"),
                F.col("w.at").alias("at"), F.col("w.span").alias("span")) \
        .join(items, ["key", "span"])
    hits = found.select(
        "doc_id", "version", "item_id", "item_words", "item_at", "span",
        (F.col("at") - F.col("item_at")).alias("shift"),
        F.zip_with("item_own", "own", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        .alias("pairs"))
    aligned = hits.groupBy("doc_id", "version", "item_id", "item_words", "span", "shift").agg(
        F.collect_set("item_at").alias("at"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    aligned = aligned.where(F.size("pairs") == F.size(F.array_distinct(
        F.transform("pairs", lambda p: p["a"]))))
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        F.flatten(F.collect_set("at")), lambda a: F.sequence(a, a + F.col("span") - 1)))))
    found = aligned.groupBy("doc_id", "version", "item_id", "item_words", "span").agg(
        covered.alias("covered"),
        F.size(F.array_distinct(F.flatten(F.collect_set("at")))).alias("n_windows"),
        F.max(F.exists("pairs", lambda p: ~p["a"].eqNullSafe(p["b"]))).alias("other"))
    return found.withColumn("coverage", F.col("covered") / F.col("item_words")) \
        .where(F.col("coverage") >= min_coverage).groupBy("doc_id", "item_id").agg(
            F.max("coverage").alias("coverage"),
            F.max("n_windows").cast("long").alias("n_windows"),
            F.max("other").alias("reparameterised"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                        **options) -> DataFrame:
    """The rows of documents that hold no item. Rows without an id stay."""
    ids = contaminated(docs, benchmark, id_col=id_col, **options) \
        .select(F.col("doc_id").alias("_leaked")).distinct()
    ids = Scratch(docs.sparkSession, "decontaminate").keep(ids, "leaked")
    return docs.join(ids, F.col(id_col) == F.col("_leaked"), "left_anti")

"""Language identification by fusing text, declared language, address suffix and host.

Text: naive Bayes over hashed byte trigrams. Declared markup language: how often a text of each
language carries that declaration. Address suffix and host: language shares, those of a host
smoothed towards its suffix's, those of a suffix towards the overall ones. Everything is counted
over all documents by grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.llm.scratch import Scratch

#: Trigrams are hashed into this many buckets.
BUCKETS = 1 << 15
#: Name of the class of texts in none of the languages: all trigrams are equally likely.
UNKNOWN = "und"
#: Overlapping trigrams repeat evidence; each text's log-likelihood is divided by this.
OVERLAP = 3.0
#: Bytes of text counted at a time.
CHUNK = 1 << 22
#: Languages with a class of their own, and languages counted at a time in a task.
MOST_LANGUAGES, HELD = 400, 64
DECLARED = r"^([a-z]{2,3})(?:[-_].*)?$"


@dataclass(frozen=True)
class TextModel:
    """Log-probabilities of trigram buckets per language; the last language is UNKNOWN."""

    languages: tuple[str, ...]
    weights: np.ndarray


def declared_language(column: str) -> Column:
    """Primary subtag in lower case; null for what isn't a language tag."""
    found = F.regexp_extract(F.lower(F.trim(F.col(column))), DECLARED, 1)
    return F.when(found != "", found)


def host_of(url: str) -> Column:
    """Host in lower case without user, port, and www or m in front."""
    host = F.regexp_extract(F.lower(F.col(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(host, r"^.*@|:\d*$", ""), r"^(?:www\d*|m)\.", "")


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"\.([a-z]+)$", 1)


def markup_language(html: str) -> Column:
    """The lang attribute of the html element."""
    return F.regexp_extract(F.col(html), r"(?i)<html\b[^>]*\slang\s*=\s*[\"']?([A-Za-z_-]+)", 1)


def trigrams(data: np.ndarray) -> np.ndarray:
    """Buckets of the byte trigrams; letters A-Z count as a-z, every run of bytes that aren't
    letters (digits, signs, white space) as one blank."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    data = np.where(letter, data, 32)
    data = data[letter | np.r_[True, letter[:-1]]].astype(np.uint32)
    if not letter.any() or len(data) < 3:
        return np.zeros(0, np.int32)
    code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return (code * np.uint32(2654435761) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(
        np.int32)


def _letters(text: pa.Scalar) -> Iterator[np.ndarray]:
    """Trigrams of a text between blanks, chunk by chunk."""
    if not text.is_valid or not len(text.as_buffer()):
        return
    data = np.r_[np.uint8(32), np.frombuffer(text.as_buffer(), np.uint8), np.uint8(32)]
    for i in range(0, max(len(data) - 2, 0), CHUNK):
        yield trigrams(data[i:i + CHUNK + 2])


def fit_text_model(rows: DataFrame, min_trigrams: int = 1000,
                   most: int = MOST_LANGUAGES) -> TextModel:
    """From columns text (binary) and declared, over all documents that declare a language.

    Every language with ``min_trigrams`` of text gets a class, however small its share; of more
    than ``most`` those with the most text. Counts stay in Spark; the driver gets one row per
    bucket of the chosen languages.
    """
    def work(batches):
        counts: dict[str, np.ndarray] = {}

        def told():
            for name, count in counts.items():
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_pydict({"declared": [name] * len(at), "bucket": at,
                                                  "n": count[at]})
            counts.clear()

        for batch in batches:
            for text, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for found in _letters(text):
                    if name not in counts:
                        if len(counts) >= HELD:
                            yield from told()
                        counts[name] = np.zeros(BUCKETS, np.int64)
                    counts[name] += np.bincount(found, minlength=BUCKETS)
        yield from told()

    scratch = Scratch(rows.sparkSession, "language-model")
    counted = scratch.keep(
        rows.where("declared IS NOT NULL").select("text", "declared")
        .mapInArrow(work, "declared string, bucket long, n long")
        .groupBy("declared", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    chosen = counted.groupBy("declared").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= min_trigrams).orderBy(F.desc("n"), "declared").limit(most)
    names = sorted(r[0] for r in chosen.collect())
    if not names:
        return TextModel((UNKNOWN,), np.full((BUCKETS, 1), -np.log(BUCKETS), np.float32))
    counts = np.full((BUCKETS, len(names)), 0.5)
    for name, buckets, values in counted.where(F.col("declared").isin(names)) \
            .groupBy("declared").agg(F.collect_list("bucket"), F.collect_list("n")).collect():
        counts[buckets, names.index(name)] += values
    weights = np.log(counts / counts.sum(0))
    flat = np.full((BUCKETS, 1), -np.log(BUCKETS))
    return TextModel((*names, UNKNOWN), np.hstack([weights, flat]).astype(np.float32))


def score_texts(rows: DataFrame, model: TextModel) -> DataFrame:
    """row, declared, suffix, host, and loglik, one value per language, for each text."""
    languages, weights = model.languages, np.ascontiguousarray(model.weights.T)

    def work(batches):
        for batch in batches:
            found = np.zeros((batch.num_rows, len(languages)))
            for i, text in enumerate(batch.column(0)):
                for grams in _letters(text):
                    counts = np.bincount(grams, minlength=BUCKETS) if len(grams) > BUCKETS else None
                    if counts is not None:
                        found[i] += weights @ counts
                    else:
                        found[i] += weights[:, grams].sum(1, dtype=np.float64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(languages)),
                pa.array((found / OVERLAP).ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, 5)), lists],
                                             ["doc_id", "declared", "suffix", "host", "loglik"])

    return rows.select("text", "doc_id", "declared", "suffix", "host").mapInArrow(
        work, "doc_id long, declared string, suffix string, host string, loglik array<double>")


def _posterior(log_values: Column) -> Column:
    """Normalised exponentials of an array."""
    top = F.array_max(log_values)
    return F.transform(log_values, lambda x: F.exp(x - top))


def _shares(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Summed text posteriors per key, one array in the order of the languages."""
    return rows.groupBy(*keys).agg(F.array(*[
        F.sum(F.get("post", F.lit(i))) for i in range(n)]).alias("counts"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             declared: Column | None = None, host: Column | None = None,
             suffix: Column | None = None, min_posterior: float = 0.6, smoothing: float = 20.0,
             model: TextModel | None = None) -> DataFrame:
    """doc_id, lang, posterior, text_lang, kept per document.

    The posterior of a language is its text likelihood times the chance of the declaration given
    the language times the host's prior. A host's counts are smoothed by ``smoothing`` pseudo-
    counts from its suffix, a suffix's by as many from the whole. ``kept``: the best language
    isn't UNKNOWN and has at least ``min_posterior``. A text that is most like UNKNOWN but
    declares a language without a class, for want of text, is taken at its word. Texts that are
    null or have no letters say nothing; they get UNKNOWN and aren't kept. A missing
    declaration, host or suffix is a value like any other. Of equal posteriors the first name
    in the alphabet wins, and UNKNOWN comes last. Repeated rows are judged alike, a long text is
    counted in chunks, an empty table gives no rows, and other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "language-id")
    none = F.lit(None).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
        (none if declared is None else declared).alias("declared"),
        F.coalesce(none if suffix is None else suffix, F.lit("")).alias("suffix"),
        F.coalesce(none if host is None else host, F.lit("")).alias("host"))
    model = fit_text_model(rows) if model is None else model
    n = len(model.languages)
    names = F.array(*map(F.lit, model.languages))
    scored = score_texts(rows, model)
    weight = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    scored = scored.withColumn("declared", F.coalesce("declared", F.lit(""))) \
        .withColumn("raw", _posterior(F.col("loglik"))) \
        .withColumn("post", F.transform("raw", lambda x: x / weight)).drop("raw")
    scored = scored.withColumn("silent", F.get("loglik", F.lit(n - 1)) == 0.0)
    scored = scratch.keep(scored, "scored")

    heard = scored.where(~F.col("silent"))
    hosts = scratch.keep(_shares(heard, ["suffix", "host", "declared"], n), "hosts")

    def summed(keys: list[str], name: str) -> DataFrame:
        return hosts.groupBy(*keys).agg(F.array(*[
            F.sum(F.get("counts", F.lit(i))) for i in range(n)]).alias(name))

    whole = summed([], "all")
    overall = whole.first()[0] or [None] * n
    overall = np.array([0.0 if x is None else x for x in overall]) + 1.0
    share = F.array(*[F.lit(float(x)) for x in overall / overall.sum()])

    def smoothed(counts: Column, prior: Column) -> Column:
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, prior, lambda c, p: (c + smoothing * p) / (size + smoothing))

    suffixes = summed(["suffix"], "own").select("suffix", smoothed(F.col("own"), share)
                                                .alias("suffix_prior"))
    priors = summed(["suffix", "host"], "own").join(suffixes, "suffix").select(
        "suffix", "host", smoothed(F.col("own"), F.col("suffix_prior")).alias("prior"))
    # chance of the declaration given the language, one pseudo-count spread over declarations
    declarations = summed(["declared"], "own")
    kinds = max(declarations.count(), 1)
    said = declarations.select("declared", F.zip_with(
        "own", F.array(*[F.lit(float(x)) for x in overall]),
        lambda c, t: (c + 1.0 / kinds) / t).alias("said"))

    fused = scored.join(priors, ["suffix", "host"], "left").join(said, "declared", "left") \
        .withColumn("prior", F.coalesce("prior", share)) \
        .withColumn("said", F.coalesce("said", F.array_repeat(F.lit(1.0), n)))
    logs = F.zip_with(F.zip_with("loglik", "prior", lambda a, b: a + F.log(b)), "said",
                      lambda a, b: a + F.log(b))
    fused = fused.withColumn("logs", logs).withColumn("odds", _posterior(F.col("logs"))) \
        .withColumn("best", F.array_position("odds", F.array_max("odds")).cast("int"))
    unclassed = (F.col("best") == n) & (F.col("declared") != "") & ~F.col("declared").isin(
        list(model.languages))
    chosen = F.when(F.col("silent"), UNKNOWN).when(unclassed, F.col("declared")) \
        .otherwise(F.element_at(names, F.col("best")))
    posterior = F.lit(1.0) / F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    text_best = F.array_position("loglik", F.array_max("loglik")).cast("int")
    return fused.select(
        "doc_id", chosen.alias("lang"), posterior.alias("posterior"),
        F.when(F.col("silent"), UNKNOWN).otherwise(F.element_at(names, text_best))
        .alias("text_lang")) \
        .withColumn("kept", (F.col("lang") != UNKNOWN) & (F.col("posterior") >= min_posterior))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows whose language is identified. Of rows that share an id all stay if one does; rows
    without an id are judged by their text like others, together."""
    found = identify(docs, id_col=id_col, **options)
    judged = found.groupBy("doc_id").agg(F.max("kept").alias("kept"))
    rejected = Scratch(docs.sparkSession, "language-id").keep(
        judged.where(~F.col("kept")).select(F.col("doc_id").alias("_rejected")), "rejected")
    return docs.join(rejected, F.col(id_col).eqNullSafe(F.col("_rejected")), "left_anti")

import numpy as np
from pyspark.sql import functions as F

from recordlens.llm import language_id as li
from tests.llm.conftest import SF


def identify(df, **options):
    return li.identify(df, declared=li.declared_language("lang"), host=F.col("source"), **options)


def test_documents_get_their_language(docs):
    found = identify(docs).join(docs.select("doc_id", F.col("lang").alias("own")), "doc_id")
    rows = found.collect()
    assert sum(r.lang == r.own for r in rows) >= 0.97 * len(rows)
    assert all(r.kept for r in rows)


def test_wrong_declarations_yield_to_the_text(docs):
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "fr").otherwise(F.col("lang")))
    rows = identify(wrong).join(docs.select("doc_id", F.col("lang").alias("own"), "n_chars"),
                                "doc_id").where("n_chars > 200").collect()
    assert sum(r.lang == r.own for r in rows) >= 0.97 * len(rows)


def test_short_texts_lean_on_declaration_and_host(spark, docs):
    """The same few letters, with different evidence around them."""
    few = spark.createDataFrame(
        [(10_001, "de", "fr", "hf"), (10_002, "de", "es", "he")] * 3,
        "doc_id long, text string, lang string, source string")
    columns = few.columns
    known = docs.select(columns)
    hosts = known.withColumn("source", F.concat(F.lit("h"), F.substring("lang", 1, 1)))
    found = {r.doc_id: r.lang for r in identify(hosts.unionByName(few)).where("doc_id > 10000")
             .collect()}
    assert found == {10_001: "fr", 10_002: "es"}


def test_texts_without_letters_are_rejected(spark, docs):
    odd = spark.createDataFrame(
        [(20_001, None), (20_002, ""), (20_003, " \n "), (20_004, "123 456 !!! 789"),
         (20_005, "中文" * 200)], "doc_id long, text string")
    odd = odd.withColumn("lang", F.lit("en")).withColumn("source", F.lit("src1"))
    found = identify(docs.select(odd.columns).unionByName(odd)).where("doc_id > 20000").collect()
    assert {r.doc_id: (r.lang, r.kept) for r in found if r.doc_id < 20_005} == {
        i: ("und", False) for i in range(20_001, 20_005)}
    kept = li.keep_identified(docs.select(odd.columns).unionByName(odd),
                              declared=li.declared_language("lang"), host=F.col("source"))
    assert {r.doc_id for r in kept.collect()}.isdisjoint(range(20_001, 20_005))


def test_pages_with_markup_language_and_address(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn(
        "markup", li.markup_language("html"))
    host = li.host_of("url")
    found = li.identify(pages, "page_id", "html", li.declared_language("markup"), host,
                        li.suffix_of(host))
    rows = found.join(pages, found.doc_id == pages.page_id).collect()
    assert sum(r.lang == r.markup for r in rows) >= 0.9 * len(rows)


def test_addresses(spark):
    urls = [("http://User@WWW.Example.DE:80/a?b", "example.de", "de"),
            ("//m.a.b.fr", "a.b.fr", "fr"), ("nonsense", "", ""), (None, None, None)]
    df = spark.createDataFrame([(u,) for u, _, _ in urls], "url string")
    host = li.host_of("url")
    assert [tuple(r) for r in df.select(host, li.suffix_of(host)).collect()] == [
        (h, s) for _, h, s in urls]


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    assert identify(odd_docs).count() == odd_docs.count()
    assert li.keep_identified(odd_docs, declared=li.declared_language("lang")).columns \
        == odd_docs.columns
    assert identify(no_docs).count() == 0


POLISH = "Wszystkie przedsięwzięcia żółtych gęsi źdźbłem trawy świadczą że chrząszcz brzmi w trzcinie. "


def test_rare_languages_are_not_lost(spark, docs):
    """A few documents of a language among many others; with a class, and without."""
    columns = ["doc_id", "text", "lang", "source"]
    rare = spark.createDataFrame(
        [(30_001 + i, POLISH * 4, "pl", f"s{i}") for i in range(4)]
        + [(30_010, "Ők húszan voltak a zűrzavaros történetben, és öten győztek. " * 3, "hu", "s")],
        "doc_id long, text string, lang string, source string")
    rows = docs.select(columns).unionByName(rare)
    found = {r.doc_id: (r.lang, r.kept) for r in identify(rows).where("doc_id > 30000").collect()}
    assert found == {**{30_001 + i: ("pl", True) for i in range(4)}, 30_010: ("hu", True)}
    kept = li.keep_identified(rows, declared=li.declared_language("lang"), host=F.col("source"))
    assert kept.where("doc_id > 30000").count() == 5
    undeclared = rows.withColumn("lang", F.when(F.col("doc_id") <= 30_000, F.col("lang")))
    found = identify(undeclared).where("doc_id > 30000").collect()
    assert {(r.lang, r.kept) for r in found} == {("und", False)}


def test_posterior_is_the_product_of_the_evidence(spark):
    """All numbers by hand, from the model's own weights."""
    rows = [(1, "aaa bbb aaa", "xx", "h1"), (2, "aaa aaa", "xx", "h1"), (3, "ccc ddd", "yy", "h2"),
            (4, "ccc ccc ddd", "yy", "h1"), (5, "aaa ddd", None, "h2"), (6, "aaa ddd", "xx", "h2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    raw = df.select(F.col("text").cast("binary").alias("text"), F.col("lang").alias("declared"))
    model = li.fit_text_model(raw, min_trigrams=1)
    assert model.languages == ("xx", "yy", "und")
    logs = {}
    for doc, text, _, _ in rows:
        data = np.frombuffer(f" {text} ".encode(), np.uint8)
        logs[doc] = model.weights[li.trigrams(data)].sum(0, dtype=float) / li.OVERLAP
    post = {d: np.exp(x - x.max()) / np.exp(x - x.max()).sum() for d, x in logs.items()}
    total = sum(post.values()) + 1.0
    share = total / total.sum()

    def smooth(counts, prior):
        return (counts + 20 * prior) / (counts.sum() + 20)

    def summed(position, value):
        return sum((post[r[0]] for r in rows if r[position] == value), np.zeros(3))

    suffix = smooth(sum(post.values()), share)
    found = {r.doc_id: r for r in identify(df, model=model).collect()}
    for doc, _, lang, host in rows:
        said = (summed(2, lang) + 1 / 3) / total
        odds = np.exp(logs[doc]) * smooth(summed(3, host), suffix) * said
        odds /= odds.sum()
        assert found[doc].lang == model.languages[odds.argmax()]
        assert abs(found[doc].posterior - odds.max()) < 1e-6

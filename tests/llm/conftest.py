import pytest

SF = "/root/testdata/sf0.001"
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with clashing names."""
    rows = [
        (1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (4, ""), (5, "  \n\t "),
        (6, "word " * 6000), (7, "x" * 9000), (8, "A B c D e f G h"), (2, "a b c d e f g h"),
        (None, "a b c d e f g h"), (9, "Größe naïve café \U0001f600 " * 30), (9, "another text"),
        (10, "12 km   ... \x1c odd\r\nspace\x0bs")]
    return spark.createDataFrame(
        [(i, t, "en", "s", 1, 2, 3) for i, t in rows],
        "doc_id long, text string, lang string, source string, version int, fp int, ranges int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

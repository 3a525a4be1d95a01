import pytest


@pytest.fixture(scope="session")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""
    long_text = "long words here and there, " * 4000
    rows = [
        (1, "The same text of ten words or more, to be kept as it is here.", "en", "words", 5),
        (2, "The same text of ten words or more, to be kept as it is here.", "en", "words", 5),
        (2, "The same text of ten words or more, to be kept as it is here.", "en", "words", 5),
        (3, None, None, None, None),
        (None, "A row without id, though with a text of more than ten words in it.", "en", "x", 1),
        (4, "", "en", "x", 0),
        (5, "  \n\t ", "fr", "x", 4),
        (6, long_text, "en", "x", len(long_text)),
        (7, "Ünïcode ñandú 日本語 👍 text; password=abcdef123 and more words to reach ten of them.", "de", "x", 1),
        (8, "one\ntwo\none\none\ntwo", "de", "x", 1),
    ]
    schema = "doc_id bigint, text string, lang string, words string, rid bigint"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none_left(odd):
    return odd.where("1 = 0")

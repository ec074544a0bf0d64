import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    """Texts that operators must take: null, empty, blank, short, repeated, long, unsplit, other scripts."""
    return [None, "", "  \n ", "a", "a", "one two three", "one two three", "x" * 5000, "word " * 3000, "İstanbul é é <|endoftext|> \x1c ½",
            "日本語のテキスト 😀", "don't I'LL  stop\t\t now \n\n"]


@pytest.fixture(scope="session")
def odd(spark, texts):
    """Such texts as documents with repeated rows, null ids and columns whose names operators use themselves."""
    rows = [(i, t, ["en", None, "de"][i % 3], ["s0", "s0", "s1", None][i % 4], 0, i, "clash", i * 2) for i, t in enumerate(texts)]
    rows += [rows[5], rows[8], (None, "no id", "en", "s0", 0, 1, "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, key string, size long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")

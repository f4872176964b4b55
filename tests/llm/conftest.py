import pytest


@pytest.fixture(scope="session")
def texts():
    """Texts with the odd cases: null, empty, ties, long words, special tokens, white space of all kinds."""
    return [None, "", " ", "a", "The cat's  hat.\n\n\tÉcole  déjà-vu  ", "x" * 5000, "ab" * 400 + " <|endoftext|> tail<|endoftext|>", "naïve café 123,456 ½ …  em nb \x1c\x85z",
            "日本語テキスト と 漢字", "é combining İ ǅ", "'S 's'll don't IT'S", "same text", "same text", "👩‍👩‍👧 emoji!!??", "�​ zero", "word " * 3000, "A$$$ re%%% <|startoftext|>x"]


def frame(spark, texts, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], schema)

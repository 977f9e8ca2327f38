import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """make(rows): a documents table from (doc_id, text[, lang, source]) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, COLUMNS)

    return make


#: nulls, empties, ties, repeated rows, wide characters, bytes that need care
ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "a"), (4, "one two"), (4, "one two"), (None, "no id here"), (5, "ÄÖ ñ ¿ 漢字 \U0001f600 é"), (6, "x" * 5000), (7, "nul\0byte and more words to read here"), (8, "Same words again and again. " * 40), (9, "Same words again and again. " * 40)]

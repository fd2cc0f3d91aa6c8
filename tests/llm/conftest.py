import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) pairs, with null in every other column."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC)
        if extra:  # names that the operators use themselves
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("x") for c in ("score", "leaks", "lang_pred", "held_out", "text_read", "raw_text", "k1", "n", "key", "component", "id", "order", "h1")})
        return df

    return make


#: Rows that every operator on documents has to stand: nulls, empty, blank, repeated, equal ids, no words of letters.
ODD = [(None, None), (None, "a b c"), (1, None), (2, ""), (3, " \t\n"), (4, "same words here again"), (4, "same words here again"), (5, "other text"), (5, "and another"), (6, "é漢🙂 \x00 \x1c x"), (7, "word " * 3000)]

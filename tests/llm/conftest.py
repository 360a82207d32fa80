import pytest

#: Columns whose names the operators use inside, to see that extra columns don't clash.
EXTRA = ["size", "h", "key", "n", "t", "code", "bucket", "whole", "edge", "vec", "slot", "label", "a b.c"]


@pytest.fixture(scope="session")
def make_documents(spark):
    """Documents from (doc_id, text, source) rows, with clashing extra columns."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        df = spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], schema)
        for name in EXTRA:
            df = df.withColumn(name, df["doc_id"].cast("string"))
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated and near-equal rows."""
    base = " ".join(f"word{k} und{k % 7}" for k in range(60))
    return [
        (1, base, "a"), (2, base, "a"), (3, base.replace("word30", "other"), "b"), (3, base.replace("word30", "other"), "b"),
        (4, None, "a"), (5, "", None), (6, " \t\n\x0b\x0c\r", "c"), (7, "one", "c"), (8, "one two three", "ä"),
        (None, "nobody's text here, six words long", "a"), (None, None, None), (9, "x" * 50_000, "b"),
        (10, "again and again " * 4_000, "b"), (11, "again and again " * 4_000, None), (12, "ÀÉ ñandú 日本語 text with breaks", "d"),
        (13, "same id, first text of it", "d"), (13, "same id, second text of it", "d"), (14, base + " tail", "e"), (14, base + " tail", "e"),
    ]

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def docs(spark):
    """Makes a table of documents from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows, extra=None):
        full = [(r + ("en", "src0"))[:4] if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOCS)
        return df if extra is None else df.selectExpr("*", *extra)

    return make


#: Rows that every operator must bear: nulls, empty and very long texts, repeated rows.
HARD = [
    (1, None, None, None), (2, "", "en", "src0"), (3, "   \n\t ", "en", None), (4, "word", None, "src0"), (5, "w " * 60_000, "en", "src0"),
    (None, "no id at all here", "en", "src0"), (6, "same row twice over", "en", "src0"), (6, "same row twice over", "en", "src0"), (7, "é" * 5000, "fr", "src1"),
    (8, "\U0001f600 emoji \U0001f600 and \u0000 nul", "en", "src1"),
]

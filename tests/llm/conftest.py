import pytest
from pyspark.sql import Row

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or from ``(id, text, source)`` rows; extra columns clash with operators' names."""

    def make(rows):
        full = []
        for k, r in enumerate(rows):
            i, text, source = r if isinstance(r, tuple) else (k, r, f"s{k % 3}")
            full.append((i, text, "en", source, len(text or "")))
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """A folder with ``documents`` and ``labels`` tables, as queries read them."""

    def make(docs, labels=()):
        folder = str(tmp_path_factory.mktemp("tables"))
        docs.write.parquet(f"{folder}/documents.parquet")
        rows = spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")
        rows.write.parquet(f"{folder}/labels.parquet")
        return folder

    return make


#: What every operator has to take: nulls, empty and repeated rows, clashing names.
@pytest.fixture(scope="session")
def odd_docs(spark, docs_of):
    long_text = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, "one", "b"), (5, "one two", "b"), (6, "One two three", "b"),
        (6, "One two three", "b"), (7, "one two THREE", "b"), (8, long_text, "c"), (9, long_text, "c"), (10, "é" * 400, None),
        (11, "é" * 400, "d"), (None, "no id here", "a"), (None, None, None), (12, "mail me@x.org or 10.0.0.1 now", "a"),
    ]
    from pyspark.sql import functions as F

    extra = {c: F.lit("x") for c in ("id", "key", "score", "kept", "keep_id", "text_sha256", "block", "n", "rep", "doc", "bucket")}
    return docs_of(rows).withColumns(extra)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


__all__ = ["Row", "plain"]

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def write_docs(spark, tmp_path):
    """Writes rows as the documents table of a folder and returns the folder."""

    def write(rows, **tables):
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        spark.createDataFrame(full, DOCS).withColumnRenamed("n_chars", "n_chars").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        for name, (values, schema) in tables.items():
            spark.createDataFrame(values, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write

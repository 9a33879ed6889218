import pytest

#: Columns whose names the operators might use themselves.
CLASHING = ("h", "n", "norm", "key", "salt", "sig", "size", "label_", "every", "root", "id", "value", "__id", "__d")


@pytest.fixture()
def documents(spark):
    def make(rows):
        """documents with clashing columns from (doc_id, text)."""
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
        full = [(i, t, None, None, None if t is None else len(t), *("x" for _ in CLASHING)) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make

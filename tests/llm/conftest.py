import pytest
from pyspark.sql import types as T

COLUMNS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                        T.StructField("n_chars", T.LongType()),
                        # names that the operators use inside
                        T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType()),
                        T.StructField("n", T.LongType())])

#: Odd texts: null, empty, blank, line ends, repeats, other scripts, long runs.
ODD = [None, "", " ", "\n\n", "a", "a  b\t c\r\nd", "idiot " * 3, "x" * 5000, "1" * 3000, "é ü ß 中文 字 🙂  z",
       "it's  we'll\n\n  they'VE 12345 &&&", "A b C d e", "a B c D E", "\x1c\x85 Σς ǅ İ", "word " * 4000]


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, partitions=3):
        full = [(i, t, "en", "s", None, "clash", 1.0, 2) for i, t in rows]
        return spark.createDataFrame(full, COLUMNS).repartition(partitions)
    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Odd texts, a repeated row, a null id."""
    rows = [(i, t) for i, t in enumerate(ODD)]
    return docs_of(rows + [(5, ODD[5]), (None, "a  b\t c\r\nd")])

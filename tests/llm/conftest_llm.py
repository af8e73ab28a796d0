import pytest
from pyspark.sql import types as T

from commitloom.llm.common import prepare

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
#: null and blank texts, a null id, repeated rows, ties, text beyond ASCII, one very long text
AWKWARD = [
    (3, None), (4, ""), (5, "  \n\t \n"), (6, "One two three. Four five six!"), (6, "One two three. Four five six!"),
    (7, "One two three. Four five six!"), (8, "x"), (None, "a null id"), (9, "Ünï çodé 日本語。 ¿qué? — ✓ \U0001f600"),
    (10, LONG), (11, LONG + " tail"), (2**40, "far id " * 30), (12, "İstanbul d'S <|endoftext|> it's 10%"),
]


@pytest.fixture(scope="session")
def make(spark):
    prepare(spark)

    def frame(rows, extra=False):
        full = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:  # names the operators use inside
            for name in ("tie", "doc", "part", "row", "hits", "items", "cut", "score", "print", "node", "id", "line", "kept"):
                df = df.selectExpr("*", f"cast(null as string) as {name}")
        return df

    return frame


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    taken = {i for i, _ in AWKWARD}
    return [(r.doc_id, r.text) for r in rows if r.doc_id not in taken]

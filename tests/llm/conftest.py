import pytest

pytest.importorskip("sparkwave.llm")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls, empties, ties, repeated rows, a very long text and columns with clashing names."""
    words = " ".join(f"w{i % 911}x{i % 13}" for i in range(30_000))
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, base), (4, base), (5, base.upper() + " seventeen"), (6, words), (7, words + " tail"), (8, "short text"), (9, "short text"), (10, "zwölf Löwen ÄÖ   x"), (11, "alpha " * 50), (12, base.replace("eight", "acht")), (3, base), (13, f"prefix {base} suffix"), (14, "lone\x00nul and word")]
    return spark.createDataFrame([(i, t, "en", "key", 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, key int, component_id int, score int")


@pytest.fixture
def folder_of(tmp_path):
    """A folder with the given DataFrames as tables."""

    def save(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return save

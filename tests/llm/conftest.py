import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
PASSAGE = " ".join(f"{a}{i}" + ("." if i % 9 == 8 else "") for i, a in enumerate(WORDS * 3))
#: Nulls, empty and white texts, ties, repeats, long and one-word texts, non-ASCII letters.
ODD = [
    (1, None), (2, ""), (3, "   "), (4, "\n\n"), (5, "Plain text of a few words."), (6, "Plain  text of a few words."), (7, "plain text of a few words."),
    (8, PASSAGE), (9, "Before it. " + PASSAGE + " After it."), (10, PASSAGE.upper()), (11, "É" * 30 + "\n" + "x" * 25), (12, "É" * 30 + "\nother"), (13, "  " + "É" * 30 + "\t\r\nmore"),
    (14, "x" * 25 + "\n" + "X" * 25), (15, " ".join(WORDS * 400)), (16, "a"), (17, "a"), (18, "  "), (19, "1234 5678"), (20, "x" * 25),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(d, t, "n", 5, "clash") for d, t in ODD], "doc_id long, text string, lang string, n_lines int, h1 string")

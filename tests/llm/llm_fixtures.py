import random
import re

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for columns of their own.
CLASHING = "rows row _row _before size fp root text_hash block rank times own_id own_hash score rule__text length kept_id".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("the of and in".split()) if rng.random() < 0.3 else "".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(words))


def messy_rows():
    """Nulls in every column, empty and very long texts, ties and repeats."""
    long_text = prose(1, 60_000)
    rows = [(i, prose(i, 60 + i % 7), "en", f"src{i % 3}", 1) for i in range(40)]
    rows += [(100, None, "en", "src0", None), (101, "", None, None, 0), (102, " \n\t", "en", None, 3), (103, long_text, "en", "src1", None)]
    rows += [(104, rows[3][1], "en", "src2", 5), (105, "ein Wort", "de", None, 8), (106, "Zwei Wörter ☃", "de", "src0", 8)]
    rows += [(None, prose(7, 80), None, None, None), (None, prose(7, 80), None, None, None), (None, None, None, None, None)]
    return rows + rows[5:8] + [(5, prose(999, 70), "en", "src2", 9)]


@pytest.fixture(scope="session")
def messy(spark):
    df = spark.createDataFrame(messy_rows(), DOCS)
    for i, name in enumerate(CLASHING):
        df = df.withColumn(name, F.lit(i).cast("string"))
    return df.withColumn("extra", F.create_map(F.lit("a"), F.col("lang"))).repartition(3)


@pytest.fixture(scope="session")
def empty(spark, messy):
    return spark.createDataFrame([], messy.schema)

"""Small document tables with every case the operators promise a result for."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "amber birch cedar delta ember fjord grove harbor island juniper kelp lagoon meadow nectar orchid pebble quartz river saffron timber".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """rows: (doc_id, text[, source])."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows], SCHEMA)


def mixed_rows(seed: int = 7, n: int = 40) -> list[tuple]:
    """Prose with copies, near copies, shared lines and passages, and null, empty, blank, short and very long texts."""
    rng = random.Random(seed)
    lines = [sentence(rng, rng.randint(4, 12)) for _ in range(30)]
    rows: list[tuple] = []
    for i in range(n):
        own = [sentence(rng, rng.randint(3, 14)) if rng.random() < 0.6 else rng.choice(lines) for _ in range(rng.randint(3, 12))]
        rows.append((i * 3 % 101, "\n".join(own), f"src{i % 4}"))
    rows += [(200 + i, rows[3][1], "src1") for i in range(3)]  # copies
    rows += [(210 + i, rows[5][1].replace("amber", "umber", i + 1), "src2") for i in range(3)]  # near copies
    rows += [(300, None, "src0"), (301, "", None), (302, " \t\n ", "src3"), (303, "one", "src0"), (304, "\n\n\n", "src1"), (305, "naïve café   \U0001f600 Ünï\n" * 3, "src2")]
    rows += [(None, rows[0][1], "src0"), (7, "Repeated id, other text than before, and more of it.", None), (7, rows[7][1], "src1"), (7, rows[7][1], "src1")]
    rows.append((400, " ".join(rng.choice(WORDS) for _ in range(6000)), "src3"))
    return rows


def clashing(docs: DataFrame) -> DataFrame:
    """Extra columns under names that operators might use themselves, nulls among them."""
    from pyspark.sql import functions as F

    return docs.selectExpr("*", "1 AS size", "CAST(NULL AS STRING) AS rid", "'x' AS key", "2.5 AS f", "'y' AS `first`", "3 AS `__row`", "4 AS __t", "5 AS taken", "array(1) AS ids").withColumn("kept", F.lit(None).cast("boolean"))

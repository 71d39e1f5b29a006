import random

import pytest


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Nulls, empty and very long texts, exact and near copies, periodic
    texts, a passage in a third of all rows, odd white space."""
    rng = random.Random(3)
    passage, base = sentence(rng, 60), sentence(rng, 120)
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (5, "One two three four five"),
            (6, "a b " * 300), (7, "x" * 3000), (8, sentence(rng, 4000)), (9, "é ü   ß" * 40)]
    docs += [(10 + i, sentence(rng, 30) + " " + passage + "\n" + sentence(rng, rng.randint(0, 30)))
             for i in range(12)]
    docs += [(30 + i, base) for i in range(6)]
    for i in range(8):
        words = base.split()
        words[rng.randrange(len(words))] = "changed"
        docs.append((40 + i, " ".join(words)))
    docs += [(60, docs[8][1][:9000]), (61, docs[8][1][5000:] + " tail"), (-5, passage)]
    return docs


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as a file-backed table with extra, clashing columns."""
    def make(rows, scratch, schema="doc_id long, text string", n=3):
        import uuid

        path = f"{scratch}/{uuid.uuid4().hex}"
        df = spark.createDataFrame(rows, schema)
        df = df.selectExpr("*", "'x' as spans", "1 as n", "2L as at", "'y' as ids", "0.5D as score")
        df.repartition(n).write.parquet(path)
        return spark.read.parquet(path)

    return make

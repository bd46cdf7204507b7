import pytest

WORDS = ("and of the to in that with from river stone light house green paper winter music garden window "
         "bridge market silver morning").split()


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) rows; every other column is there too."""
    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return build


@pytest.fixture(scope="session")
def prose():
    """Seeded text of n words."""
    import random

    def text(n, seed):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(("", "s", "ed", "ing", "er")) + str(rng.randint(0, 40)) for _ in range(n))
    return text


#: Null, empty and blank texts, one word, non-ASCII, ties and a long text.
ODD = [(101, None), (102, ""), (103, " \t\n\r "), (104, "one"), (105, "É 漢字 naïve x\u0085y"), (106, "One"),
       (107, "a b c d e " * 3000)]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)


@pytest.fixture(scope="session")
def clash(spark):
    """Adds columns named like those that operators make on the way."""
    from pyspark.sql import functions as F

    def add(df):
        for name in ("size", "n", "cid", "mark", "lo", "hi", "score", "host_", "_digest", "_norm", "digest", "target", "y"):
            if name not in df.columns:
                df = df.withColumn(name, F.lit("x"))
        return df
    return add

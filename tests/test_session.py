import pandas as pd
from pyspark.sql import functions as F

from terrane import session


def test_workers_get_long_texts_in_batches_of_bounded_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"size": [int(batch["text"].map(len).sum())]})

    texts = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    found = [r["size"] for r in texts.mapInPandas(sizes, "size long").collect()]
    assert sum(found) == 30_000_000 and max(found) <= session.BATCH_BYTES + 100_000


def test_smaller_batches_of_the_session_stay(spark):
    before = spark.conf.get(session.BATCH_SETTING)
    try:
        for given, kept in (("1m", "1m"), ("64MB", str(session.BATCH_BYTES)), ("4096", "4096")):
            spark.conf.set(session.BATCH_SETTING, given)
            session.ship(spark)
            assert session._bytes(spark.conf.get(session.BATCH_SETTING)) == session._bytes(kept)
    finally:
        spark.conf.set(session.BATCH_SETTING, before)

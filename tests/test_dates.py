import datetime

from pyspark.sql import functions as F

from threadmill.functions import dates

NOW = datetime.datetime(2024, 3, 1, 12, 0)
AT = datetime.datetime
CASES = {
    "2h": AT(2024, 3, 1, 10), "15m": AT(2024, 3, 1, 11, 45), "3d": AT(2024, 2, 27, 12), "hace 2 horas": AT(2024, 3, 1, 10), "hace 3 días": AT(2024, 2, 27, 12), "10 minutes ago": AT(2024, 3, 1, 11, 50), "Yesterday at 3:45 PM": AT(2024, 2, 29, 12), "Ahora": NOW,
    "November 15 at 3:45 PM": AT(2023, 11, 15, 15, 45), "15 de noviembre": AT(2023, 11, 15), "Nov 15, 2024": AT(2024, 11, 15), "Friday, November 15, 2024 at 3:45 PM": AT(2024, 11, 15, 15, 45), "15/11/2023": AT(2023, 11, 15), "11/15/2023": AT(2023, 11, 15),
    "2 de enero de 2022, 08:05": AT(2022, 1, 2, 8, 5), "January 2nd": AT(2024, 1, 2), "1st of February, 7 am": AT(2024, 2, 1, 7), "2023-12-31": AT(2023, 12, 31), "12 AM": AT(2024, 3, 1), "31 de abril": None, "nothing here": None, "": None, None: None, "mayor 5": None,
}


def test_post_dates(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(CASES)], "k int, t string")
    got = {r.k: r.x for r in rows.select("k", dates.relative_post(F.col("t"), F.lit(NOW)).alias("x")).collect()}
    assert {t: got[k] for k, t in enumerate(CASES)} == CASES

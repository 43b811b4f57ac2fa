"""Number formats at the borders of their rounding."""

from pyspark.sql import functions as F

from heronlake.functions import text


def test_sizes_round_halves_to_the_even_digit(spark):
    sizes = [0, 1023, 1024, 1280, 1792, 349440, 806144, 1048524, 1048575, 5 * 2**18, 7 * 2**18, 9 * 2**28, 2**40 + 2**38, 2**63 - 1]
    want = []
    for n in sizes:
        unit = max((i for i in range(1, 5) if n >= 1024**i), default=0)
        want.append(f"{n / 1024**unit:.1f} {['B', 'KiB', 'MiB', 'GiB', 'TiB'][unit]}" if unit else f"{n} B")
    got = spark.createDataFrame(list(enumerate(sizes)), "i int, n long").orderBy("i").select(text.iec_bytes(F.col("n")).alias("v"))
    assert [r.v for r in got.collect()] == want
    assert want[5] == "341.2 KiB" and spark.range(1).select(text.iec_bytes(F.lit(None).cast("long")).alias("v")).first().v is None

"""Sealed values under escaped names, and expressions that grow with the depth alone."""

from pyspark.sql import functions as F

from heronlake.functions import text
from heronlake.operators import view


def test_escaped_names_are_sealed_too(spark):
    rows = [(0, '{"\\u0073ealed": 1, "a": {"ENCRYPTED": 2, "b": [1.50, null, {"xCipher": 3}]}, "n": null}'), (1, '{"a": "sealed"}'), (2, '["sealed"]'), (3, '"{sealed"'), (4, None), (5, "{bad"), (6, '{"\\u0073ealed": 1}')]
    got = {r.i: (r.extra, r.opaque) for r in view.shown(spark.createDataFrame([(i, "c", x) for i, x in rows], "i int, content string, extra string")).collect()}
    assert got == {0: ('{"a":{"b":[1.5,null,{}]},"n":null}', True), 1: ('{"a":"sealed"}', False), 2: (None, False), 3: (None, False), 4: (None, False), 5: (None, False), 6: ('{}', True)}


def test_expression_grows_with_the_depth_alone(spark):
    assert len(view.unsealed(F.col("v"))._jc.toString()) < 40_000


def test_cut_at_every_byte(spark):
    whole = "aé😀漢b" * 3
    size = len(whole.encode())
    r = spark.createDataFrame([(whole,)], "t string").select(*[text.truncate_bytes(F.col("t"), n).alias(f"t{n}") for n in range(size + 2)]).first()
    assert [r[f"t{n}"] for n in range(size + 2)] == [whole.encode()[:n].decode(errors="ignore") for n in range(size + 2)]

"""A section of the report reads its rows once; lines without room for a loop or a hold message are not searched for one."""

from pyspark.sql import functions as F

from colloquy.functions.text import collapse_loops, is_hold_message
from colloquy.sources.review import _section


def test_section_reads_its_rows_once(spark):
    rows = spark.range(50).select((F.col("id") % 7).alias("job_id"), "id")
    out = _section(rows, 3, "Titre", ["id"], F.concat(F.lit("- "), F.col("id").cast("string")), 2)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    got = sorted(map(tuple, out.where("job_id = 6").collect()))
    assert got == [(6, 3, -1, "Titre"), (6, 3, 0, ""), (6, 3, 1, "- 6"), (6, 3, 2, "- 13"), (6, 3, 1_000_000_000, "")]


def test_short_lines(spark):
    df = spark.createDataFrame([("ok ok ok",), ("ok ok ok ok",), ("\tok  ok\nok ok ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(collapse_loops("t")).collect()] == ["ok ok ok", "ok …", "ok …", "", None]
    hold = [("bienvenue a cours de transfert",), ("bienvenue a",), ("cours de transfert",), ("bienvenue à cours de transfert",), ("",), (None,)]
    df = spark.createDataFrame(hold, "t string")
    assert [r[0] for r in df.select(is_hold_message(F.col("t"))).collect()] == [True, False, False, True, False, None]

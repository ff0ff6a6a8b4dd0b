"""Work that takes long a row reaches all cores, whatever the layout of the table."""

from pyspark.sql import functions as F

from lectern.sources.pdf.objects import END, Lexer
from lectern.sources.pdf.statements import statement, statements


def test_statements_of_one_file_go_to_all_cores(spark):
    rows = spark.createDataFrame([(k, f"Supplier {k}") for k in range(200)], "k long, name string").coalesce(1)
    files = statements(rows, F.col("k"), F.col("name"), "s")
    made = files.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in made}) > spark.sparkContext.defaultParallelism
    assert {r.path: bytes(r.content) for r in made} == {f"s/{k}.pdf": statement(k, f"Supplier {k}") for k in range(200)}


def test_strings_and_numbers():
    lex = Lexer(b"(plain\r)(a(b)c)(\\50\\n)() 007 -1 1.5 %(x)\n(last) (open")
    got = []
    while (x := lex.next()) is not END:
        got.append(x)
    assert got == [b"plain\r", b"a(b)c", b"(\n", b"", 7, -1, 1.5, b"last", b"open"]

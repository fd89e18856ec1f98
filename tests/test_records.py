"""Delimited records against Python's reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import grids, records
from siftline.sources import files


def texts(seed, n=120):
    rng = random.Random(seed)
    out = ['a,"b\nc",d\ne,f', '"x""y",\'z\'\n"1,2"', '5" pipe,6" pipe\nnext,row', '"never closed,\nat all\n,x', '"a"b,"c" d"e\n', "\x01,\x02", "", "\n\n", '""', '"""', '"a\n\n\n"",b\n",c\nd']
    alphabet = 'ab",\n'
    return out + ["".join(rng.choices(alphabet, weights=(4, 2, 2, 3, 2), k=rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("part", [1, 3, 200])
def test_records_equal_the_reader(spark, part):
    rows = list(enumerate(texts(part)))
    lines = spark.createDataFrame(rows, "doc long, t string").select("doc", F.posexplode(F.split("t", "\n")).alias("pos", "text")).repartition(3)
    votes = spark.createDataFrame([(k, ",") for k, _ in rows], "doc long, mark string")
    found = {k: [] for k, _ in rows}
    for r in records.records(lines, votes, part).select("doc", "pos", records.fields(F.col("text"), F.col("mark")).alias("f")).orderBy("doc", "pos").collect():
        found[r["doc"]].append(r["f"])
    for k, text in rows:
        want = [row or [""] for row in csv.reader(io.StringIO(text, newline="\n"))]
        got = [f for f in found[k]]
        while got and got[-1] == [""] and len(got) > len(want):  # the reader has no row after a last line feed
            got.pop()
        assert got == want, repr(text)


def test_other_marks_and_blanks(spark):
    row = spark.createDataFrame([('1| "a|b" |c', "|"), ("a.b.c", "."), ("x\t\"y\ty\"", "\t")], "t string, m string")
    assert [r[0] for r in row.select(records.fields(F.col("t"), F.col("m"))).collect()] == [["1", "a|b ", "c"], ["a", "b", "c"], ["x", "y\ty"]]


def test_delimited_files_with_line_breaks(spark):
    decoded = spark.createDataFrame([("f", "f.csv", 'name;note\r\nA;"two\r\nlines; one field"\r\nB;plain\r\n')], "path string, name string, text string")
    grid = grids.trim_grid(files.delimited_cells(decoded))
    rows = {}
    for r in grid.collect():
        rows.setdefault(r["row"], {})[r["col"]] = r["value"]
    assert rows == {1: {1: "name", 2: "note"}, 2: {1: "A", 2: "two\nlines; one field"}, 3: {1: "B", 2: "plain"}}

import random

import pytest
from pyspark.sql import functions as F

from corposcope.errors import EngineError
from corposcope.functions import positions
from corposcope.operators import edits

WIDTHS = {"utf-8": lambda c: len(c.encode()), "utf-16": lambda c: len(c.encode("utf-16-be")) // 2, "utf-32": len}


@pytest.mark.parametrize("encoding", list(WIDTHS))
def test_columns_and_characters(spark, encoding):
    rng = random.Random(1)
    rows = [("".join(rng.choice("aé🙂漢") for _ in range(rng.randint(0, 6))), n) for n in range(-1, 14) for _ in range(8)]
    df = spark.createDataFrame(rows, "line STRING, n INT")
    got = df.select("line", "n", positions.characters_before(F.col("line"), F.col("n"), encoding).alias("c"), positions.units_before(F.col("line"), F.col("n"), encoding).alias("u")).collect()
    for r in got:
        ends = [0]
        for c in r.line:
            ends.append(ends[-1] + WIDTHS[encoding](c))
        assert r.c == (ends.index(r.n) if r.n in ends else None)
        assert r.u == (ends[r.n] if 0 <= r.n <= len(r.line) else None)


def test_located_edits(spark):
    files = spark.createDataFrame([("a", "x🙂y\r\nzé\n"), ("b", ""), ("c", "one")], "path STRING, content STRING")
    rows = [
        ("a", 0, 3, 0, 4, "Y"), ("a", 1, 1, 1, 2, "e"), ("a", 2, 0, 2, 0, "end"), ("a", 0, 0, 0, 0, "<"), ("a", 0, 0, 0, 0, ">"),
        ("b", 0, 0, 0, 0, "x"), ("c", 0, 1, 0, 3, ""), ("gone", 0, 0, 0, 0, "x"),
    ]
    schema = "path STRING, start_line INT, start_column INT, end_line INT, end_column INT, text STRING"

    def run(rows):
        return {r.path: (r.error, r.after) for r in edits.compile_located_edits(files, spark.createDataFrame(rows, schema)).collect()}

    assert run(rows) == {"a": (None, "<>x🙂Y\r\nze\nend"), "b": ("INVALID_LSP_EDIT", None), "c": (None, "o"), "gone": ("PATH_NOT_FOUND", None)}
    assert run([("a", 0, 2, 0, 3, "")])["a"][0] == "INVALID_LSP_POSITION" and run([("a", 1, 0, 1, 3, "")])["a"][0] == "INVALID_LSP_POSITION"
    assert run([("a", 3, 0, 3, 0, "")])["a"][0] == "INVALID_LSP_EDIT" and run([("c", 0, 0, 0, 2, "x"), ("c", 0, 1, 0, 3, "y")])["c"][0] == "OVERLAPPING_LSP_EDITS"
    assert run([]) == {}
    with pytest.raises(EngineError):
        positions.check_encoding("latin-1")

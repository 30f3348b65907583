from __future__ import annotations

import datetime
import random

import pytest

from fieldmosaic.sources import chunks

SHAPE = {"rows": 13, "cols": 21, "chunk_rows": 6, "chunk_cols": 10}
DAYS = [datetime.date(2024, 2, d) for d in (1, 2, 5)]


@pytest.fixture
def cells(rows):
    def make(data):
        return rows("date date, row int, col int, a double, b long", data)

    return make


def test_round_trip_keeps_every_cell(cells):
    rng = random.Random(1)
    for share in (0.03, 0.5, 1.0):
        data = [(d, r, c, None if rng.random() < 0.2 else rng.random(), rng.randint(-5, 5)) for d in DAYS for r in range(13) for c in range(21) if rng.random() < share]
        made = chunks.grid_chunks(cells(data).repartition(5), ["a", "b"], **SHAPE)
        assert made.count() == len({x[0] for x in data}) * 3 * 3
        back = chunks.cells_of_chunks(made, ["a", "b"], 6, 10)
        assert sorted(map(tuple, back.collect()), key=repr) == sorted(data, key=repr)
        for row in made.collect():
            assert sum(bin(b & (1 << 64) - 1).count("1") for b in row.bits) == len(row.a) == len(row.b)
            assert list(row.words) == sorted(set(row.words))


def test_files_round_trip_and_empty_chunks(spark, cells, tmp_path):
    data = [(DAYS[0], 0, 0, 1.5, 1), (DAYS[0], 12, 20, None, 2), (DAYS[1], 5, 9, 2.5, None)]
    path = str(tmp_path / "chunks")
    chunks.write_chunks(cells(data), path, ["a", "b"], **SHAPE)
    read = spark.read.parquet(path)
    assert read.count() == 18 and read.where("size(words) = 0").count() == 15
    assert sorted(map(tuple, chunks.cells_of_chunks(read, ["a", "b"], 6, 10).collect()), key=repr) == sorted(data, key=repr)


def test_empty_table(cells):
    assert chunks.grid_chunks(cells([]), ["a", "b"], **SHAPE).collect() == []


@pytest.mark.parametrize("bad", [[(DAYS[0], 13, 0, 1.0, 1)], [(DAYS[0], None, 0, 1.0, 1)], [(DAYS[0], 1, 1, 1.0, 1), (DAYS[0], 1, 1, 2.0, 1)]])
def test_wrong_cells_are_refused(cells, bad):
    with pytest.raises(Exception, match="cell"):
        chunks.grid_chunks(cells(bad), ["a", "b"], **SHAPE).collect()

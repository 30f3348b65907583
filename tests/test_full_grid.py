"""Sparse predictions on the whole grid."""

from __future__ import annotations

import datetime
import re
from collections import Counter

from fieldmosaic.operators import rasters

DAY, OTHER, LATER = (datetime.date(2024, 1, d) for d in (1, 2, 3))


def test_full_grid_has_every_cell_and_copy(rows):
    dates = rows("date date", [(DAY,), (OTHER,)])
    found = rows(
        "date date, row long, col int, lfmc_pred double",
        [(DAY, 0, 1, 5.0), (DAY, 0, 1, 6.0), (DAY, 1, 2, None), (DAY, 2, 0, 7.0), (DAY, 1, 3, 8.0), (DAY, 1, None, 9.0), (LATER, 0, 0, 1.0)],
    )
    got = Counter(tuple(r) for r in rasters.to_full_grid(dates, found, rows=2, columns=3).collect())
    want = Counter({(d, r, c, None): 1 for d in (DAY, OTHER) for r in range(2) for c in range(3)})
    del want[(DAY, 0, 1, None)]
    assert got == want + Counter([(DAY, 0, 1, 5.0), (DAY, 0, 1, 6.0)])


def test_no_cell_is_joined_by_itself(rows):
    found = rows("date date, row int, col int, lfmc_pred double", [(DAY, 0, 1, 5.0)])
    plan = rasters.to_full_grid(rows("date date", [(DAY,)]), found)._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"Join \[([^\]]*)\]", plan)
    assert joins and not any("col#" in keys for keys in joins)

from __future__ import annotations

import random

from pyspark.sql import functions as F

from mesolite.storage import ranked


def test_ranks_within_frames_over_many_parts(spark):
    r = random.Random(1)
    rows = [(f, r.randrange(50), k) for f in (0, 1, 5) for k in range(700 if f else 3000)]
    r.shuffle(rows)
    got = ranked(spark.createDataFrame(rows, "frame int, n int, root long"), [F.desc("n"), F.asc("root")], "rank").collect()
    want = {}
    for f in (0, 1, 5):
        want |= {(f, k): i + 1 for i, (_, k) in enumerate(sorted((-n, k) for g, n, k in rows if g == f))}
    assert {(x.frame, x.root): x["rank"] for x in got} == want and len(got) == len(rows)
    assert ranked(spark.createDataFrame([], "frame int, n int, root long"), [F.asc("root")], "rank").count() == 0

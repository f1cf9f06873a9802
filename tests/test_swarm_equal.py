"""Rows that differ by the last bits of a sum are judged once by the swarm, and each gets its cluster."""

import numpy as np

from tidewheel.operators import learning


def test_rows_equal_to_the_last_bits_are_judged_once(spark, monkeypatch):
    judged, packed = [], learning.packed
    monkeypatch.setattr(learning, "packed", lambda df, *a, **k: judged.append(df.count()) or packed(df, *a, **k))
    rng = np.random.default_rng(0)
    places = np.concatenate([rng.normal(40, 3, (15, 2)), rng.normal(900, 3, (15, 2))])
    x = places[np.arange(600) % 30]
    near = np.where(rng.random(x.shape) < 0.5, x, np.nextafter(x, np.inf))
    got = []
    for rows in (x, near):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "id int, x array<double>")
        out = learning.swarm_assigned(df, "x", "id", 40, 4, 6, 3).toPandas().sort_values("id")
        assert out.id.tolist() == list(range(600))
        got.append(out.cluster.tolist())
    assert judged == [30, 30] and got[0] == got[1] and len(set(got[0])) > 1

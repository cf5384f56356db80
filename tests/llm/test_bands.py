"""The bands of operator 6 come from all labelled rows."""

import random

import numpy as np

from quarrylight.llm import quality


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    rows = [(g, v) for g, n in ((0, 501), (1, 37), (-1, 1), (2, 2)) for v in (rng.choice([0.25, 0.5, rng.random(), 0.5 + rng.random() * 1e-7, 1.0625]) for _ in range(n))]
    counts = {g: sum(r[0] == g for r in rows) for g in {r[0] for r in rows}}
    got = quality.quantiles(spark.createDataFrame(rows, "g int, v double").repartition(3), counts, [0.005, 0.5, 0.995])
    for g in counts:
        assert np.allclose(got[g], np.quantile([v for h, v in rows if h == g], [0.005, 0.5, 0.995]), rtol=0, atol=1e-15)
    assert quality.quantiles(spark.createDataFrame([], "g int, v double"), {}, [0.5]) == {}


def test_no_sample_is_taken():
    assert not hasattr(quality, "SAMPLE") and "rows" not in quality.fit.__annotations__

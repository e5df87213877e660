import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import detect

SCHEMA = "image_id int, box_id long, xmin double, ymin double, xmax double, ymax double, score double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return 0 if None in a or None in b or w <= 0 or h <= 0 else w * h / (size(a) + size(b) - w * h)


def greedy(rows, threshold):
    kept = []
    for r in sorted(rows, key=lambda r: (-(r[6] if r[6] is not None else float("-inf")), r[1] is None, r[1] or 0)):
        flat = None in r[2:6] or r[4] <= r[2] or r[5] <= r[3]
        if flat or all(k[0] != r[0] or None in k[2:6] or iou(k[2:6], r[2:6]) <= threshold for k in kept):
            kept.append(r)
    return sorted(kept, key=repr)


@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.4, 0.9])
def test_same_as_greedy(spark, threshold):
    r = random.Random(9)
    rows = []
    for k in range(400):
        x, y, s = r.uniform(-60, 60), r.uniform(-60, 60), r.choice([1, 2, 5, 17, 40])
        rows.append((r.choice([1, 2, None]), k, x, y, x + s * r.uniform(0.5, 1), y + s * r.uniform(0.5, 1), r.choice([0.5, None, round(r.random(), 1)])))
    rows += [(1, 1000 + k, 0.0, 0.0, 8.0, 8.0, 0.95) for k in range(30)] + [(2, 2000, 3.0, 3.0, 3.0, 9.0, 1.0), (2, 2001, None, 3.0, 9.0, 9.0, 1.0), (1, None, 0.0, 0.0, 8.0, 8.0, 0.95)]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "level": F.lit(1), "better": F.lit(2)})
    got = detect.suppress(d, threshold)
    assert got.columns == d.columns
    assert sorted((tuple(x)[:7] for x in got.collect()), key=repr) == greedy(rows, threshold)


def test_long_chain_and_empty(spark):
    chain = [(1, k, 4.0 * k, 0.0, 4.0 * k + 10, 10.0, 1 - k / 1000) for k in range(40)]
    assert sorted(map(tuple, detect.suppress(spark.createDataFrame(chain, SCHEMA), 0.3).collect()), key=repr) == greedy(chain, 0.3)
    assert detect.suppress(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_image_is_no_group(spark):
    n = 60_000
    side = 4000
    k = F.col("id")
    b = spark.range(n).select(F.lit(1).alias("image_id"), k.alias("box_id"), (k * 7919 % side).cast("double").alias("xmin"), (k * 104729 % side).cast("double").alias("ymin"), ((k * 31) % 97 / 97).alias("score"))
    b = b.withColumns({"xmax": F.col("xmin") + 12, "ymax": F.col("ymin") + 12})
    kept = detect.suppress(b, 0.4)
    assert 0 < kept.count() < n
    again = detect.suppress(kept, 0.4)
    assert again.count() == kept.count()  # no two kept ones overlap too much


@pytest.mark.parametrize("first", [7, 100])
def test_taken_in_portions_same_as_greedy(spark, monkeypatch, first):
    monkeypatch.setattr(detect, "FIRST", first, raising=False)
    r = random.Random(3)
    rows = []
    for k in range(400):
        x, y, s = r.uniform(-60, 60), r.uniform(-60, 60), r.choice([1, 2, 5, 17, 40])
        rows.append((r.choice([1, 2, None]), k, x, y, x + s * r.uniform(0.5, 1), y + s * r.uniform(0.5, 1), r.choice([0.5, None, round(r.random(), 1)])))
    rows += [(1, 1000 + k, 0.0, 0.0, 8.0, 8.0, 0.95) for k in range(30)] + [(2, 2000, 3.0, 3.0, 3.0, 9.0, 1.0), (2, 2001, None, 3.0, 9.0, 9.0, 1.0)]
    assert sorted(map(tuple, detect.suppress(spark.createDataFrame(rows, SCHEMA), 0.2).collect()), key=repr) == greedy(rows, 0.2)


def test_near_copies_make_few_pairs(spark, monkeypatch):
    r, written, settle = random.Random(4), [], detect.settle

    def counted(df, name):
        out = settle(df, name)
        if name == "overlaps":
            written.append(out.count())
        return out

    monkeypatch.setattr(detect, "settle", counted)
    monkeypatch.setattr(detect, "FIRST", 64, raising=False)
    rows = [(1, k, r.random(), r.random(), 20 + r.random(), 20 + r.random(), r.random()) for k in range(1500)]
    assert len(detect.suppress(spark.createDataFrame(rows, SCHEMA), 0.4).collect()) == 1
    assert sum(written) < 10_000  # there are over a million pairs that overlap

"""What batches promise, on texts and labels of very different counts."""

import random
from collections import Counter

import pytest

from ferrule.operators import batches


@pytest.mark.parametrize(("size", "hot"), [(8, 5), (8, 90), (1, 3), (500, 2)])
def test_no_text_twice(spark, size, hot):
    rng = random.Random(size)
    rows = [(k, f"t{rng.randrange(40)}") for k in range(120)] + [(1000 + k, "hot") for k in range(hot)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    got = {r.id: r.batch for r in batches.distinct_batches(df, size).collect()}
    assert set(got) == {k for k, _ in rows}
    text = {k: t or "" for k, t in rows}
    assert max(Counter((b, text[k]) for k, b in got.items()).values()) == 1
    sizes = Counter(got.values())
    assert max(sizes.values()) <= size and max(sizes.values()) - min(sizes.values()) <= 1
    most = max(Counter(text.values()).values())
    assert len(sizes) == max(-(-len(rows) // size), most)
    assert got == {r.id: r.batch for r in batches.distinct_batches(df.repartition(2), size).collect()}


def test_labels_come_in_groups(spark):
    rng = random.Random(1)
    rows = [(k, rng.choices([0, 1, 2, None], [60, 20, 3, 2])[0]) for k in range(300)] + [(999, 7)]
    df = spark.createDataFrame(rows, "id long, label int").repartition(3)
    got = batches.label_batches(df, 12, 4).collect()
    assert sorted((r.id, r.label) for r in got if r.label is not None) == sorted(r for r in rows if r[1] is not None) and len(got) == len(rows)
    left = Counter(r.label for r in got if r.batch is None)
    counts = Counter(v for _, v in rows)
    assert all(left[v] == (counts[v] if v is None else counts[v] % 4) for v in counts)
    by = Counter((r.batch, r.label) for r in got if r.batch is not None)
    assert all(n % 4 == 0 for n in by.values())
    sizes = Counter(r.batch for r in got if r.batch is not None)
    assert sorted(sizes) == list(range(len(sizes))) and all(n == 12 for b, n in sizes.items() if b < len(sizes) - 1)
    assert batches.label_batches(df.limit(0), 12, 4).collect() == []
    with pytest.raises(ValueError, match="hold"):
        batches.label_batches(df, 3, 4)

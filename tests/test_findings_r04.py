"""Inputs on which the fourth round's findings showed."""

import random

import pytest

from quillspark.operators import balance
from test_findings_r03 import agrees
from test_layouts import greedy


@pytest.mark.parametrize(
    "sizes, expected",
    [
        ([200_000, 128_064, 64_000, 64_000, 130, 64, 63, 0, None], (4, 7129)),  # two texts are longer than a batch of 2,000 times 64
        ([640_000] + [64] * 9, (6, 10_009)),
        ([640_000, 64, 0], (3, 10_001)),
        ([63, 5, 0, None], (0, 0)),
        ([None], (0, None)),
    ],
)
def test_texts_longer_than_a_batch(spark, tmp_path, sizes, expected):
    texts = [(i, None if n is None else "x" * n) for i, n in enumerate(sizes)]
    found = agrees(spark, "budgeted_batches", {"documents": (texts, "doc_id long, text string")}, tmp_path)
    assert found == [(expected[0], True, expected[1], True)]  # batches, ordered, total, within


def test_long_row_has_a_batch_like_others(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([7, 900, 30, 20, 0, 41])], "id long, n long")
    got = {r.id: r.batch for r in balance.budget_batches(rows, "n", "id", 250, strict=False).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5] and got[1] == 0 and [*got.values()].count(0) == 1 and set(got.values()) == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        balance.budget_batches(rows, "n", "id", 250)


def test_plan_does_not_grow_with_the_longest_row():
    """Short rows are dealt in whole laps also while one part is far ahead, and rows of no length where one part is least."""
    assert len(balance.greedy_plan([(10**6, 1), (3, 10**6), (1, 10**7), (0, 10**7)], 500)) < 20
    assert len(balance.greedy_plan([(5, 3), (4, 1), (0, 10**6)], 4)) < 10
    rnd = random.Random(5)
    for _ in range(300):
        parts = rnd.randrange(1, 9)
        lengths = [rnd.randrange(4) for _ in range(rnd.randrange(150))] + [rnd.randrange(10, 400) for _ in range(rnd.randrange(1, 4))]
        loads, seen = [0] * parts, set()
        for n, lo, hi, period, low, high, part in balance.greedy_plan([(n, lengths.count(n)) for n in set(lengths)], parts):
            for r in range(lo, hi):
                if low <= (r - lo) % period < high:
                    loads[part + (r - lo) % period - low] += n
                    assert (n, r) not in seen
                    seen.add((n, r))
        assert sorted(loads) == greedy(lengths, parts, False) and len(seen) == len(lengths)

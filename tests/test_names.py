"""Unique names against the loop that gives them one by one."""

import random

import pytest

from tessera.operators import names


def plain_names(askers, existing):
    seen, out = set(existing), []
    for i, title, _ in sorted((a for a in askers if a[1] is not None), key=lambda a: a[2]):
        name, n = title, 2
        while name in seen:
            name, n = f"{title} - {n}", n + 1
        seen.add(name)
        out.append((i, name))
    return sorted(out)


def given(spark, askers, existing):
    found = names.unique_names(spark.createDataFrame(askers, "id long, title string, order long"), spark.createDataFrame([(e,) for e in existing], "name string"))
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("seed", range(4))
def test_names_equal_the_loop(spark, seed, monkeypatch):
    monkeypatch.setattr(names, "BUCKET", 4)
    rng = random.Random(seed)
    titles = ["x", "x", "x", "x", "x - 2", "x - 3", "x - 7", "x - 2 - 2", "x - 2 - 3", "x - 02", "x - 1", "y", "y - 12", "z - 4", "", " - 2"]
    askers = [(i, rng.choice(titles), order) for i, order in enumerate(rng.sample(range(1000), 120))] + [(999, None, 5000)]
    existing = [*rng.sample(["x", "x - 2", "x - 4", "x - 5", "x - 9", "x - 2 - 2", "y", "y - 2", "q"], 4), None, "q"]
    assert given(spark, askers, existing) == plain_names(askers, existing)


def test_names_without_collisions(spark):
    assert given(spark, [], []) == []
    assert given(spark, [(1, "a", 2), (2, "a", 1), (3, "b", 0)], ["a - 2"]) == [(1, "a - 3"), (2, "a"), (3, "b")]

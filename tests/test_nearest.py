"""The sweep against all pairs, and names resolved against plain rules."""

import random

import pytest

from corpusloom.functions import names
from corpusloom.operators import nearest
from corpusloom.operators.nearest import nearest_in_time

SCHEMA = "release_id long, member_id long, chamber string, at long, gap string"


def plain(rows, k, within):
    out = []
    for i, m, c, at, _ in rows:
        if at is None or m is None:
            continue
        near = sorted((abs(at - t), j) for j, n, d, t, _ in rows if t is not None and n is not None and (d or "") == (c or "") and n != m and abs(at - t) <= within)
        out += [(i, r + 1, j, g) for r, (g, j) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize(("seed", "grid"), [(1, 1), (2, 40), (3, 300)])
def test_sweep_by_brute_force(spark, monkeypatch, seed, grid):
    monkeypatch.setattr(nearest, "ASKERS", 9)
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 1, 1, 1, 2, 3, 4]), rng.choice(["a", "a", "b", None]), rng.randrange(-50, 1200) // grid * grid, "clash") for i in range(220)]
    rows += [(900, None, "a", 5, "x"), (901, 1, "a", None, "x")]
    got = sorted(tuple(r) for r in nearest_in_time(spark.createDataFrame(rows, SCHEMA), 3, 100).collect())
    assert got == plain(rows, 3, 100)


def test_sweep_of_nothing_and_of_repeats(spark):
    assert nearest_in_time(spark.createDataFrame([], SCHEMA), 3).count() == 0
    rows = [(1, 1, "a", 0, ""), (2, 2, "a", 5, ""), (2, 2, "a", 5, "")]
    assert sorted(tuple(r) for r in nearest_in_time(spark.createDataFrame(rows, SCHEMA), 2).collect()) == [(1, 1, 2, 5), (1, 2, 2, 5), (2, 1, 1, 5), (2, 1, 1, 5)]


def test_names_by_stages(spark):
    known = spark.createDataFrame([(1, "Ann Lee"), (2, "Bo Lee"), (3, "José María Núñez"), (4, "Cy Poe"), (4, "Cy Poe"), (5, "Dee Roe"), (6, "Dee  Roe"), (7, None)], "known_id long, full_name string")
    cases = [
        ("lee-ann", "whoever", 1, "id"),
        ("maría-núñez-josé", "", None, None),
        ("maria-nunez-jose", "", 3, "id"),
        (None, "ANN LEE", 1, "name"),
        (None, "Jose Maria Nunez", 3, "plain"),
        (None, "Cy Poe, Jr.", 4, "no_suffix"),
        (None, "Somebody Nuñez III", 3, "last_name"),
        (None, "Other Lee", None, None),  # two of that last name
        (None, "Dee Roe", None, None),  # two entities of that name
        (None, None, None, None),
        ("", "", None, None),
    ]
    asked = spark.createDataFrame([(i, c[0], c[1], "clash") for i, c in enumerate(cases)], "ask_id long, entity_id string, full_name string, stage string")
    got = {r.ask_id: (r.known_id, r.stage) for r in names.resolve_names(asked, known).collect()}
    assert got == {i: (c[2], c[3]) for i, c in enumerate(cases)}
    assert names.resolve_names(asked.where("false"), known).count() == 0
    assert {r.known_id for r in names.resolve_names(asked, known.where("false")).collect()} == {None}


def test_related_makes_no_pairs(spark):
    """The registered query is the sweep; gaps of pairs aren't computed in a join."""
    from corpusloom.plans import catalog

    plan = catalog.queries()["e05_related"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "abs(" not in plan

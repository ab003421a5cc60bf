"""Pages of stored listings against sorted Python lists."""

import random

from lexloom.operators.paging import PagedTable

SCHEMA = "owner string, form string, n bigint"


def _rows():
    rng = random.Random(4)
    rows = [("hot", f"f{k}", rng.randint(0, 9)) for k in range(300)]
    rows += [(rng.choice(["a", "b", None]), f"f{k}", rng.choice([None, 1, 2, 3])) for k in range(90)]
    rng.shuffle(rows)
    return rows


def _listed(rows, owner):
    """Most frequent first, unknown counts last, then by form."""
    return sorted((r for r in rows if r[0] == owner), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))


def _table(spark, tmp_path, rows, range_rows=40):
    return PagedTable.create(spark.createDataFrame(rows, SCHEMA), str(tmp_path), ["owner"], [("n", True), ("form", False)], range_rows)


def test_pages_of_every_depth(spark, tmp_path):
    rows = _rows()
    table = _table(spark, tmp_path, rows)
    for owner, offset, limit in (("hot", 0, 7), ("hot", 95, 60), ("hot", 297, 25), ("hot", 300, 25), (None, 3, 5), ("none such", 0, 5)):
        got = [tuple(r) for r in table.page(limit, offset, owner=owner).collect()]
        want = _listed(rows, owner)[offset:offset + limit]
        assert got == [(*r, offset + k + 1) for k, r in enumerate(want)]
    want = {o: len(_listed(rows, o)) for o in ("hot", "a", "b", None)}
    assert {r.owner: r.total for r in table.totals().collect()} == want


def test_many_pages_at_once(spark, tmp_path):
    rows = _rows()
    table = _table(spark, tmp_path, rows)
    asked = [("hot", 10, 30), ("hot", 25, 5), ("hot", 290, 50), (None, 0, 4), ("a", 5, 1), ("b", 1000, 5), ("none such", 0, 9)]
    got = table.pages(spark.createDataFrame(asked, "owner string, offset bigint, size bigint")).collect()
    want = [(*r, o + k + 1) for owner, o, size in asked for k, r in enumerate(_listed(rows, owner)[o:o + size])]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_a_deep_page_reads_its_range(spark, tmp_path):
    rows = _rows()
    table = _table(spark, tmp_path, rows)
    plan = table.page(5, 250, owner="hot")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters")[1].split("]")[0]
    assert "part" in filters and ("rangepartitioning" not in plan)
    assert table._stored().select("part").distinct().count() > 5
    # Without any row and with rows that all tie.
    assert _table(spark, tmp_path / "none", []).page(5, 0, owner="hot").count() == 0
    same = [("o", "f", 1)] * 100
    assert [r.place for r in _table(spark, tmp_path / "same", same).page(3, 90, owner="o").collect()] == [91, 92, 93]

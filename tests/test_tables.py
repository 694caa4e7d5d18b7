"""Writes that die at any step, and what recovers them."""

import pytest

from threadmill.operators.tables import VersionedTable

STEPS = ["started", "written", "verified", "prepared", "switched", "committed"]


class Killed(Exception):
    pass


def killer(at):
    def on_step(step):
        if step == at:
            raise Killed(step)

    return on_step


@pytest.mark.parametrize("step", STEPS)
def test_readers_see_the_old_rows_or_the_new_ones(spark, tmp_path, step):
    path = f"{tmp_path}/t"
    VersionedTable(spark, path).write(spark.range(3))
    with pytest.raises(Killed):
        VersionedTable(spark, path, killer(step)).write(spark.range(7))
    table = VersionedTable(spark, path)
    want = 7 if step in ("switched", "committed") else 3
    assert table.read().count() == want and table.verify()
    closed = list(table.recover().values())
    assert closed == ([] if step == "committed" else ["committed"] if step == "switched" else ["rolled back"])
    assert table.recover() == {} and table.read().count() == want
    kept = {p.name for p in (tmp_path / "t" / "versions").iterdir() if not p.name.startswith(".")}
    assert len(kept) == (2 if want == 7 else 1) and table.current()["version"] in kept
    table.write(spark.range(9).selectExpr("id", "cast(null as string) as s"))
    assert table.read().columns == ["id", "s"] and table.read().count() == 9


def test_first_write_that_dies_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(Killed):
        VersionedTable(spark, path, killer("verified")).write(spark.range(2))
    table = VersionedTable(spark, path)
    with pytest.raises(FileNotFoundError):
        table.read()
    assert [*table.recover().values()] == ["rolled back"] and table.current() is None


def test_rows_that_change_while_they_are_written_raise(spark, tmp_path):
    """What is read back is held against what passed by, so a changed file is found."""
    table = VersionedTable(spark, f"{tmp_path}/t")
    table.write(spark.range(5))

    def spoil(step):
        if step == "written":
            new = next(p for p in (tmp_path / "t" / "versions").iterdir() if p.name != table.current()["version"])
            spark.range(4).write.mode("overwrite").parquet(str(new))

    with pytest.raises(OSError, match="does not hold"):
        VersionedTable(spark, f"{tmp_path}/t", spoil).write(spark.range(6))
    assert table.read().count() == 5 and table.recover() == {}


def test_old_versions_go(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    for n in range(4):
        table.write(spark.range(n))
    assert len(table.vacuum(keep=2)) == 2 and table.vacuum(keep=2) == [] and table.read().count() == 3

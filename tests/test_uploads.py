"""Uploaded maps with broken rows, and sketches of values."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from careledger.operators import sketches
from careledger.sources.tables import SCHEMAS
from careledger.sources.uploads import read_reason_map, upload_check


def test_broken_and_clashing_rows_are_refused(spark, tmp_path):
    names = [c.split()[0] for c in SCHEMAS["contact_reason_cost_map"].split(", ")]
    assert names[0] == "scr"

    def line(key, value="x"):
        return ",".join([key] + [value] * (len(names) - 1))

    lines = [",".join(names), line("late"), line("cold"), line("cold"), line("lost", "a"), line("lost", "b")]
    lines += ["short"] if len(names) > 2 else []
    lines += [line("late") + ",more", line("")]
    path = tmp_path / "map.csv"
    path.write_text("\n".join(lines) + "\n")
    kept, refused = read_reason_map(spark, str(path))
    assert sorted(r.scr for r in kept.collect()) == ["cold", "cold", "late"]
    assert kept.columns == names
    by = {r.reason: r["rows"] for r in upload_check(kept, refused).collect()}
    assert by == {"kept": 3, "clash": 2, "no key": 1, "broken": 2 if len(names) > 2 else 1}
    assert any(r.record == line("late") + ",more" for r in refused.collect())


def test_sketches_merge_to_any_window(spark, tmp_path):
    start = date(2024, 1, 1)
    df = spark.range(60_000).select(
        F.date_add(F.lit(start), (F.col("id") % 10).cast("int")).alias("d"),
        (F.col("id") * 7 % 20_000).alias("many"),
        (F.col("id") % 3).alias("few"),
    )
    path = str(tmp_path / "sketches")
    sketches.value_sketches(df, "d", ["many", "few"]).write.parquet(path)
    stored = spark.read.parquet(path)
    for first, last in ((0, 9), (2, 4), (5, 5)):
        a, b = start + timedelta(first), start + timedelta(last)
        inside = df.filter(F.col("d").between(F.lit(a), F.lit(b)))
        found = {r.column_name: r for r in sketches.sketched_values(stored, a, b).collect()}
        for name in ("many", "few"):
            exact = inside.select(name).distinct().count()
            assert abs(found[name]["values"] - exact) <= 0.03 * exact
            assert found[name]["rows"] == inside.count()
        assert found["few"].longest == 1

"""Flows that are taken up again, replaced tables, fixes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from voxelmill.operators import flow


def test_rerun_begins_where_the_first_run_died(spark, tmp_path):
    calls, broken = [], [True]

    def stage(name):
        def run(rows):
            calls.append(name)
            if name == "third stage" and broken:
                return rows.withColumn("x", F.raise_error(F.lit("lost")))
            return rows.withColumn(name[:3], F.lit(name))

        return name, run

    stages = [stage(n) for n in ("first", "second/2", "third stage", "fourth")]
    source = spark.range(50).withColumn("value", F.col("id") % 7)
    with pytest.raises(Exception, match="lost"):
        flow.run_stages(source, stages, str(tmp_path))
    broken.clear()
    assert calls == ["first", "second/2", "third stage"]
    # the same rows in another order and partitioning are the same input
    found = flow.run_stages(source.orderBy(F.desc("id")).repartition(3), stages, str(tmp_path))
    assert calls == ["first", "second/2", "third stage", "third stage", "fourth"] and found.count() == 50 and found.columns == ["id", "value", "fir", "sec", "thi", "fou"]
    assert flow.run_stages(source, stages, str(tmp_path)).count() == 50 and len(calls) == 5
    (key,) = tmp_path.iterdir()
    assert [p.name for p in key.iterdir()] == ["3-fourth"]  # earlier stages are gone
    assert flow.run_stages(source.where("id < 9"), stages, str(tmp_path)).count() == 9 and len(calls) == 9
    assert flow.run_stages(source.limit(0), stages, str(tmp_path)).count() == 0
    assert flow.run_stages(source, [], str(tmp_path)).count() == 50


def test_fingerprint_sees_rows_and_schema(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "i int, t string")
    assert flow.fingerprint(a) == flow.fingerprint(a.orderBy(F.desc("i")))
    others = [a.distinct(), a.withColumn("i", F.col("i").cast("long")), a.na.fill(""), a.select("t", "i"), a.limit(0)]
    assert len({flow.fingerprint(x) for x in [a, *others]}) == 6


def test_other_tables_keep_their_files(spark, tmp_path):
    out = tmp_path / "sheets"
    rows = spark.range(30).select("id", F.concat(F.lit("s"), F.col("id") % 3).alias("sheet"))
    flow.replace_tables(rows, str(out))
    content = lambda: {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in out.rglob("*.parquet")}
    before = content()
    flow.replace_tables(rows.where("sheet = 's1' and id > 20"), str(out))
    after = content()
    assert {p: h for p, h in before.items() if "sheet=s1" not in p} == {p: h for p, h in after.items() if "sheet=s1" not in p}
    assert not {p for p in before if "sheet=s1" in p} & set(after)
    assert sorted(r["id"] for r in spark.read.parquet(str(out)).where("sheet = 's1'").collect()) == [22, 25, 28]


def test_fixes_and_errors(spark):
    rows = [(1, [1.0, 2.0, 3.0, 5.0], True, True), (2, [1.0, 2.0, 3.0, 5.0], None, False), (3, None, True, False), (4, [1.0], True, True), (5, [1.0, None, 2.0, 3.0], False, True)]
    table = spark.createDataFrame([(n, d, 2, 2, o, p) for n, d, o, p in rows], "n int, data array<double>, n_rows int, n_cols int, o boolean, p boolean")
    found = {r.n: r for r in flow.apply_fixes(table, F.col("o"), F.col("p")).collect()}
    assert found[1].fixed == [4.0, 5.0, 1.0, 3.0] and found[1].fixes == ["orientation_flip_x", "photometric_inversion"] and found[1].errors == []
    assert found[2].fixed == found[2].data and found[2].fixes == found[2].errors == []
    assert found[3].errors == ["orientation_flip_x: no pixels"] and found[3].fixes == []
    assert len(found[4].errors) == 2 and found[4].fixed == [1.0] and found[5].errors == ["photometric_inversion: values that are no numbers"]

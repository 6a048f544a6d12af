import pytest
from pyspark.sql import functions as F

from rollcall.sources.tables import load_fact_once, merge_new_dimension_rows, parse_event_date


def test_lenient_and_strict_date_parse(spark):
    df = spark.createDataFrame([("2024-09-01",), ("2024-13-45",)], "d string")
    got = [r[0] for r in df.select(parse_event_date(F.col("d"), lenient=True)).collect()]
    assert str(got[0]) == "2024-09-01" and got[1] is None
    with pytest.raises(Exception):
        df.select(parse_event_date(F.col("d"), lenient=False)).collect()


def test_merge_keeps_existing_rows_untouched(spark):
    existing = spark.createDataFrame([("S1", "old")], "student_id string, v string")
    incoming = spark.createDataFrame([("S1", "new"), ("S2", "new")], "student_id string, v string")
    new = merge_new_dimension_rows(incoming, existing, "student_id").collect()
    assert [(r["student_id"], r["v"]) for r in new] == [("S2", "new")]


def test_load_fact_once_only_into_empty_target(spark):
    rows = spark.createDataFrame([("S1", "E1")], "student_id string, event_id string")
    assert load_fact_once(rows, rows.limit(0)).count() == 1
    assert load_fact_once(rows, rows).count() == 0


def test_faulty_rows_are_set_aside_with_reasons(spark, tmp_path):
    from rollcall.sources import tables as TB

    names = TB.REGISTRATION_FLAT.fieldNames()
    good = {n: "1" for n in names} | {"event_date": "2024-01-31"}
    lines = [good, good | {"semester": "x"}, good | {"cgpa": "1;2", "event_date": "soon"}, good | {"attended": "", "event_date": ""}]
    text = [",".join(names)] + [",".join(r[n] for n in names) for r in lines] + ["1,2,3"]
    (tmp_path / "f.csv").write_text("\n".join(text) + "\n")
    checked = TB.scan_checked(spark, str(tmp_path)).cache()
    assert sorted(sorted(r["reasons"]) for r in checked.collect()) == [[], [], ["cgpa", "event_date"], ["fields"], ["semester"]]
    assert TB.accepted(checked).count() == 2 and TB.accepted(checked).columns == names
    assert [r["_line"] for r in TB.quarantined(checked).collect() if r["reasons"] == ["fields"]] == ["1,2,3"]

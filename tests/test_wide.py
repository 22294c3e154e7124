from datetime import date

import pytest

from panelcast.sources import store, wide

MONTHS = {
    "first": {"2012-M01": date(2012, 1, 1), "2012-M02": date(2012, 2, 1)},
    "second": {"2012-M03": date(2012, 3, 1), "2012-M04": date(2012, 4, 1)},
}


def _write(path, files):
    for name, lines in files.items():
        target = path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("\n".join(lines) + "\n", encoding="utf-8")


def _rows(df):
    return sorted(
        (r.Product, r.Country, str(r.Time), r.Import)
        for r in df.select("Product", "Country", "Time", "Import").collect()
    )


def test_reports_with_different_headers_keep_their_months(spark, tmp_path):
    _write(
        tmp_path,
        {
            "kiwi/a.csv": ["Importers,2012-M01", "Austria,1", '"Korea, Republic of",2', "Gone,3"],
            "kiwi/b.csv": ["Importers,2012-M03", "Austria,5", '"Korea, Republic of",x'],
            "product=red plums/c.csv": ["Importers,2012-M01", "Austria,8"],
        },
    )
    out = wide.join_reports(wide.read_wide_reports(spark, str(tmp_path)))
    assert _rows(out.fillna(-1.0, ["Import"])) == [
        ("kiwi", "Austria", "2012-01-01", 1.0),
        ("kiwi", "Austria", "2012-03-01", 5.0),
        ("kiwi", "Korea, Republic of", "2012-01-01", 2.0),
        ("kiwi", "Korea, Republic of", "2012-03-01", -1.0),
        ("red plums", "Austria", "2012-01-01", 8.0),
    ]


def test_conflicting_reports_are_flagged_and_left_out(spark, tmp_path):
    _write(
        tmp_path,
        {
            "fig/a.csv": ["Importers,2012-M01,2012-M02", "A,1,2", "B,1,2"],
            "fig/b.csv": ["Importers,2012-M02,2012-M03", "A,2,3", "B,9,3"],
        },
    )
    reports = wide.read_wide_reports(spark, str(tmp_path))
    conflicts = wide.wide_conflicts(reports).collect()
    assert [(r.Country, str(r.Time), r.low, r.high) for r in conflicts] == [("B", "2012-02-01", 2, 9)]
    assert {r[1] for r in _rows(wide.join_reports(reports))} == {"A"}


def test_null_importers_match_each_other(spark, tmp_path):
    _write(
        tmp_path,
        {
            "fig/a.csv": ["Importers,2012-M01", ",1", "A,2"],
            "fig/b.csv": ["Importers,2012-M02", ",3", "A,4"],
        },
    )
    out = wide.join_reports(wide.read_wide_reports(spark, str(tmp_path)))
    assert {r.Country for r in out.collect()} == {None, "A"} and out.count() == 4


def test_unknown_header_is_an_error(spark, tmp_path):
    _write(tmp_path, {"fig/a.csv": ["Importers,January", "A,1"]})
    with pytest.raises(ValueError):
        wide.read_wide_reports(spark, str(tmp_path))


def test_months_outside_the_period_make_no_rows(spark, tmp_path):
    _write(tmp_path, {"fig/a.csv": ["Importers,2012-M01,2012-M02,2012-M03", "A,1,2,3"]})
    reports = wide.read_wide_reports(spark, str(tmp_path), "2012-02-01", "2012-03-01")
    assert reports.count() == 1
    assert _rows(wide.join_reports(reports)) == [("fig", "A", "2012-02-01", 2.0)]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_written_reports_come_back(spark, make_panel, tmp_path, fmt):
    panel = make_panel({("a", "x"): [1, 2, 3, 4], ("b", "x"): [5, 6, 7, 8]})
    path = str(tmp_path / "reports")
    if fmt == "csv":
        wide.write_wide_reports(panel, path, MONTHS)
    else:
        for name, months in MONTHS.items():
            table = wide.pivot_months(panel, months).withColumnRenamed("Product", "product")
            table.write.partitionBy("product").parquet(f"{path}/{name}")
    out = wide.join_reports(wide.read_wide_reports(spark, path, format=fmt))
    assert _rows(out) == _rows(panel)


def test_predictions_replace_only_their_years(spark, make_panel, tmp_path):
    path = str(tmp_path / "predictions")
    panel = make_panel({("a", "x"): range(24)})
    store.write_predictions(panel, path)
    store.write_predictions(panel.where("Time >= '2013-01-01'").limit(3), path)
    assert store.read_predictions(spark, path, 2012).count() == 12
    assert store.read_predictions(spark, path, 2013).count() == 3


def test_headers_may_have_spaces_and_the_importers_anywhere(spark, tmp_path):
    _write(
        tmp_path,
        {
            "kiwi/a.csv": ["Importers ,2012-01", "A,1", "B,2"],
            "kiwi/b.csv": [" 2012-02, Importers", "3,A"],
        },
    )
    reports = wide.read_wide_reports(spark, str(tmp_path))
    assert {r.n_reports for r in reports.collect()} == {2}
    assert _rows(wide.join_reports(reports)) == [
        ("kiwi", "A", "2012-01-01", 1.0),
        ("kiwi", "A", "2012-02-01", 3.0),
    ]


def test_a_file_without_importers_is_named(spark, tmp_path):
    _write(
        tmp_path,
        {"kiwi/a.csv": ["Importers,2012-01", "A,1"], "kiwi/odd.csv": ["Country,2012-02", "A,1"]},
    )
    with pytest.raises(ValueError, match="odd.csv"):
        wide.read_wide_reports(spark, str(tmp_path))


def test_parquet_gives_what_csv_gives(spark, tmp_path):
    for fmt in ("csv", "parquet"):
        for name, month, rows in (
            ("first", "2012-01", [("A", 1.0), ("B", 2.0)]),
            ("second", "2012-02", [("A", 3.0), ("C", None)]),
        ):
            frame = spark.createDataFrame(rows, f"Importers string, `{month}` double")
            frame.write.option("header", True).format(fmt).save(f"{tmp_path}/{fmt}/{name}/product=fig")
    found = [
        wide.read_wide_reports(spark, f"{tmp_path}/{fmt}", format=fmt) for fmt in ("csv", "parquet")
    ]
    plain = [sorted(map(repr, f.drop("report").collect())) for f in found]
    assert plain[0] == plain[1] and len(plain[0]) == 4
    joined = [_rows(wide.join_reports(f)) for f in found]
    assert joined[0] == joined[1] and {r[1] for r in joined[0]} == {"A"}


def test_month_labels_are_read_in_full(spark):
    assert wide.month_of("2012-1") is None
    assert wide.month_of("2012-01-15") == date(2012, 1, 1)


def test_models_and_cutoffs_stay_when_another_is_saved(spark, tmp_path):
    path = str(tmp_path / "predictions")
    rows = [(m, date(2018, 1, 1), date(2018, k, 1), 1.0) for m in ("tes", "sarima") for k in (1, 2)]
    frame = spark.createDataFrame(rows, "model string, cutoff date, Time date, pred double")
    for model in ("tes", "sarima", "tes"):
        store.write_predictions(frame.where(f"model = '{model}'"), path)
    assert store.read_predictions(spark, path).count() == 4
    later = frame.limit(1).selectExpr("model", "date'2018-07-01' AS cutoff", "Time", "pred")
    store.write_predictions(later, path)
    assert store.read_predictions(spark, path).count() == 5


def test_parameters_are_merged_by_key(spark, tmp_path):
    path = str(tmp_path / "params")
    schema = (
        "model string, year int, cutoff date, Product string, Country string, "
        "params map<string,string>, mae double, status string"
    )

    def rows(product, country, mae, month=1):
        row = ("tes", 2018, date(2018, month, 1), product, country, {"alpha": "0.5"}, mae, "ok")
        return spark.createDataFrame([row], schema)

    for part in (rows("fig", "A", 1.0), rows("fig", "B", 2.0), rows("fig", "A", 3.0), rows("fig", "A", 4.0, 7)):
        store.write_params(part, path)
    saved = store.read_params(spark, path, "tes", 2018)
    assert sorted((r.Country, r.cutoff.month, r.mae) for r in saved.collect()) == [
        ("A", 1, 3.0),
        ("A", 7, 4.0),
        ("B", 1, 2.0),
    ]
    series = spark.createDataFrame([(date(2018, 7, 1), "fig", "A")], "cutoff date, Product string, Country string")
    assert store.with_params(series, saved, "tes", ["alpha"]).count() == 1


def _csv_files(path, files):
    import csv

    for name, (header, rows) in files.items():
        target = path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        with target.open("w", newline="", encoding="utf-8") as out:
            csv.writer(out, lineterminator="\n").writerows([header, *rows])


ODD_NAMES = [
    "Korea,\nRepublic",
    'He said ""x""',
    'five" pipe',
    '"',
    '""',
    '\n\n"\n',
    '",\n"',
    "back\\slash",
    'a\n,b\n"c",\nd',
    "plain",
]


def test_records_of_another_writer_keep_quotes_and_line_breaks(spark, tmp_path):
    header = ["Importers", "2012-M01", "2012-M02"]
    rows = [[name, i, i + 0.5] for i, name in enumerate(ODD_NAMES)]
    _csv_files(tmp_path, {"fig/a.csv": (header, rows), "kiwi/b.csv": (header, [["plain", 1, 2]])})
    out = wide.join_reports(wide.read_wide_reports(spark, str(tmp_path)))
    want = [("fig", name, f"2012-{m:02d}-01", i + (m - 1) / 2) for i, name in enumerate(ODD_NAMES) for m in (1, 2)]
    assert _rows(out) == sorted([*want, ("kiwi", "plain", "2012-01-01", 1.0), ("kiwi", "plain", "2012-02-01", 2.0)])


def test_records_torn_across_blocks_are_joined(spark, tmp_path):
    import random

    rng = random.Random(3)
    header = ["Importers", "2012-M01"]
    names = {"".join(rng.choices(['"', "\n", ",", "x", "yy"], k=rng.randint(1, 30))) + str(i) for i in range(400)}
    _csv_files(tmp_path, {"fig/a.csv": (header, [[n, 1] for n in sorted(names)])})
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "700")
    try:
        out = wide.read_wide_reports(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(r.Importers for r in out) == sorted(names)


def test_names_with_quotes_survive_the_library_writer(spark, make_panel, tmp_path):
    panel = make_panel({(n, "fig"): [1, 2, 3, 4] for n in ODD_NAMES})
    wide.write_wide_reports(panel, str(tmp_path / "out"), MONTHS)
    out = wide.join_reports(wide.read_wide_reports(spark, str(tmp_path / "out")))
    assert {r[1] for r in _rows(out)} == set(ODD_NAMES) and out.count() == 4 * len(ODD_NAMES)


def test_a_quote_that_is_never_closed_is_an_error(spark, tmp_path, monkeypatch):
    from panelcast.sources import records

    monkeypatch.setattr(records, "RECORD_LINES", 5)
    _write(tmp_path, {"fig/a.csv": ["Importers,2012-M01", '"Korea,1', *[f"x{i},2" for i in range(20)]]})
    with pytest.raises(ValueError, match="never closed"):
        wide.read_wide_reports(spark, str(tmp_path)).collect()

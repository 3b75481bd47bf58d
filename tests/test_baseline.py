"""Typed CSV baselines: coercion per column, rejected values and lines, headers, missing files."""

import datetime as dt

import pytest

from funnelspark.sources import baseline as B

COLUMNS = {"id": "text", "day": "date", "n": "integer", "x": "number", "ok": "flag", "later": "number"}


def _files(folder, **texts):
    folder.mkdir()
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_good_values_and_rejects_account_for_everything(spark, tmp_path):
    lines = ["id,day,n,x,ok,spare", "a,2026-01-02,1, 2.5 ,Yes,s", "b,1/31/2026,2.0,1e3,0,", " c ,2026-03,x,n/a,perhaps,s", ",,,,,", '"d, e",2026-01-02 10:00:00,-7,-0.5,TRUE,"q""q"',
             "f,2026-13-01,1.5,$5,no,s", "g,1,2,3,4,5,6", "h,2"]
    rows, rejects = B.load_baseline(spark, _files(tmp_path / "t", one="\n".join(lines) + "\n"), COLUMNS, "id", "t")
    assert dict(rows.dtypes) == {"id": "string", "day": "timestamp", "n": "bigint", "x": "double", "ok": "boolean", "later": "double"}
    got = sorted((tuple(r) for r in rows.collect()), key=repr)
    day = lambda m, d=1, h=0: dt.datetime(2026, m, d, h)
    assert got == sorted([("a", day(1, 2), 1, 2.5, True, None), ("b", day(1, 31), 2, 1000.0, False, None), ("c", day(3), None, None, None, None),
                          (None, None, None, None, None, None), ("d, e", day(1, 2, 10), -7, -0.5, True, None), ("f", None, None, None, False, None)], key=repr)
    bad = sorted((tuple(r)[1:] for r in rejects.collect()), key=repr)
    assert bad == sorted([("value", " c ", "n", "x"), ("value", " c ", "x", "n/a"), ("value", " c ", "ok", "perhaps"), ("value", "f", "day", "2026-13-01"),
                          ("value", "f", "n", "1.5"), ("value", "f", "x", "$5"), ("row", None, None, "g,1,2,3,4,5,6"), ("row", None, None, "h,2")], key=repr)


def test_rejects_do_not_depend_on_the_columns_asked_for(spark, tmp_path):
    folder = _files(tmp_path / "t", one="id,x\na,1\nb,2,3\n")
    assert B.load_baseline(spark, folder, {"id": "text"}, "id")[1].count() == 1
    assert B.load_baseline(spark, folder, {"id": "text"}, "id")[0].select("id").count() == 1


def test_several_files_missing_ones_and_other_headers(spark, tmp_path):
    same = _files(tmp_path / "same", one="id,x\na,1\n", two="id,x\nb,2\n", three="id,x\n")
    assert sorted(r["x"] for r in B.load_baseline(spark, same, {"id": "text", "x": "number"}, "id")[0].collect()) == [1.0, 2.0]
    rows, rejects = B.load_baseline(spark, str(tmp_path / "none"), COLUMNS, "id")
    assert rows.count() == rejects.count() == 0 and rows.columns == list(COLUMNS)
    other = _files(tmp_path / "other", one="id,x\na,1\n", two="x,id\n2,b\n")
    with pytest.raises(Exception):  # noqa: B017 - columns never change places silently
        B.load_baseline(spark, other, {"id": "text", "x": "number"}, "id")[0].collect()
    with pytest.raises(ValueError, match="money"):
        B.load_baseline(spark, same, {"x": "money"}, "id")

"""Workbooks of several sheets: headers anywhere, the last budget column, stop lines, missing parts."""

from funnelspark.operators import budget as B

CELLS = "sheet string, row int, col int, value string"


def _sheet(name, lines, row=0, col=0):
    return [(name, row + r, col + c, v) for r, line in enumerate(lines) for c, v in enumerate(line) if v is not None]


GRID = [["UDR", "Budget", "SP1-A", "sp1 -g", "Notes", "SU2-G"], ["Ana", "10", "3", "4", "n", "x"], ["", "5", "1", "1", "", "1"], ["Bo", "", "", "6", "", "7"],
        ["No numbers", "n/a", "", "-", "", ""], ["Total", "10", "3", "10", "", ""], ["Starts", "", "2", "", "", ""], ["Start%", "", "0.5", "", "", ""],
        ["Behind", "9", "9", "9", "", "9"]]


def _rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_sheets_with_headers_anywhere(spark):
    cells = _sheet("a", GRID) + _sheet("b", [["Budget"], [None]], 0, 9) + _sheet("c", GRID, 3, 2) + [("c", 3, 0, "Budget"), ("c", 0, 0, "plan"), ("c", 4, 0, "Ana too")]
    cells += _sheet("d", [["nothing", "here"], ["Ana", "5"]]) + _sheet("e", [["Budget", "SP1-G"], ["1", "2"]])  # no name column
    df = spark.createDataFrame(cells, CELLS)
    alloc = _rows(B.budget_allocations(df), "sheet", "budget_name", "planned_budget", "_row")
    assert alloc == [("a", "Ana", 10.0, 1), ("c", "Ana", 10.0, 4)]
    terms = B.budget_term_allocations(df)
    per = lambda s: _rows(terms.where(f"sheet = '{s}'"), "budget_dimension", "budget_name", "term", "term_metric", "term_value", "planned_budget")
    want = sorted([("UDR allocation", "Ana", "SP1", "actual", 3.0, 10.0), ("UDR allocation", "Ana", "SP1", "goal", 4.0, 10.0),
                   ("UDR allocation", "Bo", "SP1", "goal", 6.0, 13.0), ("UDR allocation", "Bo", "SU2", "goal", 7.0, 13.0),
                   ("roundup_metric", "Start%", "SP1", "start_rate", 0.5, 0.0), ("roundup_metric", "Starts", "SP1", "starts", 2.0, 0.0),
                   ("roundup_metric", "Total", "SP1", "actual", 3.0, 10.0), ("roundup_metric", "Total", "SP1", "goal", 10.0, 10.0)], key=repr)
    assert per("a") == want and per("c") == want and per("b") == per("d") == per("e") == []
    assert {r["_col"] for r in terms.where("sheet = 'c'").collect()} == {4, 5, 7}


def test_tables_of_one_workbook_agree_with_the_single_ones(spark):
    df = spark.createDataFrame(_sheet("a", GRID) + _sheet("c", GRID, 1, 1), CELLS)
    single = [B.budget_allocations(df), B.budget_term_allocations(df), B.roundup_allocations(df)]
    for one, many in zip(single, B.budget_tables(df)):
        assert _rows(one, *one.columns) == _rows(many, *one.columns)
    totals = _rows(B.roundup_allocations(df).where("term = 'Total' and sheet = 'a'"), "budget_name", "term_metric", "term_value")
    assert totals == [("Ana", "total", 10.0)]


def test_empty_workbook(spark):
    df = spark.createDataFrame([], CELLS)
    assert B.budget_allocations(df).collect() == B.budget_term_allocations(df).collect() == B.roundup_allocations(df).collect() == []


def test_the_first_sheet_gives_the_roundup_value(spark):
    summary = spark.createDataFrame([("b", 1, "Budget", "7", 7.0), ("a", 5, "budget ", "3", 3.0), ("a", 9, "Budget", "4", 4.0)],
                                    "sheet string, _seq int, metric string, value string, numeric_value double")
    assert spark.range(1).select(B.roundup_value(summary, "Budget").alias("v")).first()["v"] == 3.0

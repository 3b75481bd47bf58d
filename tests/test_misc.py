"""Field mapping, text jobs and privacy on hand-made frames."""

from pyspark.sql import functions as F

from funnelspark.operators import privacy as PR
from funnelspark.operators import profile as PF
from funnelspark.operators import textjobs as T


def test_field_mapping_preferred_then_alternative(spark):
    inv = spark.createDataFrame([("contact", "campus_location", "Campus location", 80.0, True),
                                 ("contact", "academic_program_interest", "Program", 50.0, True),
                                 ("contact", "program_of_interest", "Program", 10.0, False)],
                                "object_type string, property_name string, label string, percent_filled double, usable boolean")
    fields = {"contact": {"campus": ["campus"], "program": ["program_of_interest"], "lead_status": ["hs_lead_status"]}}
    got = {r.logical_name: r.selected_property
           for r in PF.choose_field_mapping(inv, PF.wanted_fields(spark, fields), fields).collect()}
    assert got == {"campus": "campus_location", "program": "academic_program_interest", "lead_status": None}
    removed = PF.removed_fields(PF.choose_field_mapping(inv, PF.wanted_fields(spark, fields), fields)).collect()
    assert [r.dashboard_field for r in removed] == ["lead_status"]


def test_profile_fields_counts_and_samples(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, " b ", None), (3, "a", "x"), (4, "c", "")], "k long, p string, q string")
    prof = {r.property_name: r for r in PF.profile_fields(df, "contact", order_col="k").collect()}
    assert prof["p"].non_null_count == 4 and prof["p"].percent_filled == 100.0 and prof["p"].sample_values == "a | b | c"
    assert prof["q"].non_null_count == 1 and prof["q"].percent_filled == 25.0 and prof["q"].usable is True


def test_extract_data_lines_and_prices(spark):
    text = "Week 6 update\n\nEnrolled   12 students this week\nno digits about enroll\n" + "\n".join(
        f"Lead line {i}" for i in range(40))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    lines = [r.line for r in T.extract_data_lines(docs).orderBy("line_no").collect()]
    assert lines[0] == "Week 6 update" and lines[1] == "Enrolled 12 students this week"
    assert len(lines) == 42 and "no digits about enroll" not in lines
    assert T.extract_data_lines(docs, limit=25).count() == 25
    page = spark.createDataFrame([(7, "Master's Degree Programs\n $841   39 $32,799 $15,138 and Certificate Programs $585 18 $10,530 $10,530")],
                                 "page_id long, text string")
    rows = {r.program_degree_level: r for r in T.extract_price_table(page).collect()}
    assert (rows["Master"].tuition_per_credit, rows["Master"].estimated_total_tuition) == (841, 32799)
    assert rows["Certificate"].credits_required == 18 and "Doctoral" not in rows


def test_html_to_text(spark):
    pages = spark.createDataFrame([(1, "<p>Tuition &amp; fees</p><div>A&nbsp;B<br/>C</div><span>x</span>")], "page_id long, html string")
    text = T.html_to_text(pages).first().text
    assert text == "\nTuition & fees \nA B\nC  x "


def test_pseudonyms_and_sanitize(spark):
    a = spark.createDataFrame([("Maria",), ("Bo",), ("Unassigned",), ("",), ("TOTAL",), ("Unknown",)], "owner string")
    b = spark.createDataFrame([("Zed",), ("Bo",), ("start%",)], "udr string")
    m = {r.label: r.pseudonym for r in PR.label_pseudonyms([(a, ["owner"]), (b, ["udr"])], "UDR", keep=["unassigned"]).collect()}
    assert m == {"Bo": "UDR 01", "Maria": "UDR 02", "Zed": "UDR 03"}
    rows = [(k, f"S{k}", "Zed" if k % 2 else "Bo", "z@x", "n", f"r{k}", "Bo", "Zed") for k in range(200, 0, -1)]
    enr = spark.createDataFrame(rows, "row_number int, student string, udr string, email string, notes string, record_id string, "
                                      "normalized_budget_name string, source string").repartition(5)
    mapping = PR.label_pseudonyms([(b, ["udr"])], "UDR")
    out = PR.sanitize_frame(enr, mapping, ["row_number"]).orderBy("row_number").collect()
    assert [r.student for r in out] == [f"Student {k:04d}" for k in range(1, 201)]
    assert [(r.udr, r.normalized_budget_name, r.source) for r in out[:2]] == [("UDR 02", "UDR 01", "UDR 02"), ("UDR 01", "UDR 01", "UDR 02")]
    assert not {"email", "notes", "record_id"} & set(out[0].asDict())


def test_published_tables_hold_no_private_value(spark):
    from funnelspark.functions import rules
    from funnelspark.plans import registry
    d = "/root/testdata/sf0.001"
    named = registry._owner_map(spark, d).collect()
    owners = {r.label for r in named} - {r.pseudonym for r in named}  # some budget names look like pseudonyms
    for name in ("sanitize_leads", "sanitize_enrollments", "sanitize_budget"):
        df = registry.queries()[name](spark, d)
        assert not {c for c in df.columns if c in rules.PUBLISHED_DROP_COLUMNS and c != "student"}
        for r in df.select(*[c for c in df.columns if c in rules.OWNER_LABEL_COLUMNS + rules.SOURCE_LABEL_COLUMNS]).distinct().collect():
            assert not owners & {v for v in r if v}


def test_standardize_and_coalesce_columns(spark):
    from funnelspark.operators.enrollment import coalesce_duplicate_columns, standardize_columns
    df = spark.createDataFrame([("1", "", "x", "y")], ["Record ID", "Contact  Owner", "contact owner", " "])
    std = standardize_columns(df)
    assert std.columns == ["record_id", "contact_owner", "contact_owner_2", "unnamed"]
    out = coalesce_duplicate_columns(std, {"contact_owner_2": "contact_owner"}).first()
    assert out.contact_owner == "x" and out.record_id == "1"


def test_heading_names_never_clash():
    from funnelspark.operators.enrollment import heading_names
    assert heading_names(["A", "a ", "a_2", "A-2", "", "%"]) == ["a", "a_3", "a_2", "a_2_2", "unnamed", "unnamed_2"]


def test_raw_lead_headings_feed_logical_columns(spark):
    from funnelspark.operators.enrollment import standardize_leads
    df = spark.createDataFrame([("", "7", "Ann", "x@Y", "2001-01-02"), ("5", "8", "Bo", " ", "TBD")],
                               ["Record ID", "hs_object_id", "FirstName", "Email", "createdate"])
    out = {r.first_name: r for r in standardize_leads(df, "sheet").collect()}
    assert (out["Ann"].record_id, out["Bo"].record_id, out["Ann"].email) == ("7", "5", "x@y")
    assert out["Ann"].create_date.year == 2001 and out["Bo"].create_date is None


def test_bad_enrollment_dates_are_null(spark):
    from funnelspark.operators.enrollment import standardize_enrollments
    df = spark.createDataFrame([("A", "2001-02-03", "1", "2"), ("B", "TBD", "x", "y")], "student string, enrolled_date string, days_to_enroll string, revenue string")
    rows = {r.student: r for r in standardize_enrollments(df).collect()}
    assert rows["A"].enrolled_date.day == 3 and rows["B"].enrolled_date is None and rows["B"].enrolled_date_text == "TBD"


def test_effective_terms(spark):
    from pyspark.sql import functions as F
    from funnelspark.operators import budget as B
    assert B._tokens(["Summer 2", "Spring 1", " ", "SU-2 G"]) == ["SP1", "SU2"] and B._tokens(["2001-01-01"]) == ["2001-01-01"]
    one = spark.createDataFrame([("Spring 2",), ("Spring 2",), ("",)], "term_label string")
    two = spark.createDataFrame([("Spring 2",), ("2001-01-01",)], "term_label string")
    tok = spark.createDataFrame([("SP2",), ("SU1",)], "t string")
    pick = lambda enr, sel: sorted(r.t for r in tok.where(B.in_effective_terms(F.col("t"), sel, enr)).collect())
    assert pick(one, None) == ["SP2"] and pick(two, None) == [] and pick(two, ["Summer 1", "SP2"]) == ["SP2", "SU1"]

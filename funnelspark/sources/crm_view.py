"""CRM-shaped raw tables derived from the driver tables (FIXTURES §10).

Every value comes from key arithmetic so Spark and the DuckDB oracle (``plans/oracle.py``)
produce the same rows.  Raw CRM values arrive as text, as they do from the CRM API: ISO
timestamps, epoch-millisecond text for ``notes_last_updated`` and activity timestamps, numbers
as text.  The derivations are plain projections and one union, so they scale with the inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = "2001-08-02 00:00:00"
TODAY_SECS = 996710400          # 2001-08-02 00:00:00 UTC
BASE_SECS = 788918400           # 1995-01-01 00:00:00 UTC
DAY_SECS = 86400
ACTIVITY_SHIFT_DAYS = 8250

# FIXED VALUES: label cycles used by the view (index = key modulo the list length).
LIFECYCLE_CYCLE = ["lead", "MQL", "Applicant", "Enrolled", "Not a Lead"]
LEAD_STATUS_CYCLE = ["New", "Responded", "Dead Lead", "Closed Lost", "Unqualified", "Hot Lead",
                     "Duplicate Lead", "Outreach Attempt 1", ""]
UTM_SOURCE_CYCLE = ["google ads", "facebook", "newsletter", "organic search", "", "Partner X | list"]
UTM_MEDIUM_CYCLE = ["cpc", "email", "", "referral"]
ENROLLMENT_STATUS_CYCLE = ["EA Signed", "Inactive", "Registered", "", "", "", "", ""]
SEGMENT_PROGRAM = [("BUILDING", "Bachelor of Science"), ("AUTOMOBILE", "MBA"),
                   ("FURNITURE", "Certificate in AI"), ("HOUSEHOLD", "DBA")]
EVENT_ACTIVITY_TYPE = [("click", "emails"), ("view", "notes"), ("purchase", "meetings"),
                       ("signup", "calls"), ("error", "tasks")]
LEAD_LISTS = ["Kara Leads", "Project Falcon", "", "Website", "Referral", ""]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by key over all cores, twice as many tasks: a small file is one split, whatever its rows cost."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def _cycle(key: Column, values: list[str]) -> Column:
    idx = F.pmod(key, F.lit(len(values)))
    out = None
    for i, v in enumerate(values):
        out = F.when(idx == i, F.lit(v)) if out is None else out.when(idx == i, F.lit(v))
    return out


def iso_from_secs(secs: Column) -> Column:
    return F.date_format(F.timestamp_seconds(secs), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    return n.select(
        key.cast("string").alias("owner_id"),
        F.when(key % 6 == 0, F.lit("")).otherwise(F.col("n_name")).alias("salesman_name"),
        F.concat(F.lit("n"), key.cast("string"), F.lit("@x.org")).alias("email"),
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(read_table(spark, sf_dir, "customer"), "c_custkey")
    k = F.col("c_custkey")
    created = F.when(k % 5 == 0, F.lit(TODAY_SECS) - (k % 60) * DAY_SECS).otherwise(
        F.lit(BASE_SECS) + ((k * 37) % 2400) * DAY_SECS)
    program = None
    for seg, prog in SEGMENT_PROGRAM:
        cond = F.col("c_mktsegment") == seg
        program = F.when(cond, F.lit(prog)) if program is None else program.when(cond, F.lit(prog))
    program = program.otherwise(F.lit(""))
    blank = F.lit("")
    return c.select(
        k.cast("string").alias("hs_object_id"),
        iso_from_secs(created).alias("createdate"),
        F.when(k % 7 == 0, blank).otherwise(F.col("c_nationkey").cast("string")).alias("hubspot_owner_id"),
        iso_from_secs(created + DAY_SECS).alias("hubspot_owner_assigneddate"),
        F.lit("Student").alias("firstname"),
        k.cast("string").alias("lastname"),
        F.when(k % 11 == 0, blank).otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.test"))).alias("email"),
        F.when(k % 13 == 0, F.concat(F.lit("555-"), k.cast("string"))).otherwise(blank).alias("phone"),
        _cycle(k, LIFECYCLE_CYCLE).alias("lifecyclestage"),
        _cycle(k, LEAD_STATUS_CYCLE).alias("hs_lead_status"),
        _cycle(k, UTM_SOURCE_CYCLE).alias("utm_source"),
        _cycle(k, UTM_MEDIUM_CYCLE).alias("utm_medium"),
        F.when(k % 5 == 0, blank).otherwise(F.concat(F.lit("camp_"), (k % 5).cast("string"))).alias("utm_campaign"),
        program.alias("program"),
        F.when(k % 23 == 0, F.lit("Master")).otherwise(blank).alias("degree_level"),
        _cycle(k, ENROLLMENT_STATUS_CYCLE).alias("enrollment_status"),
        F.when(k % 5 == 3, iso_from_secs(created + 30 * DAY_SECS)).otherwise(blank).alias("enrollment_date"),
        F.when(k % 5 == 2, iso_from_secs(created + 10 * DAY_SECS)).otherwise(blank).alias("application_date"),
        F.when(k % 4 == 0, F.lit("2001 Fall I")).otherwise(blank).alias("session_start"),
        F.when(k % 10 == 0, F.lit("Official 2001A")).otherwise(blank).alias("cohort"),
        F.concat(F.lit("Campus "), (k % 3).cast("string")).alias("campus_location"),
        F.when(k % 2 == 0, F.lit("Online")).otherwise(F.lit("Hybrid")).alias("modality"),
        F.when(k % 17 == 0, F.lit("48000")).otherwise(F.lit("0")).alias("standard_tuition_total"),
        F.when(k % 2 == 0, iso_from_secs(created + (k % 5) * DAY_SECS)).otherwise(blank).alias("hs_first_outreach_date"),
        F.when(k % 5 == 4, blank).otherwise(
            ((F.lit(TODAY_SECS) - ((k * 13) % 90) * DAY_SECS) * 1000).cast("string")).alias("notes_last_updated"),
        F.when(k % 3 == 0, iso_from_secs(F.lit(TODAY_SECS) + (k % 20) * DAY_SECS)).otherwise(blank).alias("notes_next_activity_date"),
        (k % 12).cast("string").alias("num_notes"),
        F.when(k % 3 == 1, blank).otherwise(((k % 20) * 3600000).cast("string")).alias("hs_time_to_first_engagement"),
    )


def deal_stage_expr(o: Column, c: Column, status: Column) -> Column:
    by_status = F.when(status == "F", "Closed Won").when(status == "O", "Closed Lost").otherwise("Open")
    return (F.when(c % 4 == 0, F.lit("Open"))
            .when(c % 4 == 1, F.when(status == "O", "Closed Lost").otherwise("Open"))
            .otherwise(by_status))


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    stage = deal_stage_expr(key, cust, F.col("o_orderstatus"))
    created = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return o.select(
        key.cast("string").alias("hs_object_id"),
        iso_from_secs(created).alias("createdate"),
        F.when(key % 10 == 0, F.lit("")).otherwise((key % 25).cast("string")).alias("hubspot_owner_id"),
        stage.alias("dealstage"),
        F.lit("default").alias("pipeline"),
        F.when(stage == "Open", F.lit("")).otherwise(iso_from_secs(created + ((key % 90) - 5) * DAY_SECS)).alias("closedate"),
        F.when(key % 12 == 0, F.lit("0")).otherwise(F.col("o_totalprice").cast("string")).alias("amount"),
    )


def associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links: own customer (minus orphan deals and contacts without deals), a second contact on
    every 15th deal, and a link to a contact id that does not exist on every 997th deal."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n_customers = read_table(spark, sf_dir, "customer").agg(F.max("c_custkey")).scalar()
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    second = F.pmod(cust, n_customers) + 1
    base = o.where((key % 20 != 0) & (cust % 25 != 3)).select(
        cust.cast("string").alias("contact_id"), key.cast("string").alias("deal_id"),
        F.lit("contact_to_deal").alias("association_type"))
    shared = o.where((key % 15 == 0) & (key % 20 != 0) & (second % 25 != 3)).select(
        second.cast("string").alias("contact_id"), key.cast("string").alias("deal_id"),
        F.lit("shared").alias("association_type"))
    missing = o.where(key % 997 == 0).select(
        F.lit("missing").alias("contact_id"), key.cast("string").alias("deal_id"),
        F.lit("contact_to_deal").alias("association_type"))
    return base.unionByName(shared).unionByName(missing)


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    atype = None
    for ev, at in EVENT_ACTIVITY_TYPE:
        cond = F.col("event_type") == ev
        atype = F.when(cond, F.lit(at)) if atype is None else atype.when(cond, F.lit(at))
    k = F.get_json_object(F.col("props"), "$.k")
    text = F.concat(F.col("event_type"), F.lit(" #"), k)
    et = F.col("event_type")

    def only(ev: str, value: Column) -> Column:
        return F.when(et == ev, value)

    return e.select(
        atype.alias("activity_type"),
        eid.cast("string").alias("hs_object_id"),
        F.when(eid % 50 == 0, F.lit("")).otherwise(F.col("user_id").cast("string")).alias("contact_id"),
        (F.unix_millis(F.col("ts").cast("timestamp")) - ACTIVITY_SHIFT_DAYS * DAY_SECS * 1000).cast("string").alias("hs_timestamp"),
        (eid % 30).cast("string").alias("hubspot_owner_id"),
        only("signup", text).alias("hs_call_title"),
        only("signup", F.lit("COMPLETED")).alias("hs_call_status"),
        only("click", text).alias("hs_email_subject"),
        only("click", F.lit("SENT")).alias("hs_email_status"),
        only("purchase", text).alias("hs_meeting_title"),
        only("purchase", F.lit("SCHEDULED")).alias("hs_meeting_outcome"),
        only("view", text).alias("hs_note_body"),
        only("error", text).alias("hs_task_subject"),
        only("error", F.when(F.col("value") > 50, F.lit("COMPLETED")).otherwise(F.lit("NOT_STARTED"))).alias("hs_task_status"),
    )


def raw_crm(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "contacts": contacts(spark, sf_dir),
        "deals": deals(spark, sf_dir),
        "owners": owners(spark, sf_dir),
        "associations": associations(spark, sf_dir),
        "activities": activities(spark, sf_dir),
    }


# ---- uploaded-leads path -------------------------------------------------------------------

TERM_BY_QUARTER = ["SP1", "SP2", "SU1", "SU2"]


def enrollments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrollment ledger rows: lineitem joined to its order, part, supplier and the supplier's
    nation (the admissions owner).  Dimension joins are left to AQE / the broadcast threshold,
    which only broadcasts a side whose measured size is under the limit."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag",
        "l_linestatus", "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(p, li.l_partkey == p.p_partkey)
         .join(s, li.l_suppkey == s.s_suppkey)
         .join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left"))
    ok = F.col("l_orderkey")
    ship = F.col("l_shipdate").cast("timestamp")
    return j.select(
        F.concat(ok.cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("row_key"),
        F.when(ok % 40 == 0, F.lit("")).otherwise(
            F.concat(F.lit("S"), ok.cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))).alias("student"),
        F.col("n_name").alias("udr"),
        F.col("p_type").alias("program"),
        F.col("l_returnflag").alias("modality"),
        ship.alias("enrolled_date"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("New")).otherwise(F.lit("Returning")).alias("student_type"),
        F.when(ok % 3 == 0, F.lit("Title IV")).when(ok % 3 == 1, F.lit("Self Pay")).otherwise(F.lit("")).alias("payment_funding"),
        F.col("l_linestatus").alias("new_roll"),
        F.date_trunc("quarter", ship).alias("term"),
        F.when(F.col("l_partkey") % 30 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("source"),
        F.floor((F.unix_seconds(ship) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))) / DAY_SECS).cast("long").alias("days_to_enroll"),
        F.col("l_extendedprice").alias("revenue"),
    )


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded-lead rows (spreadsheet shape) from customers and nations."""
    c = spread(read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    created = F.when(k % 5 == 0, F.lit(TODAY_SECS) - (k % 60) * DAY_SECS).otherwise(
        F.lit(BASE_SECS) + ((k * 37) % 2400) * DAY_SECS)
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    return j.select(
        F.when(k % 19 == 0, F.lit("")).otherwise(k.cast("string")).alias("record_id"),
        F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.test"))).alias("email"),
        F.col("n_name").alias("contact_owner"),
        _cycle(k, LEAD_STATUS_CYCLE).alias("lead_status"),
        _cycle(k, LIFECYCLE_CYCLE).alias("lifecycle_stage"),
        F.when(k % 6 < 2, _cycle(k, LEAD_LISTS)).otherwise(F.lit("")).alias("paid_lead_list"),
        F.when(k % 6 >= 3, _cycle(k, LEAD_LISTS)).otherwise(F.lit("")).alias("organic_lead_list"),
        _cycle(k, UTM_SOURCE_CYCLE).alias("utm_source"),
        F.timestamp_seconds(created).alias("create_date"),
        F.when(k % 5 == 4, F.lit(None).cast("timestamp")).otherwise(
            F.timestamp_seconds(F.lit(TODAY_SECS) - ((k * 13) % 90) * DAY_SECS)).alias("last_activity_date"),
        F.when(k % 4 == 0, F.lit("Bachelor")).when(k % 4 == 1, F.lit("Master")).otherwise(F.lit("")).alias("degree"),
    )


# FIXED VALUES (view): vendor names for the cost ledger, cycled by supplier key.
VENDOR_COST_CYCLE = ["Meta", "Google", "Partner X", "newsletter", ""]


def vendor_costs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost ledger rows (vendor, month, spend, notes) as text, from suppliers."""
    s = read_table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        _cycle(k, VENDOR_COST_CYCLE).alias("vendor"),
        F.concat(F.lit("2001-0"), ((k % 9) + 1).cast("string")).alias("month"),
        F.col("s_acctbal").cast("string").alias("spend"),
        F.lit("").alias("notes"),
    )


# ---- budget grid (cells) -----------------------------------------------------------------------

# FIXED VALUES (view): term column headings of the budget grid, in column order (term index, metric).
BUDGET_TERM_HEADERS = [
    ("SP-1 A", 1, "a"), ("SP1-G", 1, "g"), ("SP2-A", 2, "a"), ("SP2-G", 2, "g"),
    ("SU1-A", 3, "a"), ("SU1-G", 3, "g"), ("SU2 -A", 4, "a"), ("SU2- G", 4, "g"),
    ("FA1- A", 5, "a"), ("FA1 -G", 5, "g"), ("FA2 -A", 6, "a"), ("FA2 -G", 6, "g"),
]
FIRST_TERM_COL = 3
#: Header row and column shift of a sheet, by nation key modulo these.
HEADER_ROWS, COLUMN_SHIFTS = 4, 3


def _num_text(c: Column) -> Column:
    return c.cast("long").cast("string")


def budget_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budget workbook as cells (sheet, row, col, value): one sheet per nation, one line per supplier.

    A sheet has its header in its own row and column, title cells above it, then the lines (admissions owners and
    numbered ones), Total / Starts / Start% lines, a line past the stop line, and the summary block in the second
    and third column (Budget, Enrolled, Starts, Start%, a blank Budget and a second Budget).  Goals and actuals come
    from the supplier key; totals are Spark aggregates over a sheet's lines."""
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nk"))
    nat = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), "n_name")
    k = F.col("s_suppkey")
    kk = k % 50
    name = F.when(k % 5 == 0, F.concat(F.lit("UDR "), F.lpad(k.cast("string"), 5, "0"))).otherwise(F.col("n_name"))
    goal = {t: kk * 3 + t for t in range(1, 7)}
    actual = {t: (kk * 2 + (t % 5)) if t <= 4 else F.lit(None).cast("long") for t in range(1, 7)}
    total = F.when(k % 8 == 7, F.lit(None).cast("long")).otherwise(kk * 18 + 21)
    head, shift = F.col("nk") % HEADER_ROWS, F.col("nk") % COLUMN_SHIFTS
    lines = sup.join(nat, "nk").select(
        "nk", (head + 1 + k).alias("row"), name.alias("name"), total.alias("total"),
        *[(actual[t] if m == "a" else goal[t]).alias(f"t{i}") for i, (_, t, m) in enumerate(BUDGET_TERM_HEADERS)])
    n = len(BUDGET_TERM_HEADERS)
    cell = lambda row, col, value: F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"), value.cast("string").alias("value"))
    at = lambda i: F.lit(FIRST_TERM_COL + i) + shift
    line_cells = lines.select("nk", F.explode(F.array(
        cell(F.col("row"), 1 + shift, F.col("name")), cell(F.col("row"), 2 + shift, F.coalesce(_num_text(F.col("total")), F.lit(""))),
        *[cell(F.col("row"), at(i), F.coalesce(_num_text(F.col(f"t{i}")), F.lit(""))) for i in range(n)])).alias("c"))
    sums = lines.groupBy("nk").agg(F.max("row").alias("last"), F.sum("total").alias("total"), *[F.sum(f"t{i}").alias(f"t{i}") for i in range(n)])
    a_idx = [i for i, (_, _, m) in enumerate(BUDGET_TERM_HEADERS) if m == "a"]
    starts = {i: F.floor(F.col(f"t{i}") * 0.7) for i in a_idx}
    ratio = lambda x, y: F.round(F.try_divide(x, y), 4).cast("decimal(10,4)").cast("string")
    all_actual = sum(F.coalesce(F.col(f"t{i}"), F.lit(0)) for i in a_idx)
    all_starts = sum(F.coalesce(starts[i], F.lit(0)) for i in a_idx)
    base = F.col("last") + 1
    fixed = [(F.lit(0), F.lit(0), F.lit("2001 plan")), (head, 1 + shift, F.lit("UDR")), (head, 2 + shift, F.lit("Budget"))]
    fixed += [(head, at(i), F.lit(h)) for i, (h, _, _) in enumerate(BUDGET_TERM_HEADERS)]
    fixed += [(base, 1 + shift, F.lit("Total")), (base, 2 + shift, F.coalesce(_num_text(F.col("total")), F.lit("")))]
    fixed += [(base, at(i), F.coalesce(_num_text(F.col(f"t{i}")), F.lit(""))) for i in range(n)]
    fixed += [(base + 1, 1 + shift, F.lit("Starts")), (base + 1, 2 + shift, F.lit(""))]
    fixed += [(base + 1, at(i), F.coalesce(_num_text(starts[i]), F.lit(""))) for i in a_idx]
    fixed += [(base + 2, 1 + shift, F.lit("Start%")), (base + 2, 2 + shift, F.lit(""))]
    fixed += [(base + 2, at(i), F.coalesce(ratio(starts[i], F.col(f"t{i}")), F.lit(""))) for i in a_idx]
    fixed += [(base + 3, 1 + shift, F.lit("After stop")), (base + 3, 2 + shift, F.lit("5"))]
    summary = [(5, "Budget", _num_text(F.col("total"))), (6, "Enrolled", _num_text(all_actual)), (7, "Starts", _num_text(all_starts)),
               (8, "Start%", ratio(all_starts, all_actual)), (9, "Budget", F.lit("")), (10, "Budget", _num_text(F.col("t1") + F.col("t3")))]
    for off, label, v in summary:
        fixed += [(base + off, F.lit(1), F.lit(label)), (base + off, F.lit(2), v)]
    sheet_cells = sums.select("nk", F.explode(F.array(*[cell(*f) for f in fixed])).alias("c"))
    return line_cells.unionByName(sheet_cells).select(
        F.concat(F.lit("Budget "), F.lpad(F.col("nk").cast("string"), 2, "0")).alias("sheet"), "c.row", "c.col", "c.value")

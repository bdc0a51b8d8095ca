from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parlance.operators import lookup
from parlance.sizing import number_rows

D = dt.date


@pytest.fixture(scope="module")
def customers(spark):
    rows = [
        ("C001", "ann@example.org", "Ann", "555-1", "1 Main St", "Rome", "RM", "001", "active"),
        ("C002", "bob@example.org", "Bob", None, "2 Main St", "Oslo", "OS", "002", "active"),
        ("C003", "cy@example.org", "Cy", "555-3", "3 Main St", "Bern", "BE", "003", "suspended"),
        ("C009", "ann@example.org", "Ann II", "555-9", "9 Main St", "Rome", "RM", "009", "active"),
    ]
    return spark.createDataFrame(
        rows, "customer_id string, email string, name string, phone string, address string, city string, state string, "
              "zip_code string, account_status string")


@pytest.fixture(scope="module")
def bills(spark):
    rows = [
        ("B001", "C001", D(2024, 1, 1), 89.99, "paid", D(2024, 1, 15), "Internet"),
        ("B002", "C001", D(2024, 2, 1), 12345678.9, "paid", D(2024, 2, 15), "Internet"),
        ("B003", "C003", D(2024, 1, 1), 59.99, "overdue", None, "Internet"),
    ]
    return spark.createDataFrame(
        rows, "bill_id string, customer_id string, bill_date date, amount double, status string, due_date date, service_type string")


@pytest.fixture(scope="module")
def tickets(spark):
    rows = [
        ("T001", "C001", "connection", "Slow", "resolved", D(2024, 1, 5), D(2024, 1, 6)),
        ("T002", "C001", "billing", "Charge", "open", D(2024, 2, 10), None),
        ("T003", "C001", "billing", "Lost", "resolved", D(2024, 2, 11), None),
    ]
    return spark.createDataFrame(
        rows, "ticket_id string, customer_id string, issue_type string, description string, status string, "
              "created_date date, resolved_date date")


BILLS = "Bill B002: $12345678.90 - paid (Due: 2024-02-15) - Internet\nBill B001: $89.99 - paid (Due: 2024-01-15) - Internet"
TICKETS = "Ticket T002: billing - Charge (Status: open)\nTicket T001: connection - Slow (Resolved: 2024-01-06)"
PROFILE = "Customer ID: C001, Name: Ann, Phone: 555-1, Status: active, Address: 1 Main St, Rome, RM 001"
EMAILS = ["ann@example.org", "bob@example.org", "cy@example.org", "x"]


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame([(e,) for e in EMAILS], "email string")


def test_profiles(customers, requests):
    line = lookup.profile_line(*[F.col(c) for c in (
        "customer_id", "name", "phone", "account_status", "address", "city", "state", "zip_code")])
    got = {r.email: r.profile for r in lookup.profile_lookup(requests, customers, "email", "customer_id", line).collect()}
    assert got["ann@example.org"] == PROFILE  # the smaller id of two customers with one email
    assert got["bob@example.org"] is None  # one NULL field
    assert got["x"] == "No customer found with email: x"


def test_histories(customers, bills, tickets, requests):
    bill = lookup.bill_line(*[F.col(c) for c in ("bill_id", "amount", "status", "due_date", "service_type")])
    got = {r.email: r.history for r in lookup.history_lookup(
        requests, customers, bills, "email", "customer_id", bill, [lookup.newest_first(F.col("bill_date")), F.col("bill_id")],
        lookup.NO_BILLS).collect()}
    assert got == {
        "ann@example.org": BILLS, "bob@example.org": "No billing records found for customer: bob@example.org",
        "cy@example.org": "",  # its only line is NULL
        "x": "No customer found with email: x"}
    ticket = lookup.ticket_line(*[F.col(c) for c in ("ticket_id", "issue_type", "description", "status", "resolved_date")])
    got = {r.email: r.history for r in lookup.history_lookup(
        requests, customers, tickets, "email", "customer_id", ticket,
        [lookup.newest_first(F.col("created_date")), F.col("ticket_id")], lookup.NO_TICKETS).collect()}
    assert got["ann@example.org"] == TICKETS
    assert got["cy@example.org"] == "No support tickets found for customer: cy@example.org"


def test_sql_functions(spark, customers, bills, tickets, requests):
    for name, df in (("cust", customers), ("bill", bills), ("tick", tickets), ("req", requests)):
        df.createOrReplaceTempView(name)
    lookup.register_lookups(spark, "cust", "bill", "tick")
    one = spark.sql("SELECT get_customer_info('ann@example.org') a, get_billing_info('ann@example.org') b, "
                    "get_support_tickets('ann@example.org') c, get_billing_info('x') d").first()
    assert tuple(one) == (PROFILE, BILLS, TICKETS, "No customer found with email: x")
    many = spark.sql("SELECT email, get_customer_info(email) p, get_billing_info(email) b, get_support_tickets(email) t FROM req")
    got = {r.email: (r.p, r.b, r.t) for r in many.collect()}
    assert got["bob@example.org"] == (None, "No billing records found for customer: bob@example.org",
                                      "No support tickets found for customer: bob@example.org")
    assert got["cy@example.org"][1] == ""
    lookup.drop_lookups(spark)
    with pytest.raises(Exception, match="get_billing_info"):
        spark.sql("SELECT get_billing_info('x')").collect()


def test_pages_of_a_hot_customer(spark):
    """One customer holds most rows, half of them on one day."""
    rows = [(1, i, 5 if i % 2 else i % 7) for i in range(500)] + [(2 + i % 40, 1000 + i, i % 5) for i in range(200)]
    lost = spark.createDataFrame([(None, 5000 + i, 1) for i in range(50)], "c bigint, i bigint, d bigint")
    df = spark.createDataFrame(rows, "c bigint, i bigint, d bigint").unionByName(lost).repartition(7)
    pages = lookup.history_pages(df, "c", F.concat(F.lit("L"), F.col("i").cast("string")), [-F.col("d"), F.col("i")], 30)
    got = {(r.c, r.page): (r.n_records, r.history.split("\n")) for r in pages.collect()}
    want = {}
    for c in {r[0] for r in rows}:
        lines = [f"L{i}" for _, i in sorted((-d, i) for cc, i, d in rows if cc == c)]
        for p in range(0, len(lines), 30):
            want[c, p // 30] = (len(lines[p:p + 30]), lines[p:p + 30])
    assert got == want


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_number_rows(spark, keys):
    rows = [(None if i % 11 == 0 else (0 if i % 3 else i % 5), (i * 37) % 1000) for i in range(900)]
    df = spark.createDataFrame(rows, "k bigint, v bigint").repartition(5)
    got = sorted((r.k if keys else None, r.v, r.row_id) for r in number_rows(df, [F.col("v")], keys).collect()) if not keys else \
        sorted(((-1 if r.k is None else r.k), r.v, r.row_id) for r in number_rows(df, [F.col("v")], keys).collect())
    groups: dict = {}
    for k, v in rows:
        groups.setdefault((-1 if k is None else k) if keys else None, []).append(v)
    want = sorted((k, v, n) for k, vs in groups.items() for n, v in enumerate(sorted(vs)))
    assert got == want


def test_order_is_total_on_both_paths(spark):
    rows = spark.createDataFrame([("c", f"line{i}", "2024-01-01") for i in range(6)], "c string, l string, d string")
    date = [lookup.newest_first(F.col("d").cast("date"))]
    small = lookup.history_pages(rows, "c", F.col("l"), date).collect()
    large = lookup.history_pages(rows.repartition(5), "c", F.col("l"), date, lines_per_page=3).orderBy("page").collect()
    assert small[0].history == "\n".join(r.history for r in large) == "\n".join(f"line{i}" for i in range(6))


def test_requests_narrow_the_records_before_grouping(spark):
    from parlance.operators.lookup import history_lookup

    customers = spark.range(100).selectExpr("id as cid", "concat('n', id) as name")
    records = spark.range(1000).selectExpr("id % 100 as cid", "concat('r', id) as l", "date'2024-01-01' as d")
    asked = spark.createDataFrame([("n5",)], "name string")
    out = history_lookup(asked, customers, records, "name", "cid", F.col("l"), [lookup.newest_first(F.col("d"))], "none {}")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.first().history.count("\n") == 9
    grouped = plan[plan.index("collect_list"):]
    assert "Join" in grouped  # the semi-joined owners lie below the grouping

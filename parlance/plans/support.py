"""Customer lookups: profiles, bills and tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators import lookup
from parlance.plans.registry import Tables, query

TICKETS_PER_PAGE = 50

# Requests name every customer seen in events, and every supplier, which no customer list knows.
_REQUESTS = """
    req AS (SELECT DISTINCT 'Customer#' || lpad(user_id::VARCHAR, 9, '0') AS c_name FROM events
            UNION ALL SELECT s_name FROM supplier)"""


def _requests(t: Tables) -> DataFrame:
    seen = t.events.select(F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("c_name"))
    return seen.distinct().unionByName(t.supplier.select(F.col("s_name").alias("c_name")))


@query(f"""
    WITH {_REQUESTS}
    SELECT c_name, CASE WHEN c_custkey IS NULL THEN 'No customer found with email: ' || c_name ELSE
        'Customer ID: ' || c_custkey || ', Name: ' || c_name || ', Phone: ' || c_acctbal::DECIMAL(15,2) || ', Status: '
        || c_mktsegment || ', Address: ' || r_name || ', ' || n_name || ', ' || n_regionkey || ' ' || c_nationkey END AS profile
    FROM req LEFT JOIN customer USING (c_name) LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey""")
def profile_lookup(t: Tables) -> DataFrame:
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    text = lambda name: F.col(name).cast("string")
    line = lookup.profile_line(
        text("c_custkey"), F.col("c_name"), lookup.money(F.col("c_acctbal")), F.col("c_mktsegment"), F.col("r_name"),
        F.col("n_name"), text("n_regionkey"), text("c_nationkey"))
    return lookup.profile_lookup(_requests(t), customers, "c_name", "c_custkey", line)


_BILL = """'Bill ' || o_orderkey || ': $' || o_totalprice::DECIMAL(15,2) || ' - ' || o_orderstatus || ' (Due: '
    || strftime(o_orderdate, '%Y-%m-%d') || ') - ' || o_orderpriority"""


def _bills() -> tuple:
    line = lookup.bill_line(
        F.col("o_orderkey").cast("string"), F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderdate"),
        F.col("o_orderpriority"))
    return line, [lookup.newest_first(F.col("o_orderdate")), F.col("o_orderkey")]


@query(f"""
    WITH n AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey) - 1) // 1000 AS page
               FROM orders)
    SELECT o_custkey, page, count(*) AS n_records,
           string_agg({_BILL}, chr(10) ORDER BY o_orderdate::DATE DESC, o_orderkey) AS history FROM n GROUP BY ALL""")
def billing_history(t: Tables) -> DataFrame:
    return lookup.history_pages(t.orders, "o_custkey", *_bills())


_TICKET = """'Ticket ' || event_id || ': ' || event_type || ' - ' || props || ' (' || CASE event_type
    WHEN 'purchase' THEN 'Resolved: ' || strftime(ts, '%Y-%m-%d') ELSE 'Status: open' END || ')'"""


def _tickets() -> tuple:
    status = F.when(F.col("event_type") == "purchase", "resolved").otherwise("open")
    line = lookup.ticket_line(F.col("event_id").cast("string"), F.col("event_type"), F.col("props"), status, F.col("ts"))
    return line, [lookup.newest_first(F.col("ts")), F.col("event_id")]


@query(f"""
    WITH n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC, event_id) - 1) // {TICKETS_PER_PAGE} AS page
               FROM events)
    SELECT user_id, page, count(*) AS n_records,
           string_agg({_TICKET}, chr(10) ORDER BY ts::DATE DESC, event_id) AS history FROM n GROUP BY ALL""")
def ticket_history(t: Tables) -> DataFrame:
    """Small pages, so most users take the path of customers with many records."""
    return lookup.history_pages(t.events, "user_id", *_tickets(), lines_per_page=TICKETS_PER_PAGE)


_MISSING = f"""
    WITH req AS (SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier),
    n AS (SELECT c_name, (row_number() OVER (PARTITION BY c_name ORDER BY ts::DATE DESC, event_id) - 1) // 1000 AS page,
                 ts, event_id, {_TICKET} AS line FROM events JOIN customer ON user_id = c_custkey),
    h AS (SELECT c_name, page, string_agg(line, chr(10) ORDER BY ts::DATE DESC, event_id) AS history FROM n GROUP BY ALL)
    SELECT req.c_name, coalesce(h.page, 0) AS page, CASE
        WHEN c.c_name IS NULL THEN 'No customer found with email: ' || req.c_name
        WHEN h.c_name IS NULL THEN 'No support tickets found for customer: ' || req.c_name ELSE history END AS history
    FROM req LEFT JOIN customer c ON c.c_name = req.c_name LEFT JOIN h ON h.c_name = req.c_name"""


def _everyone(t: Tables) -> DataFrame:
    return t.customer.select("c_name").unionByName(t.supplier.select(F.col("s_name").alias("c_name")))


@query(_MISSING)
def lookup_missing(t: Tables) -> DataFrame:
    """All three answers: tickets, a customer without tickets, and an unknown customer."""
    tickets = t.events.withColumnRenamed("user_id", "c_custkey")
    return lookup.history_lookup(_everyone(t), t.customer, tickets, "c_name", "c_custkey", *_tickets(), lookup.NO_TICKETS)


@query(f"""
    WITH req AS (SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier),
    n AS (SELECT c_name, (row_number() OVER (PARTITION BY c_name ORDER BY o_orderdate::DATE DESC, o_orderkey) - 1) // 1000 AS page,
                 o_orderdate, o_orderkey, {_BILL} AS line FROM orders JOIN customer ON o_custkey = c_custkey),
    h AS (SELECT c_name, page, string_agg(line, chr(10) ORDER BY o_orderdate::DATE DESC, o_orderkey) AS history FROM n GROUP BY ALL)
    SELECT req.c_name, coalesce(h.page, 0) AS page, CASE
        WHEN c.c_name IS NULL THEN 'No customer found with email: ' || req.c_name
        WHEN h.c_name IS NULL THEN 'No billing records found for customer: ' || req.c_name ELSE history END AS history
    FROM req LEFT JOIN customer c ON c.c_name = req.c_name LEFT JOIN h ON h.c_name = req.c_name""")
def billing_lookup(t: Tables) -> DataFrame:
    """Bills by customer name: bills, a customer without bills, and an unknown customer."""
    bills = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return lookup.history_lookup(_everyone(t), t.customer, bills, "c_name", "c_custkey", *_bills(), lookup.NO_BILLS)


@query(f"""
    WITH req AS (SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier),
    bills AS (SELECT c_name, string_agg({_BILL}, chr(10) ORDER BY o_orderdate::DATE DESC, o_orderkey::VARCHAR) AS text
              FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name),
    tickets AS (SELECT c_name, string_agg('Ticket ' || event_id || ': ' || event_type || ' - ' || props || ' (Status: open)', chr(10)
                ORDER BY ts::DATE DESC, event_id::VARCHAR) AS text FROM events JOIN customer ON user_id = c_custkey GROUP BY c_name)
    SELECT req.c_name, CASE WHEN c_custkey IS NULL THEN 'No customer found with email: ' || req.c_name ELSE
        'Customer ID: ' || c_custkey || ', Name: ' || c.c_name || ', Phone: -, Status: ' || c_mktsegment
        || ', Address: -, -, - -' END AS profile,
        CASE WHEN c_custkey IS NULL THEN 'No customer found with email: ' || req.c_name
             ELSE coalesce(bills.text, 'No billing records found for customer: ' || req.c_name) END AS bills,
        CASE WHEN c_custkey IS NULL THEN 'No customer found with email: ' || req.c_name
             ELSE coalesce(tickets.text, 'No support tickets found for customer: ' || req.c_name) END AS tickets
    FROM req LEFT JOIN customer c ON c.c_name = req.c_name LEFT JOIN bills ON bills.c_name = req.c_name
    LEFT JOIN tickets ON tickets.c_name = req.c_name""")
def sql_function_lookup(t: Tables) -> DataFrame:
    """The three SQL functions, called with a column.

    The list functions give one text per customer, however long; ``lookup_missing`` and ``billing_lookup`` give
    the same in pages.
    """
    text = lambda name: F.col(name).cast("string")
    t.customer.select(
        text("c_custkey").alias("customer_id"), F.col("c_name").alias("email"), F.col("c_name").alias("name"),
        F.lit("-").alias("phone"), F.lit("-").alias("address"), F.lit("-").alias("city"), F.lit("-").alias("state"),
        F.lit("-").alias("zip_code"), F.col("c_mktsegment").alias("account_status"),
    ).createOrReplaceTempView("parlance_customers")
    t.orders.select(
        text("o_orderkey").alias("bill_id"), text("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("bill_date"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("due_date"),
        F.col("o_orderpriority").alias("service_type"),
    ).createOrReplaceTempView("parlance_billing")
    t.events.select(
        text("event_id").alias("ticket_id"), text("user_id").alias("customer_id"), F.col("event_type").alias("issue_type"),
        F.col("props").alias("description"), F.lit("open").alias("status"), F.col("ts").cast("date").alias("created_date"),
        F.lit(None).cast("date").alias("resolved_date"),
    ).createOrReplaceTempView("parlance_tickets")
    _everyone(t).createOrReplaceTempView("parlance_requests")
    lookup.register_lookups(t.spark, "parlance_customers", "parlance_billing", "parlance_tickets")
    return t.spark.sql(
        "SELECT c_name, get_customer_info(c_name) AS profile, get_billing_info(c_name) AS bills, "
        "get_support_tickets(c_name) AS tickets FROM parlance_requests")

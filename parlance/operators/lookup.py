"""Per-customer lookups, for any number of requests at once, and the same as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sizing import number_rows, small_side, split_hot

LINES_PER_PAGE = 1000

# The sentences and line formats the lookups answer with.
NO_CUSTOMER = "No customer found with email: {}"
NO_BILLS = "No billing records found for customer: {}"
NO_TICKETS = "No support tickets found for customer: {}"
PROFILE = "Customer ID: {}, Name: {}, Phone: {}, Status: {}, Address: {}, {}, {} {}"
BILL = "Bill {}: ${} - {} (Due: {}) - {}"
TICKET = "Ticket {}: {} - {} ({})"
RESOLVED = "Resolved: {}"
UNRESOLVED = "Status: {}"


def fill(template: str, *fields: Column) -> Column:
    """The template with each ``{}`` replaced; NULL as soon as one field is NULL."""
    texts = [F.lit(t) for t in template.split("{}")]
    return F.concat(*[part for pair in zip(texts, [*fields, F.lit("")], strict=True) for part in pair])


def money(amount: Column) -> Column:
    """Through DECIMAL, so large amounts never turn into exponents."""
    return amount.cast("decimal(15,2)").cast("string")


def profile_line(*fields: Column) -> Column:
    """Id, name, phone, status, address, city, state, zip code."""
    return fill(PROFILE, *fields)


def bill_line(bill_id: Column, amount: Column, status: Column, due: Column, service: Column) -> Column:
    return fill(BILL, bill_id, money(amount), status, due.cast("date").cast("string"), service)


def ticket_line(ticket_id: Column, issue: Column, description: Column, status: Column, resolved: Column) -> Column:
    """A resolved ticket without a date has no line."""
    state = F.when(status == "resolved", fill(RESOLVED, resolved.cast("date").cast("string"))).otherwise(
        fill(UNRESOLVED, status))
    return fill(TICKET, ticket_id, issue, description, state)


def one_per_key(customers: DataFrame, key: str, id_col: str) -> DataFrame:
    """The row with the smallest id for each lookup key; combines before the shuffle."""
    rest = [c for c in customers.columns if c != key]
    picked = customers.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(id_col)).alias("__row"))
    return picked.select(key, "__row.*")


def profile_lookup(requests: DataFrame, customers: DataFrame, key: str, id_col: str, line: Column) -> DataFrame:
    """request key -> profile text, or the sentence that names the unknown key."""
    asked = small_side(requests.select(key).distinct())
    found = one_per_key(customers.join(asked, key, "left_semi"), key, id_col).select(key, line.alias("__line"), F.lit(True).alias("__known"))
    answer = F.when(F.col("__known"), F.col("__line")).otherwise(fill(NO_CUSTOMER, F.col(key).cast("string")))
    return requests.join(found, key, "left").select(*requests.columns, answer.alias("profile"))


def history_pages(
    records: DataFrame, customer_id: str, line: Column, order: list[Column], lines_per_page: int = LINES_PER_PAGE
) -> DataFrame:
    """Lines per customer in the given order, joined by newlines: customer, page, n_records, history.

    Customers with at most ``lines_per_page`` records (nearly all) take one shuffle and have page 0
    only.  The records of larger customers are numbered by a distributed sort first and become
    pages 0, 1, 2 ...; no task ever holds more than one page of a customer.  NULL lines vanish, and
    so do records without a customer, which no lookup can reach.
    """
    small, large = split_hot(records.where(F.col(customer_id).isNotNull()), customer_id, lines_per_page)
    marks = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    names = [f"__o{i}" for i in range(len(order))]

    def pages(rows: DataFrame) -> DataFrame:
        sort = F.array_sort(F.collect_list(F.struct(*names, "__line")))  # the line makes the order total
        return rows.groupBy(customer_id, "page").agg(F.count("*").alias("n_records"), sort.alias("__rows")).select(
            customer_id, "page", "n_records",
            F.array_join(F.transform("__rows", lambda r: r["__line"]), "\n").alias("history"))

    # Orders are ascending expressions; a descending date is passed as a negative day number.
    shaped = [df.select(customer_id, *marks, line.alias("__line")) for df in (small, large) if df is not None]
    result = pages(shaped[0].withColumn("page", F.lit(0).cast("long")))
    if len(shaped) == 2:
        numbered = number_rows(shaped[1], [*[F.col(n) for n in names], F.col("__line")], [customer_id], "__row")
        page = F.floor(F.col("__row") / lines_per_page).cast("long")
        result = result.unionByName(pages(numbered.withColumn("page", page)))
    return result


def newest_first(date: Column) -> Column:
    """An ascending sort value that puts the latest date first and NULL dates last."""
    return F.coalesce(-F.unix_date(date.cast("date")), F.lit(2147483647))


def history_lookup(
    requests: DataFrame,
    customers: DataFrame,
    records: DataFrame,
    key: str,
    id_col: str,
    line: Column,
    order: list[Column],
    no_records: str,
    lines_per_page: int = LINES_PER_PAGE,
) -> DataFrame:
    """request key -> history pages, or why there are none: unknown customer, or known without records.

    All customers that share the key count, as they do for a lookup by email.  Requests narrow the customers and these the
    records before anything is grouped, so one request does not build every history.
    """
    asked = small_side(requests.select(key).distinct())
    owners = customers.select(key, id_col).join(asked, key, "left_semi")
    keyed = records.join(small_side(owners), id_col)
    pages = history_pages(keyed, key, line, order, lines_per_page)
    known = owners.select(key).distinct().withColumn("__known", F.lit(True))
    answer = (
        F.when(F.col("__known").isNull(), fill(NO_CUSTOMER, F.col(key).cast("string")))
        .when(F.col("page").isNull(), fill(no_records, F.col(key).cast("string")))
        .otherwise(F.col("history"))
    )
    return (
        requests.join(known, key, "left").join(pages, key, "left")
        .select(*requests.columns, F.coalesce("page", F.lit(0)).alias("page"), answer.alias("history"))
    )


# Each function is one aggregate over one left join, so a call scans each table once.  A scalar
# function answers one request; tables of requests go through profile_lookup and history_lookup.
_ARGUMENT = "customer_email STRING COMMENT 'Email address of the customer to look up'"


def _fill_sql(template: str, *fields: str) -> str:
    texts = ["'" + t.replace("'", "\\'") + "'" for t in template.split("{}")]
    return f"concat({', '.join(part for pair in zip(texts, [*fields, chr(39) * 2], strict=True) for part in pair)})"


# Chooses between the list and the sentences that say why there is none.  As a function of its own
# it receives the subquery row as one argument, so the subquery is planned once.
_ANSWER = (
    "lookup_answer(f STRUCT<customers: BIGINT, records: BIGINT, text: STRING>, email STRING, none STRING) RETURNS STRING "
    f"RETURN CASE WHEN coalesce(f.customers, 0) = 0 THEN {_fill_sql(NO_CUSTOMER, 'email')} "
    "WHEN f.records = 0 THEN concat(none, email) ELSE f.text END"
)


def _list_sql(customers: str, records: str, record_id: str, date: str, line: str, none: str) -> str:
    entry = f"struct(coalesce(-unix_date(r.{date}), 2147483647) AS o, r.{record_id} AS id, {line} AS line)"
    found = f"""(
        SELECT struct(count(*) AS customers, count(r.customer_id) AS records, array_join(transform(array_sort(
            collect_list(CASE WHEN r.customer_id IS NOT NULL THEN {entry} END)), e -> e.line), '\n') AS text)
        FROM {customers} c LEFT JOIN {records} r ON r.customer_id = c.customer_id
        WHERE c.email = customer_email)"""
    return f"lookup_answer({found}, customer_email, '{none.format('')}')"


def register_lookups(spark: SparkSession, customers: str, billing: str, tickets: str) -> None:
    """The three lookups as SQL functions over the named tables or views."""
    profile = _fill_sql(PROFILE, "customer_id", "name", "phone", "account_status", "address", "city", "state", "zip_code")
    bill = _fill_sql(
        BILL, "r.bill_id", "CAST(CAST(r.amount AS DECIMAL(15,2)) AS STRING)", "r.status", "CAST(r.due_date AS STRING)",
        "r.service_type")
    state = (
        f"CASE WHEN r.status = 'resolved' THEN {_fill_sql(RESOLVED, 'CAST(r.resolved_date AS STRING)')} "
        f"ELSE {_fill_sql(UNRESOLVED, 'r.status')} END")
    ticket = _fill_sql(TICKET, "r.ticket_id", "r.issue_type", "r.description", state)
    functions = {
        "get_customer_info": (
            "Id, name, phone, status and address of the customer with this email",
            f"lookup_answer((SELECT struct(count(*) AS customers, count(*) AS records, min_by({profile}, customer_id) AS text) "
            f"FROM {customers} WHERE email = customer_email), customer_email, '')"),
        "get_billing_info": (
            "Every bill of the customer with this email, latest first",
            _list_sql(customers, billing, "bill_id", "bill_date", bill, NO_BILLS)),
        "get_support_tickets": (
            "Every ticket of the customer with this email, latest first",
            _list_sql(customers, tickets, "ticket_id", "created_date", ticket, NO_TICKETS)),
    }
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_ANSWER}")
    for name, (comment, body) in functions.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({_ARGUMENT}) RETURNS STRING COMMENT '{comment}' RETURN {body}")


def drop_lookups(spark: SparkSession) -> None:
    for name in ("get_customer_info", "get_billing_info", "get_support_tickets", "lookup_answer"):
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")

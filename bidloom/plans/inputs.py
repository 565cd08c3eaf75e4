"""Sourcing inputs read from a star schema of parts, suppliers and order lines.

`part` supplies the requested items, `supplier` the vendors and `lineitem` the
quoted lines. Two views of who is quoting are offered: every supplier on its
own, or suppliers pooled into one trading house per region (few vendors, each
holding a large share of the lines). The expressions are plain SQL that any
engine evaluates identically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.session import broadcast_if_small, spread


def code_digits(key: str) -> str:
    rest = f"({key} % 1000000)"
    return f"case when {rest} < 1000 then lpad(cast({rest} as string), 3, '0') else cast({rest} as string) end"


def code_prefix(key: str) -> str:
    high = f"chr(cast(65 + floor({key} / 26000000) as int))"
    low = f"chr(cast(65 + floor({key} / 1000000) % 26 as int))"
    return f"concat('PT', {high}, {low})"


def sku(key: str) -> str:
    return f"concat({code_prefix(key)}, '-', {code_digits(key)})"


SIZE_TEXT = (
    "case when p_partkey % 3 = 0 "
    "then concat(cast(p_size * 10 + 100 as string), ' x ', cast((p_partkey % 40) * 10 + 100 as string), ' mm') "
    "else concat('size ', cast(p_size as string)) end"
)
SIZE_TEXT_TURNED = (
    "case when p_partkey % 3 = 0 "
    "then concat(cast((p_partkey % 40) * 10 + 100 as string), 'x', cast(p_size * 10 + 100 as string), 'mm') "
    "else cast(p_size as string) end"
)

ITEM_COLUMNS = {
    "sku": sku("p_partkey"),
    "description": f"concat(p_name, ' ', p_brand, ' ', p_type, ' ', {SIZE_TEXT})",
    "quantity": "case when p_partkey % 40 = 7 then null else cast(p_size * 10 + p_partkey % 7 as bigint) end",
    "canonical_unit": "case p_partkey % 10 when 8 then 'per roll' when 9 then 'per kg' else 'per box' end",
    "unit_family": "case p_partkey % 10 when 8 then 'roll' when 9 then 'weight' else 'discrete' end",
    "line_no": "cast(p_partkey + 1 as bigint)",
}

# How a supplier words an item when it does not use the buyer's code.
SUPPLIER_WORDING = {
    0: f"concat(p_type, ' ', p_name, ', ', {SIZE_TEXT_TURNED}, ' (', p_brand, ')')",
    1: f"concat(p_name, ' - ', {SIZE_TEXT_TURNED}, ' - ', p_brand)",
    2: f"concat(p_brand, ' ', p_name, ' ', p_type, ' ', {SIZE_TEXT})",
}

SUPPLIER_SAYS = "case l_suppkey % 3 when 0 then {0} when 1 then {1} else {2} end".format(*SUPPLIER_WORDING.values())
MIXED_DESCRIPTION = f"case when l_linenumber % 4 = 0 then {SUPPLIER_SAYS} end"

SUPPLIER_COLUMNS = {
    "vendor": "s_name",
    "vendor_ord": "cast(s_suppkey as bigint)",
    "source_file": (
        "concat(replace(lower(s_name), '#', '-'), case s_suppkey % 6 when 0 then '.xlsx' when 1 then '.pdf' "
        "when 2 then '.eml' when 3 then '.csv' when 4 then '.jpg' else '.docx' end)"
    ),
    "document_currency": "case s_nationkey % 5 when 0 then 'INR' when 1 then 'usd' when 2 then '€' when 3 then null else 'JPY' end",
    "freight_included": "case s_nationkey % 3 when 0 then true when 1 then false else null end",
    "payment_terms_days": "cast(30 + 15 * (s_suppkey % 3) as bigint)",
    "lead_time_days": "case when s_suppkey % 7 = 0 then null else cast(10 + s_suppkey % 20 as double) + 0.5 end",
    "overall_confidence": "cast(80 + s_suppkey % 20 as double) / 100",
    "unresolved_reference": "case when s_suppkey % 11 = 0 then 'our standard rate card' end",
}

HOUSE_COLUMNS = {
    "vendor": "concat('House ', r_name)",
    "vendor_ord": "cast(r_regionkey as bigint)",
    "source_file": "concat('house-', cast(r_regionkey as string), case when r_regionkey = 3 then '.jpg' else '.csv' end)",
    "document_currency": "case r_regionkey when 0 then 'INR' when 1 then 'USD' when 2 then 'EUR' when 3 then null else 'GBP' end",
    "freight_included": "case r_regionkey % 3 when 0 then true when 1 then false else null end",
    "payment_terms_days": "cast(30 + 15 * r_regionkey as bigint)",
    "lead_time_days": "cast(12 + 3 * r_regionkey as double)",
    "overall_confidence": "cast(85 + 2 * r_regionkey as double) / 100",
    "unresolved_reference": "case when r_regionkey = 1 then '2025 contract rates' end",
}

LINE_COLUMNS = {
    "line_id": (
        "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', "
        "cast(l_suppkey as string), '-', cast(cast(l_quantity as bigint) as string), '-', "
        "cast(cast(round(l_extendedprice * 100) as bigint) as string))"
    ),
    "line_ord": "l_orderkey * 10 + l_linenumber",
    "vendor_sku": (
        f"case l_linenumber % 4 when 1 then {sku('l_partkey')} "
        f"when 2 then concat(lower({code_prefix('l_partkey')}), ' ', {code_digits('l_partkey')}) "
        f"when 3 then concat({code_prefix('l_partkey')}, {code_digits('l_partkey')}) else null end"
    ),
    "description": (
        "case when l_linenumber % 4 = 0 and l_returnflag = 'R' and l_linestatus = 'F' then 'as discussed, no reference' "
        f"when l_linenumber % 4 = 0 then concat('our ref ', {sku('l_partkey')}, ', supplied as usual') else null end"
    ),
    "quoted_value": "case when l_tax = 0.08 and l_discount = 0.1 then null else l_extendedprice / l_quantity end",
    "currency": "case when l_linenumber = 2 then 'Rs.' when l_linenumber = 5 then '$' else null end",
    "unit_text": (
        "case l_linenumber when 1 then 'per box' when 2 then 'Nos' when 3 then 'per roll' when 4 then 'per kg' "
        "when 5 then 'per 100 pcs' when 6 then '/ 1,000' else null end"
    ),
    "quantity": "l_quantity",
    "confidence": "0.95 - l_discount",
    "condition_1": "case when l_returnflag = 'R' and l_linestatus = 'O' then 'rates subject to confirmation' end",
    "condition_2": "case when l_returnflag = 'A' and l_linestatus = 'F' and l_tax < 0.03 then 'plus one-time plate charge' end",
    "condition_3": "case when l_suppkey % 5 = 2 and l_linenumber < 7 then 'Prices exclude packing' end",
    "notes": "case when l_tax = 0.05 then 'indicative only' else '' end",
    "source_locator": "concat('row ', cast(l_orderkey * 10 + l_linenumber as string))",
    "source_snippet": (
        "case when l_discount = 0 then null else concat('order ', cast(l_orderkey as string), ' line ', cast(l_linenumber as string)) end"
    ),
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _project(df: DataFrame, columns: dict[str, str], *keep: str) -> DataFrame:
    return df.select(*keep, *[F.expr(e).alias(n) for n, e in columns.items()])


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item list being compared: one row per requested item."""
    return _project(read(spark, sf_dir, "part"), ITEM_COLUMNS)


def _houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    region = read(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_regionkey", "r_name")


def responses(spark: SparkSession, sf_dir: str, level: str = "supplier") -> DataFrame:
    """One row per vendor: the reply's header fields."""
    if level == "house":
        rows = _project(read(spark, sf_dir, "region"), HOUSE_COLUMNS)
    else:
        rows = _project(read(spark, sf_dir, "supplier"), SUPPLIER_COLUMNS)
    return rows.withColumn(
        "unresolved_references", F.array_compact(F.array("unresolved_reference"))
    ).drop("unresolved_reference")


def _vendor_keys(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    supplier = read(spark, sf_dir, "supplier")
    header = ("vendor", "vendor_ord", "source_file", "document_currency", "freight_included")
    if level == "house":
        houses = _houses(spark, sf_dir)
        joined = supplier.join(houses, supplier.s_nationkey == houses.n_nationkey)
        return _project(joined, {k: HOUSE_COLUMNS[k] for k in header}, "s_suppkey")
    return _project(supplier, {k: SUPPLIER_COLUMNS[k] for k in header}, "s_suppkey")


def quote_lines(spark: SparkSession, sf_dir: str, level: str = "supplier") -> DataFrame:
    """Every quoted line with its vendor's header fields beside it."""
    lines = spread(read(spark, sf_dir, "lineitem"))
    vendors = broadcast_if_small(_vendor_keys(spark, sf_dir, level), read(spark, sf_dir, "supplier"))
    joined = lines.join(vendors, lines.l_suppkey == vendors.s_suppkey)
    flat = _project(joined, LINE_COLUMNS, "vendor", "vendor_ord", "source_file", "document_currency", "freight_included")
    return flat.withColumn("conditions", F.array_compact(F.array("condition_1", "condition_2", "condition_3"))).drop(
        "condition_1", "condition_2", "condition_3"
    )


def mixed_lines(spark: SparkSession, sf_dir: str, level: str = "supplier") -> DataFrame:
    """Every quoted line; each fourth line of an order names its item in the supplier's words and not by a code."""
    lines = spread(read(spark, sf_dir, "lineitem"))
    vendors = broadcast_if_small(_vendor_keys(spark, sf_dir, level), read(spark, sf_dir, "supplier"))
    part = broadcast_if_small(read(spark, sf_dir, "part"), read(spark, sf_dir, "part"))
    joined = lines.join(vendors, lines.l_suppkey == vendors.s_suppkey).join(part, lines.l_partkey == part.p_partkey)
    flat = _project(joined, LINE_COLUMNS | {"description": MIXED_DESCRIPTION}, "vendor", "vendor_ord", "source_file", "document_currency", "freight_included")
    return flat.withColumn("conditions", F.array_compact(F.array("condition_1", "condition_2", "condition_3"))).drop("condition_1", "condition_2", "condition_3")


def uncoded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines quoted by description alone, each supplier in its own wording."""
    lines = spread(read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"))
    part = broadcast_if_small(read(spark, sf_dir, "part"), read(spark, sf_dir, "part"))
    supplier = broadcast_if_small(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), read(spark, sf_dir, "supplier"))
    return (
        lines.join(part, lines.l_partkey == part.p_partkey)
        .join(supplier, lines.l_suppkey == supplier.s_suppkey)
        .select(
            F.col("s_name").alias("vendor"),
            F.expr("l_orderkey * 10 + l_linenumber").alias("line_ord"),
            F.lit(None).cast("string").alias("vendor_sku"),
            F.expr(SUPPLIER_SAYS).alias("description"),
            F.expr(sku("l_partkey")).alias("true_sku"),
        )
    )


# --- questionnaires, terms, replies and requests ------------------------------

ANSWER_FIGURES = {
    "capacity": "cast(sum(cast(l_quantity as bigint)) as bigint)",
    "n_lines": "count(*)",
    "n_returned": "sum(case when l_returnflag = 'R' then 1 else 0 end)",
    "n_late": "sum(case when l_linestatus = 'O' then 1 else 0 end)",
}

# (criterion key, wordings suppliers use, answer, stated figure, evidence, note)
ASKED = (
    (
        "capacity",
        "case s_suppkey % 4 when 0 then 'Monthly production capacity above 15,000 units?' when 1 then 'Capacity' "
        "when 2 then 'Monthly capacity above 15,000 units' else 'Production capacity per month, units above 15,000?' end",
        "'yes'", "concat('approx. ', cast(capacity as string), ' units/month')", "null", "null",
    ),
    (
        "rejection",
        "case s_suppkey % 3 when 0 then 'Quality rejection rate below 33%?' when 1 then 'Rejection rate' else 'Quality rejection rate under 33%' end",
        "case when s_suppkey % 8 = 5 then 'No' else 'Yes' end",
        "case when s_suppkey % 8 = 5 then null else concat(cast(floor(n_returned * 1000 / n_lines) / 10 as string), '% average') end", "null",
        "case when s_suppkey % 8 = 5 then 'not tracked' else null end",
    ),
    (
        "iso",
        "case s_suppkey % 3 when 0 then 'ISO 9001 certification held?' when 1 then 'ISO 9001' else 'Are you ISO 9001 certified?' end",
        "case when s_acctbal < 0 then null when s_acctbal < 3000 then 'no' when s_acctbal < 5000 then 'In progress' else 'Yes' end", "null",
        "case when s_acctbal > 7000 then 'certificate no 4711 enclosed' else null end", "null",
    ),
    (
        "otd",
        "case s_suppkey % 2 when 0 then 'On-time delivery performance above 50%?' else 'OTD >50%' end",
        "'Yes'", "case when s_suppkey % 5 = 0 then null else concat(cast(floor((n_lines - n_late) * 1000 / n_lines) / 10 as string), '%') end",
        "case when s_suppkey % 5 = 1 then 'audited report' else null end", "null",
    ),
    (
        "sla",
        "case s_suppkey % 2 when 0 then 'Able to commit to a 30-day delivery SLA?' else 'SLA' end",
        "case when s_suppkey % 6 = 0 then 'unanswered' else 'Yes' end", "null", "null", "null",
    ),
)

CRITERIA = (
    ("capacity", "Monthly production capacity above 15,000 units?", "higher_better", 15000.0, " units/month", "Scored", 2.0),
    ("rejection", "Quality rejection rate below 33%?", "lower_better", 33.0, "%", "Scored", 1.0),
    ("iso", "ISO 9001 certification held?", "boolean", None, None, "Must have", 1.5),
    ("otd", "On-time delivery performance above 50%?", "higher_better", 50.0, "%", "Scored", 1.0),
    ("sla", "Able to commit to a 30-day delivery SLA?", "lower_better", 30.0, " days", "Ignore", 1.0),
)

TERMS = (
    ("freight", "case when s_nationkey % 3 = 0 then 'Delivered price' else 'Freight extra' end", "null", "null"),
    ("payment", "concat(cast(30 + 15 * (s_suppkey % 3) as string), ' days from invoice')", "null", "null"),
    ("discount", "'Slab rates on annual offtake'", "'confirmed annual volumes'", "cast(s_suppkey % 4 as double) + 0.5"),
)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each supplier answered, in its own wording; figures come from its own lines."""
    lines = spread(read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"))
    figures = lines.groupBy("l_suppkey").agg(*[F.expr(e).alias(n) for n, e in ANSWER_FIGURES.items()])
    supplier = read(spark, sf_dir, "supplier")
    rows = F.array(
        *[
            F.expr(
                f"named_struct('question_ord', cast({i} as bigint), 'key', '{k}', 'question', {q}, 'answer', cast({a} as string), "
                f"'stated_value', cast({v} as string), 'evidence', cast({e} as string), 'note', cast({n} as string))"
            )
            for i, (k, q, a, v, e, n) in enumerate(ASKED, 1)
        ]
    )
    joined = supplier.join(figures, supplier.s_suppkey == figures.l_suppkey)
    return joined.select(F.col("s_name").alias("vendor"), F.expr("cast(s_suppkey as bigint)").alias("vendor_ord"), F.inline(rows))


def criteria(spark: SparkSession) -> DataFrame:
    """The questions of the request: a fixed handful."""
    rows = [(k, i, *rest) for i, (k, *rest) in enumerate(CRITERIA, 1)]
    return spark.createDataFrame(
        rows, "key string, position bigint, question string, direction string, threshold double, unit string, requirement string, weight double"
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(
        *[F.expr(f"named_struct('kind', '{k}', 'text', {t}, 'trigger', cast({g} as string), 'value', cast({v} as double))") for k, t, g, v in TERMS]
    )
    return read(spark, sf_dir, "supplier").select(F.col("s_name").alias("vendor"), F.inline(rows))


# A customer stands for an invited firm and an order for a reply it may have sent.
FIRM = "concat('Firm', lpad(cast({k} as string), 9, '0'), ' Trading Co')"
REQUEST_OF = "concat('RFX/', c_mktsegment, '/', cast(c_nationkey as string))"


def invited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.expr(REQUEST_OF).alias("request_id"), F.expr(FIRM.format(k="c_custkey")).alias("vendor"), F.col("c_custkey").alias("vendor_ord")
    )


def invited_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = read(spark, sf_dir, "customer").groupBy(F.expr(REQUEST_OF).alias("request_id")).agg(F.count("*").alias("line_count"))
    return sizes.select("request_id", F.col("request_id").alias("reference"), F.lit("Annual contract").alias("title"), "line_count")


REPLY_TEXT = (
    "case o_orderkey % 5 "
    "when 0 then concat('Dear sir, against your ref ', lower(token), ' we quote ', o_orderpriority) "
    "when 1 then concat('Quotation from ', upper(vendor), ' for your enquiry') "
    "when 2 then 'Please find attached our best prices' "
    "when 3 then concat('Your RFX-UNKNOWN-ABC-12ef, regards ', vendor) "
    f"else concat(vendor, ' in reply to a thread with ', {FIRM.format(k='(o_custkey + 1)')}) end"
)


# The name read off the document itself.
READ_AS = "case o_orderkey % 3 when 0 then vendor when 1 then 'Letterhead unread' end"


def replies(spark: SparkSession, sf_dir: str, invitations: DataFrame) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return orders.join(invitations, orders.o_custkey == invitations.vendor_ord).select(
        F.col("o_orderkey").alias("reply_id"), F.expr(REPLY_TEXT).alias("text"), F.expr(READ_AS).alias("read_as")
    )


EVENT_COLUMNS = {
    "request_id": "l_orderkey",
    "event_ord": "cast(row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as bigint)",
    "op": "case when l_returnflag = 'R' and l_linestatus = 'F' then 'remove_line' when l_returnflag = 'N' then 'revise_line' else 'add_line' end",
    "sku": "concat(case when l_returnflag = 'N' then 'ln-' else 'LN-' end, lpad(cast(l_partkey % 3 as string), 3, '0'), case when (l_returnflag = 'N' or (l_returnflag = 'R' and l_linestatus = 'F')) and l_suppkey % 3 = 0 then '-2' else '' end)",
    "description": "case when l_tax > 0.04 then concat('item ', cast(l_partkey as string)) when l_tax < 0.02 then ' ' end",
    "quantity": "case when l_discount > 0.03 then cast(l_quantity as bigint) when l_discount > 0.01 then cast(0 as bigint) end",
    "unit": "case l_linenumber % 3 when 0 then 'per box' when 1 then 'per 100 sheets' end",
    "note": "case when l_tax < 0.02 then 'rush' end",
    "origin": "case when l_suppkey % 2 = 0 then 'suggested' else 'buyer' end",
}


def edit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a request being drafted, each of its lines one edit. Orders are small."""
    return _project(spread(read(spark, sf_dir, "lineitem")), EVENT_COLUMNS)


SNAPSHOT = "select l_orderkey as request_id, l_linenumber as line_no, min(l_partkey) as item, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity from {t} {w} group by l_orderkey, l_linenumber"
BEFORE_ROWS = "where l_shipdate < timestamp '2001-01-01 00:00:00' or l_returnflag <> 'A'"
AFTER_ROWS = "where l_linestatus = 'F' or l_returnflag <> 'R'"


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = spread(read(spark, sf_dir, "lineitem"))
    return tuple(spark.sql(SNAPSHOT.format(t="{t}", w=w), t=lines) for w in (BEFORE_ROWS, AFTER_ROWS))


REQUEST_COLUMNS = {
    "request_id": "o_orderkey",
    "starts_at": "case when o_orderkey % 9 = 0 then '' when o_orderkey % 13 = 0 then '9 Sep 2026, 09:00' else concat(cast(cast(o_orderdate as date) as string), 'T09:00') end",
    "ends_at": "case when o_orderkey % 11 = 0 then null else concat(cast(cast(o_orderdate as date) + cast(o_custkey % 20 - 3 as int) as string), 'T17:00') end",
    "vendor_category": "case when o_orderpriority = '5-LOW' then ' ' else o_orderpriority end",
    "supplier_count": "o_custkey % 4",
}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(read(spark, sf_dir, "orders"), REQUEST_COLUMNS)


DIRECTORY_SCORES = {
    "quality": "cast(5 + c_custkey % 6 as double)",
    "delivery": "case when c_custkey % 7 = 0 then null else cast(4 + c_custkey % 5 as double) + 0.5 end",
    "commercial": "cast(6 + c_custkey % 4 as double)",
    "responsiveness": "cast(3 + c_custkey % 8 as double)",
}


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved vendors by category: customers by market segment and nation."""
    scores = ", ".join(f"'{k}', {e}" for k, e in DIRECTORY_SCORES.items())
    return read(spark, sf_dir, "customer").select(
        F.expr("concat(c_mktsegment, '-', cast(c_nationkey as string))").alias("category"),
        F.expr(FIRM.format(k="c_custkey")).alias("vendor"),
        F.expr("c_custkey % 10 = 0").alias("incumbent"),
        F.expr(f"map_filter(map({scores}), (k, v) -> v is not null)").alias("scores"),
        F.lit("").alias("note"),
    )

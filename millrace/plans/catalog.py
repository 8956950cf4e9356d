"""The catalog of queries: for each operator, expression and aggregate a query over the test tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace import types as t
from millrace.functions import (
    Expr,
    and_,
    arith,
    array_and,
    array_and_scalar,
    array_not,
    array_or,
    array_or_scalar,
    array_xor,
    avg,
    compare,
    const,
    count,
    count_star,
    custom_aggregate,
    custom_scalar,
    interval_add,
    interval_sub,
    is_not_null,
    is_null,
    max_,
    min_,
    not_,
    or_,
    regex_match,
    sum_,
)
from millrace.plans.plan import Plan
from millrace.sources import custom as custom_source
from millrace.sources import dataframe, empty, memory, numbers, parquet

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Callable[[SparkSession, str], Plan]], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], Plan]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).dataframe()

        QUERIES[f.__name__], ORACLE[f.__name__] = run, sql
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> Plan:
    return parquet(spark, f"{sf_dir}/{name}.parquet")


def _with(spark: SparkSession, sf_dir: str, name: str, logical: dict[str, t.LogicalType] | None = None, **sql: str) -> Plan:
    """A table with columns derived by SQL expressions, of the given logical types."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet").withColumns({k: F.expr(v) for k, v in sql.items()})
    return dataframe(frame, logical)


def _int(value: int, of: t.LogicalType = t.I32) -> Expr:
    return const(value, of)


# Sources


@query("SELECT range AS number FROM range(10000)")
def numbers_scan(spark, sf_dir):
    return numbers(spark, 0, 10_000)


@query("SELECT range AS number FROM range(500, 1500)")
def numbers_offset_scan(spark, sf_dir):
    return numbers(spark, 500, 1000)


@query("SELECT (9223372036854775800 + range::HUGEINT)::DECIMAL(20,0) AS number FROM range(1000)")
def numbers_beyond_i64(spark, sf_dir):
    return numbers(spark, 9_223_372_036_854_775_800, 1000)


def _kept_numbers(spark: SparkSession, n: int) -> Plan:
    plan = numbers(spark, 0, n)
    four, zero = const(4, t.U64_NARROW), const(0, t.U64_NARROW)
    return plan.filter(compare(arith(plan["number"], "%", four), "!=", zero))


def numbers_query(spark: SparkSession, name: str, n: int) -> Plan:
    """The published benchmark queries over n numbers."""
    if name == "numbers_group_mod":
        plan = numbers(spark, 0, n)
        x = plan["number"]
        plan = plan.project(x, *[arith(x, "%", const(k, t.U8)).alias(f"mod{k}") for k in (3, 4, 5)])
        x = plan["number"]
        return plan.group_by(plan[1], plan[2], plan[3])(max_(x).alias("max_number"), sum_(x).alias("sum_number"), avg(x).alias("avg_number"))
    plan = numbers(spark, 0, n) if name == "numbers_avg_max_sum" else _kept_numbers(spark, n)
    x = plan["number"]
    functions = {
        "numbers_filtered_count": (count(x).alias("count_number"),),
        "numbers_filtered_count_star": (count_star().alias("count_all"),),
        "numbers_filtered_minmax": (count(x).alias("count_number"), max_(x).alias("max_number"), min_(x).alias("min_number")),
        "numbers_avg_max_sum": (avg(x).alias("avg_number"), max_(x).alias("max_number"), sum_(x).alias("sum_number")),
    }
    return plan.aggregate(*functions[name])


@query("SELECT count(range) AS count_number FROM range(1000000) WHERE range % 4 <> 0")
def numbers_filtered_count(spark, sf_dir):
    return numbers_query(spark, "numbers_filtered_count", 1_000_000)


@query("SELECT count(*) AS count_all FROM range(1000000) WHERE range % 4 <> 0")
def numbers_filtered_count_star(spark, sf_dir):
    return numbers_query(spark, "numbers_filtered_count_star", 1_000_000)


@query("SELECT count(range) AS count_number, max(range) AS max_number, min(range) AS min_number FROM range(1000000) WHERE range % 4 <> 0")
def numbers_filtered_minmax(spark, sf_dir):
    return numbers_query(spark, "numbers_filtered_minmax", 1_000_000)


@query("SELECT sum(range)::DOUBLE / count(*) AS avg_number, max(range) AS max_number, sum(range)::BIGINT AS sum_number FROM range(1000000)")
def numbers_avg_max_sum(spark, sf_dir):
    return numbers_query(spark, "numbers_avg_max_sum", 1_000_000)


@query("""SELECT (range % 3)::SMALLINT AS mod3, (range % 4)::SMALLINT AS mod4, (range % 5)::SMALLINT AS mod5, max(range) AS max_number,
       sum(range)::BIGINT AS sum_number, sum(range)::DOUBLE / count(*) AS avg_number FROM range(1000000) GROUP BY ALL""")
def numbers_group_mod(spark, sf_dir):
    return numbers_query(spark, "numbers_group_mod", 1_000_000)


_ORDERS = {"o_orderkey": t.I64, "o_orderstatus": t.VARCHAR, "o_totalprice": t.F64}


@query("SELECT o_orderkey FROM orders WHERE false")
def empty_scan(spark, sf_dir):
    return empty(spark, {"o_orderkey": t.I64})


@query("SELECT o_orderstatus, count(*) AS orders FROM orders WHERE false GROUP BY o_orderstatus")
def empty_scan_group(spark, sf_dir):
    plan = empty(spark, _ORDERS)
    return plan.group_by(plan["o_orderstatus"])(count_star().alias("orders"))


@query("SELECT count(*) AS orders, sum(o_totalprice) AS total, min(o_orderkey) AS least FROM orders WHERE false")
def empty_scan_agg(spark, sf_dir):
    plan = empty(spark, _ORDERS)
    return plan.aggregate(count_star().alias("orders"), sum_(plan["o_totalprice"]).alias("total"), min_(plan["o_orderkey"]).alias("least"))


@query("SELECT sum(x)::BIGINT AS total, count(x) AS known, count(*) AS rows FROM (VALUES (1::INT, 'a'), (NULL, 'b'), (3, NULL)) v(x, y)")
def memory_scan_agg(spark, sf_dir):
    plan = memory(spark, [[[1, None], ["a", "b"]], [[3], [None]]], {"x": t.I32, "y": t.VARCHAR})
    return plan.aggregate(sum_(plan["x"]).alias("total"), count(plan["x"]).alias("known"), count_star().alias("rows"))


@query("SELECT x, y FROM (VALUES (1::INT, 'a'), (NULL, 'b'), (3, NULL)) v(x, y)")
def memory_scan(spark, sf_dir):
    return memory(spark, [[[1, None], ["a", "b"]], [[3], [None]]], {"x": t.I32, "y": t.VARCHAR})


@query("SELECT r_regionkey, r_name FROM region")
def parquet_scan(spark, sf_dir):
    return _table(spark, sf_dir, "region")


# Projection and constants


@query("SELECT l_orderkey AS k, l_linenumber FROM lineitem")
def proj_fields_alias(spark, sf_dir):
    plan = _table(spark, sf_dir, "lineitem")
    return plan.project(plan["l_orderkey"].alias("k"), plan["l_linenumber"])


@query("SELECT o_orderkey, 1::INT AS one, 'x' AS letter, NULL::BIGINT AS nothing FROM orders")
def proj_constant(spark, sf_dir):
    plan = _table(spark, sf_dir, "orders")
    return plan.project(plan["o_orderkey"], _int(1).alias("one"), const("x", t.VARCHAR).alias("letter"), const(None, t.I64).alias("nothing"))


@query("SELECT sum(1)::BIGINT AS ones, count(1) AS rows, count(NULL) AS nothing FROM orders")
def const_in_agg(spark, sf_dir):
    plan = _table(spark, sf_dir, "orders")
    return plan.aggregate(sum_(_int(1)).alias("ones"), count(_int(1)).alias("rows"), count(const(None, t.I32)).alias("nothing"))


@query("SELECT 7::INT AS k, count(*) AS rows FROM orders GROUP BY 1")
def const_group_key(spark, sf_dir):
    plan = _table(spark, sf_dir, "orders")
    return plan.group_by(_int(7).alias("k"))(count_star().alias("rows"))


# Arithmetic


def _lines(spark: SparkSession, sf_dir: str, **sql: str) -> Plan:
    return _with(spark, sf_dir, "lineitem", **sql)


def _arith_query(name: str, sql: str, make: Callable[[Plan], Expr], **derived: str) -> None:
    def f(spark, sf_dir):
        plan = _lines(spark, sf_dir, **derived)
        return plan.project(plan["l_orderkey"], plan["l_linenumber"], make(plan).alias("v"))

    f.__name__ = name
    query(f"SELECT l_orderkey, l_linenumber, {sql} AS v FROM lineitem")(f)


_NULLED = "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_linenumber END"
_arith_query("arith_add", "(l_linenumber + 5)::INT", lambda p: arith(p["l_linenumber"], "+", _int(5)))
_arith_query("arith_add_columns", "l_orderkey + l_partkey", lambda p: arith(p["l_orderkey"], "+", p["l_partkey"]))
_arith_query("arith_add_null", f"({_NULLED} + l_linenumber)::INT", lambda p: arith(p["n"], "+", p["l_linenumber"]), n=_NULLED)
_arith_query("arith_sub", "l_orderkey - l_partkey", lambda p: arith(p["l_orderkey"], "-", p["l_partkey"]))
_arith_query("arith_mul", "(l_linenumber * 3)::INT", lambda p: arith(p["l_linenumber"], "*", _int(3)))
_arith_query("arith_mul_double", "l_quantity * l_discount", lambda p: arith(p["l_quantity"], "*", p["l_discount"]))
_arith_query("arith_int_div", "(l_orderkey - 20000) // (l_partkey + 1)", lambda p: arith(arith(p["l_orderkey"], "-", const(20000, t.I64)), "/", arith(p["l_partkey"], "+", const(1, t.I64))))
_arith_query("arith_float_div", "l_extendedprice / l_quantity", lambda p: arith(p["l_extendedprice"], "/", p["l_quantity"]))
_arith_query(
    "arith_float_div_zero",
    "CASE WHEN l_linenumber = 1 THEN 0.0::DOUBLE / 0.0::DOUBLE ELSE (l_linenumber - 3)::DOUBLE / 0.0::DOUBLE END",
    lambda p: arith(p["x"], "/", const(0.0, t.F64)),
    x="CASE WHEN l_linenumber = 1 THEN 0D ELSE CAST(l_linenumber - 3 AS DOUBLE) END",
)
_arith_query("arith_rem", "l_orderkey % (l_partkey + 1)", lambda p: arith(p["l_orderkey"], "%", arith(p["l_partkey"], "+", const(1, t.I64))))
_arith_query("arith_rem_mixed", "(l_orderkey % l_linenumber)::INT", lambda p: arith(p["l_orderkey"], "%", p["l_linenumber"]))
_arith_query("arith_rem_negative", "(-l_linenumber % 3)::INT", lambda p: arith(arith(_int(0), "-", p["l_linenumber"]), "%", _int(3)))
_arith_query("arith_rem_double", "l_extendedprice % l_quantity", lambda p: arith(p["l_extendedprice"], "%", p["l_quantity"]))
_arith_query("arith_rem_null_divisor", f"(l_orderkey % {_NULLED})::INT", lambda p: arith(p["l_orderkey"], "%", p["n"]), n=_NULLED)
_arith_query("arith_div_null_divisor", f"(l_linenumber // {_NULLED})::INT", lambda p: arith(p["l_linenumber"], "/", p["n"]), n=_NULLED)
_arith_query("arith_scalar_left", "(100 - l_linenumber)::INT", lambda p: arith(_int(100), "-", p["l_linenumber"]))
_arith_query("arith_small_ints", "((l_linenumber % 11)::TINYINT + 3::TINYINT)::TINYINT", lambda p: arith(arith(p["l_linenumber"], "%", const(11, t.I8)), "+", const(3, t.I8)))


@query("SELECT o_orderkey, (((o_orderkey % 200) + 50) & 255)::SMALLINT AS v FROM orders")
def arith_unsigned_wrap(spark, sf_dir):
    from millrace.functions import Options

    plan = _with(spark, sf_dir, "orders", {"b": t.U8}, b="CAST(o_orderkey % 200 AS SMALLINT)")
    return plan.project(plan["o_orderkey"], arith(plan["b"], "+", const(50, t.U8), Options(overflow="wrap")).alias("v"))


@query("""SELECT o_orderkey, (CASE WHEN m >= 9223372036854775808 THEN m - 18446744073709551616 ELSE m END)::BIGINT AS v
    FROM (SELECT o_orderkey, ((o_orderkey::HUGEINT * 6364136223846793005) % 18446744073709551616) AS m FROM orders)""")
def arith_signed_wrap(spark, sf_dir):
    from millrace.functions import Options

    plan = _table(spark, sf_dir, "orders")
    return plan.project(plan["o_orderkey"], arith(plan["o_orderkey"], "*", const(6364136223846793005, t.I64), Options(overflow="wrap")).alias("v"))


@query("SELECT event_id, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS v FROM events")
def ts_duration(spark, sf_dir):
    plan = _with(spark, sf_dir, "events", first="TIMESTAMP_NTZ'2024-01-01 00:00:00'")
    return plan.project(plan["event_id"], arith(plan["ts"], "-", plan["first"]).alias("v"))


@query("SELECT event_id, (user_id % 12 + 3)::INT AS months, (user_id % 30 - 5)::INT AS days, event_id + 7 AS micros FROM events")
def interval_arith(spark, sf_dir):
    made = "named_struct('months', CAST({} AS INT), 'days', CAST({} AS INT), 'micros', CAST({} AS BIGINT))".format
    plan = _with(spark, sf_dir, "events", a=made("user_id % 12", "user_id % 30", "event_id"), b=made(2, -2, 3), c=made(-1, 3, -4))
    plan = plan.project(plan["event_id"], interval_sub(interval_add(plan["a"], plan["b"]), plan["c"]).alias("v"))
    frame = plan.dataframe()
    return dataframe(frame.select("event_id", "v.months", "v.days", "v.micros"))


# Comparison


def _filter_query(name: str, sql: str, table: str, columns: tuple[str, ...], make: Callable[[Plan], Expr], logical: dict[str, t.LogicalType] | None = None, **derived: str) -> None:
    def f(spark, sf_dir):
        plan = _with(spark, sf_dir, table, logical, **derived)
        kept = plan.filter(make(plan))
        return kept.project(*[kept[c] for c in columns])

    f.__name__ = name
    query(f"SELECT {', '.join(columns)} FROM {table} WHERE {sql}")(f)


_LINE = ("l_orderkey", "l_linenumber")
for _name, _op, _sql in (("eq", "==", "="), ("ne", "!=", "<>"), ("lt", "<", "<"), ("le", "<=", "<="), ("gt", ">", ">"), ("ge", ">=", ">=")):
    _filter_query(
        f"cmp_{_name}", f"l_linenumber {_sql} 4 AND l_quantity {_sql} 25.0 OR l_returnflag {_sql} 'N'", "lineitem", _LINE,
        lambda p, op=_op: or_(and_(compare(p["l_linenumber"], op, _int(4)), compare(p["l_quantity"], op, const(25.0, t.F64))), compare(p["l_returnflag"], op, const("N", t.VARCHAR))),
    )
_filter_query("cmp_columns", "o_orderkey < o_custkey", "orders", ("o_orderkey", "o_custkey"), lambda p: compare(p["o_orderkey"], "<", p["o_custkey"]))
_filter_query("cmp_scalar_left", "4 <= l_linenumber", "lineitem", _LINE, lambda p: compare(_int(4), "<=", p["l_linenumber"]))
_filter_query("cmp_string_order", "c_name < 'Customer#000000500'", "customer", ("c_custkey", "c_name"), lambda p: compare(p["c_name"], "<", const("Customer#000000500", t.VARCHAR)))
_filter_query("cmp_bool", "(toxic = 1) >= (quality = 1)", "labels", ("doc_id",), lambda p: compare(p["t"], ">=", p["q"]), t="toxic = 1", q="quality = 1")
_filter_query("cmp_binary", "encode(c_mktsegment) > encode(c_name)", "customer", ("c_custkey",), lambda p: compare(p["a"], ">", p["b"]), a="CAST(c_mktsegment AS BINARY)", b="CAST(c_name AS BINARY)")
_filter_query("cmp_timestamp", "o_orderdate >= TIMESTAMP '1997-01-01'", "orders", ("o_orderkey", "o_orderdate"), lambda p: compare(p["o_orderdate"], ">=", p["y"]), y="TIMESTAMP_NTZ'1997-01-01 00:00:00'")
_filter_query(
    "cmp_timestamp_units", "epoch_us(ts) * 1000 < epoch_us(TIMESTAMP '2024-01-10') * 1000 + 500", "events", ("event_id",),
    lambda p: compare(p["ts"], "<", p["ns"]), {"ns": t.timestamp("ns")}, ns="unix_micros(TIMESTAMP'2024-01-10 00:00:00Z') * 1000 + 500",
)
_filter_query("cmp_date", "o_orderdate::DATE = DATE '1996-01-02' OR o_orderdate::DATE > DATE '1998-01-01'", "orders", ("o_orderkey",), lambda p: or_(compare(p["d"], "==", p["x"]), compare(p["d"], ">", p["y"])), d="CAST(o_orderdate AS DATE)", x="DATE'1996-01-02'", y="DATE'1998-01-01'")
_filter_query("cmp_null", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END > 700", "orders", ("o_orderkey",), lambda p: compare(p["n"], ">", const(700, t.I64)), n="CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END")
_filter_query("cmp_all_rows_pass", "l_quantity >= 0", "lineitem", _LINE, lambda p: compare(p["l_quantity"], ">=", const(0.0, t.F64)))
_filter_query("cmp_no_row_passes", "l_quantity < 0", "lineitem", _LINE, lambda p: compare(p["l_quantity"], "<", const(0.0, t.F64)))
_filter_query("cmp_nan", "CASE WHEN l_linenumber = 2 THEN 'NaN'::DOUBLE ELSE l_quantity END >= 'NaN'::DOUBLE", "lineitem", _LINE, lambda p: compare(p["x"], ">=", const(float("nan"), t.F64)), x="CASE WHEN l_linenumber = 2 THEN double('NaN') ELSE l_quantity END")


# Booleans


_NULL_KEY = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 3 = 0 END"


@query("SELECT o_orderkey, o_totalprice > 100000.0 AS big, o_orderpriority = '1-URGENT' AS urgent FROM orders")
def bool_project(spark, sf_dir):
    plan = _table(spark, sf_dir, "orders")
    return plan.project(plan["o_orderkey"], compare(plan["o_totalprice"], ">", const(100000.0, t.F64)).alias("big"), compare(plan["o_orderpriority"], "==", const("1-URGENT", t.VARCHAR)).alias("urgent"))


@query(f"""SELECT o_orderkey, {_NULL_KEY} AS as_field, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END > 500, false) AS as_expression,
    coalesce(NOT ({_NULL_KEY}), false) AS negated FROM orders""")
def bool_project_nulls(spark, sf_dir):
    plan = _with(spark, sf_dir, "orders", b=_NULL_KEY, n="CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END")
    return plan.project(plan["o_orderkey"], plan["b"].alias("as_field"), compare(plan["n"], ">", const(500, t.I64)).alias("as_expression"), not_(plan["b"]).alias("negated"))


@query(f"""SELECT o_orderkey, CASE WHEN b IS NOT NULL THEN b AND c END AS both_, CASE WHEN b IS NOT NULL THEN b OR c END AS either_, b <> c AS one_
    FROM (SELECT o_orderkey, {_NULL_KEY} AS b, o_orderkey % 2 = 0 AS c FROM orders)""")
def bool_array_kernels(spark, sf_dir):
    plan = _with(spark, sf_dir, "orders", b=_NULL_KEY, c="o_orderkey % 2 = 0")
    b, c = plan["b"], plan["c"]
    return plan.project(plan["o_orderkey"], array_and(b, c).alias("both_"), array_or(b, c).alias("either_"), array_xor(b, c).alias("one_"))


@query(f"SELECT o_orderkey, NOT b AS not_, b AND CASE WHEN b IS NOT NULL THEN true END AS and_true, CASE WHEN b IS NOT NULL THEN b AND false END AS and_false, CASE WHEN b IS NOT NULL THEN b OR true END AS or_true FROM (SELECT o_orderkey, {_NULL_KEY} AS b FROM orders)")
def bool_scalar_kernels(spark, sf_dir):
    plan = _with(spark, sf_dir, "orders", b=_NULL_KEY)
    b = plan["b"]
    return plan.project(plan["o_orderkey"], array_not(b).alias("not_"), array_and_scalar(b, True).alias("and_true"), array_and_scalar(b, False).alias("and_false"), array_or_scalar(b, True).alias("or_true"))


_ORDER = ("o_orderkey",)
_PRICE = lambda p: compare(p["o_totalprice"], ">", const(100000.0, t.F64))
_filter_query("and_conj", "o_totalprice > 100000.0 AND o_orderstatus = 'F' AND o_custkey > 100", "orders", _ORDER, lambda p: and_(_PRICE(p), compare(p["o_orderstatus"], "==", const("F", t.VARCHAR)), compare(p["o_custkey"], ">", const(100, t.I64))))
_filter_query("or_conj", "o_totalprice > 100000.0 OR o_orderstatus = 'F' OR o_custkey > 100", "orders", _ORDER, lambda p: or_(_PRICE(p), compare(p["o_orderstatus"], "==", const("F", t.VARCHAR)), compare(p["o_custkey"], ">", const(100, t.I64))))
_filter_query("and_is_null", f"o_totalprice > 100000.0 AND {_NULL_KEY} IS NULL", "orders", _ORDER, lambda p: and_(_PRICE(p), is_null(p["b"])), b=_NULL_KEY)
_filter_query("and_or_nulls", f"({_NULL_KEY}) AND o_totalprice > 100000.0 OR NOT ({_NULL_KEY}) AND o_custkey > 700", "orders", _ORDER, lambda p: or_(and_(p["b"], _PRICE(p)), and_(not_(p["b"]), compare(p["o_custkey"], ">", const(700, t.I64)))), b=_NULL_KEY)
_filter_query("not_field", f"NOT ({_NULL_KEY})", "orders", _ORDER, lambda p: not_(p["b"]), b=_NULL_KEY)
_filter_query("not_compare", "NOT (o_totalprice > 100000.0) AND NOT (o_orderstatus < 'O')", "orders", _ORDER, lambda p: and_(not_(_PRICE(p)), not_(compare(p["o_orderstatus"], "<", const("O", t.VARCHAR)))))
_filter_query("is_null_field", f"({_NULL_KEY}) IS NULL", "orders", _ORDER, lambda p: is_null(p["b"]), b=_NULL_KEY)
_filter_query("is_not_null_field", f"({_NULL_KEY}) IS NOT NULL", "orders", _ORDER, lambda p: is_not_null(p["b"]), b=_NULL_KEY)

_TEXT = "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE text END"
_filter_query("regex_match_cs", f"regexp_matches({_TEXT}, 'th[ae]n? [a-z]+ing')", "documents", ("doc_id",), lambda p: regex_match(p["x"], "th[ae]n? [a-z]+ing"), x=_TEXT)
_filter_query("regex_match_ci", f"regexp_matches({_TEXT}, '^th.*ÜBER|étre', 'i')", "documents", ("doc_id",), lambda p: regex_match(p["x"], "^th.*ÜBER|étre", ignore_case=True), x=_TEXT)
_filter_query("regex_not", f"NOT regexp_matches({_TEXT}, '[0-9]{{4}}')", "documents", ("doc_id",), lambda p: regex_match(p["x"], "[0-9]{4}", negated=True), x=_TEXT)
_filter_query("regex_not_ci", f"NOT regexp_matches({_TEXT}, 'ERSCH|THAT', 'i')", "documents", ("doc_id",), lambda p: regex_match(p["x"], "ERSCH|THAT", negated=True, ignore_case=True), x=_TEXT)


@query(f"SELECT doc_id, coalesce(regexp_matches({_TEXT}, 'token'), false) AS found, coalesce(NOT regexp_matches({_TEXT}, 'token'), false) AS missed FROM documents")
def regex_project(spark, sf_dir):
    plan = _with(spark, sf_dir, "documents", x=_TEXT)
    return plan.project(plan["doc_id"], regex_match(plan["x"], "token").alias("found"), regex_match(plan["x"], "token", negated=True).alias("missed"))


# Union and limit


@query("SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def union_all(spark, sf_dir):
    c, s = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "supplier")
    return c.project(c["c_name"].alias("name"), c["c_nationkey"].alias("nation")).union(s.project(s["s_name"], s["s_nationkey"]))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def union_three(spark, sf_dir):
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    names = n.project(n["n_name"].alias("name"))
    return names.union(r.project(r["r_name"])).union(names)


@query("SELECT nation, count(*) AS parties FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY nation")
def union_then_group(spark, sf_dir):
    c, s = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "supplier")
    both = c.project(c["c_nationkey"].alias("nation")).union(s.project(s["s_nationkey"]))
    return both.group_by(both[0])(count_star().alias("parties"))


@query("SELECT count(*) AS rows FROM customer UNION ALL SELECT count(*) FROM supplier")
def union_of_aggregates(spark, sf_dir):
    return _table(spark, sf_dir, "customer").aggregate(count_star().alias("rows")).union(_table(spark, sf_dir, "supplier").aggregate(count_star().alias("rows")))


@query("SELECT count(*) AS rows FROM (SELECT * FROM orders LIMIT 4)")
def limit_count(spark, sf_dir):
    return _table(spark, sf_dir, "orders").limit(4).aggregate(count_star().alias("rows"))


@query("SELECT count(*) AS rows FROM (SELECT * FROM orders LIMIT 4 OFFSET 3)")
def limit_offset_count(spark, sf_dir):
    return _table(spark, sf_dir, "orders").limit(4, 3).aggregate(count_star().alias("rows"))


@query("SELECT count(*) AS rows FROM (SELECT * FROM region LIMIT 10 OFFSET 3)")
def limit_beyond_end(spark, sf_dir):
    return _table(spark, sf_dir, "region").limit(10, 3).aggregate(count_star().alias("rows"))


@query("SELECT count(*) AS rows FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region LIMIT 28 OFFSET 5)")
def limit_over_union(spark, sf_dir):
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    return n.project(n["n_name"]).union(r.project(r["r_name"])).limit(28, 5).aggregate(count_star().alias("rows"))


# Aggregation


@query("""SELECT count(l_orderkey) AS n, count(*) AS rows, min(l_orderkey) AS least, max(l_orderkey) AS most, sum(l_partkey)::BIGINT AS total,
    sum(l_linenumber)::DOUBLE / count(l_linenumber) AS mean FROM lineitem""")
def agg_global(spark, sf_dir):
    p = _table(spark, sf_dir, "lineitem")
    k = p["l_orderkey"]
    return p.aggregate(count(k).alias("n"), count_star().alias("rows"), min_(k).alias("least"), max_(k).alias("most"), sum_(p["l_partkey"]).alias("total"), avg(p["l_linenumber"]).alias("mean"))


@query(f"SELECT count(n) AS known, count(*) AS rows, min(n) AS least, max(n) AS most, sum(n)::BIGINT AS total, sum(n)::DOUBLE / count(n) AS mean FROM (SELECT {_NULLED} AS n FROM lineitem)")
def agg_nulls(spark, sf_dir):
    p = _lines(spark, sf_dir, n=_NULLED)
    n = p["n"]
    return p.aggregate(count(n).alias("known"), count_star().alias("rows"), min_(n).alias("least"), max_(n).alias("most"), sum_(n).alias("total"), avg(n).alias("mean"))


@query("SELECT count(l_orderkey) AS n, count(*) AS rows, max(l_orderkey) AS most, sum(l_partkey)::BIGINT AS total, avg(l_quantity) AS mean FROM lineitem WHERE l_quantity < 0")
def agg_empty(spark, sf_dir):
    p = _table(spark, sf_dir, "lineitem")
    p = p.filter(compare(p["l_quantity"], "<", const(0.0, t.F64)))
    return p.aggregate(count(p["l_orderkey"]).alias("n"), count_star().alias("rows"), max_(p["l_orderkey"]).alias("most"), sum_(p["l_partkey"]).alias("total"), avg(p["l_quantity"]).alias("mean"))


def _group_query(name: str, table: str, keys: str, sql_keys: str, **derived: str) -> None:
    names = [k.strip() for k in keys.split(",")]

    def f(spark, sf_dir):
        p = _with(spark, sf_dir, table, **derived)
        return p.group_by(*[p[k] for k in names])(count_star().alias("rows"))

    f.__name__ = name
    query(f"SELECT {sql_keys}, count(*) AS rows FROM {table} GROUP BY ALL")(f)


_group_query("group_single_key", "lineitem", "l_linenumber", "l_linenumber")
_group_query("group_multi_key", "lineitem", "l_linenumber, l_returnflag, l_linestatus", "l_linenumber, l_returnflag, l_linestatus")
_group_query("group_string_key", "customer", "c_mktsegment", "c_mktsegment")
_group_query("group_null_key", "lineitem", "n, l_returnflag", f"{_NULLED} AS n, l_returnflag", n=_NULLED)
_group_query(
    "group_float_key", "lineitem", "x", "CASE WHEN l_linenumber = 2 THEN 'NaN'::DOUBLE ELSE l_discount END AS x",
    x="CASE WHEN l_linenumber = 2 THEN double('NaN') WHEN l_discount = 0 THEN -0D ELSE l_discount END",
)
_group_query("group_bool_key", "orders", "b", f"{_NULL_KEY} AS b", b=_NULL_KEY)
_group_query("group_binary_key", "customer", "b", "encode(c_mktsegment) AS b", b="CAST(c_mktsegment AS BINARY)")
_group_query("group_date_key", "orders", "d", "o_orderdate::DATE AS d", d="CAST(o_orderdate AS DATE)")
_group_query("group_many_groups", "lineitem", "l_orderkey", "l_orderkey")


@query("SELECT c_mktsegment, min(c_name) AS first, max(c_name) AS last FROM customer GROUP BY c_mktsegment")
def agg_min_max_string(spark, sf_dir):
    p = _table(spark, sf_dir, "customer")
    return p.group_by(p["c_mktsegment"])(min_(p["c_name"]).alias("first"), max_(p["c_name"]).alias("last"))


@query("SELECT event_type, min(ts) AS first, max(ts) AS last FROM events GROUP BY event_type")
def agg_min_max_ts(spark, sf_dir):
    p = _table(spark, sf_dir, "events")
    return p.group_by(p["event_type"])(min_(p["ts"]).alias("first"), max_(p["ts"]).alias("last"))


@query("SELECT min(encode(c_name)) AS first, max(encode(c_name)) AS last FROM customer")
def agg_min_max_binary(spark, sf_dir):
    p = _with(spark, sf_dir, "customer", b="CAST(c_name AS BINARY)")
    return p.aggregate(min_(p["b"]).alias("first"), max_(p["b"]).alias("last"))


@query("SELECT min(toxic = 1) AS least, max(toxic = 1) AS most, min(DATE '2020-01-01' + quality) AS day FROM labels")
def agg_min_max_bool_date(spark, sf_dir):
    p = _with(spark, sf_dir, "labels", b="toxic = 1", d="date_add(DATE'2020-01-01', quality)")
    return p.aggregate(min_(p["b"]).alias("least"), max_(p["b"]).alias("most"), min_(p["d"]).alias("day"))


@query("SELECT o_orderpriority, sum(o_custkey % 250)::BIGINT AS total, max((o_custkey % 250)::SMALLINT) AS most FROM orders GROUP BY o_orderpriority")
def agg_sum_unsigned_widen(spark, sf_dir):
    p = _with(spark, sf_dir, "orders", {"b": t.U8}, b="CAST(o_custkey % 250 AS SMALLINT)")
    return p.group_by(p["o_orderpriority"])(sum_(p["b"]).alias("total"), max_(p["b"]).alias("most"))


@query("SELECT l_returnflag, sum(l_orderkey)::DOUBLE / count(l_orderkey) AS mean FROM lineitem GROUP BY l_returnflag")
def agg_avg_exact(spark, sf_dir):
    p = _table(spark, sf_dir, "lineitem")
    return p.group_by(p["l_returnflag"])(avg(p["l_orderkey"]).alias("mean"))


@query("SELECT sum((l_quantity)::FLOAT::DOUBLE) AS total, sum(l_quantity::FLOAT::DOUBLE) / count(*) AS mean FROM lineitem")
def agg_sum_float(spark, sf_dir):
    p = _lines(spark, sf_dir, q="CAST(l_quantity AS FLOAT)")
    return p.aggregate(sum_(p["q"]).alias("total"), avg(p["q"]).alias("mean"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS lines, sum(l_quantity) AS sum_qty, sum(l_quantity) / count(*) AS avg_qty, min(l_extendedprice) AS min_price,
    max(l_extendedprice) AS max_price FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' AND l_linenumber % 4 <> 0 GROUP BY l_returnflag, l_linestatus""")
def flagship_lineitem(spark, sf_dir):
    p = _lines(spark, sf_dir, last="TIMESTAMP_NTZ'1998-09-02 00:00:00'")
    p = p.filter(and_(compare(p["l_shipdate"], "<=", p["last"]), compare(arith(p["l_linenumber"], "%", _int(4)), "!=", _int(0))))
    q, price = p["l_quantity"], p["l_extendedprice"]
    return p.group_by(p["l_returnflag"], p["l_linestatus"])(
        count_star().alias("lines"), sum_(q).alias("sum_qty"), avg(q).alias("avg_qty"), min_(price).alias("min_price"), max_(price).alias("max_price")
    )


# What users add


@query("SELECT o_orderkey, substr(o_orderstatus, 1, 1) || '-' || o_orderkey AS tag, o_orderkey % 10 > 6 AS high FROM orders")
def custom_scalar_functions(spark, sf_dir):
    plan = _table(spark, sf_dir, "orders")
    tag = custom_scalar("tag", lambda s, k: F.concat(F.substring(s, 1, 1), F.lit("-"), k.cast("string")), lambda s, k: t.VARCHAR if s == t.VARCHAR and k == t.I64 else None)
    high = custom_scalar("high", lambda k: k % 10 > 6, t.BOOLEAN)
    return plan.project(plan["o_orderkey"], tag(plan["o_orderstatus"], plan["o_orderkey"]).alias("tag"), high(plan["o_orderkey"]).alias("high"))


@query("SELECT o_orderstatus, bit_xor(o_orderkey)::BIGINT AS mixed, count(DISTINCT o_custkey)::BIGINT AS customers FROM orders GROUP BY o_orderstatus")
def custom_aggregate_functions(spark, sf_dir):
    plan = _table(spark, sf_dir, "orders")
    mixed = custom_aggregate("bit_xor", F.bit_xor, lambda k: k if k == t.I64 else None)
    distinct = custom_aggregate("distinct", F.count_distinct, t.I64)
    return plan.group_by(plan["o_orderstatus"])(mixed(plan["o_orderkey"]).alias("mixed"), distinct(plan["o_custkey"]).alias("customers"))


@query("SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderkey)::INT AS place FROM orders")
def custom_operator(spark, sf_dir):
    plan = _table(spark, sf_dir, "orders")
    within = Window.partitionBy("o_orderstatus", "o_custkey").orderBy("o_orderkey")
    return plan.custom("RowNumber", lambda df: df.select("o_orderkey", "o_orderstatus", F.row_number().over(within).alias("place")))


class Squares(DataSource):
    """n, n * n for n in [0, count), in four partitions: how a source of one's own looks."""

    @classmethod
    def name(cls) -> str:
        return "squares"

    def schema(self) -> str:
        return "n bigint, square bigint"

    def reader(self, schema) -> DataSourceReader:
        count = int(self.options["count"])

        class Reader(DataSourceReader):
            def partitions(self):
                return [InputPartition((k * count // 4, (k + 1) * count // 4)) for k in range(4)]

            def read(self, partition):
                yield from ((n, n * n) for n in range(*partition.value))

        return Reader()


@query("SELECT range AS n, range * range AS square FROM range(1000) WHERE range % 3 <> 0")
def custom_source_scan(spark, sf_dir):
    plan = custom_source(spark, Squares, {"count": 1000})
    return plan.filter(compare(arith(plan["n"], "%", const(3, t.I64)), "!=", const(0, t.I64)))

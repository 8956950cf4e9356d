"""Fixtures with known results, edge cases, and the errors that constructors raise."""

import math

import pytest

from millrace import errors as e
from millrace import types as t
from millrace.functions import (
    Options,
    and_,
    arith,
    avg,
    compare,
    const,
    count,
    count_star,
    is_not_null,
    is_null,
    max_,
    min_,
    not_,
    or_,
    regex_match,
    sum_,
)
from millrace.sources import dataframe, empty, memory, numbers

N = None
STRICT = Options(strict=True)


def one(spark, values, of, *more):
    """A plan of columns c0, c1, ... of (values, type) pairs."""
    pairs = [(values, of), *more]
    return memory(spark, [[v for v, _ in pairs]], {f"c{i}": k for i, (_, k) in enumerate(pairs)})


def values(plan):
    return [tuple(r) for r in plan.dataframe().collect()]


def column(plan):
    return [r[0] for r in plan.dataframe().collect()]


def selected(plan, predicate):
    return column(plan.project(predicate))


def ordered(rows):
    return sorted(rows, key=repr)


# Aggregation


def test_group_by_two_nullable_keys(spark):
    block = [[-1, -1, 3, N, 7, N, 3, N], [-0.0, 0.0, N, -7.7, 3.0, N, N, N], [-1, 2, -9, 7, -2, N, -7, -7]]
    p = memory(spark, [block], {"f0": t.I32, "f1": t.F32, "f2": t.I64})
    p = p.union(p)
    got = values(p.group_by(p[0], p[1])(count_star(), sum_(p[2])))
    rounded = {(a, N if b is N else round(b, 4), c, d) for a, b, c, d in got}
    assert rounded == {(7, 3.0, 2, -4), (N, N, 4, -14), (N, -7.7, 2, 14), (-1, 0.0, 4, 2), (3, N, 4, -32)}


def test_group_by_small_integers(spark):
    p = one(spark, [-1, 2, -1, N, N], t.I8, ([-1, 7, -1, N, N], t.I8), ([-4, N, -3, 1, 5], t.I64))
    p = p.union(p)
    assert ordered(r[2:] for r in values(p.group_by(p[0], p[1])(count_star(), sum_(p[2])))) == ordered([(4, -14), (2, N), (4, 12)])


def test_partial_tables_merge(spark):
    p = memory(spark, [[[0, 1, 4, 5], [-1, 4, 6, 9]], [[1, 2, 3, 4], [7, -9, -3, -2]]], {"k": t.I32, "v": t.I64})
    assert ordered(values(p.group_by(p[0])(count_star(), min_(p[1])))) == [(0, 1, -1), (1, 2, 4), (2, 1, -9), (3, 1, -3), (4, 2, -2), (5, 1, 9)]


def test_global_aggregate_is_one_row(spark):
    p = one(spark, [-10, N, N], t.I32, (["river", "rill", N], t.VARCHAR))
    assert values(p.aggregate(count(p[0]), min_(p[1]))) == [(1, "rill")]
    none = empty(spark, {"x": t.I32})
    x = none["x"]
    assert values(none.aggregate(count(x), count_star(), min_(x), max_(x), sum_(x), avg(x))) == [(0, 0, N, N, N, N)]
    assert values(none.group_by(x)(count_star())) == []


def test_mixed_keys_with_strings_and_bytes(spark):
    p = one(
        spark, [-3, -100, N, -100, 10], t.I32, ([N, N, 100, N, -4], t.I16), (["", "Morsels", "river", "Morsels", N], t.VARCHAR),
        ([b"\x01", b"\x05\x06\x07", N, b"\x05\x06\x07", b"\x01\x02\x03\x04"], t.VARBINARY),
    )
    assert sorted(r[-1] for r in values(p.group_by(*[p[i] for i in range(4)])(count_star()))) == [1, 1, 1, 2]


def test_nan_is_one_group_and_zeros_are_one(spark):
    p = one(spark, [N, math.nan, -0.0, 0.0, math.nan, N], t.F64)
    assert sorted((r[1] for r in values(p.group_by(p[0])(count_star())))) == [2, 2, 2]


def test_avg_and_sum(spark):
    p = one(spark, [10, 20, 20, N], t.I32)
    assert values(p.aggregate(avg(p[0]), sum_(p[0]), count(p[0]))) == [(50 / 3, 50, 3)]
    p = one(spark, [10.0, N, -100.99], t.F64)
    assert values(p.aggregate(sum_(p[0])))[0][0] == pytest.approx(-90.99)


def test_sum_overflow_is_an_error_or_wraps(spark):
    p = one(spark, [(1 << 63) - 1, 1], t.I64)
    with pytest.raises(Exception, match="(?i)overflow"):
        values(p.aggregate(sum_(p[0])))
    assert values(p.aggregate(sum_(p[0], Options(overflow="wrap")))) == [(-(1 << 63),)]
    from decimal import Decimal

    u = one(spark, [Decimal((1 << 64) - 1), Decimal(2)], t.U64)
    with pytest.raises(Exception, match="(?i)overflow"):
        values(u.aggregate(sum_(u[0])))
    assert values(u.aggregate(sum_(u[0], Options(overflow="wrap")))) == [(1,)]


def test_aggregates_of_constants_count_every_row(spark):
    p = one(spark, [1, 2, 3], t.I32)
    assert values(p.aggregate(sum_(const(5, t.I32)), count(const(N, t.I32)))) == [(15, 0)]


def test_min_max_of_every_ordered_type(spark):
    p = one(spark, ["lake", "brook is long", "river runs"], t.VARCHAR)
    assert values(p.aggregate(min_(p[0]), max_(p[0]))) == [("brook is long", "river runs")]
    p = one(spark, [{"months": 1, "days": 0, "micros": 0}, {"months": 0, "days": 40, "micros": 0}], t.INTERVAL)
    assert values(p.aggregate(min_(p[0])))[0][0].days == 40


# Sources, union and limit


def test_numbers(spark):
    n = 3 * 128 * 4096
    p = numbers(spark, 0, n, partitions=2)
    assert values(p.aggregate(sum_(p[0]), count_star())) == [(n * (n - 1) // 2, n)]
    assert [int(x) for x in column(numbers(spark, (1 << 64) - 3, 10))] == [(1 << 64) - 3, (1 << 64) - 2]


def test_memory_is_read_again_and_again(spark):
    p = memory(spark, [[[1]]] * 16, {"x": t.I32})
    for _ in range(2):
        assert values(p.aggregate(sum_(p[0]))) == [(16,)]


def test_limit_with_offset(spark):
    p = memory(spark, [[[1, 2]]] * 5, {"x": t.I32})
    assert len(values(p.limit(4, 3))) == 4
    assert len(values(p.limit(4, 8))) == 2
    assert values(p.limit(1, 10)) == []
    assert len(values(p.limit(1 << 40, 3))) == 7
    assert len(values(p.union(p).limit(15, 2))) == 15


def test_union_keeps_repeats_and_order_of_columns(spark):
    a, b = one(spark, [1, N], t.I32), one(spark, [1], t.I32)
    assert ordered(column(a.union(b, b))) == ordered([1, N, 1, 1])
    # Unsigned integers in longs and in decimals are one type.
    assert len(column(numbers(spark, 0, 2).union(numbers(spark, 1 << 63, 2)))) == 4


# Arithmetic


def calc(spark, a, op, b, of, of_b=None, options=Options()):
    p = one(spark, [a], of, ([b], of_b or of))
    return column(p.project(arith(p[0], op, p[1], options)))[0]


def test_arithmetic_kernels(spark):
    p = one(spark, [10, -7, -3, -9, -20, 87, 100, 34, 65], t.I32)
    x = p[0]
    assert column(p.project(arith(x, "+", const(1, t.I32)))) == [11, -6, -2, -8, -19, 88, 101, 35, 66]
    assert column(p.project(arith(x, "/", const(-2, t.I32)))) == [-5, 3, 1, 4, 10, -43, -50, -17, -32]
    assert column(p.project(arith(x, "%", const(-3, t.I32)))) == [1, -1, 0, 0, -2, 0, 1, 1, 2]
    assert column(p.project(arith(const(5, t.I32), "-", x)))[:2] == [-5, 12]
    assert column(p.project(arith(x, "+", const(N, t.I32)))) == [N] * 9
    assert calc(spark, 1, "+", N, t.I32) is N and calc(spark, -4, "+", 8, t.I32) == 4


@pytest.mark.parametrize(("of", "low", "high"), [(t.I8, -128, 127), (t.I16, -(1 << 15), (1 << 15) - 1), (t.I32, -(1 << 31), (1 << 31) - 1), (t.I64, -(1 << 63), (1 << 63) - 1)])
def test_signed_overflow(spark, of, low, high):
    wrap, bits = Options(overflow="wrap"), high - low + 1
    wrapped = lambda v: (v - low) % bits + low
    with pytest.raises(Exception, match="(?i)overflow"):
        calc(spark, high, "+", 1, of)
    assert calc(spark, high, "+", 1, of, options=wrap) == low
    assert calc(spark, low, "-", 1, of, options=wrap) == high
    for a, b in ((high, high), (low, low), (low, -1), (high, 3)):
        assert calc(spark, a, "*", b, of, options=wrap) == wrapped(a * b)
    assert calc(spark, low, "/", -1, of, options=wrap) == low


@pytest.mark.parametrize(("of", "bits"), [(t.U8, 8), (t.U16, 16), (t.U32, 32), (t.U64, 64)])
def test_unsigned_overflow(spark, of, bits):
    from decimal import Decimal

    to = Decimal if of == t.U64 else int
    top, wrap = (1 << bits) - 1, Options(overflow="wrap")
    for op, a, b in (("+", top, 1), ("-", 0, 1), ("*", top, top)):
        with pytest.raises(Exception, match="(?i)overflow|out.of.range"):
            calc(spark, to(a), op, to(b), of)
        exact = {"+": a + b, "-": a - b, "*": a * b}[op]
        assert calc(spark, to(a), op, to(b), of, options=wrap) == exact % (1 << bits)
    assert calc(spark, to(top), "/", to(2), of) == top // 2
    assert calc(spark, to(top), "%", to(7), of) == top % 7
    assert calc(spark, to(top), "+", to(0), of) == top


def test_float_division_by_zero(spark):
    assert calc(spark, 1.0, "/", 0.0, t.F64) == math.inf and calc(spark, -1.0, "/", 0.0, t.F64) == -math.inf
    assert calc(spark, 1.0, "/", -0.0, t.F64) == -math.inf
    assert math.isnan(calc(spark, 0.0, "/", 0.0, t.F64)) and math.isnan(calc(spark, 5.0, "%", 0.0, t.F64))
    assert calc(spark, N, "/", 0.0, t.F64) is N and calc(spark, 7.5, "%", 2.0, t.F64) == 1.5


def test_integer_division_by_zero_and_null_divisor(spark):
    with pytest.raises(Exception, match="(?i)zero"):
        calc(spark, 1, "/", 0, t.I32)
    assert calc(spark, 1, "/", N, t.I32) is N and calc(spark, 1, "%", N, t.I64, t.I32) is N


def test_remainder_has_the_divisors_type():
    for wide, narrow in ((t.I64, t.I8), (t.I32, t.I16), (t.U64, t.U8)):
        assert t.arith_result("%", wide, narrow) == narrow
        with pytest.raises(e.UnsupportedInputs):
            t.arith_result("%", narrow, wide)
    with pytest.raises(e.UnsupportedInputs):
        t.arith_result("+", t.I64, t.I32)
    with pytest.raises(e.UnsupportedInputs):
        t.arith_result("+", t.VARCHAR, t.VARCHAR)


def test_durations_of_all_units(spark):
    from datetime import datetime

    a, b = datetime(2024, 1, 2, 0, 0, 1), datetime(2024, 1, 1)
    for unit, n in (("s", 86401), ("ms", 86401 * 10**3), ("us", 86401 * 10**6)):
        p = one(spark, [a], t.timestamp(unit), ([b], t.timestamp(unit)))
        made = arith(p[0], "-", p[1])
        assert made.type == t.duration(unit) and column(p.project(made)) == [n]
    assert calc(spark, 10**18 + 5, "-", 10**18, t.timestamp("ns")) == 5
    with pytest.raises(e.UnsupportedInputs):
        t.arith_result("-", t.timestamp("us"), t.timestamp("ms"))


# Booleans


def test_and_or_not(spark):
    p = one(spark, [True, False, True, False, N, True], t.BOOLEAN, ([True, True, True, False, N, N], t.BOOLEAN), (["abc", "hi", "h", "haha", "yes", "wtf"], t.VARCHAR))
    assert selected(p, and_(p[0], p[1], regex_match(p[2], "hi?"))) == [False, False, True, False, False, False]
    q = one(spark, [False, N, True], t.BOOLEAN, (["hi", "conjunction", "haha"], t.VARCHAR))
    assert selected(q, or_(q[0], regex_match(q[1], "hi?"))) == [True, False, True]
    r = one(spark, [True, N, False, N, N, True, True, False, False], t.BOOLEAN)
    assert selected(r, not_(r[0])) == [False, False, True, False, False, False, False, True, True]


def test_null_tests_under_and(spark):
    p = one(spark, [-1, N, 100, N], t.I32)
    assert selected(p, is_null(p[0])) == [False, True, False, True]
    assert selected(p, is_not_null(p[0])) == [True, False, True, False]
    q = one(spark, [True, False, True, False], t.BOOLEAN, ([-1, N, N, 3], t.I32))
    assert selected(q, and_(q[0], is_null(q[1]))) == [False, False, True, False]


def test_not_over_comparisons(spark):
    p = one(spark, [1, 5, N], t.I32, (["a", "b", N], t.VARCHAR))
    assert selected(p, not_(compare(p[0], ">", const(3, t.I32)))) == [True, False, False]
    assert selected(p, not_(compare(p[1], "==", const("b", t.VARCHAR)))) == [True, False, False]
    assert column(p.filter(not_(compare(p[0], ">", const(3, t.I32)))).project(p[0])) == [1]


def test_regex(spark):
    p = one(spark, [N, "Regex expression", "HaHa", "HAHA"], t.VARCHAR)
    assert selected(p, regex_match(p[0], ".a")) == [False, False, True, False]
    assert selected(p, regex_match(p[0], ".a", negated=True)) == [False, True, False, True]
    assert selected(p, regex_match(p[0], ".a", ignore_case=True)) == [False, False, True, True]
    assert selected(p, regex_match(p[0], ".a", negated=True, ignore_case=True)) == [False, True, False, False]
    q = one(spark, ["ÄPFEL"], t.VARCHAR)
    assert selected(q, regex_match(q[0], "äpfel", ignore_case=True)) == [True]


def test_projected_field_keeps_nulls(spark):
    p = one(spark, [False, N, True, N], t.BOOLEAN, (["yes", "no", "expr", "executor"], t.VARCHAR), ([-1, 2, N, N], t.I32))
    assert values(p.project(p[0], regex_match(p[1], ".s"), p[2])) == [(False, True, -1), (N, False, 2), (True, False, N), (N, False, N)]


# Comparison

SAMPLES = [
    (t.BOOLEAN, False, True), (t.I8, -1, 3), (t.I16, -1, 3), (t.I32, -1, 3), (t.I64, -1, 3), (t.U8, 1, 3), (t.U16, 1, 3), (t.U32, 1, 3),
    (t.F32, -1.5, 2.5), (t.F64, -1.5, 2.5), (t.VARCHAR, "a", "b"), (t.VARBINARY, b"\x01", b"\xff"), (t.TIME, 5, 6), (t.timestamp("ns"), 5, 6),
]


@pytest.mark.parametrize(("of", "low", "high"), SAMPLES, ids=lambda x: str(x))
def test_comparison_grid(spark, of, low, high):
    p = one(spark, [low, low, high, N, low], of, ([low, high, low, low, N], of))
    wanted = {"==": "T--", "!=": "-TT", "<": "-T-", "<=": "TT-", ">": "--T", ">=": "T-T"}
    for op, marks in wanted.items():
        assert selected(p, compare(p[0], op, p[1])) == [m == "T" for m in marks] + [False, False], op
        assert len(values(p.filter(compare(p[0], op, p[1])))) == marks.count("T")


def test_timestamps_of_different_units(spark):
    from datetime import datetime

    at = datetime(2024, 1, 1)
    ns = 1704067200 * 10**9
    p = one(spark, [at, at, at], t.timestamp("us"), ([ns, ns + 1, ns - 1], t.timestamp("ns")))
    assert selected(p, compare(p[0], "==", p[1])) == [True, False, False]
    assert selected(p, compare(p[1], ">", p[0])) == [False, True, False]
    assert selected(p, compare(p[0], "<=", p[1])) == [True, True, False]
    far = one(spark, [datetime(9999, 1, 1)], t.timestamp("s"), ([ns], t.timestamp("ns")))
    assert selected(far, compare(far[0], ">", far[1])) == [True]


def test_nan_comparisons(spark):
    p = one(spark, [math.nan, 1.0], t.F64, ([math.nan, math.nan], t.F64))
    assert selected(p, compare(p[0], "==", p[1])) == [True, False]
    for op in ("==", "!=", "<", ">", "<=", ">="):
        assert selected(p, compare(p[0], op, p[1], Options(ieee_nan=True))) == [False, False]


def test_comparison_types():
    for pair in ((t.I32, t.I64), (t.I32, t.VARCHAR), (t.DATE, t.timestamp("us")), (t.INTERVAL, t.INTERVAL), (t.decimal(5, 2), t.decimal(5, 2)), (t.list_of(t.I32), t.list_of(t.I32))):
        with pytest.raises(e.UnsupportedInputs):
            t.check_comparison("==", *pair)
    for kind in (t.UUID, t.IPV4, t.IPV6):
        t.check_comparison("!=", kind, kind)
        with pytest.raises(e.UnsupportedInputs):
            t.check_comparison("<", kind, kind)
    t.check_comparison("<", t.TIME, t.TIMETZ)
    t.check_comparison(">", t.timestamp("s"), t.TIMESTAMPTZ)


# Errors


def test_constructor_errors(spark):
    p = one(spark, [True], t.BOOLEAN, ([1], t.I32), (["a"], t.VARCHAR))
    b, i, s, k = p[0], p[1], p[2], const(1, t.I32)
    yes = const(True, t.BOOLEAN)
    for error, make in (
        (e.TwoConstants, lambda: arith(k, "+", k, STRICT)),
        (e.TwoConstants, lambda: compare(k, "<", k, STRICT)),
        (e.TooFewInputs, lambda: and_(b)),
        (e.NotBoolean, lambda: or_(b, i)),
        (e.NotFlattened, lambda: and_(and_(b, b), b, options=STRICT)),
        (e.ConstantInput, lambda: or_(b, yes, options=STRICT)),
        (e.NotBoolean, lambda: not_(i)),
        (e.ConstantInput, lambda: not_(yes, STRICT)),
        (e.BooleanExpression, lambda: is_null(compare(i, "<", k))),
        (e.ConstantInput, lambda: is_null(k, STRICT)),
        (e.UnsupportedInputs, lambda: regex_match(i, "a")),
        (e.InvalidPattern, lambda: regex_match(s, "(")),
        (e.InvalidPattern, lambda: regex_match(s, "(?=a)b")),
        (e.InvalidPattern, lambda: regex_match(s, r"(a)\1")),
        (e.InvalidPredicate, lambda: p.filter(i)),
        (e.ConstantPredicate, lambda: p.filter(yes, STRICT)),
        (e.UnionInputs, lambda: p.union(one(spark, [1], t.I32))),
        (e.UnionInputs, lambda: one(spark, [1], t.I64).union(one(spark, [1], t.I32))),
        (e.LimitOutOfRange, lambda: p.limit(0)),
        (e.LimitOutOfRange, lambda: p.limit(1, -1)),
        (e.LimitOutOfRange, lambda: p.limit(1 << 63, 1 << 63)),
        (e.EmptyProjection, lambda: p.project()),
        (e.EmptyGroupKeys, lambda: p.group_by()(count_star())),
        (e.EmptyAggregates, lambda: p.aggregate()),
        (e.NotAField, lambda: p.aggregate(count(k), options=STRICT)),
        (e.NotAField, lambda: p.group_by(k)(count_star(), options=STRICT)),
        (e.ArgumentMismatch, lambda: sum_(s)),
        (e.ArgumentMismatch, lambda: avg(b)),
        (e.ArgumentMismatch, lambda: min_(const(1.0, t.F64), STRICT)),
        (e.FieldOutOfRange, lambda: p[9]),
        (e.FieldOutOfRange, lambda: p["missing"]),
        (e.FieldOutOfRange, lambda: one(spark, [1], t.I32).project(p[2])),
        (e.FieldTypeMismatch, lambda: one(spark, [1], t.I32).project(b)),
        (e.EmptyMemoryTable, lambda: memory(spark, [], {"x": t.I32})),
        (e.BlocksMismatch, lambda: memory(spark, [[[1], [2]]], {"x": t.I32})),
        (e.BlocksMismatch, lambda: memory(spark, [[["a"]]], {"x": t.I32})),
        (e.InvalidRange, lambda: numbers(spark, 0, 0)),
        (e.InvalidRange, lambda: numbers(spark, -1, 5)),
        (e.InvalidConstant, lambda: const(300, t.U8)),
        (e.InvalidConstant, lambda: const("x", t.I32)),
    ):
        with pytest.raises(error):
            make()


# Plans and control


def test_plan_display_and_explain(spark):
    p = numbers(spark, 0, 100, partitions=4)
    q = p.filter(compare(p[0], ">", const(5, t.U64_NARROW)))
    q = q.union(q).aggregate(count_star().alias("n"))
    assert q.tree().split("\n")[0] == "Aggregate[n]" and "└── Filter[number > 5]" in q.tree()
    text = q.explain()
    assert "HashAggregate" in text and "Union" in text and "Exchange" in text
    seen = []
    q.visit(lambda x: seen.append(x.node) or True)
    assert len(seen) == 6
    box = one(spark, [10, N, -1], t.I32, ([N, -1.0, 9.5], t.F64)).show()
    assert "Null" in box and "i32" in box and "f64" in box


def test_filters_and_columns_reach_the_files(spark, tmp_path):
    from millrace.sources import parquet

    spark.range(100).selectExpr("id AS a", "id * 2 AS b", "id * 3 AS c").write.parquet(str(tmp_path / "t"))
    p = parquet(spark, str(tmp_path / "t"))
    text = p.filter(compare(p["a"], ">", const(90, t.I64))).project(p["b"]).explain()
    assert "PushedFilters: [IsNotNull(a), GreaterThan(a,90)]" in text and "c:bigint" not in text


def test_query_runs_in_batches_and_is_cancelled(spark):
    from millrace.plans.control import Query, metrics, observed

    got = []
    q = Query(numbers(spark, 0, 10_000)).start(got.extend, size=1000).wait(60)
    assert q.rows == len(got) == 10_000 and q.batches == 10 and q.progress() == 1.0
    slow = Query(numbers(spark, 0, 1 << 40, partitions=64).aggregate(count_star()).union(numbers(spark, 0, 1 << 40, partitions=64).filter(compare(numbers(spark, 0, 1)[0], "<", const(0, t.U64_NARROW)))))
    slow.start(lambda _: None)
    import time

    time.sleep(1)
    slow.cancel()
    with pytest.raises(e.QueryCancelled):
        slow.wait(60)
    plan, seen = observed(numbers(spark, 0, 500))
    frame = plan.dataframe()
    assert frame.count() == 500 and seen.get["rows"] == 500
    p = numbers(spark, 0, 1000)
    done = p.group_by(arith(p[0], "%", const(3, t.U8)))(count_star()).dataframe()
    done.collect()
    assert any(name == "HashAggregate" and m.get("numOutputRows") == 3 for name, m in metrics(done))


def test_any_dataframe_is_a_plan(spark):
    p = dataframe(spark.createDataFrame([(1, "a")], "`x.y` int, x string"))
    assert values(p.project(p["x.y"], p["x"])) == [(1, "a")]


def test_streams_give_the_batch_result(spark, tmp_path):
    from millrace.streaming import run_once, stream_parquet

    source = str(tmp_path / "in")
    spark.range(0, 100).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def count_by_rest(plan):
        return plan.group_by(arith(plan["id"], "%", const(3, t.I8)).alias("rest"))(count_star().alias("n"))

    kept = stream_parquet(spark, source, schema)
    run_once(kept.filter(compare(kept["id"], "<", const(10, t.I64))), str(tmp_path / "kept"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 10
    for total in (100, 150):
        run_once(count_by_rest(stream_parquet(spark, source, schema)), str(tmp_path / "counts"), str(tmp_path / "c2"), "complete")
        assert sum(r["n"] for r in spark.read.parquet(str(tmp_path / "counts")).collect()) == total
        spark.range(100, 150).write.mode("append").parquet(source)


def test_custom_functions_check_types(spark):
    from pyspark.sql import functions as F

    from millrace.functions import custom_aggregate, custom_scalar

    p = one(spark, [1, None, 3], t.I32)
    twice = custom_scalar("twice", lambda x: x * 2, lambda x: x if x == t.I32 else None)
    odd = custom_scalar("odd", lambda x: x % 2 == 1, t.BOOLEAN)
    assert values(p.project(twice(p[0]), odd(p[0]))) == [(2, True), (None, False), (6, True)] and len(values(p.filter(odd(p[0])))) == 2
    assert twice(p[0]).label == f"twice({p[0].label})"
    product = custom_aggregate("product", lambda x: F.product(x), lambda x: t.F64 if x == t.I32 else None)
    assert values(p.aggregate(product(p[0]))) == [(3.0,)]
    with pytest.raises(e.UnsupportedInputs):
        twice(const("a", t.VARCHAR))
    with pytest.raises(e.ArgumentMismatch):
        product(const("a", t.VARCHAR))


def test_custom_operators_sources_and_sinks(spark, tmp_path):
    from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

    from millrace.plans.catalog import Squares
    from millrace.sources import custom

    p = custom(spark, Squares, {"count": 100})
    assert sorted(values(p)) == [(n, n * n) for n in range(100)]

    def halve(batches):
        for b in batches:
            yield b.slice(0, b.num_rows // 2)

    q = p.custom("Halve", lambda df: df.mapInArrow(halve, df.schema), {"n": t.I64, "square": t.I64})
    assert 0 < len(values(q)) <= 50 and q.tree().startswith("Halve[n, square]")
    with pytest.raises(e.FieldTypeMismatch):
        p.custom("Bad", lambda df: df.select("n"), {"n": t.VARCHAR})

    class Files(DataSource):
        @classmethod
        def name(cls):
            return "files"

        def writer(self, schema, overwrite):
            folder = self.options["folder"]

            class Writer(DataSourceWriter):
                def write(self, rows):
                    import uuid

                    name = f"{folder}/{uuid.uuid4().hex}"
                    with open(name, "w") as f:
                        f.writelines(f"{r[0]}\n" for r in rows)
                    return WriterCommitMessage()

            return Writer()

    p.write_to(Files, {"folder": str(tmp_path)})
    assert sorted(int(x) for f in tmp_path.iterdir() for x in f.read_text().split()) == list(range(100))


def test_walks_and_pipelines(spark):
    from millrace.plans.plan import Walk

    p = numbers(spark, 0, 100, partitions=4)
    q = p.filter(compare(p[0], ">", const(5, t.U64_NARROW)))
    q = p.union(q).aggregate(count_star().alias("n")).limit(1)
    assert q.pipelines() == ["Source(Numbers) --> Sink(Aggregate)", "Source(Numbers) --> Filter --> Sink(Aggregate)", "Source(Aggregate) --> Limit"]
    down, up = [], []
    assert q.walk(lambda x: down.append(x.node.split("[")[0]), lambda x: up.append(x.node.split("[")[0])) is Walk.ON
    assert [x.split("(")[0] for x in down] == ["Limit", "Aggregate", "Union", "Numbers", "Filter", "Numbers"]
    assert [x.split("(")[0] for x in up] == ["Numbers", "Numbers", "Filter", "Union", "Aggregate", "Limit"]
    seen = []
    assert q.apply(lambda x: seen.append(x) or (Walk.SKIP if x.node == "Union" else Walk.ON)) is Walk.ON and len(seen) == 3
    assert q.apply(lambda x: Walk.STOP if x.node == "Union" else None) is Walk.STOP


def test_parallelism_and_expression_metrics(spark):
    from millrace.plans.control import Query, expression_metrics, limited

    p = numbers(spark, 0, 100_000, partitions=8)
    keys = p.group_by(arith(p[0], "%", const(100, t.U8)))(count_star())
    for plan, rows in ((keys, 100), (p, 100_000)):
        few = limited(plan, 2)
        assert few.frame.rdd.getNumPartitions() <= 2 and few.frame.count() == rows
    got = []
    assert Query(keys, parallelism=3).start(got.extend).wait(60).rows == 100 == len(got)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    with pytest.raises(e.InvalidParallelism):
        Query(keys, parallelism=0)
    half = compare(arith(p[0], "%", const(2, t.U8)), "==", const(0, t.U8)).alias("even")
    (name, found), (_, all_) = expression_metrics(p, half, p[0])
    assert name == "even" and found["rows"] == 100_000 and found["selected"] == 50_000 and found["seconds"] > 0 and all_["selected"] == 100_000


def test_all_numbers(spark):
    p = numbers(spark, 1, (1 << 64) - 1)
    assert p.fields[0].type == t.U64 and p.frame.rdd.getNumPartitions() >= 2
    last = numbers(spark, (1 << 64) - 5, 100)
    assert [int(x[0]) for x in sorted(values(last))] == [(1 << 64) - 5 + i for i in range(4)]
    whole = numbers(spark, 0, (1 << 64) - 1)
    text = whole.explain("simple")
    assert "Range (0, 9223372036854775807" in text and "Union" in text


def test_far_limit_after_a_shuffle(spark):
    p = numbers(spark, 0, 1000, partitions=7)
    shuffled = dataframe(p.dataframe().repartition(5)).project(dataframe(p.dataframe())[0])
    for offset, due in ((0, 1000), (990, 10), (1000, 0)):
        assert len(values(shuffled.limit(1 << 40, offset))) == due
    a, b = (set(values(shuffled.limit(1 << 40, k))) for k in (0, 400))
    assert len(b) == 600 and b < a

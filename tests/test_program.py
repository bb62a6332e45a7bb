"""Programs: what goes together, what is refused and why, and what a result is about."""

import pytest

from claimspark.operators import program

INPUT = "array<struct<name:string,value:string,unit:string,period:string,population:string,boundary:string>>"


def value(name, number, unit="", period=None, population=None, boundary=None):
    return (name, number, unit, period, population, boundary)


def step(op, *names):
    return (op, list(names[:-1]), names[-1])


@pytest.fixture(scope="module")
def run(spark):
    def go(inputs, *steps):
        df = spark.createDataFrame([("x", inputs, list(steps))], f"id string, inputs {INPUT}, steps array<struct<op:string,args:array<string>,out:string>>")
        return {r["out"]: (r["value"], r["unit"], r["error"]) for r in program.execute(df).collect()}

    return go


def test_rates_and_amounts(run):
    got = run([value("a", "4", "kg/unit", "2020"), value("n", "500", "units", "2020"), value("b", "3", "kg/unit", "2021"), value("m", "1000", "units made", "2021")],
        step("multiply", "a", "n", "x"), step("multiply", "m", "b", "y"), step("pct_change", "x", "y", "p"), step("reduction", "a", "b", "r"))
    assert got == {"x": (2000.0, "kg", None), "y": (3000.0, "kg", None), "p": (50.0, "%", None), "r": (25.0, "%", None)}
    assert run([value("a", "10", "kg CO2e/unit"), value("b", "1000", "units produced")], step("multiply", "a", "b", "x"))["x"] == (10000.0, "kg CO2e", None)
    assert run([value("a", "10", "kg CO2e/unit"), value("b", "500", "employees")], step("multiply", "a", "b", "x"))["x"] == (None, None, "units")
    assert run([value("a", "2", "m"), value("b", "3", "km/h/day")], step("multiply", "a", "a", "x"), step("multiply", "b", "a", "y")) == {"x": (4.0, "m*m", None), "y": (None, None, "units")}
    assert run([value("a", "6", "t"), value("b", "3", "t"), value("c", "2", "units")], step("divide", "a", "b", "x"), step("divide", "a", "c", "y"), step("divide", "a", "const_10", "z")) == {"x": (2.0, "ratio", None), "y": (3.0, "t/units", None), "z": (0.6, "t", None)}


@pytest.mark.parametrize(
    "inputs, one, error",
    [
        ([value("a", "1", "kg"), value("b", "2", "t")], step("add", "a", "b", "s"), "units"),
        ([value("a", "1", "kg"), value("b", "2", "t")], step("compare", "a", "b", "s"), "units"),
        ([value("a", "1"), value("b", "0")], step("divide", "a", "b", "s"), "zero"),
        ([value("a", "1"), value("b", "0")], step("share", "a", "b", "s"), "zero"),
        ([value("a", "1"), value("b", "0")], step("pct_change", "b", "a", "s"), "zero"),
        ([value("a", "1"), value("b", "0")], step("reduction", "b", "a", "s"), "base"),
        ([value("a", "1"), value("b", "-2")], step("reduction", "b", "a", "s"), "base"),
        ([value("a", "1"), value("b", "2")], step("eval", "a", "b", "s"), "operation"),
        ([value("a", "1"), value("b", "2")], step("add", "a", "s"), "arguments"),
        ([value("a", "1"), value("b", "2")], step("divide", "a", "const_7", "s"), "arguments"),
        ([value("a", "one"), value("b", "2")], step("add", "a", "b", "s"), "number"),
        ([value("a", "1e300"), value("b", "1e300")], step("multiply", "a", "b", "s"), "number"),
        ([value("a", "1", "t", "2024"), value("b", "2", "kg", "2025")], step("multiply", "a", "b", "s"), "periods"),
        ([value("a", "1", "t", "2025"), value("b", "2", "t", "2024")], step("pct_change", "a", "b", "s"), "order"),
        ([value("a", "1", "t", "FY2025"), value("b", "2", "t", "year to 2024")], step("reduction", "a", "b", "s"), "order"),
        ([value("a", "1", "t", None, "plant A"), value("b", "2", "t", None, "plant B")], step("compare", "a", "b", "s"), "scope"),
        ([value("a", "1", "t", None, None, "scope 1"), value("b", "2", "t", None, None, "scope 2")], step("pct_change", "a", "b", "s"), "scope"),
    ],
)
def test_refusals(run, inputs, one, error):
    assert run(inputs, one, step("add", "const_1", "const_1", "never")) == {"s": (None, None, error)}


def test_periods_out_of_order_are_known_only_where_a_year_is(run):
    for late, early in (("2025-Q1", "2024-Q1"), (None, "2024"), ("2024", "2024")):
        assert run([value("a", "1", "t", late), value("b", "2", "t", early)], step("pct_change", "a", "b", "s"))["s"] == (100.0, "%", None)


def test_parts_add_up_but_do_not_compare(run):
    """A total of two populations has none; of one period it keeps the period."""
    parts = [value("e1", "50", "i", "2023", "east"), value("w1", "40", "i", "2023", "west"), value("e2", "30", "i", "2025", "east"), value("w2", "42", "i", "2025", "west")]
    sums = (step("sum", "e1", "w1", "t1"), step("sum", "e2", "w2", "t2"))
    assert run(parts, *sums, step("pct_change", "t1", "t2", "c"))["c"] == (-20.0, "%", None)
    assert run(parts, *sums, step("pct_change", "t2", "t1", "c"))["c"] == (None, None, "order")
    assert run(parts, step("pct_change", "e1", "w2", "c"))["c"] == (None, None, "scope")
    assert run(parts, step("share", "e1", "w2", "c"))["c"][2] is None


def test_a_scale_keeps_what_a_figure_is_about(run):
    plants = [value("a", "10", "t", None, "plant A"), value("b", "20", "t", None, "plant B")]
    assert run(plants, step("multiply", "a", "const_1", "x"), step("multiply", "b", "const_1", "y"), step("compare", "x", "y", "d"))["d"] == (None, None, "scope")
    years = [value("a", "100", "t", "2024"), value("b", "120", "t", "2025")]
    assert run(years, step("multiply", "b", "const_1", "x"), step("multiply", "a", "const_1", "y"), step("pct_change", "x", "y", "d"))["d"] == (None, None, "order")


def test_constants(run):
    got = run([value("n", "1211143", "shares"), value("p", "308.10", "USD/share")], step("multiply", "n", "p", "x"), step("divide", "x", "const_1000000", "y"))
    assert got["y"] == (373.1531583, "USD", None)
    assert run([value("const_1000", "42", "t"), value("b", "2", "t")], step("add", "const_1000", "b", "s"))["s"] == (44.0, "t", None)
    got = run([value("r", "6.22", "bn"), value("g", "7", "percent")], step("divide", "g", "const_100", "f"), step("add", "const_1", "f", "k"), step("divide", "r", "k", "x"))
    assert got["k"] == (1.07, "percent", None) and round(got["x"][0], 3) == 5.813


def test_decimals_stay_decimal(run):
    assert run([value("a", "0.1"), value("b", "0.2"), value("c", "0.605")], step("add", "a", "b", "x"), step("subtract", "const_1", "c", "y"), step("multiply", "y", "const_100", "z"))["x"][0] == 0.3
    assert run([value("a", "1"), value("b", "0.605")], step("subtract", "a", "b", "y"), step("multiply", "y", "const_100", "z"))["z"][0] == 39.5


def test_names_again_and_odd_programs(spark, run):
    """A step may give a figure's name to its result; empty programs, null parts and other types of id pass."""
    assert run([value("a", "2", "t"), value("a", "3", "t"), value("b", "4", "t")], step("add", "a", "b", "a"), step("add", "a", "b", "c"))["c"][0] == 11.0
    assert run([]) == {} and run(None, ("add", None, "x"))["x"][2] == "arguments" and run([value("a", None), value("b", "1")], step("add", "a", "b", "x"))["x"][2] == "number"
    df = spark.createDataFrame([(7, [("a", "1"), ("b", "2")], [step("add", "a", "b", "s")]), (8, None, None)], "id long, inputs array<struct<name:string,value:string>>, steps array<struct<op:string,args:array<string>,out:string>>")
    assert [tuple(r) for r in program.execute(df).collect()] == [("7", "s", 3.0, "", None, None)]


def test_no_python_runs(spark):
    df = spark.createDataFrame([], f"id string, inputs {INPUT}, steps array<struct<op:string,args:array<string>,out:string>>")
    plan = program.execute(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

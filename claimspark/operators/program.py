"""Restricted arithmetic over source-linked figures, as one fold over the steps of a program.

A figure carries its unit, its period and whom and what it covers. A step refuses figures that don't go together and the program ends there. Values are
doubles, each result rounded to 15 significant digits, so that decimal figures stay decimal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.functions.numbers import bound_to, year_of

#: Scale factors that a program may name.
CONSTANTS = {f"const_{n}": n for n in (1, 10, 100, 1000, 1000000, 1000000000)}
#: Operations by what their figures must have in common, and all there are.
ONE_UNIT = ("add", "subtract", "sum", "compare", "pct_change", "reduction", "share")
ONE_SCOPE = ("compare", "pct_change", "reduction")
OPERATIONS = (*ONE_UNIT, "multiply", "divide")
ABOUT = ("unit", "period", "population", "boundary")
#: Inputs and then what each step made; the last one's error ends the program.
FIGURES = "array<struct<name:string,value:double,unit:string,period:string,population:string,boundary:string,error:string>>"
RESULT = T.StructType([T.StructField("id", T.StringType()), T.StructField("out", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType()), T.StructField("period", T.StringType()), T.StructField("error", T.StringType())])


def exact(x: Column) -> Column:
    """A double rounded to 15 significant digits."""
    return F.format_string("%.14e", x).try_cast("double")


def words(unit: Column) -> Column:
    """The distinct words of a unit, without an s at their end."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(unit), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.regexp_replace(w, "s+$", "")))


def cancelled(rate: Column, other: Column) -> Column:
    """What is over the bar of a rate, if all words under its last bar are in the other unit; else null."""
    below = F.substring_index(rate, "/", -1)
    over = F.trim(F.substring(rate, F.lit(1), F.length(rate) - F.length(below) - 1))
    cancels = bound_to(words(below), lambda w: (F.size(w) > 0) & (F.size(F.array_except(w, words(other))) == 0))
    return F.when(rate.contains("/") & cancels, over)


def product_unit(a: Column, b: Column) -> Column:
    """The unit of a product; null where a rate meets a unit that doesn't cancel."""
    plain = F.when((a == "") | (b == ""), F.concat(a, b)).when(~a.contains("/") & ~b.contains("/"), F.concat(a, F.lit("*"), b))
    return F.coalesce(cancelled(a, b), cancelled(b, a), plain)


def several(values: Column) -> Column:
    """Whether an array holds different values."""
    return F.exists(values, lambda v: v != F.get(values, 0))


def common(values: Column) -> Column:
    """The one value that all of an array are; '' for none or several."""
    return F.when((F.size(values) > 0) & ~several(values), F.get(values, 0)).otherwise("")


def constant(name: Column) -> Column:
    """The figure of a constant's name, null for other names."""
    out = F.lit(None).cast(FIGURES[6:-1])
    for k, v in CONSTANTS.items():
        out = F.when(name == k, F.struct(F.lit(k).alias("name"), F.lit(float(v)).alias("value"), *[F.lit("").alias(c) for c in ABOUT], F.lit(None).cast("string").alias("error"))).otherwise(out)
    return F.when(name.startswith("const_"), out)


def stepped(state: Column, step: Column) -> Column:
    """The state after a step. What is bound inside is small, as what is bound is copied."""
    return F.when(F.get(state, F.size(state) - 1)["error"].isNotNull(), state).otherwise(F.concat(state, F.array(made(state, step))))


def made(state: Column, step: Column) -> Column:
    """The figure of a step, or its refusal."""
    # a later figure hides an earlier one, and any a constant
    last = lambda name: F.coalesce(F.try_element_at(F.filter(state, lambda f: f["name"] == name), F.lit(-1)), constant(name))
    args = F.coalesce(step["args"], F.array().cast("array<string>"))
    return bound_to(F.transform(args, last), lambda got: applied(step["op"], step["out"], args, got))


def applied(op: Column, out: Column, args: Column, got: Column) -> Column:
    stated = lambda name: F.transform(F.filter(got, lambda g: g[name] != ""), lambda g: g[name])
    covers = F.transform(F.filter(got, lambda g: (g["population"] != "") | (g["boundary"] != "")), lambda g: F.struct(g["population"], g["boundary"]))
    part = lambda s, name: F.when(several(s), "").otherwise(F.coalesce(F.get(s, 0)[name], F.lit(""))).alias(name)
    scope = bound_to(covers, lambda s: F.struct(several(s).alias("several"), part(s, "population"), part(s, "boundary")))
    return bound_to(
        F.struct(stated("unit").alias("units"), scope.alias("scope"), bound_to(stated("period"), common).alias("period")),
        lambda has: recorded(out, has, judged(op, out, args, got, has)),
    )


def judged(op: Column, out: Column, args: Column, got: Column, has: Column) -> Column:
    """(value, unit, error) of a step: one of the last two is null."""
    x, y = F.get(got, 0), F.get(got, 1)
    a, b = x["value"], y["value"]
    period = lambda i, g: F.when(F.get(args, i) == out, has["period"]).otherwise(g["period"])  # noqa: E731  a step that renames a figure has dated it already
    first, second = period(0, x), period(1, y)
    value = (
        F.when(op.isin("add", "sum"), F.aggregate(got, F.lit(0.0), lambda s, g: s + g["value"]))
        .when(op.isin("subtract", "compare"), a - b)
        .when(op == "multiply", a * b)
        .when((op == "divide") & (b != 0), a / b)
        .when((op == "share") & (b != 0), a / b * 100)
        .when((op == "pct_change") & (a != 0), (b - a) / a * 100)
        .when((op == "reduction") & (a > 0), (1 - b / a) * 100)
    )
    quotient = F.when(y["unit"] == "", x["unit"]).when(x["unit"] == y["unit"], "ratio").otherwise(F.concat(x["unit"], F.lit("/"), y["unit"]))
    unit = F.when(op.isin("pct_change", "share", "reduction"), "%").when(op == "multiply", product_unit(x["unit"], y["unit"])).when(op == "divide", quotient).otherwise(F.coalesce(F.get(has["units"], 0), F.lit("")))

    def settled(v: Column) -> Column:
        """v: the value and the unit."""
        error = (
            F.when(v["value"].isNull() & (~op.isin(*OPERATIONS) | op.isNull()), "operation")  # an unknown one has no value
            .when(F.size(got) < 2, "arguments")
            .when(F.exists(got, lambda g: g["value"].isNull()), F.when(F.exists(got, lambda g: g.isNull()), "arguments").otherwise("number"))
            .when(several(has["units"]) & op.isin(*ONE_UNIT), "units")
            .when(has["scope"]["several"] & op.isin(*ONE_SCOPE), "scope")
            .when(op.isin("pct_change", "reduction") & (year_of(first) > year_of(second)), "order")
            .when((op == "multiply") & (first != "") & (second != "") & (first != second), "periods")
            .when((op == "multiply") & v["unit"].isNull(), "units")
            .when(v["value"].isNull(), F.when(op == "reduction", "base").otherwise("zero"))
            .when(F.isnan(v["value"]) | (F.abs(v["value"]) == float("inf")), "number")
        )
        return F.struct(v["value"], v["unit"], error.alias("error"))

    return bound_to(F.struct(value.alias("value"), unit.alias("unit")), settled)


def recorded(out: Column, has: Column, settled: Column) -> Column:
    """A step's figure; of a refusal only the name and the error."""

    def kept(m: Column) -> Column:
        fine = m["error"].isNull()
        return F.struct(out.alias("name"), F.when(fine, exact(m["value"])).alias("value"), F.when(fine, m["unit"]).alias("unit"), F.when(fine, has["period"]).alias("period"), has["scope"]["population"], has["scope"]["boundary"], m["error"].alias("error"))

    return bound_to(settled, kept)


def results(inputs: Column, steps: Column, given: tuple[str, ...] = ("name", "value", *ABOUT)) -> Column:
    """An array of (out, value, unit, period, error) for each step up to the first refusal.

    inputs: array of (name, value as decimal text, unit, period, population, boundary), of which `given` are there; steps: array of (op, args, out). Of
    inputs of one name the last counts, and it hides a constant of that name. Nulls count as not stated. A refusal is
    named operation, arguments (unknown or fewer than two), number (not one, or not finite), units, scope (another population or boundary), order (the later
    year first), periods (a product of two), zero (no change from it, no share of it, no division by it) or base (a reduction from zero or below).
    """
    blank = F.lit("")
    about = lambda i: [(F.coalesce(i[c], blank) if c in given else blank).alias(c) for c in ABOUT]
    error = F.lit(None).cast("string").alias("error")
    inputs = F.coalesce(inputs, F.array().cast(inputs_type(given)))
    read = F.transform(inputs, lambda i: F.struct(i["name"].alias("name"), F.trim(i["value"]).try_cast("double").alias("value"), *about(i), error))
    results_of = lambda s: F.transform(
        F.slice(s, F.size(inputs) + 1, F.size(s)), lambda f: F.struct(f["name"].alias("out"), f["value"].alias("value"), f["unit"].alias("unit"), F.nullif(f["period"], blank).alias("period"), f["error"].alias("error"))
    )
    return F.aggregate(F.coalesce(steps, F.array().cast("array<struct<op:string,args:array<string>,out:string>>")), read.cast(FIGURES), stepped, results_of)


def inputs_type(given: tuple[str, ...]) -> str:
    return "array<struct<" + ",".join(f"{c}:string" for c in given) + ">>"


def execute(programs: DataFrame) -> DataFrame:
    """RESULT rows of (id, inputs, steps), one for each step up to the first refusal; see `results`. Inputs may lack what they don't state. A program without steps has no row."""
    given = tuple(programs.schema["inputs"].dataType.elementType.names)
    fits = programs.schema["inputs"].dataType.simpleString() == inputs_type(given)
    inputs = F.col("inputs") if fits else F.col("inputs").cast(inputs_type(given))
    rows = programs.select(F.col("id").cast("string").alias("id"), F.explode(results(inputs, F.col("steps"), given)).alias("r"))
    return rows.select("id", "r.*").select(*RESULT.names)

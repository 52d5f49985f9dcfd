"""Mixing to target weights by iterative proportional fitting.

Tokens are counted in cells of source, language and topic.  Cell probabilities are the product of
one factor for each of the three, cut at 1; factors are raked, one dimension after the other, until
the expected tokens of every source, language and topic meet their targets.  A document is then
taken if a hash of it, as a number from 0 to 1, is below its cell's probability, so a rerun takes
the same documents.

Texts are read once: topic and tokens are written beside the columns that are asked for, and cells
and results come from that table.  Up to ``ARRAY_CELLS`` cells are raked as arrays of one row, in one
plan; beyond it each half sweep is a join and a sum over the cell table.

A null source or language counts as ``(none)``, a text without words has no tokens and is its
cell's like any other; very long texts are counted whole.  Rows of one id and text share their fate.
Raking ends when the tolerance is met or the error stops falling (bounded probabilities cannot meet
every set of marginals); ``marginals`` tells how far each one is from its target.  Columns of the
documents may have any names; ``topic`` and the other results take the place of theirs.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamwatch.functions.core import compute_once, let
from seamwatch.llm.common import SPACE, durable, sized, with_results

#: More sweeps than any fit has needed; the fit itself ends by tolerance or by an error that stops falling.
SWEEPS = 500
TOLERANCE = 0.002
#: A sweep must cut the error to less than this share of the one before.
FALLING = 0.999
#: Share of all tokens to take, and the power that evens the marginals out (1 leaves them, 0 levels).
KEEP = 0.6
EVEN = 0.8
#: Cells, and values of a dimension, up to which raking works on arrays in one row.
ARRAY_CELLS = 5_000
#: Marks of the topics, as patterns counted over the whole text; most marks win, then the first.
TOPIC_MARKS = {
    "legal": "[Ll]icen[sc]e|[Cc]opyright|[Rr]ights",
    "contact": "@|\\+[0-9]",
    "figures": "[0-9]{4,}",
    "symbols": "[#$%&*|!]{2,}",
}
DIMENSIONS = ("source", "lang", "topic")


def token_count(text: str = "text") -> Column:
    """Words of the text: each is cut down to its first character, white space goes."""
    firsts = F.regexp_replace(F.col(text), f"([^{SPACE}])[^{SPACE}]*+|[{SPACE}]++", "$1")
    return F.coalesce(F.char_length(firsts), F.lit(0)).cast("long")


def topic(text: str = "text", marks: Mapping[str, str] = TOPIC_MARKS) -> Column:
    """The topic with most marks in the text, ``prose`` without any."""
    counts = [F.struct(F.coalesce(F.regexp_count(F.col(text), F.lit(p)), F.lit(0)).alias("n"), F.lit(-i).alias("first"), F.lit(t).alias("topic"))
              for i, (t, p) in enumerate(marks.items())]
    best = F.array_max(F.array(*counts, F.struct(F.lit(0).alias("n"), F.lit(1).alias("first"), F.lit("prose").alias("topic"))))
    return best["topic"]


def _array_sized(df: DataFrame) -> bool:
    return df.limit(ARRAY_CELLS + 1).count() <= ARRAY_CELLS


def targets(cells: DataFrame, by: str, even: float = EVEN, keep: float = KEEP) -> DataFrame:
    """(value, target share) of a dimension: the corpus shares to the power ``even``.

    No value is asked for more tokens than it has (its cap); what it lacks is spread over the others
    in proportion, until nothing lacks.
    """
    rows = cells.groupBy(by).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    if not _array_sized(rows):
        return _targets_of_many(durable(rows), by, even, keep)
    one = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("value"), "t"))).alias("v"), F.sum("t").alias("whole"))
    one = compute_once(one, x=F.transform("v", lambda r: F.struct(r["value"].alias("value"), F.pow(r["t"], F.lit(even)).alias("p"), (r["t"] / F.col("whole") / keep).alias("cap"))))

    def total(value) -> Column:
        return F.aggregate("x", F.lit(0.0), lambda acc, r: acc + value(r))

    def step(acc: Column, _: Column) -> Column:
        full = F.struct(total(lambda r: F.when(r["p"] * acc["level"] >= r["cap"], r["cap"]).otherwise(0.0)).alias("cap"),
                        total(lambda r: F.when(r["p"] * acc["level"] < r["cap"], r["p"]).otherwise(0.0)).alias("open"),
                        total(lambda r: F.when(r["p"] * acc["level"] >= r["cap"], 1.0).otherwise(0.0)).alias("n"))
        return F.when(acc["done"], acc).otherwise(let(full, lambda s: F.struct(
            F.when(s["open"] > 0, (1.0 - s["cap"]) / s["open"]).otherwise(acc["level"]).alias("level"), s["n"].alias("n"), ((s["n"] == acc["n"]) | (s["open"] <= 0)).alias("done"))))

    start = F.struct((1.0 / total(lambda r: r["p"])).alias("level"), F.lit(-1.0).alias("n"), F.lit(False).alias("done"))
    one = compute_once(one, level=F.aggregate(F.sequence(F.lit(1), F.size("x") + 1), start, step, lambda acc: acc["level"]))
    return one.select("level", F.inline("x")).select(F.col("value").alias(by), F.least(F.col("p") * F.col("level"), "cap").alias("target"))


def _targets_of_many(rows: DataFrame, by: str, even: float, keep: float) -> DataFrame:
    """The same level from sums over the table; it rises until no further value is full."""
    whole = rows.agg(F.sum("t")).first()[0]
    rows = rows.select(by, F.pow("t", F.lit(even)).alias("p"), (F.col("t") / whole / keep).alias("cap"))
    level, full = 1.0 / rows.agg(F.sum("p")).first()[0], -1
    while True:
        at = F.col("p") * level >= F.col("cap")
        cap, open_, n = rows.agg(F.coalesce(F.sum(F.when(at, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~at, F.col("p"))), F.lit(0.0)), F.count_if(at)).first()
        if n == full or open_ <= 0:
            return rows.select(by, F.least(F.col("p") * level, F.col("cap")).alias("target"))
        level, full = (1.0 - cap) / open_, n


def fit(cells: DataFrame, wanted: Mapping[str, DataFrame], keep: float = KEEP, dimensions: Sequence[str] = DIMENSIONS,
        sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells with their calibrated ``probability``; one with no target in some dimension has 0."""
    if _array_sized(cells):
        return _fit_arrays(cells, wanted, keep, list(dimensions), sweeps, tolerance)
    return _fit_tables(cells, wanted, keep, list(dimensions), sweeps, tolerance)


def _fit_arrays(cells: DataFrame, wanted: Mapping[str, DataFrame], keep: float, dimensions: list[str], sweeps: int, tolerance: float) -> DataFrame:
    """Raking as one fold over half sweeps; the state is one array of factors for each dimension, and those of the sweep before."""
    cell = F.struct(*[F.col(d).alias(d) for d in dimensions], "tokens")
    goal = "struct<value:string,target:double>"
    rows = [cells.select(cell.alias("c"), *[F.lit(None).cast(goal).alias(d) for d in dimensions])]
    for d in dimensions:
        own = F.struct(F.col(d).cast("string").alias("value"), F.col("target").cast("double").alias("target"))
        rows.append(wanted[d].select(F.lit(None).cast(cells.select(cell.alias("c")).schema["c"].dataType).alias("c"), *[own.alias(x) if x == d else F.lit(None).cast(goal).alias(x) for x in dimensions]))
    one = reduce(DataFrame.unionByName, rows).agg(F.array_sort(F.collect_list("c")).alias("c"), *[F.array_sort(F.collect_list(d)).alias(f"w_{d}") for d in dimensions])
    total = F.aggregate("c", F.lit(0.0), lambda acc, x: acc + x["tokens"])
    one = compute_once(one, whole=total, **{f"v_{d}": F.transform(f"w_{d}", lambda x: x["value"]) for d in dimensions})
    one = compute_once(one, x=F.transform("c", lambda x: F.struct(*[(F.array_position(f"v_{d}", x[d]).cast("int") - 1).alias(d) for d in dimensions], x["tokens"].cast("double").alias("tokens"))))
    def members_of(d: str):
        return lambda _, i: F.filter("x", lambda y: (y[d] == i) & ~reduce(Column.__or__, [y[e] < 0 for e in dimensions]))

    one = compute_once(one, **{f"g_{d}": F.transform(f"v_{d}", members_of(d)) for d in dimensions},
                       **{f"t_{d}": F.transform(f"w_{d}", lambda x: x["target"] * F.col("whole") * keep) for d in dimensions})
    n = len(dimensions)

    def product(acc: Column, x: Column) -> Column:
        return F.least(reduce(Column.__mul__, [F.get(acc[d], x[d]) for d in dimensions]), F.lit(1.0))

    def half(acc: Column, d: str) -> Column:
        def scaled(members: Column, i: Column) -> Column:
            expected = F.aggregate(members, F.lit(0.0), lambda s, x: s + x["tokens"] * product(acc, x))
            return F.get(acc[d], i) * let(expected, lambda e: F.when(e > 0, F.get(F.col(f"t_{d}"), i) / e).otherwise(1.0))
        return F.transform(f"g_{d}", scaled)

    def off(acc: Column) -> Column:
        each = [F.aggregate(F.arrays_zip(acc[d].alias("f"), acc[f"p_{d}"].alias("p")), F.lit(0.0), lambda worst, z: F.greatest(worst, F.when((z["f"] > 0) & (z["p"] > 0), F.abs(F.log(z["f"] / z["p"]))).otherwise(0.0))) for d in dimensions]
        return F.greatest(*each) if n > 1 else each[0]

    def moved(acc: Column, k: Column, error: Column) -> Column:
        return F.struct(*[F.when(k % n == i, half(acc, d)).otherwise(acc[d]).alias(d) for i, d in enumerate(dimensions)],
                        *[F.when(k % n == i, acc[d]).otherwise(acc[f"p_{d}"]).alias(f"p_{d}") for i, d in enumerate(dimensions)],
                        error.alias("error"), F.lit(False).alias("done"))

    def ended(acc: Column, error: Column) -> Column:
        return F.struct(*[acc[d].alias(d) for d in dimensions], *[acc[f"p_{d}"].alias(f"p_{d}") for d in dimensions], error.alias("error"), F.lit(True).alias("done"))

    def step(acc: Column, k: Column) -> Column:
        swept = F.when((k % n == 0) & (k > 0), off(acc))
        return F.when(acc["done"], acc).otherwise(let(swept, lambda e: F.when(
            e.isNotNull() & ((e < tolerance) | (e > acc["error"] * FALLING)), ended(acc, e)).otherwise(moved(acc, k, F.coalesce(e, acc["error"])))))

    def level(d: str, value: float) -> Column:
        return F.transform(f"t_{d}", lambda _: F.lit(value))

    first = F.struct(*[level(d, 1.0 if i else float(keep)).alias(d) for i, d in enumerate(dimensions)], *[level(d, 1.0).alias(f"p_{d}") for d in dimensions], F.lit(float("inf")).alias("error"), F.lit(False).alias("done"))
    one = compute_once(one, f=F.aggregate(F.sequence(F.lit(0), F.lit(sweeps * n)), first, step))
    none = [f"y.{d} < 0" for d in dimensions]
    probability = F.when(F.expr(" OR ".join(none)), 0.0).otherwise(F.least(reduce(Column.__mul__, [F.get(F.col(f"f.{d}"), F.col(f"y.{d}")) for d in dimensions]), F.lit(1.0)))
    each = one.select("f", F.explode(F.arrays_zip("c", F.col("x").alias("y"))).alias("z")).select("f", "z.c", "z.y")
    return each.select(*[F.col(f"c.{d}").alias(d) for d in dimensions], F.col("c.tokens").alias("tokens"), probability.alias("probability")).select(*cells.columns, "probability")


def _fit_tables(cells: DataFrame, wanted: Mapping[str, DataFrame], keep: float, dimensions: list[str], sweeps: int, tolerance: float) -> DataFrame:
    """Raking over tables of any size; only factors, one row for each value of a dimension, travel between the sweeps."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    factors = durable(reduce(DataFrame.unionByName, [wanted[d].select(
        F.lit(d).alias("dimension"), F.col(d).alias("value"), (F.col("target") * F.lit(float(total) * keep)).alias("goal"),
        F.lit(1.0 if i else float(keep)).alias("factor"), F.lit(1.0).alias("off")) for i, d in enumerate(dimensions)]))
    before = float("inf")
    for _ in range(sweeps):
        worst = 0.0
        for d in dimensions:
            sums = _with_factors(cells, factors, dimensions).groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.sum(F.col("tokens") * F.col("probability")).alias("expected"))
            ratio = F.when(F.col("expected") > 0, F.col("goal") / F.col("expected")).otherwise(1.0)
            factors = durable(factors.join(sums, ["dimension", "value"], "left").select(
                "dimension", "value", "goal", (F.col("factor") * ratio).alias("factor"), F.abs(F.log(ratio)).alias("off")))
            worst = max(worst, factors.where(F.col("dimension") == d).agg(F.max("off")).first()[0] or 0.0)
        if worst < tolerance or worst > before * FALLING:
            break
        before = worst
    return _with_factors(cells, factors, dimensions).select(*cells.columns, "probability")


def _with_factors(cells: DataFrame, factors: DataFrame, dimensions: list[str]) -> DataFrame:
    rows = cells
    for d in dimensions:
        rows = rows.join(factors.where(F.col("dimension") == d).select(F.col("value").alias(d), F.col("factor").alias(f"f_{d}")), d, "left")
    product = reduce(Column.__mul__, [F.coalesce(F.col(f"f_{d}"), F.lit(0.0)) for d in dimensions])
    return rows.withColumn("probability", F.least(product, F.lit(1.0)))


def marginals(fitted: DataFrame, wanted: Mapping[str, DataFrame], keep: float = KEEP) -> DataFrame:
    """(dimension, value, target, reached, error): shares of the tokens taken that were wanted and are expected, and their difference."""
    whole = (fitted.agg(F.sum("tokens")).first()[0] or 0) * keep or 1.0
    out = [goal.join(fitted.groupBy(d).agg(F.sum(F.col("tokens") * F.col("probability")).alias("n")), d, "left").select(
        F.lit(d).alias("dimension"), F.col(d).alias("value"), "target", (F.coalesce("n", F.lit(0.0)) / whole).alias("reached")) for d, goal in wanted.items()]
    return reduce(DataFrame.unionByName, out).withColumn("error", F.col("reached") - F.col("target"))


def mix(docs: DataFrame, keep: float = KEEP, even: float = EVEN, doc_id: str = "doc_id", text: str = "text",
        source: str = "source", lang: str = "lang", seed: int = 17, columns: Sequence[str] | None = None) -> DataFrame:
    """Documents with ``topic``, ``tokens``, ``weight`` (probability over ``keep``), ``probability`` and ``taken``.

    ``columns`` names those of the documents that the result has; all if it is not given.
    """
    kept = list(columns) if columns is not None else docs.columns
    named = {"source": F.coalesce(F.col(source).cast("string"), F.lit("(none)")), "lang": F.coalesce(F.col(lang).cast("string"), F.lit("(none)")), "topic": topic(text)}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), *[v.alias(f"_{k}") for k, v in named.items()], token_count(text).alias("tokens"), F.xxhash64(F.lit(seed), doc_id, text).alias("_u"))
    rows = durable(rows)
    cells = durable(rows.groupBy(*[F.col(f"_{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("tokens").alias("tokens")))
    fitted = durable(fit(cells, {d: targets(cells, d, even, keep) for d in DIMENSIONS}, keep).drop("tokens"))
    fitted = fitted.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "probability")
    unit = F.shiftrightunsigned("_u", 11).cast("double") * F.lit(2.0**-53)
    out = rows.join(sized(fitted), [f"_{d}" for d in DIMENSIONS])
    out = out.withColumns({"topic": F.col("_topic"), "weight": F.col("probability") / keep, "taken": unit < F.col("probability")})
    return with_results(out, kept, ["topic", "tokens", "weight", "probability", "taken"])


def sample(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with their own columns."""
    inner = mix(docs.select(F.struct("*").alias("_doc"), *[F.col(c) for c in ("doc_id", "text", "source", "lang")]), columns=["_doc"], **options)
    return inner.where("taken").select("_doc.*")

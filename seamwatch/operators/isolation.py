"""Inspection modules as batch functions, each shielded from the failures of the others.

A module is built once for each worker and takes either one row or a batch of rows.  One that takes
rows is called once for each, however many fail.  If a batch fails, its first failing row is found by
halving and the rows after it go on in stretches as long as the failures are apart, so k bad rows of n
cost about k log2(n / k) calls and the good rows keep their results; a row that fails alone has
``status = failed`` with the exception's text.  A module that cannot even be built fails for every
row.  The other modules run in either case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Columns of a module's result besides keys, order and name; a module leaves out what it has not.
RESULT = ("enabled boolean, status string, number int, raw_text string, value double, present boolean, labels array<string>, "
          "meters int, confidence double, votes bigint, source string, reason string")

#: What a result column that a module leaves out holds, if not null.
_DEFAULTS = {"enabled": True}

#: Rows in, one result for each row (a frame with any of the columns of ``RESULT``) out.
Batch = Callable[[pd.DataFrame], pd.DataFrame]

#: One row in, its result (any of the columns of ``RESULT``) out.
Single = Callable[[dict[str, Any]], Mapping[str, Any]]


@dataclass(frozen=True)
class Module:
    """A module: its name, what builds it on a worker, whether it is switched on, and whether it takes rows one by one."""

    name: str
    build: Callable[[], Batch | Single]
    enabled: bool = True
    by_row: bool = False


def _guarded(run: Batch, rows: pd.DataFrame, names: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Results of the rows in order; failures are narrowed down one after the other."""
    def attempt(start: int, stop: int) -> pd.DataFrame | Exception:
        try:
            out = run(rows.iloc[start:stop])
            if len(out) != stop - start:
                raise ValueError(f"{len(out)} results for {stop - start} rows")
            unknown = [c for c in out.columns if c not in names]
            if unknown:
                raise ValueError(f"unknown result columns: {', '.join(unknown)}")
            return out
        except Exception as problem:  # whatever a module raises is its result
            return problem

    start, size, failures = 0, len(rows), 0
    while start < len(rows):
        stop = min(start + size, len(rows))
        out = attempt(start, stop)
        if isinstance(out, Exception):
            while stop - start > 1:  # the first failing row is before ``stop``
                half = (start + stop) // 2
                out = attempt(start, half)
                if isinstance(out, Exception):
                    stop = half
                else:
                    yield out
                    start, out = half, None
            out = attempt(start, stop) if out is None else out
            failures += 1
        yield _failed(1, out) if isinstance(out, Exception) else out
        start = stop
        size = max(1, start * 7 // (failures * 10)) if failures else size


def _failed(n: int, problem: Exception) -> pd.DataFrame:
    return pd.DataFrame({"enabled": [True] * n, "status": ["failed"] * n, "reason": [str(problem)] * n})


def _each(run: Single, rows: Sequence[dict[str, Any]], fields: Sequence[pa.Field]) -> list[pa.Array]:
    """The fields of the rows' results; a row that fails, or whose result a field cannot take, has its reason."""
    names = {field.name for field in fields}
    results = []
    for row in rows:
        try:
            result = run(row)
            if not result.keys() <= names:
                raise ValueError(f"unknown result columns: {', '.join(c for c in result if c not in names)}")
        except Exception as problem:
            result = {"status": "failed", "reason": str(problem)}
        results.append(result)
    try:
        return _fields(results, fields)
    except Exception:  # the results are not all of the fields' kinds
        return [pa.concat_arrays(values) for values in zip(*(_one(result, fields) for result in results))]


def _one(result: Mapping[str, Any], fields: Sequence[pa.Field]) -> list[pa.Array]:
    try:
        return _fields([result], fields)
    except Exception as problem:
        return _same(fields, 1, status="failed", reason=str(problem))


def _fields(results: Sequence[Mapping[str, Any]], fields: Sequence[pa.Field]) -> list[pa.Array]:
    used = set().union(*results)
    return [_cast([r.get(f.name, _DEFAULTS.get(f.name)) for r in results], f.type) if f.name in used else _standard(f, len(results)) for f in fields]


def _same(fields: Sequence[pa.Field], n: int, **values: Any) -> list[pa.Array]:
    return [pa.repeat(pa.scalar(values[f.name], f.type), n) if f.name in values else _standard(f, n) for f in fields]


def run_isolated(rows: DataFrame, keys: Sequence[str], modules: Sequence[Module]) -> DataFrame:
    """(keys, module_order, module_id, result columns): every module on every row, in the given order of modules."""
    keys = list(keys)
    result = StructType.fromDDL(RESULT)
    schema = StructType([*[rows.schema[k] for k in keys], *StructType.fromDDL("module_order int, module_id string"), *result])
    arrow = to_arrow_schema(schema)
    result_fields = list(arrow)[len(keys) + 2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[str, Batch | Exception] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            for order, module in enumerate(modules):
                if not module.enabled:
                    results = _same(result_fields, n, enabled=False, status="disabled")
                else:
                    if module.name not in built:
                        try:
                            built[module.name] = module.build()
                        except Exception as problem:  # a module that cannot start fails alone
                            built[module.name] = problem
                    own = built[module.name]
                    if isinstance(own, Exception):
                        results = _same(result_fields, n, status="failed", reason=str(own))
                    elif module.by_row:
                        results = _each(own, batch.to_pylist(), result_fields)
                    else:
                        parts = list(_guarded(own, batch.to_pandas(), result.names))
                        results = [_column(parts, field) for field in result_fields]
                columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
                columns += [pa.array([order] * n, pa.int32()), pa.array([module.name] * n, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *results], schema=arrow)

    # few large row groups or a filter would leave the modules, which cost most, to few tasks
    spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(run, schema)


def _column(parts: Sequence[pd.DataFrame], field: pa.Field) -> pa.Array:
    """The field's values of the parts in order, turned to Arrow at once where they are of one kind."""
    has = np.array([field.name in list(part.columns) for part in parts])  # an index would be hashed for each part
    sizes = [len(part) for part in parts]
    if not has.any():
        return _standard(field, sum(sizes))
    values = _joined([part[field.name] for part, there in zip(parts, has) if there], field.type)
    if has.all():
        return values
    there = np.repeat(has, sizes)
    found = pa.concat_arrays([values, _standard(field, 1)])
    return found.take(pa.array(np.where(there, np.cumsum(there) - 1, len(values))))


def _joined(values: Sequence[pd.Series], kind: pa.DataType) -> pa.Array:
    dtypes = {v.dtype for v in values}
    if len(dtypes) == 1 and isinstance(dtype := dtypes.pop(), np.dtype):
        whole = np.concatenate([v.to_numpy() for v in values])
        if dtype != object or {type(v) for v in whole} <= {str, type(None)}:
            return _cast(pd.Series(whole, dtype=dtype), kind)
    return pa.concat_arrays([_cast(v, kind) for v in values])


def _cast(values: pd.Series | list, kind: pa.DataType) -> pa.Array:
    out = pa.array(values.tolist() if isinstance(values, pd.Series) and values.dtype == object else values, from_pandas=True)
    return (out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out).cast(kind)


def _standard(field: pa.Field, n: int) -> pa.Array:
    return pa.repeat(pa.scalar(_DEFAULTS[field.name], field.type), n) if field.name in _DEFAULTS else pa.nulls(n, field.type)


def module_health(results: DataFrame) -> DataFrame:
    """(module_id, rows, failed, first_reason): how often each module has failed, and the least of its reasons."""
    bad = F.col("status") == "failed"
    found = results.groupBy("module_order", "module_id", bad.alias("bad"), F.when(bad, F.col("reason")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    # the least of strings needs sorted rows, so only the distinct reasons go there
    return found.groupBy("module_order", "module_id").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("failed"), F.min("reason").alias("first_reason")).drop("module_order")


def as_modules(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key with its modules as an ordered array of (module_id, result)."""
    fields = StructType.fromDDL(RESULT).names
    entry = F.struct("module_order", "module_id", F.struct(*fields).alias("result"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["module_id"].alias("module_id"), e["result"].alias("result")))
    return results.groupBy(*keys).agg(ordered.alias("modules"))

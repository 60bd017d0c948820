"""JSON functions over JSON text.  What recurses into documents of any shape
(containment, removal of nulls, changes by path, pretty printing) runs as
Arrow-batched UDFs, registered by :func:`register`; the rest are expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_KIND = (
    "CASE WHEN try_parse_json($1) IS NULL THEN NULL WHEN schema_of_variant(try_parse_json($1)) = 'VOID' THEN 'null'"
    " WHEN schema_of_variant(try_parse_json($1)) = 'BOOLEAN' THEN 'boolean' WHEN schema_of_variant(try_parse_json($1)) = 'STRING' THEN 'string'"
    " WHEN schema_of_variant(try_parse_json($1)) LIKE 'ARRAY%' THEN 'array' WHEN schema_of_variant(try_parse_json($1)) LIKE 'OBJECT%' THEN 'object' ELSE 'number' END"
)
_VALUE = "to_json(CAST($1 AS VARIANT))"
_OBJECT = "to_json(map_from_entries(collect_list(struct(CAST($1 AS STRING) AS k, $2 AS v))))"
_TEXTS = "from_json($1, 'array<string>')"

TEMPLATES = {
    "json_valid": {1: "try_parse_json($1) IS NOT NULL"},
    "json_typeof": {1: _KIND},
    "jsonb_typeof": {1: _KIND},
    "jsonb_array_length": {1: "json_array_length($1)"},
    "json_object_keys": {1: "explode(json_object_keys($1))"},
    "jsonb_object_keys": {1: "explode(json_object_keys($1))"},
    "to_json": {1: _VALUE},
    "to_jsonb": {1: _VALUE},
    "json_extract_scalar": {2: "CASE WHEN left(get_json_object($1, $2), 1) NOT IN ('{', '[') THEN get_json_object($1, $2) END"},
    "json_extract": {2: "get_json_object($1, $2)"},
    "json_extract_path": {2: "get_json_object($1, concat('$.', $2))"},
    "json_extract_path_text": {2: "get_json_object($1, concat('$.', $2))"},
    "jsonb_extract_path": {2: "get_json_object($1, concat('$.', $2))"},
    "jsonb_extract_path_text": {2: "get_json_object($1, concat('$.', $2))"},
    "json_array_elements": {1: f"explode({_TEXTS})"},
    "jsonb_array_elements": {1: f"explode({_TEXTS})"},
    "json_array_elements_text": {1: f"explode({_TEXTS})"},
    "jsonb_array_elements_text": {1: f"explode({_TEXTS})"},
    "json_has_key": {2: "coalesce(array_contains(json_object_keys($1), $2), false)"},
    "json_has_any_key": {2: "coalesce(arrays_overlap(json_object_keys($1), $2), false)"},
    "json_has_all_keys": {2: "coalesce(size(array_except($2, json_object_keys($1))) = 0, false)"},
    "json_agg": {1: "to_json(transform(collect_list(struct($1 AS v)), s -> s.v))"},
    "jsonb_agg": {1: "to_json(transform(collect_list(struct($1 AS v)), s -> s.v))"},
    "json_object_agg": {2: _OBJECT},
    "jsonb_object_agg": {2: _OBJECT},
    "json_populate_record": {2: "from_json($2, $1)"},
    "json_to_record": {2: "from_json($1, $2)"},
    "jsonb_contains": {2: "pg_json_contains($1, $2)"},
    "jsonb_contained": {2: "pg_json_contains($2, $1)"},
    "json_strip_nulls": {1: "pg_json_strip_nulls($1)"},
    "jsonb_strip_nulls": {1: "pg_json_strip_nulls($1)"},
    "jsonb_pretty": {1: "pg_json_pretty($1)"},
    "jsonb_set": {3: "pg_json_set($1, $2, $3)"},
    "jsonb_insert": {3: "pg_json_insert($1, $2, $3, false)", 4: "pg_json_insert($1, $2, $3, $4)"},
    "jsonb_delete": {2: "pg_json_delete($1, $2)"},
    "jsonb_delete_path": {2: "pg_json_delete($1, $2)"},
}


def build_object(args: list[str]) -> str:
    """json_build_object of any number of pairs; names must be text literals or expressions."""
    names = [f"array({', '.join(args[0::2])})", f"array({', '.join(f'to_json(CAST({a} AS VARIANT))' for a in args[1::2])})"]
    return f"concat('{{', array_join(transform(arrays_zip({names[0]}, {names[1]}), p -> concat(to_json(CAST(CAST(p['0'] AS STRING) AS VARIANT)), ':', coalesce(p['1'], 'null'))), ','), '}}')"


def contains(a, b) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and contains(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return all(any(contains(x, y) for x in a) for y in b) if isinstance(b, list) else any(type(x) is type(b) and x == b for x in a)
    return type(a) is type(b) and a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b


def strip_nulls(x):
    if isinstance(x, dict):
        return {k: strip_nulls(v) for k, v in x.items() if v is not None}
    return [strip_nulls(v) for v in x] if isinstance(x, list) else x


def _steps(path: str) -> list[str]:
    return [p.strip().strip('"') for p in path.strip("{}").split(",")] if path.strip("{}") else []


def _reach(doc, steps: list[str], make: bool = False):
    """The container of the last step, or None."""
    for s in steps[:-1]:
        if isinstance(doc, dict):
            if s not in doc and make:
                doc[s] = {}
            doc = doc.get(s)
        elif isinstance(doc, list) and s.lstrip("-").isdigit() and -len(doc) <= int(s) < len(doc):
            doc = doc[int(s)]
        else:
            return None
    return doc


def set_path(doc, path: str, value):
    steps = _steps(path)
    at = _reach(doc, steps, True)
    if isinstance(at, dict) and steps:
        at[steps[-1]] = value
    elif isinstance(at, list) and steps[-1].lstrip("-").isdigit() and -len(at) <= int(steps[-1]) < len(at):
        at[int(steps[-1])] = value
    return doc


def insert_path(doc, path: str, value, after: bool):
    steps = _steps(path)
    at = _reach(doc, steps)
    if isinstance(at, dict) and steps[-1] not in at:
        at[steps[-1]] = value
    elif isinstance(at, list) and steps[-1].lstrip("-").isdigit() and -len(at) <= int(steps[-1]) <= len(at):
        i = int(steps[-1])
        at.insert((i if i >= 0 else len(at) + i) + bool(after), value)
    return doc


def delete_path(doc, path: str):
    steps = _steps(path)
    at = _reach(doc, steps)
    if isinstance(at, dict):
        at.pop(steps[-1], None)
    elif isinstance(at, list) and steps[-1].lstrip("-").isdigit() and -len(at) <= int(steps[-1]) < len(at):
        del at[int(steps[-1])]
    return doc


def _dump(x) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def _rows(f, *series: pd.Series) -> pd.Series:
    """Applies ``f`` to rows without nulls; documents that don't parse give null."""
    out = []
    for row in zip(*series):
        try:
            out.append(None if any(v is None for v in row) else f(*row))
        except (ValueError, TypeError):
            out.append(None)
    return pd.Series(out, dtype=object)


def register(spark: SparkSession) -> None:
    @F.pandas_udf("boolean")
    def pg_json_contains(a: pd.Series, b: pd.Series) -> pd.Series:
        return _rows(lambda x, y: contains(json.loads(x), json.loads(y)), a, b)

    @F.pandas_udf("string")
    def pg_json_strip_nulls(a: pd.Series) -> pd.Series:
        return _rows(lambda x: _dump(strip_nulls(json.loads(x))), a)

    @F.pandas_udf("string")
    def pg_json_pretty(a: pd.Series) -> pd.Series:
        return _rows(lambda x: json.dumps(json.loads(x), indent=2, ensure_ascii=False), a)

    @F.pandas_udf("string")
    def pg_json_set(a: pd.Series, p: pd.Series, v: pd.Series) -> pd.Series:
        return _rows(lambda x, y, z: _dump(set_path(json.loads(x), y, json.loads(z))), a, p, v)

    @F.pandas_udf("string")
    def pg_json_insert(a: pd.Series, p: pd.Series, v: pd.Series, after: pd.Series) -> pd.Series:
        return _rows(lambda x, y, z, w: _dump(insert_path(json.loads(x), y, json.loads(z), w)), a, p, v, after)

    @F.pandas_udf("string")
    def pg_json_delete(a: pd.Series, p: pd.Series) -> pd.Series:
        return _rows(lambda x, y: _dump(delete_path(json.loads(x), y)), a, p)

    for f in (pg_json_contains, pg_json_strip_nulls, pg_json_pretty, pg_json_set, pg_json_insert, pg_json_delete):
        spark.udf.register(f.__name__, f)

"""Date and time functions.  EXTRACT fields are doubles; weeks begin on Monday."""

_MICROS = "unix_micros(CAST($1 AS TIMESTAMP))"

#: EXTRACT field -> template over the value $1.
FIELDS = {
    "year": "year($1)",
    "month": "month($1)",
    "day": "day($1)",
    "hour": "hour($1)",
    "minute": "minute($1)",
    "second": "extract(second FROM $1)",
    "microseconds": f"pmod({_MICROS}, 60000000)",
    "milliseconds": f"pmod({_MICROS}, 60000000) / 1000",
    "epoch": f"{_MICROS} / 1000000D",
    "dow": "dayofweek($1) - 1",
    "isodow": "weekday($1) + 1",
    "doy": "dayofyear($1)",
    "quarter": "quarter($1)",
    "week": "weekofyear($1)",
    "isoyear": "extract(yearofweek FROM $1)",
    "decade": "year($1) div 10",
    "century": "(year($1) - 1) div 100 + 1",
    "millennium": "(year($1) - 1) div 1000 + 1",
}
#: date_trunc fields that Spark lacks: first year of the period.
PERIODS = {
    "decade": "year($1) div 10 * 10",
    "century": "(year($1) - 1) div 100 * 100 + 1",
    "millennium": "(year($1) - 1) div 1000 * 1000 + 1",
}


def extract(field: str, value: str) -> str:
    f = {"years": "year", "isoweek": "week", "timezone": "epoch"}.get(field.strip("'\"` ").lower(), field.strip("'\"` ").lower())
    if f not in FIELDS:
        raise ValueError(f"EXTRACT field {field} is not known")
    if f == "epoch" and value.lstrip("( ").startswith(("INTERVAL", "make_interval")):
        value = f"(timestamp_seconds(0) + {value})"
    return f"CAST({FIELDS[f].replace('$1', value)} AS DOUBLE)"


def date_trunc(field: str, value: str) -> str:
    f = field.strip("' ").lower()
    if f in PERIODS:
        return f"make_timestamp({PERIODS[f].replace('$1', value)}, 1, 1, 0, 0, 0)"
    return f"date_trunc('{f}', {value})"


TEMPLATES = {
    "now": {0: "current_timestamp()"},
    "age": {2: "($1) - ($2)", 1: "CAST(current_date() AS TIMESTAMP) - CAST($1 AS TIMESTAMP)"},
    "to_timestamp": {1: "timestamp_seconds($1)"},
    "epoch": {0: "timestamp_seconds(0)"},
    "make_date": {3: "make_date($1, $2, $3)"},
    "make_time": {3: "make_time($1, $2, $3)"},
    "pg_timestamp_from_text": {1: "to_timestamp($1)"},
    "pg_date_from_text": {1: "to_date($1)"},
    "pg_time_from_text": {1: "CAST($1 AS TIME(6))"},
    "datetime": {0: "date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')", 1: "date_format(CASE WHEN CAST($1 AS STRING) = 'now' THEN current_timestamp() ELSE try_cast($1 AS TIMESTAMP) END, 'yyyy-MM-dd HH:mm:ss')"},
    "strftime": {2: "date_format($2, replace(replace(replace(replace(replace(replace($1, '%Y', 'yyyy'), '%m', 'MM'), '%d', 'dd'), '%H', 'HH'), '%M', 'mm'), '%S', 'ss'))"},
}

"""Mathematical functions; domain errors raise as they do in PostgreSQL."""


def _guard(bad: str, value: str, message: str) -> str:
    return f"CASE WHEN {bad} THEN CAST(raise_error('{message}') AS DOUBLE) ELSE {value} END"


TEMPLATES = {
    "trunc": {
        1: "CASE WHEN $1 >= 0 THEN floor($1) ELSE ceil($1) END",
        2: "CASE WHEN $1 >= 0 THEN floor($1 * pow(10, $2)) ELSE ceil($1 * pow(10, $2)) END / pow(10, $2)",
    },
    "ceil": {1: "CAST(ceil($1) AS DOUBLE)"},
    "ceiling": {1: "CAST(ceil($1) AS DOUBLE)"},
    "floor": {1: "CAST(floor($1) AS DOUBLE)"},
    "sign": {1: "signum($1)"},
    "mod": {2: "($1) % ($2)"},
    "pow": {2: "power($1, $2)"},
    "sqrt": {1: _guard("$1 < 0", "sqrt($1)", "cannot take square root of a negative number")},
    "ln": {1: _guard("$1 <= 0", "ln($1)", "cannot take logarithm of a non-positive number")},
    # one argument: base 10, not natural
    "log": {
        1: _guard("$1 <= 0", "log10($1)", "cannot take logarithm of a non-positive number"),
        2: _guard("$1 <= 0 OR $1 = 1 OR $2 <= 0", "log($1, $2)", "logarithm is not defined"),
    },
    "asin": {1: _guard("abs($1) > 1", "asin($1)", "input is out of range")},
    "acos": {1: _guard("abs($1) > 1", "acos($1)", "input is out of range")},
    "random": {0: "rand()"},
    # integers divide like integers
    "div": {2: "($1) div ($2)"},
}

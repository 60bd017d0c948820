"""Exact decimal functions.  Bare numeric is decimal(38,9)."""

TEMPLATES = {
    "decimal_from_text": {1: "CAST($1 AS DECIMAL(38,9))"},
    "decimal_to_text": {1: "CAST($1 AS STRING)"},
    "decimal_add": {2: "($1) + ($2)"},
    "decimal_sub": {2: "($1) - ($2)"},
    "decimal_mul": {2: "($1) * ($2)"},
    "decimal_div": {2: "($1) / ($2)"},
    # comparisons of this family are two-valued
    "decimal_eq": {2: "($1) <=> ($2)"},
    "decimal_lt": {2: "coalesce(($1) < ($2), false)"},
    "decimal_gt": {2: "coalesce(($1) > ($2), false)"},
    "numeric_format": {3: "CAST(CAST($1 AS DECIMAL(38,$3)) AS STRING)"},
    # too many decimals or integer digits are errors, never rounded away
    "numeric_cast": {
        3: "CASE WHEN CAST($1 AS DECIMAL(38,12)) <> round(CAST($1 AS DECIMAL(38,12)), $3) THEN CAST(raise_error('numeric field overflow: too many decimals') AS DECIMAL($2,$3))"
        " WHEN abs(CAST($1 AS DECIMAL(38,12))) >= power(10, $2 - $3) THEN CAST(raise_error('numeric field overflow') AS DECIMAL($2,$3)) ELSE CAST($1 AS DECIMAL($2,$3)) END"
    },
    "decimal_round": {2: "bround($1, $2)"},
    "decimal_abs": {1: "abs($1)"},
}

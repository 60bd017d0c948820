"""String functions."""

TEMPLATES = {
    # fields below 1 and past the end are empty
    "split_part": {3: "CASE WHEN $3 < 1 THEN '' ELSE split_part($1, $2, greatest($3, 1)) END"},
    "string_agg": {2: "listagg(CAST($1 AS STRING), $2)"},
    "chr": {1: "CASE WHEN $1 BETWEEN 1 AND 1114111 AND NOT ($1 BETWEEN 55296 AND 57343) THEN decode(unhex(lpad(hex(CAST($1 AS BIGINT)), 8, '0')), 'UTF-32') ELSE '' END"},
    "left": {2: "CASE WHEN $2 <= 0 THEN '' ELSE left($1, $2) END"},
    "right": {2: "CASE WHEN $2 <= 0 THEN '' ELSE right($1, $2) END"},
    "lpad": {2: "lpad($1, $2, ' ')"},
    "rpad": {2: "rpad($1, $2, ' ')"},
    "regexp": {2: "rlike($2, $1)"},
    "regexpi": {2: "rlike($2, concat('(?i)', $1))"},
    "strpos": {2: "instr($1, $2)"},
}

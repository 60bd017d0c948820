"""Array functions.  Positions count from 1."""

TEMPLATES = {
    "array_length": {1: "size($1)", 2: "CASE $2 WHEN 1 THEN size($1) END"},
    "array_upper": {2: "CASE $2 WHEN 1 THEN size($1) END"},
    "array_lower": {2: "CASE WHEN $2 = 1 AND size($1) > 0 THEN 1 END"},
    "array_ndims": {1: "CAST(length(regexp_replace(typeof($1), '[^<]', '')) AS INT)"},
    "array_prepend": {2: "array_prepend($2, $1)"},
    "array_cat": {2: "concat($1, $2)"},
    "array_remove": {2: "filter($1, e -> NOT (e <=> $2))"},
    "array_replace": {3: "transform($1, e -> CASE WHEN e <=> $2 THEN $3 ELSE e END)"},
    "array_contains": {2: "coalesce(size(array_except($2, $1)) = 0, false)"},
    "array_contained": {2: "coalesce(size(array_except($1, $2)) = 0, false)"},
    "array_overlap": {2: "coalesce(size(array_intersect($1, $2)) > 0, false)"},
    "array_slice": {3: "CASE WHEN $3 < greatest($2, 1) THEN slice($1, 1, 0) ELSE slice($1, greatest($2, 1), $3 - greatest($2, 1) + 1) END"},
    "array_position": {2: "nullif(array_position($1, $2), 0)"},
    "array_positions": {2: "filter(transform($1, (e, i) -> CASE WHEN e <=> $2 THEN i + 1 END), v -> v IS NOT NULL)"},
    # nulls stay: they travel inside structs
    "array_agg": {1: "transform(collect_list(struct($1 AS v)), s -> s.v)"},
    "array_agg_distinct": {1: "transform(array_sort(collect_set(struct(CAST($1 AS STRING) AS v))), s -> s.v)"},
    "string_to_array": {2: "CASE WHEN $1 = '' THEN array() WHEN $2 = '' THEN split($1, '') ELSE split($1, concat('\\\\Q', $2, '\\\\E')) END"},
    "array_to_string": {2: "array_join($1, $2)", 3: "array_join($1, $2, $3)"},
    "validate_array_for_unnest": {1: "CASE WHEN try_parse_json($1) IS NOT NULL AND schema_of_variant(try_parse_json($1)) LIKE 'ARRAY%' THEN $1 END"},
    "cardinality": {1: "size($1)"},
}

"""The library's cell and name functions under names of their own in SQL. They are SQL bodies, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import names as N

_TAGLESS = rf"trim(regexp_replace(x, '(?i)\\s*\\(({N.TAGS})\\)\\s*$', ''))"
_quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
_FOLDED = f"translate(regexp_replace(upper(replace({_TAGLESS}, 'ß', 'ss')), '[\\\\x{{0300}}-\\\\x{{036F}}]', ''), {_quoted(N.ACCENTED)}, {_quoted(N.PLAIN)})"

#: name: (parameters, result, body).
FUNCTIONS = {
    "flow_name": ("x STRING", "STRING", f"trim(regexp_replace(regexp_replace(replace({_FOLDED}, '&', ' AND '), '\\'S(?![A-Za-z0-9_])', 'S'), '[^A-Z0-9]+', ' '))"),
    "flow_slug": ("x STRING", "STRING", "regexp_replace(lower(x), '[^a-z0-9]+', '-')"),
    "flow_amount": ("x STRING", "DECIMAL(16,2)", "CAST(CASE WHEN trim(regexp_replace(x, '[$,]', '')) RLIKE '^-?\\\\d+(\\\\.\\\\d+)?$' THEN try_cast(trim(regexp_replace(x, '[$,]', '')) AS DECIMAL(38,18)) END AS DECIMAL(16,2))"),
    "flow_day": ("x STRING", "DATE", "CASE WHEN year(coalesce(try_to_date(CASE WHEN trim(x) RLIKE '^\\\\d{4}-\\\\d{2}-\\\\d{2}' THEN substring(trim(x), 1, 10) END, 'yyyy-MM-dd'), try_to_date(CASE WHEN trim(x) RLIKE '^\\\\d{1,2}/\\\\d{1,2}/\\\\d{4}$' THEN trim(x) END, 'M/d/yyyy'))) BETWEEN 1800 AND 2200 THEN coalesce(try_to_date(CASE WHEN trim(x) RLIKE '^\\\\d{4}-\\\\d{2}-\\\\d{2}' THEN substring(trim(x), 1, 10) END, 'yyyy-MM-dd'), try_to_date(CASE WHEN trim(x) RLIKE '^\\\\d{1,2}/\\\\d{1,2}/\\\\d{4}$' THEN trim(x) END, 'M/d/yyyy')) END"),
    "flow_id": ("x STRING", "STRING", "substring(sha2(x, 256), 1, 32)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to this session's SQL; their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)

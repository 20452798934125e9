"""SQL functions: ``matching_lines(text, pattern)``, and the table functions ``search_lines`` and ``trigrams``.

They are macros of built-in functions, so a query that uses them has no Python in its
plan. For tables, use the array: ``select id, inline(found) from (select id,
matching_lines(text, 'pattern') as found from t)``; a table function that is given a
column of another table is joined to it by Spark.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the engine refuses, or reads in another way than Java does: back references, look-around, atomic groups, POSIX classes, ``(?P``.
_REFUSED = r"\\\\[1-9]|\\(\\?[=!>P]|\\(\\?<[=!]|\\[:\\^?[a-z]+:\\]|\\\\[kKQEGZR]"
_LINES = r"""
filter(transform(slice(parts, 1, size(parts) - cast(element_at(parts, -1) = '' as int)), (x, i) -> named_struct('line_no', cast(i + 1 as bigint), 'line', x)),
  s -> regexp_like(s.line, case when regexp_like(pattern, '{refused}') then raise_error(concat('PatternError: not read alike everywhere: ', pattern)) else concat('(?Ud)', pattern) end))"""
_PARTS = r"split(substring_index(coalesce(text, ''), '\0', 1), '\n', -1)"
_TRIGRAMS = r"array_distinct(transform(sequence(1, greatest(octet_length(text) - 2, 0), 1), i -> cast(conv(substring(hex(cast(text as binary)), 2 * i - 1, 6), 16, 10) as int)))"


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    found = _LINES.format(refused=_REFUSED).replace("parts", _PARTS)
    spark.sql(f"create or replace temporary function matching_lines(text string, pattern string) returns array<struct<line_no: bigint, line: string>> return {found}")
    spark.sql(f"create or replace temporary function search_lines(text string, pattern string) returns table(line_no bigint, line string) return select line_no, line from inline({found})")
    grams = f"case when octet_length(text) > 2 then {_TRIGRAMS} else cast(array() as array<int>) end"
    spark.sql(f"create or replace temporary function trigrams(text string) returns table(tri int) return select tri from explode({grams}) as t(tri)")

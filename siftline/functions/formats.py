"""Short forms of counts, sizes and durations, as columns and plain values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_count(n: Column) -> Column:
    """758, 93.6k, 1.5m; what would round to 1000.0k is 1.0m."""
    k = n / 1000.0
    return F.when(n < 1000, n.cast("string")).when(k < 999.95, F.format_string("%.1fk", k)).otherwise(F.format_string("%.1fm", n / 1e6))


def human_bytes(n: Column) -> Column:
    """512 B, 1.0 MB; steps of 1024 up to GB."""
    out = F.format_string("%.1f GB", F.bround(n / float(1 << 30), 1))
    for power, unit in ((2, "MB"), (1, "KB")):
        v = n / float(1 << 10 * power)
        out = F.when(v < 1023.95, F.format_string(f"%.1f {unit}", F.bround(v, 1))).otherwise(out)
    return F.when(n < 1023.95, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def human_duration(seconds: Column) -> Column:
    """59s, 5m7s, 3h20m, 2d4h."""
    s = seconds.cast("long")
    part = lambda unit, of: F.floor(s % of / unit).cast("string")
    whole = lambda unit: F.floor(s / unit).cast("string")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(whole(60), F.lit("m"), (s % 60).cast("string"), F.lit("s")))
        .when(s < 86400, F.concat(whole(3600), F.lit("h"), part(60, 3600), F.lit("m")))
        .otherwise(F.concat(whole(86400), F.lit("d"), part(3600, 86400), F.lit("h")))
    )


def shell_quote(text: Column) -> Column:
    """A text as one word of a POSIX shell."""
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.when(text.rlike(r"\A[A-Za-z0-9_@%+=:,./-]+\z"), text).otherwise(quoted)

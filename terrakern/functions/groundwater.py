"""Groundwater as depth below ground and as head above sea level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How logs write a level, and that there is none.
_LEVEL = r"(?:지하수위|water[_\s-]*(?:level(?:[_\s-]*gl)?|gl))['\"]?\s*[:=]\s*['\"]?\s*"
DEPTH = r"(?i)" + _LEVEL + r"(?:GL\s*\(?\s*[-+]?\s*\)?\s*)?(-?\d+(?:\.\d+)?)"
NO_LEVEL = r"(?i)" + _LEVEL + r"(?:N/?A|NONE|NULL|-)(?:['\",}\s]|$)"
#: Rank of a review status; those left out rank 0. Two take no part.
STATUS_RANK = {"confirmed": 3, "approved": 3, "auto": 2, "needs_review": 1}
REFUSED = ("rejected", "excluded")


def normalized(elevation: Column, depth: Column, head: Column, tolerance: float = 0.25) -> Column:
    """struct<depth, head, inconsistent>: each level filled from the other, a depth below zero refused."""
    below = F.coalesce(F.abs(depth), elevation - head)
    above = F.coalesce(head, elevation - below)
    wrong = F.coalesce(below < 0, F.lit(False))
    apart = F.coalesce(F.abs(elevation - below - above) > tolerance, F.lit(False))
    return F.struct(F.when(~wrong, below).alias("depth"), above.alias("head"), (wrong | apart).alias("inconsistent"))


def by_datum(datum: Column, elevation: Column, depth: Column, head: Column) -> Column:
    """struct<depth, head>: the side that the datum measures is kept, the other follows from the elevation."""
    from_depth, from_head = elevation - depth, elevation - head
    return F.struct(
        F.when((datum == "EL") & from_head.isNotNull(), from_head).when((datum == "GL") & from_depth.isNotNull(), depth).otherwise(F.coalesce(depth, from_head)).alias("depth"),
        F.when((datum == "GL") & from_depth.isNotNull(), from_depth).when((datum == "EL") & from_head.isNotNull(), head).otherwise(F.coalesce(head, from_depth)).alias("head"),
    )


def status_rank(status: Column) -> Column:
    out = F.lit(0)
    for name, rank in STATUS_RANK.items():
        out = F.when(status == name, F.lit(rank)).otherwise(out)
    return out


def depth_in_text(raw: Column) -> Column:
    """Depth written in a log's text, or null where there is none, or it is said to be missing, or below zero."""
    text = F.coalesce(raw, F.lit(""))
    found = F.when(~text.rlike(NO_LEVEL), F.regexp_extract(text, DEPTH, 1).try_cast("double"))
    return F.when(found >= 0, found)

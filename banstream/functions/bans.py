"""Ban times and their expiry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = (1 << 63) - 1
#: The doubling stops here.
MOST_DOUBLINGS = 20


def calc_ban_time(base: Column, count: Column, increment: Column, factor: Column, multipliers: Column, maxtime: Column) -> Column:
    """The ban time of an address with ``count`` earlier bans: base times 2^count, or the count-th multiplier, times factor.

    A negative base is permanent and stays; ``maxtime`` over 0 is a cap.
    """
    doubled = F.pow(F.lit(2.0), F.least(count, F.lit(MOST_DOUBLINGS)))
    listed = F.element_at(multipliers, (F.least(count, F.size(multipliers) - 1) + 1).cast("int")).cast("double")
    raised = base.cast("double") * F.when(F.size(multipliers) > 0, listed).otherwise(doubled) * factor
    # what does not fit is the longest time there is
    whole = F.when(raised >= float(LONGEST), F.lit(LONGEST)).when(raised <= -float(LONGEST), F.lit(-LONGEST)).otherwise(raised.try_cast("long"))
    capped = F.when(maxtime > 0, F.least(whole, maxtime)).otherwise(whole)
    return F.when(~increment | (base < 0), base.cast("long")).otherwise(capped)


def ban_expiry(at: Column, ban_time: Column) -> Column:
    """When a ban ends; NULL for a permanent one."""
    return F.when(ban_time >= 0, F.coalesce(F.try_add(at, ban_time), F.lit(LONGEST)))

"""Names and timestamps as text: validity, splitting, strict ISO round trips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import normal_text
from .scalars import c

PG_IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_$]{0,62}$"
ISO_FORM = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"


def valid_identifier(x) -> Column:
    """A plain identifier that needs no quoting."""
    return F.coalesce(c(x).rlike(PG_IDENTIFIER), F.lit(False))


def valid_scoped_name(x) -> Column:
    """1..128 characters, normalised, no control characters."""
    t = c(x)
    return F.coalesce((F.length(t) > 0) & (F.length(t) <= 128) & ~t.rlike(r"[\x00-\x1f\x7f]") & (normal_text(t) == t), F.lit(False))


def strict_iso(x) -> Column:
    """Timestamp of a millisecond ISO text in UTC that survives the round trip; null for any other text."""
    t = c(x)
    local = F.regexp_replace(F.regexp_replace(t, "T", " "), "Z$", "")
    ts = F.when(t.rlike(ISO_FORM), F.try_to_timestamp(local, F.lit("yyyy-MM-dd HH:mm:ss.SSS")).cast("timestamp_ntz"))
    return F.when(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") == t, ts)


def stale_after(observed, seconds) -> Column:
    """When an observation of this age limit goes stale."""
    return c(observed) + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))

"""Event expressions: keys, coercion, time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stream_key(service: Column, session: Column) -> Column:
    """``service:session``; an absent service is ``unknown``, an absent session is empty."""
    return F.concat(
        F.coalesce(F.nullif(service, F.lit("")), F.lit("unknown")),
        F.lit(":"),
        F.coalesce(session, F.lit("")),
    )


def path_key(service: Column, session: Column) -> Column:
    """``service/session``, or the bare service when the session is absent."""
    session = F.coalesce(session, F.lit(""))
    return F.when(session == "", service).otherwise(F.concat_ws("/", service, session))


def safe_timestamp(ts: Column) -> Column:
    """Epoch seconds as double; text that is no number, NaN and null become 0."""
    value = ts.try_cast("double")
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def coalesce_token(token: Column, template: Column) -> Column:
    """Token id, else template id, else 1; zero counts as absent."""
    return F.coalesce(F.nullif(token, F.lit(0)), F.nullif(template, F.lit(0)), F.lit(1)).cast("int")


def epoch_to_timestamp(epoch: Column) -> Column:
    """Timestamp of a UTC epoch in seconds, to the microsecond."""
    return F.timestamp_micros(F.round(epoch * 1e6).cast("bigint"))


def severity_by_ratio(score: Column, threshold: Column, buckets: dict[str, float] | None = None) -> Column:
    """Severity of ``score / threshold``; the highest multiplier reached wins, else ``low``."""
    # Default multipliers.
    buckets = buckets or {"critical": 1.5, "high": 1.2, "medium": 1.0}
    ratio = score / F.greatest(threshold, F.lit(1e-9))
    chain = F
    for name, multiplier in sorted(buckets.items(), key=lambda b: -b[1]):
        chain = chain.when(ratio >= multiplier, name)
    return chain.otherwise("low")

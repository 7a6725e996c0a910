"""Column expressions for log fields."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuescope import vocab


def nanos(text: Column) -> Column:
    """Nanoseconds since the epoch of ``yyyy-MM-dd HH:mm:ss[.f{1,9}]`` text, read as UTC.

    TIMESTAMP keeps microseconds only, so order and differences use this BIGINT.
    """
    seconds = F.unix_seconds(F.concat(F.substring(text, 1, 19), F.lit("Z")).try_cast("timestamp"))
    fraction = F.rpad(F.regexp_extract(text, r"\.([0-9]{1,9})", 1), 9, "0")
    return seconds * F.lit(1_000_000_000) + fraction.cast("bigint")


def nanos_of_timestamp(df: DataFrame, name: str) -> Column:
    """Nanoseconds since the epoch of a timestamp column; a zone-free one is read as UTC."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        instant = F.to_utc_timestamp(F.col(name).cast("timestamp"), F.current_timezone())
    else:
        instant = F.col(name)
    return F.unix_micros(instant) * F.lit(1000)


def display_time(ns: Column) -> Column:
    """TIMESTAMP_NTZ (microseconds) for reading; never used for order."""
    utc = F.timestamp_micros(F.call_function("div", ns, F.lit(1000)))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), utc.cast("timestamp_ntz"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (later - earlier) / F.lit(1e9)


def trace_id(own: Column, span: Column) -> Column:
    """The record's own trace id, else the one of its span."""
    return F.coalesce(own, span)


def base_function(fqdn: Column) -> Column:
    """``cupy-4-0.0.1`` -> ``cupy``; NULL where the name starts with a digit."""
    stem = F.regexp_extract(fqdn, vocab.BASE_FUNCTION_PATTERN, 1)
    return F.nullif(F.btrim(stem, F.lit("-")), F.lit(""))


def status_flags(status: Column) -> dict[str, Column]:
    """0/1 flag per known queue state; an unknown state sets none."""
    return {
        f"is_status_{s}": F.coalesce((status == s).cast("int"), F.lit(0))
        for s in vocab.QUEUE_STATES
    }


def policy_name(label: Column) -> Column:
    """Policy without its parameter: ``WeightedRandom_0.5`` -> ``WeightedRandom``."""
    return F.regexp_replace(label, r"_[0-9.]+$", "")


def policy_flags(label: Column) -> dict[str, Column]:
    """0/1 flag per known policy."""
    name = policy_name(label)
    return {
        f"policy_{p}": F.coalesce((name == p).cast("int"), F.lit(0)) for p in vocab.POLICIES
    }


def log_target(latency: Column) -> Column:
    return F.log1p(latency)


def from_log_target(predicted: Column) -> Column:
    return F.expm1(predicted)


def error_columns(actual: Column, predicted: Column) -> dict[str, Column]:
    """Absolute, squared and percentage error; the last is NULL where ``actual`` is 0."""
    gap = actual - predicted
    return {
        "absolute_error": F.abs(gap),
        "squared_error": gap * gap,
        "percentage_relative_error": F.try_divide(gap, actual) * F.lit(100.0),
    }

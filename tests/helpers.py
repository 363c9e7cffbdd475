import datetime as dt

T0 = dt.datetime(2024, 3, 20, 0, 0)


def at(minutes: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


def frame(spark, rows, schema):
    """Rows with datetimes as wall-clock times."""
    return spark.createDataFrame(rows, schema)


def minutes_series(spark, values, step=10, site="a", start=0):
    """values: {minute: value} -> (site, ts, x)"""
    return frame(spark, [(site, at(start + m), v) for m, v in values.items()], "site string, ts timestamp_ntz, x double")


def rows(df, *cols, order=None):
    out = df.select(*cols).collect()
    return sorted([tuple(r) for r in out], key=lambda r: tuple("" if v is None else str(v) for v in r)) if order is None else [tuple(r) for r in df.orderBy(*order).select(*cols).collect()]

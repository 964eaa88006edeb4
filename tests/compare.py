"""Rows of two engines, made comparable."""


def plain(value):
    """A value as both engines have it."""
    if value is None or value != value:
        return None
    if isinstance(value, bool) or type(value).__name__ in ("bool", "bool_"):
        return bool(value)
    if hasattr(value, "item"):
        value = value.item()
    return value


def rows_of(frame):
    columns = sorted(frame.columns)
    return sorted(repr(tuple(plain(x) for x in row)) for row in frame[columns].itertuples(index=False, name=None))

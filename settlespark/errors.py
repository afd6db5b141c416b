"""Errors raised by guards."""


class GuardError(ValueError):
    """A data rule was broken."""


class MissingColumns(KeyError):
    """A table lacks required columns."""


def need_columns(df, columns, label="table"):
    """Check column presence on the schema; nothing is executed."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise MissingColumns(f"{label} lacks columns {absent}")
    return df

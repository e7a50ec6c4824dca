"""Rows of a frame in a form that tests compare."""


def values(df, *order):
    """Rows as plain tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=repr)

def bag(df, *columns):
    """A DataFrame's rows as a sorted list."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

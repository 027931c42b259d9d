def rows(df, *columns):
    """Rows as plain tuples, in a stable order."""
    df = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=repr)

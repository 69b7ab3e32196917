"""Small helpers shared by the tests."""


def rows(df, *order):
    """Rows as tuples, sorted with NULLs last; by ``order`` columns if given."""
    picked = df.select(*order) if order else df
    found = [tuple(r) for r in picked.collect()]
    return sorted(found, key=lambda r: tuple((v is None, 0 if v is None else v) for v in r))


def plan(df):
    """The physical plan text after running the query."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()

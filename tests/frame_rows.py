"""Rows of a DataFrame in a form that tests can compare."""


def rows_of(df, digits=7):
    def plain(v):
        if isinstance(v, float):
            return None if v != v else round(v, digits) + 0.0
        return v

    cols = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)

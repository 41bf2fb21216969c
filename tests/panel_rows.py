"""Small helpers of the panel tests; not in conftest.py, whose name another test folder may hold."""


def by_key(df, *columns):
    """{(country, brand_name, months_postgx): row} for small frames."""
    return {(r["country"], r["brand_name"], r["months_postgx"]): r for r in df.collect()}

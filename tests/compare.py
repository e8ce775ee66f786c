"""Running queries beside their SQL on the smallest test tables."""

from __future__ import annotations

from pathlib import Path

FOLDER = Path("/root/testdata/sf0.001")


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows)


def differences(spark, queries, sql):
    """The names of queries that fail or whose rows aren't those of their SQL, with a word on why."""
    import duckdb

    con = duckdb.connect()
    for file in FOLDER.iterdir():
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    wrong = {}
    for name, query in queries.items():
        frame = query(spark, str(FOLDER))
        got = frame.collect()
        if name in sql:
            result = con.execute(sql[name])
            names = [c[0] for c in result.description]
            if sorted(names) != sorted(frame.columns):
                wrong[name] = f"columns {frame.columns} and {names}"
            elif rows_of(frame.columns, got) != rows_of(names, result.fetchall()):
                wrong[name] = "rows"
    return wrong

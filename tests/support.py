"""Comparison with DuckDB over one folder of tables."""

import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    """Rows as comparable text, columns by name, doubles to six digits."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    shown = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return [columns[k] for k in order], sorted(tuple(shown(r[k]) for k in order) for r in rows)


def same_as_sql(query, sql, spark, duck, folder=SF):
    found = query(spark, folder)
    ours = canonical([tuple(r) for r in found.collect()], found.columns)
    result = duck.execute(sql)
    theirs = canonical(result.fetchall(), [d[0] for d in result.description])
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
    return len(ours[1])

"""Compare queries of the folder with their SQL twins: ``python tests/llm/compare.py folder [query ...]``."""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from check import connect, local_session, rows_of

from quern.llm.queries import ORACLES, QUERIES


def compare(spark, con, name, sf_dir):
    """An empty text if both sides agree, else the first difference."""
    df = QUERIES[name](spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return "" if ours else "no rows"
    relation = con.sql(ORACLES[name])
    theirs = rows_of(relation.columns, relation.fetchall())
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} != {sorted(relation.columns)}"
    if ours != theirs:
        odd = next(((a, b) for a, b in zip(ours, theirs) if a != b), None)
        return f"{len(ours)} and {len(theirs)} rows, first difference {odd}"
    return ""


if __name__ == "__main__":
    session, connection = local_session(), connect(sys.argv[1])
    for query in sys.argv[2:] or list(QUERIES):
        began = time.time()
        said = compare(session, connection, query, sys.argv[1])
        print("FAIL" if said else "ok", query, f"{time.time() - began:.1f}s", said, flush=True)

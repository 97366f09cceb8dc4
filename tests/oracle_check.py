"""Compare registered queries with their SQL on one scale: python tests/oracle_check.py DIR [name…]"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from keelson.plans.oracles import ORACLES  # noqa: E402
from keelson.plans.queries import QUERIES  # noqa: E402
from keelson.session import local_session  # noqa: E402


def connect(sf_dir):
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def plain(value):
    if value is None or value != value:
        return None
    return str(value)[:10] if hasattr(value, "year") else value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    values = [tuple(plain(r[i]) for i in order) for r in records]
    return [columns[i] for i in order], sorted(values, key=repr)


def compare(spark, db, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    got = rows(frame.columns, frame.collect())
    if name not in ORACLES:
        return "rows only", len(got[1]), None
    result = db.execute(ORACLES[name])
    want = rows([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return "COLUMNS", len(got[1]), (got[0], want[0])
    if got[1] == want[1]:
        return "ok", len(got[1]), None
    a = [x for x in got[1] if x not in set(want[1])][:3] if len(got[1]) < 50000 else "many"
    b = [x for x in want[1] if x not in set(got[1])][:3] if len(got[1]) < 50000 else "many"
    return "DIFFERENT", (len(got[1]), len(want[1])), (got[0], a, b)


if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    session = local_session("oracle", memory="12g")
    session.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    for name in names:
        start = time.time()
        try:
            state, n, detail = compare(session, db, sf_dir, name)
        except Exception as problem:  # report and go on with the next query
            state, n, detail = "FAILED", 0, str(problem)[:1500]
        print(f"{name:28} {state:10} {n} {time.time() - start:.1f}s", detail or "", flush=True)

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from quillspark.session import local_session

    session = local_session("tests", cores="4", shuffle=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).exists():
        pytest.skip("no test tables here")
    return SF


@pytest.fixture(scope="session")
def sql(sf):
    """Runs SQL over the test tables and gives column names and rows."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")

    def run(text):
        got = con.execute(text)
        return [c[0] for c in got.description], got.fetchall()

    return run


def rows(columns, values):
    """Rows in one order and form, columns by name; numbers to six places."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    form = lambda v: None if v is None else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(form(v[i]) for i in order) for v in values), key=repr)

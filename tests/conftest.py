import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from stockflow.session import session

    folder = tmp_path_factory.mktemp("spark")
    conf = {"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.local.dir": f"{folder}/local", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.checkpoint.dir": f"file://{folder}/shared"}
    spark = session("tests", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def canonical(df):
    """Rows as sorted tuples of text, columns by name; whole floats and integers are alike, nulls too."""
    import datetime
    import math

    def text(x):
        if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("NaT", "<NA>"):
            return ""
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else f"{x:.6f}"
        if isinstance(x, datetime.datetime) and (x.hour, x.minute, x.second, x.microsecond) == (0, 0, 0, 0):
            return str(x.date())
        return str(x)

    df = df.reindex(sorted(df.columns), axis=1).astype(object)
    return list(df.columns), sorted(tuple(map(text, r)) for r in df.itertuples(index=False))

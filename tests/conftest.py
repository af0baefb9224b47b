import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
    session = builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare():
    """Compares a DataFrame with DuckDB SQL over the Parquet files of a folder."""
    import duckdb

    def rows(columns, values):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(repr(tuple(round(v[i], 9) if isinstance(v[i], float) else v[i] for i in order)) for v in values)

    def check(df, sql, folder):
        con = duckdb.connect(config={"memory_limit": "8GB"})
        for path in Path(folder).glob("*.parquet"):
            files = f"{path}/*.parquet" if path.is_dir() else str(path)
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names)
        mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, found.fetchall())
        assert mine == theirs

    return check

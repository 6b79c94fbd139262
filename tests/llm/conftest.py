import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    import cases

    return cases.saved(spark, str(tmp_path_factory.mktemp("tables")))


@pytest.fixture(scope="session")
def empty(spark, folder, tmp_path_factory):
    """The same tables without rows."""
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "pages"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{path}/{t}.parquet")
    return path

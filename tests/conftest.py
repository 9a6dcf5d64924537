import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from strataleaf.session import session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    yield spark
    spark.stop()

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wellspring.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.default.parallelism": "4", "spark.sql.maxMetadataStringLength": "10000", "spark.sql.debug.maxToStringFields": "1000"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def three_wells(spark):
    return spark.createDataFrame(
        [("WELL_001", 80.5, 5000, "Sandstone", "Clay & Iron"), ("WELL_002", 120.3, 12000, "Carbonate", None),
         ("WELL_003", None, 8000, None, "Fluid Loss")],
        "Well_ID string, Temperature_C double, Pressure_psi long, Formation string, Damage_Type string")

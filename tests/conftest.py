import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from sparkdex.common import ship_package

    ship_package(s)
    yield s
    s.stop()


@pytest.fixture
def engine(spark, tmp_path):
    from sparkdex.plans.engine import Engine

    return Engine(spark, "file://" + str(tmp_path / "warehouse"))


@pytest.fixture
def write(tmp_path):
    def f(name, text, encoding="utf-8"):
        p = tmp_path / name
        p.write_bytes(text.encode(encoding))
        return str(p)

    return f

import pytest

from provenio.session import session


@pytest.fixture(scope="session")
def spark():
    made = session("local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_memory="4g", spark_ui_showConsoleProgress="false")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()

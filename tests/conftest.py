import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from arbora import build_graph, configure  # noqa: E402
from arbora.session import release  # noqa: E402
from arbora.schema import LINK_FIELDS, ORG_FIELDS, PERSON_FIELDS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def make_graph(spark):
    """Graph from short lists: persons (id or dict), orgs (id or (id, label)), links (source, target)."""

    def make(persons, orgs, links):
        people = []
        for n, p in enumerate(persons):
            p = p if isinstance(p, dict) else {"id": p}
            people.append((p.get("id"), p.get("label"), p.get("email"), p.get("basis", False), n))
        units = [(o, None, n) if isinstance(o, str) else (o[0], o[1], n) for n, o in enumerate(orgs)]
        ends = [(s, t, n) for n, (s, t) in enumerate(links)]
        return build_graph(
            spark.createDataFrame(people, PERSON_FIELDS),
            spark.createDataFrame(units, ORG_FIELDS),
            spark.createDataFrame(ends, LINK_FIELDS),
        )

    return make


@pytest.fixture(scope="session")
def roots_of(spark):
    def make(*ids):
        return spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "root_id STRING, root_ord BIGINT")

    return make


@pytest.fixture(scope="session")
def sf():
    """Folder of the smallest tables."""
    return "/root/testdata/sf0.001"

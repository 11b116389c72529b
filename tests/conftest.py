import functools
import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for the Python workers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from netdrift.session import get_session
    from netdrift.sources import panels

    shared = tmp_path_factory.mktemp("shared")
    session = get_session("tests", "local[4]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=str(shared), spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    # the tables that nearly all queries begin with are made once a session
    for name in ("nation_panels", "shipping_panel", "region_flows", "nation_flows"):
        setattr(panels, name, functools.cache(lambda spark, sf_dir, make=getattr(panels, name): make(spark, sf_dir).coalesce(4).cache()))
    yield session
    session.stop()

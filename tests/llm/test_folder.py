"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from hushframe.llm.common import shared_folder


def test_no_local_folder_on_a_cluster():
    unset = SimpleNamespace(isDefined=lambda: False)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        sc = SimpleNamespace(master=master, _jsc=jsc, getConf=lambda: SimpleNamespace(get=lambda key: None))
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default=None: default)))

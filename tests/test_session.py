from types import SimpleNamespace

import pytest

from concord.session import CHECKPOINT_DIR, pinned, shared_dir


def test_the_session_names_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get(CHECKPOINT_DIR)
    assert pinned(spark.range(3)).count() == 3


def test_a_cluster_must_name_one():
    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: conf, master="yarn")
    with pytest.raises(ValueError, match=CHECKPOINT_DIR):
        shared_dir(SimpleNamespace(sparkContext=context, conf=conf))

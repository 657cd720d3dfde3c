from types import SimpleNamespace

import pytest
from tallyforge.llm.shared import shared_dir


def session(master, **settings):
    return SimpleNamespace(conf=SimpleNamespace(get=settings.get), sparkContext=SimpleNamespace(master=master))


def test_shared_folder():
    given = {"spark.checkpoint.dir": "file:///somewhere/"}
    assert shared_dir(session("spark://host:7077", **given)).startswith("file:///somewhere/tallyforge-")
    assert shared_dir(session("local[2]")).startswith("file:///")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077"))

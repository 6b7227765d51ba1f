import pytest

from tidemark import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Fake:
    """As much of a session as shared_folder looks at."""

    def __init__(self, master, application, **conf):
        self.master, self.applicationId, self.conf = master, application, Conf({k.replace("__", "."): v for k, v in conf.items()})
        self.sparkContext = self

    def getConf(self):
        return self.conf


def test_shared_folder_is_the_sessions():
    assert session.shared_folder(Fake("spark://x", "a1", spark__checkpoint__dir="hdfs://n/c/")) == "hdfs://n/c"


def test_own_folder_only_where_all_is_one_machine():
    local = Fake("local[2]", "a2")
    first = session.shared_folder(local)
    assert first.startswith("file://") and session.shared_folder(local) == first
    assert session.shared_folder(Fake("local[2]", "a3")) != first
    with pytest.raises(ValueError):
        session.shared_folder(Fake("spark://x", "a4"))


def test_scratch_paths_differ(spark):
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")

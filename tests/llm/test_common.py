"""The shared folder."""

import pytest

from corpusloom.llm import common


class Session:
    """The settings of a session alone."""

    def __init__(self, **settings):
        self.settings = settings
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_staging_takes_the_shared_folder():
    assert common.shared_root(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", ""])
def test_no_local_folder_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_root(Session(**{"spark.master": master}))


def test_own_folder_in_a_local_session(spark):
    assert common.shared_root(Session(**{"spark.master": "local[4]"})).startswith("file:///")
    assert common.shared_root(spark)

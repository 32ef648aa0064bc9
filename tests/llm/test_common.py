import pytest

from verdance.llm import common


class Conf:
    def __init__(self, values):
        self.values = values

    def get(self, name, default=None):
        return self.values.get(name, default)


class Session:
    def __init__(self, values, master="local[2]"):
        self.conf, self.sparkContext, self.dir, self.master = Conf(values), self, "set", master

    def getCheckpointDir(self):
        return self.dir


def test_shared_folder_is_the_session_s():
    assert common.shared_root(Session({"spark.checkpoint.dir": "s3://shared"})) == "s3://shared"
    own = common.shared_root(Session({}))
    assert own and own == common.shared_root(Session({}))
    assert common.shared_root(Session({"spark.checkpoint.dir": "s3://shared"}, "yarn")) == "s3://shared"
    with pytest.raises(RuntimeError):
        common.shared_root(Session({}, "yarn"))


def test_callers_drop_their_own_tables(spark):
    before = common.written()
    mine = common.cut(spark.range(4), "t")
    with common.own_tables():
        other = common.cut(spark.range(2), "t")
        assert other.count() == 2 and common.written() == 1
        common.drop_written(spark)
    assert mine.count() == 4 and common.written() == before + 1
    common.drop_written(spark, before)


def test_cut_and_drop(spark):
    first = common.written()
    a, b = (common.cut(spark.range(n), "t") for n in (3, 5))
    assert (a.count(), b.count(), common.written()) == (3, 5, first + 2)
    common.drop_written(spark, first, keep_last=True)
    assert b.count() == 5 and common.written() == first + 1
    common.drop_written(spark, first)
    assert common.written() == first


def test_least_hash_does_not_depend_on_partitions(spark):
    one = common.least_hash(spark.range(5000), "id", 100).collect()
    assert len(one) == 100 and sorted(one) == sorted(common.least_hash(spark.range(5000).repartition(7), "id", 100).collect())
    assert common.least_hash(spark.range(30), "id", 100).count() == 30

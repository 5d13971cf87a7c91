"""Shared-folder rule: use spark.checkpoint.dir; a private temp folder only in
local mode; on a cluster without the setting, refuse."""

import pytest

from sharecast import session as S


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _SC:
    def __init__(self, master, conf):
        self.master = master
        self._conf = conf
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d + "/uuid"

    def getConf(self):
        return self._conf


class _Spark:
    def __init__(self, master, values):
        self.conf = _Conf(values)
        self.sparkContext = _SC(master, _Conf(values))


def test_configured_folder_is_used():
    sp = _Spark("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert S.ensure_checkpoint_dir(sp) == "hdfs:///shared/ckpt"
    assert sp.sparkContext.dir.startswith("hdfs:///shared/ckpt")


def test_cluster_without_setting_is_an_error():
    with pytest.raises(ValueError):
        S.ensure_checkpoint_dir(_Spark("yarn", {}))


def test_local_without_setting_gets_a_private_folder():
    sp = _Spark("local[2]", {})
    base = S.ensure_checkpoint_dir(sp)
    assert base and sp.sparkContext.dir.startswith(base)

import pytest

from folioscan.llm import common


class Session:
    """A session on several machines without a shared folder."""

    class sparkContext:
        master = "spark://host:7077"

    class conf:
        get = staticmethod(lambda name, other=None: other)


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        common.scratch(Session)


def test_scratch_is_new_each_time(spark):
    assert common.scratch(spark) != common.scratch(spark)

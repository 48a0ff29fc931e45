"""The entry module without the corpus operators or what they need, and written tables."""

import os
import subprocess
import sys

import pytest

from eventscope.sources import storage

_BLOCKED = """
import sys
class Blocker:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {name!r} or name == {name!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Blocker())
import __spark_entry__ as e
from eventscope.plans import catalog
assert set(e.queries()) == set(catalog.QUERIES) | ({more}), set(e.queries()) - set(catalog.QUERIES)
assert set(e.oracle_sql()) <= set(e.queries())
"""


@pytest.mark.parametrize(("name", "more"), [("public_tokenizers", "set()"), ("eventscope.llm", "set()"), ("corpus_pipeline", "set(e._llm.QUERIES) if e._llm else set()")])
def test_entry_without_optional_modules(name, more):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", _BLOCKED.format(name=name, more=more)], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_written_tables_are_released(spark):
    mark = storage.written()
    tables = [storage.materialize(spark.range(3), f"release-{k}") for k in range(3)]
    paths = [t.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] for t in tables]
    assert all(map(os.path.isdir, paths))
    storage.release(spark, mark, keep=1)
    assert [os.path.isdir(p) for p in paths] == [False, False, True] and tables[2].count() == 3
    storage.release(spark, mark)
    assert not os.path.isdir(paths[2]) and storage.written() == mark


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)

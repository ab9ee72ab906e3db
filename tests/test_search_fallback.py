import shutil

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from test_operators import store


def found(page):
    return sorted(r.server_id for r in page.items.collect())


def test_an_index_that_is_lost_is_opened_again_and_else_rows_are_scanned(spark, tmp_path):
    at = str(tmp_path / "index")
    s = store(spark).build_index(root=at)
    want = found(s.search("words"))
    assert want and s.search("words").warnings == [] and s.search("words").scanned == 0
    # Another process indexes anew below the same root; what this store had open is gone, the latest version is not.
    shutil.move(at, f"{at}-old")
    store(spark).build_index(root=at)
    again = s.search("words")
    assert found(again) == want and again.warnings == [] and again.scanned == 0
    shutil.move(at, f"{at}-gone")
    page = s.search("words")
    assert found(page) == want and len(page.warnings) == 1 and "scanned" in page.warnings[0] and page.scanned == page.total
    with pytest.raises((Py4JJavaError, PySparkException)):
        s.search("words", mode="index")
    assert s.warnings == []

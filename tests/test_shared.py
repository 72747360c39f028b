"""Scopes of the shared folder in several threads."""

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from threading import Barrier

from meshwalk.functions.shared import cut, scope


def test_scopes_of_two_threads_keep_apart(spark):
    both = Barrier(2, timeout=120)

    def run(n):
        with scope(spark) as path:
            both.wait()
            d = cut(spark.range(n), "rows")
            both.wait()
            inside = d.inputFiles()[0].removeprefix("file://").startswith(path)
            if n == 5:
                both.wait()  # the other scope has ended
            count = d.count()
        if n == 9:
            both.wait()
        return inside, count, Path(path).exists()

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(run, (5, 9))) == [(True, 5, False), (True, 9, False)]

"""Word hashes, blocks of texts and folders."""

import numpy as np
import pyarrow as pa

from floodspark.llm import common


def test_words_and_bounds():
    data, at = common.utf8(pa.array(["One  two", None, "", "TWO", " x"]).slice(0, 5))
    hashes, start, end, counts = common.word_hashes(data, at, common.byte_table(outside=b" "))
    assert counts.tolist() == [2, 0, 0, 1, 1] and hashes[1] == hashes[2] and len(set(hashes.tolist())) == 3
    assert [bytes(data[a:b]) for a, b in zip(start, end)] == [b"One", b"two", b"TWO", b"x"]


def test_slices_and_blocks():
    column = pa.array(["a" * n for n in (5, 0, 7, 30, 2)]).slice(1, 4)
    data, at = common.utf8(column)
    assert np.diff(at).tolist() == [0, 7, 30, 2]
    found = list(common.text_blocks(data, at, size=8))
    assert [(i, j) for i, j, _, _ in found] == [(0, 2), (2, 3), (3, 4)] and all(b[0] == 0 and b[-1] == len(d) for _, _, d, b in found)


def test_release(spark):
    table = common.stored(spark.range(3), "numbers")
    path = table.inputFiles()[0]
    assert table.count() == 3 and common.release(spark) >= 1
    import os

    assert not os.path.exists(path.removeprefix("file://"))

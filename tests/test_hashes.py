"""Hashes of files of any size, and of files that are not there."""

import hashlib

from tidemark.sources import tables


def test_both_ways_give_the_same(spark, tmp_path):
    want = {}
    for name, n in (("empty.bin", 0), ("small.bin", 1000), ("large.bin", 3_000_000)):
        body = bytes(i * 7 % 251 for i in range(n))
        (tmp_path / name).write_bytes(body)
        if n:
            want[name] = (hashlib.sha256(body).hexdigest(), n)
    for whole in (1 << 28, 1000, 10):
        got = {r["path"].rsplit("/", 1)[1]: (r["sha256"], r["bytes"]) for r in tables.file_hashes(spark, str(tmp_path), whole=whole).collect()}
        assert got == want
    names = spark.createDataFrame([("small.bin",), ("gone.bin",), ("empty.bin",), (None,)], "name string")
    got = {r["name"]: r["sha256"] for r in tables.hash_map(names, tables.file_hashes(spark, str(tmp_path))).collect()}
    assert got == {"small.bin": want["small.bin"][0], "gone.bin": "MISSING", "empty.bin": "MISSING", None: "MISSING"}


def test_file_that_no_row_can_hold(spark, tmp_path):
    size = (1 << 31) + 5
    with open(tmp_path / "sparse.bin", "wb") as file:
        file.truncate(size)
    digest = hashlib.sha256()
    zeros = bytes(1 << 24)
    for at in range(0, size, len(zeros)):
        digest.update(zeros[: size - at])
    row = tables.file_hashes(spark, str(tmp_path)).first()
    assert (row["sha256"], row["bytes"]) == (digest.hexdigest(), size)

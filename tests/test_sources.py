"""Readers and the sink on small files."""

import zipfile

from caseloom.sources.readers import bundle_members, json_lines, pages_of, replace_partitions, store_objects, write_json_lines


def test_json_lines_keep_what_does_not_fit(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"id": 1, "t": "x"}\nno json\n{"id": 2}\n')
    got = json_lines(spark, str(tmp_path / "a.ndjson"), "id int, t string").cache()
    assert sorted((r["id"] or 0, r["t"], r["_corrupt"]) for r in got.collect()) == [(0, None, "no json"), (1, "x", None), (2, None, None)]


def test_bundles(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.txt", "hello")
        z.writestr("../two.txt", "no")
        z.writestr("big.bin", b"0" * 100)
    (tmp_path / "b.zip").write_bytes(b"broken")
    got = {(r["member"], r["part"], r["status"], r["content"] and bytes(r["content"])) for r in bundle_members(spark, str(tmp_path / "*.zip"), 50).collect()}
    assert got == {("one.txt", 0, "OK", b"hello"), ("../two.txt", 0, "UNSAFE", None), ("big.bin", 0, "OK", b"0" * 50), ("big.bin", 1, "OK", b"0" * 50), (None, 0, "BROKEN", None)}


def test_bundles_lose_nothing_and_survive_bad_members(spark, tmp_path):
    data = bytes(range(256)) * 1000
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("whole.bin", data)
        z.writestr("empty.txt", "")
        z.writestr("bad.bin", b"x" * 5000)
        z.writestr("locked.bin", b"y")
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[raw.index(b"xxxx") + 10] = 0
    at = raw.rindex(b"locked.bin") - 46  # its entry in the directory
    raw[at + 8] |= 1
    (tmp_path / "a.zip").write_bytes(raw)
    rows = bundle_members(spark, str(tmp_path / "a.zip"), 100_000).collect()
    parts = sorted((r["part"], bytes(r["content"])) for r in rows if r["member"] == "whole.bin")
    assert [n for n, _ in parts] == [0, 1, 2] and b"".join(c for _, c in parts) == data
    assert {(r["member"], r["part"], r["status"]) for r in rows if r["member"] != "whole.bin" and r["status"] != "OK"} == {("bad.bin", 0, "DAMAGED"), ("locked.bin", 0, "ENCRYPTED")}
    assert [bytes(r["content"]) for r in rows if r["member"] == "empty.txt"] == [b""]


def test_pages_and_sink(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a\fb\f"), (2, None), (3, "")], "k int, t string")
    pages = pages_of(texts, "k", "t")
    assert sorted((r["k"], r["page"], r["content"]) for r in pages.collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (3, 1, "")]
    path = str(tmp_path / "out")
    replace_partitions(pages, path, "k")
    replace_partitions(pages.filter("k = 3"), path, "k")
    assert spark.read.parquet(path).count() == 4


def test_objects_are_stored_once(spark, tmp_path):
    import hashlib

    path = str(tmp_path / "objects")
    first = spark.createDataFrame([(b"a",), (b"b",), (b"a",), (None,), (b"",)], "content binary")
    assert {(r["sha"], r["n_bytes"]) for r in store_objects(first, path).collect()} == {(hashlib.sha256(x).hexdigest(), len(x)) for x in (b"a", b"b", b"")}
    store_objects(spark.createDataFrame([(b"b",), (b"c",)], "content binary"), path)
    assert sorted(bytes(r["content"]) for r in spark.read.parquet(path).collect()) == [b"", b"a", b"b", b"c"]
    store_objects(first, path)
    assert spark.read.parquet(path).count() == 4
    write_json_lines(spark.createDataFrame([(1, None)], "id int, t string"), str(tmp_path / "lines"))
    assert json_lines(spark, str(tmp_path / "lines"), "id int, t string").first()["_corrupt"] is None

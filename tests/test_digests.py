"""Range digests against hashlib."""

import gzip
import hashlib
import random

from docketry.operators import digests, inventory


def plain(data, size):
    nodes = [hashlib.sha256(data[i : i + size]).digest() for i in range(0, max(len(data), 1), size)]
    while len(nodes) > 1:
        groups = [nodes[i : i + digests.FAN] for i in range(0, len(nodes), digests.FAN)]
        nodes = [g[0] if len(g) == 1 else hashlib.sha256(b"".join(g)).digest() for g in groups]
    return nodes[0].hex()


def test_digests_of_any_bytes_and_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(digests, "FAN", 4)
    rng = random.Random(3)
    bom = b"\xef\xbb\xbf"
    files = {
        "random.bin": rng.randbytes(30_000), "lines.txt": b"line\r\n\n" * 900, "none.bin": b"\0" * 5_000,
        "open.txt": b"a\nb", "mark.txt": bom + b"a\nb\n", "markonly.txt": bom, "feed": b"\n", "sub/random.bin": rng.randbytes(999), "z.gz": gzip.compress(b"abc" * 50),
        "thousand.bin": rng.randbytes(1000), "markopen.txt": bom + b"x" * 2000,
    }
    (tmp_path / "sub").mkdir()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    want = {n: (len(b), hashlib.sha256(b).hexdigest() if n == "z.gz" else plain(b, 1000)) for n, b in files.items()}
    root = str(tmp_path)
    for split in ("3k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = {r["path"].split(root + "/")[1]: (r["bytes"], r["digest"]) for r in digests.file_digests(spark, root, size=1000).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == want
    listed = {r["file"]: r["sha256"] for r in inventory.file_inventory(spark, root).collect()}
    assert listed == {n: hashlib.sha256(b).hexdigest() for n, b in files.items()}


def test_only_packed_files_are_read_whole(spark, tmp_path):
    (tmp_path / "plain.bin").write_bytes(b"abc\n" * 500)
    (tmp_path / "z.gz").write_bytes(gzip.compress(b"abc" * 50))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")  # a row that held the plain file would fail
    try:
        got = {r["path"].rsplit("/", 1)[1]: r["digest"] for r in digests.file_digests(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("plain.bin", "z.gz")}


def test_no_files(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"x")
    assert digests.file_digests(spark, str(tmp_path), "*.none").collect() == []

"""Checksums of files, also of more than a cell can hold."""

import hashlib
import os
import subprocess
import sys

import pytest

from sedimenta.sources import files


def test_identities_of_registered_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.bin").write_bytes(b"abc" * 1000)
    (tmp_path / "sub" / "b b.bin").write_bytes(os.urandom(5000))
    (tmp_path / "empty").write_bytes(b"")
    at = lambda name: f"file:{tmp_path}/{name}"
    (tmp_path / "locked").mkdir()  # a folder can't be read as a file
    rows = [(1, at("a.bin"), None), (2, at("sub/b b.bin"), 5000), (3, at("empty"), None), (4, "file:/nowhere", None), (5, at("a.bin"), 3001), (6, None, None), (7, at("locked"), None)]
    got = {r.document_id: (r.checksum, r.size, r.failure) for r in files.identities(spark.createDataFrame(rows, "document_id long, path string, expected long"), size=100).collect()}
    a, b = hashlib.sha256(b"abc" * 1000).hexdigest(), hashlib.sha256((tmp_path / "sub" / "b b.bin").read_bytes()).hexdigest()
    lost = (None, None, "content_not_found")
    assert got == {1: (a, 3000, None), 2: (b, 5000, None), 3: (None, None, "empty_content"), 4: lost, 5: (None, None, "checksum_failure"), 6: lost, 7: (None, None, "content_inaccessible")}
    listed = files.checksums(files.listed(spark, str(tmp_path))).collect()
    assert sorted((r.length, r.checksum) for r in listed) == [(3000, a), (5000, b)]


@pytest.fixture(scope="module")
def big(tmp_path_factory):
    path = tmp_path_factory.mktemp("big") / "sparse.bin"
    with open(path, "wb") as f:
        f.truncate(3 * 1024**3)
        f.seek(2 * 1024**3 + 5)
        f.write(b"x")
    yield path
    path.unlink()


def test_a_file_of_three_gb(spark, big):
    got = files.checksums(files.listed(spark, str(big.parent))).first()
    assert (got.length, got.bytes_read, got.error) == (3 * 1024**3, 3 * 1024**3, None)
    code = f"import resource; from sedimenta.sources.files import checksum_of; c = checksum_of({str(big)!r}); print(c[0], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    checksum, peak_kb = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert checksum == got.checksum and int(peak_kb) < 1024 * 1024

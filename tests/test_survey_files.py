"""Survey files as they lie on disk: whole paths, hashes, NULs, other bytes than ASCII, line ends, records and issues."""

from __future__ import annotations

import hashlib

from terralith.operators import survey

FILES = {
    "a/P1.dat": b"WL/2(km)  Vx\r\n0.1 200\r\n0.2 1.#QNAN0\r\n\x00",
    "b/P1.dat": b"head\n0.5\n0.1 300\r0.3 400\n\n\x00\x00\r\n",
    "b/P2.dat": b"gr\xf6\xdfe\n0.1 5\xe9\n",
    "b/P3.dat": b"",
    "b/P4.dat": b"\x00",
}


def put(folder, files):
    for name, data in files.items():
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_bytes(data)


def test_manifest_of_files(spark, tmp_path):
    put(tmp_path, FILES)
    files = survey.read_files(spark, f"file://{tmp_path}")
    lines = {}
    for r in survey.lines_of(files).orderBy("file", "line_no").collect():
        lines.setdefault(r["file"].split(f"{tmp_path}/")[1], []).append(r["text"])
    assert lines == {"a/P1.dat": ["WL/2(km)  Vx", "0.1 200", "0.2 1.#QNAN0"], "b/P1.dat": ["head", "0.5", "0.1 300", "0.3 400"], "b/P2.dat": ["gr\ufffd\ufffde", "0.1 5\ufffd"]}
    told = {r["file"].split(f"{tmp_path}/")[1]: r for r in survey.manifest(files, survey.parse(survey.lines_of(files))).collect()}
    assert {k: (r["name"], r["size"], r["sha256"]) for k, r in told.items()} == {k: (k[2:], len(v), hashlib.sha256(v).hexdigest()) for k, v in FILES.items() if v}
    assert {k: (r["encoding"], r["nul"], r["records"], r["valid"], r["issues"]) for k, r in told.items()} == {
        "a/P1.dat": ("ascii", 1, 2, 1, ["SOURCE_NUL_TERMINATOR", "v_msvc_special"]), "b/P1.dat": ("ascii", 2, 3, 2, ["SOURCE_NUL_TERMINATOR", "column_count", "v_empty"]),
        "b/P2.dat": ("ascii_with_replacement", 0, 1, 0, ["ENCODING_FALLBACK", "v_not_numeric"]), "b/P4.dat": ("ascii", 1, 0, 0, ["SOURCE_NUL_TERMINATOR"]),
    }


def test_hashes_before_and_after(spark, tmp_path):
    put(tmp_path, FILES)
    before = spark.createDataFrame(survey.read_files(spark, f"file://{tmp_path}").select("file", "sha256").collect(), "file string, sha256 string")
    (tmp_path / "b/P2.dat").write_bytes(b"other")
    (tmp_path / "b/P4.dat").unlink()
    (tmp_path / "b/P5.dat").write_bytes(b"x")
    out = survey.hash_changes(before, survey.read_files(spark, f"file://{tmp_path}")).collect()
    assert {r["file"][-8:]: r["state"] for r in out} == {"a/P1.dat": "unchanged", "b/P1.dat": "unchanged", "b/P2.dat": "changed", "b/P4.dat": "gone", "b/P5.dat": "new"}

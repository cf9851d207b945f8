"""Archives listed and extracted under their caps, and text files told by their ends."""

from __future__ import annotations

import random
import zipfile

import pytest

from quern.sources import archives, files


def _zip(path, entries: dict[str, bytes]) -> str:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries.items():
            z.writestr(name, content)
    return str(path)


def _listed(spark, path, **caps):
    return {(r["name"], r["entry"], r["size"]): r["refused"] for r in archives.archive_entries(spark, path, **caps).collect()}


@pytest.mark.parametrize("name", ["../up.txt", "/root.txt", "in/../../x", "..\\up.txt", "\\share"])
def test_names_that_lead_out(name):
    assert archives.entry_name(name) is None


def test_names_that_stay():
    assert archives.entry_name("a\\b..c\\d.txt") == "a/b..c/d.txt" and archives.entry_name("..a/b") == "..a/b" and archives.entry_name("") is None


def test_caps_refuse_an_archive_whole_and_bad_names_alone(spark, tmp_path):
    path = _zip(tmp_path / "a.zip", {"in/": b"", "in/a.txt": b"abc", "b.xyz": b"x" * 9, "../c.txt": b"x" * 99})
    held = {("in/a.txt", "in/a.txt", 3): None, ("b.xyz", "b.xyz", 9): None, ("../c.txt", None, 99): "path"}
    assert _listed(spark, path) == held
    assert _listed(spark, path, kinds=["text"]) == {**held, ("b.xyz", "b.xyz", 9): "kind"}
    # an entry that is refused by itself counts for no cap
    assert _listed(spark, path, entries=2, entry_bytes=9, total_bytes=12) == held
    for cap, why in ({"entries": 1}, "entries"), ({"entry_bytes": 8}, "entry size"), ({"total_bytes": 11}, "total size"):
        assert _listed(spark, path, **cap) == {k: v or why for k, v in held.items()}


def test_files_that_are_no_archives_and_empty_ones(spark, tmp_path):
    (tmp_path / "no.zip").write_bytes(b"PK no")
    (tmp_path / "nil.zip").write_bytes(b"")
    _zip(tmp_path / "empty.zip", {})
    rows = archives.archive_entries(spark, str(tmp_path)).collect()
    assert {r["file"].rsplit("/", 1)[-1]: r["refused"] for r in rows} == {"no.zip": "unreadable"}
    assert {(r["content"], r["refused"]) for r in archives.extract(archives.archive_entries(spark, str(tmp_path))).collect()} == {(None, "unreadable")}


def test_extraction_gives_every_byte_and_tells_broken_entries(spark, tmp_path):
    r = random.Random(5)
    bodies = {f"d {k}/é{k}.txt": r.randbytes(k * 40_000) for k in range(40)}
    _zip(tmp_path / "big one.zip", {**bodies, "../out": b"no"})
    # an entry that says it is shorter than it is
    lying = bytearray(open(_zip(tmp_path / "lie.zip", {"long.txt": b"q" * 5000}), "rb").read())
    at = lying.index(b"PK\x01\x02")
    lying[at + 24 : at + 28] = (10).to_bytes(4, "little")
    (tmp_path / "lie.zip").write_bytes(bytes(lying))
    rows = archives.extract(archives.archive_entries(spark, str(tmp_path))).collect()
    assert {x["entry"]: bytes(x["content"]) for x in rows if x["refused"] is None} == bodies
    assert sorted((x["entry"] or "", x["refused"]) for x in rows if x["refused"]) == [("", "path"), ("long.txt", "broken")]
    small = archives.extract(archives.archive_entries(spark, str(tmp_path / "big one.zip")), entry_bytes=80_000).collect()
    assert {x["refused"] for x in small if x["entry"] and len(bodies[x["entry"]]) > 80_000} == {"entry size"}
    assert sum(x["content"] is not None for x in small) == 3


def test_text_files_are_told_by_their_ends(spark, tmp_path):
    clean, odd = "wörd\n" * 30_000, "\x01" * 4000
    (tmp_path / "middle of it.log").write_text(clean + odd * 20 + clean)
    (tmp_path / "front.log").write_text(odd + clean)
    (tmp_path / "back.log").write_text(clean + odd)
    (tmp_path / "latin.log").write_bytes(("é" * 100).encode("latin-1"))
    (tmp_path / "tenth.log").write_text("\x0b" + "a" * 9)
    (tmp_path / "over.log").write_text("\x0c\x0c" + "a" * 17)
    (tmp_path / "none.log").write_text("")
    told = {x["file"].rsplit("/", 1)[-1]: x["readable"] for x in archives.text_files(spark, str(tmp_path)).collect()}
    assert told == {"middle%20of%20it.log": True, "front.log": False, "back.log": False, "latin.log": False, "tenth.log": True, "over.log": False}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    try:
        lines = files.read_long_lines(spark, str(tmp_path)).collect()
        assert files.read_long_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    short = files.read_lines(spark, str(tmp_path)).filter("raw != ''").collect()
    assert {tuple(x) for x in short} == {tuple(x) for x in lines if x["raw"]} and len(lines) > 60_000
    assert len({(x["file"], x["line_no"]) for x in lines}) == len(lines)


def test_lines_under_the_headers_of_a_dump(spark):
    from quern.operators import logs

    text = ["before", "Short text", "one", "  WHAT HAPPENED?", "two", "", "whatever", "Short Text again", "three"]
    lines = spark.createDataFrame([("f", k, x) for k, x in enumerate(text)] + [("g", 0, "no header")], "file string, line_no int, raw string")
    told = logs.dump_sections(lines, ["what happened", "short text"]).orderBy("line_no").collect()
    assert [(r["section"].lower(), r["line_no"], r["raw"]) for r in told] == [("short text", 2, "one"), ("what happened", 4, "two"), ("what happened", 5, ""), ("what happened", 6, "whatever"), ("short text", 8, "three")]

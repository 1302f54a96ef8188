"""Files one by one, and what a run has written."""

from __future__ import annotations

import json

import pytest

from loreweave.sources.artifacts import Artifacts, latest_output
from loreweave.sources.documents import load, load_files


def test_files_and_folders(spark, tmp_path):
    for name, body in (("book1_ch02.txt", b"two\r\n"), ("book1_ch01.MD", b"one"), ("image.png", b"x"), ("bad.txt", b"\xff")):
        (tmp_path / name).write_bytes(body)
    at = lambda name: f"file://{tmp_path}/{name}"
    told = lambda d: sorted((r.source_id, r.order_hint, r.raw_text, r.book_label) for r in d.collect())
    assert told(load(spark, at("book1_ch02.txt"))) == [("book1_ch02", 0, "two\n", "book1")]
    both = [at("book1_ch02.txt"), at("book1_ch01.MD")]
    assert told(load_files(spark, both)) == [("book1_ch01", 0, "one", "book1"), ("book1_ch02", 0, "two\n", "book1")]
    assert told(load_files(spark, both, ordered=True)) == [("book1_ch01", 0, "one", "book1"), ("book1_ch02", 1, "two\n", "book1")]
    assert told(load(spark, f"file://{tmp_path}")) == [("bad", 0, None, None), ("book1_ch01", 1, "one", "book1"), ("book1_ch02", 2, "two\n", "book1")]
    assert load_files(spark, []).count() == 0
    for name, error in (("nothing.txt", FileNotFoundError), ("image.png", ValueError), ("", ValueError)):
        with pytest.raises(error):
            load_files(spark, [at(name).rstrip("/")])
    with pytest.raises(FileNotFoundError):
        load(spark, at("nothing"))


def test_artifacts(spark, tmp_path):
    out = tmp_path / "out_2"
    (out / "kb").mkdir(parents=True)
    (tmp_path / "out_10").mkdir()
    (out / "kb" / "entities.json").write_text(json.dumps([{"id": "a", "n": 1}, {"id": "é", "n": None}], indent=1))
    (out / "one.json").write_text('{"id": "only"}')
    (out / "both.json").write_text('[{"id": "json"}]')
    (out / "both.jsonl").write_text('{"id": "x"}\n\n{"id": "y"}\n')
    (out / "kb" / "dossier.md").write_text("# a\nb")
    assert latest_output(spark, f"file://{tmp_path}/out").endswith("/out_2")
    assert latest_output(spark, f"file://{tmp_path}/none") is None
    a = Artifacts(spark, f"file://{out}")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(a.json("kb/entities.json")) == ["a", "é"] and ids(a.records("one")) == ["only"] and ids(a.records("both")) == ["x", "y"]
    assert a.records("nothing").count() == 0 and a.text("kb/dossier.md").collect()[0].value == "# a\nb"
    assert [r.name for r in a.listing().collect()] == ["both.json", "both.jsonl", "kb/dossier.md", "kb/entities.json", "one.json"]
    assert Artifacts(spark, f"file://{tmp_path}/none").listing().count() == 0
    for name in ("../out_10", "/etc/passwd", "kb/../../x", "", "file:x"):
        with pytest.raises(ValueError):
            a.path(name)
    with pytest.raises(FileNotFoundError):
        a.json("nothing.json")
    (tmp_path / "out").mkdir()
    assert latest_output(spark, f"file://{tmp_path}/out").endswith("/out")

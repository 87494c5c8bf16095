"""Pages of files, read in ranges of any size."""

import os
import random

import pytest

from quillstone.sources import pages as P


def test_ranges_give_each_page_once(tmp_path):
    rng = random.Random(1)
    for n in range(150):
        text = "".join(rng.choice("ab\f") for _ in range(rng.randint(0, 25)))
        (tmp_path / "a.txt").write_text(text)
        for size in (1, 2, 3, 7, 100):
            reader = P.PageReader({"path": str(tmp_path), "bytes": str(size)})
            assert [x for part in reader.partitions() for x in P.pages(part)] == text.split("\f"), (text, size)


def test_pages_are_numbered(spark, tmp_path):
    long = "a page with more than thirty characters, number "
    (tmp_path / "a.txt").write_text("\f".join(f"{long}{k}" for k in range(40)) + "\fshort")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.md").write_text(long)
    for size in ("64", "100000"):
        rows = P.load_pages(spark, str(tmp_path), bytes=size).orderBy("file", "number").collect()
        assert [(r.file, r.number, r.n_pages) for r in rows] == [("a.txt", k + 1, 41) for k in range(41)] + [("b.txt", 1, 1)]
        assert [r.text for r in rows[:40]] == [f"{long}{k}" for k in range(40)] and all(r.blank and r.text is None for r in rows[40:])
    assert [r.file for r in P.load_pages(spark, str(tmp_path), glob="*.md").collect()] == ["c.md"]
    assert P.load_pages(spark, str(tmp_path), names="a.txt\nc.md").select("file").distinct().count() == 2


def test_nothing_outside_the_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "secret.txt").write_text("x")
    os.symlink(tmp_path / "secret.txt", tmp_path / "in" / "link.txt")
    for name in ("../secret.txt", "link.txt", str(tmp_path / "secret.txt"), "."):
        with pytest.raises(P.OutsideFolder):
            P.held(str(tmp_path / "in"), name)
        with pytest.raises(Exception, match="is outside"):
            P.load_pages(spark, str(tmp_path / "in"), names=name).count()

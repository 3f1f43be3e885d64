"""File categories, object keys, listing pages, conversation windows."""
import pytest

from meterlake.operators import inventory as M


def test_file_categories(spark):
    paths = ["a.tar.gz", ".bashrc", "x.JPG", "http://h.example.com/a/b.PDF?x=1#f", "file.", "/d/song.mp3;v=2",
             "https://h/en/25#top", "/data/report.csv?v=5", "noext"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: (r.category, r.extension, r.is_remote) for r in M.classify_files(df).collect()}
    assert got == {
        "a.tar.gz": ("default", ".gz", False), ".bashrc": ("default", "", False), "x.JPG": ("image", ".JPG", False),
        "http://h.example.com/a/b.PDF?x=1#f": ("document", ".PDF", True), "file.": ("default", ".", False),
        "/d/song.mp3;v=2": ("audio", ".mp3", False), "https://h/en/25#top": ("default", "", True),
        "/data/report.csv?v=5": ("document", ".csv", False), "noext": ("default", "", False)}


def test_key_validation_first_failing_rule(spark):
    keys = ["ok/file-1.csv", "", "   ", "x" * 1025, "/lead", "trail/", "a//b", "has space", "bad#char", "é"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.key: (r.valid, r.reason, r.bad_char) for r in M.validate_keys(df).collect()}
    assert got["ok/file-1.csv"] == (True, None, None)
    assert got[""][1] == "empty" and got["   "][1] == "empty"
    assert got["x" * 1025][1] == "too_long"
    assert got["/lead"][1] == "slash_edge" and got["trail/"][1] == "slash_edge"
    assert got["a//b"][1] == "double_slash"
    assert got["has space"] == (False, "bad_char", " ") and got["bad#char"][2] == "#"
    assert got["é"][1] == "bad_char"


def test_unique_keys_are_deterministic(spark):
    df = spark.createDataFrame([("photos/My.Photo.JPG",), ("README",)], "name string")
    got = {r.name: r.object_key for r in M.unique_keys(df).collect()}
    assert got["photos/My.Photo.JPG"].startswith("My.Photo_") and got["photos/My.Photo.JPG"].endswith(".jpg")
    assert len(got["README"]) == len("README_") + 8
    assert got == {r.name: r.object_key for r in M.unique_keys(df).collect()}


def test_list_page_and_continuation(spark):
    df = spark.createDataFrame([(f"k/{i:03d}",) for i in range(25)] + [("other/1",)], "key string")
    p1 = M.list_page(df, prefix="k/", max_keys=10).collect()
    assert [r.key for r in p1] == [f"k/{i:03d}" for i in range(10)]
    assert p1[0].is_truncated and p1[0].next_token == "k/009"
    p3 = M.list_page(df, prefix="k/", max_keys=10, continuation_token="k/019").collect()
    assert len(p3) == 5 and not p3[0].is_truncated and p3[0].next_token is None
    with pytest.raises(ValueError):
        M.list_page(df, max_keys=1001)


def test_size_cap(spark):
    df = spark.createDataFrame([("a", 10), ("b", 200), ("c", None)], "key string, size long")
    ok, bad = M.size_cap(df, cap=100)
    assert [r.key for r in ok.collect()] == ["a"] and sorted(r.key for r in bad.collect()) == ["b", "c"]


def test_last_messages_keeps_whole_texts(spark):
    rows = [(1, t, "user", "x" * (t + 1)) for t in range(6)] + [(2, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.turn, len(r.text)) for r in M.last_messages(df, n=3).collect())
    assert got == [(1, 3, 4), (1, 4, 5), (1, 5, 6), (2, 0, 2)]

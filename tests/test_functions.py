import hashlib
import posixpath
import zlib

import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from treeline.functions import globs, hashing, kinds, labels, paths, rules
from treeline.schema import ALGORITHMS


def values(spark, column, inputs, dtype="string"):
    """The column over one-column rows ``x``, in input order."""
    rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {dtype}")
    return [r["y"] for r in rows.select("i", column.alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "fn, expected",
    [
        (paths.extension, {"/a/b.tar.gz": ".gz", "/a/.gitignore": ".gitignore", "/a.b/c": "", "/a/foo.": ".",
                           "/A.JPG": ".jpg"}),
        (paths.parent_of, {"/x": "/", "/a/b": "/a", "/": "/", "a": ".", "/a/b/": "/a/b"}),
        (paths.base_name, {"/a/b": "b", "/a/b/": "b", "/": "/", "": ".", "c": "c", "//": "/"}),
        (paths.depth, {"/a/b": 3, "a": 1, "/": 2}),
        (paths.ancestors, {"/a/b/c": ["/", "/a", "/a/b"], "/a": ["/"], "/": [], "a/b": ["a"], "a": []}),
        (rules.is_hidden, {"/a/.b": True, "/a/b": False, "/.a/b": False, ".": False, "..": False}),
        (labels.title, {"dry_run": "Dry Run", "CLEANUP": "Cleanup"}),
    ],
)
def test_path_columns(spark, fn, expected):
    assert values(spark, fn("x"), list(expected)) == list(expected.values())


_PART = st.sampled_from(["", ".", "..", "a", "b.c", ".d"])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(_PART, min_size=1, max_size=7).map(lambda p: "/" + "/".join(p)), min_size=1, max_size=20))
def test_normal_path_is_posix(spark, inputs):
    # posix keeps exactly two leading slashes, which mean nothing here
    want = [posixpath.normpath("/" + p.lstrip("/")) for p in inputs]
    assert values(spark, paths.normal_path("x"), inputs) == want


def test_relative_paths_start_at_the_working_directory(spark):
    assert values(spark, paths.normal_path("x", "/w/d"), ["a/../b", "./c", "../../../d"]) == ["/w/d/b", "/w/d/c", "/d"]


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        ("*.tmp", ["a.tmp", ".tmp"], ["x/a.tmp", "a.tmpx"]),
        ("?", ["a", "é"], ["", "/", "ab"]),
        ("[a-c]x", ["ax", "cx"], ["dx", "x"]),
        ("[^a-c]x", ["dx", "/x"], ["ax"]),
        (r"\*a", ["*a"], ["xa"]),
        (r"[\]\-]", ["]", "-"], ["a"]),
        ("a.b+(c)", ["a.b+(c)"], ["axb+(c)", "a.bb(c)"]),
        ("a*b*c", ["abc", "a1b2c"], ["a/bc", "acb"]),
        ("", [""], ["a"]),
        ("[b-a]", [], ["a", "b"]),
        ("a\n?", ["a\nb"], ["a\n"]),
    ],
)
def test_globs(spark, pattern, yes, no):
    got = values(spark, globs.matches_glob(F.col("x"), pattern), yes + no)
    assert got == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize("pattern", ["[", "[]", "[]a]", "[a", "a\\", "[-a]", "[a-]", "[^]"])
def test_malformed_globs_match_nothing(spark, pattern):
    assert globs.glob_regex(pattern) is None
    assert values(spark, globs.matches_glob(F.col("x"), pattern), [pattern, "a", "["]) == [False] * 3


def test_cleanup_rules(spark):
    inputs = ["/r/.github/x", "/r/a", "/r/.hidden", "/r/node_modules", "/r/.DS_Store", "/r/.keep1"]
    keep = rules.cleanup_allows("x", (".git",), (".keep?", "/r"))
    assert values(spark, keep, inputs) == [False, True, False, False, False, True]
    # the ownership rule holds patterns against the whole path
    own = rules.ownership_allows("x", (".git", "/r/*/x"))
    assert values(spark, own, inputs) == [False, True, True, True, True, True]


def test_include_and_exclude(spark):
    inputs = ["/a/b.txt", "/a/B.LOG", "/tmpx/c.txt", "/a/d.md"]
    assert values(spark, rules.path_allowed("x", ("*.log", "TMP")), inputs) == [True, True, False, True]
    assert values(spark, rules.path_allowed("x", (".log", "TMP"), ("*.txt",)), inputs) == [True, False, False, False]


def test_kinds(spark):
    exts = [".jpg", ".svg", ".mkv", ".ogg", ".css", ".pdf", ".tar", ".gz", ".zip", ".js", ".xml", ".tiff", ""]
    want = ["images", "images", "videos", "audio", "documents", "documents", "archives", "archives", "archives",
            "other", "other", "other", "other"]
    assert len(kinds.MIME_TYPES) == 28
    assert values(spark, kinds.category(kinds.mime_type(F.col("x"))), exts) == want
    assert values(spark, rules.has_format("x", kinds.IMAGE_FORMATS), [".jpg", ".tiff", ".webp"]) == [True, True, False]


def test_sizes(spark):
    sizes = [0, 1023, 1024, 1280, 1048575, 1024**2, 1024**3, 5 * 1024**4, 1024**5, 2**63 - 1, -5]
    want = ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1024.0 KB", "1.0 MB", "1.0 GB", "5.0 TB", "1.0 PB", "8.0 EB", "-5 B"]
    assert values(spark, labels.size_label("x"), sizes, "bigint") == want
    texts = ["64MB", "64 MB", "1.5GB", "80%", "1TB", "", " 10kb ", "+5b", "-1", "9999999999999999999", "9223372036854775807GB", "7"]
    want = [67108864, 9, 9, 9, 9, 9, 10240, 5, -1, 9, 9, 7]
    assert values(spark, labels.parse_size("x", 9), texts) == want
    assert values(spark, rules.size_between("x", 10, 0), [9, 10, 10**9], "bigint") == [False, True, True]
    assert values(spark, rules.size_between("x", 0, 10), [9, 10, 11], "bigint") == [True, True, False]


def _digest(name, data):
    if name == "crc32":
        return f"{zlib.crc32(data):08x}"
    if name == "xxhash64":
        return xxhash.xxh64(data, seed=0).hexdigest()
    if name == "blake2b":
        return hashlib.blake2b(data, digest_size=32).hexdigest()
    return hashlib.new(name, data).hexdigest()


@pytest.mark.parametrize("name", ALGORITHMS)
def test_digests(spark, name):
    data = [b"", b"a", b"hello", bytes(range(256)) * 4, b"x" * 1000]
    want = [_digest(name, d) for d in data]
    assert values(spark, hashing.digest("x", name.upper()), [bytearray(d) for d in data], "binary") == want
    texts = ["", "é", "hello" * 50]
    assert values(spark, hashing.digest("x", name), texts) == [_digest(name, t.encode()) for t in texts]


def test_unknown_digest(spark):
    with pytest.raises(ValueError, match="unsupported hash algorithm: md4"):
        hashing.digest("x", "md4")

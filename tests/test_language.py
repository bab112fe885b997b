import random

import pytest

from pathloom.plans import patterns
from pathloom.plans.language import ALL, FOLDERS, FUZZY, GLOB, REGEX, SUBSTRING, Sort, allowed_typos, parse, refines, tag_group


@pytest.mark.parametrize(
    ("line", "mode", "text", "extension", "kind"),
    [
        ("", SUBSTRING, "", None, ALL),
        ("  config ", SUBSTRING, "config", None, ALL),
        ("*.py main", SUBSTRING, "main", "py", ALL),
        ("main *.py", SUBSTRING, "main", "py", ALL),
        ("*.a x *.tar.gz", SUBSTRING, "x", "tar.gz", ALL),
        ("*.", GLOB, "*.", None, ALL),
        ("two words", SUBSTRING, "two words", None, ALL),
        ("two   words", SUBSTRING, "two words", None, ALL),
        ("folder:movies", SUBSTRING, "movies", None, FOLDERS),
        ("FOLDER: movies", SUBSTRING, "movies", None, FOLDERS),
        ("folder:", SUBSTRING, "", None, FOLDERS),
        ("folder: *.d x", SUBSTRING, "x", "d", FOLDERS),
        ("übergröße", SUBSTRING, "übergröße", None, ALL),
        ("foldér:x", SUBSTRING, "foldér:x", None, ALL),
        ("~config", FUZZY, "config", None, ALL),
        ("~", SUBSTRING, "~", None, ALL),
        ("~conf *.rs", FUZZY, "conf", "rs", ALL),
        ("~a/b", FUZZY, "a/b", None, ALL),
        ("/doc[0-9]+", REGEX, "doc[0-9]+", None, ALL),
        ("/", REGEX, "", None, ALL),
        ("/[", SUBSTRING, "/[", None, ALL),
        ("/(?=a)", SUBSTRING, "/(?=a)", None, ALL),
        (r"/(a)\1", SUBSTRING, r"/(a)\1", None, ALL),
        ("foo*bar", GLOB, "foo*bar", None, ALL),
        ("fo?", GLOB, "fo?", None, ALL),
        ("a[*", SUBSTRING, "a[*", None, ALL),
        ("src/*.rs", GLOB, "src/*.rs", None, ALL),
        ("src/", SUBSTRING, "src", None, ALL),
        ("main t:work", SUBSTRING, "main", None, ALL),
    ],
)
def test_parse(line, mode, text, extension, kind):
    q = parse(line)
    assert (q.mode, q.text, q.extension, q.kind) == (mode, text, extension, kind)


@pytest.mark.parametrize(
    ("line", "segments", "text"),
    [("src/config", ("src", "config"), "config"), ("a/b/c", ("a", "b", "c"), "c"), ("a//b/", ("a", "b"), "b"), ("src/", None, "src"), ("/src/x", None, "src/x"), ("a/b x", ("a", "b x"), "b x")],
)
def test_segments(line, segments, text):
    q = parse(line)
    assert (q.segments, q.text) == (segments, text)


@pytest.mark.parametrize(
    ("line", "groups", "text"),
    [
        ("t:paid", ((("paid",),),), ""),
        ("T:paid berlin", ((("paid",),),), "berlin"),
        ("t:paid&berlin", ((("paid", "berlin"),),), ""),
        ("t:paid AND berlin", ((("paid", "berlin"),),), ""),
        ("t:paid OR berlin x", ((("paid",), ("berlin",)),), "x"),
        ("t:paid &berlin", ((("paid", "berlin"),),), ""),
        ("t:paid& berlin", ((("paid", "berlin"),),), ""),
        ("t:a and b", ((("a",),),), "and b"),
        ("x t: a b&c", ((("a",), ("b", "c")),), "x"),
        ("t: a AND b OR c", ((("a", "b"), ("c",)),), ""),
        ("t:", ((),), ""),
        ("t:&", ((),), ""),
        ("t: a *.md t:b", ((("a",),), (("b",),)), ""),
        ("t:a AND t:b", ((("a",),), (("b",),)), ""),
        ("t:a OR *.md", ((("a",),),), ""),
        ("t:a OR AND b", ((("a",),),), "b"),
        ("t:a& *.md x", ((("a", "*.md"),),), "x"),
        ("t:a & t:b c", ((("a", "t:b"),),), "c"),
        ("t: a OR & b", ((("a", "b"),),), ""),
    ],
)
def test_tag_groups(line, groups, text):
    q = parse(line)
    assert (q.tags, q.text) == (groups, text)
    assert q.extension == ("md" if "*.md" in line and "& *.md" not in line else None)


def test_tag_group_joins_only_what_is_there():
    assert tag_group(["&", "a"]) == (("a",),)
    assert tag_group(["a", "&&", "b"]) == (("a", "b"),)
    assert tag_group(["a", "&", "OR", "b"]) == (("a",), ("b",))


def test_typos_go_by_bytes():
    assert [allowed_typos("x" * n) for n in (0, 3, 4, 6, 7, 12, 13, 50)] == [0, 0, 1, 1, 2, 2, 3, 3]
    assert allowed_typos("été") == 1


def test_sort_index():
    assert parse("x", 3).sort == Sort.NAME_DOWN and parse("x", 99).sort == Sort.NEWEST and parse("x", -1).sort == Sort.NEWEST


@pytest.mark.parametrize(
    ("old", "new", "sort", "fine"),
    [
        ("rep", "reports", 0, True),
        ("folder", "folder:rep", 0, False),
        ("folder:", "folder:rep", 0, True),
        ("folder:rep", "folder:reports", 0, True),
        ("folder:reports", "folder:report", 0, False),
        ("folder:rep", "rep", 0, False),
        ("rep", "reports", 2, False),
        ("~not", "~note", 0, False),
        ("a/b", "c/b", 0, False),
        ("x *.md", "xy", 0, False),
        ("Rep", "rEPorts", 0, True),
    ],
)
def test_refinement(old, new, sort, fine):
    assert refines(parse(old), parse(new, sort)) is fine


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("*a?c*", ["abc", "x/a/c", "aaXc1"], ["ac", "ABC"]),
        ("*{md,txt}", ["a.md", "x.txt"], ["a.rs"]),
        ("*[0-9].x", ["1.x", "ab3.x"], ["a.x", "1xx"]),
        ("*[!0-9].x", ["a.x"], ["1.x"]),
        (r"*\**", ["a*b"], ["ab"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["ab", "a/xb"]),
        ("*.[]x]", ["a.]", "a.x"], ["a.y"]),
    ],
)
def test_globs(glob, yes, no):
    import re

    regex = re.compile(patterns.glob_regex(glob))
    assert all(regex.match(x) for x in yes) and not any(regex.match(x) for x in no)


def test_characters_by_number():
    assert patterns.java_regex(r"a\x{41}") == r"(?idU)a\x{41}" and patterns.java_regex(r"\u{e9}$") == r"(?idU)\x{e9}$"
    assert patterns.java_regex(r"\x{zz}[") is None and parse(r"/\x{41}b").mode == REGEX


def test_open_globs_are_invalid():
    assert [patterns.glob_regex(g) for g in ("[a", "{a", "a}", "a\\", "[z-a]")] == [None] * 5


def test_required_literals_are_sound():
    import re

    rng = random.Random(4)
    atoms = ["a", "b", "cd", "e?", "f*", "[gh]", "(ij)?", "k+", ".", "l{0,2}", "mn", r"\.", "(op|q)", "r"]
    for _ in range(300):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 6)))
        regex = re.compile(pattern, re.I)
        for _ in range(30):
            text = "".join(rng.choice("abcdefghijklmnopqr.") for _ in range(rng.randint(0, 12)))
            if (m := regex.search(text)) is not None:
                assert all(lit in text for lit in patterns.required_literals(pattern)), (pattern, text, m)
    assert patterns.required_literals("foo|barbaz") == [] and patterns.required_literals("foobar") == ["foobar"]

"""From a parsed query to a Column over catalog rows. Cheap conjuncts come first; Catalyst keeps their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import paths
from . import patterns
from .language import ALL, EDIT, FILES, FOLDERS, FUZZY, GLOB, REGEX, Query, TagGroup

# Extensions that an editor doesn't open.
BINARY_EXTENSIONS = (
    "png jpg jpeg gif bmp ico webp svg tiff raw mp3 mp4 wav avi mkv mov flac ogg m4a aac pdf doc docx xls xlsx ppt pptx "
    "zip tar gz bz2 xz 7z rar zst exe dll so dylib a o obj bin dat db sqlite sqlite3 ttf otf woff woff2 eot "
    "class jar war pyc pyo whl min.js min.css"
).split()


def kind_filter(kind: str) -> Column:
    is_dir = F.col("is_dir")
    if kind == ALL:
        return F.lit(True)
    if kind == FOLDERS:
        return is_dir
    if kind == FILES:
        return ~is_dir
    if kind == EDIT:
        return ~is_dir & ~F.coalesce(F.lower(paths.extension(F.col("path"))).isin(BINARY_EXTENSIONS), F.lit(False))
    raise ValueError(f"unknown kind {kind!r}")


def extension_filter(extension: str | None) -> Column:
    if extension is None:
        return F.lit(True)
    return F.coalesce(F.lower(paths.extension(F.col("path"))) == extension.lower(), F.lit(False))


def letter_masks(low: str) -> dict[str, int]:
    """For each character of a text, the places where it stands, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(low):
        out[c] = out.get(c, 0) | 1 << i
    return out


def holds_nearly(text: Column, masks: Column, n: Column, distance: Column) -> Column:
    """Whether some part of `text` is within the edit distance of a pattern of n characters (62 at most), given by its letter_masks.

    One pass over the text, however long the pattern: a column of the table of
    distances is two longs, whose bits say where it rises and falls, and a step
    takes some additions and shifts on them.
    """
    one = F.lit(1).cast("long")
    shift = lambda x, k: F.call_function("shiftleft", x, k)
    full, top = shift(one, n) - one, shift(one, n - 1)
    seen = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.coalesce(F.try_element_at(masks, F.substring(text, i, F.lit(1))), F.lit(0).cast("long")))

    def step(s: Column, eq: Column) -> Column:
        up, down = s["up"], s["down"]
        across = (eq.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(eq)
        rise = down.bitwiseOR(F.bitwise_not(across.bitwiseOR(up)).bitwiseAND(full))
        fall = up.bitwiseAND(across)
        score = s["score"] + F.when(rise.bitwiseAND(top) != 0, 1).when(fall.bitwiseAND(top) != 0, -1).otherwise(0)
        rise, fall, beside = F.shiftleft(rise, 1).bitwiseAND(full), F.shiftleft(fall, 1).bitwiseAND(full), eq.bitwiseOR(down)
        new_up = fall.bitwiseOR(F.bitwise_not(beside.bitwiseOR(rise)).bitwiseAND(full))
        return F.struct(new_up.alias("up"), rise.bitwiseAND(beside).alias("down"), score.alias("score"), (s["near"] | (score <= distance)).alias("near"))

    start = F.struct(full.alias("up"), F.lit(0).cast("long").alias("down"), n.cast("int").alias("score"), (n <= distance).alias("near"))
    return F.aggregate(seen, start, step, lambda s: s["near"])


MOST_BITS = 62


def typo_pieces(low: str, distance: int) -> list[str]:
    """distance + 1 pieces of the text: that many typos leave one of them as it is."""
    n = distance + 1
    cuts = [i * len(low) // n for i in range(n + 1)]
    return [low[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def fuzzy(path: Column, text: str, distance: int, windows: bool = True) -> Column:
    """The name holds the text, or part of the stem (windows) or the whole of it is within the distance."""
    low = text.lower()
    if not low:
        return F.lit(True)
    stem, n = F.lower(paths.stem(path)), len(low)
    near = lambda x: F.levenshtein(F.lit(low), x, distance) >= 0
    whole = near(stem)
    exact = F.contains(F.lower(paths.name(path)), F.lit(low))
    if not windows or not distance:
        # without typos a window is the text itself, which the name's test covers
        return exact | (whole if not windows else (F.length(stem) <= n) & whole)
    if n <= MOST_BITS:
        masks = F.create_map(*(F.lit(x) if isinstance(x, str) else F.lit(x).cast("long") for pair in letter_masks(low).items() for x in pair))
        intact = F.lit(False)
        for piece in typo_pieces(low, distance):
            intact = intact | F.contains(stem, F.lit(piece))  # generated code, which leaves few rows to the pass over their letters
        fits = intact & holds_nearly(stem, masks, F.lit(n), F.lit(distance))
    else:
        fits = F.exists(
            F.sequence(F.lit(n - distance), F.least(F.lit(n + distance), F.length(stem))),
            lambda w: F.exists(F.sequence(F.lit(1), F.length(stem) - w + 1), lambda i: near(F.substring(stem, i, w))),
        )
    return exact | F.when(F.length(stem) <= n, whole).otherwise(fits)


def text_filter(query: Query, tagged: bool = False) -> Column:
    """tagged: the route over tag entries, where typos are allowed for the whole stem only."""
    path, low = F.col("path"), F.lower(F.col("path"))
    if query.mode == REGEX:
        return path.rlike(patterns.java_regex(query.text))
    if query.mode == GLOB:
        regex = patterns.glob_regex(f"*{query.text}*")
        return paths.name(path).rlike(regex) | path.rlike(regex)
    if query.mode == FUZZY:
        return fuzzy(path, query.text, query.distance, windows=not tagged)
    found = F.lit(True)
    if query.segments:
        found = paths.in_segments(path, query.segments)
    if query.text:
        where = paths.name(low) if query.kind == FOLDERS else low
        found = F.contains(where, F.lit(query.text.lower())) & found
    return found


def row_filter(query: Query) -> Column:
    return kind_filter(query.kind) & extension_filter(query.extension) & text_filter(query)


def _holds(name: str):
    return lambda tag: F.contains(F.lower(tag), F.lit(name.lower()))


def tag_filter(groups: tuple[TagGroup, ...], tags: Column) -> Column:
    """Every group holds: one of its alternatives, each name a part of some tag, case-insensitive. An empty group: any tag."""
    out = F.lit(True)
    for group in groups:
        any_ = F.lit(False) if group else F.size(tags) > 0
        for names in group:
            all_ = F.lit(True)
            for name in names:
                all_ = all_ & F.exists(tags, _holds(name))
            any_ = any_ | all_
        out = out & any_
    return out

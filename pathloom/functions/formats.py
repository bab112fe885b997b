"""Display forms and small validators, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30


def size_text(size: Column) -> Column:
    """1023 B, 1.0 KiB, 5.0 MiB, 3.0 GiB; one decimal, half to even."""
    tenths = lambda unit: F.call_function("format_number", size / float(unit), F.lit("0.0"))
    return (
        F.when(size < KIB, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < MIB, F.concat(tenths(KIB), F.lit(" KiB")))
        .when(size < GIB, F.concat(tenths(MIB), F.lit(" MiB")))
        .otherwise(F.concat(tenths(GIB), F.lit(" GiB")))
    )


def listing_size(size: Column) -> Column:
    """Size as a long listing shows it: powers of 1024, rounded up, one decimal under ten."""
    units = "KMGTPE"
    out = F.lit(None).cast("string")
    for i in range(len(units), 0, -1):
        value = size / float(1 << (10 * i))
        tenths = F.ceil(value * 10).cast("long")
        small = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
        text = F.when(tenths < 100, small).otherwise(F.ceil(value).cast("string"))
        text = F.concat(text, F.lit(units[i - 1]))
        out = text if i == len(units) else F.when(value < 1024, text).otherwise(out)
    return F.when(size < KIB, size.cast("string")).otherwise(out)


def listing_time(mtime: Column, now: int) -> Column:
    """Time of day within half a year before `now` (a minute after it), else the year. Epoch seconds, session time zone."""
    at = F.timestamp_seconds(mtime)
    day = F.concat(F.date_format(at, "MMM "), F.lpad(F.date_format(at, "d"), 2, " "))
    recent = (mtime >= now - int(182.5 * 86400)) & (mtime <= now + 60)
    return F.when(recent, F.concat(day, F.date_format(at, " HH:mm"))).otherwise(F.concat(day, F.lit("  "), F.date_format(at, "yyyy")))


def date_text(mtime: Column, now: int) -> Column:
    """Today: the time; this year: day and time; else the date and time. Empty for 0 or less."""
    at, today = F.timestamp_seconds(mtime), F.timestamp_seconds(F.lit(now))
    clock = F.lower(F.date_format(at, "h:mm a"))
    return (
        F.when(mtime <= 0, F.lit(""))
        .when(F.to_date(at) == F.to_date(today), clock)
        .when(F.year(at) == F.year(today), F.concat(F.date_format(at, "MMM d "), clock))
        .otherwise(F.concat(F.date_format(at, "yyyy-MM-dd "), clock))
    )


def mode_text(mode: Column) -> Column:
    """-rwxr-xr-x from mode bits."""
    kind = F.shiftright(mode.bitwiseAND(0o170000), 12)
    # File type codes and their letters.
    letters = {0o04: "d", 0o12: "l", 0o10: "-", 0o06: "b", 0o02: "c", 0o01: "p", 0o14: "s"}
    first = F.lit("?")
    for code, letter in letters.items():
        first = F.when(kind == code, F.lit(letter)).otherwise(first)
    bit = lambda mask: mode.bitwiseAND(mask) != 0
    parts = [first]
    for shift, special, letter in ((6, 0o4000, "s"), (3, 0o2000, "s"), (0, 0o1000, "t")):
        run = bit(1 << shift)
        parts += [
            F.when(bit(4 << shift), "r").otherwise("-"),
            F.when(bit(2 << shift), "w").otherwise("-"),
            F.when(bit(special), F.when(run, letter).otherwise(letter.upper())).otherwise(F.when(run, "x").otherwise("-")),
        ]
    return F.concat(*parts)


def valid_tag(tag: Column) -> Column:
    """Trimmed, not empty, without a comma or control characters."""
    return (F.trim(tag) != "") & ~tag.rlike(r"[,\p{Cc}]")


def tag_list(text: Column) -> Column:
    """Tags of a comma-separated text, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")


def duration_text(seconds: Column) -> Column:
    """m:ss"""
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad(F.floor(seconds % 60).cast("string"), 2, "0"))


def system_names(groups: bool = False) -> dict[int, str]:
    """The users, or groups, that this machine knows, by number; the first name of a number holds."""
    import grp
    import pwd

    known = [(g.gr_gid, g.gr_name) for g in grp.getgrall()] if groups else [(u.pw_uid, u.pw_name) for u in pwd.getpwall()]
    return dict(reversed(known))


def owner_name(uid: Column, names: dict[int, str] | None = None, groups: bool = False) -> Column:
    """Name of a numeric owner or group, or the number itself; names: by number, by default those the system knows."""
    names = system_names(groups) if names is None else names
    if not names:
        return uid.cast("string")
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), uid.cast("int")), uid.cast("string"))

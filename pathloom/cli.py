"""Tags from the command line: python -m pathloom.cli COMMAND ..."""

from __future__ import annotations

import os
import sys

from .sources.store import TagStore, TagStoreError

USAGE = """usage: [--store DIR] COMMAND
  init [DIR]
  add|rm|set FILE TAG...   or   add|rm|set -t TAG [-t TAG...] FILE...   (rm --all FILE...)
  ls [--plain] [PATH...]
  find [TAG...] [--any TAG...] [--not TAG...] [--show-tags]
  tags
  mv SOURCE TARGET
  repair [--prune] [--dry-run]
  check [--verify]"""


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("pathloom").getOrCreate()


def _change(store, command: str, args: list[str]) -> list[str]:
    tags, files, all_ = [], [], False
    rest = iter(args)
    for a in rest:
        if a in ("-t", "--tag"):
            tag = next(rest, None)
            if tag is None:
                raise TagStoreError("-t needs a tag")
            tags.append(tag)
        elif a == "--all" and command == "rm":
            all_ = True
        else:
            files.append(a)
    if not all_ and not tags:
        if len(files) < 2:
            raise TagStoreError(USAGE)
        files, tags = files[:1], files[1:]
    if not files:
        raise TagStoreError("no files given")
    own = store or TagStore.discover(os.path.dirname(os.path.abspath(files[0])))
    done = own.remove(files, tags, all_) if command == "rm" else getattr(own, {"add": "add", "set": "set_tags"}[command])(files, tags)
    return [f"{rel}: {', '.join(t)}" for rel, t in done.items()]


def listing(rows: list, plain: bool, now: int | None = None) -> list[str]:
    """rows: (name, is_dir, tags, stat)."""
    import grp
    import pwd
    import stat as modes
    import time

    if plain:
        width = max((len(n) + d for n, d, _, _ in rows), default=0)
        return [f"{n}/" if d else f"{n:<{width}}  {', '.join(t) or '-'}" for n, d, t, _ in rows]

    def size(n: int) -> str:
        if n < 1024:
            return str(n)
        for power, unit in enumerate("KMGTPE", 1):
            if n < 1024 ** (power + 1) or unit == "E":
                tenths = -(-n * 10 // 1024**power)
                return f"{tenths // 10}.{tenths % 10}{unit}" if tenths < 100 else f"{-(-n // 1024**power)}{unit}"

    def named(find, i):
        try:
            return find(i)[0]
        except KeyError:
            return str(i)

    now = int(time.time()) if now is None else now
    rows = sorted(rows, key=lambda r: not r[1])
    lines = [f"total {size(512 * sum(r[3].st_blocks for r in rows))}"]
    cells = []
    for name, is_dir, tags, s in rows:
        at = time.localtime(s.st_mtime)
        recent = now - int(182.5 * 86400) <= int(s.st_mtime) <= now + 60
        when = f"{time.strftime('%b', at)} {at.tm_mday:2} " + (time.strftime("%H:%M", at) if recent else f" {at.tm_year}")
        cells.append((modes.filemode(s.st_mode), str(s.st_nlink), named(pwd.getpwuid, s.st_uid), named(grp.getgrgid, s.st_gid), size(s.st_size), when))
    w = [max((len(c[i]) for c in cells), default=0) for i in range(6)]
    wide = max((len(n) + d for n, d, _, _ in rows), default=0)
    for (name, is_dir, tags, _), c in zip(rows, cells):
        left = f"{c[0]} {c[1]:>{w[1]}} {c[2]:<{w[2]}} {c[3]:<{w[3]}} {c[4]:>{w[4]}} {c[5]}"
        lines.append(f"{left} {name}/" if is_dir else f"{left} {name:<{wide}}  {', '.join(tags) or '-'}")
    return lines


def _list(store, args: list[str]) -> list[str]:
    plain, where = "--plain" in args, [a for a in args if a != "--plain"] or ["."]
    own, out = store or TagStore.discover(where[0]), []
    for i, path in enumerate(where):
        if not os.path.isdir(path):
            out.append(f"{own.rel(path)}: {', '.join(own.get(path))}")
            continue
        if len(where) > 1:
            out += [""] * bool(i) + [f"{path}:"]
        out += listing(own.list_dir(path), plain)
    return out


def _find(store, args: list[str]) -> list[str]:
    buckets = {"": [], "--any": [], "--not": []}
    at, shown = "", False
    for a in args:
        if a in ("--any", "--not"):
            at = a
        elif a == "--show-tags":
            shown = True
        else:
            buckets[at].append(a)
    found = (store or TagStore.discover(".")).find(*buckets.values())
    return [f"{rel}: {', '.join(tags)}" if shown else rel for rel, tags in found.items()]


def _tags(store) -> list[str]:
    n = (store or TagStore.discover(".")).tag_counts()
    width = max((len(str(x)) for x in n.values()), default=1)
    return [f"{x:>{width}}  {t}" for t, x in n.items()]


def _repair(store, args: list[str]) -> tuple[int, list[str]]:
    prune, dry = "--prune" in args, "--dry-run" in args
    rows = (store or TagStore.discover(".")).repair(_spark(), prune, dry)
    lines = [f"relinked: {r} -> {new}" for s, r, new, _ in rows if s == "relinked"]
    lines += [f"refreshed fingerprint: {r}" for s, r, _, _ in rows if s == "refreshed"]
    lines += [f"ambiguous: {r} matches {', '.join(c)}; mv says which" for s, r, _, c in rows if s == "ambiguous"]
    lines += [f"missing: {r}{' (pruned)' if s == 'pruned' else ' (--prune drops it)'}" for s, r, _, _ in rows if s in ("missing", "pruned")]
    if not rows:
        lines.append("nothing to repair")
    if dry:
        lines.append("dry run: the store is as before")
    return int(any(s in ("ambiguous", "missing") for s, *_ in rows)), lines


def _check(store, args: list[str]) -> tuple[int, list[str]]:
    rows = [(r.status, r.rel) for r in (store or TagStore.discover(".")).check(_spark(), "--verify" in args).orderBy("rel").collect()]
    untracked = sum(s == "untracked" for s, _ in rows)
    lines = [f"entries: {len(rows) - untracked}  untracked files: {untracked}"]
    for status, label in (("missing", "missing"), ("modified", "modified since tagging"), ("mismatch", "fingerprint mismatch")):
        lines += [f"{label}: {r}" for s, r in rows if s == status]
    bad = len(lines) > 1
    return int(bad), [*lines, "problems found: see repair" if bad else "ok"]


def run(args: list[str]) -> tuple[int, list[str]]:
    """(exit code, lines)"""
    args, store = list(args), None
    while "--store" in args:
        at = args.index("--store")
        if at + 1 == len(args):
            raise TagStoreError("--store needs a directory")
        store = TagStore(args[at + 1])
        del args[at : at + 2]
    command, rest = (args[0], args[1:]) if args else ("", [])
    if command == "init":
        return 0, [f"initialized tag store at {TagStore.init(rest[0] if rest else '.').root}"]
    if command in ("add", "rm", "set"):
        return 0, _change(store, command, rest)
    if command == "ls":
        return 0, _list(store, rest)
    if command == "find":
        return 0, _find(store, rest)
    if command == "tags":
        return 0, _tags(store)
    if command == "mv":
        if len(rest) != 2:
            raise TagStoreError("usage: mv SOURCE TARGET")
        return 0, ["{} -> {}".format(*(store or TagStore.discover(os.path.dirname(os.path.abspath(rest[0])))).move(*rest))]
    if command == "repair":
        return _repair(store, rest)
    if command == "check":
        return _check(store, rest)
    if command in ("help", "--help", "-h"):
        return 0, [USAGE]
    raise TagStoreError(f"unknown command {command!r}\n{USAGE}")


def main() -> int:
    try:
        code, lines = run(sys.argv[1:])
    except (TagStoreError, ValueError, OSError) as problem:
        print(f"pathloom: {problem}", file=sys.stderr)
        return 1
    print("\n".join(lines))
    return code


if __name__ == "__main__":
    sys.exit(main())

"""Markdown texts as simple HTML, for previews: headings, paragraphs, nested lists, quotes, tables, fences, rules and inline marks."""

from __future__ import annotations

import html
import re

_ITEM = re.compile(r"( *)([-*+]|\d{1,9}[.)])( +|$)(.*)")
_HEADING = re.compile(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r" {0,3}(```+|~~~+)")
_QUOTE = re.compile(r" {0,3}> ?(.*)")
_RULE = re.compile(r" {0,3}([-*_])( *\1){2,} *$")
_DASHES = re.compile(r" *\|? *:?-+:? *(\| *:?-+:? *)*\|? *$")


def inline(line: str, base: str, width: int) -> str:
    """Emphasis, code, links and images; images get a width, and sources below `base`."""
    kept: list[str] = []

    def code(m) -> str:
        kept.append(f"<code>{m[2].strip()}</code>")
        return f"\0{len(kept) - 1}\0"

    def image(m) -> str:
        source = m[2] if re.match(r"[a-z]+:|/", m[2]) else f"{base.rstrip('/')}/{m[2]}" if base else m[2]
        return f'<img src="{source}" alt="{m[1]}" width="{width}">'

    line = re.sub(r"(`+)(.+?)\1", code, html.escape(line.replace("\0", ""), quote=False))  # what is code has no other marks
    line = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", image, line)
    line = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', line)
    line = re.sub(r"\*\*([^*]+)\*\*|__([^_]+)__", lambda m: f"<strong>{m[1] or m[2]}</strong>", line)
    line = re.sub(r"\*([^*]+)\*", r"<em>\1</em>", line)
    line = re.sub(r"~~([^~]+)~~", r"<del>\1</del>", line)
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], line)


def _cells(line: str) -> list[str]:
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


class _Reader:
    def __init__(self, base: str, width: int):
        self.inline = lambda line: inline(line, base, width)

    def blocks(self, lines: list[str], depth: int = 0) -> list[str]:
        out, paragraph, at = [], [], 0

        def flush() -> None:
            if paragraph:
                out.append(f"<p>{self.inline(' '.join(paragraph))}</p>")
                paragraph.clear()

        while at < len(lines):
            line = lines[at]
            table = "|" in line and at + 1 < len(lines) and _DASHES.match(lines[at + 1]) and len(_cells(lines[at + 1])) == len(_cells(line))
            if m := _FENCE.match(line):
                end = next((i for i in range(at + 1, len(lines)) if lines[i].strip().startswith(m[1])), len(lines))
                flush()
                out.append("<pre><code>" + html.escape("\n".join(lines[at + 1 : end]), quote=False) + "</code></pre>")
                at = end + 1
            elif m := _HEADING.match(line):
                flush()
                out.append(f"<h{len(m[1])}>{self.inline(m[2])}</h{len(m[1])}>")
                at += 1
            elif _RULE.match(line):
                flush()
                out.append("<hr>")
                at += 1
            elif depth < 16 and _QUOTE.match(line):
                flush()
                own = []
                while at < len(lines) and (m := _QUOTE.match(lines[at])):
                    own.append(m[1])
                    at += 1
                out.append("<blockquote>" + "\n".join(self.blocks(own, depth + 1)) + "</blockquote>")
            elif depth < 16 and _ITEM.match(line):
                flush()
                text, at = self.list_of(lines, at, depth)
                out.append(text)
            elif table:
                flush()
                text, at = self.table(lines, at)
                out.append(text)
            else:
                if line.strip():
                    paragraph.append(line.strip())
                else:
                    flush()
                at += 1
        flush()
        return out

    def list_of(self, lines: list[str], at: int, depth: int) -> tuple[str, int]:
        """The list that begins at a line, and the line after it. What is indented as far as an item's text belongs to it."""
        first = _ITEM.match(lines[at])
        ordered, items = first[2][-1] in ".)", []
        while at < len(lines) and (m := _ITEM.match(lines[at])) and len(m[1]) <= len(first[1]) + 1 and (m[2][-1] in ".)") == ordered:
            inner, own, at = len(m[1]) + len(m[2]) + 1, [m[4]], at + 1
            while at < len(lines):
                line = lines[at]
                indent = len(line) - len(line.lstrip(" "))
                after = next((x for x in lines[at:] if x.strip()), "")
                if not line.strip():
                    if len(after) - len(after.lstrip(" ")) < inner:
                        break
                elif indent < inner and (indent <= len(m[1]) + 1 and _ITEM.match(line) or not lines[at - 1].strip() or _HEADING.match(line) or _FENCE.match(line) or _QUOTE.match(line)):
                    break
                own.append(line[min(indent, inner) :])
                at += 1
            parts = self.blocks(own, depth + 1)
            items.append("\n".join(p[3:-4] if p.startswith("<p>") and sum(x.startswith("<p>") for x in parts) == 1 else p for p in parts))
            blank = at
            while blank < len(lines) and not lines[blank].strip():
                blank += 1
            if blank > at and blank < len(lines) and (n := _ITEM.match(lines[blank])) and len(n[1]) <= len(first[1]) + 1:
                at = blank  # items may stand apart
        start = first[2][:-1]
        opened = f'<ol start="{int(start)}">' if ordered and int(start) != 1 else "<ol>" if ordered else "<ul>"
        return opened + "".join(f"<li>{i}</li>" for i in items) + ("</ol>" if ordered else "</ul>"), at

    def table(self, lines: list[str], at: int) -> tuple[str, int]:
        sides = ["center" if d[0] == d[-1] == ":" and len(d) > 1 else "right" if d[-1] == ":" else "left" if d[0] == ":" else "" for d in _cells(lines[at + 1])]
        row = lambda cells, tag: "<tr>" + "".join(f'<{tag}{f" align=\"{s}\"" if s else ""}>{self.inline(c)}</{tag}>' for c, s in zip([*cells, *[""] * len(sides)], sides)) + "</tr>"
        out, at = [row(_cells(lines[at]), "th")], at + 2
        while at < len(lines) and "|" in lines[at] and lines[at].strip():
            out.append(row(_cells(lines[at]), "td"))
            at += 1
        return "<table>" + "".join(out) + "</table>", at


def to_html(text: str, base: str = "", width: int = 400) -> str:
    """HTML of a text, a block a line. Sources of images that aren't absolute lie below `base`. Quotes and lists nest 16 deep at most."""
    return "\n".join(_Reader(base, width).blocks([line.expandtabs(4) for line in text.splitlines()]))

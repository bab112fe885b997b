"""Regular expressions and globs, checked and translated for the JVM's dialect."""

from __future__ import annotations

import re
import warnings

# Constructs that the JVM has and the query language hasn't: look-around, atomic groups, back-references.
_FOREIGN = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k[<{']|\\[GXRQE]")
_POSIX = {n: f"\\p{{{n.capitalize()}}}" for n in ("alpha", "digit", "alnum", "upper", "lower", "punct", "blank", "space", "cntrl", "graph", "print")}


def java_regex(pattern: str) -> str | None:
    """The pattern for rlike: case-insensitive with Unicode folding, "." stops at line feeds only. None if invalid."""
    bare = re.sub(r"\\\\", "", pattern)
    if _FOREIGN.search(bare):
        return None
    java = re.sub(r"\[:(\w+):\]", lambda m: _POSIX.get(m[1], m[0]), pattern)
    java = java.replace("(?P<", "(?<")
    java = re.sub(r"(?<!\\)((?:\\\\)*)\\[uU]\{([0-9A-Fa-f]+)\}", r"\1\\x{\2}", java)  # a character by its number
    java = re.sub(r"(?<!\\)([*+?}])\+", r"\1", java)  # a repeated "+" changes nothing for a test; the JVM would read it as possessive
    probe = re.sub(r"\\x\{[0-9A-Fa-f]{1,6}\}", "x", java)
    probe = re.sub(r"\\[pP](?:\{\^?[\w=:]+\}|[A-Z])", "x", probe).replace(r"\z", r"\Z").replace("(?<", "(?P<")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(probe)
    except (re.error, OverflowError, RecursionError):
        return None
    return "(?idU)" + java


def required_literals(pattern: str) -> list[str]:
    """Texts that every match of a (valid) pattern has in it, lower-cased; perhaps none.

    Sound, not complete: only plain characters in sequence at the top level
    count. "s" ends a text, as another character folds to it in patterns alone.
    """
    if "|" in pattern or not pattern.isascii():
        return []
    # what may be optional, and groups, classes and escapes, become breaks
    plain = re.sub(r"\\.|\[(?:\\.|[^\]])*\]|\((?:\\.|[^)])*\)[?*+{]?", "\0", pattern)
    if any(c in plain for c in "()[]"):
        return []
    plain = re.sub(r".\{[^}]*\}|.[?*]", "\0", plain)
    return [t for t in re.split(r"[^a-z0-9 _,;:=@#%&~'\"<>!-]+", plain.lower().replace("s", "\0")) if t]


def glob_literals(glob: str) -> list[str]:
    """Texts without a slash that every path matched by a glob has in it, lower-cased; perhaps none."""
    if re.search(r"[{}\\]", glob):
        return []  # alternatives and escapes
    return [t.lower() for t in re.split(r"\[[!^]?.[^\]]*\]|[*?/\[\]]", glob, flags=re.DOTALL) if t]


def glob_regex(glob: str) -> str | None:
    """The glob as an anchored pattern: * and ? take any character, "/" too. None if a class or brace stays open."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            run = len(glob[i:]) - len(glob[i:].lstrip("*"))
            before, after = glob[:i], glob[i + run :]
            if run == 2 and (not before or before.endswith("/")) and after.startswith("/"):
                out.append("(?:/?|.*/)" if not before else "(?:|.*/)")
                i += run + 1
                continue
            out.append(".*")
            i += run
            continue
        if c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))
            if end < 0:
                return None
            body = glob[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = re.sub(r"([\\\[\]&^])", r"\\\1", body[negated:])
            if any(a > b for a, b in re.findall(r"([^\\])-([^\\])", body)):
                return None
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            depth -= 1
            if depth < 0:
                return None
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\":
            if i + 1 == len(glob):
                return None
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return None if depth else "(?s)^" + "".join(out) + "$"

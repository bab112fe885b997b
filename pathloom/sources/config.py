"""Settings: a small JSON file on the driver. A bad file gives defaults and isn't touched."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from ..operators.search import DEFAULT_RESULTS, MOST_RESULTS


def clean_path(text: str) -> str:
    """~ as the home folder; no trailing slashes."""
    if text == "~" or text.startswith("~/"):
        text = os.path.expanduser("~") + text[1:]
    return text.rstrip("/") or ("/" if text.startswith("/") else "")


@dataclass
class Settings:
    bookmarks: list[dict] = field(default_factory=list)  # {name, path, is_network}
    max_results: int = DEFAULT_RESULTS
    exclude_paths: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Settings:
        try:
            with open(path, encoding="utf-8") as f:
                raw = json.load(f)
        except (OSError, ValueError):
            return cls()
        if not isinstance(raw, dict):
            return cls()
        known = {k: raw[k] for k, v in asdict(cls()).items() if isinstance(raw.get(k), type(v))}
        out = cls(**known)
        out.exclude_paths = [p for p in map(clean_path, out.exclude_paths) if p]
        return out

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2, ensure_ascii=False)
            f.write("\n")

    def roots(self) -> list[tuple[str, str]]:
        return [(b["name"], clean_path(b["path"])) for b in self.bookmarks]

    def results(self) -> int:
        return max(1, min(self.max_results, MOST_RESULTS))

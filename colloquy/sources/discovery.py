"""Finding store files: path templates for a given platform, bounded walks, globs. Driver-side, by listing only.

The result is a list of explicit paths, because Spark's file sources skip names that begin with a dot or underscore.
"""

from __future__ import annotations

import fnmatch
import os
import re
from dataclasses import dataclass, field

MAX_DEPTH, MAX_FILES, MAX_ENTRIES = 12, 20_000, 200_000
#: Editors that keep the same storage layout.
EDITORS = ("Code", "Code - Insiders", "VSCodium", "Cursor", "Windsurf", "Trae", "PearAI")


@dataclass(frozen=True)
class Platform:
    """Where things are; passed in, never taken from the process, so that any platform can be asked about."""

    name: str = "linux"
    home: str = "/home/user"
    env: dict = field(default_factory=dict)
    project: str | None = None

    @property
    def config(self) -> str:
        if self.name == "windows":
            return self.env.get("APPDATA", f"{self.home}/AppData/Roaming").replace("\\", "/")
        return f"{self.home}/Library/Application Support" if self.name == "macos" else self.env.get("XDG_CONFIG_HOME", f"{self.home}/.config")

    @property
    def data(self) -> str:
        if self.name == "windows":
            return self.env.get("LOCALAPPDATA", f"{self.home}/AppData/Local").replace("\\", "/")
        return f"{self.home}/Library/Application Support" if self.name == "macos" else self.env.get("XDG_DATA_HOME", f"{self.home}/.local/share")


_INNER = re.compile(r"\$\{([A-Za-z_]\w*)(?::-([^${}]*))?\}")


def expand(template: str, platform: Platform) -> list[str]:
    """Absolute patterns of a template. An unset variable without a default, or a missing project, drops it; other
    platforms' variables do too."""
    text = template
    for _ in range(8):
        found = _INNER.search(text)
        if not found:
            break
        value = platform.env.get(found[1]) or found[2]
        if value is None:
            return []
        text = text[: found.start()] + value + text[found.end() :]
    missing = [v for v in re.findall(r"%([A-Za-z_]+)%", text) if v not in platform.env]
    if missing or "${" in text:
        return []
    text = re.sub(r"%([A-Za-z_]+)%", lambda m: platform.env[m[1]], text).replace("\\", "/")
    if "<project>" in text:
        if not platform.project:
            return []
        text = text.replace("<project>", platform.project)
    text = text.replace("<config>", platform.config).replace("<data>", platform.data)
    if text.startswith("~"):
        text = platform.home + text[1:]
    texts = [text.replace("<vscode-User>", f"{platform.config}/{e}/User") for e in EDITORS] if "<vscode-User>" in text else [text]
    return [t for t in dict.fromkeys(texts) if re.match(r"(/|[A-Za-z]:/)[^*?]", t)]


def _fixed_part(pattern: str) -> str:
    parts = []
    for part in pattern.split("/")[:-1]:
        if any(c in part for c in "*?[{"):
            break
        parts.append(part)
    return "/".join(parts) or "/"


def matches(path: str, pattern: str) -> bool:
    """Glob over path segments; ** is any number of them."""
    def fits(a: list[str], b: list[str]) -> bool:
        if not b:
            return not a
        if b[0] == "**":
            return any(fits(a[i:], b[1:]) for i in range(len(a) + 1))
        return bool(a) and fnmatch.fnmatchcase(a[0], b[0]) and fits(a[1:], b[1:])

    return fits(path.split("/"), pattern.split("/"))


def walk(root: str) -> list[str]:
    """Files below root, breadth first, within MAX_DEPTH, MAX_FILES and MAX_ENTRIES; dot files too, links not followed."""
    found, level, seen = [], [root], 0
    for _ in range(MAX_DEPTH):
        below = []
        for folder in level:
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                seen += 1
                if seen > MAX_ENTRIES or len(found) >= MAX_FILES:
                    return found
                if e.is_dir(follow_symlinks=False):
                    below.append(e.path)
                elif e.is_file():
                    found.append(e.path)
        level = below
    return found


def store_files(harnesses: list[tuple[str, str, str, list[str]]], platform: Platform, only: tuple[str, ...] = (), most: int = 400) -> list[tuple[str, str, str]]:
    """(harness, format kind, path) of the files that exist, each once per harness, at most so many of one."""
    out = []
    for key, _, kind, templates in harnesses:
        if only and key not in only:
            continue
        mine: dict[str, None] = {}
        for pattern in (p for t in templates for p in expand(t, platform)):
            if not any(c in pattern for c in "*?["):
                paths = [pattern] if os.path.isfile(pattern) else []
            else:
                root = _fixed_part(pattern)
                paths = [p for p in walk(root) if matches(p, pattern)] if root not in ("/", "") else []
            mine |= dict.fromkeys(paths)
        out += [(key, kind, p) for p in list(mine)[:most]]
    return out

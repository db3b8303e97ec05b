"""Ignore files: patterns with wildcards, anchors, directories and negation, from the deepest folder up."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from pathlib import Path

from lodestrand.config import GLOBAL_IGNORE_FOLDER


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern[str]
    negated: bool
    folders_only: bool


def _translated(glob: str) -> str:
    """A glob as a regular expression for a path relative to the rule's folder."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out, k = out + "(?:[^/]+/)*", k + 3
            continue
        if glob[k:] == "**" and (k == 0 or glob[k - 1] == "/"):
            return out + ".+"
        if c == "*":
            while glob.startswith("*", k + 1):
                k += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", k + 2)) > 0:
            body = glob[k + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + body[1:] if body[0] in '!^' else body}]"
            k = end
        elif c == "\\" and k + 1 < len(glob):
            k += 1
            out += re.escape(glob[k])
        else:
            out += re.escape(c)
        k += 1
    return out


def parse(text: str) -> list[Rule]:
    rules = []
    for line in text.splitlines():
        line = line if line.endswith("\\ ") else line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line
        folders = line.endswith("/")
        line = line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        body = _translated(line.lstrip("/"))
        rules.append(Rule(re.compile(f"{'' if anchored else '(?:.*/)?'}{body}\\Z", re.S), negated, folders))
    return rules


def verdict(rules: list[Rule], path: str, folder: bool) -> bool | None:
    """Whether the last rule that fits ignores the path; None if none fits."""
    for rule in reversed(rules):
        if (folder or not rule.folders_only) and rule.pattern.match(path):
            return not rule.negated
    return None


class Ignores:
    """The rules that hold below a root: the custom file of each folder, version control's (only
    inside a repository), and the user's global files. Deeper folders go before higher ones, and
    custom files before version control's."""

    def __init__(self, root: Path, ignore_file: str, home: Path | None = None, patterns: tuple[str, ...] = ()):
        self.root, self.ignore_file = root, ignore_file
        home = home or Path(os.environ.get("HOME", "/nonexistent"))
        self.repository = next((p for p in (root, *root.parents) if (p / ".git").exists()), None)
        self.shared = self._read(home / GLOBAL_IGNORE_FOLDER / ignore_file)
        self.last = parse("\n".join(patterns))
        self.vcs_global, self.vcs_exclude = [], []
        if self.repository:
            self.vcs_global = self._read(Path(os.environ.get("XDG_CONFIG_HOME", home / ".config")) / "git" / "ignore")
            self.vcs_exclude = self._read(self.repository / ".git" / "info" / "exclude")
        self.known: dict[Path, tuple[list[Rule], list[Rule]]] = {}

    @staticmethod
    def _read(path: Path) -> list[Rule]:
        try:
            return parse(path.read_text("utf-8", "replace"))
        except OSError:
            return []

    def _of(self, folder: Path) -> tuple[list[Rule], list[Rule]]:
        if folder not in self.known:
            self.known[folder] = (self._read(folder / self.ignore_file), self._read(folder / ".gitignore") if self.repository else [])
        return self.known[folder]

    def ignored(self, path: Path, folder: bool) -> bool:
        """Whether a path, whose folders are not ignored themselves, is."""
        top = self.repository or self.root
        above = [p for p in path.parents if p == top or top in p.parents or p == self.root or self.root in p.parents]
        for kind in (0, 1):
            for parent in above:
                found = verdict(self._of(parent)[kind], path.relative_to(parent).as_posix(), folder)
                if found is not None:
                    return found
        relative = path.relative_to(self.root).as_posix()
        inside = path.relative_to(top).as_posix() if top == path or top in path.parents else relative
        for rules, name in ((self.shared, relative), (self.vcs_exclude, inside), (self.vcs_global, inside), (self.last, relative)):
            found = verdict(rules, name, folder)
            if found is not None:
                return found
        return False

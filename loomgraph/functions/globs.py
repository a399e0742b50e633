"""Path globs, compiled once on the driver to regular expressions that run inside the JVM."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ReportError

_UNSUPPORTED = re.compile(r"[?\[\]{}!]")


@dataclass(frozen=True)
class Glob:
    text: str
    regex: str
    prefix: int  # characters before the first star
    stars: int  # a double star counts as two

    @property
    def directory(self) -> str | None:
        """The directory of which the glob takes every file below, else None."""
        head = self.text[: self.prefix]
        return head[:-1] if self.text == head + "**" and head.endswith("/") else None

    def matches(self, path: Column) -> Column:
        """A plain prefix test where the glob is one, tests of both ends where it has one star, else the
        regular expression behind its literal prefix, which turns most paths away without it."""
        head = self.text[: self.prefix]
        if self.directory is not None:
            return path.startswith(head)
        if self.stars == 1:
            tail = self.text[self.prefix + 1 :]
            middle = F.substring(path, F.lit(len(head) + 1), F.length(path) - len(head) - len(tail))
            ends = path.startswith(head) & path.endswith(tail) if head else path.endswith(tail)
            return ends & (F.length(path) >= len(head) + len(tail)) & ~middle.contains("/") & ~middle.contains("\n")
        return path.startswith(head) & path.rlike(self.regex) if head else path.rlike(self.regex)

    def test(self, path: str) -> bool:
        return re.search(self.regex, path) is not None


def compile_glob(text: str) -> Glob:
    """`**/` spans any number of directories, other `**` anything, `*` anything but a slash."""
    out, at = ["^"], 0
    while at < len(text):
        if text.startswith("**/", at) and (at == 0 or text[at - 1] == "/"):
            out.append("(?:.*/)?")
            at += 3
        elif text.startswith("**", at):
            out.append(".*")
            at += 2
        elif text[at] == "*":
            out.append("[^/]*")
            at += 1
        else:
            out.append(re.escape(text[at]) if not text[at].isalnum() and text[at] not in "/_" else text[at])
            at += 1
    star = text.find("*")
    return Glob(text, "".join(out) + "$", len(text) if star < 0 else star, text.count("*"))


def assert_supported(globs: list[str]) -> None:
    for g in globs:
        if not isinstance(g, str) or not g:
            raise ReportError("A glob must be a non-empty string.", "Write a path pattern such as src/part/**.")
        if _UNSUPPORTED.search(g):
            raise ReportError(f"The glob {g!r} uses syntax that is not supported.", "Use only * and **.")


def base_directory(glob: str) -> str:
    """The literal directory in front of the first star."""
    head = glob.split("*", 1)[0]
    return (head.rstrip("/") if head.endswith("/") else head.rpartition("/")[0]) if "*" in glob else glob.rpartition("/")[0]


def shared_directory(globs: list[str]) -> str | None:
    """The one base directory of all `globs`, or None if they differ."""
    bases = {base_directory(g) for g in globs}
    return bases.pop() if len(bases) == 1 else None


def relative_glob(module_glob: str, inner: str) -> str:
    return re.sub("/{2,}", "/", f"{base_directory(module_glob)}/{inner}").lstrip("/")


def any_match(path: Column, globs: list[str]) -> Column:
    """Whether `path` matches one of `globs`; a null path never does."""
    out = F.lit(False)
    for g in globs:
        out = out | F.coalesce(compile_glob(g).matches(path), F.lit(False))
    return out

"""Revision-checked edits: of tables of notes in batch, and of files in a vault."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import data_uri, frontmatter
from ..functions.paths import IMAGE_MIME, VaultPath
from ..sources.vault import AccessError, inside


class Conflict(RuntimeError):
    """The file is not in the revision that the edit expects."""


class NoMatch(ValueError):
    """An edit that would change nothing."""


# ---- batches -------------------------------------------------------------------------------------------------------


def apply_writes(writes: DataFrame, revisions: DataFrame) -> DataFrame:
    """writes (path, expected) against revisions (path, token): applied, conflict (another revision) or exists (none expected)."""
    known = revisions.select("path", "token")
    outcome = (
        F.when(F.col("token").isNull() & F.col("expected").isNull(), "created").when(F.col("token").isNull(), "missing").when(F.col("expected").isNull(), "exists").when(F.col("expected") == F.col("token"), "updated").otherwise("conflict")
    )
    return writes.join(known, "path", "left").withColumn("outcome", outcome)


def replace_all(content: Column, old: str, new: str) -> Column:
    return F.replace(content, F.lit(old), F.lit(new))


def replace_first(content: Column, old: str, new: str) -> Column:
    at = F.locate(old, content)
    return F.when(at == 0, content).otherwise(F.concat(F.substr(content, F.lit(1), at - 1), F.lit(new), F.substr(content, at + len(old))))


def replace_regex(content: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(content, pattern, new)


def append(content: Column, more: Column) -> Column:
    return F.concat(content, F.lit("\n"), more)


def patch_map(custom: Column, set_: Column, remove: list[str]) -> Column:
    """A map with keys removed first and then set."""
    kept = F.map_filter(custom, lambda k, _: ~k.isin(*remove) & ~F.array_contains(F.map_keys(set_), k))
    return F.map_concat(kept, set_)


# Fixed value: what a link to a stem looks like.
def link_pattern(stem: str) -> str:
    """Wikilinks to a stem, with any folders before it; group 1 is what follows the stem."""
    return r"\[\[(?:[^\]\[|#]*/)?" + re.escape(stem) + r"(\]\]|#|\|)"


def rename_links(notes: DataFrame, old_stem: str, new_stem: str) -> DataFrame:
    """notes with links to a renamed note rewritten, and whether a note changed."""
    new = F.regexp_replace("content", link_pattern(old_stem), "[[" + new_stem.replace("\\", "\\\\") + "$1")
    return notes.withColumn("rewritten", new).withColumn("changed", F.col("rewritten") != F.col("content"))


# ---- files ---------------------------------------------------------------------------------------------------------


@dataclass
class Vault:
    """A folder of notes. Every write checks the revision that it expects; tokens are milliseconds and size."""

    root: str
    denied: set[str] = field(default_factory=set)
    read_only: set[str] = field(default_factory=set)
    tracked: dict[str, str] = field(default_factory=dict)

    def deny_access(self, paths_: Iterable[str]) -> None:
        self.denied = set(paths_)

    def read_only_access(self, paths_: Iterable[str]) -> None:
        self.read_only = set(paths_)

    def _file(self, path: str, write: bool = False) -> str:
        p = VaultPath.of(path).value
        if p in self.denied or (write and p in self.read_only):
            raise AccessError(f"{path} is not accessible")
        return inside(self.root, p)

    def exists(self, path: str) -> bool:
        return os.path.isfile(self._file(path))

    def token(self, path: str) -> str:
        s = os.stat(self._file(path))
        return f"{s.st_mtime_ns // 1_000_000}:{s.st_size}"

    def read(self, path: str) -> str:
        """The text of a note, or the data URI of an image."""
        full = self._file(path)
        if VaultPath.of(path).kind == "image":
            with open(full, "rb") as f:
                import base64

                return f"data:{IMAGE_MIME[path.rsplit('.', 1)[1]]};base64,{base64.b64encode(f.read()).decode()}"
        with open(full, encoding="utf-8", newline="") as f:
            return f.read()

    def _check(self, path: str, token: str | None, full: str) -> None:
        if os.path.exists(full):
            if token is None:
                raise FileExistsError(path)
            if token != self.token(path):
                raise Conflict(path)
        elif token is not None:
            raise FileNotFoundError(path)

    def write(self, path: str, content: str, token: str | None = None) -> str:
        """Write a note (or an image's data URI) that is in revision `token`, or is new; its new token."""
        full = self._file(path, write=True)
        self._check(path, token, full)
        raw = data_uri.parse_one(content)[1] if VaultPath.of(path).kind == "image" else content.encode()
        os.makedirs(os.path.dirname(full), exist_ok=True)
        fd, draft = tempfile.mkstemp(dir=os.path.dirname(full))
        with os.fdopen(fd, "wb") as f:
            f.write(raw)
        os.replace(draft, full)
        self.tracked[path] = self.token(path)
        return self.tracked[path]

    def create(self, path: str, content: str, fm: dict[str, Any] | None = None) -> str:
        return self.write(path, content if fm is None else f"{frontmatter.dump(frontmatter.patch(frontmatter.EMPTY, fm))}\n{content}")

    def validate(self, path: str, token: str) -> bool:
        """Whether token is the revision tracked; any is right for a path that is not tracked."""
        return self.tracked.get(path, token) == token

    def save(self, path: str, content: str, fm: dict[str, Any] | None = None) -> str:
        """Create or overwrite, expecting the tracked revision."""
        if fm is not None:
            content = f"{frontmatter.dump(frontmatter.patch(frontmatter.EMPTY, fm))}\n{content}"
        return self.write(path, content, self.tracked.get(path) if self.exists(path) else None)

    def _edit(self, path: str, change) -> str:
        if not self.exists(path):
            raise FileNotFoundError(path)
        token, old = self.token(path), self.read(path)
        new = change(old)
        if new == old:
            raise NoMatch(path)
        return self.write(path, new, token)

    def replace(self, path: str, old: str, new: str, mode: str = "first") -> str:
        if mode == "regex":
            pattern = re.compile(old)
            return self._edit(path, lambda s: pattern.sub(re.sub(r"\$(\d+)", r"\\g<\1>", new), s))
        return self._edit(path, lambda s: s.replace(old, new, 1 if mode == "first" else -1))

    def append(self, path: str, more: str) -> str:
        return self._edit(path, lambda s: f"{s}\n{more}")

    def delete(self, path: str, token: str | None = None) -> None:
        """Remove a file in revision `token`, or, without one, in the revision tracked; a file that is not tracked needs a token."""
        full = self._file(path, write=True)
        if not os.path.exists(full):
            raise FileNotFoundError(path)
        token = token if token is not None else self.tracked.get(path)
        if token is None:
            raise FileNotFoundError(f"{path} is not tracked")
        if token != self.token(path):
            raise Conflict(path)
        os.remove(full)
        self.tracked.pop(path, None)

    def copy(self, path: str, to: str) -> str:
        target = self._file(to, write=True)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        shutil.copyfile(self._file(path), target)
        self.tracked[to] = self.token(to)
        return self.tracked[to]

    def linking(self, stem: str) -> list[str]:
        """Notes with a wikilink to a stem. For a vault of many notes, take `graph.backlinks` of the stored index instead."""
        pattern, found = re.compile(link_pattern(stem)), []
        for folder, _, names in os.walk(self.root):
            for name in names:
                path = os.path.relpath(os.path.join(folder, name), self.root).replace(os.sep, "/")
                try:
                    if name.endswith(".md") and pattern.search(self.read(path)):
                        found.append(path)
                except (OSError, UnicodeDecodeError):
                    continue
        return sorted(found)

    def rename(self, path: str, to: str, token: str | None = None, backlinks: Iterable[str] | None = None, update_links: bool = True) -> int:
        """Move a note and rewrite the links to it; how many notes were rewritten.

        backlinks: the notes that may link to it; without them the vault is searched. update_links: False leaves all links.
        """
        source, target = self._file(path, write=True), self._file(to, write=True)
        if not os.path.exists(source):
            raise FileNotFoundError(path)
        if token is not None and token != self.token(path):
            raise Conflict(path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        os.replace(source, target)
        self.tracked.pop(path, None)
        self.tracked[to] = self.token(to)
        old, new = VaultPath.of(path).stem, VaultPath.of(to).stem
        if old == new or not update_links:
            return 0
        if backlinks is None:
            backlinks = self.linking(old)
        pattern, done = re.compile(link_pattern(old)), 0
        for p in backlinks:
            try:
                self._edit(p, lambda s: pattern.sub(lambda m: f"[[{new}{m.group(1)}", s))
                done += 1
            except (OSError, Conflict, NoMatch):
                continue
        return done

    def read_frontmatter(self, path: str) -> dict[str, Any] | None:
        block, _ = frontmatter.split(self.read(path))
        return None if block is None else frontmatter.parse(block)

    def write_frontmatter(self, path: str, fm: dict[str, Any]) -> str:
        return self._edit(path, lambda s: f"{frontmatter.dump(fm)}\n{frontmatter.split(s)[1]}")

    def patch_frontmatter(self, path: str, set_: dict[str, Any] | None = None, remove: list[str] | None = None) -> str:
        def change(s: str) -> str:
            block, rest = frontmatter.split(s)
            return f"{frontmatter.dump(frontmatter.patch(frontmatter.parse(block or ''), set_, remove))}\n{rest}"

        return self._edit(path, change)

    def delete_frontmatter(self, path: str) -> str:
        return self._edit(path, lambda s: frontmatter.split(s)[1])

"""Finding files by include and exclude patterns, and telling them apart by content or inode."""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from loglattice.options import CHECKSUM, CHECKSUM_SEPARATOR, DEVICE_AND_INODE, OptionError

BLOCK = 1 << 20


class FileSizeTooSmall(Exception):
    """The file is shorter than the prefix to fingerprint."""


class NotEnoughSeparators(Exception):
    """The file has fewer separators than the fingerprint needs."""


class FingerprintMismatch(Exception):
    """The file at a path is no longer the one that was tracked."""

    def __init__(self, path: str, want: str, got: str | None):
        super().__init__(f"{path}: fingerprint is {got}, expected {want}")
        self.path, self.want, self.got = path, want, got


def has_meta(text: str) -> bool:
    return any(c in text for c in "*?[")


def is_sub_path(path: str, parent: str) -> bool:
    """Whether ``path`` lies below ``parent``; a path is not below itself."""
    try:
        rel = os.path.relpath(path, parent)
    except ValueError:
        return False
    return rel != "." and not rel.startswith("..")


def glob_root(pattern: str) -> str:
    """The deepest folder before the first segment with a glob character; the pattern itself without any."""
    if not pattern:
        return ""
    parts = os.path.normpath(pattern).split(os.sep)
    fixed = next((i for i, p in enumerate(parts) if has_meta(p)), len(parts))
    if fixed == len(parts):
        return os.path.normpath(pattern)
    return os.sep.join(parts[:fixed]) or (os.sep if pattern.startswith(os.sep) and fixed else ".")


def scan_roots(include: list[str]) -> list[str]:
    """Distinct folders to walk; ["."] without patterns."""
    roots: dict[str, None] = {}
    for pattern in include:
        p = os.path.normpath(pattern) if pattern else "."
        root = glob_root(p) if has_meta(p) else p if os.path.isdir(p) else os.path.dirname(p) or "."
        roots[os.path.normpath(root)] = None
    return list(roots) or ["."]


def check_overlap(roots: list[str]) -> None:
    for a in roots:
        for b in roots:
            if is_sub_path(a, b):
                raise OptionError(f"overlapping watch paths: {a} is subpath of {b}")


def glob_matches(pattern: str, text: str) -> bool:
    """Shell match in which * and ? do not cross a slash."""
    if text.count("/") != pattern.count("/"):
        return False
    return all(re.match(fnmatch.translate(p.replace("[^", "[!")), t) for p, t in zip(pattern.split("/"), text.split("/")))


class Matcher:
    """Include, then exclude. Folders only count as includes if no include names a glob, a file or a missing path."""

    def __init__(self, include: list[str], exclude: list[str]):
        self.exclude = list(exclude)
        self.globs, self.names, self.folders = [], [], []
        for raw in include:
            p = os.path.normpath(raw)
            if has_meta(p):
                self.globs.append(p)
            elif os.path.isdir(p) or raw.endswith(os.sep):
                self.folders.append((p, os.path.isdir(p)))
            else:
                self.names.append(p)
        self.specific = bool(self.globs or self.names or any(not there for _, there in self.folders))
        self.everything = not include

    def included(self, path: str) -> bool:
        base, clean = os.path.basename(path), os.path.normpath(path)
        if self.everything or any(n in (clean, base) for n in self.names):
            return True
        if any(glob_matches(g, base) or glob_matches(g, path) for g in self.globs):
            return True
        return not self.specific and any(is_sub_path(path, f) for f, _ in self.folders)

    def excluded(self, path: str) -> bool:
        base = os.path.basename(path)
        return any(glob_matches(g, base) or glob_matches(g, path) for g in self.exclude)

    def __call__(self, path: str) -> bool:
        return self.included(path) and not self.excluded(path)


def checksum_of(path: str, size: int) -> str:
    """SHA-256 of the first ``size`` bytes, or of all for 0."""
    digest, left = hashlib.sha256(), size
    with open(path, "rb") as f:
        if size and os.fstat(f.fileno()).st_size < size:
            raise FileSizeTooSmall(path)
        while block := f.read(min(BLOCK, left) if size else BLOCK):
            digest.update(block)
            left -= len(block)
            if size and left <= 0:
                break
    return digest.hexdigest()


def separator_checksum_of(path: str, separator: bytes, n: int) -> str:
    """SHA-256 up to and with the n-th separator; separators do not overlap. Only as much as needed is read."""
    if not separator or n <= 0:
        raise ValueError("the separator and the number of separators must be given")
    digest, held, found = hashlib.sha256(), b"", 0
    with open(path, "rb") as f:
        while block := f.read(BLOCK):
            held += block
            at = 0
            while (hit := held.find(separator, at)) >= 0:
                at, found = hit + len(separator), found + 1
                if found == n:
                    digest.update(held[:at])
                    return digest.hexdigest()
            keep = max(at, len(held) - len(separator) + 1)
            digest.update(held[:keep])
            held = held[keep:]
    raise NotEnoughSeparators(path)


def inode_of(path: str) -> str:
    s = os.stat(path)
    return f"dev:{s.st_dev}-ino:{s.st_ino}"


def identity(path: str, strategy: str, size: int, separator: str) -> str | None:
    """The file's identity; None for empty files, files too short for the strategy, and files that are gone."""
    try:
        if os.path.getsize(path) == 0:
            return None
        if strategy == CHECKSUM:
            return checksum_of(path, size)
        if strategy == CHECKSUM_SEPARATOR:
            return separator_checksum_of(path, separator.encode(), size)
        if strategy == DEVICE_AND_INODE:
            return inode_of(path)
    except (FileSizeTooSmall, NotEnoughSeparators, OSError):
        return None
    raise OptionError(f"unsupported fingerprint strategy: {strategy}")


@dataclass(frozen=True)
class Found:
    file_id: str
    path: str
    size: int


def walk(root: str) -> Iterator[str]:
    """Files below a folder in lexical order of each folder's names; a file is itself. What cannot be read is skipped."""
    if not os.path.isdir(root):
        if os.path.exists(root):
            yield root
        return
    try:
        with os.scandir(root) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        path = os.path.join(root, e.name) if root != "." else e.name
        try:
            folder = e.is_dir()
        except OSError:
            continue
        if folder and not e.is_symlink():
            yield from walk(path)
        elif not folder:
            yield path


class Known:
    """What earlier listings found of each path, for as long as inode, size and times of its file stay the same."""

    def __init__(self):
        self.rows: dict[tuple, tuple] = {}

    def of(self, path: str, what: str, make: Callable[[], object]) -> object:
        """``make()``, or its last value if the file has not changed since."""
        try:
            s = os.stat(path)
        except OSError:
            return make()
        stamp = (s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns, s.st_ctime_ns)
        held = self.rows.get((path, what))
        if held and held[0] == stamp:
            return held[1]
        value = make()
        self.rows[path, what] = (stamp, value)
        return value

    def keep(self, paths: set[str]) -> None:
        """Forgets all other paths."""
        self.rows = {k: v for k, v in self.rows.items() if k[0] in paths}


def listing(include: list[str], exclude: list[str], strategy: str, size: int, separator: str = "\n", workers: int = 16, known: Known | None = None) -> list[Found]:
    """The files there are now, one for each identity: the first path found.

    Files are identified by ``workers`` threads, since this is waiting for storage; with ``known`` only those that
    changed since the last listing are read.
    """
    roots = scan_roots(include)
    check_overlap(roots)
    match, known = Matcher(include, exclude), known or Known()
    paths = [path for root in roots for path in walk(root) if match(path)]

    def look(path: str) -> Found | None:
        found = known.of(path, "identity", lambda: identity(path, strategy, size, separator))
        try:
            return Found(found, path, os.path.getsize(path)) if found else None
        except OSError:
            return None

    out: dict[str, Found] = {}
    with ThreadPoolExecutor(max(1, workers)) as pool:
        for f in pool.map(look, paths):
            if f and f.file_id not in out:
                out[f.file_id] = f
    known.keep(set(paths))
    return list(out.values())


@dataclass
class TrackedFile:
    file_id: str
    path: str
    strategy: str
    fingerprint_size: int = 0
    offset: int = 0


class FileTracker:
    """A registry of files by identity, safe to use from several threads."""

    def __init__(self):
        self._lock, self._files = threading.Lock(), {}

    def add(self, file: TrackedFile) -> None:
        """Registers a file, in place of one with the same identity."""
        with self._lock:
            self._files[file.file_id] = replace(file)

    def get(self, file_id: str) -> TrackedFile | None:
        """A copy of what is registered."""
        with self._lock:
            return replace(self._files[file_id]) if file_id in self._files else None

    def path(self, file_id: str) -> str:
        """The path of a file; empty if it is not registered."""
        found = self.get(file_id)
        return found.path if found else ""

    def remove(self, file_id: str) -> None:
        with self._lock:
            self._files.pop(file_id, None)

    def update_offset(self, file_id: str, offset: int) -> bool:
        """False if the file is not registered."""
        with self._lock:
            if file_id not in self._files:
                return False
            self._files[file_id].offset = offset
            return True

    def all(self) -> dict[str, TrackedFile]:
        with self._lock:
            return {k: replace(v) for k, v in self._files.items()}

"""Path selection: glob rules, depth and size limits, skip reasons.

Rules match relative paths by component: ``*`` and ``?`` within one, ``**`` as a whole component
for any number, a trailing ``/`` (exclude only) for a directory and all below it; backslash
escapes ``* ? \\ [ ] { } !`` and ``\\xHH`` a byte. Paths are matched as bytes, seen as ISO-8859-1.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES, MAX_RULE_BYTES, MAX_TOTAL_BYTES, MAX_COMPONENTS = 128, 4096, 64 << 10, 256


def _component(source: str) -> str:
    out, i, star = [], 0, False
    while i < len(source):
        c = source[i]
        i += 1
        if c == "*":
            if star:
                raise ValueError("invalid selection pattern")
            out.append("[^/]*")
            star = True
            continue
        star = False
        if c == "?":
            out.append("[^/]")
        elif c == "\\":
            kind = source[i : i + 1]
            if kind and kind in "*?\\[]{}!":
                out.append(re.escape(kind))
                i += 1
            elif kind == "x" and re.fullmatch("[0-9a-fA-F]{2}", source[i + 1 : i + 3]) and int(source[i + 1 : i + 3], 16) not in (0, 0x2F):
                out.append(rf"\x{source[i + 1 : i + 3]}")
                i += 3
            else:
                raise ValueError("invalid selection pattern")
        elif c in "[]{}!" or ord(c) < 32 or ord(c) == 127:
            raise ValueError("invalid selection pattern")
        else:
            out.append("".join(re.escape(b) for b in c.encode().decode("latin-1")))
    if "".join(out) in (re.escape("."), re.escape("..")):
        raise ValueError("invalid selection pattern")
    return "".join(out)


def compile_rule(source: str, exclude: bool = False) -> str:
    """A whole-path regular expression over the ISO-8859-1 view of the path's bytes."""
    directory = source.endswith("/")
    if directory and not exclude:
        raise ValueError("directory patterns only exclude")
    body = source.removesuffix("/")
    if not body or body[1:2] == ":" or len(source.encode()) > MAX_RULE_BYTES:
        raise ValueError("invalid selection pattern")
    parts = body.split("/")
    if len(parts) > MAX_COMPONENTS or "" in parts:
        raise ValueError("invalid selection pattern")
    # each component eats its leading slash, so ``**`` may stand for none
    pieces = ["(?:/[^/]+)*" if p == "**" else "/" + _component(p) for p in parts]
    return "".join(pieces) + ("(?:/.*)?" if directory else "")


@dataclass(frozen=True)
class Policy:
    includes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    max_depth: int | None = None
    max_file_bytes: int | None = None

    def checked(self) -> Policy:
        rules = [*self.includes, *self.excludes]
        if len(rules) > MAX_RULES or sum(len(r.encode()) for r in rules) > MAX_TOTAL_BYTES:
            raise ValueError("too many selection rules")
        for r in self.includes:
            compile_rule(r)
        for r in self.excludes:
            compile_rule(r, True)
        return self

    def matches(self, path: str) -> bool:
        """Whether a file of this path is taken, sizes aside."""
        at = "/" + path.encode("utf-8", "surrogateescape").decode("latin-1")
        hit = lambda rules, ex: any(re.fullmatch(compile_rule(r, ex), at, re.S) for r in rules)
        return not hit(self.excludes, True) and (self.max_depth is None or path.count("/") <= self.max_depth) and (not self.includes or hit(self.includes, False))


def pruned(policy: Policy, path: str) -> bool:
    """Whether a folder is not entered: it is excluded, or so deep that nothing below it can be taken."""
    at = "/" + path.encode("utf-8", "surrogateescape").decode("latin-1")
    deep = policy.max_depth is not None and path.count("/") + 1 > policy.max_depth
    return deep or any(re.fullmatch(compile_rule(r, True), at, re.S) for r in policy.excludes)


def decision(policy: Policy, path: Column, size: Column) -> Column:
    """The skip reason of a file, null if it is taken: exclude, then depth, include, size."""
    policy.checked()
    at = F.concat(F.lit("/"), F.decode(path.cast("binary"), "ISO-8859-1"))
    hit = lambda rules, ex: _any(at.rlike(f"(?s)\\A(?:{compile_rule(r, ex)})\\z") for r in rules)
    out = F.when(hit(policy.excludes, True), "selection_excluded")
    if policy.max_depth is not None:
        out = out.when(F.size(F.split(path, "/")) - 1 > policy.max_depth, "selection_depth")
    if policy.includes:
        out = out.when(~hit(policy.includes, False), "selection_not_included")
    if policy.max_file_bytes is not None:
        out = out.when(size > policy.max_file_bytes, "selection_size")
    return out


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def skip_reasons(entries: DataFrame, policy: Policy, recursive: bool = True) -> DataFrame:
    """entries: path, size, kind (file, directory, link, special), in_output. Adds ``reason``, null for files that are taken."""
    path, kind = F.col("path"), F.col("kind")
    selecting = bool(policy.includes or policy.excludes or policy.max_depth is not None or policy.max_file_bytes is not None)
    below = path.contains("/")
    reason = F.when(kind == "link", "link").when(F.col("in_output"), "output_tree")
    if not recursive and not selecting:
        reason = reason.when((kind == "directory") | below, "subdirectory")
    reason = reason.when(kind == "special", "special_file")
    excluded = decision(Policy(excludes=policy.excludes), path, F.col("size"))
    deep = F.lit(False) if policy.max_depth is None else F.size(F.split(path, "/")) > policy.max_depth
    reason = reason.when(kind == "directory", F.coalesce(excluded, F.when(deep, "selection_depth"), F.when(F.lit(not recursive), "subdirectory")))
    return entries.withColumn("reason", reason.otherwise(decision(policy, path, F.col("size"))))

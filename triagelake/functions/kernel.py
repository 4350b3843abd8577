"""Byte-level kernels: string extraction, matching with fair retention, Base64 layers, findings.

Pure functions of one input; the operators run them in Arrow batches on the executors.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from . import validation
from .patterns import Pattern

MAX_DETAILS, MAX_DETAIL_BYTES, MAX_TOKENS, MAX_DEPTH = 1000, 1 << 20, 128, 8
_TEXT_RUN = re.compile("[^\x00-\x1f\x7f-\x9f\ud800-\udfff]+")
_EMBEDDED = ((re.compile(rb"(?:[\x20-\x7e]\x00)+"), "UTF-16LE"), (re.compile(rb"(?:\x00[\x20-\x7e])+"), "UTF-16BE"))
_TOKEN = re.compile(r"[A-Za-z0-9+/]+={0,2}")
_SHAPE = re.compile(r"[A-Za-z0-9+/]+={0,2}")


@dataclass(frozen=True)
class Config:
    """Analysis options; ``validated`` checks them as the command line would."""

    strings: bool = True
    matches_only: bool = False
    no_decode: bool = False
    max_string_bytes: int = 1 << 20
    max_decode_bytes: int = 256 << 10
    encoding: str = "auto"
    scan_utf16: bool = False
    offset: int = 0
    length: int | None = None
    min_length: int = 4
    categories: tuple[str, ...] = ()
    decode_depth: int = 1
    entropy: bool = False
    entropy_window: int = 4096
    entropy_threshold: float = 7.0
    max_details: int = MAX_DETAILS
    max_detail_bytes: int = MAX_DETAIL_BYTES

    def validated(self) -> Config:
        rules = (
            (self.max_string_bytes >= 4, "max_string_bytes is at least 4"),
            (self.max_decode_bytes >= 0, "max_decode_bytes is not negative"),
            (self.min_length >= 1, "min_length is at least 1"),
            (0 <= self.decode_depth <= MAX_DEPTH, "decode_depth is 0 to 8"),
            (self.encoding in ("auto", "utf8", "utf16le", "utf16be"), "unknown encoding"),
            (self.offset >= 0 and (self.length is None or self.length >= 0), "offset and length are not negative"),
            (self.offset + (self.length or 0) < 1 << 64, "offset plus length overflows"),
            (self.entropy_window >= 1, "entropy_window is at least 1"),
            (0.0 <= self.entropy_threshold <= 8.0, "entropy_threshold is 0 to 8"),
        )
        for ok, message in rules:
            if not ok:
                raise ValueError(message)
        return self

    @property
    def decodes(self) -> bool:
        return not self.no_decode and self.max_decode_bytes > 0 and self.decode_depth > 0

    def as_dict(self) -> dict:
        """The options of the command line; the caps of details are none of them."""
        return {k: v for k, v in asdict(self).items() if k not in ("max_details", "max_detail_bytes")} | {"categories": list(self.categories)}


@dataclass
class Run:
    offset: int
    encoding: str
    extraction: str
    length: int
    value: str
    truncated: bool
    end: int = field(default=0, compare=False)


def selected(data: bytes, offset: int, length: int | None) -> bytes:
    if offset > len(data):
        raise ValueError("offset is beyond the end of the input")
    return data[offset : len(data) if length is None else offset + length]


def _kept(text: str, limit: int) -> tuple[str, bool]:
    data = text.encode("utf-8")
    if len(data) <= limit:
        return text, False
    return data[:limit].decode("utf-8", "ignore"), True


def text_runs(data: bytes, encoding: str, limit: int) -> Iterator[Run]:
    """Maximal runs of valid characters that are no controls, with byte offsets."""
    bom = {b"\xff\xfe": "utf16le", b"\xfe\xff": "utf16be"}.get(data[:2])
    if encoding == "auto":
        encoding = bom or "utf8"
    elif encoding != "utf8" and bom and bom != encoding:
        raise ValueError("byte order mark conflicts with the encoding")
    if encoding == "utf8":
        text, at, unit, label = data.decode("utf-8", "surrogateescape"), 0, None, "UTF-8"
    else:
        at = 2 if bom == encoding else 0
        body = data[at : at + (len(data) - at) // 2 * 2]
        label = "UTF-16LE" if encoding == "utf16le" else "UTF-16BE"
        text, unit = body.decode(label.lower(), "surrogatepass"), 2
    done = 0
    size = (lambda s: len(s.encode("utf-8", "surrogateescape"))) if unit is None else (lambda s: 2 * (len(s) + sum(c > "\uffff" for c in s)))
    for m in _TEXT_RUN.finditer(text):
        at += size(text[done : m.start()])
        run, done = m.group(), m.end()
        value, cut = _kept(run, limit)
        name = "ASCII" if unit is None and run.isascii() else label
        end = at + size(run)
        yield Run(at, name, "text", len(run), value, cut, end)
        at = end


def embedded_runs(data: bytes, limit: int) -> list[Run]:
    """Printable ASCII stored as UTF-16 anywhere, in the order in which the runs end."""
    found = []
    for order, (regex, label) in enumerate(_EMBEDDED):
        for m in regex.finditer(data):
            text = m.group().decode(label.lower())
            value, cut = _kept(text, limit)
            found.append((m.end(), order * 2 + m.start() % 2, Run(m.start(), label, "embedded_utf16_candidate", len(text), value, cut, m.end())))
    return [r for _, _, r in sorted(found, key=lambda x: x[:2])]


def _units(text: str, encoding: str) -> int:
    return len(text.encode("utf-16-le")) if encoding.startswith("UTF-16") else len(text.encode())


def find_matches(value: str, offset: int, encoding: str, rules: list[Pattern], max_details: int = MAX_DETAILS, max_bytes: int = MAX_DETAIL_BYTES) -> dict:
    """Matches of a text with fair retention: the r-th match of every rule before any (r+1)-th."""
    names, details, omitted, actionable, used = set(), [], {}, False, 0
    # each rule's place is carried on from its match before, so that a long text is measured once
    turn = deque((rule, rule.regex.finditer(value), 0, offset) for rule in rules if rule.possible(value))
    while turn:
        rule, found, done, start = turn.popleft()
        for m in found:
            end = validation.match_end(rule.name, rule.builtin, value, m.start(), m.end())
            judged = validation.validate(rule.name, rule.builtin, value, m.start(), end)
            if judged is None:
                continue
            names.add(rule.name)
            actionable |= judged[0] != validation.INVALID
            text = value[m.start() : end]
            size = len(text.encode())
            if len(details) >= max_details or size > max_bytes - used:
                omitted[rule.name] = omitted.get(rule.name, 0) + 1
            else:
                used += size
                start += _units(value[done : m.start()], encoding)
                done = m.start()
                proof = validation.evidence(rule.name, rule.builtin, value, m.start(), end)
                row = {"pattern": rule.name, "text": text, "offset": start, "end_offset": start + _units(text, encoding), "validation": {"status": judged[0], "reason": judged[1]}, "evidence": proof}
                details.append((rule.index, row["offset"], row))
            turn.append((rule, found, done, start))
            break
    details.sort(key=lambda d: d[:2])
    order = {r.name: r.index for r in rules}
    return {
        "matches": sorted(names, key=order.__getitem__),
        "has_actionable_match": actionable,
        "match_details": [d[2] for d in details],
        "match_details_truncated": bool(omitted),
        "match_details_omitted": omitted,
    }


def base64_shaped(text: str) -> bool:
    return len(text) % 4 == 0 and _SHAPE.fullmatch(text) is not None


def decoded_size(text: str) -> int:
    return max(0, len(text) // 4 * 3 - (len(text) - len(text.rstrip("="))))


def decode_text(text: str) -> str | None:
    """Strict standard Base64 of non-empty UTF-8: canonical, padded."""
    try:
        data = base64.b64decode(text, validate=True)
        return data.decode() or None if base64.b64encode(data).decode() == text else None
    except (binascii.Error, ValueError):
        return None


def decode_layers(run: Run, rules: list[Pattern], cfg: Config) -> tuple[str, str | None, list[dict]]:
    """(status, first decoded text, layers) of a run, under the shared byte budget."""
    if not cfg.decodes:
        return "disabled", None, []
    if run.truncated:
        return "truncated", None, []
    value, status, first, layers = run.value, "not_utf8_base64", None, []
    tokens = [(0, len(value))] if base64_shaped(value) else [m.span() for m in _TOKEN.finditer(value) if len(m.group()) >= 8 and base64_shaped(m.group())]
    if len(tokens) > MAX_TOKENS:
        status = "limit"
    room = cfg.max_decode_bytes
    for start, end in tokens[:MAX_TOKENS]:
        token = value[start:end]
        if decoded_size(token) > room:
            status = "limit"
            continue
        text = decode_text(token)
        if text is None:
            continue
        room -= len(text.encode())
        first = text if first is None else first
        status = "decoded" if status != "limit" else status
        source = run.offset + _units(value[:start], run.encoding)
        depth = 1
        while text is not None:
            following = None
            if not base64_shaped(text):
                state = "not_utf8_base64"
            elif depth == cfg.decode_depth:
                state = "depth_limit"
            elif decoded_size(text) > room:
                state = "byte_limit"
            else:
                following = decode_text(text)
                state = "decoded" if following is not None else "not_utf8_base64"
            layer = {"depth": depth, "encoding": "base64", "source_offset": source, "source_end_offset": source + _units(token, run.encoding), "offset_space": "decoded_layer_utf8", "text": text}
            layers.append(layer | find_matches(text, 0, "UTF-8", rules, cfg.max_details, cfg.max_detail_bytes) | {"next_decode": state})
            room -= len(following.encode()) if following else 0
            text, depth = following, depth + 1
    return status, first, layers


def limited(finding: dict) -> bool:
    layers = finding["decoded_layers"]
    return finding["truncated"] or finding["decode_status"] == "limit" or finding["match_details_truncated"] or any(x["match_details_truncated"] or x["next_decode"] in ("byte_limit", "depth_limit") for x in layers)


def findings(data: bytes, rules: list[Pattern], cfg: Config) -> Iterator[dict]:
    """The findings of the selected bytes; offsets are those of the whole input."""
    body = selected(data, cfg.offset, cfg.length)
    runs = list(text_runs(body, cfg.encoding, cfg.max_string_bytes))
    if cfg.scan_utf16:
        runs += embedded_runs(body, cfg.max_string_bytes)
    for run in runs:
        if run.length < cfg.min_length:
            continue
        run.offset += cfg.offset
        found = find_matches(run.value, run.offset, run.encoding, [] if run.truncated else rules, cfg.max_details, cfg.max_detail_bytes)
        status, first, layers = decode_layers(run, rules, cfg)
        out = {"offset": run.offset, "encoding": run.encoding, "extraction": run.extraction, "length": run.length, "value": run.value} | found
        out |= {"decoded": first, "decoded_layers": layers, "truncated": run.truncated, "decode_status": status}
        if cfg.matches_only and not found["matches"] and not any(x["matches"] for x in layers) and not limited(out):
            continue
        yield out

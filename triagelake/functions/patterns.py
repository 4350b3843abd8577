"""The indicator rules: the bundled catalogue and user tables of name -> expression."""

from __future__ import annotations

import hashlib
import re
import struct
import tomllib
from dataclasses import dataclass
from functools import lru_cache

# The bundled rules, name and expression. Validation depends on both, exactly.
BUNDLED = {
    "URL": r"""(?i)https?://[^\s<>"'`]+""",
    "Email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "ip_address": r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\b",
    "credit_card": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "api_key": r"\b[A-Za-z0-9]{32,64}\b",
    "pem_key": r"-----BEGIN .*? KEY-----",
    "file_path": r"(?:[a-zA-Z]:[\\/]|/)(?:[\w .-]+[\\/])*[\w .-]+\.[a-zA-Z0-9]{1,16}\b",
    "guid": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    "mac": r"([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})",
    "reg_path": r"(HKEY_LOCAL_MACHINE|HKEY_CURRENT_USER|HKEY_CLASSES_ROOT|HKEY_USERS|HKEY_CURRENT_CONFIG)\\[\w\\]+",
    "sid": r"S-1-\d+-(\d+-){1,14}\d+",
    "unc": r"\\\\[A-Za-z0-9_.-]+\\[A-Za-z0-9$.~-]+",
    "aeon": r"4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}",
    "bitcoin": r"^(bc1|[13])[a-zA-HJ-NP-Za-km-z]{25,39}$",
    "bitlocker": r"[0-9]{8}-[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}",
    "bytecoin": r"2[1-9A-HJ-NP-Za-km-z]{94}",
    "cardano": r"^addr1[a-zA-HJ-NP-Za-km-z0-9]{58,}",
    "dashcoin": r"^D[1-9A-HJ-NP-Za-km-z]{33}$",
    "dashcoin2": r"^(7|X)[1-9A-HJ-NP-Za-km-z]{33}$",
    "dogecoin": r"^D{1}[5-9A-HJ-NP-U]{1}[1-9A-HJ-NP-Za-km-z]{32,34}$",
    "ethereum": r"^0x[a-fA-F0-9]{40}$",
    "fantomcoin": r"6[0-9AB][1-9A-HJ-NP-Za-km-z]{93}",
    "litecoin": r"^[LM3][a-km-zA-HJ-NP-Z1-9]{26,33}$",
    "monero": r"4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}",
    "polkadot": r"^1[a-km-zA-HJ-NP-Z1-9]{47}$",
    "ripple": r"^r[0-9a-zA-Z]{24,34}$",
    "solana": r"^[1-9A-HJ-NP-Za-km-z]{44}$",
    "sumokoin": r"Sumo[0-9A-HJ-NP-Za-km-z]{94}",
    "zcash": r"t1[a-zA-Z0-9]{33}",
}
# What every match of a bundled rule holds, and the shortest and (for rules of whole texts) longest text that can match:
# derived from the expressions above, to spare searches that cannot succeed.
HOLDS = {"URL": "://", "Email": "@", "ip_address": ".", "ssn": "-", "pem_key": "-----BEGIN ", "guid": "-", "reg_path": "HKEY_", "sid": "S-1-", "unc": "\\\\", "bitlocker": "-", "cardano": "addr1", "ethereum": "0x", "sumokoin": "Sumo", "zcash": "t1"}
SHORTEST = {"api_key": 32, "credit_card": 13, "guid": 36, "mac": 17, "aeon": 95, "bitlocker": 43, "bytecoin": 95, "fantomcoin": 95, "monero": 95, "sumokoin": 98, "zcash": 35}
LONGEST = {"bitcoin": 42, "dashcoin": 34, "dashcoin2": 34, "dogecoin": 36, "ethereum": 42, "litecoin": 34, "polkadot": 48, "ripple": 35, "solana": 44}
# Combining marks count as word characters in the rules but not in this language's \w.
_MARKS = "\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"


@dataclass(frozen=True)
class Pattern:
    index: int
    name: str
    expression: str
    builtin: bool

    def possible(self, text: str) -> bool:
        """False only if no match of the rule can stand in the text."""
        if not self.builtin:
            return True
        return SHORTEST.get(self.name, 0) <= len(text) <= LONGEST.get(self.name, len(text)) and HOLDS.get(self.name, "") in text

    @property
    def regex(self) -> re.Pattern:
        return compiled(self.expression)


def translated(expression: str) -> str:
    """The expression for this language: ``$`` only at the very end, marks in ``[\\w``."""
    out, i, inside = [], 0, False
    while i < len(expression):
        c = expression[i]
        if c == "\\" and i + 1 < len(expression):
            pair = expression[i : i + 2]
            out.append({"\\z": r"\Z", "\\w": rf"\w{_MARKS}" if inside else rf"[\w{_MARKS}]"}.get(pair, pair))
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside and expression[i - 1] not in "[^":
            inside = False
        out.append(r"\Z" if c == "$" and not inside else c)
        i += 1
    return "".join(out)


@lru_cache(maxsize=1024)
def compiled(expression: str) -> re.Pattern:
    try:
        return re.compile(translated(expression))
    except re.error as e:
        raise ValueError(f"invalid pattern: {e}") from e


def load(source: str | None = None, categories: list[str] | None = None) -> list[Pattern]:
    """Rules in byte order of their names; ``source`` is TOML text in place of the bundled table."""
    table = BUNDLED if source is None else tomllib.loads(source)
    names = sorted(table, key=lambda n: n.encode())
    rules = []
    for i, name in enumerate(names):
        if not isinstance(table[name], str):
            raise ValueError(f"pattern {name} is not a string")
        try:
            compiled(table[name])
        except ValueError as e:
            raise ValueError(f"invalid pattern {name}: {e}") from e
        rules.append(Pattern(i, name, table[name], BUNDLED.get(name) == table[name]))
    if categories:
        unknown = sorted(set(categories) - set(names))
        if unknown:
            raise ValueError(f"unknown category {unknown[0]}")
        rules = [r for r in rules if r.name in categories]
    return rules


def fingerprint(rules: list[Pattern], domain: bytes) -> str:
    """SHA-256 of a domain tag and the length-framed names and expressions, in order."""
    h = hashlib.sha256(domain)
    for r in rules:
        for value in (r.name.encode(), r.expression.encode()):
            h.update(struct.pack("<Q", len(value)) + value)
    return h.hexdigest()

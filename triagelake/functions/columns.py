"""Column functions: JVM-side expressions for the scalar kernels of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROLS = r"[\x00-\x1f\x7f-\x9f]"
#: Signatures of common types: (leading bytes in hex, type). Others are "Unknown".
MAGIC = (
    ("7F454C46", "application/x-executable"), ("4D5A", "application/vnd.microsoft.portable-executable"), ("25504446", "application/pdf"),
    ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"),
    ("377ABCAF271C", "application/x-7z-compressed"), ("425A68", "application/x-bzip2"), ("FD377A585A00", "application/x-xz"), ("52494646", "audio/x-wav"),
    ("3C21444F43545950452068746D6C", "text/html"), ("3C21646F63747970652068746D6C", "text/html"), ("3C68746D6C", "text/html"), ("3C3F786D6C", "text/xml"),
)


def mime_type(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 16))
    out = F
    for sign, kind in MAGIC:
        out = out.when(head.startswith(sign), kind)
    return out.otherwise("Unknown")


def mime_of(data: bytes) -> str:
    """The same for bytes at hand."""
    return next((kind for sign, kind in MAGIC if data.startswith(bytes.fromhex(sign))), "Unknown")


def human_size(n: Column) -> Column:
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB", "EiB"), 1):
        value = F.format_string(f"%.2f {unit}", F.bround(n / F.lit(float(1024**i)), 2))
        out = out.otherwise(value) if i == 6 else out.when(n < 1024 ** (i + 1), value)
    return out


def runs(text: Column) -> Column:
    """The runs between control characters of a text, empty ones too."""
    return F.split(text, CONTROLS, -1)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn checksum."""
    n = F.char_length(digits)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: _luhn_term(F.substring(digits, i, F.lit(1)).cast("int"), (n - i) % 2))
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10 == 0


def _luhn_term(digit: Column, odd: Column) -> Column:
    return F.when(odd == 0, digit).when(digit > 4, digit * 2 - 9).otherwise(digit * 2)


def printable(content: Column) -> Column:
    """Bytes as text with everything but printable ASCII shown as a dot."""
    return F.regexp_replace(F.decode(content, "ISO-8859-1"), r"[^\x20-\x7e]", ".")


def hex_row(chunk: Column, offset: Column) -> Column:
    """A hex dump line of up to 16 bytes."""
    pairs = F.rpad(F.lower(F.hex(chunk)), 32, " ")
    left = F.regexp_replace(F.substring(pairs, 1, 16), "(..)", "$1 ")
    right = F.regexp_replace(F.substring(pairs, 17, 16), "(..)", "$1 ")
    at = F.lower(F.hex(offset))
    at = F.when(F.char_length(at) < 8, F.lpad(at, 8, "0")).otherwise(at)
    return F.concat(at, F.lit(": "), left, F.lit(" "), right, F.lit("|"), printable(chunk), F.lit("|"))


def csv_field(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(value, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def report_id(domain: str, tag: Column, raw_path: Column) -> Column:
    """SHA-256 of a domain tag, the path's encoding tag, NUL and the path's native bytes."""
    return F.sha2(F.concat(F.lit(domain.encode()), tag.cast("binary"), F.lit(b"\0"), raw_path), 256)


def report_location(report: Column) -> Column:
    return F.concat(F.lit("results/"), F.substring(report, 1, 2), F.lit("/"), report, F.lit(".json"))


def valid_relative_path(path: Column) -> Column:
    """Not empty, no NUL, no empty, ``.`` or ``..`` component."""
    return (F.char_length(path) > 0) & ~path.contains("\0") & ~path.rlike(r"(^|/)(\.{0,2})(/|\z)")


def escape_controls(text: Column) -> Column:
    """Tab, newline and return by name, other controls by code point."""
    named = F.replace(F.replace(F.replace(text, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    parts = F.transform(F.split(named, "", -1), lambda c: F.when(c.rlike(CONTROLS), F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))).otherwise(c))
    return F.when(named.rlike(CONTROLS), F.array_join(parts, "")).otherwise(named)

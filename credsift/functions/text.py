"""Scalar functions as Spark expressions: redaction, fingerprints, ranks, languages and names."""

from __future__ import annotations

import base64
import hashlib
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lists import CALLS, LANGUAGES, SEEDS, SEVERITIES


def redacted(value: Column) -> Column:
    """First and last four characters of values of twelve or more; shorter ones as they are."""
    return F.when(F.char_length(value) < 12, value).otherwise(F.concat(F.left(value, F.lit(4)), F.lit("..."), F.right(value, F.lit(4))))


def fingerprint(value: Column, salt: bytes) -> Column:
    """HMAC-SHA256 of the value under ``salt``, URL-safe base64 without padding."""
    key = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256))
    return F.regexp_replace(F.translate(F.base64(digest), "+/", "-_"), "=+$", "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it occurs in there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA256 (binary) of a message under a key, both binary columns."""

    def padded(digits: Column, byte: int) -> Column:
        word = int.from_bytes(bytes([byte] * 8), "big")
        eight = (F.lpad(F.hex(F.conv(F.substring(digits, 16 * i + 1, 16), 16, -10).cast("long").bitwiseXOR(F.lit(word))), 16, "0") for i in range(8))
        return F.unhex(F.concat(*eight))

    def digest(digits: Column) -> Column:
        return F.unhex(F.sha2(F.concat(padded(digits, 0x5C), F.unhex(F.sha2(F.concat(padded(digits, 0x36), message), 256))), 256))

    return bound(bound(key, lambda k: F.rpad(F.hex(F.when(F.octet_length(k) > 64, F.unhex(F.sha2(k, 256))).otherwise(k)), 128, "0")), digest)


def load_salt(path: str | None, create: bool = False) -> bytes:
    """The salt in a file (base64, 16 bytes at least); made where ``create``; without a file a fresh one for this run."""
    if path and os.path.exists(path):
        with open(path) as f:
            salt = base64.b64decode("".join(f.read().split()))
        if len(salt) < 16:
            raise ValueError(f"{path}: a salt has 16 bytes at least")
        return salt
    salt = os.urandom(32)
    if path and create:
        with open(path, "w") as f:
            f.write(base64.b64encode(salt).decode() + "\n")
    return salt


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1, F.lit(0)).cast("int")


def parse_verdict(text: Column) -> Column:
    clean = F.lower(F.trim(text))
    return F.when(clean.isin("real", "fixture"), clean).otherwise("unknown")


def language(path: Column) -> Column:
    """The language of a path, null where it is none of the known."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    extension = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    out = F.when(name.startswith(".env"), "env")
    for lang, extensions in LANGUAGES.items():
        out = out.when(extension.isin(extensions.split()), lang)
    return out


def env_call(lang: Column, name: Column) -> Column:
    out = F.lit(None).cast("string")
    for x, call in CALLS.items():
        before, after = call.split("N", 1) if not call.startswith("System.getenv") and not call.startswith("os.Getenv") else (call[: call.index('"N"') + 1], call[call.index('"N"') + 2 :])
        if x == "rust":
            out = F.when(lang == x, F.concat(F.lit('std::env::var("'), name, F.lit('").expect("missing '), name, F.lit('")'))).otherwise(out)
            continue
        if x == "ruby":
            before, after = "ENV.fetch('", "')"
        out = F.when(lang == x, F.concat(F.lit(before), name, F.lit(after))).otherwise(out)
    return out


def env_name(line: Column, pattern: Column) -> Column:
    """The variable that a line assigns, in upper snake case: a shouted name, else a snake one, else a camel one, else the pattern's id."""
    take = lambda regex: F.nullif(F.regexp_extract(line, regex, 1), F.lit(""))
    camel = F.regexp_replace(take(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*:"), r"(?<!^)([A-Z])", "_$1")
    found = F.coalesce(take(r"\b([A-Z][A-Z0-9_]+)\s*[:=]"), take(r"\b([a-z_][a-z0-9_]*)\s*[:=]"), camel, pattern)
    return F.regexp_replace(F.regexp_replace(F.upper(found), r"[^A-Z0-9_]", "_"), "^_+|_+$", "")


def replace_first(line: Column, secret: Column, call: Column) -> Column:
    """The first quoted secret replaced with its quotes, else the first bare one."""

    def put(target: Column) -> Column:
        at = F.instr(line, target)
        return F.when(at > 0, F.concat(F.substring(line, F.lit(1), at - 1), call, F.substring(line, at + F.char_length(target), F.char_length(line))))

    return F.coalesce(*(put(F.concat(F.lit(q), secret, F.lit(q))) for q in ("'", '"')), put(secret), line)


def seed_commands(name: Column, backend: str) -> Column:
    place = F.concat(F.lit("<paste-"), F.lower(name), F.lit("-value-here>"))
    dashed = F.replace(F.lower(name), F.lit("_"), F.lit("-"))
    parts, text = [], SEEDS[backend]
    held = ""
    words = {"N": name, "D": dashed, "P": place}
    for i, c in enumerate(text):
        alone = (i == 0 or not text[i - 1].isalpha()) and (i + 1 == len(text) or not text[i + 1].isalpha())
        if c in words and alone:
            parts += [F.lit(held), words[c]]
            held = ""
        else:
            held += c
    return F.concat(*parts, F.lit(held))

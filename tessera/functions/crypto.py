"""Digests, keyed digests, encodings, identifiers and unaccenting."""

from __future__ import annotations

import base64
import hashlib
import hmac as _hmac
import os
import re
import struct
import unicodedata
import uuid
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def digest(data: Column, kind: str) -> Column:
    """The digest as bytes."""
    if kind == "md5":
        return F.unhex(F.md5(data))
    if kind == "sha1":
        return F.unhex(F.sha1(data))
    return F.unhex(F.sha2(data, int(kind.removeprefix("sha"))))


def hmac(key: bytes, kind: str):
    """A keyed digest, as a function of a column of texts or bytes."""

    @F.pandas_udf("binary")
    def keyed(data: pd.Series) -> pd.Series:
        as_bytes = lambda x: x.encode() if isinstance(x, str) else bytes(x)
        return data.map(lambda x: None if x is None else _hmac.new(key, as_bytes(x), kind).digest())

    return keyed


def encode(data: Column, form: str) -> Column:
    """Bytes as text: hex or base64."""
    return F.lower(F.hex(data)) if form == "hex" else F.base64(data)


def decode(text: Column, form: str) -> Column:
    return F.unhex(text) if form == "hex" else F.unbase64(text)


def escape_bytes(data: bytes) -> str:
    """The escape form: zero and high bytes as octal, backslashes doubled."""
    return "".join("\\\\" if b == 92 else f"\\{b:03o}" if b == 0 or b > 127 else chr(b) for b in data)


@F.pandas_udf(T.BinaryType())
def random_bytes(n: pd.Series) -> pd.Series:
    return n.map(lambda k: None if pd.isna(k) else os.urandom(int(k)))


#: Nil, and the name spaces of the standard.
UUID_NIL = "00000000-0000-0000-0000-000000000000"
NAMESPACES = {"dns": str(uuid.NAMESPACE_DNS), "url": str(uuid.NAMESPACE_URL), "oid": str(uuid.NAMESPACE_OID), "x500": str(uuid.NAMESPACE_X500)}


def uuid_v5(namespace: str, name: Column) -> Column:
    """A name's identifier by SHA-1, without leaving the JVM."""
    return _named(F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))), 1, 32), 5)


def uuid_v3(namespace: str, name: Column) -> Column:
    """A name's identifier by MD5."""
    return _named(F.md5(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))), 3)


def _named(h: Column, version: int) -> Column:
    at = lambda i, n: F.substring(h, i, n)
    variant = F.lower(F.hex((F.conv(at(17, 2), 16, 10).cast("int").bitwiseAND(0x3F)).bitwiseOR(0x80)))
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit(f"-{version}"), at(14, 3), F.lit("-"), variant, at(19, 2), F.lit("-"), at(21, 12))


@F.pandas_udf(T.StringType())
def uuid_v1(seed: pd.Series) -> pd.Series:
    return seed.map(lambda _: str(uuid.uuid1()))


# Letters that do not decompose.
_SPECIAL = {"æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D", "ı": "i"}


def plain(text: str) -> str:
    """A text without marks."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return unicodedata.normalize("NFC", "".join(_SPECIAL.get(c, c) for c in bare))


@F.pandas_udf(T.StringType())
def unaccent(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else plain(t))


def password_hash(password: str, salt: bytes | None = None, rounds: int = 200_000) -> str:
    """A salted password hash (PBKDF2; bcrypt isn't offered)."""
    salt = salt or os.urandom(16)
    return f"pbkdf2${rounds}${base64.b64encode(salt).decode()}${hashlib.pbkdf2_hmac('sha256', password.encode(), salt, rounds).hex()}"


# Passwords: bcrypt (Provos and Mazieres, A Future-Adaptable Password Scheme).

_ALPHABET = "./ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_TEXT = b"OrpheanBeholderScryDoubt"


@cache
def _pi_words(n: int) -> tuple[int, ...]:
    """The first 32-bit words of the fraction of pi, by Machin's formula: what Blowfish starts from."""
    bits = 32 * n + 64

    def arctan(x: int) -> int:
        term, total, k, sign = (1 << bits) // x, 0, 1, 1
        while term:
            total += sign * (term // k)
            term //= x * x
            k, sign = k + 2, -sign
        return total

    fraction = (4 * (4 * arctan(5) - arctan(239))) & ((1 << bits) - 1)
    return tuple(fraction >> (bits - 32 * (i + 1)) & 0xFFFFFFFF for i in range(n))


class _Blowfish:
    def __init__(self):
        words = list(_pi_words(18 + 4 * 256))
        self.p, self.s = words[:18], [words[18 + 256 * i : 274 + 256 * i] for i in range(4)]

    def encrypt(self, left: int, right: int) -> tuple[int, int]:
        p, (a, b, c, d) = self.p, self.s
        for i in range(0, 16, 2):
            left ^= p[i]
            right ^= (((a[left >> 24] + b[left >> 16 & 255]) ^ c[left >> 8 & 255]) + d[left & 255]) & 0xFFFFFFFF
            right ^= p[i + 1]
            left ^= (((a[right >> 24] + b[right >> 16 & 255]) ^ c[right >> 8 & 255]) + d[right & 255]) & 0xFFFFFFFF
        return right ^ p[17], left ^ p[16]

    def expand(self, key: list[int], salt: list[int]) -> None:
        self.p = [x ^ key[i % len(key)] for i, x in enumerate(self.p)]
        left = right = turn = 0
        for table in (self.p, *self.s):
            for i in range(0, len(table), 2):
                left, right = self.encrypt(left ^ salt[turn], right ^ salt[turn + 1])
                table[i], table[i + 1] = left, right
                turn = (turn + 2) % len(salt)


def _words32(data: bytes) -> list[int]:
    return list(struct.unpack(f">{len(data) // 4}I", data))


def _to64(data: bytes) -> str:
    bits = int.from_bytes(data) << (-8 * len(data) % 6)
    n = -(-8 * len(data) // 6)
    return "".join(_ALPHABET[bits >> 6 * (n - 1 - i) & 63] for i in range(n))


def _from64(text: str, size: int) -> bytes:
    bits = 0
    for c in text:
        bits = bits << 6 | _ALPHABET.index(c)
    return (bits >> (6 * len(text) - 8 * size)).to_bytes(size)


def gen_salt(kind: str = "bf", cost: int = 6) -> str:
    """A new salt; only Blowfish's."""
    if kind != "bf":
        raise NotImplementedError("only bf salts are supported")
    if not 4 <= cost <= 31:
        raise ValueError("incorrect number of rounds")
    return f"$2a${cost:02}${_to64(os.urandom(16))}"


def crypt_text(password: str, salt: str) -> str:
    """The hash of a password under a salt, or under a whole hash, whose salt is taken: ``crypt(p, h) == h`` for the right one. 72 bytes count."""
    m = re.match(r"\$2([aby])\$(\d\d)\$([./A-Za-z0-9]{22})", salt)
    if not m or not 4 <= int(m[2]) <= 31:
        raise ValueError("invalid salt")
    raw = _from64(m[3], 16)
    data = (password.encode() + b"\0")[:72]
    key, own = _words32((data * (72 // len(data) + 1))[:72]), _words32(raw)
    cipher = _Blowfish()
    cipher.expand(key, own)
    for _ in range(1 << int(m[2])):
        cipher.expand(key, [0, 0])
        cipher.expand(own, [0, 0])
    text = _words32(_TEXT)
    for i in range(0, 6, 2):
        for _ in range(64):
            text[i], text[i + 1] = cipher.encrypt(text[i], text[i + 1])
    return f"$2{m[1]}${m[2]}${_to64(raw)}{_to64(struct.pack('>6I', *text)[:23])}"


@F.pandas_udf(T.StringType())
def crypt(password: pd.Series, salt: pd.Series) -> pd.Series:
    """``crypt(password, salt)``; null if either is."""
    return pd.Series([None if p is None or s is None else crypt_text(p, s) for p, s in zip(password, salt, strict=True)], dtype=object)

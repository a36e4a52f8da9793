"""Passwords, capability tokens, secret shares and sealed logs: plain library functions."""

from __future__ import annotations

import hashlib
import hmac
import json
import os


def password_record(password: str, rounds: int = 4096) -> str:
    """A salted record of a password; the password itself isn't kept."""
    salt = os.urandom(16)
    return f"pbkdf2${rounds}${salt.hex()}${hashlib.pbkdf2_hmac('sha256', password.encode(), salt, rounds).hex()}"


def password_matches(password: str, record: str) -> bool:
    _, rounds, salt, want = record.split("$")
    got = hashlib.pbkdf2_hmac("sha256", password.encode(), bytes.fromhex(salt), int(rounds)).hex()
    return hmac.compare_digest(got, want)


def issue_token(key: bytes, claims: dict) -> str:
    """A capability token: claims and their HMAC-SHA256. ``expires`` is a logical time."""
    body = json.dumps(claims, sort_keys=True, separators=(",", ":"))
    return body.encode().hex() + "." + hmac.new(key, body.encode(), "sha256").hexdigest()


def read_token(key: bytes, token: str, now: int = 0) -> dict:
    body, _, mac = token.partition(".")
    raw = bytes.fromhex(body)
    if not hmac.compare_digest(hmac.new(key, raw, "sha256").hexdigest(), mac):
        raise ValueError("the token's seal doesn't match")
    claims = json.loads(raw)
    if "expires" in claims and now >= claims["expires"]:
        raise ValueError("the token has expired")
    return claims


def _tables() -> tuple[list[int], list[int]]:
    """Powers and logarithms of the generator 3 in the field of 256 elements with polynomial 0x11b."""
    power, log, x = [], [0] * 256, 1
    for i in range(255):
        power.append(x)
        log[x] = i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    return power, log


_POWER, _LOG = _tables()


def _mul(a: int, b: int) -> int:
    return _POWER[(_LOG[a] + _LOG[b]) % 255] if a and b else 0


def split_secret(secret: bytes, shares: int, threshold: int) -> list[tuple[int, bytes]]:
    """Shamir shares of ``secret``, any ``threshold`` of which give it back."""
    if not 1 <= threshold <= shares <= 255:
        raise ValueError("1 <= threshold <= shares <= 255")
    polys = [[b, *os.urandom(threshold - 1)] for b in secret]

    def at(poly: list[int], x: int) -> int:
        y = 0
        for c in reversed(poly):
            y = _mul(y, x) ^ c
        return y

    return [(x, bytes(at(p, x) for p in polys)) for x in range(1, shares + 1)]


def join_secret(shares: list[tuple[int, bytes]]) -> bytes:
    xs = [x for x, _ in shares]
    if len(set(xs)) < len(xs) or not xs or 0 in xs:
        raise ValueError("shares are distinct and not numbered 0")
    out = []
    for i in range(len(shares[0][1])):
        total = 0
        for x, body in shares:
            weight = 1
            for z in xs:
                if z != x:
                    weight = _mul(weight, _mul(z, _POWER[(255 - _LOG[z ^ x]) % 255]))
            total ^= _mul(body[i], weight)
        out.append(total)
    return bytes(out)


class ForwardLog:
    """Entries sealed under a key that is replaced after each, so that a stolen key forges no earlier entry."""

    def __init__(self, key: bytes):
        self._key = key
        self.entries: list[tuple[bytes, bytes]] = []

    def append(self, entry: bytes) -> None:
        self.entries.append((entry, hmac.new(self._key, entry, "sha256").digest()))
        self._key = hashlib.sha256(b"next" + self._key).digest()

    @staticmethod
    def verify(first_key: bytes, entries: list[tuple[bytes, bytes]]) -> bool:
        key = first_key
        for entry, seal in entries:
            if not hmac.compare_digest(hmac.new(key, entry, "sha256").digest(), seal):
                return False
            key = hashlib.sha256(b"next" + key).digest()
        return True

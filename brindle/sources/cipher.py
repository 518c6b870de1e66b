"""Authenticated encryption with extended nonces: the ChaCha20 stream over 192-bit nonces, and Poly1305 tags. NumPy computes all blocks of a message at once."""

from __future__ import annotations

import hmac
import struct

import numpy as np

#: Fixed values of the public specifications: the constant words of the state, and the mask of the tag's multiplier.
CONSTANTS = struct.unpack("<4I", b"expand 32-byte k")
CLAMP = 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF
PRIME = (1 << 130) - 5
U32 = np.uint32


class AuthenticationError(ValueError):
    pass


def _rounds(s: np.ndarray) -> np.ndarray:
    """Ten double rounds on states (16, lanes), four quarter rounds side by side."""

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return (x << U32(n)) | (x >> U32(32 - n))

    a, b, c, d = s[:4], s[4:8], s[8:12], s[12:]
    for half in range(20):
        if half % 2:
            b, c, d = np.roll(b, -1, axis=0), np.roll(c, -2, axis=0), np.roll(d, -3, axis=0)
        a = a + b
        d = turned(d ^ a, 16)
        c = c + d
        b = turned(b ^ c, 12)
        a = a + b
        d = turned(d ^ a, 8)
        c = c + d
        b = turned(b ^ c, 7)
        if half % 2:
            b, c, d = np.roll(b, 1, axis=0), np.roll(c, 2, axis=0), np.roll(d, 3, axis=0)
    return np.concatenate([a, b, c, d])


def _state(key: bytes, last: bytes) -> np.ndarray:
    return np.array([*CONSTANTS, *struct.unpack("<8I", key), *struct.unpack("<4I", last)], U32)[:, None]


def subkey(key: bytes, nonce: bytes) -> bytes:
    """The key of a 128-bit nonce part: the first and last rows of the rounds, without the final addition."""
    out = _rounds(_state(key, nonce))[:, 0]
    return np.concatenate([out[:4], out[12:]]).astype("<u4").tobytes()


def stream(key: bytes, nonce: bytes, first: int, size: int) -> bytes:
    """Key stream from block `first` on, for a 96-bit nonce."""
    blocks = -(-size // 64)
    if not blocks:
        return b""
    s = np.repeat(_state(key, struct.pack("<I", 0) + nonce), blocks, axis=1)
    s[12] = np.arange(first, first + blocks).astype(U32)
    return np.ascontiguousarray((_rounds(s) + s).T).astype("<u4").tobytes()[:size]


def tag(key: bytes, data: bytes) -> bytes:
    """The one-time tag of whole 16-byte blocks."""
    r, add = int.from_bytes(key[:16], "little") & CLAMP, int.from_bytes(key[16:], "little")
    total = 0
    for i in range(0, len(data), 16):
        total = (total + int.from_bytes(data[i : i + 16] + b"\1", "little")) * r % PRIME
    return ((total + add) & ((1 << 128) - 1)).to_bytes(16, "little")


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 16)


def _tag_of(key: bytes, nonce: bytes, sealed: bytes, more: bytes) -> bytes:
    lengths = struct.pack("<QQ", len(more), len(sealed))
    return tag(stream(key, nonce, 0, 32), _padded(more) + _padded(sealed) + lengths)


def _xor(data: bytes, with_: bytes) -> bytes:
    return (np.frombuffer(data, np.uint8) ^ np.frombuffer(with_, np.uint8)).tobytes()


def seal(key: bytes, nonce: bytes, data: bytes, more: bytes = b"") -> bytes:
    """Encrypted data followed by the tag of it and of `more`; the nonce has 24 bytes."""
    own, rest = subkey(key, nonce[:16]), bytes(4) + nonce[16:]
    sealed = _xor(data, stream(own, rest, 1, len(data)))
    return sealed + _tag_of(own, rest, sealed, more)


def open_sealed(key: bytes, nonce: bytes, sealed: bytes, more: bytes = b"") -> bytes:
    own, rest = subkey(key, nonce[:16]), bytes(4) + nonce[16:]
    body, given = sealed[:-16], sealed[-16:]
    if not hmac.compare_digest(_tag_of(own, rest, body, more), given):
        raise AuthenticationError("the tag does not fit")
    return _xor(body, stream(own, rest, 1, len(body)))

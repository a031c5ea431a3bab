"""The block cipher of encrypted notifications (AES of FIPS 197 in CFB mode, RFC 3826), over numpy arrays.

Only encryption of blocks is needed: CFB turns it into a key stream, which for decryption is known for all
blocks at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def _double(a: int) -> int:
    return (a << 1) ^ (0x11B if a & 0x80 else 0)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out, a, b = out ^ (a if b & 1 else 0), _double(a), b >> 1
    return out


def _substitution() -> np.ndarray:
    """The substitution by its rule: the inverse in the field of 256 elements, then a fixed affine map."""
    inverse = {a: b for a in range(1, 256) for b in range(1, 256) if _times(a, b) == 1}
    out = []
    for a in range(256):
        b = inverse.get(a, 0)
        s = 0x63
        for k in range(5):
            s ^= (b << k | b >> (8 - k)) & 0xFF
        out.append(s)
    return np.array(out, dtype=np.uint8)


SUBSTITUTION = _substitution()
_DOUBLED = np.array([_double(a) for a in range(256)], dtype=np.uint8)
#: Where each byte of a block comes from when row r of the 4 x 4 square (column by column) turns by r.
_TURNED = np.array([(4 * (c + r) + r) % 16 for c in range(4) for r in range(4)])


@lru_cache(maxsize=4096)
def round_keys(key: bytes) -> np.ndarray:
    """Keys of all rounds, 16 bytes each, of a key of 16, 24 or 32 bytes."""
    if len(key) not in (16, 24, 32):
        raise ValueError("a key has 16, 24 or 32 bytes")
    n, s = len(key) // 4, SUBSTITUTION
    words, factor = [list(key[4 * k : 4 * k + 4]) for k in range(n)], 1
    for k in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if k % n == 0:
            w = [int(s[x]) for x in (w[1], w[2], w[3], w[0])]
            w[0], factor = w[0] ^ factor, _double(factor)
        elif n == 8 and k % n == 4:
            w = [int(s[x]) for x in w]
        words.append([a ^ b for a, b in zip(words[k - n], w, strict=True)])
    return np.array(words, dtype=np.uint8).reshape(-1, 16)


def encrypt_blocks(blocks: np.ndarray, key: bytes) -> np.ndarray:
    """Each row of ``blocks`` (n x 16 bytes) encrypted."""
    keys = round_keys(key)
    state = blocks ^ keys[0]
    for k, own in enumerate(keys[1:], 1):
        state = SUBSTITUTION[state][:, _TURNED]
        if k < len(keys) - 1:
            c = state.reshape(-1, 4, 4)
            whole = c[..., 0] ^ c[..., 1] ^ c[..., 2] ^ c[..., 3]
            state = (c ^ whole[..., None] ^ _DOUBLED[c ^ np.roll(c, -1, axis=2)]).reshape(-1, 16)
        state = state ^ own
    return state


def cfb_decrypt(data: bytes, key: bytes, start: bytes) -> bytes:
    """``data`` (of any length) decrypted: each block is hidden by the block before it, encrypted."""
    if not data:
        return b""
    padded = np.frombuffer(data + bytes(-len(data) % 16), dtype=np.uint8).reshape(-1, 16)
    before = np.vstack([np.frombuffer(start, dtype=np.uint8)[None, :], padded[:-1]])
    return (padded ^ encrypt_blocks(before, key)).tobytes()[: len(data)]


def cfb_encrypt(data: bytes, key: bytes, start: bytes) -> bytes:
    """The other way, block after block."""
    out, before = b"", np.frombuffer(start, dtype=np.uint8)
    for at in range(0, len(data), 16):
        block = data[at : at + 16]
        hidden = np.frombuffer(block + bytes(16 - len(block)), dtype=np.uint8) ^ encrypt_blocks(before[None, :], key)[0]
        out, before = out + hidden.tobytes()[: len(block)], hidden
    return out

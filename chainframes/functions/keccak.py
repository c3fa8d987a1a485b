"""Keccak-256 of a few configured values, on the driver.

Only addresses and signatures that a spec names are hashed (hundreds at most);
nothing here runs on rows.
"""

from __future__ import annotations

from functools import cache

_MASK = (1 << 64) - 1
RATE = 136  # bytes absorbed per permutation


@cache
def _constants() -> tuple[list[int], list[tuple[int, int]]]:
    """Round constants from the degree-8 shift register, and for each lane but the
    first its place on the walk of rho and pi with its rotation."""
    register, rounds = 1, []
    for _ in range(24):
        constant = 0
        for j in range(7):
            if register & 1:
                constant |= 1 << ((1 << j) - 1)
            register = (register << 1) ^ (0x171 if register & 0x80 else 0)
        rounds.append(constant)
    x, y, walk = 1, 0, []
    for t in range(24):
        walk.append((x + 5 * y, (t + 1) * (t + 2) // 2 % 64))
        x, y = y, (2 * x + 3 * y) % 5
    return rounds, walk


def _turn(lane: int, by: int) -> int:
    return ((lane << by) | (lane >> (64 - by))) & _MASK


def _permute(lanes: list[int]) -> list[int]:
    rounds, walk = _constants()
    for constant in rounds:
        column = [lanes[x] ^ lanes[x + 5] ^ lanes[x + 10] ^ lanes[x + 15] ^ lanes[x + 20] for x in range(5)]
        lanes = [lane ^ column[(i - 1) % 5] ^ _turn(column[(i + 1) % 5], 1) for i, lane in enumerate(lanes)]
        moved = lanes[:1] + [0] * 24
        for step, (at, by) in enumerate(walk):
            to = walk[(step + 1) % 24][0]
            moved[to] = _turn(lanes[at], by)
        lanes = [moved[i] ^ (~moved[i - i % 5 + (i + 1) % 5] & _MASK & moved[i - i % 5 + (i + 2) % 5]) for i in range(25)]
        lanes[0] ^= constant
    return lanes


def keccak256(data: bytes) -> bytes:
    """The original padding (0x01), as chain addresses and topics use it."""
    padded = bytearray(data + b"\x01" + bytes(-(len(data) + 1) % RATE))
    padded[-1] |= 0x80
    lanes = [0] * 25
    for start in range(0, len(padded), RATE):
        for i in range(RATE // 8):
            lanes[i] ^= int.from_bytes(padded[start + 8 * i : start + 8 * i + 8], "little")
        lanes = _permute(lanes)
    return b"".join(lane.to_bytes(8, "little") for lane in lanes[:4])


def bloom_positions(address: str) -> tuple[int, int, int]:
    """The three bits (0..2047) that an address sets in a block's bloom: the low 11
    bits of the first three pairs of bytes of its hash."""
    digest = keccak256(bytes.fromhex(address.lower().removeprefix("0x")))
    return tuple(int.from_bytes(digest[i : i + 2], "big") % 2048 for i in (0, 2, 4))


def selector(signature: str) -> str:
    """An event's ``topic0`` from its signature, such as ``Transfer(address,address,uint256)``."""
    return keccak256(signature.encode()).hex()


def call_selector(signature: str) -> str:
    """The first four bytes of calldata of a function with that signature."""
    return selector(signature)[:8]

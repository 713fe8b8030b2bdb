"""Portable integer mixing, for repeatable synthetic columns.

The arithmetic stays inside 64-bit integers and uses only multiply, add, xor, shift and
remainder, so any SQL engine can reproduce the values. Expressions are built as SQL text:
one parsed expression is far cheaper to make from Python than a tree of column calls.
"""

from __future__ import annotations

MODULUS = 2_147_483_648
KEY_RANGE = 4_294_967_296
MULTIPLIER = 1_103_515_245
STREAM_STEP = 2_654_435_761


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def mix(key: str, stream: int) -> str:
    """A number in [0, 2**26) that depends on the key column and on a stream number."""
    seed = (stream * STREAM_STEP) % MODULUS
    x = f"((pmod(CAST({key} AS BIGINT), {KEY_RANGE}L) * {MULTIPLIER}L + {seed}L) % {MODULUS}L)"
    return f"shiftright((({x} ^ shiftright({x}, 15)) * {MULTIPLIER}L + 12345L) % {MODULUS}L, 5)"


def between(key: str, stream: int, low: int, high: int) -> str:
    """A whole number in [low, high]."""
    return f"({mix(key, stream)} % {high - low + 1}L + {low}L)"


def pick(key: str, stream: int, values: tuple[str, ...]) -> str:
    """One of a fixed list of values."""
    choices = ", ".join(literal(v) for v in values)
    return f"element_at(array({choices}), CAST({mix(key, stream)} % {len(values)}L AS INT) + 1)"

"""Generated sort records: pseudo-random keys, padded row ids and filler.

The expressions are SQL texts: one text costs one call into the JVM however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# The generator s -> (s * MULTIPLIER + INCREMENT) mod 2^32 and the record layout.
MULTIPLIER = 3141592621
INCREMENT = 663896637
DRAWS_PER_ROW = 3
DRAW_DIVISOR = 52
KEY_BASE = 95
KEY_BYTES = 10
ID_BYTES = 10
FILLER_BLOCKS = (10, 10, 10, 10, 10, 10, 10, 8)

_MASK = 2**32 - 1


def jump_tables() -> list[list[tuple[int, int]]]:
    """For each of the four bytes of a step count: the map (a, c) that takes that many steps.

    n steps of the generator are again a map s -> a*s + c, and such maps commute, so four
    look-ups reach any state without walking there.
    """
    tables = []
    a, c = MULTIPLIER, INCREMENT
    for _ in range(4):
        row, cur = [], (1, 0)
        for _ in range(256):
            row.append(cur)
            cur = ((cur[0] * a) & _MASK, (cur[1] * a + c) & _MASK)
        tables.append(row)
        a, c = cur
    return tables


def _affine(a: str, s: str, c: str) -> str:
    """(a*s + c) mod 2^32 without overflowing a signed 64-bit product."""
    high = f"((shiftright({a}, 16) * {s}) & 65535L) * 65536L"
    return f"(({high} + ({a} & 65535L) * {s} + {c}) & {_MASK}L)"


def _look_up(values: list[int], index: str) -> str:
    """Entry of a constant array, given as one text that is folded before the query runs."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)[{index}]"


def with_draws(df: DataFrame, row_id: str, names: tuple[str, ...] = ("_d1", "_d2", "_d3")) -> DataFrame:
    """Add the draws of a row: the states one, two and three steps after 3 * row_id steps from 0."""
    keep = [f"`{c}`" for c in df.columns]
    df = df.selectExpr(*keep, f"(cast({row_id} as bigint) * {DRAWS_PER_ROW}) & {_MASK}L as _steps")
    entries = []
    for byte, table in enumerate(jump_tables()):
        index = f"cast(shiftright(_steps, {8 * byte}) & 255 as int)"
        entries += [f"{_look_up([m[i] for m in table], index)} as _{'ac'[i]}{byte}" for i in (0, 1)]
    df = df.selectExpr(*keep, *entries)
    state = "_c0"
    for byte in (1, 2, 3):
        later = [f"_{n}{b}" for b in range(byte + 1, 4) for n in "ac"]
        df = df.selectExpr(*keep, *later, f"{_affine(f'_a{byte}', state, f'_c{byte}')} as _state")
        state = "_state"
    for i, name in enumerate(names):
        df = df.selectExpr(*keep, *names[:i], f"{_affine(f'{MULTIPLIER}L', state, f'{INCREMENT}L')} as {name}")
        state = name
    return df


def _key_part(draw: str) -> str:
    """Four printable characters of one draw, most significant digit first."""
    places = [KEY_BASE**3, KEY_BASE**2, KEY_BASE, 1]
    return ", ".join(f"char(({draw} div {DRAW_DIVISOR} div {p}) % {KEY_BASE} + 32)" for p in places)


def with_key(df: DataFrame, row_id: str, name: str = "key") -> DataFrame:
    """Add the ten-character key of a row."""
    keep = [f"`{c}`" for c in df.columns]
    parts = ", ".join(_key_part(d) for d in ("_d1", "_d2", "_d3"))
    return with_draws(df, row_id).selectExpr(*keep, f"substring(concat({parts}), 1, {KEY_BYTES}) as {name}")


def padded_id(row_id: str) -> str:
    """Row id as a 32-bit integer, right-justified in ten characters."""
    wrapped = f"((({row_id} + {2**31}L) & {_MASK}L) - {2**31}L)"
    return f"lpad(cast({wrapped} as string), {ID_BYTES}, ' ')"


def filler(row_id: str) -> str:
    """Blocks of repeated capital letters whose first letter follows the row id."""
    texts = []
    for base in range(26):
        blocks = (chr(ord("A") + (base + i) % 26) * n for i, n in enumerate(FILLER_BLOCKS))
        texts.append("".join(blocks))
    return f"split('{','.join(texts)}', ',')[cast(({row_id} * {len(FILLER_BLOCKS)}) % 26 as int)]"

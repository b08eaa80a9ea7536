"""Boxes of one kind and size read together: a field is one number for all of them, or an array with one for each.

A decoder runs once for a group, on a reader whose numbers may be ``Each``. Where it has to know such a number, to choose or to
write a text, it fails with ``Differs``, and the group is parted by that number, or its boxes are read one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NoReturn

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from streamloom.operators.box_fields import Malformed, Reader, Table, render

#: Smaller groups, and parts of a group of fewer boxes on average, are read box by box.
FEWEST = 8


class Differs(Exception):
    def __init__(self, values: np.ndarray | None = None):
        self.values = values


class Each:
    """A number of each box of a group: below 2^62 in magnitude, so that what decoders do to it stays exact."""

    __slots__ = ("of",)

    def __init__(self, of: np.ndarray):
        self.of = of

    def unknown(self, *_) -> NoReturn:
        raise Differs(self.of)

    __bool__ = __index__ = __int__ = __float__ = __eq__ = __ne__ = __lt__ = __le__ = __gt__ = __ge__ = __hash__ = __str__ = __repr__ = __format__ = unknown
    __lshift__ = __rlshift__ = __rrshift__ = __mul__ = __rmul__ = __truediv__ = __floordiv__ = __mod__ = __pow__ = __neg__ = __or__ = __ror__ = __xor__ = to_bytes = unknown

    def __and__(self, other: int):
        return number(self.of & other) if type(other) is int and other < 1 << 62 else self.unknown()

    def __rshift__(self, other: int):
        return number(self.of >> other) if type(other) is int and other < 63 else self.unknown()

    def __add__(self, other: int):
        return number(self.of + other) if type(other) is int and -(1 << 61) < other < 1 << 61 else self.unknown()

    def __sub__(self, other: int):
        return self + -other if type(other) is int else self.unknown()

    __rand__, __radd__, __rsub__ = __and__, __add__, unknown


def number(values: np.ndarray) -> int | Each:
    first = int(values[0])
    if (values == values[0]).all():
        return first
    if int(values.max()) >= 1 << 62 or int(values.min()) < -(1 << 62):
        raise Differs
    return Each(values)


class Readers(Reader):
    """A reader of bodies of one size, a row of bytes each."""

    def __init__(self, bodies: np.ndarray):
        super().__init__(bodies[0].tobytes())
        self.bodies, self.same = bodies, (bodies == bodies[0]).all(axis=0)

    def bits(self, n: int) -> int | Each:
        at, end = self.bit // 8, -(-(self.bit + n) // 8)
        if n < 1 or end > len(self.data) or self.same[at:end].all():
            return super().bits(n)
        if end - at > 8:
            raise Differs
        value = np.zeros(len(self.bodies), np.uint64)
        for k in range(at, end):
            value = value << np.uint64(8) | self.bodies[:, k].astype(np.uint64)
        value = value >> np.uint64(8 * end - self.bit - n)
        if n < 64:
            value &= np.uint64((1 << n) - 1)
        if int(value.max()) >= 1 << 62:
            raise Differs
        self.bit += n
        return number(value.astype(np.int64))

    def u(self, size: int) -> int | Each:
        return self.bits(8 * size)

    def i(self, size: int) -> int | Each:
        at = self.bit // 8
        if size > 4 or at + size > len(self.data) or self.same[at : at + size].all():
            return super().i(size)
        value = self.u(size)
        if not isinstance(value, Each):
            return value - (1 << 8 * size) if value >> (8 * size - 1) else value
        return number(np.where(value.of >> (8 * size - 1), value.of - (1 << 8 * size), value.of))

    def f32(self) -> float:
        at = self.bit // 8
        if not self.same[at : at + 4].all():
            raise Differs
        return super().f32()

    def take(self, n: int) -> bytes:
        at = self.bit // 8
        if n > 0 and not self.same[at : at + n].all():
            raise Differs
        return super().take(n)


def _texts(value: Any, n: int) -> pa.Array:
    """A text for each of ``n`` boxes."""
    if isinstance(value, Each):
        return pa.array(value.of).cast(pa.string())
    if isinstance(value, list | tuple) and any(isinstance(v, Each) for v in value):
        return pc.binary_join_element_wise(*(_texts(v, n) for v in value), ", ")
    return pa.array([render(value)] * n, pa.string())


def _varies(value: Any) -> bool:
    return isinstance(value, Each) or (isinstance(value, list | tuple) and any(map(_varies, value)))


def _tables(rows: list[list[Any]], n: int) -> pa.Array:
    """A table of texts for each of ``n`` boxes."""
    cells = [_texts(v, n) for r in rows for v in r]
    order = np.arange(len(cells) * n).reshape(len(cells), n).T.ravel()
    flat = pa.concat_arrays(cells).take(pa.array(order))
    ends = np.cumsum([len(r) for r in rows])
    inner = np.concatenate([[0], (np.arange(n)[:, None] * len(cells) + ends).ravel()])
    lists = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), flat)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(rows), pa.int32()), lists)


Fields = list[tuple[str, Any]]


def read(bodies: np.ndarray, decode: Callable[[Reader], tuple[str, Fields]]) -> list[tuple[np.ndarray, tuple[str, Fields] | None]]:
    """(rows of ``bodies``, name and fields that hold for all of them); None: those are to be read one by one."""
    out, todo = [], [np.arange(len(bodies))]
    while todo:
        of = todo.pop()
        if len(of) < FEWEST:
            out.append((of, None))
            continue
        try:
            out.append((of, decode(Readers(bodies[of]))))
        except Differs as e:
            kinds = () if e.values is None else np.unique(e.values)
            if len(kinds) > 1 and len(kinds) * FEWEST <= len(of):
                todo += [of[e.values == k] for k in kinds]
            else:
                out.append((of, None))
        except (Malformed, ArithmeticError, AttributeError, LookupError, TypeError, ValueError):
            out.append((of, None))  # told by each box's own error
    return out


def texts_of(fields: Fields, n: int) -> tuple[dict[int, pa.Array], dict[int, pa.Array]]:
    """By place: texts, and tables, of fields that are not the same for all ``n`` boxes."""
    texts, tables = {}, {}
    for k, (_, value) in enumerate(fields):
        if isinstance(value, Table):
            if any(_varies(v) for r in value.rows for v in r):
                tables[k] = _tables(value.rows, n)
        elif _varies(value):
            texts[k] = _texts(value, n)
    return texts, tables

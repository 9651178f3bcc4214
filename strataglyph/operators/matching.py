"""Alignment of many bounded units at once: recursive longest common blocks over the arrays of a batch, without a loop over units or tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Positions in a unit are below it.
_PLACES = 1 << 20
#: Pairs of equal tokens that are held at a time; a unit that has more is held alone.
AT_A_TIME = 1 << 21
OPS = pa.array(["replace", "delete", "insert"])


def _steps(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of the next."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _codes(*tokens: pa.Array) -> list[np.ndarray]:
    """The tokens of some arrays as numbers, equal ones alike in all."""
    flat = pa.concat_arrays([t.cast(pa.string()) for t in tokens])
    codes = flat.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, np.cumsum([len(t) for t in tokens])[:-1])


class _Side:
    """Units of tokens on end: where each begins, and how long it is."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        self.codes, self.sizes, self.begins = codes, sizes, np.cumsum(sizes) - sizes

    def chosen(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, place, code) of the tokens of some units, in order."""
        n = self.sizes[units]
        at = _steps(self.begins[units], n)
        return np.repeat(units, n), at - np.repeat(self.begins[units], n), self.codes[at]


def _alike(a: _Side, b: _Side) -> np.ndarray:
    """Which units are the same on both sides."""
    same = a.sizes == b.sizes
    units = np.flatnonzero(same)
    n = a.sizes[units]
    other = a.codes[_steps(a.begins[units], n)] != b.codes[_steps(b.begins[units], n)]
    same[np.repeat(units, n)[other]] = False
    return same


def _pairs(a: _Side, b: _Side, units: np.ndarray) -> np.ndarray:
    """How many pairs of equal tokens each unit has."""
    keys = int(max(a.codes.max(initial=0), b.codes.max(initial=0))) + 1
    ua, _, ca = a.chosen(units)
    ub, _, cb = b.chosen(units)
    kb = np.sort(ub * keys + cb)
    found = np.searchsorted(kb, ua * keys + ca, "right") - np.searchsorted(kb, ua * keys + ca, "left")
    return np.bincount(ua, found, len(a.sizes)).astype(np.int64)[units]


def _runs(a: _Side, b: _Side, units: np.ndarray) -> tuple[np.ndarray, ...]:
    """(unit, i, j, n): the longest runs of equal tokens on every diagonal of every unit, by unit and i."""
    keys = int(max(a.codes.max(initial=0), b.codes.max(initial=0))) + 1
    ua, pa_, ca = a.chosen(units)
    ub, pb, cb = b.chosen(units)
    ka, kb = ua * keys + ca, ub * keys + cb
    order = np.argsort(kb, kind="stable")
    kb = kb[order]
    first = np.searchsorted(kb, ka, "left")
    n = np.searchsorted(kb, ka, "right") - first
    u, i, j = np.repeat(ua, n), np.repeat(pa_, n), pb[order[_steps(first, n)]]
    diagonal = u * (2 * _PLACES) + i - j + _PLACES
    order = np.argsort(diagonal, kind="stable")  # places in a keep their order
    u, i, j, diagonal = u[order], i[order], j[order], diagonal[order]
    begins = np.ones(len(u), bool)
    begins[1:] = (diagonal[1:] != diagonal[:-1]) | (i[1:] != i[:-1] + 1)
    at = np.flatnonzero(begins)
    u, i, j, n = u[at], i[at], j[at], np.diff(np.append(at, len(begins)))
    order = np.argsort(u * _PLACES + i, kind="stable")
    return u[order], i[order], j[order], n[order]


def _split(u: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(unit, i, j, n): the blocks that runs leave.

    The longest run of a stretch is a block (of equal ones the first in a, and
    of those the first in b) and splits it; runs are cut to what lies left and
    right of it in both. A stretch in which no run cuts another off is done.
    All stretches of all units take a step together.
    """
    found, s = [], u
    while len(u):
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        crossed = np.zeros(len(s), np.int64)
        crossed[1:] = ~new[1:] & ((i[1:] < i[:-1] + n[:-1]) | (j[1:] < j[:-1] + n[:-1]))
        done = (np.add.reduceat(crossed, at) == 0)[group]
        found.append((u[done], i[done], j[done], n[done]))
        u, i, j, n, s = (x[~done] for x in (u, i, j, n, group))
        if not len(u):
            break
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        # one number that grows with the length and falls with the places
        best = np.maximum.reduceat((n * _PLACES + (_PLACES - 1 - i)) * _PLACES + (_PLACES - 1 - j), at)
        bj, bi, bn = _PLACES - 1 - best % _PLACES, _PLACES - 1 - best // _PLACES % _PLACES, best // _PLACES // _PLACES
        found.append((u[at], bi, bj, bn))
        bi, bj, bn = bi[group], bj[group], bn[group]
        left = np.minimum(n, np.minimum(bi - i, bj - j))
        gone = np.maximum(0, np.maximum(bi + bn - i, bj + bn - j))
        l, r = left > 0, n > gone  # noqa: E741
        s = np.concatenate([2 * group[l], 2 * group[r] + 1])
        order = np.argsort(s, kind="stable")
        s = s[order]
        both = lambda x, y: np.concatenate([x, y])[order]  # noqa: B023, E731
        u, i, j, n = both(u[l], u[r]), both(i[l], (i + gone)[r]), both(j[l], (j + gone)[r]), both(left[l], (n - gone)[r])
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (u, i, j, n)


def blocks(a: _Side, b: _Side, units: np.ndarray) -> tuple[np.ndarray, ...]:
    """(unit, i, j, n): the blocks of equal tokens of some units, so many units at a time as AT_A_TIME allows."""
    many = np.cumsum(_pairs(a, b, units)) // AT_A_TIME
    parts = [_split(*_runs(a, b, part)) for part in np.split(units, np.flatnonzero(np.diff(many)) + 1)]
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _joined(tokens: pa.Array, begins: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Tokens begins[k], begins[k] + 1, ... counts[k] of them, with single spaces between."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, tokens.take(pa.array(_steps(begins, counts)))), " ")


KIND = ArrayType(StructType([StructField(c, IntegerType() if c in ("block", "k", "ref_position") else StringType()) for c in ("block", "k", "op", "ref_position", "ref_text", "var_text", "ref_rasm", "var_rasm")]))


@F.arrow_udf(KIND)
def rows(ref_plain: pa.Array, ref_rasm: pa.Array, var_plain: pa.Array, var_rasm: pa.Array) -> pa.Array:
    """What differs in each unit, aligned on its rasm: a row for what lies between blocks, with the rasm of both sides, and one for each token of a block that is spelled otherwise, without. None of a unit whose plain tokens are the same, or null."""
    whole = pc.and_(pc.and_(ref_plain.is_valid(), ref_rasm.is_valid()), pc.and_(var_plain.is_valid(), var_rasm.is_valid()))
    units = len(whole)
    held = [x.filter(whole) for x in (ref_plain, ref_rasm, var_plain, var_rasm)]
    place = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
    sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in held]
    ap, ar, bp, br = (x.flatten().cast(pa.string()) for x in held)
    apc, bpc = _codes(ap, bp)
    arc, brc = _codes(ar, br)
    changed = ~_alike(_Side(apc, sizes[0]), _Side(bpc, sizes[2]))

    def spelled(plain: pa.Array, codes: np.ndarray, rasm: pa.Array, own: np.ndarray, n: np.ndarray):  # noqa: ANN202
        """A side without the tokens that have no rasm, which can't be aligned; the others keep their places."""
        there = pc.not_equal(rasm, "").fill_null(False).to_numpy(zero_copy_only=False)
        unit = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
        keep = pa.array(there)
        return plain.filter(keep), codes[there], rasm.filter(keep), _Side(own[there], np.bincount(unit[there], minlength=len(n)).astype(np.int64)), at[there]

    ap, apc, ar, a, a_at = spelled(ap, apc, ar, arc, sizes[1])
    bp, bpc, br, b, _ = spelled(bp, bpc, br, brc, sizes[3])
    alike = _alike(a, b)
    plain = np.flatnonzero(changed & alike & (a.sizes > 0))
    zero = np.zeros(len(plain), np.int64)
    found = blocks(a, b, np.flatnonzero(changed & ~alike))
    ends = np.flatnonzero(changed)
    u, i, j, n = (np.concatenate(c) for c in zip((plain, zero, zero, a.sizes[plain]), found, (ends, a.sizes[ends], b.sizes[ends], 0 * ends), strict=True))
    order = np.argsort(u * _PLACES + i, kind="stable")
    u, i, j, n = u[order], i[order], j[order], n[order]
    first = np.ones(len(u), bool)
    first[1:] = u[1:] != u[:-1]
    ended = lambda x: np.where(first, 0, np.concatenate([[0], (x + n)[:-1]])) if len(x) else x
    i1, j1 = ended(i), ended(j)
    k = np.arange(len(u)) - np.maximum.accumulate(np.where(first, np.arange(len(u)), 0)) if len(u) else u
    # between blocks
    gap = np.flatnonzero((i1 < i) | (j1 < j))
    gu, gi, gj, ni, nj = u[gap], i1[gap], j1[gap], (i - i1)[gap], (j - j1)[gap]
    op = np.where((ni > 0) & (nj > 0), 0, np.where(ni > 0, 1, 2))
    beyond = gi >= a.sizes[gu]
    where = np.append(a_at, 0)[np.where(beyond, len(a_at), a.begins[gu] + gi)]
    position = np.where(beyond, sizes[0][gu], where) + 1
    text = lambda tokens, side, at, m: _joined(tokens, side.begins[gu] + at, m)
    # within them
    t = _steps(0 * n, n)
    tu, tk, x, y = np.repeat(u, n), np.repeat(k, n), np.repeat(a.begins[u] + i, n) + t, np.repeat(b.begins[u] + j, n) + t
    other = apc[x] != bpc[y]
    tu, tk, t, x, y = tu[other], tk[other], t[other], x[other], y[other]
    none = pa.nulls(len(t), pa.string())
    fields = [
        pa.array(np.concatenate([2 * k[gap], 2 * tk + 1]), pa.int32()), pa.array(np.concatenate([0 * gap, t]), pa.int32()), OPS.take(pa.array(np.concatenate([op, 0 * t]))), pa.array(np.concatenate([position, a_at[x] + 1]), pa.int32()),
        pa.concat_arrays([text(ap, a, gi, ni), ap.take(pa.array(x))]), pa.concat_arrays([text(bp, b, gj, nj), bp.take(pa.array(y))]),
        pa.concat_arrays([text(ar, a, gi, ni), none]), pa.concat_arrays([text(br, b, gj, nj), none]),
    ]
    of = place[np.concatenate([gu, tu])]
    order = pa.array(np.argsort(of, kind="stable"))
    struct = pa.StructArray.from_arrays([f.take(order) for f in fields], names=KIND.elementType.names)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=units))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)

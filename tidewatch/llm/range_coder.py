"""Adaptive range coding of token ids in blocks.

A block is cut into lanes that are coded side by side, one id of every lane per step, by one model that starts
anew with the block.  The model holds, for the last id (order 1) and for the last two (order 2, hashed), the
id that followed and how often in a row it was right; how sure both are chooses the adaptive odds with which
an id is coded as the order-2 prediction, the order-1 prediction, or neither.  An id that neither foretold is
coded by adaptive order-0 counts.  Decoder and encoder update the same model in the same order, so a block
needs nothing but its bytes.  Each lane has its own coder of 62 bits, which sends 32 bits at a time and adds a
carry to what it has sent already.
"""

from __future__ import annotations

import zlib

import numpy as np

LANES = 8192                # at most
LEAST_STEPS = 256
ODDS_BITS, COUNT_BITS = 12, 21
CONTEXT_BITS = 18
REFRESH = 32                # steps between two sets of order-0 odds, fewer at the start of a block

_U = np.uint64
_TOP, _LOW = _U((1 << 62) - 1), _U((1 << 30) - 1)
_SMALL, _W, _S30, _S62 = _U(1 << 30), _U(32), _U(30), _U(62)


class _Model:
    def __init__(self, vocabulary: int, lanes: int):
        # an id and, in the two bits below it, how often in a row it was right
        self.next1 = np.zeros(vocabulary, np.int32)
        self.next2 = np.zeros(1 << CONTEXT_BITS, np.int32)
        self.odds = np.ones((32, 3), np.int64) * np.array([2, 2, 4])
        self.counts = np.ones(vocabulary, np.int64)
        self.seen: list[np.ndarray] = []
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.uint32)
        self.step = 0
        self._set_odds()
        self._set_counts()

    def _set_odds(self) -> None:
        total = 1 << ODDS_BITS
        share = 1 + self.odds * (total - 3) // self.odds.sum(1, keepdims=True)
        share[:, 2] += total - share.sum(1)
        self.share = share.ravel().astype(np.uint64)
        self.below = (np.cumsum(share, 1) - share).ravel().astype(np.uint64)
        self.cut1, self.cut2 = self.below[1::3], self.below[2::3]

    def _set_counts(self) -> None:
        for ids in self.seen:
            self.counts += np.bincount(ids, minlength=len(self.counts)) * 32
        self.seen = []
        total, n = 1 << COUNT_BITS, len(self.counts)
        share = 1 + self.counts * (total - n) // self.counts.sum()
        edges = np.zeros(n + 1, np.uint64)
        np.cumsum(share, out=edges[1:])
        self.count_share, self.count_below = share.astype(np.uint64), edges

    def predict(self):
        last = self.last.astype(np.uint32)
        self.at2 = ((self.before * np.uint32(0x9E3779B1) ^ last * np.uint32(0x85EBCA77)) >> np.uint32(
            32 - CONTEXT_BITS)).astype(np.int64)
        self.before = last
        self.held2, self.held1 = self.next2.take(self.at2), self.next1.take(self.last)
        self.guess2, self.guess1 = self.held2 >> 2, self.held1 >> 2
        self.context = ((self.held2 & 3) << 2 | (self.held1 & 3) | (self.guess1 == self.guess2).astype(np.int32) << 4
                        ).astype(np.int64)
        return self.context

    def update(self, ids: np.ndarray, at: np.ndarray, missed: np.ndarray) -> None:
        """Learn the ``ids`` of a step, coded as the kinds ``at`` (three times the context, and the kind)."""
        self.odds += np.bincount(at, minlength=96).reshape(32, 3) * 16
        fresh = ids << 2
        for held, guess, place, following in ((self.held1, self.guess1, self.last, self.next1),
                                              (self.held2, self.guess2, self.at2, self.next2)):
            trust = held & 3
            following[place] = np.where(guess == ids, held + (trust < 3),
                                        np.where(trust > 0, held - trust + (trust >> 1), fresh))
        self.seen.append(missed)
        self.last = ids.astype(np.int64)
        self.step += 1
        if self.step & 3 == 0 or self.step < 8:
            self._set_odds()
            if self.odds.max() > 1 << 20:
                self.odds = (self.odds >> 1) + 1
        if self.step % REFRESH == 0 or self.step in (1, 2, 4, 8, 16):
            self._set_counts()


def lanes_for(n: int) -> int:
    return max(1, min(LANES, n // LEAST_STEPS))


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """The coded block; ids are whole numbers from 0 to below ``vocabulary`` (at most 2**20)."""
    n, lanes = len(ids), lanes_for(len(ids))
    steps = -(-n // lanes)
    laid = np.zeros(lanes * steps, np.int32)
    laid[:n] = ids
    laid = np.ascontiguousarray(laid.reshape(lanes, steps).T)
    out = np.zeros((lanes, steps + 4), np.uint32)
    flat, width = out.ravel(), out.shape[1]
    place = np.arange(lanes, dtype=np.int64) * width
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _TOP, np.uint64)
    model = _Model(vocabulary, lanes)

    def code(which, below, share, bits):
        """Narrow the spans of some lanes (None: all)."""
        nonlocal low, span
        lo, sp = (low, span) if which is None else (low[which], span[which])
        unit = sp >> _U(bits)
        lo = lo + unit * below
        sp = unit * share
        over = np.flatnonzero(lo > _TOP)
        if len(over):
            at = place[over if which is None else which[over]] - 1
            while len(at):
                flat[at] += np.uint32(1)
                at = at[flat[at] == 0] - 1
            lo[over] &= _TOP
        small = np.flatnonzero(sp < _SMALL)
        if len(small):
            lanes_ = small if which is None else which[small]
            flat[place[lanes_]] = (lo[small] >> _S30).astype(np.uint32)
            place[lanes_] += 1
            lo[small] = (lo[small] & _LOW) << _W
            sp[small] <<= _W
        if which is None:
            low, span = lo, sp
        else:
            low[which], span[which] = lo, sp

    for step in range(steps):
        x = laid[step]
        context = model.predict()
        kind = np.where(model.guess2 == x, 0, np.where(model.guess1 == x, 1, 2))
        at = context * 3 + kind
        code(None, model.below[at], model.share[at], ODDS_BITS)
        miss = np.flatnonzero(kind == 2)
        missed = x[miss]
        if len(miss):
            code(miss, model.count_below[missed], model.count_share[missed], COUNT_BITS)
        model.update(x, at, missed)
    flat[place] = (low >> _S30).astype(np.uint32)
    flat[place + 1] = ((low & _LOW) << _U(2)).astype(np.uint32)
    used = place + 2 - np.arange(lanes) * width
    words = [out[i, :k] for i, k in enumerate(used)]
    return used.astype("<u4").tobytes() + np.concatenate(words).astype("<u4").tobytes()


def decode_block(data: bytes, n: int, vocabulary: int) -> np.ndarray:
    """The ``n`` ids of a coded block."""
    lanes = lanes_for(n)
    steps = -(-n // lanes)
    words = np.frombuffer(data, "<u4")
    used = words[:lanes].astype(np.int64)
    words = np.concatenate([words[lanes:], np.zeros(4, np.uint32)]).astype(np.uint64)
    place = np.cumsum(used) - used
    value = words[place] << _S30 | words[place + 1] >> _U(2)
    rest = words[place + 1] & _U(3)                     # two bits of the word at hand are still to come
    place = place + 2
    span = np.full(lanes, _TOP, np.uint64)
    model = _Model(vocabulary, lanes)
    out = np.empty((steps, lanes), np.int32)

    def narrow(which, val, sp, unit, below, share):
        nonlocal value, span
        val = val - unit * below
        sp = unit * share
        small = np.flatnonzero(sp < _SMALL)
        if len(small):
            lanes_ = small if which is None else which[small]
            word = words[place[lanes_]]
            val[small] = val[small] << _W | rest[lanes_] << _S30 | word >> _U(2)
            rest[lanes_] = word & _U(3)
            place[lanes_] += 1
            sp[small] <<= _W
        if which is None:
            value, span = val, sp
        else:
            value[which], span[which] = val, sp

    for step in range(steps):
        context = model.predict()
        unit = span >> _U(ODDS_BITS)
        kind = (value >= unit * model.cut1[context]).astype(np.int64) + (value >= unit * model.cut2[context])
        at = context * 3 + kind
        narrow(None, value, span, unit, model.below[at], model.share[at])
        x = np.where(kind == 0, model.guess2, model.guess1)
        miss = np.flatnonzero(kind == 2)
        if len(miss):
            val, sp = value[miss], span[miss]
            unit = sp >> _U(COUNT_BITS)
            missed = (np.searchsorted(model.count_below, val // unit, "right") - 1).astype(np.int32)
            narrow(miss, val, sp, unit, model.count_below[missed], model.count_share[missed])
            x[miss] = missed
        else:
            missed = x[:0]
        out[step] = x
        model.update(x, at, missed)
    return out.T.ravel()[:n]


def checksum(ids: np.ndarray, so_far: int = 0) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes(), so_far)

"""Range asymmetric numeral system over symbols with fixed frequencies.

A block of symbols is dealt to ``lanes`` coders in turn, so one numpy step codes a symbol
of every lane. All lanes share one stream of 32-bit words: the decoder takes a word for
each lane whose state ran low, in lane order, and the encoder, which runs backwards, puts
them there. The states after every ``CHECK_STEPS`` steps are kept as checkpoints, from
which a reader can start inside a block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LOW = np.uint64(1 << 31)       # states lie in [2**31, 2**63)
WORD = np.uint64(32)
MAX_LANES = 1024
CHECK_STEPS = 256


def quantised(counts: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Slots per symbol, at least one each, that add up to a power of two (``2**bits``);
    in proportion to the counts as far as that allows."""
    k = len(counts)
    if not k:
        return np.empty(0, np.int64)
    bits = bits or min(max(12, (k - 1).bit_length() + 4), 28)
    spare = (1 << bits) - k
    if spare < 0:
        raise ValueError(f"{k} symbols do not fit into {bits} bits")
    share = counts / counts.sum() * spare
    slots = np.floor(share).astype(np.int64)
    left = spare - int(slots.sum())
    if left > 0:
        first = np.argsort(slots - share, kind="stable")
        slots += left // k
        slots[first[:left % k]] += 1
    elif left < 0:                                            # rounding of the shares themselves
        slots[np.argmax(slots)] += left
    return slots + 1


class Model:
    """Symbols ``0 .. k-1`` with their slots."""

    def __init__(self, slots: np.ndarray):
        total = int(slots.sum())
        if len(slots) and total & (total - 1):
            raise ValueError("slots must add up to a power of two")
        self.bits = max(total.bit_length() - 1, 0)
        self.slots = slots.astype(np.uint64)
        self.first = (np.cumsum(slots) - slots).astype(np.uint64)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        """The symbol of every slot (needed for decoding only)."""
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.slots), dtype=np.int32), self.slots.astype(np.int64))
        return self._symbol


@dataclass
class Coded:
    """One block: its words, and per checkpoint the place in the words and the states."""
    lanes: int
    words: np.ndarray          # uint32
    places: np.ndarray         # uint32, one per checkpoint
    states: np.ndarray         # uint64, checkpoints x lanes


def lanes_for(n: int) -> int:
    """A power of two: short blocks have few states to keep."""
    return int(min(MAX_LANES, 1 << max(0, (n // 64).bit_length() - 1)))


def encode(symbols: np.ndarray, model: Model) -> Coded:
    n = len(symbols)
    lanes = lanes_for(n)
    slots, first = model.slots[symbols], model.first[symbols]
    limit = slots << np.uint64(63 - model.bits)
    state = np.full(lanes, LOW, np.uint64)
    shift = np.uint64(model.bits)
    chunks: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for step in range(-(-n // lanes) - 1, -1, -1):
        a, b = step * lanes, min((step + 1) * lanes, n)
        s = state[:b - a]
        over = s >= limit[a:b]
        if over.any():
            chunks.append(s[over].astype(np.uint32))
            written += len(chunks[-1])
            s = np.where(over, s >> WORD, s)
        whole, rest = np.divmod(s, slots[a:b])
        state[:b - a] = (whole << shift) + first[a:b] + rest
        if step % CHECK_STEPS == 0:
            marks.append((written, state.copy()))
    words = np.concatenate(chunks[::-1]) if chunks else np.empty(0, np.uint32)
    marks.reverse()
    return Coded(lanes, words, np.array([written - w for w, _ in marks], np.uint32),
                 np.array([s for _, s in marks], np.uint64).reshape(len(marks), lanes))


def decode(coded: Coded, n: int, model: Model, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Symbols ``start .. stop`` of a block of ``n``, from the checkpoint before ``start``."""
    stop = n if stop is None else min(stop, n)
    if stop <= start:
        return np.empty(0, np.int32)
    lanes, words = coded.lanes, coded.words
    mark = start // lanes // CHECK_STEPS
    state, at = coded.states[mark].copy(), int(coded.places[mark])
    begin = mark * CHECK_STEPS * lanes
    out = np.empty(min(-(-stop // lanes) * lanes, n) - begin, np.int32)
    shift, mask = np.uint64(model.bits), np.uint64((1 << model.bits) - 1)
    for a in range(begin, stop, lanes):
        b = min(a + lanes, n)
        s = state[:b - a]
        slot = s & mask
        sym = model.symbol[slot]
        out[a - begin:b - begin] = sym
        s = model.slots[sym] * (s >> shift) + slot - model.first[sym]
        low = np.flatnonzero(s < LOW)
        if len(low):
            if at + len(low) > len(words):
                raise ValueError("block ends early")
            s[low] = s[low] << WORD | words[at:at + len(low)]
            at += len(low)
        state[:b - a] = s
    return out[start - begin:stop - begin]

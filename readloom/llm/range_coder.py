"""Adaptive context-mixing range coder for token ids.

A segment's ids are cut into blocks of nearly equal length. Every block starts from the same fresh model, has its own
byte string and a CRC-32 of its ids, so blocks decode alone; here all blocks of a segment are coded side by side, one
id of each at a time, with integer arithmetic only (any machine decodes the same).

Model. Order 2 and order 1: a table keyed by the last two ids, and one by the last id, each predict one id and hold
the probability that it comes true. Order 0: adaptive frequencies of id classes (small ids alone, others in ranges);
the place within a class is uniform. How likely order 2's id is comes from mixing what all three orders say of it, and
how often it came true in the same situation (how sure each of the two is, and whether they agree): their log odds are
added with weights, of which each situation has its own. The weights are learned in the block: after each id they move
against the coding error. Order 1's id is weighed in the same way for where order 2's does not come. The masses of the
two ids and of neither drive the first coding step; order 0 alone drives the second, when neither came true.

TokenCoder.java is the same coder for one block at a time, which the files are written and read with; this one is the
plain form of the format, and the tests hold both against each other.

Coder. A 56-bit window, words of 28 bits; carries are added to the words already written and settled at the end.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RLTC"
ALONE, SPREAD = 512, 7  # ids below ALONE are classes of their own; above, 2 ** SPREAD ids share a class
SLOTS = 11  # bits of the keys of the order-1 and order-2 tables
WORD, WINDOW = 28, 56
LOW = (1 << WORD) - 1
GROUP = 32  # classes that are searched together
STEADY = 512  # order-0 frequencies are renewed at 16, 32, 64 ... and from here on every so many ids
INPUTS = 4, 3  # what is mixed for order 2's id (orders 2, 1, 0, situation) and for order 1's (orders 1, 0, situation)
FIRST, RATE = 16384, 15  # weights at a block's start, of 65536, and how many bits less of an error's product they move by
ODDS = 4095  # largest log odds, in steps of 1/256 bit
LEAST, MOST = 32, 65000  # a mixed probability's bounds, of 65536


def _log_odds() -> np.ndarray:
    """log2(p / (65536 - p)) in steps of 1/256 for p of 0 (taken as 1) to 65535, by squaring integers."""
    p = np.arange(1, 65536, dtype=np.int64)
    whole = sum((p >> bit > 0).astype(np.int64) for bit in range(1, 16))
    rest, log = p << 30 - whole, whole << 8
    for bit in range(7, -1, -1):
        rest = rest * rest >> 30
        two = rest >> 31
        log += two << bit
        rest >>= two
    odds = log - log[::-1]
    return np.concatenate([odds[:1], odds])


LOG_ODDS = _log_odds()
#: The smallest p of 65536 with log odds of -ODDS, -ODDS + 1 ... ODDS, within the bounds.
CHANCE = np.clip(1 + np.searchsorted(LOG_ODDS[1:], np.arange(-ODDS, ODDS + 1)), LEAST, MOST)


class Model:
    """The state of `lanes` blocks. Tables hold two numbers in one entry, so that each costs one look-up."""

    def __init__(self, lanes: int, vocabulary: int):
        self.lanes, lane = lanes, np.arange(lanes, dtype=np.int64)
        self.classes = ALONE + max(1, (vocabulary - ALONE + (1 << SPREAD) - 1) >> SPREAD)
        self.groups = -(-self.classes // GROUP)
        self.at_t, self.at_g, self.at_c = lane << SLOTS, lane * 32, lane * (self.groups * GROUP)
        self.at_group = lane * self.groups
        self.t2, self.t1 = (np.full(lanes << SLOTS, -1 << 16, dtype=np.int64) for _ in range(2))  # id << 16 | chance
        self.g = np.full(lanes * 32, 8192 << 16 | 8192, dtype=np.int64)  # chance of order 2 << 16 | of order 1
        self.weights = np.full((lanes * 32, sum(INPUTS)), FIRST, dtype=np.int64)
        self.counts = np.ones((lanes, self.classes), dtype=np.int32)
        self.counts[:, :ALONE] = 2
        self.cum = np.full((lanes, self.groups * GROUP + 1), 65536, dtype=np.int64)
        self.last, self.before = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
        self.added = np.zeros((lanes, self.classes), dtype=np.int32)
        self.added_flat, self.at_added = self.added.reshape(-1), lane * self.classes
        self.t = 0
        self._renew()

    def _renew(self) -> None:
        self.counts += self.added
        self.added[:] = 0
        sums = self.counts.cumsum(axis=1, dtype=np.int64)
        self.cum[:, 0] = 0
        self.cum[:, 1 : self.classes + 1] = sums * (65536 - self.classes) // sums[:, -1:] + np.arange(1, self.classes + 1)
        start = np.ascontiguousarray(self.cum[:, :-1])
        self.slots = (start << 20 | np.diff(self.cum, axis=1)).reshape(-1)  # start << 20 | width of a class
        self.rows = start.astype(np.int32).reshape(-1, GROUP)
        self.firsts = np.ascontiguousarray(self.rows[:, 0].reshape(self.lanes, self.groups))

    def find(self, slot: np.ndarray) -> np.ndarray:
        """The class that holds each lane's slot: first its group of classes, then its place there."""
        slot = slot.astype(np.int32)[:, None]
        group = np.count_nonzero(self.firsts <= slot, axis=1) - 1
        inside = np.count_nonzero(self.rows.take(self.at_group + group, axis=0) <= slot, axis=1) - 1
        return np.minimum(group * GROUP + inside, self.classes - 1)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Predicted ids of order 2 and 1, and their masses of 65536."""
        mixed = self.last * 40503
        self.i2 = self.at_t + (mixed + self.before * 30011 >> 3 & (1 << SLOTS) - 1)
        self.i1 = self.at_t + (mixed >> 4 & (1 << SLOTS) - 1)
        e2, e1 = self.t2.take(self.i2), self.t1.take(self.i1)
        c2, c1, q2, q1 = e2 >> 16, e1 >> 16, e2 & 65535, e1 & 65535
        same = c2 == c1
        self.j = self.at_g + (q2 >> 14 << 3 | q1 >> 14 << 1 | same)
        g = self.g.take(self.j)
        g2, g1 = g >> 16, g & 65535
        self.odds = LOG_ODDS.take(np.stack([q2, q1, self._order0(c2), g2, q1, self._order0(c1), g1], axis=1))
        said = self.weights.take(self.j, axis=0) * self.odds
        m2 = self._mixed(said[:, : INPUTS[0]])
        p1 = self._mixed(said[:, INPUTS[0] :])
        m1 = np.maximum((65536 - m2) * p1 >> 16, 1) * ~same
        self.seen = c2, c1, q2, q1, g2, g1, m2, p1, same
        return c2, c1, m2, m1

    def _order0(self, c: np.ndarray) -> np.ndarray:
        """Order 0's mass of the class of id c, 0 without one."""
        return (self.slots.take(self.at_c + _class_of(np.maximum(c, 0))) & 0xFFFFF) * (c >= 0)

    def _mixed(self, said: np.ndarray) -> np.ndarray:
        return CHANCE.take(np.clip(said.sum(axis=1) >> 16, -ODDS, ODDS) + ODDS)

    def update(self, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, c1_right: np.ndarray, klass: np.ndarray) -> None:
        """x: the ids that came; klass: their class where neither prediction was right."""
        c2, c1, q2, q1, g2, g1, m2, p1, same = self.seen
        error = np.repeat(np.stack([hit2 * 65536 - m2, (hit1 * 65536 - p1) * ~(hit2 | same)], axis=1), INPUTS, axis=1)
        self.weights[self.j] += self.odds * error >> RATE
        fresh = x << 16 | 16384
        # a poor prediction that fails makes room
        self.t2[self.i2] = np.where(hit2 | (q2 >= 24000), c2 << 16 | q2 + (hit2 * 65535 - q2 >> 2), fresh)
        self.t1[self.i1] = np.where(c1_right | (q1 >= 24000), c1 << 16 | q1 + (c1_right * 65535 - q1 >> 2), fresh)
        self.g[self.j] = g2 + (hit2 * 65535 - g2 >> 4) << 16 | np.where(hit2, g1, g1 + (hit1 * 65535 - g1 >> 4))
        missed = np.nonzero(~(hit2 | hit1))[0]
        self.added_flat[self.at_added[missed] + klass[missed]] += 24
        self.before, self.last = self.last, x
        self.t += 1
        if self.t % STEADY == 0 or self.t >= 16 and self.t & self.t - 1 == 0 and self.t < STEADY:
            self._renew()


def _class_of(x: np.ndarray) -> np.ndarray:
    return np.where(x < ALONE, x, ALONE + (x - ALONE >> SPREAD))


def encode_blocks(ids: np.ndarray, vocabulary: int) -> list[bytes]:
    """Byte strings of the rows of ids (lanes, length); an id of -1 in the last column: that row is one shorter."""
    lanes, length = ids.shape
    cap = length * 44 // WORD + 6
    out, pos, row = np.zeros((lanes, cap), dtype=np.int64), np.zeros(lanes, dtype=np.int64), np.arange(lanes)
    low, span = np.zeros(lanes, dtype=np.int64), np.full(lanes, 1 << WINDOW, dtype=np.int64)
    model, columns = Model(lanes, vocabulary), np.ascontiguousarray(ids.T.astype(np.int64))

    def renorm() -> None:
        at = np.nonzero(span <= LOW)[0]
        if len(at):
            x = low[at]
            out[at, pos[at]] = x >> WORD
            pos[at] += 1
            low[at] = (x & LOW) << WORD
            span[at] <<= WORD

    for t in range(length):
        x, ended = columns[t], None
        if t == length - 1 and (x < 0).any():
            ended = x < 0, low.copy(), span.copy()
            x = np.maximum(x, 0)
        c2, c1, m2, m1 = model.predict()
        hit2, right1 = x == c2, x == c1
        hit1, rest = right1 & ~hit2, m2 + m1
        hit = hit2 | hit1
        r = span >> 16
        low += r * np.where(hit2, 0, np.where(hit1, m2, rest))
        span = r * np.where(hit2, m2, np.where(hit1, m1, 65536 - rest))
        if ended:
            low, span = np.where(ended[0], ended[1], low), np.where(ended[0], ended[2], span)
        renorm()
        if ended:
            ended = ended[0], low.copy(), span.copy()
        klass = _class_of(x)
        slot = model.slots.take(model.at_c + klass)
        start, wide = slot >> 20, x >= ALONE
        width = ((slot & 0xFFFFF) << 8) >> SPREAD * wide
        place = (x - ALONE & (1 << SPREAD) - 1) * wide
        r = span >> 24
        low += np.where(hit, 0, r * ((start << 8) + width * place))
        span = r * np.where(hit, 1 << 24, width)
        if ended:
            low, span = np.where(ended[0], ended[1], low), np.where(ended[0], ended[2], span)
        renorm()
        model.update(x, hit2, hit1, right1, klass)
    for _ in range(2):
        out[row, pos] = low >> WORD
        pos += 1
        low = (low & LOW) << WORD
    out = out[:, : int(pos.max()) + (int(pos.max()) & 1)]
    while (over := out >> WORD).any():  # settle the carries
        out &= LOW
        out[:, :-1] += over[:, 1:]
    pairs = (out[:, ::2] << WORD | out[:, 1::2]).astype(">u8").view(np.uint8).reshape(lanes, -1, 8)[:, :, 1:]
    data = np.ascontiguousarray(pairs).reshape(lanes, -1)
    return [data[i, : -(-int(n) // 2) * 7].tobytes() for i, n in enumerate(pos)]


def decode_blocks(blocks: list[bytes], lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    """ids (lanes, longest); the lengths differ by one at most, -1 fills."""
    lanes, length = len(blocks), int(lengths.max())
    pairs = max(len(b) for b in blocks) // 7 + 2
    data = np.zeros((lanes, pairs, 8), dtype=np.uint8)
    for i, b in enumerate(blocks):
        data[i, : len(b) // 7, 1:] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 7)
    both = data.reshape(lanes, -1).view(">u8").astype(np.int64)
    words = np.empty((lanes, 2 * pairs), dtype=np.int64)
    words[:, ::2], words[:, 1::2] = both >> WORD, both & LOW
    pos = np.full(lanes, 2, dtype=np.int64)
    code, span = words[:, 0] << WORD | words[:, 1], np.full(lanes, 1 << WINDOW, dtype=np.int64)
    model, out = Model(lanes, vocabulary), np.empty((length, lanes), dtype=np.int64)

    def renorm() -> None:
        at = np.nonzero(span <= LOW)[0]
        if len(at):
            code[at] = code[at] << WORD | words[at, np.minimum(pos[at], words.shape[1] - 1)]
            pos[at] += 1
            span[at] <<= WORD

    for t in range(length):
        c2, c1, m2, m1 = model.predict()
        r, rest = span >> 16, m2 + m1
        v = np.minimum(code // r, 65535)
        hit2 = v < m2
        hit = v < rest
        hit1 = hit & ~hit2
        code -= r * np.where(hit2, 0, np.where(hit1, m2, rest))
        span = r * np.where(hit2, m2, np.where(hit1, m1, 65536 - rest))
        renorm()
        r = span >> 24
        v = np.minimum(code // r, (1 << 24) - 1)
        klass = model.find(v >> 8)
        slot = model.slots.take(model.at_c + klass)
        start, wide = slot >> 20, klass >= ALONE
        width = ((slot & 0xFFFFF) << 8) >> SPREAD * wide
        place = np.minimum((v - (start << 8)) // width, (1 << SPREAD) - 1) * wide
        code -= np.where(hit, 0, r * ((start << 8) + width * place))
        span = r * np.where(hit, 1 << 24, width)
        renorm()
        x = np.where(hit2, c2, np.where(hit1, c1, np.where(wide, ALONE + (klass - ALONE << SPREAD) + place, klass)))
        klass = np.where(hit, _class_of(x), klass)
        model.update(x, hit2, hit1, x == c1, klass)
        out[t] = x
    found = out.T
    found[np.arange(lanes)[lengths < length], length - 1] = -1
    return found


def encode_segment(ids: np.ndarray, vocabulary: int, lanes: int = 1024, longest: int = 2048, shortest: int = 512) -> bytes:
    """Header, block table and blocks of one-dimensional ids below `vocabulary`."""
    n = len(ids)
    if n and (int(ids.min()) < 0 or int(ids.max()) >= vocabulary):
        raise ValueError("an id outside the vocabulary")
    size = min(max(n // 256, shortest), longest)
    count = -(-n // size)
    length = -(-n // count) if count else 0
    short = count * length - n  # so many blocks, the last ones, are one shorter
    at = np.concatenate([[0], np.cumsum(np.where(np.arange(count) < count - short, length, length - 1))]).astype(np.int64)
    blocks, sums = [], []
    for first in range(0, count, lanes):
        some = range(first, min(first + lanes, count))
        table = np.full((len(some), length), -1, dtype=np.int64)
        for i, b in enumerate(some):
            table[i, : at[b + 1] - at[b]] = ids[at[b] : at[b + 1]]
            sums.append(zlib.crc32(ids[at[b] : at[b + 1]].astype("<u4").tobytes()))
        blocks += encode_blocks(table, vocabulary)
    head = MAGIC + struct.pack("<BIQII", 2, vocabulary, n, count, lanes)
    return head + np.array([[len(b), s] for b, s in zip(blocks, sums, strict=True)], dtype="<u4").tobytes() + b"".join(blocks)


def decode_segment(data: bytes) -> np.ndarray:
    """The ids of a segment; ValueError if a block's checksum or length is wrong."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of coded ids")
    version, vocabulary, n, count, lanes = struct.unpack_from("<BIQII", data, 4)
    at = 4 + struct.calcsize("<BIQII")
    table = np.frombuffer(data, dtype="<u4", count=2 * count, offset=at).reshape(count, 2)
    at += 8 * count
    if version != 2 or len(data) != at + int(table[:, 0].sum()):
        raise ValueError("unknown version or cut off")
    length = -(-n // count) if count else 0
    lengths = np.where(np.arange(count) < count - (count * length - n), length, length - 1)
    starts = at + np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))])
    out = []
    for first in range(0, count, lanes):
        some = range(first, min(first + lanes, count))
        found = decode_blocks([data[starts[b] : starts[b + 1]] for b in some], lengths[first : first + lanes], vocabulary)
        for i, b in enumerate(some):
            ids = found[i, : lengths[b]].astype("<u4")
            if zlib.crc32(ids.tobytes()) != table[b, 1]:
                raise ValueError(f"block {b}: wrong checksum")
            out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, dtype="<u4")

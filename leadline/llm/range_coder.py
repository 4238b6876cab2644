"""Adaptive context-mixing range coder for token ids.

Many blocks are coded side by side, one in each lane of the arrays: step t codes the t-th id of every block. A block starts
from nothing and has its own checksum, so it can be read without the others.

Per id, order 2 (the two ids before) or else order 1 (the id before) predicts one id: what came last time in this context.
Whether it comes is coded with a probability that mixes three opinions in the logistic domain: how often predictions came
true at this length of the order-2 context's run of right guesses, the same for order 1, and the same for ids of this
frequency in order 0. An id that was not predicted is coded by order 0: shares of the block's ids so far, with an escape to 16
plain bits. Prediction contexts change with every id; shares, opinions and the weights of the mix are renewed from all ids so
far after 32, 64, 128 ... ids. All arithmetic is on integers, so any machine decodes what another has written.

The encoder knows all ids of a block, so it finds the states of all steps by sorting the block's contexts; only the coder's
own low and range go step by step. The decoder keeps the same states in small tables.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

U64 = np.uint64
BLOCK = 4096            # ids in a block
LANES = 1024            # blocks side by side
SHORT = 512             # smaller inputs are cut into blocks of this size at least
GROUP = 128             # blocks whose states the encoder finds at once
TABLE = 1 << 12         # entries of each context table
SLOT_BITS, TOTAL_BITS, CHANCE_BITS = 13, 18, 12
SLOTS, TOTAL = 1 << SLOT_BITS, 1 << TOTAL_BITS
FIRST, EVERY = 32, 1024     # when shares and opinions are renewed
LEVELS = 16
LIMIT = 1 << 16         # ids are smaller

_P = np.arange(1 << CHANCE_BITS) + 0.5
#: Logistic tables: ln(p / (1 - p)) in 1/256 units, and its inverse (for -2047 .. 2047) as parts of TOTAL.
STRETCH = np.round(256 * np.log(_P / ((1 << CHANCE_BITS) - _P))).astype(np.int32)
#: The mix of three opinions of weight 2 at most lies within REACH of zero.
REACH = 1 << 14
SQUASH = np.clip(np.round(TOTAL / (1 + np.exp(-np.clip(np.arange(-REACH, REACH + 1), -2047, 2047) / 256))), 64, TOTAL - SLOTS).astype(np.int64)

MAGIC = b"IDCM"
HEADER = struct.Struct("<4sIII")    # magic, ids, checksum of the ids, bytes of the payload


def _epochs(steps: int) -> Iterator[tuple[int, int]]:
    begin, end = 0, FIRST
    while begin < steps:
        yield begin, min(end, steps)
        begin, end = end, end + min(end, EVERY)


def _index(last: np.ndarray, older: np.ndarray | None) -> np.ndarray:
    """Entry of a context table for the ids before."""
    mixed = last.astype(np.uint32) * np.uint32(2654435761)
    if older is not None:
        mixed = (mixed ^ older.astype(np.uint32) * np.uint32(2246822519)) * np.uint32(3266489917)
    return (mixed >> np.uint32(20)).astype(np.uint16)


class _Shares:
    """Order 0: every id seen so far has at least one of SLOTS slots; the slots at the end mean an id not seen so far."""

    def __init__(self, lanes: int):
        self.lanes, self.rows = lanes, np.arange(lanes)
        self.number = np.zeros(lanes, np.int64)         # distinct ids of each lane
        self.lane = self.value = self.begin = self.end = np.zeros(0, np.int64)
        self.escape = np.zeros(lanes, np.int64)
        self.first = np.zeros(lanes, np.int64)
        self.kind = np.zeros((lanes, TABLE), np.uint8)  # 1 + log2 of the share of an id, by its low bits

    def renew(self, seen: np.ndarray) -> None:
        t = seen.shape[1]
        ordered = np.sort(seen, axis=1)
        new = np.ones(ordered.shape, bool)
        new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        flat = np.flatnonzero(new.ravel())
        self.lane = flat // t
        self.value = ordered.ravel()[flat].astype(np.int64)
        count = np.diff(np.append(flat, self.lanes * t))
        self.number = new.sum(axis=1)
        self.first = np.cumsum(self.number) - self.number
        spare = SLOTS - self.number - np.maximum(1, SLOTS * self.number // (4 * (t + self.number)))
        size = 1 + count * spare[self.lane] // t
        total = np.cumsum(size)
        self.end = total - np.concatenate([[0], total])[self.first][self.lane]
        self.begin = self.end - size
        self.escape = self.end[self.first + self.number - 1]
        self.kind[:] = 0
        self.kind[self.lane, self.value & TABLE - 1] = 1 + np.log2(size).astype(np.uint8)


class _Opinions:
    """How often predictions came true in each state, and the weights of the three opinions, for each lane."""

    SIZES = (LEVELS, 2 * LEVELS, LEVELS)

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.tried = [np.zeros(lanes * n, np.int64) for n in self.SIZES]
        self.right = [np.zeros(lanes * n, np.int64) for n in self.SIZES]
        self.weights = [np.full(lanes, 26_214, np.int64) for _ in self.SIZES]

    def renew(self) -> list[np.ndarray]:
        """The weighted opinions of every lane and state."""
        self.odds = [STRETCH[((2 * r + 1) << CHANCE_BITS) // (2 * n + 2)] for r, n in zip(self.right, self.tried, strict=True)]
        return [(o.reshape(self.lanes, -1) * w[:, None] >> 16).astype(np.int32).ravel() for o, w in zip(self.odds, self.weights, strict=True)]

    def learn(self, states: list[np.ndarray], chance: np.ndarray, hit: np.ndarray, known: np.ndarray) -> None:
        """states: flat state numbers of the steps just coded (lanes x steps), of which the known ones count."""
        known = np.ascontiguousarray(known)
        error = np.where(known, (hit.astype(np.int64) << CHANCE_BITS) - (chance >> TOTAL_BITS - CHANCE_BITS), 0)
        for k, state in enumerate(states):
            push = (error * self.odds[k][state]).sum(axis=1) >> 14
            self.weights[k] = np.clip(self.weights[k] + np.clip(push, -16_384, 16_384), 0, 131_072)
            some = state[known]
            self.tried[k] += np.bincount(some, minlength=len(self.tried[k]))
            self.right[k] += np.bincount(state[known & hit], minlength=len(self.tried[k]))


def _visits(index: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each step: the id at the last visit of its table entry, and one more than the right guesses in a row (0: no visit)."""
    lanes, steps = ids.shape
    order = (np.argsort(index, axis=1, kind="stable") + np.arange(lanes)[:, None] * steps).ravel()
    entry, value = index.ravel()[order], ids.ravel()[order]
    first = np.ones(len(order), bool)
    first[1:] = entry[1:] != entry[:-1]
    first[::steps] = True
    before = np.empty_like(value)
    before[0], before[1:] = 0, value[:-1]
    before[first] = 0
    wrong = first | (value != before)
    place = np.arange(len(order), dtype=np.int32)
    since = np.maximum.accumulate(np.where(wrong, place, 0))
    level = np.empty(len(order), np.uint8)
    level[0] = 0
    level[1:] = 1 + np.minimum(LEVELS - 2, place[:-1] - since[:-1])
    level[first] = 0
    guess, out = np.empty_like(value), np.empty_like(level)
    guess[order], out[order] = before, level
    return guess.reshape(lanes, steps), out.reshape(lanes, steps)


def _intervals(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and size (of TOTAL) of every step's part of the range, and whether the id follows in plain bits."""
    lanes, steps = ids.shape
    last, older = np.zeros_like(ids), np.zeros_like(ids)
    last[:, 1:], older[:, 2:] = ids[:, :-1], ids[:, :-2]
    guess2, level2 = _visits(_index(last, older), ids)
    guess1, level1 = _visits(_index(last, None), ids)
    guess = np.where(level2 > 0, guess2, guess1)
    known = (level2 > 0) | (level1 > 0)
    hit = known & (guess == ids)
    pair = 2 * level1 + (guess1 == guess)
    begin, size, plain = np.empty(ids.shape, np.uint32), np.empty(ids.shape, np.uint32), np.zeros(ids.shape, bool)
    shares, opinions = _Shares(lanes), _Opinions(lanes)
    rank = np.zeros((lanes, int(ids.max(initial=0)) + 1), np.uint16)
    rows = np.arange(lanes)[:, None]
    for a, b in _epochs(steps):
        if a:
            shares.renew(ids[:, :a])
            rank[shares.lane, shares.value] = np.arange(len(shares.lane)) - shares.first[shares.lane] + 1
        mix2, mix1, mix0 = opinions.renew()
        now, may, right = ids[:, a:b], known[:, a:b], hit[:, a:b]
        states = [rows * LEVELS + level2[:, a:b], rows * 2 * LEVELS + pair[:, a:b], rows * LEVELS + np.minimum(shares.kind[rows, guess[:, a:b] & TABLE - 1], LEVELS - 1)]
        chance = SQUASH[mix2[states[0]] + mix1[states[1]] + mix0[states[2]] + REACH]
        opinions.learn(states, chance, right, may)
        chance = np.where(may, chance, 0).astype(np.int64)
        place = rank[rows, now].astype(np.int64)
        if a:
            at = shares.first[:, None] + np.maximum(place, 1) - 1
            low = np.where(place > 0, shares.begin[at], shares.escape[:, None])
            high = np.where(place > 0, shares.end[at], SLOTS)
        else:
            low, high = 0, SLOTS
        rest = TOTAL - chance
        low, high = chance + (low * rest >> SLOT_BITS), chance + (high * rest >> SLOT_BITS)
        begin[:, a:b] = np.where(right, 0, low)
        size[:, a:b] = np.where(right, chance, high - low)
        plain[:, a:b] = ~right & (place == 0)
    return begin, size, plain


class _Writer:
    """A range coder in every lane: 64-bit low and range, words of 32 bits, carries added at the end."""

    def __init__(self, lanes: int, most: int):
        self.low, self.range = np.zeros(lanes, U64), np.full(lanes, ~U64(0))
        self.words, self.at = np.zeros((lanes, most), np.uint32), np.zeros(lanes, np.int64)
        self.carries: list[tuple[int, int]] = []

    def put(self, lanes, begin: np.ndarray, size: np.ndarray, bits: int) -> None:
        """lanes: a slice of all lanes, or numbers of some."""
        part = self.range[lanes] >> U64(bits)
        step = begin * part
        low = self.low[lanes] + step
        width = part * size
        over = low < step
        if over.any():
            who = np.flatnonzero(over) if isinstance(lanes, slice) else lanes[over]
            self.carries += zip(who.tolist(), self.at[who].tolist(), strict=True)
        out = np.flatnonzero(width < U64(1 << 32))
        if len(out):
            who = out if isinstance(lanes, slice) else lanes[out]
            gone = low[out]
            self.words[who, self.at[who]] = gone >> U64(32)
            self.at[who] += 1
            low[out] = gone << U64(32)
            width[out] <<= U64(32)
        self.low[lanes], self.range[lanes] = low, width

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for shift in (32, 0):
            self.words[every, self.at] = self.low >> U64(shift) & U64(0xFFFFFFFF)
            self.at += 1
        for lane, at in self.carries:
            row = self.words[lane]
            at -= 1
            while row[at] == 0xFFFFFFFF:
                row[at] = 0
                at -= 1
            row[at] += 1
        return [row[:n].astype("<u4").tobytes() for row, n in zip(self.words, self.at.tolist(), strict=True)]


class _Reader:
    """The other side: what is left of the code above low, and the range, in every lane."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        self.words, self.at = words, first + 2
        self.left = words[first].astype(U64) << U64(32) | words[first + 1]
        self.range = np.full(len(first), ~U64(0))

    def target(self, lanes, bits: int) -> np.ndarray:
        part = self.range[lanes] >> U64(bits)
        return np.minimum((self.left[lanes] // part).astype(np.int64), (1 << bits) - 1)

    def take(self, lanes, begin: np.ndarray, size: np.ndarray, bits: int) -> None:
        part = self.range[lanes] >> U64(bits)
        left = self.left[lanes] - begin.astype(U64) * part
        width = part * size.astype(U64)
        more = np.flatnonzero(width < U64(1 << 32))
        if len(more):
            who = more if isinstance(lanes, slice) else lanes[more]
            at = self.at[who]
            # a damaged block may run over its end
            left[more] = left[more] << U64(32) | self.words[np.minimum(at, len(self.words) - 1)]
            self.at[who] = at + 1
            width[more] = np.maximum(width[more] << U64(32), U64(1 << 32))
        self.left[lanes], self.range[lanes] = left, width


def _decode(lanes: int, steps: int, reader: _Reader) -> np.ndarray:
    out = np.zeros((steps, lanes), np.uint16)
    every = slice(None)
    base, rows16, rows32, slots = (np.arange(lanes) * n for n in (TABLE, LEVELS, 2 * LEVELS, SLOTS))
    # entries of the context tables: the id that came last, and the level above it
    table2, table1 = np.zeros(lanes * TABLE, np.uint32), np.zeros(lanes * TABLE, np.uint32)
    shares, opinions = _Shares(lanes), _Opinions(lanes)
    last = older = np.zeros(lanes, np.uint16)
    for a, b in _epochs(steps):
        if a:
            shares.renew(np.ascontiguousarray(out[:a].T))
            # each lane has one entry more than ids, the escape, at its begin: id, begin and end of its slots
            begin = shares.first + np.arange(lanes)
            entry = np.insert(shares.value << 32 | shares.begin << 16 | shares.end, shares.first, shares.escape << 16 | SLOTS)
            rank = np.insert(np.arange(len(shares.lane)) - shares.first[shares.lane] + 1, shares.first + shares.number, 0)
            size = np.insert(shares.end - shares.begin, shares.first + shares.number, SLOTS - shares.escape)
            owner = np.repeat(rank.astype(np.uint16), size)
        mix2, mix1, mix0 = opinions.renew()
        kind = np.minimum(shares.kind, LEVELS - 1).ravel()
        trace = [np.empty((b - a, lanes), np.int64) for _ in range(3)]
        chances, hits, mays = np.empty((b - a, lanes), np.int64), np.empty((b - a, lanes), bool), np.empty((b - a, lanes), bool)
        for t in range(a, b):
            at2, at1 = base + _index(last, older), base + _index(last, None)
            entry2, entry1 = table2[at2].astype(np.int64), table1[at1].astype(np.int64)
            guess2, guess1, level2, level1 = entry2 & 0xFFFF, entry1 & 0xFFFF, entry2 >> 16, entry1 >> 16
            guess = np.where(level2 > 0, guess2, guess1)
            known = (level2 | level1) > 0
            state2 = rows16 + level2
            state1 = rows32 + 2 * level1 + (guess1 == guess)
            state0 = rows16 + kind[base + (guess & TABLE - 1)]
            chance = SQUASH[mix2[state2] + mix1[state1] + mix0[state0] + REACH]
            k = t - a
            trace[0][k], trace[1][k], trace[2][k], chances[k], mays[k] = state2, state1, state0, chance, known
            chance = chance * known
            target = reader.target(every, TOTAL_BITS)
            hit = hits[k] = target < chance
            rest = TOTAL - chance
            if a:
                # exact in floating point: the quotient is small beside the precision, and not whole unless it is exact
                slot = (((np.maximum(target - chance, 0) + 1) * SLOTS - 1) / rest).astype(np.int64)
                place = owner[slots + slot]
                found = entry[begin + place]
                low, high = chance + ((found >> 16 & 0xFFFF) * rest >> SLOT_BITS), chance + ((found & 0xFFFF) * rest >> SLOT_BITS)
                now = np.where(hit, guess, found >> 32)
                plain = np.flatnonzero((place == 0) & ~hit)
            else:
                low, high, now = chance, TOTAL, guess.copy()
                plain = np.flatnonzero(~hit)
            reader.take(every, np.where(hit, 0, low), np.where(hit, chance, high - low), TOTAL_BITS)
            if len(plain):
                value = reader.target(plain, 16)
                reader.take(plain, value, np.ones(len(plain), np.int64), 16)
                now[plain] = value
            out[t] = now
            table2[at2] = now | 1 + (guess2 == now) * np.minimum(level2, LEVELS - 2) << 16
            table1[at1] = now | 1 + (guess1 == now) * np.minimum(level1, LEVELS - 2) << 16
            last, older = out[t], last
        opinions.learn([s.T for s in trace], chances.T, hits.T, mays.T)
    return np.ascontiguousarray(out.T)


def _block_size(n: int) -> int:
    return min(BLOCK, max(SHORT, -(-n // LANES)))


def _encode(ids: np.ndarray) -> list[bytes]:
    """Payloads of the rows."""
    lanes, steps = ids.shape
    begin, size, plain = np.empty((steps, lanes), np.uint32), np.empty((steps, lanes), np.uint32), np.empty((steps, lanes), bool)
    for g in range(0, lanes, GROUP):
        for whole, part in zip((begin, size, plain), _intervals(ids[g:g + GROUP]), strict=True):
            whole[:, g:g + GROUP] = part.T
    writer = _Writer(lanes, steps + 4 + int(plain.sum(axis=0).max(initial=0)))
    one = np.ones(lanes, U64)
    for t in range(steps):
        writer.put(slice(None), begin[t].astype(U64), size[t].astype(U64), TOTAL_BITS)
        some = np.flatnonzero(plain[t])
        if len(some):
            writer.put(some, ids[some, t].astype(U64), one[:len(some)], 16)
    return writer.finish()


def compress(ids: np.ndarray) -> bytes:
    """Blocks of the ids (below 65,536), each with its header: magic, number of ids, CRC-32 of the ids as 32-bit, payload size."""
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= LIMIT):
        raise ValueError(f"ids must be from 0 to {LIMIT - 1}")
    block, made = _block_size(len(ids)), []
    for at in range(0, len(ids), block * LANES):
        some = ids[at:at + block * LANES]
        lanes = -(-len(some) // block)
        steps = min(block, len(some))
        padded = np.zeros(lanes * steps, np.uint16)
        padded[:len(some)] = some
        for k, payload in enumerate(_encode(padded.reshape(lanes, steps))):
            own = some[k * block:(k + 1) * block]
            made.append(HEADER.pack(MAGIC, len(own), zlib.crc32(own.astype("<u4").tobytes()), len(payload)) + payload)
    return struct.pack("<II", block, len(made)) + b"".join(made)


def decompress(data: bytes) -> np.ndarray:
    """The ids of `compress`, after each block's checksum has been verified."""
    block, count = struct.unpack_from("<II", data)
    at, blocks = 8, []
    for _ in range(count):
        if at + HEADER.size > len(data):
            raise ValueError("cut off")
        magic, n, check, size = HEADER.unpack_from(data, at)
        at += HEADER.size
        if magic != MAGIC or at + size > len(data) or not 0 < n <= block or size < 8:
            raise ValueError("not a block of ids, or cut off")
        blocks.append((n, check, at, size))
        at += size
    out = []
    for k in range(0, count, LANES):
        group = blocks[k:k + LANES]
        sizes = np.array([size // 4 + 2 for *_, size in group])     # two words for those that are read ahead
        first = np.cumsum(sizes) - sizes
        words = np.zeros(int(sizes.sum()), np.uint32)
        for f, (_, _, at, size) in zip(first.tolist(), group, strict=True):
            words[f:f + size // 4] = np.frombuffer(data, "<u4", size // 4, at)
        ids = _decode(len(group), max(n for n, *_ in group), _Reader(words, first))
        for lane, (n, check, _, _) in enumerate(group):
            own = ids[lane, :n].astype("<u4")
            if zlib.crc32(own.tobytes()) != check:
                raise ValueError("a block of ids is damaged")
            out.append(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)

"""A byte automaton whose runs over pieces of a text compose.

Read from the middle, a text's bytes say little: the state there depends on all that came before. So a piece is summed up
as a function: for each state it may be entered in, the state it is left in and the units it finishes. Functions of
neighbouring pieces compose, in any grouping, to that of both; the tree of such compositions also finds the byte at which
a given unit ends, by walking down from the root.
"""

from __future__ import annotations

import functools

import numpy as np

STRIP = 128  # bytes that are stepped through one by one, all strips of a batch side by side
NO_BYTE = 256  # fills up strips; leaves state and count as they are


class Automaton:
    """States of UTF-8 decoding times states of a search for marks; a unit is a code point.

    A mark that has been seen stays seen. A byte that cannot go on a character begins a new one, and a stray one is a
    unit by itself, so that any bytes can be cut and put together again.
    """

    def __init__(self, marks: tuple[str, ...]):
        patterns = [m.encode() for m in marks]
        beginnings = [b"", *sorted({p[:k] for p in patterns for k in range(1, len(p))})]
        seen = len(beginnings)  # the number of the state after a mark

        def search(at: int, byte: int) -> int:
            if at == seen:
                return seen
            held = beginnings[at] + bytes([byte])
            if any(held.endswith(p) for p in patterns):
                return seen
            return max((b for b in range(seen) if held.endswith(beginnings[b])), key=lambda b: len(beginnings[b]))

        def decode(left: int, byte: int) -> tuple[int, int]:
            """Continuation bytes still due, and whether a unit is finished."""
            if 0x80 <= byte < 0xC0:
                return (left - 1, int(left == 1)) if left else (0, 1)
            due = (byte >= 0xC0) + (byte >= 0xE0) + (byte >= 0xF0)
            return due, int(due == 0)

        states, table = [(0, 0)], []
        for left, at in states:  # grows as new states are met
            row = []
            for byte in range(256):
                due, unit = decode(left, byte)
                to = (due, search(at, byte))
                if to not in states:
                    states.append(to)
                row.append((states.index(to), unit))
            table.append(row)
        self.size = len(states)
        self.seen = np.array([at == seen for _, at in states])
        to = np.array([[n for n, _ in row] + [i] for i, row in enumerate(table)])
        unit = np.array([[u for _, u in row] + [0] for row in table])
        self.width = NO_BYTE + 1
        #: by state * width + byte: twice the next state's offset, plus the unit
        self.steps = (to * self.width * 2 + unit).astype(np.int32).ravel()

    def strips(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of pieces, one after the other, as rows of STRIP; and how many rows each piece has, one at least."""
        rows = np.maximum(1, -(-sizes // STRIP))
        out = np.full((int(rows.sum()), STRIP), NO_BYTE, np.int16)
        begin = (np.cumsum(rows) - rows) * STRIP
        where = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(data))
        out.ravel()[where] = data
        return out, rows

    def functions(self, strips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each strip and each state it may be entered in: the state after it, and the units that it finishes."""
        state = np.tile(np.arange(self.size, dtype=np.int32) * self.width, (len(strips), 1))
        count = np.zeros(state.shape, np.int32)
        for column in np.ascontiguousarray(strips.T):
            state += column[:, None]
            step = self.steps[state]
            count += step & 1
            state = step >> 1
        return state // self.width, count


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The functions of rows of two pieces in a row. Associative."""
    end, count = first
    return np.take_along_axis(then[0], end, 1), count + np.take_along_axis(then[1], end, 1)


class Tree:
    """Compositions of the strips of each piece, level by level up to one function for each."""

    def __init__(self, automaton: Automaton, data: np.ndarray, sizes: np.ndarray):
        self.automaton = automaton
        self.bytes, rows = automaton.strips(data, sizes)
        end, count = automaton.functions(self.bytes)
        self.levels = []
        while True:
            begin = np.cumsum(rows) - rows
            self.levels.append((end, count.astype(np.int64), rows, begin))
            if rows.max(initial=1) == 1:
                break
            half = (rows + 1) // 2
            place = np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half)
            left = np.repeat(begin, half) + 2 * place
            both = np.flatnonzero(2 * place + 1 < np.repeat(rows, half))
            up_end, up_count = end[left], self.levels[-1][1][left]
            right = left[both] + 1
            up_end[both], up_count[both] = compose((up_end[both], up_count[both]), (end[right], self.levels[-1][1][right]))
            end, count, rows = up_end, up_count, half

    @property
    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """One row for each piece."""
        return self.levels[-1][:2]

    def offsets(self, piece: np.ndarray, state: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The bytes of a piece, entered in a state, up to the end of its rank-th unit (0: none). The piece has that many."""
        state, left, place = state.copy(), rank.copy(), np.zeros(len(piece), np.int64)
        for end, count, rows, begin in self.levels[-2::-1]:
            place *= 2
            node = begin[piece] + place
            beyond = (left > count[node, state]) & (place + 1 < rows[piece])
            left -= np.where(beyond, count[node, state], 0)
            state = np.where(beyond, end[node, state], state)
            place += beyond
        strip = self.bytes[self.levels[0][3][piece] + place]
        at, out = state * self.automaton.width, place * STRIP
        open_ = left > 0
        for column in strip.T:
            step = self.automaton.steps[at + column]
            left -= (step & 1) * open_
            out += open_
            open_ &= left > 0
            at = step >> 1
        return np.where(rank > 0, out, 0)


def prefixes(end: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row k: the composition of rows 0 to k, by doubling."""
    reach = 1
    while reach < len(end):
        joined = compose((end[:-reach], count[:-reach]), (end[reach:], count[reach:]))
        end, count = (np.concatenate([own[:reach], more]) for own, more in zip((end, count), joined))
        reach *= 2
    return end, count


@functools.cache
def automaton(marks: tuple[str, ...]) -> Automaton:
    """One per Python worker and set of marks."""
    return Automaton(marks)

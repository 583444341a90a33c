"""External induced suffix sorting with common-prefix values.

A text is a sequence of integers in which 0 ends a segment; prefixes never run past the end of a segment.
The suffixes at local minima (the least of a falling run) are sorted first: their substrings get names by rank,
and the string of names is sorted the same way, in memory once it is short enough. From them all other
suffixes are induced in two passes. Each pass takes tuples (first character, position, common prefix with
the tuple before) out of a priority queue in order and puts the suffixes one position further left back in;
the common prefix of two neighbours put in is one more than the least one between the two they came from.
Queues and the output of the first pass hold `room` tuples in memory and write the rest to disk.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
from pyarrow import fs

TUPLE = np.dtype([("key", "<i4"), ("at", "<i4"), ("lcp", "<i4")])  # texts of one task are shorter than 2**31


class Disk:
    """Files of tuples in a folder given by URI, removed on close."""

    def __init__(self, folder: str):
        self.system, self.folder = fs.FileSystem.from_uri(folder)
        self.made = False

    def write(self, rows: np.ndarray) -> str:
        if not self.made:
            self.system.create_dir(self.folder, recursive=True)
            self.made = True
        path = f"{self.folder}/{uuid.uuid4().hex}"
        with self.system.open_output_stream(path) as out:
            out.write(np.ascontiguousarray(rows).tobytes())
        return path

    def open(self, path: str):
        return self.system.open_input_file(path)

    def close(self) -> None:
        if self.made:
            self.system.delete_dir(self.folder)


class _Run:
    """One sorted run on disk, read a block at a time."""

    def __init__(self, disk: Disk, path: str, n: int, block: int):
        self.file, self.left, self.block = disk.open(path), n, block
        self.rows = np.empty(0, TUPLE)
        self.fill()

    def fill(self) -> None:
        n = min(self.block, self.left)
        self.left -= n
        self.rows = np.frombuffer(self.file.read(n * TUPLE.itemsize), TUPLE) if n else self.rows[:0]

    def take(self, key: int) -> list[np.ndarray]:
        """All rows with this key, which is the least one here."""
        out = []
        while len(self.rows):
            n = int(np.searchsorted(self.rows["key"], key, "right"))
            out.append(self.rows[:n])
            self.rows = self.rows[n:]
            if len(self.rows):
                break
            self.fill()
        return out


class DiskQueue:
    """Priority queue of tuples: those of the least key come out together, in the order they came in."""

    def __init__(self, disk: Disk, room: int):
        self.disk, self.room, self.held = disk, room, 0
        self.by_key: dict[int, list[np.ndarray]] = {}
        self.keys: list[int] = []
        self.runs: list[_Run] = []
        self.heads: list[tuple[int, int]] = []

    def put(self, rows: np.ndarray) -> None:
        """rows: sorted by key."""
        cuts = np.flatnonzero(rows["key"][1:] != rows["key"][:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
            key = int(rows["key"][a])
            if key not in self.by_key:
                self.by_key[key] = []
                heapq.heappush(self.keys, key)
            self.by_key[key].append(rows[a:b])
        self.held += len(rows)
        if self.held > self.room:
            self._spill()

    def _spill(self) -> None:
        rows = np.concatenate([x for key in sorted(self.by_key) for x in self.by_key[key]])
        run = _Run(self.disk, self.disk.write(rows), len(rows), max(1, self.room // 64))
        heapq.heappush(self.heads, (int(run.rows["key"][0]), len(self.runs)))
        self.runs.append(run)
        self.by_key, self.keys, self.held = {}, [], 0

    def least(self) -> int | None:
        return min([*(x[0] for x in self.heads[:1]), *self.keys[:1]], default=None)

    def take(self) -> np.ndarray:
        """All tuples of the least key that are in the queue now."""
        key, out = self.least(), []
        while self.heads and self.heads[0][0] == key:
            at = heapq.heappop(self.heads)[1]
            out += self.runs[at].take(key)
            if len(self.runs[at].rows):
                heapq.heappush(self.heads, (int(self.runs[at].rows["key"][0]), at))
            else:
                self.runs[at].file.close()
        if self.keys and self.keys[0] == key:
            heapq.heappop(self.keys)
            rows = self.by_key.pop(key)
            self.held -= sum(map(len, rows))
            out += rows
        return out[0] if len(out) == 1 else np.concatenate(out)


class Spool:
    """Batches in order, read back from the last; those beyond `room` tuples go to disk."""

    def __init__(self, disk: Disk, room: int):
        self.disk, self.room, self.held, self.batches, self.files = disk, room, 0, [], []

    def add(self, rows: np.ndarray) -> None:
        self.batches.append(rows)
        self.held += len(rows)
        if self.held > self.room:
            self.files.append((self.disk.write(np.concatenate(self.batches)), [len(x) for x in self.batches]))
            self.batches, self.held = [], 0

    def backwards(self):
        yield from reversed(self.batches)
        self.batches = []
        for path, sizes in reversed(self.files):
            with self.disk.open(path) as f:
                end = sum(sizes)
                for n in reversed(sizes):
                    f.seek((end - n) * TUPLE.itemsize)
                    yield np.frombuffer(f.read(n * TUPLE.itemsize), TUPLE)
                    end -= n


class _Since:
    """The least common prefix since a key was last put in, while the first character stays the same; after that it is 0."""

    def __init__(self):
        self.first, self.least, self.seen = None, {}, set()

    def induced(self, first: int, key: np.ndarray, at: np.ndarray, lcp: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Tuples for the suffixes one to the left of `at`, where keep holds; key: what they are ordered by. Sorted by key."""
        before = self.least if first == self.first else {}
        low = int(lcp.min())
        self.first, self.least = first, {k: min(v, low) for k, v in before.items()}
        chosen = np.flatnonzero(keep)
        new = np.empty(len(chosen), TUPLE)
        if not len(chosen):
            return new
        chosen = chosen[np.argsort(key[chosen], kind="stable")]
        new["key"], new["at"] = key[chosen], at[chosen] - 1
        starts = np.flatnonzero(np.concatenate(([True], new["key"][1:] != new["key"][:-1])))
        padded = np.append(lcp, np.iinfo(np.int32).max).astype(np.int32)
        ranges = np.empty(2 * len(chosen), np.int64)
        ranges[2::2], ranges[1::2] = chosen[:-1] + 1, chosen + 1
        ranges[2 * starts] = 0
        new["lcp"] = np.minimum.reduceat(padded, ranges)[::2] + 1
        after = np.minimum.accumulate(padded[::-1])[::-1]
        rest = after[chosen[np.append(starts[1:], len(chosen)) - 1] + 1]
        for s, k, r in zip(starts.tolist(), new["key"][starts].tolist(), rest.tolist()):
            if k not in self.seen:
                self.seen.add(k)
                new["lcp"][s] = 0
            elif k in before:
                new["lcp"][s] = min(before[k] + 1, int(new["lcp"][s]))
            else:
                new["lcp"][s] = 1
            self.least[k] = r
        return new


def _falling(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than the one to their right, and the first of each run of these: the local minima."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int32) - text[:-1]).astype(np.int8)
    at = np.where(step != 0, np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
    at = np.minimum.accumulate(at[::-1])[::-1]
    rising = np.append(step, 1)[np.append(at, n - 1)] > 0
    minima = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    return rising, minima


def _names(text: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the substrings; one that is the start of another comes after it."""
    bits = max(1, int(text.max()).bit_length() + 1)
    each = 63 // bits
    fill = (1 << bits) - 1
    rank = np.zeros(len(begins), np.int64)
    active, offset = np.arange(len(begins)), 0
    while len(active):
        key = np.zeros(len(active), np.int64)
        for k in range(offset, offset + each):
            inside = k < lengths[active]
            char = text[np.minimum(begins[active] + k, len(text) - 1)].astype(np.int64)
            key = (key << bits) | np.where(inside, char, fill)
        order = np.lexsort((key, rank[active]))
        active, key = active[order], key[order]
        old = rank[active]
        group = np.concatenate(([True], old[1:] != old[:-1]))
        new = group | np.concatenate(([True], key[1:] != key[:-1]))
        # ranks count the substrings before: a group's first one keeps the group's rank
        place = np.arange(len(active))
        base = np.maximum.accumulate(np.where(group, place, 0))
        rank[active] = old + np.maximum.accumulate(np.where(new, place, 0)) - base
        offset += each
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(active)))
        active = active[np.repeat((size > 1) & np.logical_or.reduceat(lengths[active] > offset, starts), size)]
    return np.unique(rank, return_inverse=True)[1] + 1


def sort_in_memory(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes (without the 0s) in order, and each one's common prefix with the one before, by prefix doubling.

    Suffixes that agree in `depth` characters may stay in any order.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    rank[order] = np.maximum.accumulate(np.where(np.concatenate(([True], rank[order][1:] != rank[order][:-1])), np.arange(n), 0))  # suffixes before it
    levels, reach = [rank.astype(np.int32)], 1
    while reach < depth:
        same = rank[order]
        alone = np.concatenate(([True], same[1:] != same[:-1]))
        size = np.diff(np.append(np.flatnonzero(alone), n))
        open_ = np.repeat(size > 1, size)
        if not open_.any():
            break
        active = order[open_]
        old, after = rank[active], rank[np.minimum(active + reach, n - 1)]
        by = np.argsort(old.astype(np.int64) * n + after, kind="stable")
        active, old, after = active[by], old[by], after[by]
        order[open_] = active
        group = np.concatenate(([True], old[1:] != old[:-1]))
        new = group | np.concatenate(([True], after[1:] != after[:-1]))
        place = np.arange(len(active))
        base = np.maximum.accumulate(np.where(group, place, 0))
        rank = rank.copy()
        rank[active] = old + np.maximum.accumulate(np.where(new, place, 0)) - base
        reach *= 2
        levels.append(rank.astype(np.int32))
    order = order[text[order] != 0]
    lcp = np.zeros(len(order), np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        step = np.where(levels[k][a] == levels[k][b], 1 << k, 0)
        lcp[1:] += step
        a, b = a + step, b + step
    return order, np.minimum(lcp, depth)


def _extended(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, of which `known` characters agree."""
    out = known.copy()
    active = np.flatnonzero(out < depth)
    while len(active):
        x, y = text[a[active] + out[active]], text[b[active] + out[active]]
        active = active[(x == y) & (x != 0)]
        out[active] += 1
        active = active[out[active] < depth]
    return out


def _run_length(text: np.ndarray, at: int, depth: int) -> int:
    part = text[at : at + depth]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def _sorted_minima(text, minima, depth, disk, room, in_memory):
    """The local minima (without the 0s) in the order of their suffixes, with common prefixes."""
    inner = text[minima] != 0
    follows = np.append(minima[1:], len(text) - 1)
    named = np.zeros(len(minima), np.int64)
    at = np.flatnonzero(inner)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    named[at] = _names(text, minima[at], follows[at] - minima[at] + 1)
    keep = np.ones(len(named), bool)  # segments without minima leave only their 0
    keep[1:] = (named[1:] != 0) | (named[:-1] != 0)
    keep[0] = named[0] != 0
    where = minima[keep]
    reduced = named[keep]
    names = depth // 2 + 1  # a name stands for two characters at least
    if len(reduced) <= in_memory:
        order, lcp = sort_in_memory(reduced, names)
    else:
        order, lcp = induced_sort(reduced, names, disk=disk, room=room, in_memory=in_memory)
    a, b = order[:-1], order[1:]
    at = where[order]
    known = np.minimum(where[a + lcp[1:]] - where[a], depth)
    out = np.zeros(len(order), np.int64)
    out[1:] = _extended(text, at[:-1], at[1:], known, depth)
    return at, out


def induced_sort(text: np.ndarray, depth: int, *, disk: Disk, room: int = 4 << 20, in_memory: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
    """As sort_in_memory, by induction. The text ends with 0, and no 0 follows another or comes first."""
    parts = list(from_largest(text, depth, disk=disk, room=room, in_memory=in_memory))
    at = np.concatenate([x for x, _ in parts])[::-1] if parts else np.empty(0, np.int64)
    down = np.concatenate([x for _, x in parts])[::-1] if parts else np.empty(0, np.int64)
    lcp = np.zeros(len(at), np.int64)
    lcp[1:] = down[:-1]
    return at, lcp


def from_largest(text: np.ndarray, depth: int, *, disk: Disk, room: int = 4 << 20, in_memory: int = 2 << 20):
    """Batches (positions, common prefix with the suffix before, which is larger) of all suffixes, from the largest down."""
    _, minima = _falling(text)
    stars, star_lcp = _sorted_minima(text, minima, depth, disk, room, in_memory)
    left = _left_pass(text, stars, star_lcp, depth, disk, room)
    yield from _right_pass(text, left, depth, disk, room)


def _rows(key, at, lcp) -> np.ndarray:
    rows = np.empty(len(at), TUPLE)
    rows["key"], rows["at"], rows["lcp"] = key, at, lcp
    return rows


def _left_pass(text, stars, star_lcp, depth, disk, room) -> Spool:
    queue, out, since = DiskQueue(disk, room), Spool(disk, room), _Since()
    ends = np.flatnonzero(text == 0)
    first = text[ends - 1].astype(np.int64)
    by = np.argsort(first, kind="stable")
    rows = _rows(first[by], ends[by] - 1, 1)
    fresh = np.concatenate(([True], rows["key"][1:] != rows["key"][:-1]))
    rows["lcp"][fresh] = 0
    since.seen.update(rows["key"][fresh].tolist())
    queue.put(rows)
    star_first = text[stars].astype(np.int64)
    i = 0

    def induce(c, at, lcp):
        key = text[at - 1].astype(np.int64)
        new = since.induced(c, key, at, lcp, (key >= c) & (at > 0))
        np.minimum(new["lcp"], depth, out=new["lcp"])
        if len(new):
            queue.put(new)

    while True:
        least = queue.least()
        next_star = int(star_first[i]) if i < len(stars) else None
        if least is None and next_star is None:
            return out
        c = min(x for x in (least, next_star) if x is not None)
        last = None
        while queue.least() == c:
            rows = queue.take()
            out.add(rows)
            induce(c, rows["at"], rows["lcp"])
            last = int(rows["at"][-1])
        j = int(np.searchsorted(star_first, c, "right"))
        if j > i:
            lcp = star_lcp[i:j].astype(np.int32)
            lcp[0] = 0 if last is None else min(_run_length(text, last, depth), _run_length(text, int(stars[i]), depth))
            induce(c, stars[i:j], lcp)
            i = j


def _right_pass(text, left: Spool, depth, disk, room):
    queue, since = DiskQueue(disk, room), _Since()  # keys are negative: the largest character first
    falling = left.backwards()
    held = next(falling, None)

    def induce(c, at, lcp, rises):
        key = text[at - 1].astype(np.int64)
        new = since.induced(c, -key, at, lcp, (key < c + rises) & (key > 0) & (at > 0))
        np.minimum(new["lcp"], depth, out=new["lcp"])
        if len(new):
            queue.put(new)

    while True:
        least = queue.least()
        top = int(held["key"][0]) if held is not None else None
        if least is None and top is None:
            return
        c = max(x for x in (None if least is None else -least, top) if x is not None)
        last = None
        while queue.least() == -c:
            rows = queue.take()
            induce(c, rows["at"], rows["lcp"], 1)
            last = int(rows["at"][-1])
            yield rows["at"], rows["lcp"]
        below = None  # common prefix of the batch before, in this order, with what comes next
        while held is not None and int(held["key"][0]) == c:
            at, up = held["at"][::-1], held["lcp"][::-1]
            lcp = np.empty(len(at), np.int32)
            lcp[1:] = up[:-1]
            if below is not None:
                lcp[0] = below
            else:
                lcp[0] = 0 if last is None else min(_run_length(text, last, depth), _run_length(text, int(at[0]), depth))
            below = int(up[-1])
            induce(c, at, lcp, 0)
            yield at, lcp
            held = next(falling, None)

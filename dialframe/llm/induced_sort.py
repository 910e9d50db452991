"""External induced suffix sorting of one shard, bounded to a match length.

The order of all suffixes follows from that of the few that start a rising run
after a fall (the seeds): read in order, each suffix hands its left neighbour to
a queue of that neighbour's first byte, first for falling suffixes from small to
large, then for rising ones from large to small.  Because suffixes are handed on
in rank order, a queue per byte *is* the priority queue over (byte, rank).  The
queues carry (position, common prefix with the one before) and go to disk when
they outgrow their memory; common prefixes are handed on as one more than the
least between two sources.

The seeds are sorted by prefix doubling, not by recursion: a seed's substring up
to the next seed gets a rank, and each round names pairs of the round before, until
all names differ or cover the match length; common prefixes of seeds are read from
the text.  Sorting of names goes through disk too, beyond a block.

Suffixes are ordered by their first ``length`` bytes only; equal ones keep any
order, and common prefixes are cut at ``length``.  All arrays as long as the
shard are files, so memory is bounded by :data:`BLOCK` whatever its size.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Elements that an operation holds in memory at once.
BLOCK = 1 << 21
#: Queue entries kept in memory before they go to disk.
QUEUE_ENTRIES = 1 << 21
SEPARATOR = 0xFF
_PAD = 256


class Disk:
    """Arrays as files in a folder that is removed at the end."""

    def __enter__(self) -> "Disk":
        self._folder = tempfile.TemporaryDirectory(prefix="induced-")
        self._n = 0
        return self

    def __exit__(self, *exc) -> None:
        self._folder.cleanup()

    def path(self) -> str:
        self._n += 1
        return os.path.join(self._folder.name, str(self._n))

    def array(self, n: int, dtype) -> np.ndarray:
        """A zeroed array: in memory if it is no longer than a block, else a mapped file.

        The file has no name from the start, so its space is free again as soon as the array is.
        """
        if n <= BLOCK:
            return np.zeros(n, dtype)
        path = self.path()
        mapped = np.memmap(path, dtype=dtype, mode="w+", shape=(n,))
        os.remove(path)
        return mapped


def _blocks(n: int) -> Iterator[slice]:
    for at in range(0, n, BLOCK):
        yield slice(at, min(n, at + BLOCK))


class Queues:
    """One first-in first-out queue of (position, common prefix) per byte, on disk beyond a bound."""

    def __init__(self, disk: Disk):
        self._disk, self._held = disk, 0
        self._mem: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(256)]
        self._file: list[str | None] = [None] * 256

    def push(self, byte: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self._mem[byte].append((pos.astype(np.int64), lcp.astype(np.uint8)))
        self._held += len(pos)
        if self._held > QUEUE_ENTRIES:
            self._spill()

    def _spill(self) -> None:
        for byte, parts in enumerate(self._mem):
            if parts:
                self._file[byte] = self._file[byte] or self._disk.path()
                with open(self._file[byte], "ab") as f:
                    for pos, lcp in parts:
                        row = np.empty(len(pos), _ENTRY)
                        row["pos"], row["lcp"] = pos, lcp
                        row.tofile(f)
                self._mem[byte] = []
        self._held = 0

    def take(self, byte: int, back: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Empties the queue and yields its entries in order (``back``: last blocks first, each still in order)."""
        parts, name = self._mem[byte], self._file[byte]
        self._mem[byte], self._file[byte] = [], None
        self._held -= sum(len(p) for p, _ in parts)

        def from_file():
            if name is not None:
                rows = np.memmap(name, dtype=_ENTRY, mode="r")
                cuts = list(_blocks(len(rows)))
                for s in reversed(cuts) if back else cuts:
                    yield np.array(rows["pos"][s]), np.array(rows["lcp"][s])
                del rows
                os.remove(name)

        joined, at = [], 0
        while at < len(parts):  # many small hand-overs are read as few blocks
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end][0]) <= BLOCK):
                size += len(parts[end][0])
                end += 1
            joined.append(tuple(np.concatenate(x) for x in zip(*parts[at:end])))
            at = end
        if back:
            yield from reversed(joined)
            yield from from_file()
        else:
            yield from from_file()
            yield from joined

    def holds(self, byte: int) -> bool:
        return bool(self._mem[byte]) or self._file[byte] is not None


_ENTRY = np.dtype([("pos", "<i8"), ("lcp", "u1")])


def _order(keys: np.ndarray, disk: Disk) -> np.ndarray:
    """Stable order of the keys; beyond a block they are dealt into key ranges on disk, sorted one by one."""
    n = len(keys)
    if n <= BLOCK:
        return np.argsort(keys, kind="stable")
    sample = np.sort(np.array(keys[:: max(1, n // 65536)]))
    # A value that fills several ranges is a range of its own, which needs no sort.
    pivots = np.unique(sample[:: max(1, len(sample) * BLOCK // (4 * n))])
    counts = np.zeros(2 * len(pivots) + 1, np.int64)

    def ranges(part: np.ndarray) -> np.ndarray:
        return np.searchsorted(pivots, part, "left") + np.searchsorted(pivots, part, "right")

    for s in _blocks(n):
        counts += np.bincount(ranges(keys[s]), minlength=len(counts))
    ends = np.cumsum(counts)
    at, dealt = ends - counts, disk.array(n, np.int64)
    for s in _blocks(n):
        r = ranges(keys[s])
        o = np.argsort(r, kind="stable")
        size = np.bincount(r, minlength=len(counts))
        first = np.repeat(at, size) + np.arange(len(o)) - np.repeat(np.cumsum(size) - size, size)
        dealt[first] = o + s.start
        at += size
    for r in np.flatnonzero(counts):
        if r % 2 == 0 and counts[r] > 1:  # odd ranges hold one value
            s = slice(ends[r] - counts[r], ends[r])
            idx = np.array(dealt[s])
            dealt[s] = idx[np.argsort(keys[idx], kind="stable")]
    return dealt


def _names(keys: np.ndarray, disk: Disk) -> tuple[np.ndarray, np.ndarray, int]:
    """(dense rank of each key, order, number of distinct keys)."""
    n, order = len(keys), _order(keys, disk)
    names, count, last = disk.array(n, np.int64), 0, None
    for s in _blocks(n):
        o = order[s]
        k = keys[o]
        new = np.empty(len(k), bool)
        new[0] = last is None or k[0] != last
        new[1:] = k[1:] != k[:-1]
        rank = count - 1 + np.cumsum(new)
        names[o] = rank
        count, last = int(rank[-1]) + 1, k[-1]
    return names, order, count


class InducedSort:
    """Marks the positions whose ``length`` bytes also start at another position of the shard."""

    def __init__(self, text: np.ndarray, length: int, disk: Disk):
        """``text``: the shard's bytes, segments each ended by a separator, then :data:`_PAD` zero bytes."""
        self.t, self.n, self.length, self.disk = text, len(text) - _PAD, length, disk
        self.word = np.ndarray(self.n + _PAD - 8, "<u8", buffer=text.data, strides=(1,))
        self.marked = disk.array(self.n, np.uint8)

    def seeds(self) -> np.ndarray:
        """Positions of suffixes smaller than the next one whose left neighbour is larger than them."""
        rising = self.disk.array(self.n + 1, np.uint8)  # the end counts as falling: nothing follows
        carry = False
        for s in reversed(list(_blocks(self.n))):
            here, after = self.t[s].astype(np.int16), self.t[s.start + 1:s.stop + 1].astype(np.int16)
            if s.stop == self.n:
                after[-1] = -1
            differs = here != after
            nearest = np.where(differs, np.arange(len(here)), len(here))
            nearest = np.minimum.accumulate(nearest[::-1])[::-1]
            up = np.append(here < after, carry)
            rising[s] = up[nearest]
            carry = bool(rising[s.start])
        found = [np.flatnonzero(rising[s] & (1 - np.concatenate([[1 if s.start == 0 else rising[s.start - 1]],
                                                                  rising[s.start:s.stop - 1]]))) + s.start
                 for s in _blocks(self.n)]
        out = self.disk.array(sum(map(len, found)), np.int64)
        at = 0
        for f in found:
            out[at:at + len(f)] = f
            at += len(f)
        return out

    def sorted_seeds(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Seeds ordered by their suffixes' first bytes, and the common prefix of each with the one before."""
        m, disk = len(seeds), self.disk
        if not m:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        # Level 0: names of the bytes up to the next seed, eight at a time; ended ones are the largest.
        keys = disk.array(m, np.uint64)
        sizes = disk.array(m, np.int64)
        for s in _blocks(m):
            nxt = np.append(seeds[s.start + 1:s.stop + 1], self.n - 1)[:s.stop - s.start]
            sizes[s] = np.minimum(nxt - seeds[s] + 1, self.length)
        names, order, count = None, None, 0
        for chunk in range(0, self.length, 8):
            any_open = False
            for s in _blocks(m):
                left = sizes[s] - chunk
                word = self.word[np.minimum(seeds[s] + chunk, self.n)].byteswap()
                gone = np.clip(8 - left, 0, 8).astype(np.uint64) * np.uint64(8)
                mask = np.where(gone >= 64, np.uint64(0xFFFFFFFFFFFFFFFF),
                                (np.uint64(1) << np.minimum(gone, np.uint64(63))) - np.uint64(1))
                keys[s] = word | mask
                any_open |= bool((left > 8).any())
            part, order, parts = _names(keys, disk)
            if names is not None:
                for s in _blocks(m):
                    keys[s] = names[s].astype(np.uint64) * np.uint64(parts + 1) + part[s].astype(np.uint64)
                part, order, parts = _names(keys, disk)
            names, count = part, parts
            if not any_open or count == m:
                break
        # Levels above: names of pairs, covering twice as many seeds each.
        span = 1
        while count < m and span < m:
            least = min(int((np.append(seeds[s.start + span:s.stop + span], np.full(BLOCK, 1 << 62))
                             [:s.stop - s.start] - seeds[s]).min()) for s in _blocks(m))
            if least >= self.length:
                break
            for s in _blocks(m):
                after = np.zeros(s.stop - s.start, np.uint64)
                tail = names[s.start + span:min(m, s.stop + span)]
                after[:len(tail)] = tail.astype(np.uint64) + np.uint64(1)
                keys[s] = names[s].astype(np.uint64) * np.uint64(count + 1) + after
            names, order, count = _names(keys, disk)
            span *= 2
        pos, lcp = disk.array(m, np.int64), disk.array(m, np.uint8)
        last = None
        for s in _blocks(m):
            here = seeds[order[s]]
            before = np.append(here[:1] if last is None else [last], here[:-1])
            pos[s], lcp[s] = here, self.common(before, here)
            last = here[-1]
        lcp[0] = 0
        return pos, lcp

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at a and b, cut at the length and at the end of the text."""
        out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
        for chunk in range(0, self.length, 8):
            x, y = a[open_] + chunk, b[open_] + chunk
            diff = self.word[np.minimum(x, self.n)] ^ self.word[np.minimum(y, self.n)]
            same = diff == 0
            low = diff & (~diff + np.uint64(1))
            out[open_] += np.where(same, 8, np.log2(np.where(same, 1, low).astype(np.float64)).astype(np.int64) // 8)
            open_ = open_[same & (np.maximum(x, y) + 8 < self.n)]
            if not len(open_):
                break
        return np.minimum(np.minimum(out, self.length), self.n - np.maximum(a, b)).astype(np.uint8)

    def _mark(self, pos: np.ndarray, lcp: np.ndarray, before: int | None) -> None:
        """Neighbours in the order that share ``length`` bytes."""
        same = np.flatnonzero(lcp >= self.length)
        if len(same):
            self.marked[pos[same]] = 1
            self.marked[pos[same[same > 0] - 1]] = 1
            if same[0] == 0 and before is not None:
                self.marked[before] = 1

    def _hand_on(self, queues: Queues, least: np.ndarray, pos: np.ndarray, lcp: np.ndarray, byte: int,
                 rising: bool, same_too: bool) -> None:
        """Hand each suffix's left neighbour to the queue of its byte, with the common prefix it inherits.

        ``least[c]`` is the least common prefix among the sources since the last that went to queue c,
        -1 before any did: the first of a byte shares nothing with the suffix before it.
        """
        left = np.where(pos > 0, self.t[np.maximum(pos - 1, 0)].astype(np.int16), -1)
        go = (left >= 0) & ((left < byte if rising else left > byte) | ((left == byte) & same_too))
        ell = lcp.astype(np.int16)
        targets = np.flatnonzero(go)
        overall = int(ell.min()) if len(ell) else 0
        seen = np.unique(left[targets]) if len(targets) else ()
        absent = np.ones(256, bool)
        for c in seen:
            js = targets[left[targets] == c]
            cuts = np.append(0, js + 1)
            tail = cuts[-1] < len(ell)
            low = np.minimum.reduceat(ell, cuts if tail else cuts[:-1])
            got = low[:len(js)].copy()
            got[0] = min(got[0], least[c])
            queues.push(int(c), pos[js] - 1, np.minimum(got + 1, self.length))
            least[c] = low[-1] if tail else 1 << 14
            absent[c] = False
        least[absent] = np.minimum(least[absent], overall)

    def run(self) -> np.ndarray:
        """The marks, one per position."""
        if self.n < 2:
            return self.marked
        seeds, seed_lcp = self.sorted_seeds(self.seeds())
        first = self._byte_cuts(seeds)
        falling, kept = Queues(self.disk), Queues(self.disk)
        # Falling suffixes, small to large.  The empty suffix at the end comes first of all.
        least = np.full(256, -1, np.int64)
        falling.push(int(self.t[self.n - 1]), np.array([self.n - 1]), np.array([0]))
        least[self.t[self.n - 1]] = 1 << 14
        last_falling = np.full(256, -1, np.int64)
        for byte in range(256):
            before = None
            while falling.holds(byte):  # a run of one byte hands on to its own queue
                for pos, lcp in falling.take(byte):
                    self._mark(pos, lcp, before)
                    before = int(pos[-1])
                    kept.push(byte, pos, lcp)
                    self._hand_on(falling, least, pos, lcp, byte, False, True)
            last_falling[byte] = -1 if before is None else before
            for s in _blocks(first[byte + 1] - first[byte]):
                part = slice(first[byte] + s.start, first[byte] + s.stop)
                pos, lcp = np.array(seeds[part]), np.array(seed_lcp[part])
                if s.start == 0:
                    lcp[0] = 0 if before is None else self.common(np.array([before]), pos[:1])[0]
                self._hand_on(falling, least, pos, lcp, byte, False, False)
        # Rising suffixes, large to small; the falling ones are sources again.
        rising = Queues(self.disk)
        least = np.full(256, -1, np.int64)
        for byte in range(255, -1, -1):
            before = None
            while rising.holds(byte):
                for pos, lcp in rising.take(byte):
                    self._mark(pos, lcp, before)
                    before = int(pos[-1])
                    self._hand_on(rising, least, pos, lcp, byte, True, True)
            follow = 0
            if before is not None and last_falling[byte] >= 0:
                seam = self.common(np.array([last_falling[byte]]), np.array([before]))
                self._mark(np.array([before]), seam, int(last_falling[byte]))
                follow = int(seam[0])
            for pos, lcp in kept.take(byte, back=True):
                # Read backwards, a suffix's common prefix is with the one after it.
                pos, own = pos[::-1], lcp[::-1]
                ell = np.append(np.uint8(follow), own[:-1])
                follow = int(own[-1])
                self._hand_on(rising, least, pos, ell, byte, True, False)
        return self.marked

    def _byte_cuts(self, seeds: np.ndarray) -> np.ndarray:
        """Where the seeds of each first byte begin, and the end."""
        counts = np.zeros(256, np.int64)
        for s in _blocks(len(seeds)):
            counts += np.bincount(self.t[seeds[s]], minlength=256)
        return np.append(0, np.cumsum(counts))


def repeated(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, which of its positions start ``length`` bytes that start elsewhere in the segments too.

    Matches do not cross segments; bytes of value 255 end them and so must not occur (UTF-8 has none).
    """
    total = sum(map(len, segments)) + len(segments)
    with Disk() as disk:
        text = disk.array(total + _PAD, np.uint8)
        at, starts = 0, []
        for s in segments:
            starts.append(at)
            text[at:at + len(s)] = np.frombuffer(s, np.uint8)
            text[at + len(s)] = SEPARATOR
            at += len(s) + 1
        marks = InducedSort(text, length, disk).run()
        # A window that would pass its segment's end holds a separator and does not count.
        return [np.array(marks[a:a + max(0, len(s) - length + 1)], bool) for a, s in zip(starts, segments)]

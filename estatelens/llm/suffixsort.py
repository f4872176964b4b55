"""External induced suffix sorting of one shard, with common-prefix values, on disk-backed bucket queues.

The shard is a byte file. Suffixes whose class changes from falling to rising (LMS) are sorted first: their substrings
by two induction passes, then, through their names, by recursion on the shorter string of names, until that string
fits in memory. From them an ascending pass induces the falling suffixes and a descending pass the rising ones. Each
queue entry is (position, common prefix with the entry before), and an induced entry's value is one more than the least
value of the entries passed since its bucket last got one. Queues, sorted falling suffixes, names and positions live in
files of a scratch folder once they have more than ``budget`` items, the text always.

Order and values are exact up to ``cap`` bytes, which is all that finding repeats of that length takes.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18


class BucketQueue:
    """A priority queue of int64 items whose priority is an integer key; first in, first out within a key.

    Items beyond ``budget`` are spilled to one file per spill, ordered by key.
    """

    def __init__(self, scratch: str, name: str, budget: int, largest_first: bool = False):
        self.scratch, self.name, self.budget, self.sign = scratch, name, budget, -1 if largest_first else 1
        self.heap, self.mem, self.disk, self.held, self.files = [], {}, {}, 0, []

    def push(self, keys: np.ndarray, items: np.ndarray) -> None:
        """Add items in the order given; keys are sorted already."""
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                k = int(keys[a])
                if k not in self.mem:
                    self.mem[k] = []
                    if k not in self.disk:
                        heapq.heappush(self.heap, self.sign * k)
                self.mem[k].append(items[a:b])
        self.held += len(items)
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        path = os.path.join(self.scratch, f"{self.name}-{len(self.files)}")
        at = 0
        with open(path, "wb") as f:
            for k in sorted(self.mem):
                n = 0
                for part in self.mem[k]:
                    f.write(part.tobytes())
                    n += len(part)
                self.disk.setdefault(k, []).append([len(self.files), at, n])
                at += n
        self.files.append(path)
        self.mem, self.held = {}, 0

    def first_key(self) -> int | None:
        return self.sign * self.heap[0] if self.heap else None

    def chunks(self, key: int) -> Iterator[np.ndarray]:
        """Take out all items of a key in order, also those that are pushed under it meanwhile."""
        while key in self.disk or key in self.mem:
            if key in self.disk:
                for file, at, n in self.disk.pop(key):
                    for lo in range(0, n, CHUNK):
                        yield np.fromfile(self.files[file], np.int64, min(CHUNK, n - lo), offset=8 * (at + lo))
            else:
                parts = self.mem.pop(key)
                all_ = parts[0] if len(parts) == 1 else np.concatenate(parts)
                self.held -= len(all_)
                for lo in range(0, len(all_), CHUNK):
                    yield all_[lo:lo + CHUNK]
        if self.heap and self.sign * self.heap[0] == key:
            heapq.heappop(self.heap)
        elif self.sign * key in self.heap:
            self.heap.remove(self.sign * key)
            heapq.heapify(self.heap)

    def close(self) -> None:
        for path in self.files:
            os.remove(path)
        self.files = []


class Runs:
    """Int64 items under keys that only change to larger ones; taken back from the last to the first. Beyond ``budget`` in a file."""

    def __init__(self, path: str, budget: int):
        self.path, self.budget, self.held, self.at, self.index, self.file = path, budget, 0, 0, [], None

    def append(self, key: int, items: np.ndarray) -> None:
        if not self.index or self.index[-1][0] != key:
            self.index.append((key, []))
        self.index[-1][1].append(items)
        self.held += len(items)
        if self.held > self.budget:
            self.file = self.file or open(self.path, "wb")
            for _, parts in self.index:
                for i, part in enumerate(parts):
                    if isinstance(part, np.ndarray):
                        self.file.write(part.tobytes())
                        parts[i] = (self.at, len(part))
                        self.at += len(part)
            self.file.flush()
            self.held = 0

    def last_key(self) -> int | None:
        return self.index[-1][0] if self.index else None

    def backward(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks of the last key from its end, each with the item that follows each item (the last: itself)."""
        _, parts = self.index.pop()
        after = None
        for part in reversed(parts):
            items = part if isinstance(part, np.ndarray) else np.fromfile(self.path, np.int64, part[1], offset=8 * part[0])
            yield items[::-1], np.append(items[1:], items[-1] if after is None else after)[::-1]
            after = items[0]

    def close(self) -> None:
        if self.file:
            self.file.close()
            os.remove(self.path)


def array(path: str, kind, n: int, budget: int) -> np.ndarray:
    """A zero array of n items: in memory up to ``budget`` items, else a mapped file."""
    return np.zeros(n, kind) if n <= budget else np.memmap(path, kind, "w+", shape=(n,))


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at a and at b, up to cap; text is bytes with at least cap + 8 spare bytes behind."""
    words = np.ndarray((len(text) - 7,), "<u8", buffer=text, strides=(1,))
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(0, cap, 8):
        x = words[a[live] + k] ^ words[b[live] + k]
        differs = x != 0
        low = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3
        out[live] = k + np.where(differs, low, 8)
        live = live[~differs]
        if not len(live):
            break
    return np.minimum(out, cap)


class Induction:
    """The two passes over one string. Items are position << 8 | common prefix (0 if not asked for)."""

    def __init__(self, text: np.ndarray, scratch: str, level: str, budget: int, cap: int = 0):
        self.text, self.scratch, self.level, self.budget, self.cap = text, scratch, level, budget, cap
        self.least = np.zeros(256, np.int64) if cap else None

    def _induced(self, items: np.ndarray, accept, queue: BucketQueue) -> None:
        pos = items >> 8
        before = pos - 1
        ch = np.where(before >= 0, self.text[np.maximum(before, 0)], 0).astype(np.int64)
        idx = np.flatnonzero((before >= 0) & accept(ch))
        chars = ch[idx]
        order = np.argsort(chars.astype(np.uint8) if self.cap else chars, kind="stable")
        idx, chars = idx[order], chars[order]
        if not self.cap:
            if len(idx):
                queue.push(chars, before[idx] << 8)
            return
        lcp = items & 255
        padded = np.append(lcp, 255)
        tail = np.minimum.accumulate(padded[::-1])[::-1]
        if len(idx):
            starts = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
            lo = np.r_[0, idx[:-1] + 1]
            lo[starts] = 0
            spans = np.empty(2 * len(idx), np.int64)
            spans[0::2], spans[1::2] = lo, idx + 1
            low = np.minimum.reduceat(padded, spans)[::2]
            low[starts] = np.minimum(low[starts], self.least[chars[starts]])
            self.least = np.minimum(self.least, tail[0])
            self.least[chars[starts]] = tail[idx[np.r_[starts[1:], len(idx)] - 1] + 1]
            queue.push(chars, (before[idx] << 8) | np.minimum(low + 1, self.cap))
        else:
            self.least = np.minimum(self.least, tail[0])

    def _seam(self, a: int, b: int) -> int:
        return int(common_prefix(self.text, np.array([a]), np.array([b]), self.cap)[0]) if self.cap else 0

    def descending(self, seeds: BucketQueue) -> Iterator[tuple[np.ndarray, bool]]:
        """(chunk of items, whether they are rising) of all suffixes but the last one, from the largest down.

        seeds: the LMS suffixes under their first characters. An item's value is its common prefix with the item before.
        """
        falling = BucketQueue(self.scratch, f"{self.level}-l", self.budget)
        sorted_l = Runs(os.path.join(self.scratch, f"{self.level}-runs"), self.budget)
        if self.cap:
            self.least[:] = 0
        while (c := min((k for k in (falling.first_key(), seeds.first_key()) if k is not None), default=None)) is not None:
            last = None
            for chunk in falling.chunks(c):
                if last is None:
                    chunk = chunk.copy()
                    chunk[0] &= ~255
                last = int(chunk[-1] >> 8)
                sorted_l.append(c, chunk)
                self._induced(chunk, lambda ch: ch >= c, falling)
            first = True
            for chunk in seeds.chunks(c):
                if first:
                    chunk = chunk.copy()
                    chunk[0] = chunk[0] & ~255 | (self._seam(last, int(chunk[0] >> 8)) if last is not None else 0)
                    first = False
                self._induced(chunk, lambda ch: ch > c, falling)
        falling.close()
        rising = BucketQueue(self.scratch, f"{self.level}-s", self.budget, largest_first=True)
        if self.cap:
            self.least[:] = 0
        while (c := max((k for k in (rising.first_key(), sorted_l.last_key()) if k is not None), default=None)) is not None:
            last = None
            for chunk in rising.chunks(c):
                if last is None:
                    chunk = chunk.copy()
                    chunk[0] &= ~255
                last = int(chunk[-1] >> 8)
                yield chunk, True
                self._induced(chunk, lambda ch: ch <= c, rising)
            if sorted_l.last_key() == c:
                first = True
                for items, after in sorted_l.backward():
                    items = items & ~255 | (after & 255)
                    if first:
                        items[0] = items[0] & ~255 | (self._seam(last, int(items[0] >> 8)) if last is not None else 0)
                        first = False
                    yield items, False
                    self._induced(items, lambda ch: ch < c, rising)
        rising.close()
        sorted_l.close()


def lms_positions(text: np.ndarray) -> Iterator[np.ndarray]:
    """Ascending chunks of the LMS positions of a string that ends in a unique smallest character."""
    found, hi = [] if len(text) > 1 else [np.zeros(1, np.int64)], len(text) - 1
    rising = True  # class of the suffix at hi
    step = 1 << 20
    while hi > 0:
        lo = max(0, hi - step)
        t = np.asarray(text[lo:hi + 1]).astype(np.int64)
        differ = np.flatnonzero(t[:-1] != t[1:])
        up = t[:-1] < t[1:]
        nxt = np.searchsorted(differ, np.arange(hi - lo))
        cls = np.where(nxt < len(differ), up[differ[np.minimum(nxt, len(differ) - 1)]] if len(differ) else False, rising)
        cls = np.append(cls, rising)  # classes of lo..hi
        found.append(lo + 1 + np.flatnonzero(cls[1:] & ~cls[:-1]))
        rising, hi = bool(cls[0]), lo
    whole = np.concatenate(found[::-1])
    yield from (whole[i:i + CHUNK] for i in range(0, len(whole), CHUNK))


def _same_substring(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether text[a:a+length] is text[b:b+length], row by row."""
    same, live, k = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(live):
        live = live[length[live] > k]
        ok = text[a[live] + k] == text[b[live] + k]
        same[live[~ok]] = False
        live, k = live[ok], k + 1
    return same


def _by_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by their first ``depth`` names (ties in any order)."""
    rank, step = names.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        follow = np.zeros(len(rank), np.int64)
        follow[:-step or None] = rank[step:] + 1 if step < len(rank) else 0
        key = rank * (int(rank.max()) + 2) + follow
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.cumsum(np.r_[0, k[1:] != k[:-1]])
        rank = np.empty_like(rank)
        rank[order] = new
        if new[-1] == len(rank) - 1:
            break
        step *= 2
    return order


def sorted_lms(text: np.ndarray, scratch: str, level: str, budget: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(LMS positions ascending, their order as suffixes), both files mapped to memory. The order is exact to depth characters."""
    seeds = BucketQueue(scratch, f"{level}-seed", budget)
    kind = np.int32 if len(text) < 1 << 31 else np.int64
    n = sum(map(len, lms_positions(text)))
    lms = array(os.path.join(scratch, f"{level}-lms"), kind, n, budget)
    slot = array(os.path.join(scratch, f"{level}-slot"), kind, len(text) // 2 + 1, budget)
    lo = 0
    for chunk in lms_positions(text):
        lms[lo:lo + len(chunk)] = chunk
        slot[chunk >> 1] = np.arange(lo, lo + len(chunk))  # LMS positions are two or more apart
        lo += len(chunk)
        keys = np.asarray(text[chunk]).astype(np.int64)
        o = np.argsort(keys, kind="stable")
        seeds.push(keys[o], chunk[o].astype(np.int64) << 8)
    names = array(os.path.join(scratch, f"{level}-names"), kind, n, budget)
    name, last = 0, None  # names count down from the largest substring
    for items, is_rising in Induction(text, scratch, f"{level}-sub", budget).descending(seeds):
        if not is_rising:
            continue
        pos = items >> 8
        pos = pos[(pos > 0) & (text[np.maximum(pos - 1, 0)] > text[pos])]
        if not len(pos):
            continue
        at = slot[pos >> 1]
        length = lms[np.minimum(at + 1, n - 1)].astype(np.int64) - pos + 1
        prev = np.r_[last if last is not None else pos[0], pos[:-1]]
        p_at = slot[prev >> 1]
        p_length = lms[np.minimum(p_at + 1, n - 1)].astype(np.int64) - prev + 1
        equal = p_length == length
        sel = np.flatnonzero(equal)
        equal[sel] = _same_substring(text, prev[sel], pos[sel], length[sel])
        if last is None:
            equal[0] = True
        names[at] = name - np.cumsum(~equal)
        name -= int(np.count_nonzero(~equal))
        last = int(pos[-1])
    seeds.close()
    if isinstance(slot, np.memmap):
        os.remove(slot.filename)
    names[n - 1] = name - 1  # the end of the text
    names -= name - 1
    if -name + 2 >= n:  # all names differ
        order = np.empty(n, np.int64)
        order[np.asarray(names)] = np.arange(n)
    elif n <= budget:
        order = _by_doubling(np.asarray(names), depth)
    else:  # names end in the unique smallest one, 0: the same again on the string of names
        order = array(os.path.join(scratch, f"{level}-order"), kind, n, budget)
        inner, inner_order = sorted_lms(names, scratch, f"{level}n", budget, depth)
        again = BucketQueue(scratch, f"{level}-again", budget)
        for lo in range(0, len(inner), CHUNK):
            p = np.asarray(inner[inner_order[lo:lo + CHUNK]])
            p = p.astype(np.int64)
            again.push(np.asarray(names[p]).astype(np.int64), p << 8)
        hi = n
        for items, _ in Induction(names, scratch, f"{level}-full", budget).descending(again):
            order[hi - len(items):hi] = (items >> 8)[::-1]
            hi -= len(items)
        order[0] = n - 1
        again.close()
    return lms, order


def sorted_suffixes(text: np.ndarray, scratch: str, cap: int, budget: int = 1 << 22) -> Iterator[np.ndarray]:
    """Chunks of items (position << 8 | common prefix with the item before, at most cap) from the largest suffix down.

    text: bytes that end in one 0, the only one, followed by cap + 8 spare zero bytes; cap is below 256.
    """
    body = text[:len(text) - cap - 8]
    lms, order = sorted_lms(body, scratch, "0", budget, depth=cap // 2 + 2)
    seeds = BucketQueue(scratch, "0-lms-sorted", budget)
    last = None
    for lo in range(0, len(order), CHUNK):
        p = np.asarray(lms[order[lo:lo + CHUNK]]).astype(np.int64)
        prev = np.r_[p[0] if last is None else last, p[:-1]]
        seeds.push(np.asarray(text[p]).astype(np.int64), (p << 8) | common_prefix(text, prev, p, cap))
        last = p[-1]
    induction = Induction(text, scratch, "0-full", budget, cap)
    for items, _ in induction.descending(seeds):
        yield items
    seeds.close()


def repeats(text: np.ndarray, scratch: str, length: int, budget: int = 1 << 22) -> np.ndarray:
    """A byte per position: 1 where the string of ``length`` bytes there also starts earlier in the text. A mapped file."""
    flag = array(os.path.join(scratch, "flag"), np.uint8, len(text), 8 * budget)
    least = many = None  # of the group that the last chunk ended in
    for items in sorted_suffixes(text, scratch, length, budget):
        pos, new = items >> 8, (items & 255) < length
        starts = np.flatnonzero(new)
        if least is not None and (not len(starts) or starts[0] > 0):  # the group goes on
            head = pos[:starts[0]] if len(starts) else pos
            flag[head], flag[least] = 1, 1
            least, many = min(least, int(head.min())), True
            flag[least] = 0 if len(starts) else 1
        elif least is not None and many:
            flag[least] = 0
        if len(starts):
            if least is not None and many:
                flag[least] = 0
            group_least = np.minimum.reduceat(pos, starts)
            sizes = np.diff(np.r_[starts, len(pos)])
            body = pos[starts[0]:]
            flag[body[np.repeat(sizes > 1, sizes)]] = 1
            flag[group_least[:-1]] = 0
            least, many = int(group_least[-1]), bool(sizes[-1] > 1)
    if least is not None:
        flag[least] = 0
    return flag

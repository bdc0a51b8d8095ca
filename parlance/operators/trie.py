"""A prefix trie of dictionary entries that finds the entry most similar to a word.

Entries that begin alike share the alignment of what they have in common.  Nodes wait in the order of the best ratio that any entry
below them could still reach; when the best finished entry reaches that, no other node is opened.
"""

from __future__ import annotations

import heapq


def letter_masks(word: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(word):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    return masks


def ratio_of(shared: int, total: int) -> int:
    """0 to 100: twice the shared letters over the summed lengths, half rounded up."""
    return (400 * shared + total) // (2 * total) if total else 100


class Trie:
    """Entries with a position each; parts without a branch are one node, so there are fewer than two nodes per entry."""

    def __init__(self, entries: list[tuple[str, int]]):
        self.label, self.kids, self.end, self.depth = [""], [[]], [None], [0]
        open_ = [0]  # nodes from the root to the last entry
        for text, position in sorted(entries):
            if self.depth[open_[-1]] == len(text) and self.end[open_[-1]] is not None and self._text(open_) == text:
                continue  # the same entry again, at a higher position
            shared = self._common(open_, text)
            while self.depth[open_[-1]] - len(self.label[open_[-1]]) >= shared and len(open_) > 1:
                open_.pop()
            node = open_[-1]
            if self.depth[node] > shared:  # the last entry's node is cut where the texts part
                keep = shared - (self.depth[node] - len(self.label[node]))
                low = self._new(self.label[node][keep:], self.depth[node])
                self.kids[low], self.end[low] = self.kids[node], self.end[node]
                self.label[node], self.depth[node], self.kids[node], self.end[node] = self.label[node][:keep], shared, [low], None
            if len(text) > shared:
                new = self._new(text[shared:], len(text))
                self.kids[node].append(new)
                open_.append(new)
                node = new
            self.end[node] = position if self.end[node] is None else min(self.end[node], position)
        self.low, self.high, self.first = ([0] * len(self.label) for _ in range(3))
        for node in sorted(range(len(self.label)), key=lambda n: -self.depth[n]):
            below = [(self.low[k], self.high[k], self.first[k]) for k in self.kids[node]]
            if self.end[node] is not None:
                below.append((self.depth[node], self.depth[node], self.end[node]))
            if below:
                self.low[node], self.high[node], self.first[node] = (f(b[i] for b in below) for i, f in enumerate((min, max, min)))
        self.empty = not entries

    def _new(self, label: str, depth: int) -> int:
        self.label.append(label)
        self.kids.append([])
        self.end.append(None)
        self.depth.append(depth)
        return len(self.label) - 1

    def _text(self, path: list[int]) -> str:
        return "".join(self.label[n] for n in path)

    def _common(self, path: list[int], text: str) -> int:
        last, n = self._text(path), 0
        for a, b in zip(last, text):
            if a != b:
                break
            n += 1
        return n

    def best(self, word: str, threshold: int) -> tuple[int, int, int] | None:
        """(ratio, position, nodes opened) of the highest ratio above the threshold and its lowest position."""
        if self.empty:
            return None
        masks, size = letter_masks(word), len(word)
        full = (1 << size) - 1
        found, opened, least = None, 0, threshold + 1
        waiting = [(-100, 0, 0, full)]  # of equal bounds the deepest is opened first, so that an entry is finished soon
        while waiting:
            bound, _, node, row = heapq.heappop(waiting)
            if -bound < least:
                break
            if found and -bound == least and self.first[node] > found[1]:
                continue
            opened += 1
            for ch in self.label[node]:
                hit = row & masks.get(ch, 0)
                row = ((row + hit) | (row - hit)) & full
            shared, depth = size - row.bit_count(), self.depth[node]
            if self.end[node] is not None:
                ratio = ratio_of(shared, size + depth)
                if ratio > threshold and (not found or (ratio, -self.end[node]) > (found[0], -found[1])):
                    found, least = (ratio, self.end[node]), ratio
            for kid in self.kids[node]:
                # First as if all that is left could match, which is quick to say; then by what lies where.
                length = min(max(size - shared + depth, self.low[kid]), self.high[kid])
                if ratio_of(min(shared + length - depth, size), size + length) < least:
                    continue
                reach = self._reach(size, row, depth, self.low[kid], self.high[kid])
                if reach >= least:
                    heapq.heappush(waiting, (-reach, -depth, kid, row))
        return None if found is None else (*found, opened)

    @staticmethod
    def _reach(size: int, row: int, depth: int, low: int, high: int) -> int:
        """No entry of ``low`` to ``high`` letters that begins with the first ``depth`` aligned ones has a higher ratio.

        ``rest`` letters can match the last ``rest`` letters of the word at most; before those, only what is aligned already counts.
        """
        best = 0
        for length in range(low, high + 1):
            rest = length - depth
            if rest >= size:  # all letters of the word could match; longer entries reach less
                return max(best, ratio_of(size, size + length))
            before = size - rest
            aligned = before - (row & ((1 << before) - 1)).bit_count()
            best = max(best, ratio_of(aligned + rest, size + length))
        return best

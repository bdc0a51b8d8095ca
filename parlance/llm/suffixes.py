"""Repeated passages found with the difference-cover suffix order.

Steps, each a Spark job over the whole table whose result is a table in shared storage:

1. Exact copies are folded: of equal texts only the one with the smallest id goes on.
2. Every 50-byte string has an anchor, its 16-gram with the smallest hash.  Equal strings have equal anchors, so a
   string can only repeat if its anchors occur in several documents.  Parts send each of their anchor hashes once to
   the bucket of the hash and get those back that are not alone.  This loses no repeat.
3. What is left of the texts, the surroundings of anchors (at most 84 bytes), is folded within each part and dealt to
   buckets by anchor.  Anchors with very many surroundings are dealt string by string instead.
4. Each bucket sorts its suffixes with the difference cover modulo 3: sampled triples are sorted and named, the string
   of names is sorted the same way, the remaining suffixes are merged in.  Strings whose 50 bytes equal
   those of their neighbour in that order are one class; its smallest id is compared with each member's.
5. The marks return to the parts, which cut the covered bytes out.

Texts stay in a table that is bucketed by part, so they are shuffled once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import discard, pieces, query, release, remove, stored, table
from parlance.session import run_dir

WIDTH = 50
GRAM = 16
WINDOW = WIDTH - GRAM + 1
TILE = 1 << 15
PART_BYTES = 2 << 20
HOT_ANCHOR = 20_000
SORT_SYMBOLS = 1 << 20
LAST = (1 << 63) - 1

_U = np.uint64


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes that begin at each position, from hashes of 1, 2, 4 and 8 bytes."""
    h = data.astype(_U)
    h += _U(1)
    h *= _U(0xD6E8FEB86659FD93)
    for width in (1, 2, 4, 8):
        x = h[:-width] * _U(0x9E3779B97F4A7C15)
        x += h[width:]
        x ^= x >> _U(29)
        x *= _U(0xBF58476D1CE4E5B9)
        h = x
    h ^= h >> _U(32)
    return h


class Strings:
    """The 50-byte strings of the texts of a part, with their anchors."""

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        n = len(self.data)
        self.grams = np.empty(max(n - GRAM + 1, 0), _U)
        anchors = np.empty(max(n - WIDTH + 1, 0), np.int64)
        places = np.arange(TILE + WIDTH, dtype=_U)
        for at in range(0, n - WIDTH + 1, TILE):
            piece = self.data[at:at + TILE + WIDTH - 1]
            h = gram_hashes(piece)
            self.grams[at:at + len(h)] = h
            # The position in the low bits breaks ties to the left and comes out with the minimum.
            low = h & ~_U(2 * TILE - 1)
            low |= places[:len(h)]
            for step in (1, 2, 4, 8, 16, 3):
                low = np.minimum(low[:-step], low[step:])
            low &= _U(2 * TILE - 1)
            anchors[at:at + len(low)] = low
            anchors[at:at + len(low)] += at
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        inside = np.zeros(n + 1, np.int8)  # where strings begin
        long_enough = lengths >= WIDTH
        inside[self.starts[long_enough]] = 1
        inside[self.ends[long_enough] - WIDTH + 1] -= 1
        self.valid = np.flatnonzero(np.cumsum(inside[:len(anchors)], dtype=np.int8))
        self.anchor = anchors[self.valid]
        fresh = np.ones(len(self.anchor), bool)
        np.not_equal(self.anchor[1:], self.anchor[:-1], out=fresh[1:])
        self.positions = self.anchor[fresh]  # of the anchors, in order
        self.place = np.cumsum(fresh) - 1  # of each string's anchor among them

    def anchor_counts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different anchor hashes in order; twice how often each occurs, plus 1 if in several documents."""
        h, own = self.grams[self.positions], ids[self.doc[self.positions]]
        order = np.argsort(h, kind="stable")
        h, own = h[order], own[order]
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([heads, [len(h)]]))
        several = np.minimum.reduceat(own, heads) < np.maximum.reduceat(own, heads) if len(h) else count > 0
        return h[heads], 2 * np.minimum(count, 32_000) + several

    def runs(self, repeated: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first string, number of strings, bucket hash) for runs of strings with the same repeated anchor."""
        h = self.grams[self.positions]
        fine = np.flatnonzero(_among(h, repeated)[self.place])
        first, anchor = self.valid[fine], self.anchor[fine]
        whole = ~_among(h, hot)[self.place[fine]]
        if not len(first):
            return first, first, np.zeros(0, _U)
        begins = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)]) | ~whole
        at = np.flatnonzero(begins)
        count = np.diff(np.concatenate([at, [len(first)]]))
        lo = first[at]
        return lo, count, np.where(whole[at], self.grams[anchor[at]], self.spread(lo, np.full(len(lo), WIDTH)))

    def spread(self, lo: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hash of the bytes from ``lo``; 16-grams that overlap cover lengths from 50 to 84 completely."""
        out = length.astype(_U)
        for offset in (0, 16, 32, 48, 64):
            out = (out ^ self.grams[lo + np.minimum(offset, length - GRAM)]) * _U(0xC2B2AE3D27D4EB4F)
            out ^= out >> _U(31)
        return (out ^ self.grams[lo + length - GRAM]) * _U(0x165667B19E3779F9)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Names from 1 in the order of triples; equal triples have equal names."""
    top = int(max(x.max(initial=0) for x in (a, b, c))) + 1
    if top <= 128:  # a table of all triples is smaller than a sort
        key = (a * top + b) * top + c
        seen = np.zeros(top**3, bool)
        seen[key] = True
        return np.cumsum(seen)[key]
    if top < 1 << 21:
        return _ordinal((a << 42) | (b << 21) | c)
    return _ordinal(_ordinal(a * top + b) * top + c)


def _ordinal(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    ordered = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else ordered
    return out


def suffix_places(text: np.ndarray) -> np.ndarray:
    """Places (from 0) of all suffixes of an array of positive integers, by the difference cover modulo 3.

    Suffixes at positions 1 and 2 modulo 3 are the sample.  Their triples are sorted and named; if names repeat, the
    string of the names is sorted in the same way.  The remaining suffixes are one symbol and a sampled suffix each, so
    one sort orders them, and two searches merge them in.
    """
    n = len(text)
    t = np.concatenate([text, np.zeros(3, np.int64)])
    zero, one, two = (np.arange(k, n, 3) for k in range(3))
    sample = np.concatenate([one, two])
    m = len(sample)
    names = _names(t[sample], t[sample + 1], t[sample + 2])
    if m and names.max() < m:
        # The names of positions 1 mod 3, a separator below all of them, and the names of positions 2 mod 3.
        below = suffix_places(np.concatenate([names[:len(one)], [0], names[len(one):]]) + 1)
        gap = below[len(one)]
        names = np.concatenate([below[:len(one)], below[len(one) + 1:]])
        names = names + (names < gap)  # places from 1 without the separator's
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    ordered = np.empty(m, np.int64)
    ordered[names - 1] = sample
    by_one = t[zero] * (m + 1) + rank[zero + 1]
    order = np.argsort(by_one)
    rest, by_one = zero[order], by_one[order]
    # A suffix at 1 mod 3 is compared by one symbol and a sampled suffix, one at 2 mod 3 by two symbols and one.
    is_one = ordered % 3 == 1
    smaller = np.empty(m, np.int64)
    first, second = ordered[is_one], ordered[~is_one]
    smaller[is_one] = np.searchsorted(by_one, t[first] * (m + 1) + rank[first + 1])
    both = np.concatenate([rest, second])
    pair = t[both] * (int(t.max(initial=0)) + 1) + t[both + 1]
    if int(pair.max(initial=0)) >= (1 << 62) // (m + 1):
        pair = _ordinal(pair)
    by_two = pair * (m + 1) + rank[both + 2]
    smaller[~is_one] = np.searchsorted(by_two[:len(rest)], by_two[len(rest):])
    place = np.empty(n, np.int64)
    taken = np.arange(m) + smaller
    place[ordered] = taken
    free = np.ones(n, bool)
    free[taken] = False
    place[rest] = np.flatnonzero(free)
    return place


def earlier_strings(records: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For records (rows of bytes, padded) a bit mask each: which of their strings also lie in a record of a smaller id."""
    n, width = records.shape
    inside = np.arange(width)[None, :] < lengths[:, None]
    used = np.zeros(256, np.int64)
    used[records[inside]] = 1
    symbol = np.cumsum(used) + 1  # 1 parts the records
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    text = np.ones(int(ends[-1]), np.int64)
    body = np.ones(len(text), bool)
    body[ends - 1] = False
    text[body] = symbol[records[inside]]
    raw = np.zeros(len(text) + 8, np.uint8)
    raw[:len(text)][body] = records[inside]
    place = suffix_places(text)
    count = lengths - WIDTH + 1
    record = np.repeat(np.arange(n), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    string = np.full(len(text), -1, np.int64)
    string[place[starts[record] + offset]] = np.arange(len(record))  # in suffix order
    string = string[string >= 0]
    record, offset = record[string], offset[string]
    begin = starts[record] + offset
    # Neighbours in suffix order are one class if their first 50 bytes agree.
    eight = np.ndarray(len(text), "<u8", raw, 0, (1,))
    same = np.arange(1, len(begin))
    for k in (0, 8, 16, 24, 32, 40, WIDTH - 8):
        same = same[eight[begin[same] + k] == eight[begin[same - 1] + k]]
    fresh = np.ones(len(begin), bool)
    fresh[same] = False
    heads = np.flatnonzero(fresh)
    lowest = np.minimum.reduceat(ids[record], heads)
    earlier = lowest[np.cumsum(fresh) - 1] < ids[record]
    masks = np.zeros(n, np.int64)
    np.bitwise_or.at(masks, record[earlier], np.int64(1) << offset[earlier])
    return masks


def _raw(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values.astype(kind)).tobytes()


def _texts(rows: pa.Table) -> tuple[np.ndarray, list[bytes], pa.Table]:
    rows = rows.sort_by([("id", "ascending"), ("hash", "ascending")])
    return rows["id"].to_numpy(), [t.encode("utf-8") for t in rows["text"].to_pylist()], rows


def _by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order that sorts by bucket, then hash; and (bucket, from, to) for every bucket."""
    bucket = ((hashes >> _U(20)) % _U(buckets)).astype(np.int64)
    order = np.lexsort((hashes, bucket))
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    return order, [(int(bucket[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]


ANCHORS = "bucket long, part long, hashes binary, counts binary"


def _send_anchors(buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, texts, _ = _texts(rows)
        hashes, counts = Strings(texts).anchor_counts(ids)
        order, cuts = _by_bucket(hashes, buckets)
        hashes, counts = hashes[order], counts[order]
        return pa.table({
            "bucket": pa.array([c[0] for c in cuts], pa.int64()), "part": pa.array([key[0].as_py()] * len(cuts), pa.int64()),
            "hashes": pa.array([_raw(hashes[a:b], "<u8") for _, a, b in cuts], pa.binary()),
            "counts": pa.array([_raw(counts[a:b], "<u2") for _, a, b in cuts], pa.binary())})

    return run


REPLIES = "part long, hashes binary, hot binary"


def _repeated_anchors(key: tuple, rows: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, "<u8") for x in rows["hashes"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, "<u2") for x in rows["counts"].to_pylist()]).astype(np.int64)
    hashes, name = np.unique(np.concatenate(parts), return_inverse=True)
    again = (np.bincount(name) > 1) | (np.bincount(name, weights=counts & 1) > 0)
    hot, at, out = np.bincount(name, weights=counts >> 1) > HOT_ANCHOR, 0, []
    for part, own in zip(rows["part"].to_pylist(), parts):
        names = name[at:at + len(own)]
        at += len(own)
        if (found := again[names]).any():
            out.append((part, own[found].tobytes(), _raw(own[hot[names]], "<u8")))
    return pa.table({"part": pa.array([o[0] for o in out], pa.int64()), "hashes": pa.array([o[1] for o in out], pa.binary()),
                     "hot": pa.array([o[2] for o in out], pa.binary())})


# kind 0: records for a bucket; 1: marks found inside the part; 2: places of the records in the part
RECORDS = "kind int, bucket long, part long, n binary, ids binary, keys binary, body binary"


def _gather(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    blobs = [b for b in column.to_pylist() if b]
    return np.frombuffer(b"".join(blobs), kind)


def _send_records(buckets: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in RECORDS.split(", ")}

        def add(**values: object) -> None:
            for name, cells in out.items():
                cells.append(values.get(name))

        repeated, hot = np.sort(_gather(replies["hashes"], "<u8")), np.sort(_gather(replies["hot"], "<u8"))
        part = key[0].as_py()
        if rows.num_rows and len(repeated):
            ids, texts, _ = _texts(rows)
            strings = Strings(texts)
            lo, count, where = strings.runs(repeated, hot)
            length = count + WIDTH - 1
            if len(lo):
                _fold(part, strings, ids, lo, length, where, buckets, add)
        kinds = {"kind": pa.int32(), "bucket": pa.int64(), "part": pa.int64()}
        return pa.table({n: pa.array(c, kinds.get(n, pa.binary())) for n, c in out.items()})

    return run


def _fold(part: int, strings: Strings, ids: np.ndarray, lo: np.ndarray, length: np.ndarray, where: np.ndarray, buckets: int,
          add: Callable[..., None]) -> None:
    """Sends different surroundings once, for the smallest id of the part; larger ids are marked here and now."""
    look = strings.spread(lo, length)
    own = ids[strings.doc[lo]]
    order = np.lexsort((lo, own, length, look))
    lo, length, where, look, own = lo[order], length[order], where[order], look[order], own[order]
    same = np.concatenate([[False], (look[1:] == look[:-1]) & (length[1:] == length[:-1])])
    for k in np.flatnonzero(same):  # equal hashes are compared byte by byte
        if strings.data[lo[k]:lo[k] + length[k]].tobytes() != strings.data[lo[k - 1]:lo[k - 1] + length[k - 1]].tobytes():
            same[k] = False
    group = np.cumsum(~same) - 1
    heads = np.flatnonzero(~same)
    lowest = own[heads]
    later = own > lowest[group]
    every = (np.int64(1) << (length - WIDTH + 1)) - 1
    if later.any():
        add(kind=1, part=part, n=_raw(lo[later], "<u4"), keys=_raw(every[later], "<i8"))
    add(kind=2, part=part, n=_raw(lo[~later], "<u4"), keys=_raw(group[~later], "<u4"))
    sent, cuts = _by_bucket(where[heads], buckets)
    heads = heads[sent]
    for bucket, a, b in cuts:
        take = heads[a:b]
        body = b"".join(strings.data[lo[k]:lo[k] + length[k]].tobytes() for k in take)
        add(kind=0, bucket=bucket, part=part, n=_raw(length[take], "u1"), ids=_raw(own[take], "<i8") + _raw(where[take], "<u8"),
            keys=_raw(group[take], "<u4"), body=body)


MARKS = "part long, records binary, masks binary"


def _padded(body: np.ndarray, length: np.ndarray) -> np.ndarray:
    rows = np.zeros((len(length), WIDTH + WINDOW - 1), np.uint8)
    rows[np.arange(rows.shape[1])[None, :] < length[:, None]] = body
    return rows


def _fold_records(rows: np.ndarray, length: np.ndarray, where: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each record the name of its bytes; for each name the smallest id and a record."""
    powers = np.cumprod(np.full(rows.shape[1], _U(0x9E3779B97F4A7C15)))
    look = np.zeros(len(rows), _U)
    for k in range(rows.shape[1]):
        look += rows[:, k] * powers[k]
    order = np.lexsort((length, look, where))
    fresh = np.concatenate([[True], (look[order][1:] != look[order][:-1]) | (where[order][1:] != where[order][:-1])])
    fresh[1:] |= (rows[order[1:]] != rows[order[:-1]]).any(axis=1) | (length[order[1:]] != length[order[:-1]])
    name = np.empty(len(rows), np.int64)
    name[order] = np.cumsum(fresh) - 1
    return name, np.minimum.reduceat(ids[order], np.flatnonzero(fresh)), order[fresh]


def _mark_bucket(key: tuple, rows: pa.Table) -> pa.Table:
    part, length, ids, where, record, body = [], [], [], [], [], []
    for row in rows.select(["part", "n", "ids", "keys", "body"]).to_pylist():
        n = np.frombuffer(row["n"], "u1").astype(np.int64)
        length.append(n)
        part.append(np.full(len(n), row["part"], np.int64))
        ids.append(np.frombuffer(row["ids"], "<i8", len(n)))
        where.append(np.frombuffer(row["ids"], "<u8", len(n), 8 * len(n)))
        record.append(np.frombuffer(row["keys"], "<u4"))
        body.append(np.frombuffer(row["body"], np.uint8))
    part, length, ids, where, record, body = (np.concatenate(x) for x in (part, length, ids, where, record, body))
    rows = _padded(body, length)
    name, lowest, heads = _fold_records(rows, length, where, ids)
    masks = np.zeros(len(heads), np.int64)
    # Only an anchor with different surroundings needs an order.  Its records stay together; slices bound the memory.
    anchor = where[heads]
    _, group, size = np.unique(anchor, return_inverse=True, return_counts=True)
    many = np.flatnonzero(size[group] > 1)
    many = many[np.argsort(anchor[many], kind="stable")]
    cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], anchor[many][1:] != anchor[many][:-1]])), [len(many)]]) if len(many) else [0]
    sizes = np.concatenate([[0], np.cumsum(length[heads[many]] + 1)])
    done = 0
    while done < len(many):
        fitting = int(np.searchsorted(sizes, sizes[done] + SORT_SYMBOLS, "right")) - 1
        stop = int(cuts[max(np.searchsorted(cuts, done, "right"), np.searchsorted(cuts, fitting, "right") - 1)])
        take = many[done:stop]
        masks[take] = earlier_strings(rows[heads[take]], length[heads[take]], lowest[take])
        done = stop
    # A record of a larger id than another with the same bytes repeats it as a whole.
    masks = np.where(ids > lowest[name], (np.int64(1) << (length - WIDTH + 1)) - 1, masks[name])
    hit = np.flatnonzero(masks)
    hit = hit[np.argsort(part[hit], kind="stable")]
    cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], part[hit][1:] != part[hit][:-1]])), [len(hit)]]) if len(hit) else np.zeros(1, int)
    spans = [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table({
        "part": pa.array([int(part[hit[a]]) for a, _ in spans], pa.int64()),
        "records": pa.array([_raw(record[hit[a:b]], "<u4") for a, b in spans], pa.binary()),
        "masks": pa.array([_raw(masks[hit[a:b]], "<i8") for a, b in spans], pa.binary())})


RESULT = "id long, hash string, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _covered(n: int, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which of ``n`` bytes lie in a marked string: a string that covers a byte begins on it or up to 49 bytes before."""
    begins = np.zeros(n, bool)
    for bit in range(WINDOW):
        begins[at[mask & (np.int64(1) << bit) != 0] + bit] = True
    count = np.cumsum(begins, dtype=np.int32)
    count[WIDTH:] -= count[:-WIDTH].copy()
    return count > 0


def _cut(with_text: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table, marks: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({n: pa.array([], pa.int64() if k == "long" else pa.string()) for n, k in map(str.split, RESULT.split(", "))})
        ids, texts, rows = _texts(rows)
        lengths = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        gone = _covered(len(data), *_marked_places(marks))
        removed, spans, digests, kept = [], [], [], []
        end = 0
        for n in lengths.tolist():
            own = gone[end:end + n]
            removed.append(int(own.sum()))
            spans.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()))
            rest = data[end:end + n][~own].tobytes()
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "ignore") if with_text and removed[-1] else None)
            end += n
        return pa.table({"id": pa.array(ids), "hash": rows["hash"].combine_chunks(), "n_removed": pa.array(removed, pa.int64()),
                         "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
                         "kept_text": pa.array(kept, pa.string())})

    return run


def _marked_places(marks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(first string, mask) of all marks of a part."""
    kinds = marks["kind"].to_numpy() if marks.num_rows else np.zeros(0, np.int64)
    found = {k: marks.filter(pa.array(kinds == k)) for k in (1, 2, 3)}
    at, mask = [_gather(found[1]["n"], "<u4").astype(np.int64)], [_gather(found[1]["keys"], "<i8")]
    place, record = _gather(found[2]["n"], "<u4").astype(np.int64), _gather(found[2]["keys"], "<u4").astype(np.int64)
    if len(place):
        masks = np.zeros(int(record.max()) + 1, np.int64)
        masks[_gather(found[3]["n"], "<u4")] = _gather(found[3]["keys"], "<i8")
        at.append(place)
        mask.append(masks[record])
    return np.concatenate(at), np.concatenate(mask)


class _Texts:
    """The folded texts as an external table in shared storage, bucketed by part."""

    def __init__(self, texts: DataFrame, parts: int):
        self.spark = texts.sparkSession
        self.buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), parts // 8)
        self.name, self.path = f"suffix_texts_{uuid.uuid4().hex}", run_dir(self.spark, "suffix-texts")
        placed = texts.withColumn("part", F.pmod(F.xxhash64("id", "hash"), F.lit(parts))).repartition(self.buckets, "part")
        placed.write.format("parquet").option("compression", "zstd").option("path", self.path).bucketBy(self.buckets, "part").saveAsTable(self.name)

    def by_part(self) -> object:
        return self.spark.table(self.name).groupBy("part")

    def with_rows(self, rows: DataFrame, run: Callable, schema: str) -> DataFrame:
        """Meets rows that have a part with the texts of the part, which are not shuffled."""
        other = rows.repartition(self.buckets, "part").groupBy("part")
        return self.by_part().cogroup(other).applyInArrow(run, schema)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Removes every byte covered by a 50-byte string that also begins in a document with a smaller id.

    One row per row of ``docs``: id, hash (of the text), n_bytes, n_removed, n_spans, kept_sha256, and kept_text if
    asked for: NULL where nothing was removed, and for copies of earlier texts; bytes of characters that were cut
    apart are left out of it, not of the hash.  A NULL text is empty.  A NULL id counts as larger than any other.  Rows of the same id do not remove each other's
    strings, so repeated rows get equal results.  Texts below 50 bytes are kept.  Texts may be of any length:
    hashing goes by tiles, and a text belongs to one part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("given_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), text.alias("text"))
    sized = stored(given.select("given_id", "id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("n_bytes")), "suffix-sizes")
    first = sized.groupBy("hash").agg(F.min("id").alias("id"), F.max("n_bytes").alias("n_bytes")).where(F.col("n_bytes") >= WIDTH)
    n_bytes = first.agg(F.sum("n_bytes")).first()[0] or 0
    parts = buckets = pieces(n_bytes, PART_BYTES)
    folded = given.select("id", "text").withColumn("hash", F.sha2("text", 256)).join(first.select("id", "hash"), ["id", "hash"], "left_semi")
    if not sized.groupBy("id", "hash").count().where("count > 1").isEmpty():
        folded = folded.dropDuplicates(["id", "hash"])  # combined before the shuffle, so repetitions never meet in a part
    texts, spark = _Texts(folded, parts), docs.sparkSession
    release(spark)
    anchors = texts.by_part().applyInArrow(_send_anchors(buckets), ANCHORS)
    replies = stored(anchors.groupBy("bucket").applyInArrow(_repeated_anchors, REPLIES), "suffix-anchors")
    release(spark)
    records = stored(texts.with_rows(replies, _send_records(buckets), RECORDS), "suffix-records")
    release(spark)
    marks = records.where("kind = 0").groupBy("bucket").applyInArrow(_mark_bucket, MARKS)
    found = stored(marks.select(F.lit(3).alias("kind"), "part", F.col("records").alias("n"), F.col("masks").alias("keys")), "suffix-marks")
    release(spark)
    everything = records.where("kind > 0").select("kind", "part", "n", "keys").union(found)
    cut = stored(texts.with_rows(everything, _cut(with_text), RESULT), "suffix-result")
    texts.drop()
    for used in (replies, records, found):
        discard(used)
    release(spark)
    out = sized.join(cut, ["id", "hash"], "left")
    copy = (F.col("n_bytes") >= WIDTH) & F.col("n_removed").isNull()
    columns = [
        F.col("given_id").alias(id_col), "hash", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "hash")).alias("kept_sha256")]
    return out.select(*columns, "kept_text") if with_text else out.select(*columns)


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the passages of earlier ones."""
    return cut_repeats(table(spark, folder, "documents")).drop("hash")

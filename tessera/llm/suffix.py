"""Suffix-array dedup: repeated byte strings by hash-compared suffix sort.

A byte goes if a string of ``length`` bytes over it starts anywhere else too. Sorting all suffixes of a corpus would move each many
times, so a sparse set is sorted: in every string of ``length`` bytes the place with the lowest hash of its next ``gram`` bytes (the
leftmost, if several) is its anchor. Equal strings have their anchors at equal places, so a repeat always meets itself. The strings that
share an anchor make one span (their union).

1. Anchors whose gram occurs twice or more in all are found by the exchange of repeats.py. Only these go on.
2. Each chunk sends the bytes of its different found spans to the bucket of their gram. There the suffixes from the anchors on are sorted by a
   mergesort whose comparisons find the common extension of two suffixes by binary search over prefix polynomial hashes, so each takes a
   logarithm of their length; the reversed texts before the anchors are sorted alike. Neighbours are then compared byte by byte, which verifies
   the order and gives the common lengths; where a hash collision has misled the sort, the bytes are sorted themselves.
   The string that begins d bytes before an anchor occurs twice if two spans agree on length - d bytes from the anchor on and on d bytes before
   it: the two sorted lists give each span a class for either side, and equal pairs of classes are equal strings. The bucket answers with a
   bit for each d. Buckets are as many as the found spans need (``BUCKET_BYTES`` each), and a bucket is sorted in parts of ``PART`` bytes, dealt by gram.
3. Grams that occur ``HOT`` times or more would make large buckets. Their strings are compared one by one instead, by 96-bit BLAKE2b with a salt
   drawn for each run, over the exchange of repeats.py, where a string is one key of a chunk.
4. Bytes under repeated strings go.

Defined cases: null text has no bytes; texts shorter than ``length`` lose nothing; repeated rows are copies of each other, so all lose their repeated strings
(rows that repeat very often are collapsed, see repeats.py); texts of any length are cut into pieces of ``PIECE`` bytes that share ``length`` - 1 bytes, so that
arrays of one piece are in memory; an empty table gives an empty result; other columns, of any name, are ignored. A kept text may end inside a character:
operators see bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Scratch
from .repeats import LEAST_BUCKET_BITS, MESSAGE, Chunks, Key, Prefix, answered, bucket_bits, exchange, frugal, in_order, member, messages, mix, short_key, texts_of, with_answers

LENGTH, GRAM, HOT, PIECE = 200, 32, 4096, 1_000_000
#: Bytes of spans in a bucket, and those that are sorted at once (a worker holds some 60 times as much).
BUCKET_BYTES, PART = 16_000_000, 2_000_000
SENT = "bucket int, chunk long, ids binary, left binary, right binary, twice binary, body binary"
FOUND = "chunk long, ids binary, bits binary"
_HIGH = np.uint64(0xFFFFFFFF00000000)


class Piece:
    """A stretch of a document's bytes: document, place of the first byte, bytes. Strings belong to the piece that they begin in."""

    __slots__ = ("doc", "first", "data")

    def __init__(self, doc: int, first: int, data: bytes):
        self.doc, self.first, self.data = doc, first, data


def pieces(texts: list[bytes], length: int) -> Iterator[list[Piece]]:
    """All texts in pieces, in lists of about PIECE bytes."""
    out, size = [], 0
    for doc, text in enumerate(texts):
        for at in range(0, max(1, len(text)), PIECE):
            data = text[at : at + PIECE + length - 1]
            if at and len(data) < length:
                break
            out.append(Piece(doc, at, data))
            size += len(data)
            if size >= PIECE:
                yield out
                out, size = [], 0
    if out:
        yield out


class Spans:
    """Some pieces, their anchors and the spans of strings that share an anchor."""

    def __init__(self, of: list[Piece], length: int, gram: int):
        self.length, self.buffer = length, b"".join([p.data for p in of])
        self.data = np.frombuffer(self.buffer, np.uint8)
        sizes = np.array([len(p.data) for p in of], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        n = len(self.data)
        self.anchor = self.first = self.last = np.zeros(0, np.int64)
        self.keys = np.zeros(0, np.uint64)
        inside = np.ones(max(0, n - length + 1), bool)  # strings that lie in one piece
        for end in self.ends[:-1].tolist():
            inside[max(0, end - length + 1) : end] = False
        start = np.flatnonzero(inside)
        if not len(start):
            return
        grams = mix(Prefix(self.data.astype(np.uint64) + np.uint64(1)).rolling(gram))
        lowest = grams & _HIGH | np.arange(len(grams), dtype=np.uint64)
        width, reach = length - gram + 1, 1
        while 2 * reach <= width:
            lowest = np.minimum(lowest[:-reach], lowest[reach:])
            reach *= 2
        rest = width - reach
        if rest:
            lowest = np.minimum(lowest[: len(lowest) - rest], lowest[rest:])
        at = (lowest[start] & ~_HIGH).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        self.first = start[new]
        self.last = start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
        self.anchor = at[new]
        self.keys = mix(~grams[self.anchor])  # hashed anew: the lowest hashes would all go to the first buckets

    def classes(self, which: np.ndarray) -> np.ndarray:
        """For each of the given spans the first one with the same bytes and the same anchor in them."""
        known: dict[tuple[int, bytes], int] = {}
        number, buffer, length = known.setdefault, self.buffer, self.length
        spans = zip(which.tolist(), self.first[which].tolist(), self.last[which].tolist(), self.anchor[which].tolist(), strict=True)
        return np.array([number((a - f, buffer[f : l + length]), i) for i, f, l, a in spans], np.int64)


def lce(prefix: Prefix, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Longest common extension of suffixes a and b, ``most`` at the most: binary search over stretches with equal hashes."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    while (open_ := low < high).any():
        middle = np.where(open_, (low + high + 1) // 2, low)
        equal = prefix.stretch(a, a + middle) == prefix.stretch(b, b + middle)
        low = np.where(open_ & equal, middle, low)
        high = np.where(open_ & ~equal, middle - 1, high)
    return low


def suffix_sort(prefix: Prefix, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of the strings data[start : start + size] (a prefix goes before what it begins); mergesort, all merges of a level at once."""
    n = len(start)
    order = np.arange(n)
    head = np.zeros(n, np.uint64)  # the first eight bytes as a number: only suffixes that agree on them need more
    for i in range(8):
        head = head << np.uint64(8) | np.where(i < size, data[np.minimum(start + i, len(data) - 1)], 0).astype(np.uint64)

    def less(a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        ha, hb = head[a], head[b]
        out = ha < hb
        i = np.flatnonzero(ha == hb)
        if len(i):
            a, b = a[i], b[i]
            sa, sb, za, zb = start[a], start[b], size[a], size[b]
            both = np.minimum(za, zb)
            same = lce(prefix, sa, sb, both)
            over = same >= both
            at = np.where(over, 0, same)
            out[i] = np.where(over, (za <= zb) if or_equal else (za < zb), data[np.minimum(sa + at, len(data) - 1)] < data[np.minimum(sb + at, len(data) - 1)])
        return out

    width = 1
    while width < n:
        place = np.arange(n)
        run = place // width
        other = np.where(run % 2 == 0, run + 1, run - 1) * width  # the run that this one merges with
        low = np.minimum(other, n)
        end = np.minimum(other + width, n)
        high, own = end.copy(), order
        left = run % 2 == 0
        while (open_ := low < high).any():  # how many of the other run go before: strictly less for the left run, less or equal for the right
            i = np.flatnonzero(open_)
            middle = (low[i] + high[i]) // 2
            before, l = np.empty(len(i), bool), left[i]
            before[l], before[~l] = less(own[middle[l]], own[i[l]], False), less(own[middle[~l]], own[i[~l]], True)
            low[i] = np.where(before, middle + 1, low[i])
            high[i] = np.where(before, high[i], middle)
        base = run // 2 * 2 * width
        target = base + (place - run * width) + (low - np.minimum(other, n))
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        width *= 2
    return order


def neighbours(data: np.ndarray, start: np.ndarray, size: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, bool]:
    """Common length of each string data[start : start + size] (``most`` long at the most) with the one before it in ``order`` (0 for the first),
    and whether the order is right: by the bytes themselves."""
    common, right = np.zeros(len(order), np.int64), True
    for at in range(0, len(order) - 1, 16_384):
        o = order[at : at + 16_385]
        rows = data[np.minimum(start[o][:, None] + np.arange(most), len(data) - 1)].astype(np.int16)
        rows[np.arange(most) >= size[o][:, None]] = -1  # after the end: before any byte
        differ = rows[1:] != rows[:-1]
        some = differ.any(1)
        n = np.where(some, differ.argmax(1), np.minimum(size[o[1:]], size[o[:-1]]))
        common[at + 1 : at + len(o)] = n
        i = np.flatnonzero(some)
        right &= bool((rows[i + 1, n[i]] > rows[i, n[i]]).all())
    return common, right


def sorted_suffixes(data: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings and the common length of each with the one before. Sorted by hashes, verified by bytes; by bytes, if that fails."""
    order = suffix_sort(Prefix(data.astype(np.uint64) + np.uint64(1)), data, start, size)
    common, right = neighbours(data, start, size, order, most)
    if not right:
        whole = data.tobytes()
        strings = [whole[s : s + z] for s, z in zip(start.tolist(), size.tolist(), strict=True)]
        order = np.array(sorted(range(len(strings)), key=strings.__getitem__), np.int64)
        common, _ = neighbours(data, start, size, order, most)
    return order, common


def repeated(data: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For spans of one bucket, one after the other in ``data`` with ``left`` bytes before the anchor and ``right`` from it on: whether the string that
    begins d bytes before the anchor occurs twice or more (a span counts ``weight`` times), for each d up to length - gram."""
    n, depth = len(left), length - gram + 1
    out = np.zeros((n, depth), bool)
    begin = np.cumsum(left + right) - (left + right)
    place = np.arange(depth)
    own = (place >= length - right[:, None]) & (place <= left[:, None])
    out[weight > 1] = own[weight > 1]  # those that repeat in their chunk
    order, common = sorted_suffixes(data, begin + left, right, length)
    met = np.zeros(n, bool)  # spans that share their gram with another
    met[order] = (common >= gram) | np.append(common[1:] >= gram, False)
    if not met.any():
        return out
    back, alike = sorted_suffixes(data[::-1], len(data) - begin - left, left, max(1, length - gram))
    group, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(depth):
        which = np.flatnonzero(own[:, d] & met)
        if len(which) < 2:
            continue
        group[order] = np.cumsum(common < length - d)
        behind[back] = np.cumsum(alike < d)
        pair = group[which] * (n + 1) + behind[which]
        by = np.argsort(pair, kind="stable")
        same = np.diff(pair[by]) == 0
        twice = np.append(same, False) | np.append(False, same)
        out[which[by[twice]], d] = True
    return out


def _strings(spans: Spans, which: np.ndarray, key: Key) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and keyed hashes (64 and 32 bits) of all strings of the given spans."""
    first, n = spans.first[which], spans.last[which] - spans.first[which] + 1
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    made = key.digests((spans.buffer[i : i + spans.length] for i in at.tolist()), 12)
    both = np.frombuffer(made, np.dtype([("k", "<u8"), ("m", "<u4")]))
    return at, both["k"].astype(np.uint64), both["m"].astype(np.uint64)


def _sent(chunk: int, bits: int, spans: Spans, base: int, lead: np.ndarray, weight: np.ndarray) -> pa.Table:
    """Messages with the bytes of spans, one a bucket."""
    order = np.argsort(spans.keys[lead], kind="stable")
    lead, weight = lead[order], weight[order]
    bucket = (spans.keys[lead] >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    bounds = list(zip(np.append(0, cuts).tolist(), np.append(cuts, len(lead)).tolist(), strict=True)) if len(lead) else []
    left = (spans.anchor[lead] - spans.first[lead]).astype("<u2")
    right = (spans.last[lead] + spans.length - spans.anchor[lead]).astype("<u2")
    ids, twice = (lead + base).astype("<u8"), np.minimum(weight, 2).astype(np.uint8)
    whole = [spans.buffer[f:e] for f, e in zip(spans.first[lead].tolist(), (spans.last[lead] + spans.length).tolist(), strict=True)]
    columns = [pa.array([int(bucket[s]) for s, _ in bounds], pa.int32()), pa.array([chunk] * len(bounds), pa.int64())]
    columns += [pa.array([x[s:e].tobytes() for s, e in bounds], pa.binary()) for x in (ids, left, right, twice)]
    columns.append(pa.array([b"".join(whole[s:e]) for s, e in bounds], pa.binary()))
    return pa.table(columns, ["bucket", "chunk", "ids", "left", "right", "twice", "body"])


def _parts(data: np.ndarray, anchor: np.ndarray, gram: int) -> list[np.ndarray]:
    """The spans of a bucket in parts of about PART bytes; equal grams are in one part."""
    parts = -(-len(data) // PART)
    if parts < 2:
        return [np.arange(len(anchor))]
    part, weights = np.empty(len(anchor), np.int64), mix(np.arange(1, gram + 1, dtype=np.uint64)) | np.uint64(1)
    for at in range(0, len(anchor), 16_384):
        grams = data[anchor[at : at + 16_384, None] + np.arange(gram)].astype(np.uint64) + np.uint64(1)
        part[at : at + 16_384] = mix((grams * weights).sum(1, dtype=np.uint64)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(part[order])) + 1)


def _found(table: pa.Table, length: int, gram: int) -> pa.Table:
    """For one bucket: to each chunk the spans with repeated strings and a bit for each d."""
    parts = {c: [x.as_py() for x in table[c]] for c in ("ids", "left", "right", "twice", "body")}
    ids, left, right, twice = (np.frombuffer(b"".join(parts[c]), t) for c, t in (("ids", "<u8"), ("left", "<u2"), ("right", "<u2"), ("twice", np.uint8)))
    data = np.frombuffer(b"".join(parts["body"]), np.uint8)
    ends = np.cumsum([len(x) // 8 for x in parts.pop("ids")])
    parts.clear()
    left, right = left.astype(np.int64), right.astype(np.int64)
    size = left + right
    begin = np.cumsum(size) - size
    bits = np.empty((len(ids), -(-(length - gram + 1) // 8)), np.uint8)
    for own in _parts(data, begin + left, gram):
        n = size[own]
        some = data[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        bits[own] = np.packbits(repeated(some, left[own], right[own], twice[own], length, gram), axis=1)
    some = bits.any(1)
    out = []
    for chunk, s, e in zip(table["chunk"].to_pylist(), np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
        mine = np.flatnonzero(some[s:e]) + s
        if len(mine):
            out.append((chunk, ids[mine].tobytes(), bits[mine].tobytes()))
    return pa.table([pa.array([x[0] for x in out], pa.int64()), *[pa.array([x[i] for x in out], pa.binary()) for i in (1, 2)]], ["chunk", "ids", "bits"])


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    if not 0 < gram <= length:
        raise ValueError("a gram must fit in the string")
    ship(docs.sparkSession)
    scratch, key, chunks = Scratch(docs.sparkSession, "suffix"), Key(), Chunks(docs)
    bits, depth, rows = bucket_bits(chunks.total // 80), length - gram + 1, chunks.rows

    def anchors(table: pa.Table) -> pa.Table:
        return pa.concat_tables([messages(table["chunk"][0].as_py(), bits, Spans(of, length, gram).keys, counted=True) for of in pieces(texts_of(table), length)])

    found = exchange(rows.groupBy("chunk").applyInArrow(frugal(anchors), MESSAGE), 6, scratch, "anchors", hot)
    few, many = (int(x or 0) // 6 for x in found.agg(F.sum(F.octet_length("keys")), F.sum(F.octet_length("hot"))).first())
    body_bits = max(LEAST_BUCKET_BITS, (few * (length + depth // 2) // BUCKET_BYTES).bit_length())  # a span has length to length + depth bytes
    string_bits = bucket_bits(many * depth)

    def known(table: pa.Table, answers: pa.Table) -> Iterator[tuple[int, list[Piece], Spans, np.ndarray, np.ndarray]]:
        """Number of the first span, pieces, spans, found spans and hot spans of each list of pieces of a chunk."""
        few, many = (answered(answers, 0, 6, c)[0] for c in ("keys", "hot"))
        base = 0
        for of in pieces(texts_of(table), length):
            spans = Spans(of, length, gram)
            short = short_key(spans.keys, bits)
            yield base, of, spans, np.flatnonzero(member(short, few)), np.flatnonzero(member(short, many))
            base += len(spans.keys)

    def bodies(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, out = in_order(table), [_sent(0, body_bits, Spans([], length, gram), 0, np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for base, _, spans, which, _ in known(table, answers) if table.num_rows and answers.num_rows else ():
            lead, count = np.unique(spans.classes(which), return_counts=True)
            out.append(_sent(table["chunk"][0].as_py(), body_bits, spans, base, lead, count))
        return pa.concat_tables(out)

    met = with_answers(rows, [found], bodies, SENT).groupBy("bucket").applyInArrow(frugal(lambda t: _found(t, length, gram)), FOUND)
    met = scratch.table(met, "spans")

    def hot_strings(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = [messages(0, string_bits, np.zeros(0, np.uint64))]
        for _, _, spans, _, which in known(table, answers) if table.num_rows and any(x.as_py() for x in answers["hot"]) else ():
            lead, count = np.unique(spans.classes(which), return_counts=True)
            _, a, b = _strings(spans, np.repeat(lead, np.minimum(count, 2)), key)
            out.append(messages(table["chunk"][0].as_py(), string_bits, a, b))
        return pa.concat_tables(out)

    strings = exchange(with_answers(rows, [found.where("length(hot) > 0")], hot_strings, MESSAGE), 12, scratch, "strings")

    def cover(table: pa.Table, answers: pa.Table, texts: list[bytes]) -> list[np.ndarray | None]:
        """For each text which bytes go (None: none do)."""
        gone: list[np.ndarray | None] = [None] * len(texts)
        mine = [(i.as_py(), b.as_py()) for i, b, k in zip(answers["ids"], answers["bits"], answers["kind"], strict=True) if k.as_py() == 1]
        ids = np.frombuffer(b"".join([i for i, _ in mine]), "<u8").astype(np.int64)
        marks = np.frombuffer(b"".join([b for _, b in mine]), np.uint8).reshape(len(ids), -(-depth // 8))
        by = np.argsort(ids)
        ids, marks = ids[by], marks[by]
        k, m = answered(answers, 2, 12)
        for base, of, spans, which, many in known(table, answers):
            count = np.zeros(len(spans.data) + 1, np.int64)
            if len(which) and len(ids):
                lead = spans.classes(which) + base
                at = np.minimum(np.searchsorted(ids, lead), len(ids) - 1)
                hit = ids[at] == lead
                flags = np.unpackbits(marks[at[hit]], axis=1, count=depth).astype(np.int8)
                edges = np.diff(flags, axis=1, prepend=0, append=0)
                span, d = np.nonzero(edges == 1)
                _, after = np.nonzero(edges == -1)
                anchor = spans.anchor[which[hit]][span]
                count[anchor - after + 1] += 1  # no two strings begin or end at one place
                count[anchor - d + length] -= 1
            if len(many) and len(k):
                at, a, b = _strings(spans, many, key)
                at = at[member(a, k, b, m)]
                count[at] += 1
                count[at + length] -= 1
            covered = np.cumsum(count[:-1]) > 0
            for p, s, e in zip(of, spans.starts.tolist(), spans.ends.tolist(), strict=True):
                if covered[s:e].any():
                    if gone[p.doc] is None:
                        gone[p.doc] = np.zeros(len(texts[p.doc]), bool)
                    gone[p.doc][p.first : p.first + e - s] |= covered[s:e]
        return gone

    def judge(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = in_order(table)
        texts = texts_of(table)
        removed, runs, sha = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
        gone = cover(table, answers, texts) if answers.num_rows else [None] * len(texts)
        for i, (text, mine) in enumerate(zip(texts, gone, strict=True)):
            if mine is not None:
                removed[i] = mine.sum()
                runs[i] = (np.diff(mine.astype(np.int8), prepend=0) == 1).sum()
                text = np.frombuffer(text, np.uint8)[~mine].tobytes()
            sha.append(hashlib.sha256(text).hexdigest())
        sizes = np.array([len(t) for t in texts], np.int64)
        return pa.table(
            [table["doc_id"], pa.array(sizes), pa.array(removed), pa.array(runs), pa.array(sha, pa.string()), table["n"]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n"]
        )

    judged = with_answers(rows, [found, met, strings], judge, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n long")
    return chunks.spread(judged)

"""Where a window of consecutive tokens has stood before, over a whole corpus.

Sorting one row for every window would move many times the corpus.  Each window
is owned by its rarest gram instead (the gram of smallest hash in it), and
consecutive windows with the same owner form a *run*: one row for some ten
windows.  Equal windows have equal owners, so only runs whose owner occurs
twice can hold a repeated window, and

* of runs with equal owner and equal content, all but the first are candidates
  for removal, with the place of the first as their source,
* where an owner leads on to different contents (a branch), the first
  occurrence of each content is opened into single windows, which are compared
  with each other.

Candidates that follow one another along the same source are joined to long
spans. Hashes only propose them: the bytes of every span's source are fetched
to the span's document and compared there, and only equal spans are removed.

Runs move between tasks packed in binary columns, dealt by a hash of the owner,
and what is found goes back dealt by document.  Copies met in one task are
settled there, and a source passage moves once per part of documents that asks
for it, so a passage that a third of the documents share sends a bounded number
of rows. The number of parts follows from the bytes of the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import _BYTE, Chunk, Words, chunks, prefix_sums, ragged_arange, sliding_min, span_hash, word_hashes, words
from .shared import dealt, dealt_np, part_count, stored

FLUSH_BYTES = 6 << 20
SUB_BUCKETS = 8
_SEGMENT = 1 << 22
PACKED = "part int, kind int, payload binary"
#: Kinds of packed rows; parts past the number of parts are only passed on.
RUNS, SPANS, EDGES, OPEN, WINDOWS, ASKED, PASSAGES = range(7)
SPAN = (np.int64, np.int32, np.int32, np.int64, np.int32)  # doc, place, windows, source doc, source place (-1: compared already)
EDGE = (np.uint64, *SPAN)


@dataclass(frozen=True)
class Windows:
    """width: tokens in a window; gram: tokens in an owner; by_word: tokens are words, else bytes.

    within: a repeat inside one document counts too; else only one in a document of smaller doc_id.
    """

    width: int
    gram: int
    by_word: bool
    within: bool


@dataclass
class Runs:
    row: np.ndarray  # index of the document in the chunk
    place: np.ndarray  # first token, counted in the document
    n: np.ndarray  # windows
    owner: np.ndarray
    content: np.ndarray


def tokens_of(chunk: Chunk, how: Windows) -> tuple[np.ndarray, np.ndarray, Words | None]:
    """A hash per token, where each document's tokens begin (and the end), and the words."""
    if not how.by_word:
        return _BYTE[chunk.data], chunk.off, None
    w = words(chunk)
    return word_hashes(chunk, w), w.first, w


def find_runs(chunk: Chunk, how: Windows) -> Runs:
    """All runs of a chunk, in order."""
    tokens, first, _ = tokens_of(chunk, how)
    sums = prefix_sums(tokens)
    parts = []
    step, width = _SEGMENT, how.width
    for lo in range(0, max(1, len(tokens) - width + 1), step):
        hi = min(len(tokens), lo + step + width - 1)
        if hi - lo < width:
            continue
        i = np.arange(lo, hi - how.gram + 1)
        gram = span_hash(sums, i, i + how.gram)
        low = np.uint64((1 << 23) - 1)
        least = sliding_min((gram & ~low) | (i - lo).astype(np.uint64), width - how.gram + 1)
        at = (least & low).astype(np.int64)
        ends = first[1:][np.searchsorted(first, np.arange(lo, lo + len(least)), "right") - 1] if len(first) > 2 else np.full(len(least), first[-1])
        whole = np.arange(lo, lo + len(least)) + width <= ends
        new = np.ones(len(least), bool)
        new[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(least))
        keep = whole[s]
        s, e = s[keep], e[keep]
        parts.append((s + lo, e - s, gram[at[s]]))
    if parts:
        start, n, owner = (np.concatenate(x) for x in zip(*parts))
    else:
        start, n, owner = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.searchsorted(first, start, "right") - 1
    return Runs(row, (start - first[row]).astype(np.int32), n.astype(np.int32), owner, span_hash(sums, start, start + n + width - 1))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte by byte, so that the shuffle compresses their constant bytes away."""
    n = len(columns[0])
    return np.int64(n).tobytes() + b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T).tobytes() for c in columns)


def unpack(payload: bytes, *types: object) -> list[np.ndarray]:
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    out, at = [], 8
    for t in types:
        size = t if isinstance(t, int) else np.dtype(t).itemsize
        planes = np.frombuffer(payload, np.uint8, size * n, at).reshape(size, n)
        at += size * n
        if isinstance(t, int):  # an unsigned number of so many bytes
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :size] = planes.T
            out.append(wide.view(np.uint64).ravel())
        else:
            out.append(np.ascontiguousarray(planes.T).view(t).ravel())
    return out


def unpack_all(payloads, *types: object) -> list[np.ndarray]:
    parts = [unpack(p.as_py() if hasattr(p, "as_py") else p, *types) for p in payloads]
    if not parts:
        return [np.zeros(0, np.uint64 if isinstance(t, int) else t) for t in types]
    return [np.concatenate(x) for x in zip(*parts)]


def of_kind(t: pa.Table, kind: int) -> pa.ChunkedArray:
    """The payloads of one kind."""
    return t.column("payload").filter(pa.array(t.column("kind").to_numpy() == kind))


def short(x: np.ndarray, size: int) -> np.ndarray:
    """The low ``size`` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size]


def by_part(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    for lo, hi in zip(cuts, np.append(cuts[1:], len(part))):
        yield int(part[lo]), [c[order[lo:hi]] for c in columns]


Rows = list[tuple[int, int, bytes]]


def batch(rows: Rows) -> pa.RecordBatch:
    part, kind, payload = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["part", "kind", "payload"])


def table(rows: Rows) -> pa.Table:
    return pa.Table.from_batches([batch(rows)])


def passed_on(t: pa.Table, part: int) -> pa.Table:
    """The same rows for ``part``."""
    return t.select(["part", "kind", "payload"]).set_column(0, "part", pa.array(np.full(len(t), part, np.int32)))


def shared_owner(owner: np.ndarray) -> np.ndarray:
    """Indexes of the rows whose owner occurs more than once."""
    order = np.argsort(owner)
    ranked = owner[order]
    twice = np.zeros(len(owner), bool)
    twice[1:] = ranked[1:] == ranked[:-1]
    twice[:-1] |= twice[1:]
    return order[twice]


def repeats(same: list[np.ndarray], doc: np.ndarray, place: np.ndarray, how: Windows) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by the columns ``same``, doc and place: which repeat the first row of their kind, and the index of that row."""
    if not len(doc):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    new = np.zeros(len(doc), bool)
    new[0] = True
    for c in same:
        new[1:] |= c[1:] != c[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    other = doc != doc[first]
    return (other | (place != place[first]) if how.within else other), first


def joined(doc, place, n, source, at) -> list[np.ndarray]:
    """Spans of one document that follow one another or overlap along one source, as one span each."""
    along = np.where(at < 0, 0, place.astype(np.int64) - at)
    source = np.where(at < 0, 0, source)
    order = np.lexsort((place, along, at < 0, source, doc))
    doc, place, n, source, at, along = (x[order] for x in (doc, place, n, source, at, along))
    if not len(doc):
        return [doc, place, n, source, at]
    line = np.zeros(len(doc), bool)
    line[0] = True
    for c in (doc, source, along, at < 0):
        line[1:] |= c[1:] != c[:-1]
    # ends grow along a line if each is offset by the line's number
    number = np.cumsum(line).astype(np.int64) << np.int64(33)
    reach = np.maximum.accumulate(number + place + n) - number
    new = line.copy()
    new[1:] |= place[1:] > reach[:-1]
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(doc)) - 1
    return [doc[lo], place[lo], (reach[hi] - place[lo]).astype(np.int32), source[lo], at[lo]]


def span_rows(n_parts: int, doc, place, n, source, at) -> Rows:
    """Spans, packed for the parts of their documents."""
    spans = joined(doc, place, n, source, at)
    return [(p, SPANS, pack(*c)) for p, c in by_part(dealt_np(spans[0], n_parts), spans)]


def _past(rows: Rows, n_parts: int) -> Rows:
    """Rows that the next grouping only passes on."""
    return [(n_parts + p, k, c) for p, k, c in rows]


def _packed_runs(owner, content, doc, place, n, n_parts: int, how: Windows) -> Rows:
    """Rows for the buckets of owners, and for repeats of a run in this very task, spans for its documents."""
    again = shared_owner(owner)
    again = again[np.lexsort((place[again], doc[again], content[again], owner[again]))]
    mask, first = repeats([owner[again], content[again]], doc[again], place[again], how)
    one, source = again[mask], again[first[mask]]
    rows = _past(span_rows(n_parts, doc[one], place[one], n[one], doc[source], place[source]), n_parts)
    left = np.ones(len(owner), bool)
    left[one] = False
    owner, content, doc, place, n = (x[left] for x in (owner, content, doc, place, n))
    bucket = ((owner >> np.uint64(40)) % np.uint64(n_parts)).astype(np.int32)
    return rows + [(p, RUNS, pack(short(a, 5), short(c, 6), d, o, short(m, 1))) for p, (a, c, d, o, m) in by_part(bucket, [owner, content, doc, place, n])]


def emit(how: Windows, n_parts: int) -> Callable:
    def run(batches):
        have, size = [], 0
        for b in batches:
            for chunk in chunks(b):
                r = find_runs(chunk, how)
                have.append((r.owner, r.content, chunk.doc[r.row], r.place, r.n))
                size += len(chunk.data)
                if size >= FLUSH_BYTES:
                    yield batch(_packed_runs(*(np.concatenate(x) for x in zip(*have)), n_parts, how))
                    have, size = [], 0
        if have:
            yield batch(_packed_runs(*(np.concatenate(x) for x in zip(*have)), n_parts, how))

    return run


def settle(how: Windows, n_parts: int, with_edges: bool) -> Callable:
    """For one bucket of owners: repeats of whole runs, and the first runs of owners that branch.

    with_edges: all runs of a repeated content, as edges of a graph, instead of spans.
    """

    def run(key, t):
        part = key[0].as_py()
        if part >= n_parts:
            return passed_on(t, part - n_parts)
        owner, content, doc, place, n = unpack_all(of_kind(t, RUNS), 5, 6, np.int64, np.int32, 1)
        shared = shared_owner(owner)
        order = shared[np.lexsort((place[shared], doc[shared], content[shared], owner[shared]))]
        owner, content, doc, place, n = (x[order] for x in (owner, content, doc, place, n.astype(np.int32)))
        later, first = repeats([owner, content], doc, place, how)
        new_owner = np.ones(len(owner), bool)
        new_owner[1:] = owner[1:] != owner[:-1]
        changes = np.zeros(len(owner), np.int64)
        changes[1:] = (content[1:] != content[:-1]) & ~new_owner[1:]
        group = np.cumsum(new_owner) - 1
        branches = np.bincount(group, changes, minlength=1)[group] > 0 if len(owner) else np.zeros(0, bool)
        if with_edges:
            again = np.zeros(len(owner), bool)
            again[later] = again[first[later]] = True
            name = (content[again] << np.uint64(16)) | (owner[again] & np.uint64(0xFFFF))
            source = first[again]
            rows = [(-1, EDGES, pack(name, doc[again], place[again], n[again], doc[source], place[source]))] if again.any() else []
        else:
            source = first[later]
            rows = span_rows(n_parts, doc[later], place[later], n[later], doc[source], place[source])
        opened = branches & ~later
        own = [doc[opened], place[opened], short(n[opened], 1), short(owner[opened], 5)]
        to = dealt_np(doc[opened], n_parts)
        return table(rows + [(p, OPEN, pack(*c, np.full(len(c[0]), part, np.int32))) for p, c in by_part(to, own)])

    return run


def first_rows(t: pa.Table, docs: np.ndarray) -> pa.Table:
    """doc_id and text of the given documents, one row each."""
    ids = t.column("doc_id").to_numpy()
    own, at = np.unique(ids, return_index=True)
    return t.select(["doc_id", "text"]).take(pa.array(at[np.isin(own, docs)]))


def rows_of(chunk: Chunk, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries sorted by ``doc``: pairs of a row of the chunk and an entry of its document."""
    lo, hi = np.searchsorted(doc, chunk.doc), np.searchsorted(doc, chunk.doc, "right")
    row = np.repeat(np.arange(len(chunk.doc)), hi - lo)
    return row, np.repeat(lo, hi - lo) + ragged_arange(hi - lo)


def sorted_by(columns: list[np.ndarray]) -> list[np.ndarray]:
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def open_branches(how: Windows, n_parts: int) -> Callable:
    """For the documents of one part: the windows of runs that are to be opened.

    Words: for buckets of their content, so that one owner spreads; repeats within a chunk go past them, as spans.
    Bytes: for the buckets of their owners.
    """

    def run(key, docs, found):
        doc, place, n, owner, bucket = sorted_by(unpack_all(of_kind(found, OPEN), np.int64, np.int32, 1, 5, np.int32))
        rows: Rows = []
        for chunk in chunks(first_rows(docs, doc).combine_chunks()):
            tokens, first, _ = tokens_of(chunk, how)
            row, own = rows_of(chunk, doc)
            length = n[own].astype(np.int64) + how.width - 1
            start = first[row] + place[own]
            inside = start + length <= first[row + 1]
            row, own, start, length = row[inside], own[inside], start[inside], length[inside]
            if how.by_word:
                sums, m = prefix_sums(tokens), length - how.width + 1
                at = np.repeat(start, m) + ragged_arange(m)
                each = [span_hash(sums, at, at + how.width), np.repeat(chunk.doc[row], m), (np.repeat(place[own], m) + ragged_arange(m)).astype(np.int32)]
                order = np.lexsort(each[::-1])
                content, d, o = (x[order] for x in each)
                later, before = repeats([content], d, o, how)
                source = before[later]
                rows += _past(span_rows(n_parts, d[later], o[later], np.ones(len(source), np.int32), d[source], o[source]), n_parts)
                part = (content[~later] % np.uint64(n_parts)).astype(np.int64)
                rows += [(p, WINDOWS, pack(*c)) for p, c in by_part(part, [content[~later], d[~later], o[~later]])]
            else:
                sub = ((owner[own] >> np.uint64(32)) % np.uint64(SUB_BUCKETS)).astype(np.uint8)
                for p, (s, m, d, o, b) in by_part(bucket[own], [start, length.astype(np.int32), chunk.doc[row], place[own], sub]):
                    rows.append((p, WINDOWS, pack(d, o, m, b) + chunk.data[np.repeat(s, m) + ragged_arange(m)].tobytes()))
        return table(rows)

    return run


def settle_words(how: Windows, n_parts: int) -> Callable:
    """For one bucket of contents: single windows that are not the first of their kind."""

    def run(key, t):
        part = key[0].as_py()
        if part >= n_parts:
            return passed_on(t, part - n_parts)
        content, doc, place = unpack_all(of_kind(t, WINDOWS), np.uint64, np.int64, np.int32)
        order = np.lexsort((place, doc, content))
        content, doc, place = content[order], doc[order], place[order]
        later, first = repeats([content], doc, place, how)
        source = first[later]
        return table(span_rows(n_parts, doc[later], place[later], np.ones(len(source), np.int32), doc[source], place[source]))

    return run


def window_classes(data: np.ndarray, starts: np.ndarray, width: int, q: int = 8) -> np.ndarray:
    """Bucket-pointer refinement: a number for each start, equal for equal strings of ``width`` bytes; -1: unlike all other positions.

    Every position points to the bucket of its q-gram. A round sorts the
    positions that share a bucket by (own pointer, pointer ``depth`` further
    on), which doubles the depth the pointers stand for; later rounds use the
    pointers that earlier ones have updated. Positions alone in a bucket are
    settled and sorted no more.
    """
    n, q = len(data), min(q, width)
    padded = np.concatenate([data, np.zeros(width + 8, np.uint8)])
    pointer = np.ndarray((n,), "<u8", padded.tobytes(), 0, (1,)) & np.uint64((1 << 8 * q) - 1)
    active = np.arange(n)
    depth = 0
    while True:
        if depth == 0:
            keys, depth = pointer, q
        else:
            step = min(depth, width - depth)
            ahead = np.minimum(active + step, n - 1)
            keys = (pointer[active].astype(np.uint64) << np.uint64(32)) | pointer[ahead].astype(np.uint64)
            depth += step
        order = np.argsort(keys)
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        bucket = np.cumsum(new)
        size = np.bincount(bucket, minlength=2)
        updated = np.arange(1, n + 1, dtype=np.int64) + len(data)  # of its own for whatever is settled
        if depth == q:
            pointer = updated
        ids = np.empty(len(keys), np.int64)
        ids[order] = np.where(size[bucket] > 1, bucket, 0)
        pointer[active] = np.where(ids > 0, ids, updated[active])
        active = active[ids > 0]
        if depth >= width or not len(active):
            break
    return np.where(pointer[starts] <= n, pointer[starts], -1)


def settle_bytes(how: Windows, n_parts: int) -> Callable:
    """For one bucket of owners: single windows whose bytes also start in a document of smaller doc_id."""

    def repeated(doc, place, length, data):
        n = length - how.width + 1
        begin = np.cumsum(length) - length
        starts = np.repeat(begin, n) + ragged_arange(n)
        doc, place = np.repeat(doc, n), (np.repeat(place, n) + ragged_arange(n)).astype(np.int32)
        kind = window_classes(data, starts, how.width)
        seen = kind >= 0
        kind, doc, place = kind[seen], doc[seen], place[seen]
        order = np.lexsort((place, doc, kind))
        kind, doc, place = kind[order], doc[order], place[order]
        later, _ = repeats([kind], doc, place, how)
        return doc[later], place[later]

    def run(key, t):
        held: dict[int, list] = {}
        for p in of_kind(t, WINDOWS):
            raw = p.as_py()
            d, o, m, b = unpack(raw, np.int64, np.int32, np.int32, np.uint8)
            text = np.frombuffer(raw, np.uint8, -1, 8 + len(d) * 17)
            at = np.cumsum(m) - m
            for sub in np.unique(b).tolist():
                own = b == sub
                held.setdefault(sub, []).append((d[own], o[own], m[own], text[np.repeat(at[own], m[own]) + ragged_arange(m[own])]))
        found = [repeated(*(np.concatenate(x) for x in zip(*held.pop(sub)))) for sub in sorted(held)]
        if not found:
            return table([])
        doc, place = (np.concatenate(x) for x in zip(*found))
        sure = np.full(len(doc), -1, np.int32)  # the refinement has compared the bytes
        return table(span_rows(n_parts, doc, place, np.ones(len(doc), np.int32), np.zeros(len(doc), np.int64), sure))

    return run


def gather(n_parts: int) -> Callable:
    """For one part: its spans, joined, and past them the source passages that it asks the parts of their documents for."""

    def run(key, t):
        part = key[0].as_py()
        doc, place, n, source, at = joined(*unpack_all(of_kind(t, SPANS), *SPAN))
        rows: Rows = [(part, SPANS, pack(doc, place, n, source, at))]
        open_ = at >= 0
        order = np.lexsort((n[open_], at[open_], source[open_]))
        ask = [source[open_][order], at[open_][order], n[open_][order]]
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = False
            for c in ask:
                new[1:] |= c[1:] != c[:-1]
        ask = [c[new] for c in ask]
        return table(rows + [(n_parts + p, ASKED, pack(*c, np.full(len(c[0]), part, np.int32))) for p, c in by_part(dealt_np(ask[0], n_parts), ask)])

    return run


def plain_bytes(chunk: Chunk, w: Words | None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a chunk as they are compared (words one space apart), and where each token begins in them, and the end."""
    if w is None:
        return chunk.data, np.arange(len(chunk.data) + 1)
    size = w.end - w.start
    begin = np.append(0, np.cumsum(size + 1))
    out = np.full(begin[-1], ord(" "), np.uint8)
    out[np.repeat(begin[:-1], size) + ragged_arange(size)] = chunk.data[np.repeat(w.start, size) + ragged_arange(size)]
    return out, begin


def fetch(how: Windows) -> Callable:
    """For the documents of one part: the passages that others ask for, packed for the askers' parts."""

    def run(key, docs, asked):
        source, at, n, part = sorted_by(unpack_all(of_kind(asked, ASKED), np.int64, np.int32, np.int32, np.int32))
        rows: Rows = []
        for chunk in chunks(first_rows(docs, source).combine_chunks()):
            _, first, w = tokens_of(chunk, how) if how.by_word else (None, chunk.off, None)
            data, begin = plain_bytes(chunk, w)
            row, own = rows_of(chunk, source)
            start = first[row] + at[own]
            stop = start + n[own] + how.width - 1
            inside = stop <= first[row + 1]
            own, lo, hi = own[inside], begin[start[inside]], begin[stop[inside]]
            for p, (s, a, m, x, y) in by_part(part[own], [source[own], at[own], n[own], lo, hi]):
                rows.append((p, PASSAGES, pack(s, a, m, y - x) + data[np.repeat(x, y - x) + ragged_arange(y - x)].tobytes()))
        return table(rows)

    return run


def compared(how: Windows, finish: Callable) -> Callable:
    """For the documents of one part: spans whose bytes equal those of their source are removed."""

    def run(key, docs, found):
        doc, place, n, source, at = sorted_by(unpack_all(of_kind(found, SPANS), *SPAN))
        passages: dict = {}
        for p in of_kind(found, PASSAGES):
            raw = p.as_py()
            s, a, m, size = unpack(raw, np.int64, np.int32, np.int32, np.int64)
            ends = 8 + len(s) * 24 + np.cumsum(size)
            view = memoryview(raw)
            passages.update({(x, y, z): view[e - k : e] for x, y, z, k, e in zip(s.tolist(), a.tolist(), m.tolist(), size.tolist(), ends.tolist())})
        out = []
        for chunk in chunks(docs.select(["doc_id", "text"]).combine_chunks()):
            _, first, w = tokens_of(chunk, how) if how.by_word else (None, chunk.off, None)
            row, own = rows_of(chunk, doc)
            start = first[row] + place[own]
            stop = start + n[own] + how.width - 1
            inside = stop <= first[row + 1]
            own, start, stop = own[inside], start[inside], stop[inside]
            same = at[own] < 0
            if not same.all():
                data, begin = plain_bytes(chunk, w)
                raw = memoryview(data.tobytes())
                for i in np.flatnonzero(~same).tolist():
                    j = own[i]
                    same[i] = passages.get((source[j], at[j], n[j])) == raw[begin[start[i]] : begin[stop[i]]]
            edge = np.zeros(first[-1] + 1, np.int64)
            np.add.at(edge, start[same], 1)
            np.add.at(edge, stop[same], -1)
            out.append(finish(chunk, w, np.cumsum(edge[:-1]) > 0))
        return pa.concat_tables(out) if out else finish(Chunk(np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64)), None, np.zeros(0, bool))

    return run


def repeated_windows(docs: DataFrame, how: Windows, finish: Callable, schema: str, compact: Callable | None = None) -> DataFrame:
    """``finish(chunk, words, gone)`` for every document, by chunks, to Arrow tables of ``schema``.

    docs: doc_id (not null) and text (not null). ``gone`` tells, for the tokens
    of the chunk, which are covered by a repeated window. compact: makes long
    spans of the runs that repeat as a whole, given as rows of ``edge_rows``.
    """
    n = part_count(docs)
    flags = stored(docs.mapInArrow(emit(how, n), PACKED).groupBy("part").applyInArrow(settle(how, n, compact is not None), PACKED), "runs")
    spans = flags.filter(F.col("kind") == SPANS)
    if compact is not None:
        spans = spans.unionByName(compact(flags.filter(F.col("kind") == EDGES), n))
    parted = docs.select("doc_id", "text", dealt(F.col("doc_id"), n).alias("part"))
    opened = parted.groupBy("part").cogroup(flags.filter(F.col("kind") == OPEN).groupBy("part")).applyInArrow(open_branches(how, n), PACKED)
    spans = spans.unionByName(opened.groupBy("part").applyInArrow(settle_words(how, n) if how.by_word else settle_bytes(how, n), PACKED))
    found = stored(spans.groupBy("part").applyInArrow(gather(n), PACKED), "spans")
    asked = found.filter(F.col("kind") == ASKED).withColumn("part", F.col("part") - n)
    passages = parted.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(fetch(how), PACKED)
    told = found.filter(F.col("kind") == SPANS).unionByName(passages)
    return parted.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(compared(how, finish), schema)

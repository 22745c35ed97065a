"""Suffix-array dedup: long repeats across documents by matching statistics over run-length indexes."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, lean, shuffle_tasks
from .runindex import gather, repeats

#: Bytes a repeat must have, a multiple of seven and one more.
LENGTH = 50
#: Bytes of a fingerprint; every repeat holds LENGTH - GRAM + 1 of them, and the one of the
#: smallest hash, which all its copies share.
GRAM = 24
#: The most windows of a stretch; longer ones, of periodic text, are cut.
WINDOWS = 64
#: Bytes and rows of a block (a longer text is a block of its own), fingerprints in a shard of
#: the count, and bytes of text for each index.
BLOCK, ROWS, FINGERPRINTS, INDEX = 8 << 20, 1 << 16, 1 << 20, 8 << 20
#: A fingerprint is hot with so many stretches; blocks count theirs up to MANY.
HOT, MANY = 2048, 64

_M1, _M2, _M3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def _pack(raw: bytes) -> bytes:
    """Compressed, but for short ones; the first byte tells."""
    import zstandard

    return b"\1" + zstandard.ZstdCompressor(level=3).compress(raw) if len(raw) > 256 else b"\0" + raw


def _unpack(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw[1:]) if raw[:1] == b"\1" else raw[1:]


def _mix(h):
    import numpy as np

    h = h * np.uint64(_M2)
    h ^= h >> np.uint64(29)
    h *= np.uint64(_M3)
    h ^= h >> np.uint64(32)
    return h


def regions(body: bytes, sizes):
    """Maximal runs of window starts with one minimiser: start, windows, document, fingerprint.

    Windows of LENGTH bytes inside one document; the fingerprint of a window is the smallest
    hash of its GRAM-byte substrings."""
    import numpy as np

    found = []
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):  # about a megabyte at a time
        begin = int(ends[lo] - sizes[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, begin + (1 << 20))))
        found.append(_regions(body, begin, int(ends[hi - 1]), ends[lo:hi], lo))
        lo = hi
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _regions(body, begin, end, ends, first):
    import numpy as np

    n = end - begin
    if n < LENGTH:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    words = np.ndarray((n - 7,), "<u8", body, begin, (1,))
    m = n - GRAM + 1
    h = _gram(words[:m], words[8 : 8 + m], words[16 : 16 + m])
    width, span = LENGTH - GRAM + 1, 1
    least = h
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    count = n - LENGTH + 1
    if span < width:
        least = np.minimum(least[:count], least[width - span : width - span + count])
    stops = ends - begin
    begins = np.concatenate(([0], stops[:-1]))
    change = np.empty(count, bool)
    change[0] = True
    np.not_equal(least[1:], least[:-1], out=change[1:])
    for edge in (begins, np.maximum(begins, stops - LENGTH + 1)):  # documents, and the ends that no window starts in
        change[edge[edge < count]] = True
    at = np.flatnonzero(change)
    size = np.diff(np.append(at, count))
    doc = np.searchsorted(stops, at, "right")
    keep = at + LENGTH <= stops[doc]
    at, size, doc = at[keep], size[keep], doc[keep]
    return begin + at, size, first + doc, _mix(least[at])


def _gram(first, second, third):
    """Hashes of GRAM bytes, given as three words."""
    import numpy as np

    h = first * np.uint64(_M1)
    h ^= h >> np.uint64(29)
    h += second * np.uint64(_M2)
    h ^= h >> np.uint64(31)
    h *= np.uint64(_M3)
    h += third * np.uint64(_M1)
    h ^= h >> np.uint64(30)
    h *= np.uint64(_M2)
    h ^= h >> np.uint64(32)
    return h


def _divided(body: bytes, start, windows, doc, value):
    """Stretches around a hot fingerprint, divided into runs of windows with one second smallest
    hash too, which all copies of a window share as well; with values of both."""
    import numpy as np

    words = np.ndarray((len(body) - 7,), "<u8", body, 0, (1,))
    found = []
    share = np.cumsum(windows) // (1 << 15)
    for k in np.unique(share):
        part = np.flatnonzero(share == k)
        w = windows[part]
        of = np.repeat(part, w)
        at = np.repeat(start[part] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
        grams = at[:, None] + np.arange(LENGTH - GRAM + 1)
        h = _gram(words[grams], words[grams + 8], words[grams + 16])
        least = h.min(1)
        h[h == least[:, None]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        second = h.min(1)
        f = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (second[1:] != second[:-1]))))
        found.append((at[f], np.diff(np.append(f, len(at))), doc[of[f]], _mix(value[of[f]] ^ (second[f] * np.uint64(_M2)))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _content(body: bytes, start, length):
    """64-bit hashes of many stretches of ``body``: polynomial sums of byte values drawn at random."""
    import numpy as np

    values = np.random.default_rng(23).integers(1, 1 << 63, 256, np.uint64)
    b = np.frombuffer(body, np.uint8)
    out = np.empty(len(start), np.uint64)
    step = 1 << 20
    power = np.cumprod(np.full(step * 2, _M1, np.uint64))
    inverse = np.cumprod(np.full(step * 2, pow(_M1, -1, 1 << 64), np.uint64))
    block = start // step
    for k in np.unique(block):
        rows = np.flatnonzero(block == k)
        lo, hi = int(k) * step, int((start[rows] + length[rows]).max())
        if hi - lo > len(power):
            power, inverse = (np.cumprod(np.full(hi - lo, x, np.uint64)) for x in (_M1, pow(_M1, -1, 1 << 64)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[b[lo:hi]] * power[: hi - lo])))
        s = start[rows] - lo
        out[rows] = (sums[s + length[rows]] - sums[s]) * inverse[s]
    return _mix(out ^ length.astype(np.uint64) * np.uint64(_M3))


def _blocks(docs: DataFrame, carry: list[str]) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        held, sizes, texts, number, total = [], [], [], 0, 0

        def block():
            ids = pa.concat_arrays([x.column(0) for x in held])
            sink = pa.BufferOutputStream()
            rows = pa.Table.from_batches([x.select([0, *range(2, x.num_columns)]) for x in held]).combine_chunks()
            with pa.ipc.new_stream(sink, rows.schema) as w:
                w.write_table(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([part + number]), pa.array([total]), pa.array([len(ids)]), pa.array([_pack(sink.getvalue().to_pybytes())]), pa.array([sizes], pa.list_(pa.int64())), pa.array([_pack(b"".join(texts))])],
                names=["block", "n_bytes", "n_texts", "carried", "sizes", "body"],
            )

        for b in batches:
            lo = 0
            for i, x in enumerate(b.column(1)):
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                if sizes and (total + len(raw) > BLOCK or len(sizes) >= ROWS):
                    if i > lo:
                        held.append(b.slice(lo, i - lo))
                    yield block()
                    lo, held, sizes, texts, number, total = i, [], [], [], number + 1, 0
                sizes.append(len(raw))
                texts.append(raw)
                total += len(raw)
            if b.num_rows > lo:
                held.append(b.slice(lo))
        if sizes:
            yield block()

    return docs.mapInArrow(lean(run), "block long, n_bytes long, n_texts long, carried binary, sizes array<long>, body binary")


def _fingerprints(shards: int):
    """Per block and shard of the hash range: the lower four bytes of the distinct fingerprints,
    in order (the shard tells the upper bits; a chance equal only makes a candidate), and bits of those that several documents and of those that MANY stretches have. Rows
    are no more than fingerprints."""

    def run(batches):
        import numpy as np

        for b in batches:
            for block, sizes, body in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                _, _, doc, value = regions(_unpack(body.as_buffer().to_pybytes()), sizes.values.to_numpy())
                if not len(value):
                    continue
                order = np.argsort(value)
                value, doc = value[order], doc[order]
                first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
                several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
                many = np.diff(np.append(first, len(value))) >= MANY
                value = value[first]
                shard = _shard(value, shards)
                low = value.astype(np.uint32)
                cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
                rows = [(int(shard[lo]), block, low[lo:hi].tobytes(), np.packbits(several[lo:hi]).tobytes(), np.packbits(many[lo:hi]).tobytes() if many[lo:hi].any() else None) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["shard", "block", "hashes", "several", "many"])

    return lean(run)


def _shard(value, shards: int):
    """Shards as equal ranges of hashes, so that sorted hashes have sorted shards."""
    import numpy as np

    return ((value >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _shared(key, group: pa.Table) -> pa.Table:
    """For each block those of its fingerprints of a shard that another document has, and the
    hot ones among them."""
    import numpy as np

    n = np.array([len(x.as_buffer()) // 4 for x in group["hashes"]])
    bits = lambda c: np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=k).astype(bool) if x.is_valid else np.zeros(k, bool) for x, k in zip(group[c], n, strict=True)])
    value = np.frombuffer(b"".join(x.as_py() for x in group["hashes"]), np.uint32)
    order = np.argsort(value)
    s = value[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    size = np.diff(np.append(first, len(s)))
    weight = 1 + (MANY - 1) * bits("many")[order].astype(np.int64)
    state = ((size > 1) | np.maximum.reduceat(bits("several")[order], first)).astype(np.uint8)
    state += state * (np.add.reduceat(weight, first) >= HOT)
    each = np.empty(len(s), np.uint8)
    each[order] = np.repeat(state, size)
    cut = np.cumsum(n) - n
    out = [[value[c : c + k][each[c : c + k] >= least].tobytes() for c, k in zip(cut, n, strict=True)] for least in (1, 2)]
    return pa.table({"block": group["block"], "shared": pa.array(out[0], pa.binary()), "hot": pa.array(out[1], pa.binary())})


def _candidates(indexes: int):
    """Per block: the distinct stretches around shared fingerprints, dealt over indexes by
    fingerprint, each with its smallest document, and (index -1) where they stand in the block."""

    def run(key, block: pa.Table, answers: pa.Table) -> pa.Table:
        import numpy as np

        schema = pa.schema([("target", pa.int64()), ("part", pa.int64()), ("block", pa.int64()), ("own", pa.binary()), ("body", pa.binary())])
        if not block.num_rows or not answers.num_rows:
            return pa.table([[], [], [], [], []], schema=schema)
        body, sizes = _unpack(block["body"][0].as_py()), np.asarray(block["sizes"][0].as_py(), np.int64)
        shared, hot = (np.sort(np.frombuffer(b"".join(x.as_py() for x in answers[c]), np.uint32)) for c in ("shared", "hot"))
        ids, known = _ids(block["carried"][0].as_py())

        def among(value, some):
            low = value.astype(np.uint32)
            return some[np.minimum(np.searchsorted(some, low), len(some) - 1)] == low if len(some) else np.zeros(len(value), bool)

        start, windows, doc, value = regions(body, sizes)
        keep = among(value, shared) & known[doc] if len(value) else np.empty(0, bool)
        start, windows, doc, value = start[keep], windows[keep], doc[keep], value[keep]
        split = among(value, hot)
        if split.any():
            parts = _divided(body, start[split], windows[split], doc[split], value[split])
            start, windows, doc, value = (np.concatenate((x[~split], y)) for x, y in zip((start, windows, doc, value), parts, strict=True))
        pieces = -(-windows // WINDOWS)
        if len(pieces) and pieces.max() > 1:
            of = np.repeat(np.arange(len(pieces)), pieces)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, windows, doc, value = start[of] + nth * WINDOWS, np.minimum(WINDOWS, windows[of] - nth * WINDOWS), doc[of], value[of]
        length = windows + LENGTH - 1
        content = _content(body, start, length)
        # Sorted by index first, then content: equal stretches are next to each other, but for
        # those between which others with the same bits in the key fall, which only stay apart.
        target = (_mix(value) % np.uint64(indexes)).astype(np.int64)
        order = np.argsort((target.astype(np.uint64) << np.uint64(40)) | (content >> np.uint64(24)))
        start, windows, length, content, target, doc, value = (x[order] for x in (start, windows, length, content, target, doc, value))
        head = np.concatenate(([True], (content[1:] != content[:-1]) | (target[1:] != target[:-1])))[: len(start)]
        f = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        owner = np.minimum.reduceat(ids[doc], f) if len(f) else np.empty(0, np.int64)
        ft = target[f]
        place = np.argsort(start)
        rows = [(-1, _pack(np.diff(start[place], prepend=0).astype(np.int32).tobytes() + group[place].astype(np.int32).tobytes() + windows[place].astype(np.uint8).tobytes()), None)] if len(f) else []
        cut = np.flatnonzero(np.concatenate(([True], ft[1:] != ft[:-1], [True]))) if len(f) else []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            pick = f[a:b]
            rows.append((int(ft[a]), _pack(owner[a:b].tobytes() + value[pick].astype(np.uint32).tobytes() + length[pick].astype(np.uint8).tobytes()), _pack(gather(body, start[pick], length[pick]))))
        own = key[0].as_py()
        return pa.table([[x[0] for x in rows], [own if x[0] < 0 else 0 for x in rows], [own] * len(rows), [x[1] for x in rows], [x[2] for x in rows]], schema=schema)

    return run


def _ids(carried: bytes):
    """The document ids of a block and whether they are known (null ids take no part)."""
    import numpy as np

    column = pa.ipc.open_stream(_unpack(carried)).read_all().column(0).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _matched(key, group: pa.Table) -> pa.Table:
    """Which windows of all blocks' stretches a smaller document has, for each block: bits of
    stretches that a smaller document has as they are, then runs of windows of the others. Where
    stretches stand in a block passes through."""
    import numpy as np

    if key[0].as_py() < 0:
        return pa.table({"block": group["block"], "target": group["target"], "found": group["own"]})
    parts = [_unpack(x.as_py()) for x in group["own"]]
    n = np.array([len(x) // 13 for x in parts])
    owner = np.concatenate([np.frombuffer(x, np.int64, k) for x, k in zip(parts, n, strict=True)])
    value = np.concatenate([np.frombuffer(x, np.uint32, k, 8 * k) for x, k in zip(parts, n, strict=True)])
    length = np.concatenate([np.frombuffer(x, np.uint8, k, 12 * k) for x, k in zip(parts, n, strict=True)]).astype(np.int64)
    body = b"".join(_unpack(x.as_py()) for x in group["body"])
    start = np.cumsum(length) - length
    content = _content(body, start, length)
    order = np.lexsort((owner, content))
    c = content[order]
    head = np.concatenate(([True], c[1:] != c[:-1]))
    first = order[np.flatnonzero(head)]  # one of each content, of its smallest owner
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(head) - 1
    later = owner > owner[first][inverse]
    del parts, content, c, head, order
    found = repeats(body, start[first], length[first], owner[first], value[first], LENGTH)
    windows = (length[first] - LENGTH + 1).astype(np.int64)
    edge = np.diff(np.concatenate(([0], found.astype(np.int8), [0])))
    # Runs of marked windows of each distinct stretch, cut where stretches end.
    bounds = np.cumsum(windows)
    inner = bounds[:-1][found[bounds[:-1]] & found[bounds[:-1] - 1]] if len(bounds) > 1 else bounds[:0]
    begins = np.union1d(np.flatnonzero(edge == 1), inner)
    stops = np.union1d(np.flatnonzero(edge == -1), inner)
    of = np.searchsorted(bounds, begins, "right")
    runs = np.bincount(of, minlength=len(first))
    at = np.cumsum(runs) - runs
    begins, size = begins - (bounds - windows)[of], stops - begins
    out, done = [], 0
    for k in n:
        which, all_of = inverse[done : done + k], later[done : done + k]
        done += k
        own = np.where(all_of, 0, runs[which])
        stretch = np.repeat(np.arange(k), own)
        run = np.repeat(at[which] - (np.cumsum(own) - own), own) + np.arange(len(stretch))
        out.append(_pack(np.int32([k, len(run)]).tobytes() + np.packbits(all_of).tobytes() + stretch.astype(np.int32).tobytes() + begins[run].astype(np.uint8).tobytes() + size[run].astype(np.uint8).tobytes()))
    return pa.table({"block": group["block"], "target": group["target"], "found": pa.array(out, pa.binary())})


def _removed(schema: pa.Schema):
    """Per block: cover what matches a smaller document, and give each text's remainder."""

    def run(key, block: pa.Table, answers: pa.Table) -> pa.Table:
        import numpy as np

        if not block.num_rows:
            return pa.Table.from_batches([], schema)
        body, sizes = _unpack(block["body"][0].as_py()), np.asarray(block["sizes"][0].as_py(), np.int64)
        carried = pa.ipc.open_stream(_unpack(block["carried"][0].as_py())).read_all().combine_chunks()
        ids, _ = _ids(block["carried"][0].as_py())
        found = sorted(zip(answers["target"].to_pylist(), answers["found"].to_pylist(), strict=True))
        cover = np.zeros(len(body) + 1, np.int32)
        if found:
            raw = _unpack(found[0][1])
            n = len(raw) // 9
            start, group = np.cumsum(np.frombuffer(raw, np.int32, n), dtype=np.int64), np.frombuffer(raw, np.int32, n, 4 * n).astype(np.int64)
            windows = np.frombuffer(raw, np.uint8, n, 8 * n).astype(np.int64)
            gone, stretch, begins, size, done = [], [], [], [], 0
            for _, raw in found[1:]:
                raw = _unpack(raw)
                k, m = (int(x) for x in np.frombuffer(raw, np.int32, 2))
                at = 8 + (k + 7) // 8
                gone.append(np.unpackbits(np.frombuffer(raw, np.uint8, (k + 7) // 8, 8), count=k).astype(bool))
                stretch.append(np.frombuffer(raw, np.int32, m, at).astype(np.int64) + done)
                begins.append(np.frombuffer(raw, np.uint8, m, at + 4 * m))
                size.append(np.frombuffer(raw, np.uint8, m, at + 5 * m))
                done += k
            gone, stretch = np.concatenate(gone), np.concatenate(stretch)
            begins, size = np.concatenate(begins).astype(np.int64), np.concatenate(size).astype(np.int64)
            own = ids[np.searchsorted(np.cumsum(sizes), start, "right")]
            least = np.full(done, np.iinfo(np.int64).max)
            np.minimum.at(least, group, own)
            whole = gone[group] | (own > least[group])
            np.add.at(cover, start[whole], 1)
            np.add.at(cover, start[whole] + windows[whole] + LENGTH - 1, -1)
            # Runs of windows of the other stretches, wherever those stand.
            runs = np.bincount(stretch, minlength=done)
            first = np.cumsum(runs) - runs
            rest = np.flatnonzero(~whole)
            k = runs[group[rest]]
            occurrence = np.repeat(rest, k)
            r = np.repeat(first[group[rest]] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            begin = start[occurrence] + begins[r]
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + size[r] + LENGTH - 1, -1)
        covered = np.cumsum(cover[:-1]) > 0
        doc_of_end = np.cumsum(sizes)
        edge = np.diff(np.concatenate(([0], covered.astype(np.int8))))
        begins = np.flatnonzero(edge == 1)
        # A run also ends where its document does.
        limits = doc_of_end - sizes
        limits = limits[(limits < len(body)) & (limits > 0)]
        limits = limits[covered[limits] & covered[limits - 1]]
        begins = np.unique(np.concatenate((begins, limits)))
        stops = np.unique(np.concatenate((np.flatnonzero(edge == -1), limits, [len(body)] if len(body) and covered[-1] else np.empty(0, np.int64)))).astype(np.int64)
        doc_of = np.searchsorted(doc_of_end, begins, "right")
        per_doc = np.bincount(doc_of, minlength=len(sizes))
        base = (doc_of_end - sizes)[doc_of]
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_doc))).astype(np.int32)), pa.StructArray.from_arrays([pa.array(begins - base, pa.int64()), pa.array(stops - base, pa.int64())], names=["start", "end"]))
        total = np.concatenate(([0], np.cumsum(covered)))
        removed = total[doc_of_end] - total[doc_of_end - sizes]
        rest = np.frombuffer(body, np.uint8)[~covered].tobytes()
        offsets = np.concatenate(([0], np.cumsum(sizes - removed))).astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rest)])
        columns = [*carried.columns, pa.array(sizes), pa.array(removed.astype(np.int64)), spans, kept]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row's ``id_col``, the columns ``carry``, and ``n_bytes, n_removed`` (longs),
    ``spans`` (removed runs of bytes, start and end) and ``kept`` (the remaining bytes).

    A byte of the UTF-8 text is removed if a 50-byte string that covers it also starts in a row
    with a smaller id; strings do not cross rows, overlaps count, and strings are judged on the
    input. Null text has no bytes. Rows with null ids take no part: nothing is taken from them
    or because of them. Rows with one id take nothing from each other. ``carry`` may not hold the names above. An empty table gives
    an empty one. Hashes of 64 bits decide what is equal where stretches are collected.

    Method. Texts lie in blocks of about BLOCK bytes. Every repeat of 50 bytes has a minimiser
    that all copies share. Blocks send their distinct minimisers to shards of the hash range,
    which answer which ones several documents have. The stretches of text around those go to
    an index by minimiser (where one is hot, by it and the next smallest hash), each distinct one
    of a block once with its smallest document; so all copies of a 50-byte string meet. There, in
    rounds, the stretches of smaller documents are indexed by the runs of their Burrows-Wheeler
    transform with samples at run ends, and those of larger ones streamed through it: a window is
    marked where its matching statistics reach 50 symbols at a place of a smaller document (see
    ``runindex.repeats``). Blocks get the marks as runs and cover their bytes. Texts of any length
    are whole: one longer than BLOCK is a block of its own, and is held by one task.

    Plan: blocks are written once, bucketed by their number, and read where they lie by both
    passes over them; what is shuffled are fingerprints (four bytes for some 14 of text), stretches
    of repeated text and marks. Rows of a shuffle are never more than fingerprints or stretches.
    Nothing is collected by the driver; the number of shards and indexes follows the input.
    """
    carry = [c for c in carry or [] if c != id_col]
    own = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col), *(F.col(c).alias(c) for c in carry))
    own = own.toDF(id_col, "\0text", *carry)
    tasks = shuffle_tasks(docs.sparkSession)
    blocks = bucketed(_blocks(own, carry), "block", 2 * tasks)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    shards, indexes = max(8, math.ceil(total / 12 / FINGERPRINTS)), max(tasks, math.ceil(total / INDEX))
    prints = blocks.select("block", "sizes", "body").mapInArrow(_fingerprints(shards), "shard int, block long, hashes binary, several binary, many binary")
    shared = prints.groupBy("shard").applyInArrow(lean(_shared), "block long, shared binary, hot binary")
    renamed = shared.select(F.col("block").alias("to"), "shared", "hot")
    found = blocks.select("block", "sizes", "body", "carried").groupBy("block").cogroup(renamed.groupBy("to")).applyInArrow(lean(_candidates(indexes)), "target long, part long, block long, own binary, body binary")
    answers = found.groupBy("target", "part").applyInArrow(lean(_matched), "block long, target long, found binary").withColumnRenamed("block", "to")
    fields = own.select(id_col, *carry)
    result = fields.withColumns({"n_bytes": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<start:bigint,end:bigint>>"), "kept": F.lit(None).cast("binary")}).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(result)
    return blocks.select("block", "sizes", "body", "carried").groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(lean(_removed(schema)), result)


#: The contract of ``dedup_substrings`` for DuckDB, by grouping all strings of 50 bytes, with the rest as a digest.
ORACLE = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, h, len(h) // 2 AS n FROM h),
z AS (SELECT doc_id, n, c, substring(h, 1000 * c + 1, 1098) AS piece FROM (SELECT doc_id, h, n, unnest(range((n - 49 + 499) // 500)) AS c FROM g WHERE n >= 50)),
o AS (SELECT doc_id, 500 * c + j AS i, substring(piece, 2 * j + 1, 100) AS s FROM (SELECT doc_id, c, piece, unnest(range(least(500, n - 49 - 500 * c))) AS j FROM z)),
f AS (SELECT s, min(doc_id) AS first FROM o GROUP BY s HAVING min(doc_id) < max(doc_id)),
m AS (SELECT doc_id, i FROM o JOIN f USING (s) WHERE doc_id > first),
q AS (SELECT doc_id, i, lag(i) OVER w AS before, lead(i) OVER w AS after FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT doc_id, i AS lo, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM q WHERE before IS NULL OR i > before + 50),
v AS (SELECT doc_id, i + 50 AS hi, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM q WHERE after IS NULL OR after > i + 50),
x AS (SELECT doc_id, k, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY k), 0) AS since FROM u JOIN v USING (doc_id, k)),
y AS (SELECT x.doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last, string_agg(substring(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY k) AS kept FROM x JOIN g ON g.doc_id = x.doc_id GROUP BY x.doc_id)
SELECT g.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM g LEFT JOIN y ON y.doc_id = g.doc_id
"""

"""Suffix-array dedup: later copies of long byte strings go, the first stays.

A byte is removed if a string of ``length`` bytes that covers it also starts in a
document with a smaller id. Suffixes that share their first ``length`` bytes
share an anchor there: the position whose hashed ``gram`` is smallest in the
window. So suffixes are dealt by anchor; each anchor stands for the suffixes that
start at most ``length - gram`` bytes before it, and for the bytes around it.

1. Equal texts are one text with the smallest id; its copies go whole.
2. Tasks find anchors and send packed arrays (anchor hash, hash of the bytes
   around it, place) to hash ranges. An anchor of one document has no earlier
   match. Equal surroundings are one suffix group held by its first document;
   in the others everything around the anchor is matched. What remains, one
   place per surrounding, needs its bytes; its twins, the further places of the
   same text with these surroundings, get the spans found for it.
3. The bytes of these places are sorted as suffixes. In suffix order the previous
   and the next suffix of a smaller document give the longest previous factor:
   the longest match that starts in an earlier document. From ``length`` on it
   is removed.

An anchor with many surroundings (a common phrase) is split: each of its windows
is dealt by its own hash, and windows equal within a task meet there first. The
number of ranges follows the bytes counted, so no task holds more than a few tens
of megabytes. Tables of spans and copies are broadcast below a checked size and
joined by shuffle beyond it.

Cases: null text is empty; a text shorter than ``length`` loses nothing; rows
without id come after all others and do not shorten one another; rows that
repeat an id do not shorten one another, each keeps its own text; an empty table
gives an empty result; other columns are not read. Ids must be integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.llm.common import arrow_bytes, mix64, parallelism, pieces, power_of_two, small, stage
from hazardlake.llm.shingles import powers

LENGTH, GRAM = 50, 24
PIECE = 512 << 10
MESSAGE_PLACES = 200_000
RANGE_BYTES = 4 << 20  # text bytes whose anchors form one range
SPLIT = 4096  # surroundings of one anchor beyond which its windows are dealt one by one
NO_ID = (1 << 63) - 1
TABLE = mix64(np.arange(1, 257).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
REQUEST = np.dtype([("h", "<u8"), ("pos", "<i4"), ("lead", "<i4"), ("split", "<i4")])  # a twin has another lead than itself


def sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every ``width`` neighbours, by doubling."""
    step, out = 1, a
    while step * 2 <= width:
        out = op(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` values from each place on, put together from powers of two."""
    level, size, done, have = values, 1, None, 0
    while True:
        if gram & size:
            if done is None:
                done, have = level, size
            else:  # the shorter part comes first
                factor = np.uint64(pow(0xD1342543DE82EF95, size, 1 << 64))
                n = len(level) - have
                done, have = done[:n] * factor + level[have:], have + size
        size *= 2
        if size > gram:
            return mix64(done)
        factor = np.uint64(pow(0xD1342543DE82EF95, size // 2, 1 << 64))
        level = level[: -(size // 2)] * factor + level[size // 2 :]


def chosen(h: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Places whose hash is the smallest of a window of ``length`` items inside one document."""
    width = length - gram + 1
    low = sliding(h, width, np.minimum)  # one per window start
    ends = np.zeros(len(low) + 1, np.int64)
    sizes = np.diff(offsets)
    np.add.at(ends, offsets[:-1][sizes >= length], 1)
    np.add.at(ends, offsets[1:][sizes >= length] - length + 1, -1)
    low[np.cumsum(ends[:-1]) == 0] = 0  # windows that cross documents
    around = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    return np.nonzero(sliding(around, width, np.maximum)[: len(h)] == h)[0]


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Places that are the smallest gram of a window: document, position, gram hash, hash of the surroundings."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    if len(raw) < length:
        return none
    values = TABLE[raw]
    h = gram_hashes(values, gram)
    at = chosen(h, offsets, length, gram)
    doc = np.searchsorted(offsets, at, "right") - 1
    start, end = offsets[doc], offsets[doc + 1]
    a, b = np.maximum(start, at - (length - gram)), np.minimum(end, at + length)
    up, down = powers(max(16, int(len(raw) - 1).bit_length()))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(raw)])])
    near = mix64((upto[b] - upto[a]) * down[a] + (at - a).astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + (b - at).astype(np.uint64))
    return doc, at - start, h[at], near >> np.uint64(16)


def pack(doc, sub, who, pos, h, near) -> bytes:
    """One message to a range; ``who`` counts into doc and sub."""
    used, who = np.unique(who, return_inverse=True)
    head = np.array([len(used), len(pos)], np.int64)
    low, high = near.astype(np.uint32), (near >> np.uint64(32)).astype(np.uint16)
    parts = [head, doc[used], sub[used].astype(np.int32), np.bincount(who, minlength=len(used)).astype(np.int32), h, low, pos.astype(np.int32), high]
    return b"".join(p.tobytes() for p in parts)


def messages(doc: np.ndarray, sub: np.ndarray, found, bits: int) -> Iterator[pa.RecordBatch]:
    """Messages to the ranges from (first document, who, pos, h, near) pieces, a few megabytes at a time."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        who, pos, h, near = (np.concatenate(x) for x in zip(*held))
        # by the last bits: anchors are the smallest of their window, so most of their first bits are zeros
        to = (h & np.uint64((1 << bits) - 1)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange((1 << bits) + 1))
        used = np.nonzero(np.diff(cut))[0]
        sent = [pack(doc, sub, *(x[order[cut[r] : cut[r + 1]]] for x in (who, pos, h, near))) for r in used]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sent, pa.binary())], names=["r", "message"])

    for first, who, pos, h, near in found:
        held.append((who + first, pos, h, near))
        if sum(len(x[0]) for x in held) >= MESSAGE_PLACES:
            yield flush()
    if held:
        yield flush()
    pa.default_memory_pool().release_unused()


def unpack(message: bytes):
    m, n = np.frombuffer(message, np.int64, 2)
    at, out = 16, []
    for kind, k in (("<i8", m), ("<i4", m), ("<i4", m), ("<u8", n), ("<u4", n), ("<i4", n), ("<u2", n)):
        out.append(np.frombuffer(message, kind, int(k), at))
        at += int(k) * np.dtype(kind).itemsize
    doc, sub, count, h, low, pos, high = out
    near = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
    return np.repeat(doc, count), np.repeat(sub, count), h, near, pos


def nearest_smaller(doc: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Common prefix with the previous suffix of a smaller document; lcp[i] joins i - 1 and i.

    Pointers jump over suffixes that are not smaller; a jump carries the
    smallest common prefix on its way and ends below ``least``.
    """
    n = len(doc)
    to, reach = np.arange(n) - 1, lcp.copy()
    reach[:1] = 0
    while True:
        on = np.nonzero((to >= 0) & (reach >= least) & (doc[np.maximum(to, 0)] >= doc))[0]
        if not len(on):
            return np.where((to >= 0) & (reach >= least), reach, 0)
        via = to[on]
        reach[on], to[on] = np.minimum(reach[on], reach[via]), to[via]


def previous_factors(key: np.ndarray, doc: np.ndarray, texts: list[bytes], n_starts: np.ndarray, length: int):
    """Segment, offset and longest previous factor of the suffixes that have one of ``length`` or more.

    Suffixes are compared within one key; each text gives its first ``n_starts``.
    """
    size = np.array([len(t) for t in texts])
    width = int(size.max())
    flat = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size)])
    seg = np.repeat(np.arange(len(texts)), n_starts)
    off = np.arange(len(seg)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
    left = size[seg] - off
    # rows: key, then the suffix padded with zeros
    rows = np.zeros((len(seg), 8 + width), np.uint8)
    rows[:, :8] = key[seg].astype(">u8").view(np.uint8).reshape(-1, 8)
    take = np.arange(width)[None, :]
    place = np.minimum((begin[seg] + off)[:, None] + take, len(flat) - 1)
    rows[:, 8:] = np.where(take < left[:, None], flat[place], 0)
    order = np.argsort(rows.view(f"V{8 + width}").ravel().view(f"S{8 + width}"), kind="stable")
    rows, left, who = rows[order], left[order], doc[seg][order]
    same = rows[1:] == rows[:-1]
    lcp = np.where(same.all(axis=1), 8 + width, same.argmin(axis=1)) - 8
    lcp = np.concatenate([[0], np.minimum(lcp, np.minimum(left[1:], left[:-1]))])
    back = nearest_smaller(who, lcp, length)
    ahead = nearest_smaller(who[::-1], np.concatenate([[0], lcp[1:][::-1]]), length)[::-1]
    factor = np.maximum(back, ahead)
    hit = factor >= length
    return seg[order][hit], off[order][hit], factor[hit]


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, joined (start, end) rows."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    at = np.nonzero(new)[0]
    return np.stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]], axis=1)


def by_document(doc: np.ndarray, sub: np.ndarray):
    """Groups of equal (doc, sub): order and bounds."""
    order = np.lexsort((sub, doc))
    d, s = doc[order], sub[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    return order, np.append(np.nonzero(new)[0], len(d))


FOUND = "doc long, sub int, spans binary, wanted binary"


def found_table(doc, sub, spans, w_doc, w_sub, wanted) -> pa.Table:
    """Rows of spans (start, end) and of requests, one per document and kind."""
    out: dict[str, list] = {"doc": [], "sub": [], "spans": [], "wanted": []}

    def put(doc, sub, spans, wanted):
        for c, v in zip(out.values(), (doc.tolist(), sub.tolist(), spans, wanted)):
            c.extend(v)

    def cut_bytes(a: np.ndarray, at: np.ndarray) -> list[bytes]:
        raw, size = a.tobytes(), a.nbytes // len(a)
        return [raw[x * size : y * size] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]

    if len(doc):
        order, cut = by_document(doc, sub)
        n = len(cut) - 1
        all_spans = merged(spans[order] + (np.repeat(np.arange(n), np.diff(cut)) << 32)[:, None])  # documents apart
        at = np.searchsorted(all_spans[:, 0] >> 32, np.arange(n + 1))
        put(doc[order[cut[:-1]]], sub[order[cut[:-1]]], cut_bytes((all_spans & 0xFFFFFFFF).astype(np.int32), at), [None] * n)
    if len(w_doc):
        order, cut = by_document(w_doc, w_sub)
        put(w_doc[order[cut[:-1]]], w_sub[order[cut[:-1]]], [None] * (len(cut) - 1), cut_bytes(wanted[order], cut))
    return pa.table(
        [pa.array(out["doc"], pa.int64()), pa.array(out["sub"], pa.int32()), pa.array(out["spans"], pa.binary()), pa.array(out["wanted"], pa.binary())],
        names=["doc", "sub", "spans", "wanted"],
    )


def match_anchors(messages: list[bytes], length: int, gram: int) -> pa.Table:
    """What the anchors of one range say: spans that are matched already and places whose bytes are needed."""
    doc, sub, h, near, pos = (np.concatenate(x) for x in zip(*[unpack(m) for m in messages]))
    order = np.argsort(h, kind="stable")
    again = np.zeros(len(h), bool)
    twin = h[order][1:] == h[order][:-1]
    again[1:] |= twin
    again[:-1] |= twin
    keep = order[again]
    doc, sub, h, near, pos = doc[keep], sub[keep], h[keep], near[keep], pos[keep].astype(np.int64)
    order = np.lexsort((pos, sub, doc, near, h))
    doc, sub, h, near, pos = doc[order], sub[order], h[order], near[order], pos[order]
    n = len(h)
    if not n:
        none = np.zeros(0, np.int64)
        return found_table(none, none, np.zeros((0, 2), np.int64), none, none, np.zeros(0, REQUEST))
    anchor = np.ones(n, bool)
    anchor[1:] = h[1:] != h[:-1]
    group = anchor.copy()
    group[1:] |= near[1:] != near[:-1]
    head = np.nonzero(group)[0]
    leader = doc[head][np.cumsum(group) - 1]
    later = doc > leader
    spans = np.stack([np.maximum(pos - (length - gram), 0), pos + length], axis=1)[later]
    # groups of one anchor: bytes are needed where several documents lead
    of = (np.cumsum(anchor) - 1)[head]
    lead = doc[head]
    low, high = np.full(of[-1] + 1, NO_ID, np.int64), np.full(of[-1] + 1, -(1 << 63), np.int64)
    np.minimum.at(low, of, lead)
    np.maximum.at(high, of, lead)
    ask = (low < high)[of]
    wide = np.bincount(of)[of] > SPLIT
    # every place of the leading document asks; inside one text the first stands for its twins
    first = group.copy()
    first[1:] |= (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])
    first = pos[np.nonzero(first)[0]][np.cumsum(first) - 1]
    to = np.cumsum(group) - 1
    asks = ask[to] & ~later
    wanted = np.zeros(int(asks.sum()), REQUEST)
    wanted["h"], wanted["pos"], wanted["lead"], wanted["split"] = h[asks], pos[asks], first[asks], wide[to][asks]
    return found_table(doc[later], sub[later], spans, doc[asks], sub[asks], wanted)


def window_keys(windows: np.ndarray) -> np.ndarray:
    """Hash of every row of bytes."""
    up, _ = powers(16)
    return mix64((TABLE[windows] * up[: windows.shape[1]]).sum(axis=1, dtype=np.uint64))


def as_runs(places: np.ndarray) -> np.ndarray:
    """Sorted places as rows of first place and number of neighbours from there on."""
    at = np.nonzero(np.concatenate([[True], places[1:] != places[:-1] + 1]))[0]
    return np.stack([places[at], np.diff(np.append(at, len(places)))], axis=1)


def segments_of(ids, subs, raw, off, asked, length: int, gram: int) -> pa.RecordBatch:
    """The bytes of the asked places; windows of split anchors one by one, those equal here met already.

    ``twins`` are the starts of equal bytes in the same text, as runs.
    """
    out: dict[str, list] = {k: [] for k in ("key", "doc", "sub", "start", "n_starts", "bytes", "upto", "twins")}
    w_of, w_start, w_rows, w_runs = [], [], [], []
    none = np.zeros((0, 2), np.int64)

    def put(key, i, start, n_starts, text, upto, twins):
        for c, v in zip(out.values(), (key, ids[i], subs[i], start, n_starts, text, upto, twins)):
            c.append(v)

    for i in range(len(ids)):
        text = raw[off[i] : off[i + 1]]
        ask = np.frombuffer(asked[i].as_buffer(), REQUEST)
        ask = ask[np.lexsort((ask["pos"], ask["lead"], ask["h"]))]
        first = np.nonzero(ask["pos"] == ask["lead"])[0]
        for x, y in zip(first, np.append(first[1:], len(ask))):
            h, pos, _, split = ask[x].tolist()
            a, b = max(0, pos - (length - gram)), min(len(text), pos + length)
            n = min(pos, b - length) - a + 1
            runs = as_runs(ask["pos"][x + 1 : y].astype(np.int64) - (pos - a)) if y > x + 1 else none
            if split:
                w_rows.append(np.lib.stride_tricks.sliding_window_view(text[a : a + n + length - 1], length))
                w_start.append(np.arange(a, a + n))
                w_of.append(np.full(n, i))
                w_runs.extend([runs + [[j, 0]] for j in range(n)] if len(runs) else [none] * n)
            else:
                twins = runs.astype(np.int32).tobytes() if len(runs) else None
                put(h - (1 << 64) if h >> 63 else h, i, a, n, text[a:b].tobytes(), None, twins)
    if w_rows:
        rows, start, of = np.concatenate(w_rows), np.concatenate(w_start), np.concatenate(w_of)
        doc, sub = np.asarray(ids, np.int64)[of], np.asarray(subs, np.int64)[of]
        keys = window_keys(rows)
        order = np.lexsort((start, of, sub, doc, keys))
        new = np.ones(len(order), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        own = new.copy()  # first window of its text
        own[1:] |= of[order][1:] != of[order][:-1]
        head, mine = (order[np.nonzero(x)[0][np.cumsum(x) - 1]] for x in (new, own))
        met = (doc[order] > doc[head]) & (rows[order] == rows[head]).all(axis=1)
        twin = ~met & ~own & (rows[order] == rows[mine]).all(axis=1)
        also: dict[int, list] = {}
        for at, lead in zip(order[twin], mine[twin]):
            also.setdefault(int(lead), []).append(at)
        for at in order[~met & ~twin]:
            equal = also.get(int(at), [])
            runs = np.concatenate([w_runs[at], *(r for e in equal for r in (w_runs[e], [[start[e], 1]]))])
            put(int(keys[at].astype(np.int64)), int(of[at]), int(start[at]), 1, rows[at].tobytes(), None, runs.astype(np.int32).tobytes() if len(runs) else None)
        done: dict[int, list] = {}
        for at in order[met]:
            done.setdefault(int(of[at]), []).append(np.concatenate([w_runs[at], [[start[at], 1]]]))
        for i, runs in done.items():
            runs = np.concatenate(runs)
            for a, b in merged(np.stack([runs[:, 0], runs.sum(axis=1) - 1 + length], axis=1)).tolist():
                put(0, i, a, 0, None, b, None)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


SEGMENTS = "key long, doc long, sub int, start int, n_starts int, bytes binary, upto int, twins binary"


def match_segments(table: pa.Table, length: int, most: int = 60_000) -> pa.Table:
    """Spans of the longest previous factors, a few thousand suffixes at a time."""
    key = table["key"].to_numpy().view(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    doc, sub, start, n = (table[c].to_numpy()[order] for c in ("doc", "sub", "start", "n_starts"))
    texts, twins = table["bytes"].to_pylist(), table["twins"].to_pylist()
    new = np.append(np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0], len(key))
    load = np.concatenate([[0], np.cumsum(n)])
    docs, subs, spans = [], [], []
    g = 0
    while g < len(new) - 1:
        e = g + 1
        while e < len(new) - 1 and load[new[e + 1]] - load[new[g]] <= most:
            e += 1
        a, b = new[g], new[e]
        seg, off, factor = previous_factors(key[a:b], doc[a:b], [texts[i] for i in order[a:b]], n[a:b], length)
        # joined inside each segment, then moved to its start and to those of its twins
        part = np.stack([off, off + factor], axis=1) + (seg << 32)[:, None]
        part = merged(part) if len(part) else part
        seg, part = part[:, 0] >> 32, part & 0xFFFFFFFF
        docs.append(doc[a:b][seg])
        subs.append(sub[a:b][seg])
        spans.append(start[a:b][seg].astype(np.int64)[:, None] + part)
        for i, (x, y) in zip(seg, part):
            if twins[order[a + i]]:
                runs = np.frombuffer(twins[order[a + i]], np.int32).reshape(-1, 2).astype(np.int64)
                docs.append(np.full(len(runs), doc[a + i]))
                subs.append(np.full(len(runs), sub[a + i]))
                spans.append(np.stack([runs[:, 0] + x, runs.sum(axis=1) - 1 + y], axis=1))
        g = e
    none = np.zeros(0, np.int64)
    if not docs:
        return found_table(none, none, np.zeros((0, 2), np.int64), none, none, np.zeros(0, REQUEST))
    return found_table(np.concatenate(docs), np.concatenate(subs), np.concatenate(spans), none, none, np.zeros(0, REQUEST))


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc, tx, spans: what goes from each text (null spans: all of it). ``tx`` are 128 bits of the text's digest."""
    spark = docs.sparkSession
    known = distinct_texts(source_rows(docs, id_col, text_col))
    n_ranges = power_of_two(max(parallelism(spark), -(-known.total // RANGE_BYTES), 2))
    bits = n_ranges.bit_length() - 1
    texts = known.texts

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = arrow_bytes(b.column("text"))
            doc, sub = b.column("doc").to_numpy(), b.column("sub").to_numpy()
            found = (
                (i, *anchors(raw[off[i] : off[j]], off[i : j + 1] - off[i], length, gram)) for i, j in pieces(off, PIECE)
            )
            yield from messages(doc, sub, found, bits)

    def meet(table: pa.Table) -> pa.Table:
        return match_anchors([m.as_buffer() for m in table["message"]], length, gram)

    met = stage(texts.mapInArrow(find, "r int, message binary").groupBy("r").applyInArrow(meet, FOUND), "anchors")
    wanted = met.filter("wanted IS NOT NULL").groupBy("doc", "sub").agg(F.collect_list("wanted").alias("w"))
    wanted = stage(wanted.select("doc", "sub", F.expr("aggregate(w, X'', (a, x) -> concat(a, x))").alias("w")), "wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = arrow_bytes(b.column("text"))
            if b.num_rows:
                yield segments_of(b.column("doc").to_pylist(), b.column("sub").to_pylist(), raw, off, b.column("w"), length, gram)

    seg = texts.join(small(wanted), ["doc", "sub"]).select("doc", "sub", "text", "w").mapInArrow(read, SEGMENTS)
    seg = stage(seg, "segments")
    need = seg.filter("n_starts > 0").agg(F.sum(F.col("n_starts") * F.octet_length("bytes"))).first()[0] or 0
    n_parts = max(parallelism(spark), -(-need // (16 * RANGE_BYTES)), 2)

    def factors(table: pa.Table) -> pa.Table:
        return match_segments(table, length)

    more = seg.filter("n_starts > 0").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(n_parts)))
    more = more.groupBy("part").applyInArrow(factors, FOUND)
    local = seg.filter("n_starts = 0").select("doc", "sub", pair("start", "upto").alias("spans"))
    spans = met.filter("spans IS NOT NULL").select("doc", "sub", "spans").union(more.select("doc", "sub", "spans")).union(local)
    listed = spans.groupBy("doc", "sub").agg(F.collect_list("spans").alias("s"))
    listed = listed.select("doc", "sub", F.expr("aggregate(s, X'', (a, x) -> concat(a, x))").alias("spans"))
    owner = known.subs.join(listed, ["doc", "sub"]).select("doc", "tx", "spans")
    whole = known.copies.filter(F.col("n") >= length).select("doc", "tx", F.lit(None).cast("binary").alias("spans"))
    return owner.union(whole)


class Texts(NamedTuple):
    texts: DataFrame  # doc, sub, text: every distinct text once, under its smallest document
    subs: DataFrame  # doc, tx, sub: sub counts the texts of one id
    copies: DataFrame  # doc, tx, rx, n, lead: rows whose text belongs to a smaller document
    total: int  # bytes


def distinct_texts(rows: DataFrame) -> Texts:
    """Equal texts as one; ``rows`` has doc, text and tx, which is read once.

    Later passes know a row by its id and a quick hash of its text.
    """
    quick = rows.withColumn("rx", F.xxhash64("text"))
    known = stage(quick.select("doc", "tx", "rx", F.octet_length("text").alias("n")).distinct(), "texts")
    ranked = known.groupBy("tx").agg(F.min("doc").alias("lead"))
    placed = stage(known.join(ranked, "tx"), "placed")
    copies = placed.filter("doc > lead")
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("tx")) - 1
    subs = stage(placed.filter("doc = lead").select("doc", "tx").distinct().select("doc", "tx", nth.alias("sub")), "subs")
    further = placed.filter("doc = lead").join(subs.filter("sub > 0"), ["doc", "tx"])
    special = stage(copies.select("doc", "rx", F.lit(-1).alias("sub")).union(further.select("doc", "rx", "sub")).distinct(), "special")
    texts = quick.select("doc", "text", "rx").join(small(special), ["doc", "rx"], "left")
    texts = texts.withColumn("sub", F.coalesce("sub", F.lit(0))).filter("sub >= 0")
    total = known.agg(F.sum("n")).first()[0] or 0
    return Texts(texts.select("doc", "sub", "text"), subs, copies, total)


def pair(a: str, b: str):
    """Two numbers as eight bytes, least byte first."""
    turned = lambda c: F.unhex(F.regexp_replace(F.lpad(F.hex(F.col(c)), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1"))
    return F.concat(turned(a), turned(b))


def source_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"), text.alias("text"))
    return rows.withColumn("tx", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the bytes that stay."""
    gone = stage(removed_spans(docs, id_col, text_col, length, gram), "spans").withColumn("hit", F.lit(True))
    rows = source_rows(docs, id_col, text_col).join(small(gone), ["doc", "tx"], "left").select("doc", "text", "spans", "hit")
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = arrow_bytes(b.column("text"))
            spans, hit = b.column("spans"), b.column("hit").is_valid().to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            for i in range(b.num_rows):
                text = raw[off[i] : off[i + 1]]
                n, runs = len(text), np.zeros((0, 2), np.int64)
                if hit[i]:
                    if spans[i].is_valid:
                        runs = merged(np.frombuffer(spans[i].as_buffer(), np.int32).reshape(-1, 2).astype(np.int64))
                        runs[:, 1] = np.minimum(runs[:, 1], n)
                    else:
                        runs = np.array([[0, n]])
                at = np.concatenate([[0], runs.ravel(), [n]])
                stays = [text[x:y] for x, y in zip(at[::2], at[1::2])]
                digest = hashlib.sha256()
                for part in stays:
                    digest.update(part)
                kept = b"".join(part.tobytes() for part in stays) if keep_text else None
                out.append((n, n - sum(map(len, stays)), len(runs), digest.hexdigest(), kept))
            cols = list(zip(*out)) or [()] * 5
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), *arrays[: 4 + keep_text]], names=names)

    # written here, where batches are bounded by bytes
    out = stage(rows.mapInArrow(cut, schema), "removed")
    kind = docs.schema[id_col].dataType
    return out.withColumn("doc", F.when(F.col("doc") != NO_ID, F.col("doc")).cast(kind)).withColumnRenamed("doc", id_col)

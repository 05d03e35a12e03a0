"""Repeated passages by prefix-free parsing: phrases between hash triggers, and suffix orders of dictionary and parse."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, blobs, pieces, strings

U = np.uint64
BUCKET, CHUNK, BLOCK, ORDER = 16 << 20, 1 << 20, 100_000, 32_768
SPANS = "array<struct<start:long,end:long>>"


def parse(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Phrases of texts: trigger hash, phrase hash, text, first window, windows, and the trigger's place in it.

    A window is a string of `length` bytes inside one text; its trigger is the leftmost gram with the least
    rolling hash in it, so equal windows have equal triggers at equal places and no window is without one. A
    phrase is what the windows of one trigger cover.
    """
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    p, q = K.powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(K.BYTE[data] * p[:n], out=total[1:])
    rolling = K.mix((total[gram:] - total[:-gram]) * q[: n - gram + 1])
    least, places = (rolling & U(0xFFFFFFFF00000000)) | np.arange(len(rolling), dtype=np.uint64), length - gram + 1
    step = 1
    while 2 * step <= places:
        least, step = np.minimum(least[:-step], least[step:]), 2 * step
    if places > step:
        least = np.minimum(least[: len(least) - (places - step)], least[places - step :])
    trigger = (least & U(0xFFFFFFFF)).astype(np.int64)
    whole = np.zeros(len(trigger) + 1, np.int32)
    some = np.diff(offsets) >= length
    whole[offsets[:-1][some]] += 1
    np.add.at(whole, offsets[1:][some] - length + 1, -1)
    whole = np.cumsum(whole[:-1]) > 0
    turn = trigger[1:] != trigger[:-1]
    first, last = whole.copy(), whole.copy()
    first[1:] &= ~whole[:-1] | turn
    last[:-1] &= ~whole[1:] | turn
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    at = trigger[lo]
    phrase = K.mix((total[hi + length] - total[lo]) * q[lo] + (at - lo).astype(np.uint64) * K.PLACE[0])
    text = np.searchsorted(offsets, lo, "right") - 1
    return rolling[at], phrase, text, lo - offsets[text], hi - lo + 1, at - lo


def _squeeze(a: np.ndarray) -> bytes:
    """Byte planes of numbers, compressed: neighbours' high bytes agree."""
    if not len(a):
        return b""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _widen(raw: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _low(a: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _high(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


PARSED = "bucket long, chunk long, size int, id binary, tag binary, at binary, entry binary, h binary, u binary, least binary, several binary, place binary"


def _parsed(buckets: int, length: int, gram: int):
    """A chunk of texts, packed: one row with all phrase occurrences (bucket -1), and a row per bucket of trigger hashes with
    the chunk's different phrases, each with the least id that holds it and whether others do."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        h, u, ids, tag, at = (np.concatenate(x) for x in zip(*held, strict=True))
        chunk = uuid.uuid4().int >> 65
        order = np.lexsort((ids, u, h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (u[order][1:] != u[order][:-1])]
        heads = np.flatnonzero(new)
        least, most = ids[order][heads], ids[order][np.r_[heads[1:], len(order)] - 1]
        # entries are numbered by first occurrence, so that their numbers rise along the chunk
        begin = np.minimum.reduceat(order, heads)
        rank = np.argsort(begin)
        number = np.empty(len(heads), np.int64)
        number[rank] = np.arange(len(heads))
        entry = np.empty(len(order), np.int64)
        entry[order] = number[np.cumsum(new) - 1]
        h, u, least, several = h[order][heads][rank], u[order][heads][rank], least[rank], (least != most)[rank]
        columns: dict[str, list] = {n: [] for n in PARSED_KINDS}

        def put(**row) -> None:
            for n, values in columns.items():
                values.append(row.get(n))

        put(bucket=-1, chunk=chunk, size=len(ids), id=_squeeze(np.diff(ids, prepend=0)), tag=_squeeze(tag), at=_squeeze(at), entry=_squeeze(np.diff(entry, prepend=0)))
        bucket = ((h >> U(44)) % U(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
            put(bucket=int(bucket[some[0]]), chunk=chunk, size=len(some), h=_low(h[some], 5), u=u[some].tobytes(), least=_squeeze(np.diff(least[some], prepend=0)), several=_squeeze(several[some].view(np.uint8)), place=_squeeze(np.diff(some, prepend=0)))
        return pa.RecordBatch.from_arrays([pa.array(v, PARSED_KINDS[n]) for n, v in columns.items()], names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0
        for batch in batches:
            data, offsets = strings(batch.column(2))
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint32)
            for i, j in pieces(offsets, 1 << 20):
                at = offsets[i : j + 1]
                h, u, text, lo, n, place = parse(data[at[0] : at[-1]], at - at[0], length, gram)
                held.append((h, u, ids[i + text], tags[i + text], lo << 16 | n << 8 | place))
                count += len(h)
                if count >= CHUNK:
                    yield flush(held)
                    held, count = [], 0
        if count:
            yield flush(held)

    return run


PARSED_KINDS = {"bucket": pa.int64(), "chunk": pa.int64(), "size": pa.int32()} | dict.fromkeys(("id", "tag", "at", "entry", "h", "u", "least", "several", "place"), pa.binary())
TOLD = "chunk long, size int, place binary, least binary, met int, where binary, h binary, u binary"


def _met(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """What a bucket tells each chunk about its phrases: the least id of all chunks, where the chunk holds a larger one; and
    trigger and phrase hash of those it holds first whose trigger has other phrases elsewhere."""
    sizes = np.array([r["size"] for r in rows])
    h, u = _high(b"".join(r["h"] for r in rows), 5), np.frombuffer(b"".join(r["u"] for r in rows), np.uint64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(h, kind="stable")
    least, place = (np.concatenate([np.cumsum(_widen(r[c], n, np.int64)) for r, n in zip(rows, sizes, strict=True)]) for c in ("least", "place"))
    several = np.concatenate([_widen(r["several"], n, np.uint8) for r, n in zip(rows, sizes, strict=True)]).view(bool)
    # a phrase that only one text of one chunk holds, with no other of its trigger, concerns nobody
    same = h[order][1:] == h[order][:-1]
    some = order[np.r_[same, False] | np.r_[False, same] | several[order]]
    if not len(some):
        return
    h, u, owner, least, place, several = (x[some] for x in (h, u, owner, least, place, several))
    order = np.lexsort((least, u, h))
    h, u, owner, least, place, several = (x[order] for x in (h, u, owner, least, place, several))
    new_h = np.r_[True, h[1:] != h[:-1]]
    new_u = new_h | np.r_[True, u[1:] != u[:-1]]
    starts, group = np.flatnonzero(new_h), np.cumsum(new_h) - 1
    shared = ((np.minimum.reduceat(least, starts) < np.maximum.reduceat(least, starts)) | np.maximum.reduceat(several, starts))[group]
    others = (np.add.reduceat(new_u.astype(np.int64), starts) > 1)[group]
    first = least[np.flatnonzero(new_u)][np.cumsum(new_u) - 1]
    gone = several | (least > first)
    mine = (least == first) & shared & others
    key = h | U(rows[0]["bucket"]) << U(40)
    order = np.lexsort((place, owner))
    order = order[(gone | mine)[order]]
    if not len(order):
        return
    out = []
    for x in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
        g, m = x[gone[x]], x[mine[x]]
        out.append((rows[owner[x[0]]]["chunk"], len(g), _squeeze(np.diff(place[g], prepend=0)), _squeeze(first[g]), len(m), _squeeze(np.diff(place[m], prepend=0)), key[m].tobytes(), u[m].tobytes()))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    for k in range(0, len(out), 1024):
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out[k : k + 1024], strict=True), kinds, strict=True)], names=["chunk", "size", "place", "least", "met", "where", "h", "u"])


def _grouped(key: str, work):
    """`work` over the rows of each value of a column that rows are sorted by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0][key] != row[key]:
                    yield from work(held)
                    held = []
                held.append(row)
        if held:
            yield from work(held)

    return run


MET = "id long, tag long, at long, h long, u long"


def _told(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """A chunk's occurrences whose phrase a smaller id has too, and (with h and u) first ones whose trigger has other phrases."""
    (own,) = [r for r in rows if r["at"] is not None]
    n = own["size"]
    ids, entry = (np.cumsum(_widen(own[c], n, np.int64)) for c in ("id", "entry"))
    tag, at = _widen(own["tag"], n, np.uint32), _widen(own["at"], n, np.int64)
    least = np.full(entry.max() + 1, np.iinfo(np.int64).max)
    h, u = np.zeros((2, len(least)), np.int64)
    mine = np.zeros(len(least), bool)
    for r in rows:
        if r["at"] is None:
            least[np.cumsum(_widen(r["place"], r["size"], np.int64))] = _widen(r["least"], r["size"], np.int64)
            where = np.cumsum(_widen(r["where"], r["met"], np.int64))
            mine[where] = True
            h[where], u[where] = np.frombuffer(r["h"], np.int64), np.frombuffer(r["u"], np.int64)
    gone = ids > least[entry]
    keep = np.flatnonzero(gone | mine[entry])
    for k in range(0, len(keep), BLOCK):
        x = keep[k : k + BLOCK]
        yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(tag[x].astype(np.int64)), pa.array(at[x]), pa.array(h[entry[x]], mask=gone[x]), pa.array(u[entry[x]], mask=gone[x])], names=["id", "tag", "at", "h", "u"])


def _contexts(length: int):
    """The bytes of phrases, cut from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(2))
            raw = data.tobytes()
            for i in range(len(batch)):
                x = batch.column(3)[i].values
                at = x.field("at").to_numpy()
                lo = offsets[i] + (at >> 16)
                cut = [raw[a:b] for a, b in zip(lo.tolist(), (lo + (at >> 8 & 255) - 1 + length).tolist(), strict=True)]
                for k in range(0, len(at), BLOCK):
                    m = len(cut[k : k + BLOCK])
                    yield pa.RecordBatch.from_arrays([x.field("h").slice(k, m), x.field("u").slice(k, m), pa.array(np.full(m, batch.column(0)[i].as_py())), pa.array(np.full(m, batch.column(1)[i].as_py())), pa.array(at[k : k + BLOCK]), blobs(cut[k : k + BLOCK])], names=["h", "u", "id", "tag", "at", "phrase"])

    return run


def _by_bytes(rows: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Lexicographic order of rows of bytes, inside their groups."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view(">u8").astype(np.uint64)
    keys = [words[:, k] for k in range(words.shape[1] - 1, -1, -1)]
    return np.lexsort((*keys, group) if group is not None else keys)


def suffix_order(context: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes inside their groups, and the common prefix of each with the one before (-1 in a new group)."""
    order = _by_bytes(context, group)
    common = np.full(len(context), -1)
    same = np.cumprod(context[order][1:] == context[order][:-1], 1, dtype=np.int8).sum(1, dtype=np.int64)
    common[1:] = np.where(group[order][1:] == group[order][:-1], same, -1)
    return order, common


def dictionary_suffixes(phrases: np.ndarray, size: np.ndarray, gram: int) -> np.ndarray:
    """The suffix array of a dictionary, as ranks: [phrase, k] is the rank of its suffix of k + gram bytes among all suffixes, -1 where it has none.

    Phrases are rows of bytes, aligned right, that end with their trigger. Equal suffixes have equal ranks.
    """
    m, width = phrases.shape
    depth = width - gram
    rows, lengths = [], []
    for k in range(depth + 1):
        some = np.flatnonzero(size >= k + gram)
        part = np.zeros((len(some), width), np.uint8)
        part[:, : k + gram] = phrases[some, width - k - gram :]
        rows.append(part)
        lengths.append(some * (depth + 1) + k)
    text, at = np.concatenate(rows), np.concatenate(lengths)
    order = np.argsort(at % (depth + 1), kind="stable")  # of equal padded rows the shorter is first
    order = order[_by_bytes(text[order])]
    k = at[order] % (depth + 1)
    new = np.r_[True, (text[order][1:] != text[order][:-1]).any(1) | (k[1:] != k[:-1])]
    out = np.full(m * (depth + 1), -1)
    out[at[order]] = np.cumsum(new) - 1
    return out.reshape(m, depth + 1)


def _ordered(length: int, gram: int):
    """Windows of phrases with a common trigger that a smaller id has too; those of groups that other tasks may hold go on with a key.

    A window is a suffix of the dictionary phrase that ends with its trigger, and a beginning of the parse after it.
    The suffix array of a block's dictionary ranks the one, the order of the parse's suffixes with their common
    prefixes ranks the other at the depth that is left, and sorted by both, windows stand in the order of the corpus,
    equal ones together.
    """
    depth = length - gram

    def block(t: pa.Table, open_: set[int]) -> Iterator[pa.RecordBatch]:
        h, ids, tag, at = (t.column(c).to_numpy() for c in ("h", "id", "tag", "at"))
        data, offsets = strings(t.column("phrase").cast(pa.large_binary()).combine_chunks())
        lo, n, place = at >> 16, at >> 8 & 255, at & 255
        size = np.diff(offsets)
        back = np.arange(length)[::-1]  # bytes before the trigger's end
        left = np.where(back < place[:, None] + gram, np.take(data, offsets[:-1, None] + np.maximum(place[:, None] + gram - 1 - back, 0)), 0).astype(np.uint8)
        right = place[:, None] + gram + np.arange(depth)
        after = np.where(right < size[:, None], np.take(data, offsets[:-1, None] + np.minimum(right, size[:, None] - 1)), 0).astype(np.uint8)
        named = np.concatenate([left, place[:, None].astype(np.uint8)], 1)
        phrases, of = np.unique(named.view(f"V{length + 1}").ravel(), return_inverse=True)
        phrases = phrases.view(np.uint8).reshape(-1, length + 1)
        suffix = dictionary_suffixes(phrases[:, :length], phrases[:, length].astype(np.int64) + gram, gram)
        order, common = suffix_order(after, np.zeros(len(h), np.int64))
        row, first, rest = [], [], []
        parse = np.zeros(len(h), np.int64)
        for k in range(depth + 1):
            some = np.flatnonzero((k <= place) & (k > place - n))
            parse[order] = np.cumsum(common < depth - k)
            row.append(some)
            first.append(suffix[of[some], k])
            rest.append(parse[some])
        start = np.repeat(np.arange(depth + 1), [len(x) for x in row])
        row, first, rest = np.concatenate(row), np.concatenate(first), np.concatenate(rest)
        corpus = np.lexsort((rest, first))
        new = np.r_[True, (first[corpus][1:] != first[corpus][:-1]) | (rest[corpus][1:] != rest[corpus][:-1])]
        least = np.minimum.reduceat(ids[row[corpus]], np.flatnonzero(new))[np.cumsum(new) - 1]
        gone = np.zeros((len(h), depth + 2), bool)
        hit = np.zeros(len(row), bool)
        hit[corpus] = least < ids[row[corpus]]
        gone[row[hit], (place[row] - start)[hit]] = True
        wait = ~hit & np.isin(h, list(open_))[row]
        if wait.any():
            later, k = row[wait], (place[row] - start)[wait]
            key = K.hashes(data, offsets[later] + k, offsets[later] + k + length)
            yield out(ids[later], tag[later], (lo[later] + k) << 16 | 1 << 8, h[later], key.view(np.int64))
        row, k = np.nonzero(gone[:, :-1] & ~np.pad(gone, ((0, 0), (1, 0)))[:, :-2])
        _, end = np.nonzero(gone[:, :-1] & ~gone[:, 1:])
        yield out(ids[row], tag[row], (lo[row] + k) << 16 | (end - k + 1) << 8)

    def out(ids, tag, at, h=None, w=None) -> pa.RecordBatch:
        none = pa.nulls(len(ids), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tag), pa.array(at), none if h is None else pa.array(h), none if w is None else pa.array(w)], names=["id", "tag", "at", "h", "u"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        open_: set[int] = set()
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not open_:
                open_ = {held.column("h")[0].as_py()}  # the task before may hold more of it
            if len(held) >= ORDER:
                h = held.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
                if not cut:
                    open_.add(int(h[-1]))
                    cut = len(h)
                yield from block(held.slice(0, cut), open_)
                held = held.slice(cut)
        if held is not None and len(held):
            open_.add(held.column("h")[-1].as_py())
            yield from block(held, open_)

    return run


def _strip(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for i, j in pieces(offsets, 4 << 20):
                kept, spans, size = [], [], []
                for k in range(i, j):
                    raw = data[offsets[k] : offsets[k + 1]]
                    at = batch.column(2)[k].values
                    runs = []
                    if at is not None and len(at):
                        at = at.to_numpy()
                        cover = np.zeros(len(raw) + 1, np.int32)
                        np.add.at(cover, at >> 16, 1)
                        np.add.at(cover, (at >> 16) + (at >> 8 & 255) - 1 + length, -1)
                        inside = np.cumsum(cover[:-1]) > 0
                        edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
                        runs = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                        raw = raw[~inside]
                    kept.append(raw.tobytes())
                    spans.append(runs)
                    size.append(offsets[k + 1] - offsets[k])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(spans, kind), blobs(kept)], names=["id", "n_bytes", "spans", "kept"])

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = 20) -> DataFrame:
    """One row per input row: id, n_bytes, spans (maximal removed runs of bytes, end exclusive), kept (the remaining bytes).

    A byte goes if a string of `length` bytes over it also starts in a row with a smaller id; texts are UTF-8,
    strings stay inside one text and are judged on the input.

    Texts are parsed into phrases at triggers, the least rolling hashes of `gram` bytes. A chunk of texts reduces its
    occurrences to its different phrases, each with the least id; these travel by trigger hash to buckets of about
    16 MB of text each, so a passage that every text holds is one row per chunk there. The bucket tells each chunk
    the least id of all. Phrases that share a trigger but differ go on to the suffix arrays of dictionary and parse,
    block by block over range partitions, which may cut a very common trigger's phrases; what such cuts leave open
    meets by window hash. Phrases count as equal by hashes of 64 bits beside 40 and more of their trigger's.

    Null ids are compared with nothing and keep all. Equal ids don't remove each other's text; rows are told
    apart by a checksum of the text, and repeated rows come out alike. Null or short texts keep all. An empty
    table gives an empty result. Other columns are not read.
    """
    if not 0 < gram <= length < gram + 250:
        raise ValueError("gram must be positive, at most length and above length - 250")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("tag"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(total // BUCKET + 1)
    parsed = scratch.save(docs.filter("id is not null").mapInArrow(_parsed(buckets, length, gram), PARSED))
    entries = parsed.filter("bucket >= 0").select("bucket", "chunk", "size", "h", "u", "least", "several", "place")
    told = entries.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_grouped("bucket", _met), TOLD)
    own = parsed.filter("bucket < 0").select("chunk", "size", "id", "tag", "at", "entry")
    both = own.unionByName(told, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk")
    met = scratch.save(both.mapInArrow(_grouped("chunk", _told), MET))
    scratch.drop(parsed)
    firsts = met.filter("h is not null").groupBy("id", "tag").agg(F.collect_list(F.struct("at", "h", "u")).alias("phrases"))
    phrases = docs.join(firsts, ["id", "tag"]).select("id", "tag", "text", "phrases").dropDuplicates(["id", "tag"])
    phrases = scratch.save(phrases.mapInArrow(_contexts(length), "h long, u long, id long, tag long, at long, phrase binary"))
    ordered = scratch.save(phrases.repartitionByRange("h", "u").sortWithinPartitions("h", "u").mapInArrow(_ordered(length, gram), MET))
    open_ = ordered.filter("h is not null")
    least = open_.groupBy("h", "u").agg(F.min("id").alias("least"))
    late = open_.join(least, ["h", "u"]).filter("id > least").select("id", "tag", "at")
    gone = met.filter("h is null").select("id", "tag", "at").unionAll(ordered.filter("h is null").select("id", "tag", "at")).unionAll(late)
    gone = scratch.save(gone.groupBy("id", "tag").agg(F.collect_list("at").alias("at")))
    scratch.drop(met, phrases, ordered)
    out = docs.join(gone, ["id", "tag"], "left").select("id", "text", "at").mapInArrow(_strip(length), f"id long, n_bytes long, spans {SPANS}, kept binary")
    return out.withColumnRenamed("id", id_col)

"""One packed shuffle that tells rows which of their 64-bit keys other rows hold.

A row here is a document, a key a fingerprint of one of its windows.  Map tasks
emit one Arrow row per (flush, bucket) that packs thousands of postings grouped by
row, five bytes of key each; the bucket holds the key's leading bits.  Only those
bits of a key count, 40 and log2(buckets); a second hash of the window may add 24 more
to them, then a posting has eight bytes.  A key that several rows of a flush hold is
sent once: a key that a third of all rows hold costs one posting a flush, not one a
row, and no task gathers all its holders.

A bucket's postings are sorted range by range of their keys, and what a worker has freed
goes back to the system after each flush and bucket: Spark keeps idle workers beside busy ones.

Two questions can be asked of a key:

``shared``   does any other row hold it?
``earlier``  does a row with a smaller id hold it, or a run of keys seen before?
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

U64 = np.uint64
#: Postings that a map task holds before it packs and emits them.
FLUSH = 500_000
#: Postings of a bucket that are sorted at once, about.
RANGE = 1 << 18
#: Kinds of packed rows: keys to ask about, keys whose answer is known, keys of an older run.
POSTED, KNOWN, RUN = 0, 1, 2

PACKED = "bucket int, kind int, ids binary, counts binary, keys binary, many binary, info binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("many", pa.binary()), ("info", pa.binary())])
ANSWER = "part int, ids binary, sizes binary, cells binary, info binary, bucket int, run binary"
_ANSWER_SCHEMA = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("cells", pa.binary()), ("info", pa.binary()), ("bucket", pa.int32()), ("run", pa.binary())])

#: (ids of the rows, info of the rows or None, row of each key, keys, second hashes or None)
Held = tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray, np.ndarray | None]


def split(keys: np.ndarray, check: np.ndarray | None, n_buckets: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, rest) of 64-bit keys: all that the exchange compares of them; without a check, rest has ``width`` bytes."""
    bits = U64(n_buckets.bit_length() - 1)
    rest = (keys << bits) >> U64(24 if check is not None else 64 - 8 * width)
    if check is not None:
        rest = rest << U64(24) | check >> U64(40)
    return (keys >> (U64(64) - bits)).astype(np.int64), rest


def _short(rest: np.ndarray, width: int) -> bytes:
    """The low bytes of each key."""
    return np.ascontiguousarray(rest).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _long(packed: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(packed) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8).reshape(-1, width)
    return out.view(U64).ravel()


def _planes(rest: np.ndarray, width: int) -> bytes:
    """Sorted keys byte by byte, which leaves little of the leading bytes once compressed."""
    return np.ascontiguousarray(np.ascontiguousarray(rest).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(packed: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(packed) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8).reshape(width, -1).T
    return out.view(U64).ravel()


def _cells(told: bytes) -> list[bytes]:
    """Cells that stand one after another, each after its size."""
    out, at = [], 0
    while at < len(told):
        size = int.from_bytes(told[at : at + 4], "little")
        out.append(told[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def unpacked(cells: bytes | None, width: int = 5) -> np.ndarray:
    """The keys in an id's answer cells; with less than eight bytes, the bucket in front of each."""
    parts = [np.zeros(0, U64)]
    for c in _cells(cells or b""):
        rest = _long(c[4:], width)
        parts.append(rest | U64(int.from_bytes(c[:4], "little")) << U64(8 * width) if width < 8 else rest)
    return np.concatenate(parts)


def spare() -> None:
    """Give memory that this process has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def _ranges(keys: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Where keys of ``width`` bytes stand, one range of keys after another."""
    bits = min(8, (len(keys) // RANGE).bit_length())
    lead = (keys >> U64(8 * width - bits)).astype(np.uint8) if bits else np.zeros(len(keys), np.uint8)
    for k in range(1 << bits):
        at = np.flatnonzero(lead == k)
        if len(at):
            yield at


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    first = np.ones(len(sorted_keys), dtype=bool)
    first[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(first)


def _spans(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    start = _runs(sorted_values)
    return list(zip(start.tolist(), np.append(start[1:], len(sorted_values)).tolist(), strict=True)) if len(start) else []


def _pack(held: list[Held], n_buckets: int, ask: str, short: int) -> pa.RecordBatch:
    """Rows with the postings to ask about, a bucket each, and with what is known already; empties ``held``."""
    base = np.cumsum([0] + [len(h[0]) for h in held])
    ids = np.concatenate([h[0] for h in held])
    info = np.concatenate([h[1] for h in held]) if held[0][1] is not None else None
    row = np.concatenate([h[2] + b for h, b in zip(held, base, strict=False)]).astype(np.int32)
    check = np.concatenate([h[4] for h in held]) if held[0][4] is not None else None
    keys = np.concatenate([h[3] for h in held])
    held.clear()
    width = short if check is None else 8
    bucket, rest = split(keys, check, n_buckets, short)
    del keys, check
    if info is None:  # rows of one id are one holder
        single, one = np.unique(ids, return_inverse=True)
        if len(single) < len(ids):
            ids, row = single, one[row].astype(np.int32)
            order = np.argsort(row, kind="stable")
            bucket, rest, row = bucket[order], rest[order], row[order]
    deal = np.argsort(bucket.astype(np.uint16 if n_buckets <= 1 << 16 else np.uint32), kind="stable")
    edge = np.searchsorted(bucket[deal], np.arange(n_buckets + 1))
    out, known_row, known_cell = [], [], []
    for b in np.flatnonzero(np.diff(edge)):
        some = deal[edge[b] : edge[b + 1]]
        order = some[np.argsort(rest[some], kind="stable")]
        k, r = rest[order], row[order]
        fresh = np.ones(len(k), dtype=bool)  # a key that a row holds twice counts once
        fresh[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        k, r = k[fresh], r[fresh]
        start = _runs(k)
        size = np.diff(np.append(start, len(k)))
        if ask == "shared":
            asked, many = start, size > 1
            told = np.repeat(many, size)
        else:
            told = ids[r] > np.repeat(np.minimum.reduceat(ids[r], start), size)
            asked, many = np.minimum.reduceat(np.where(told, len(k), np.arange(len(k))), start), None
        by_row = np.argsort(r[asked], kind="stable")
        holder, counts = np.unique(r[asked], return_counts=True)
        marks = np.packbits(many[by_row]).tobytes() if many is not None else b""
        out.append((int(b), POSTED, ids[holder].tobytes(), counts.astype(np.uint32).tobytes(), _short(k[asked][by_row], width), marks, b""))
        if told.any():
            k, r = k[told], r[told]
            by_row = np.argsort(r, kind="stable")
            k, r = k[by_row], r[by_row]
            head = int(b).to_bytes(4, "little")
            for a, z in _spans(r):
                known_row.append(int(r[a]))
                known_cell.append(head + _short(k[a:z], width))
    if info is not None or known_row:
        cells: dict[int, list[bytes]] = {}
        for r, c in zip(known_row, known_cell, strict=True):
            cells.setdefault(r, []).append(len(c).to_bytes(4, "little") + c)
        some = np.arange(len(ids)) if info is not None else np.array(sorted(cells))
        told = [b"".join(cells.get(r, ())) for r in some.tolist()]
        spread = int(ids[0]) * 2654435761 % n_buckets
        out.append((spread, KNOWN, ids[some].tobytes(), np.array([len(c) for c in told], np.uint32).tobytes(), b"".join(told), b"", info.tobytes() if info is not None else b""))
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA) if out else pa.RecordBatch.from_pylist([], schema=_SCHEMA)


def _parts(ids: np.ndarray, n: int) -> np.ndarray:
    return ((ids.view(U64) * U64(0x9E3779B97F4A7C15) >> U64(40)) % U64(n)).astype(np.int64)


def packed(df: DataFrame, hold: Callable[[pa.RecordBatch], Iterator[Held]], n_buckets: int, ask: str, *, width: int = 5) -> DataFrame:
    """Rows of ``PACKED``; ``n_buckets`` is a power of two over 1, ``hold`` turns a batch into keys."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Held] = []
        for batch in batches:
            for part in hold(batch):
                held.append(part)
                del part
                if sum(len(h[3]) for h in held) >= FLUSH:
                    yield _pack(held, n_buckets, ask, width)
                    spare()
        if sum(len(h[0]) for h in held):
            yield _pack(held, n_buckets, ask, width)
            spare()

    return df.mapInArrow(mapped, PACKED)


def answered(rows: DataFrame, ask: str, n_parts: int, *, width: int = 5, info_width: int = 0, make_run: bool = False, often: int | None = None) -> DataFrame:
    """``ANSWER`` rows of packed ones: keys of which the answer is yes, many ids to a row.

    Ids are dealt into ``n_parts``; ``merged`` brings an id's answers together.  With ``make_run`` a bucket's keys that no older run holds come back as a sorted run.
    With ``often``, so do those of at least that many postings, each with their number (eight bytes and eight).
    """

    def told(table: pa.Table) -> list[tuple]:
        bucket = table.column("bucket")[0].as_py()
        posted, older = [], []
        answers: list[tuple] = []

        def answer(ids: np.ndarray, told: list, info: np.ndarray | None) -> None:
            part = _parts(ids, n_parts)
            order = np.argsort(part, kind="stable")
            for a, z in _spans(part[order]):
                some = order[a:z]
                sizes = np.array([len(told[j]) for j in some.tolist()], np.uint32)
                answers.append((int(part[some[0]]), ids[some].tobytes(), sizes.tobytes(), b"".join(told[j] for j in some.tolist()), b"" if info is None else info[some].tobytes(), None, None))

        for batch in table.select(_SCHEMA.names[1:]).to_batches():
            for kind, *cells in zip(*batch.columns, strict=True):
                i, c, k, m, info = (memoryview(x.as_buffer()).cast("B") for x in cells)  # no copies
                if kind.as_py() == RUN:
                    older += [_from_planes(k, width)] if len(k) else []
                elif kind.as_py() == KNOWN:
                    i, edge = np.frombuffer(i, np.int64), [0, *np.cumsum(np.frombuffer(c, np.uint32)).tolist()]
                    answer(i, [k[a:z] for a, z in zip(edge, edge[1:], strict=False)], np.frombuffer(info, np.int64).reshape(len(i), -1) if info_width else None)
                else:
                    posted.append((i, c, k, m))
        if posted:
            edge = np.cumsum([0] + [len(k) // width for _, _, k, _ in posted]).tolist()
            keys, owner, many = np.empty(edge[-1], U64), np.empty(edge[-1], np.int64), np.zeros(edge[-1], bool)
            for a, z, (i, c, k, m) in zip(edge, edge[1:], posted, strict=False):
                keys[a:z] = _long(k, width)
                owner[a:z] = np.repeat(np.frombuffer(i, np.int64), np.frombuffer(c, np.uint32))
                if ask == "shared":
                    many[a:z] = np.unpackbits(np.frombuffer(m, np.uint8), count=z - a)
            yes_k, yes_o, hot, fresh = [], [], [], []
            for at in _ranges(keys, width):
                k = keys[at]
                order = np.argsort(k)
                at, k = at[order], k[order]
                o = owner[at]
                start = _runs(k)
                size = np.diff(np.append(start, len(k)))
                seen = np.zeros(len(start), bool)
                if ask == "shared":
                    yes = ~many[at] & np.repeat(np.minimum.reduceat(o, start) < np.maximum.reduceat(o, start), size)
                else:
                    mine = k[start]
                    for run in older:  # both sides are sorted
                        place = np.minimum(np.searchsorted(run, mine), len(run) - 1)
                        seen |= run[place] == mine
                    yes = (o > np.repeat(np.minimum.reduceat(o, start), size)) | np.repeat(seen, size)
                if often is not None and (size >= often).any():
                    hot.append(np.stack([k[start][size >= often] | U64(bucket) << U64(8 * width), size[size >= often].astype(U64)], axis=1))
                if make_run:
                    fresh.append(k[start][~seen])
                yes_k.append(k[yes])
                yes_o.append(o[yes])
            del keys, owner, many
            if hot:
                answers.append((None, None, None, None, None, bucket, np.concatenate(hot).tobytes()))
            if make_run:
                answers.append((None, None, None, None, None, bucket, _planes(np.concatenate(fresh or [np.zeros(0, U64)]), width)))
            k, o = np.concatenate(yes_k or [np.zeros(0, U64)]), np.concatenate(yes_o or [np.zeros(0, np.int64)])
            del yes_k, yes_o
            order = np.argsort(o, kind="stable")
            k, o = k[order], o[order]
            head = bucket.to_bytes(4, "little")
            each = _spans(o)
            if each:
                cells = [(4 + width * (z - a)).to_bytes(4, "little") + head + _short(k[a:z], width) for a, z in each]
                answer(o[[a for a, _ in each]], cells, None)
        return answers

    def reduce(table: pa.Table) -> pa.Table:
        columns = list(zip(*told(table), strict=True)) or [()] * 7
        out = pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ANSWER_SCHEMA, strict=True)], schema=_ANSWER_SCHEMA)
        del columns
        spare()
        return out

    return rows.groupBy("bucket").applyInArrow(reduce, ANSWER)


def compacted(runs: DataFrame, width: int) -> DataFrame:
    """(bucket, run): one sorted run a bucket of the disjoint runs (bucket, run)."""

    def reduce(table: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([_from_planes(r, width) for r in table.column("run").to_pylist()]))
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "run": pa.array([_planes(keys, width)], pa.binary())})

    return runs.groupBy("bucket").applyInArrow(reduce, "bucket int, run binary")


def as_packed(runs: DataFrame) -> DataFrame:
    """Runs as rows of ``PACKED``, to be asked about together with new postings."""
    none = F.lit(b"")
    return runs.select("bucket", F.lit(RUN).alias("kind"), none.alias("ids"), none.alias("counts"), F.col("run").alias("keys"), none.alias("many"), none.alias("info"))


def merged(answers: DataFrame, info_width: int = 0) -> DataFrame:
    """(id, cells, info): one row per id, its keys in packed cells (see ``unpacked``)."""
    schema = pa.schema([("id", pa.int64()), ("cells", pa.binary()), ("info", pa.binary())])

    def reduce(table: pa.Table) -> pa.Table:
        told: dict[int, list[bytes]] = {}
        infos: dict[int, bytes] = {}
        for i, s, c, info in zip(*(table.column(n).to_pylist() for n in ("ids", "sizes", "cells", "info")), strict=True):
            at = 0
            for j, (x, size) in enumerate(zip(np.frombuffer(i, np.int64).tolist(), np.frombuffer(s, np.uint32).tolist(), strict=True)):
                told.setdefault(x, []).append(c[at : at + size])
                at += size
                if info:
                    infos[x] = info[8 * info_width * j : 8 * info_width * (j + 1)]
        ids = sorted(told)
        out = pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array([b"".join(told[x]) for x in ids], pa.binary()), pa.array([infos.get(x) for x in ids], pa.binary())], schema=schema)
        del told, infos
        spare()
        return out

    return answers.where("part is not null").groupBy("part").applyInArrow(reduce, "id long, cells binary, info binary")

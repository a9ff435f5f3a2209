"""Removal of repeated byte strings by blockwise suffix order with a difference cover.

Positions whose number modulo 31 is in a difference cover are sampled, six of 31.  For any
two positions i and j some offset d under 31 takes both onto sampled ones, and two strings
of ``width`` bytes are equal if the d bytes before those samples are, and the samples'
suffixes through width - d bytes.  So suffixes are compared at a common sample, by d bytes
and by the sample's rank, and only sampled suffixes are ever sorted:

1. Copies.  Rows of equal text (128 bits of SHA-256) are one class, and its smallest id
   stands for it; a text that a smaller id holds too goes whole.
2. Filter.  The 20 bytes at a sample must stand in another class, or no equal string of 50
   bytes holds it there.  A packed exchange of hashes tells each class which of its samples
   pass; false matches cost work but decide nothing.
3. Suffix buckets.  A sample that passed goes, with the 50 bytes from it and the 30 before,
   to the bucket of its leading 20 bytes.  Buckets are handled in blocks, one after the
   other, and a block's shuffle is freed, which bounds disk and memory.  A bucket sorts its
   sampled suffixes by their bytes; the adjacent common prefixes give each one's rank among
   prefixes of every length.  The bytes before are ranked the same way, backwards.
4. Ties.  For each d, samples that tie in the first 20 bytes are compared by the ranks of
   their d bytes before and of their width - d bytes from there: equal ones mean equal
   strings, all others than those of the smallest id are removed.  No hash decides here.
   A string that one block removes isn't asked about in the next: whoever has it with the
   smallest id is never removed and stands for it in every block.

A sample held by very many flushes (a passage that a third of all documents share) isn't
gathered in its bucket.  Every string that holds such a sample is dealt by its own whole
content instead, where a flush sends one copy; strings that only begin or end in the
passage differ and spread.  Such samples are at most ``HOT_KEYS`` and are broadcast.

Cases: null and empty texts and texts of under 50 bytes lose nothing; a null id counts as
the largest; rows that share an id aren't copies of each other; a string that a document
repeats isn't removed for that; an empty table gives an empty result; removal may cut a
character in two, which is why bytes are compared; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexigrade.llm import exchange as X
from lexigrade.llm import hashing as H
from lexigrade.llm.scratch import Scratch, buckets

U64 = np.uint64
#: Every difference modulo the period is one of two members of the cover.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
BEFORE = PERIOD - 1
LAST = (1 << 63) - 1
#: Flushes that must hold a sample before it is dealt by content, and most such samples.
#: A flush of the filter has some hundred documents, so a bucket's group stays below 100 MB.
HOT_FLUSHES, HOT_KEYS = 1000, 1 << 20
#: Records that a map task holds before it packs and emits them.
FLUSH = 120_000
KEY_BYTES = 4
#: Kinds of packed rows: samples with their context, whole strings, answers known already.
SAMPLE, STRING, KNOWN = 0, 1, 2
#: Set in an answer's mask if its document holds the same context elsewhere too.
AGAIN = 1 << 31
_CHUNK = U64(0x2545F4914F6CDD1D)
_ZSTD = pa.Codec("zstd", compression_level=1)

_PACKED = [("bucket", pa.int32()), ("kind", pa.int32()), ("owners", pa.binary()), ("owner", pa.binary()), ("bytes", pa.binary()), ("places", pa.binary()), ("masks", pa.binary())]
PACKED = "bucket int, kind int, owners binary, owner binary, bytes binary, places binary, masks binary"
_TOLD = [("part", pa.int32()), ("owners", pa.binary()), ("owner", pa.binary()), ("places", pa.binary()), ("masks", pa.binary())]
TOLD = "part int, owners binary, owner binary, places binary, masks binary"
MERGED = "h1 long, h2 long, places binary, masks binary"
#: Parts that samples fall into by their bytes; a block of buckets is a range of them.
SHARES = 256


def byte_hashes(padded: np.ndarray, at: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of the width bytes from each position; padded has 8 more bytes than positions reach."""
    eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    h = np.full(len(at), U64(seed) + _CHUNK, U64)
    for k in range(0, width, 8):
        part = eight[at + k]
        if width - k < 8:
            part = part & H._MASK[width - k]
        h = H.mix((h ^ part) * _CHUNK + U64(k + 1))
    return h


def sampled(offsets: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, row) of each sampled position that has ``inside`` bytes left in its row."""
    size = np.diff(offsets)
    periods = -(-size // PERIOD)
    row = np.repeat(np.arange(len(size)), periods)
    first = np.arange(len(row)) - np.repeat(np.cumsum(periods) - periods, periods)
    at = (offsets[row] + first * PERIOD)[:, None] + np.array(COVER)
    row = np.repeat(row, len(COVER))
    at = at.ravel()
    full = at + inside <= offsets[row + 1]
    return at[full], row[full]


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, np.uint8)])


def _words(rows: np.ndarray) -> list[np.ndarray]:
    """The columns of byte rows as big-endian words, so that their order is that of the bytes."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    return list(np.ascontiguousarray(wide.view(">u8").astype(U64).T))


def sort_suffixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of byte rows, bytes that each has in common with the one before it in order)."""
    order = np.lexsort(_words(rows)[::-1])
    common = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        inside = rows[order]
        unlike = np.ones((len(rows) - 1, rows.shape[1] + 1), bool)
        np.not_equal(inside[1:], inside[:-1], out=unlike[:, :-1])
        common[1:] = unlike.argmax(1)
    return order, common


def ranks(order: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """Rank of each row among the rows' first ``length`` bytes, equal for equal ones."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < length)
    return out


def _later(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a smaller id has the same key."""
    order = np.argsort(key)
    k = key[order]
    start = X._runs(k)
    least = np.repeat(np.minimum.reduceat(ids[order], start), np.diff(np.append(start, len(k)))) if len(k) else ids
    out = np.empty(len(key), bool)
    out[order] = ids[order] > least
    return out


def resolve_samples(context: np.ndarray, ids: np.ndarray, masks: np.ndarray, width: int) -> np.ndarray:
    """For each sample, the offsets d (as bits) whose string a smaller id holds too.

    ``context`` has the 30 bytes before a sample and the ``width`` from it; ``masks`` the
    offsets whose string lies within the document.
    """
    inside = width - BEFORE
    out = np.zeros(len(ids), np.int64)
    order, common = sort_suffixes(context[:, BEFORE:])
    tied = ranks(order, common, inside)
    some = np.flatnonzero(np.bincount(tied)[tied] > 1)  # the others tie with none
    if not len(some):
        return out
    clipped = [ranks(order, common, width - d)[some] for d in range(PERIOD)]
    before, alike = sort_suffixes(np.ascontiguousarray(context[some, BEFORE - 1 :: -1]))
    mine, valid = ids[some], masks[some]
    for d in range(PERIOD):
        has = np.flatnonzero(valid >> d & 1)
        if len(has):
            key = clipped[d][has] << 32 | ranks(before, alike, d)[has]
            out[some[has]] |= _later(key, mine[has]).astype(np.int64) << d
    return out


def resolve_strings(strings: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a smaller id holds the same string."""
    order, common = sort_suffixes(strings)
    return _later(ranks(order, common, strings.shape[1]), ids)


class _Flush:
    """Records of one kind that a map task has gathered."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.owners: list[np.ndarray] = []
        self.size = self.n_owners = 0

    def add(self, owners: np.ndarray, owner: np.ndarray, rows: np.ndarray, key: np.ndarray, place: np.ndarray, mask: np.ndarray, valid: np.ndarray) -> None:
        """``mask``: the strings to ask about; ``valid``: those that lie within the text."""
        self.parts.append((owner + self.n_owners, rows, key, place, mask, valid))
        self.owners.append(owners)
        self.n_owners += len(owners)
        self.size += len(owner)

    def packed(self, kind: int, n_buckets: int, n_parts: int) -> Iterator[tuple]:
        """Rows of ``PACKED``: of equal records one, the smallest id's; answers for the rest."""
        if not self.parts:
            return
        owners = np.concatenate(self.owners)
        owner, rows, key, place, mask, valid = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        if not len(owner):
            return
        content = byte_hashes(_padded(rows.ravel()), np.arange(len(rows)) * rows.shape[1], rows.shape[1])
        order = np.lexsort((owner, owners[owner, 2], content))
        start = X._runs(content[order])
        head = np.repeat(order[start], np.diff(np.append(start, len(order))))
        alike = (rows[order] == rows[head]).all(1)
        told = np.where(alike & (owners[owner[order], 2] > owners[owner[head], 2]), mask[order] & valid[head], 0)
        again = alike & (owner[order] == owner[head]) & (order != head) & (mask[order] == mask[head])
        twice = np.zeros(len(order), np.int64)
        twice[head[again]] = AGAIN
        some = np.flatnonzero(told)
        yield from _answers(owners, owner[order[some]], place[order[some]], told[some], n_parts, KNOWN)
        mask[order] &= ~told
        left = order[~again & (mask[order] != 0)]
        bucket = (key[left] >> U64(64 - (n_buckets.bit_length() - 1))).astype(np.int64)
        deal = np.argsort(bucket, kind="stable")
        for a, z in X._spans(bucket[deal]):
            some = left[deal[a:z]]
            who, local = np.unique(owner[some], return_inverse=True)
            at = int(bucket[deal[a]])
            yield at, kind, owners[who].tobytes(), local.astype(np.uint32).tobytes(), _ZSTD.compress(rows[some].tobytes(), asbytes=True), place[some].astype(np.uint32).tobytes(), (mask[some] | twice[some]).astype(np.uint32).tobytes()


def _answers(owners: np.ndarray, owner: np.ndarray, place: np.ndarray, mask: np.ndarray, n_parts: int, kind: int | None = None) -> Iterator[tuple]:
    """Answers dealt by their owner, many to a row."""
    if not len(owner):
        return
    part = X._parts(np.ascontiguousarray(owners[owner, 0]), n_parts)
    deal = np.argsort(part, kind="stable")
    for a, z in X._spans(part[deal]):
        some = deal[a:z]
        who, local = np.unique(owner[some], return_inverse=True)
        told = owners[who].tobytes(), local.astype(np.uint32).tobytes()
        numbers = place[some].astype(np.uint32).tobytes(), mask[some].astype(np.uint32).tobytes()
        yield (int(part[some[0]]), *told, *numbers) if kind is None else (int(part[some[0]]), kind, *told, b"", *numbers)


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _gathered(table: pa.Table, width: int | None) -> tuple[np.ndarray, ...]:
    """(owners, owner, byte rows, places, masks) of packed rows."""
    owners, owner, n = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)], 0
    for who, local in zip(table.column("owners").to_pylist(), table.column("owner").to_pylist(), strict=True):
        owners.append(np.frombuffer(who, np.int64).reshape(-1, 3))
        owner.append(np.frombuffer(local, np.uint32).astype(np.int64) + n)
        n += len(owners[-1])
    numbers = [np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint32).astype(np.int64) for c in ("places", "masks")]
    rows = None
    if width:
        sizes = [len(local) // 4 * width for local in table.column("owner").to_pylist()]
        raw = [_ZSTD.decompress(c, n, asbytes=True) for c, n in zip(table.column("bytes").to_pylist(), sizes, strict=True)]
        rows = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width)
    return np.concatenate(owners), np.concatenate(owner), rows, *numbers


def _hot(found: DataFrame) -> np.ndarray:
    """The samples of most postings, at most ``HOT_KEYS``, sorted."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["sample", "n"])

    rows = found.where("run is not null").select("run").mapInArrow(spread, "sample long, n long")
    return np.sort(np.array([r.sample for r in rows.orderBy(F.desc("n"), "sample").limit(HOT_KEYS).collect()], np.int64).view(U64))


def _extractor(width: int, n_filter: int, n_buckets: int, low: int, high: int, hot: np.ndarray):
    """Packed records of ``(text, h1, h2, id, cells, places, masks)``: samples of a block that passed, with their context."""
    inside = width - BEFORE

    def records(part: pa.RecordBatch, samples: _Flush, strings: _Flush) -> None:
        data, offsets = H.text_bytes(part.column(0))
        owners = np.stack([part.column(k).to_numpy() for k in (1, 2, 3)], axis=1)
        at, row = sampled(offsets, inside)
        around = np.concatenate([np.zeros(BEFORE, np.uint8), data, np.zeros(width + 8, np.uint8)])
        hashed = byte_hashes(around[BEFORE:], at, inside)
        bucket, rest = X.split(hashed, None, n_filter, KEY_BYTES)
        key = rest | bucket.astype(U64) << U64(8 * KEY_BYTES)
        cells = [X.unpacked(c, KEY_BYTES) for c in part.column(4).to_pylist()]
        of = np.repeat(np.arange(len(cells)), [len(c) for c in cells]).astype(U64)
        passed = np.isin(H.mix(key + H.mix(row.astype(U64))), H.mix(np.concatenate(cells) + H.mix(of)))
        at, row, hashed, key = at[passed], row[passed], hashed[passed], key[passed]
        often = np.isin(key, hot)
        if low == 0 and often.any():
            near = np.zeros(len(data) + 1, np.int64)
            np.add.at(near, np.maximum(at[often] - BEFORE, offsets[row[often]]), 1)
            np.add.at(near, at[often] + 1, -1)
            begin = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            holder = np.searchsorted(offsets, begin, side="right") - 1
            full = begin + width <= offsets[holder + 1]
            begin, holder = begin[full], holder[full]
            rows = np.lib.stride_tricks.sliding_window_view(around[BEFORE:], width)[begin]
            strings.add(owners, holder, rows, byte_hashes(around[BEFORE:], begin, width, 7), begin - offsets[holder], *(np.ones(len(begin), np.int64),) * 2)
        share = hashed & U64(SHARES - 1)
        mine = np.flatnonzero(~often & (share >= low) & (share < high))
        at, row, hashed = at[mine], row[mine], hashed[mine]
        least = np.maximum(0, width - (offsets[row + 1] - at))
        most = np.minimum(BEFORE, at - offsets[row])
        valid = np.where(least <= most, (2 << np.maximum(most, 0)) - (1 << least), 0)
        masks = valid.copy()
        known = np.zeros(len(data) + BEFORE, bool)  # strings that a block before has removed, BEFORE places on
        for k, (p, m) in enumerate(zip(part.column(5).to_pylist(), part.column(6).to_pylist(), strict=True)):
            if p:
                known[_begins(p, m) + offsets[k] + BEFORE] = True
        if known.any():
            back = np.lib.stride_tricks.sliding_window_view(known, PERIOD)[at]
            masks &= ~(back[:, ::-1] @ (1 << np.arange(PERIOD)))
        some = np.flatnonzero(masks)
        at, row, hashed, masks, valid = at[some], row[some], hashed[some], masks[some], valid[some]
        rows = np.lib.stride_tricks.sliding_window_view(around, BEFORE + width)[at]
        samples.add(owners, row, rows, hashed, at - offsets[row], masks, valid)

    def flushed(samples: _Flush, strings: _Flush) -> pa.RecordBatch:
        rows = [*samples.packed(SAMPLE, n_buckets, n_filter), *strings.packed(STRING, n_buckets, n_filter)]
        return _batch(rows, _PACKED)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, strings = _Flush(), _Flush()
        for batch in batches:
            for part in H.slices(batch):
                records(part, samples, strings)
                if samples.size + strings.size >= FLUSH:
                    yield flushed(samples, strings)
                    samples, strings = _Flush(), _Flush()
        yield flushed(samples, strings)

    return mapped


def _resolver(width: int, n_parts: int):
    """Answers of one bucket: its samples sorted and compared, and its strings."""

    def reduce(table: pa.Table) -> pa.Table:
        out = []
        kinds = np.array(table.column("kind").to_pylist())
        for kind, wide in ((SAMPLE, BEFORE + width), (STRING, width)):
            if (kinds == kind).any():
                owners, owner, rows, place, mask = _gathered(table.filter(pa.array(kinds == kind)), wide)
                ids = owners[owner, 2]
                found = resolve_samples(rows, ids, mask & AGAIN - 1, width) if kind == SAMPLE else resolve_strings(rows, ids).astype(np.int64)
                some = np.flatnonzero(found)
                out += _answers(owners, owner[some], place[some], found[some] | mask[some] & AGAIN, n_parts)
        return pa.Table.from_batches([_batch(out, _TOLD)])

    return reduce


def _merged(table: pa.Table) -> pa.Table:
    """(h1, h2, places, masks): one row for each owner of a part's answers."""
    owners, owner, _, place, mask = _gathered(table, None)
    _, first, one = np.unique(owners[:, :2], axis=0, return_index=True, return_inverse=True)
    who = one.ravel()[owner]
    order = np.argsort(who, kind="stable")
    edge = np.searchsorted(who[order], np.arange(len(first) + 1))
    place, mask = place[order].astype(np.uint32), mask[order].astype(np.uint32)
    cells = [[c[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:], strict=True)] for c in (place, mask)]
    return pa.table({"h1": pa.array(owners[first, 0]), "h2": pa.array(owners[first, 1]), "places": pa.array(cells[0], pa.binary()), "masks": pa.array(cells[1], pa.binary())})


def _begins(places: bytes, masks: bytes) -> np.ndarray:
    """Where the strings that answers remove begin."""
    at, bits = (np.frombuffer(c, np.uint32).astype(np.int64) for c in (places, masks))
    which, d = np.nonzero(bits[:, None] >> np.arange(PERIOD) & 1)
    return at[which] - d


def gone(text: np.ndarray, places: bytes, masks: bytes, width: int) -> np.ndarray:
    """Which bytes of a text the answers remove."""
    begins = np.zeros(len(text) + 1, bool)
    begins[_begins(places, masks)] = True
    if (np.frombuffer(masks, np.uint32) & U64(AGAIN)).any():  # the same context stands elsewhere in the text
        padded, every = _padded(text), np.arange(len(text) - width + 1)
        hashes = byte_hashes(padded, every, width)
        begins[every[np.isin(hashes, hashes[begins[: len(every)]])]] = True
    return H.covered(np.flatnonzero(begins), width, len(text))


def deduplicated(documents: DataFrame, *, width: int = 50, blocks: tuple[int, ...] = (SHARES // 4, SHARES), texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and the kept bytes if asked for.

    ``width`` is over 38; ``blocks``: the ends of the blocks that suffixes are handled in,
    in shares of ``SHARES``, the last at the end.  A small first block removes most of what
    many documents hold and spares the others that work.
    """
    if width <= BEFORE + 8:
        raise ValueError(f"width must be over {BEFORE + 8}")
    spark = documents.sparkSession
    scratch = Scratch(spark, "suffixes")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), text.alias("text"), F.sha2(text, 256).alias("sha"))

    def half(k: int) -> Column:
        return F.conv(F.substring("sha", 1 + 16 * k, 16), 16, -10).cast("long")

    rows = rows.select("*", half(0).alias("h1"), half(1).alias("h2"))
    n_filter, inside = buckets(documents), width - BEFORE
    classes = scratch.save(rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.max("id").alias("most")), "classes")

    def sample(b: pa.RecordBatch) -> Iterator[X.Held]:
        for part in H.slices(b):
            data, offsets = H.text_bytes(part.column(1))
            at, row = sampled(offsets, inside)
            yield part.column(0).to_numpy(), None, row, byte_hashes(_padded(data), at, inside), None

    found = X.packed(rows.select("h1", "text"), sample, n_filter, "shared", width=KEY_BYTES)
    found = scratch.save(X.answered(found, "shared", n_filter, width=KEY_BYTES, often=HOT_FLUSHES), "shared")
    hot = _hot(found)
    shared = X.merged(found).select(F.col("id").alias("h1"), "cells").where(F.length("cells") > 0)
    asked = scratch.save(classes.join(shared, "h1").select("h1", "h2", "id", "cells"), "asked")
    n_buckets, answers = n_filter, None
    told = spark.createDataFrame([], MERGED)
    for k, (low, high) in enumerate(zip((0, *blocks), blocks, strict=False)):
        cells = asked.join(told, ["h1", "h2"], "left")
        some = rows.select("text", "h1", "h2", "id").join(cells, ["h1", "h2", "id"]).select("text", "h1", "h2", "id", "cells", "places", "masks")
        records = scratch.save(some.mapInArrow(_extractor(width, n_filter, n_buckets, low, high, hot), PACKED), f"records{k}")
        known = records.where(F.col("kind") == KNOWN).select(F.col("bucket").alias("part"), "owners", "owner", "places", "masks")
        found = records.where(F.col("kind") != KNOWN).groupBy("bucket").applyInArrow(_resolver(width, n_filter), TOLD)
        block = scratch.save(found.union(known), f"block{k}")
        scratch.drop(f"records{k}")
        answers = block if answers is None else answers.union(block)
        told = scratch.save(answers.groupBy("part").applyInArrow(_merged, MERGED), f"told{k}")
    told = classes.select("h1", "h2", "id").join(told, ["h1", "h2"], "left")
    scratch.drop("asked", *(f"block{k}" for k in range(len(blocks))), *(f"told{k}" for k in range(len(blocks) - 1)))

    def cleaned(b: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in b:
            for part in H.slices(batch, "text"):
                yield _cleaned(part, width, texts)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    firsts = rows.select("doc_id", "text", "h1", "h2", "id").join(told, ["h1", "h2", "id"])
    firsts = firsts.select("doc_id", "text", "places", "masks").mapInArrow(cleaned, schema)
    # a hot text's copies are dealt over salts, and don't take their texts along
    salts = 16
    first = classes.where("most > id").select("h1", "h2", F.col("id").alias("first"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    light = rows.select("doc_id", "id", "h1", "h2", F.octet_length("text").cast("long").alias("n"), "sha", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), *[F.when(F.octet_length("text") < width, F.col("text").cast("binary")).otherwise(F.lit(b"")).alias("kept")] * texts)
    whole = F.col("n") >= width
    copies = light.join(first, ["h1", "h2", "salt"]).where("id > first").select("doc_id", F.col("n").alias("n_bytes"), F.when(whole, F.col("n")).otherwise(0).cast("long").alias("n_removed"), whole.cast("long").alias("n_spans"), F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha")).alias("kept_sha256"), *["kept"] * texts)
    return firsts.union(copies)


def _cleaned(part: pa.RecordBatch, width: int, texts: bool) -> pa.RecordBatch:
    data, offsets = H.text_bytes(part.column(1))
    raw = data.tobytes()
    n_removed, n_spans, digests, kept_texts = [], [], [], []
    for k, (places, masks) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
        a, z = int(offsets[k]), int(offsets[k + 1])
        removed, spans, text = 0, 0, raw[a:z]
        if places:
            out = gone(data[a:z], places, masks, width)
            removed, spans = int(out.sum()), int((out & ~np.append(False, out[:-1])).sum())
            text = data[a:z][~out].tobytes()
        n_removed.append(removed)
        n_spans.append(spans)
        digests.append(hashlib.sha256(text).hexdigest())
        kept_texts.append(text)
    columns = [part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return pa.RecordBatch.from_arrays([*columns, pa.array(kept_texts, pa.binary())] if texts else columns, names=[*names, "kept"] if texts else names)


#: Every string of 50 bytes as hexadecimal digits; texts are cut in pieces first, as a cut far into a text is slow.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
  SELECT r, doc_id, 1000 * c + j AS k, substr(piece, 2 * j - 1, 100) AS s
  FROM (SELECT r, doc_id, c, piece, unnest(generate_series(1, least(1000, len(piece) // 2 - 49))) AS j
    FROM (SELECT r, doc_id, c, substr(h, 2000 * c + 1, 2098) AS piece
      FROM (SELECT r, doc_id, h, unnest(generate_series(0, (len(h) // 2 - 50) // 1000)) AS c FROM docs WHERE len(h) >= 100)))
), firsts AS (SELECT s, min(doc_id) AS low FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)
), hits AS (SELECT r, k FROM strings JOIN firsts USING (s) WHERE doc_id > low
), marked AS (SELECT r, k, k - lag(k) OVER (PARTITION BY r ORDER BY k) AS gap FROM hits
), runs AS (
  SELECT r, k, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY k) AS run FROM marked
), spans AS (SELECT r, run, min(k) AS a, max(k) + 50 AS z FROM runs GROUP BY r, run
), pieces AS (
  SELECT r, run, z, substr(h, 2 * coalesce(lag(z) OVER w, 1) - 1, 2 * (a - coalesce(lag(z) OVER w, 1))) AS before, z - a AS n
  FROM spans JOIN docs USING (r) WINDOW w AS (PARTITION BY r ORDER BY run)
), cut AS (SELECT r, string_agg(before, '' ORDER BY run) AS kept, max(z) AS z, CAST(sum(n) AS BIGINT) AS n_removed, count(*) AS n_spans FROM pieces GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE kept || substr(h, 2 * z - 1) END)) AS kept_sha256
FROM docs LEFT JOIN cut USING (r)
"""

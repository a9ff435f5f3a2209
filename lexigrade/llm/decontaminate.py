"""Benchmark decontamination with one Aho-Corasick automaton over item windows.

Normalised text is its words, lower-cased in A-Z, each between single spaces.  Every
run of ``width`` consecutive words of a benchmark item is a pattern (a shorter item is
one pattern), and all patterns go into one automaton.  A document is normalised and
scanned once; an occurrence's end maps to a word number, and word numbers map to byte
offsets of the original text.

The automaton is broadcast.  It is only ever built over ``part_bytes`` of benchmark
text: a larger benchmark is cut into parts of that size, documents are scanned once a
part and the parts' spans are merged, so the broadcast has a fixed bound.

Cases: null and empty texts and texts without words have no words and no hits; items
without words have no window; repeated items count once; an item without id marks words
but isn't counted; an empty benchmark hits nothing; equal rows give equal results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words: anything but ASCII other than letters and digits, after lower-casing A-Z.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
PART_BYTES = 8 << 20

FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def normal(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8."""
    return WORD.findall(text.encode().lower()) if text else []


def automaton(items: list[tuple[int | str | None, str | None]], width: int) -> ahocorasick.Automaton:
    """All windows of the items; a value is (words of the window, ids of its items)."""
    found: dict[str, tuple[int, set]] = {}
    for item, text in items:
        words = normal(text)
        for k in range(max(1, len(words) - width + 1) if words else 0):
            some = words[k : k + width]
            found.setdefault(f" {b' '.join(some).decode()} ", (len(some), set()))[1].add(item)
    out = ahocorasick.Automaton()
    for pattern, value in found.items():
        out.add_word(pattern, value)
    out.make_automaton()
    return out


def occurrences(words: list[bytes], machine: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set]:
    """(first, end) word numbers of every occurrence, and the items that occur."""
    if not words or not len(machine):
        return [], set()
    hits = list(machine.iter(f" {b' '.join(words).decode()} "))
    if not hits:
        return [], set()
    # a word's closing space stands at the summed lengths so far plus one space a word
    closing = np.cumsum([len(w.decode()) + 1 for w in words])
    ends = np.searchsorted(closing, [h[0] for h in hits])
    return [(int(e) + 1 - n, int(e) + 1) for e, (_, (n, _)) in zip(ends, hits, strict=True)], set().union(*(h[1][1] for h in hits))


def _digest(n_words: int, spans: list[tuple[int, int]], items: set) -> tuple:
    hit = np.zeros(n_words + 1, np.int64)
    for a, b in set(spans):
        hit[a] += 1
        hit[b] -= 1
    n_hit = int((np.cumsum(hit[:-1]) > 0).sum()) if spans else 0
    names = sorted(str(x) for x in items if x is not None)
    return n_words, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0


def _parts(benchmark: DataFrame, part_bytes: int) -> Iterator[list[tuple[int | str | None, str]]]:
    """Benchmark items in lists of about part_bytes; one item at least in each."""
    part, size = [], 0
    for item, text in benchmark.select("item_id", "text").where("text is not null").distinct().toLocalIterator():
        if part and size + len(text) > part_bytes:
            yield part
            part, size = [], 0
        part.append((item, text))
        size += len(text)
    yield part


class Scanner:
    """Builds its automaton once a worker from a broadcast list of items."""

    def __init__(self, items, width: int):
        self.items, self.width, self.machine = items, width, None

    def __getstate__(self):
        return self.items, self.width, None

    def __setstate__(self, state):
        self.items, self.width, self.machine = state

    def __call__(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        if self.machine is None:
            self.machine = automaton(self.items.value, self.width)
        words = normal(text)
        return len(words), *occurrences(words, self.machine)


def _texts(column: pa.Array) -> Iterator[str | None]:
    for k in range(len(column)):
        yield column[k].as_py()


def _scanned(documents: DataFrame, benchmark: DataFrame, width: int, part_bytes: int) -> list[tuple[DataFrame, Scanner]]:
    context = documents.sparkSession.sparkContext
    return [Scanner(context.broadcast(part), width) for part in _parts(benchmark, part_bytes)]


def contamination(documents: DataFrame, benchmark: DataFrame, *, width: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    scanners = _scanned(documents, benchmark, width, part_bytes)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    if len(scanners) == 1:
        scan = scanners[0]

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [_digest(*scan(t)) for t in _texts(b.column(1))]
                columns = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.string(), pa.bool_()), strict=True))], names=["doc_id", *names])

        return rows.mapInArrow(mapped, f"doc_id long, {FOUND}")

    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    every = [rows.mapInArrow(_spans_of(scan), "rid long, doc_id long, n_words long, spans array<int>, items array<string>") for scan in scanners]
    both = every[0]
    for one in every[1:]:
        both = both.union(one)
    both = both.groupBy("rid", "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_digest(n, list(zip(s[::2], s[1::2], strict=True)), set(i)) for n, s, i in zip(*(b.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.string(), pa.bool_()), strict=True))], names=["doc_id", *names])

    return both.mapInArrow(merged, f"doc_id long, {FOUND}")


def _spans_of(scan: Scanner):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t) for t in _texts(b.column(2))]
            spans = [[x for s in set(f[1]) for x in s] for f in found]
            items = [[str(x) for x in f[2] if x is not None] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["rid", "doc_id", "n_words", "spans", "items"])

    return mapped


def hit_spans(documents: DataFrame, benchmark: DataFrame, *, width: int = 10) -> DataFrame:
    """(doc_id, start, end): byte spans of the original texts that benchmark windows cover."""
    scanners = _scanned(documents, benchmark, width, PART_BYTES)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")

    def mapper(scan: Scanner):
        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                for doc, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                    _, spans, _ = scan(text)
                    if spans:
                        at = [m.span() for m in WORD.finditer(text.encode().lower())]
                        out += [(doc, at[a][0], at[z - 1][1]) for a, z in sorted(set(spans))]
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "end"])

        return mapped

    every = [rows.mapInArrow(mapper(scan), "doc_id long, start long, end long") for scan in scanners]
    out = every[0]
    for one in every[1:]:
        out = out.union(one)
    return out


def without_contaminated(documents: DataFrame, benchmark: DataFrame, *, width: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of documents, all columns, in which no benchmark window occurs."""
    kept = documents
    for scan in _scanned(documents, benchmark, width, part_bytes):
        text = kept.columns.index("text")

        def mapped(batches: Iterator[pa.RecordBatch], scan=scan, text=text) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not scan(t)[1] for t in _texts(b.column(text))], pa.bool_()))

        kept = kept.mapInArrow(mapped, kept.schema)
    return kept


#: Columns doc_id, n_words, n_hit, n_items, items_sha256, contaminated.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), patterns AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM item_words WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM patterns
), grams AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM words, sizes WHERE len(w) >= n)
), hits AS (SELECT g.doc_id, g.k, g.n, p.item_id FROM grams g JOIN patterns p USING (n, gram)
), hit_words AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS i FROM hits) GROUP BY 1
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

"""Operators that search the corpus, against brute force on a small fixture with odd rows."""

import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from lexigrade.llm import cover_tree, exchange, fingerprint_index, hashing, suffix_dedup
from lexigrade.llm.components import components
from lexigrade.llm.jaccard_join import near_duplicates, one_of_each
from lexigrade.llm.scratch import Scratch

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, rid string, n int"


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    texts = [" ".join(word() for _ in range(r.randint(20, 80))) for _ in range(25)]
    base = texts[0].split()
    for _ in range(70):  # near copies, more than a token's block threshold
        some = list(base)
        for _ in range(r.randint(0, 3)):
            some[r.randrange(len(some))] = word()
        texts.append(" ".join(some))
    passage = " ".join(word() for _ in range(30))
    texts += [f"{word()} {word()} {passage}\n\t{word()}" for _ in range(8)]
    texts += [texts[5]] * 5 + [texts[5].upper(), "", None, " \t ", "one", "one", "two words", "x" * 9000, passage]
    rows = [(k, t, "s", "clash", 1) for k, t in enumerate(texts)]
    return rows + [(3, texts[3], "s", "clash", 1), (None, texts[5], None, None, None)]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3, "doc_id").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["a bb\tccc  d", "", None, "é ü", "x" * 100 + " y", "\x0b\x0c"]
    data, offsets = hashing.text_bytes(pa.array(texts))
    start, length, row = hashing.words(data, offsets)
    got = [[] for _ in texts]
    for a, n, k in zip(start, length, row, strict=True):
        got[k].append(data[a : a + n].tobytes().decode())
    assert got == [SPACE.findall(t or "") for t in texts]
    one, two = (hashing.word_hashes(*map(np.asarray, (np.frombuffer(b, np.uint8), [0], [len(b)]))) for b in (b"abcdefghi", b"abcdefghj"))
    assert one != two


def test_near_duplicates(documents):
    rows = documents.collect()
    sets = []
    for row in rows:
        w = SPACE.findall(lowered(row.text))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and None not in (rows[a].doc_id, rows[b].doc_id) and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[top(a)] = top(b)
    low = collections.defaultdict(list)
    for a, row in enumerate(rows):
        if row.doc_id is not None:
            low[top(a)].append(row.doc_id)
    want = sorted((str(row.doc_id), len(s), str(min(low[top(a)]) if row.doc_id is not None else None)) for a, (row, s) in enumerate(zip(rows, sets, strict=True)))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_duplicates(documents).collect()) == want
    kept = one_of_each(documents)
    assert kept.columns == documents.columns
    assert kept.count() == len({top(a) for a in range(len(rows))})


def test_window_dedup(documents):
    rows = documents.collect()
    held = collections.defaultdict(set)
    key = lambda r: float("inf") if r.doc_id is None else r.doc_id
    for row in rows:
        w = SPACE.findall(row.text or "")
        for k in range(len(w) - 12):
            held[tuple(w[k : k + 13])].add(key(row))
    want = []
    for row in rows:
        w = SPACE.findall(row.text or "")
        gone = {j for k in range(len(w) - 12) if min(held[tuple(w[k : k + 13])]) < key(row) for j in range(k, k + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((str(row.doc_id), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    for batches in (1, 4):
        got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in fingerprint_index.deduplicated(documents, batches=batches).collect()]
        assert sorted(got) == sorted(want)
    assert sum(w[2] for w in want) > 500


def test_the_operator_compacts(documents, monkeypatch):
    done = []
    compact = fingerprint_index.FingerprintIndex.compact

    def counting(index):
        held = len(index.runs)
        compact(index)
        done.append((held, len(index.runs)))

    monkeypatch.setattr(fingerprint_index.FingerprintIndex, "compact", counting)
    fingerprint_index.deduplicated(documents)
    assert done == [(3, 1)]


def test_index_compacts(spark, documents):
    index = fingerprint_index.FingerprintIndex(spark, 4, width=3, fan=1)
    batch = spark.createDataFrame([(1, "a b c d")], "id long, text string")
    assert exchange.merged(index.add(batch)).count() == 0
    index.add(spark.createDataFrame([(2, "x y z")], "id long, text string"))
    assert len(index.runs) == 1
    told = exchange.merged(index.add(spark.createDataFrame([(3, "b c d x y z")], "id long, text string"))).collect()
    assert [(r.id, len(exchange.unpacked(r.cells, 8))) for r in told] == [(3, 2)]


def without_strings(rows, width):
    """What the contract of suffix dedup says, string by string."""
    key = lambda r: float("inf") if r[0] is None else r[0]
    held = {}
    for row in rows:
        b = (row[1] or "").encode()
        for k in range(len(b) - width + 1):
            held[b[k : k + width]] = min(held.get(b[k : k + width], float("inf")), key(row))
    want = []
    for row in rows:
        b = (row[1] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if held[b[k : k + width]] < key(row):
                gone[k : k + width] = b"\1" * width
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        want.append((str(row[0]), len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(want)


def with_ties():
    """Texts of two letters and of repeated passages: ties far over the bytes that make a bucket."""
    r = random.Random(8)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 150))) * r.randint(1, 3) for _ in range(30)]
    passage = "the same long passage of words that stands in many a text, " * 4
    texts += [f"{r.random()} {passage[: r.randint(40, 200)]}{r.random()}" for _ in range(25)]
    return [(k % 50, t) for k, t in enumerate([*texts, "z" * 700, "z" * 900 + "y", *texts[:4]])] + [(None, passage), (None, passage)]


@pytest.mark.parametrize(("width", "hot"), [(50, 1000), (50, 1), (50, 2), (77, 2)])
def test_suffix_dedup(spark, documents, monkeypatch, width, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_FLUSHES", hot)
    some = spark.createDataFrame(with_ties(), "doc_id long, text string").repartition(5)
    for table in (some, documents)[: 2 if hot == 1000 else 1]:
        rows = [(r.doc_id, r.text) for r in table.collect()]
        got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(table, width=width).collect()]
        assert sorted(got) == without_strings(rows, width)
    kept = {r.kept_sha256: r.kept for r in suffix_dedup.deduplicated(some, width=width, texts=True).collect()} if hot == 1 else {}
    assert all(hashlib.sha256(text).hexdigest() == digest for digest, text in kept.items())


def test_samples_tie_by_ranks():
    """Strings that agree through their common sample's 20 bytes and beyond differ by ranks only."""
    base = np.frombuffer(b"0123456789" * 8, np.uint8)
    far, near = base.copy(), base.copy()
    far[79] ^= 1  # the last byte of offset 0 alone
    near[0] ^= 1  # the first byte of offset 30 alone
    found = suffix_dedup.resolve_samples(np.stack([base, far, near]), np.array([1, 2, 3]), np.full(3, (1 << 31) - 1), 50)
    assert found.tolist() == [0, (1 << 31) - 2, (1 << 30) - 1]
    order, common = suffix_dedup.sort_suffixes(np.stack([far, base, near])[:, 30:])
    texts = [bytes(x[30:]) for x in (far, base, near)]
    assert [texts[k] for k in order] == sorted(texts) and common.tolist()[1:] == [49, 50]


def test_cover_takes_any_two_positions():
    p, cover = suffix_dedup.PERIOD, set(suffix_dedup.COVER)
    assert all(any((i + d) % p in cover and (j + d) % p in cover for d in range(p)) for i in range(p) for j in range(p))


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8)).astype("f4")
    v[10:40] = v[0] + rng.normal(size=(30, 8)) * 0.15
    v[50:55] = v[1]
    rows = [(k, [float(x) for x in u]) for k, u in enumerate(v)] + [(60, None), (61, []), (62, [0.0] * 8), (63, [float("nan")] * 8), (64, [1.0, None] * 4), (65, [1.0, 2.0]), (None, [float(x) for x in v[1]])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=16).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    label = np.arange(60)
    for _ in range(60):
        label = np.array([label[near[k]].min() for k in range(60)])
    assert got == {k: (int(near[k].sum()) - 1, int(label[k]), k == label[k]) for k in range(60)} | {k: (0, k, True) for k in range(60, 66)} | {None: (0, None, None)}


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(50, 51), (51, 50)], "u long, v long")
    got = {r.node: r.component for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {50: 50, 51: 50}


@pytest.mark.parametrize("operator", [near_duplicates, fingerprint_index.deduplicated, suffix_dedup.deduplicated])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_vectors_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, n_links string, component_id int, kept string, rid long"
    rows = [(3, [1.0, 0.0], "x", 1, "y", 0)] * 2 + [(1, [2.0, 0.0], None, None, None, None), (2, [0.0, 1.0], "x", 1, "y", 0), (4, [1.0, 0.0, 0.0], "x", 1, "y", 0), (5, [], "x", 1, "y", 0), (6, [None, 1.0], "x", 1, "y", 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in cover_tree.near_vectors(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 2, 1, True), (2, 0, 2, True), (3, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)]
    assert cover_tree.near_vectors(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("ask", ["shared", "earlier"])
def test_a_bucket_needs_little_memory(monkeypatch, ask):
    """A few words a posting, and the same answers whatever the ranges."""
    import pyarrow as pa
    import pyarrow.compute as pc

    class Rows:
        def groupBy(self, _):
            return self

        def applyInArrow(self, function, _):
            return function

    rng = np.random.default_rng(4)
    posted = []
    for flush in range(4):
        keys = rng.integers(0, 1 << 63, 500_000, dtype=np.uint64) << np.uint64(1)
        keys[:1000] = np.arange(1000, dtype=np.uint64) << np.uint64(40)
        posted.append(exchange._pack([(np.arange(5000) + 5000 * flush, None, np.sort(rng.integers(0, 5000, len(keys))), keys, None)], 2, ask, 5))
    table = pa.Table.from_batches(posted)
    table = table.filter(pc.equal(table.column("bucket"), 0))
    reduce = exchange.answered(Rows(), ask, 2, make_run=ask == "earlier", often=3)
    tracemalloc.start()
    got = reduce(table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50 * 1_000_000
    assert any(r["part"] is not None for r in got.to_pylist())
    monkeypatch.setattr(exchange, "RANGE", 1 << 40)
    assert reduce(table).equals(got)


def test_near_vectors_without_structure_take_little_shuffle(spark):
    """Uniform vectors, which no bound prunes, with links and a chain planted: shuffled bytes go with the vectors, not their pairs."""
    rng = np.random.default_rng(9)
    n, dim = 1500, 64
    v = rng.normal(size=(n, dim)).astype("f4")
    v[600:640] = v[:40] + rng.normal(size=(40, dim)).astype("f4") * 0.2
    for k in range(1000, 1030):
        v[k] = v[k - 1] + rng.normal(size=dim) * 0.3
    v[1200:1205] = v[7]
    table = spark.createDataFrame([(k, [float(x) for x in u]) for k, u in enumerate(v)], "vec_id long, embedding array<float>")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    got = {r.vec_id: (r.n_links, r.component_id) for r in cover_tree.near_vectors(table, block=32).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    label = np.arange(n)
    for _ in range(40):
        label = np.array([label[near[k]].min() for k in range(n)])
    assert got == {k: (int(near[k].sum()) - 1, int(label[k])) for k in range(n)}
    assert written() - before < 8 * v.nbytes


def test_near_vectors_in_clusters(spark, monkeypatch):
    """Few pairs of blocks: they meet by a shuffle."""
    monkeypatch.setattr(cover_tree, "_met", None)
    rng = np.random.default_rng(2)
    v = np.repeat(np.eye(10), 24, axis=0) + rng.normal(size=(240, 10)) * 0.02
    rows = [(k, [float(x) for x in u]) for k, u in enumerate(v)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in cover_tree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=20).collect())
    assert got == [(k, 23, k // 24 * 24) for k in range(240)]

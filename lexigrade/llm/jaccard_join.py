"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents link when their sets of word shingles have Jaccard similarity of at
least ``percent`` / 100; the operator returns each document's connected component.

1. Shingle hashes (64 bits) of all documents meet once in a packed exchange.  A
   document learns which of its shingles any other row holds.  The rest, private
   shingles, can't be in an intersection, so a document with too few shared ones
   links with nothing and leaves here; most do.
2. Documents with equal sets become one class, so copies need no pairs.
3. Tokens are ordered by document frequency among classes, private ones first.  With
   t the least overlap a set of n can link by, its l-prefix is the first n - t + l
   tokens; two sets that link share l tokens of their l-prefixes, for the smaller of
   their l.  Each class lengthens its prefix as long as the estimated cost falls:
   postings times their frequency, plus verification of at most 1/l of those pairs.
4. A first round compares each class only with the leader it shares most prefix tokens
   with, so a large group of near copies falls together as a tree, not in all pairs.
   A leader has fewer private tokens than its followers, so trees have no cycles, and two
   hops up a tree give a class its group.
5. The second round counts prefix matches only of pairs from different groups.  A pair
   whose shared tokens, or whose matches plus the longer remainder of the two sets, can't
   reach the overlap isn't verified.  Rare tokens are joined with themselves.  For tokens
   of over ``_HOT`` classes, blocks of ``_BLOCK`` classes with their whole prefixes meet in
   one task, which counts all matches of a pair at once and returns only pairs to verify.
   All links between groups are found, so the components of the groups are those of the
   full join.

A pair's intersection is counted on the bits that the exchange keeps, 46 for 64 buckets
and one more for each doubling of the input: two different shingles of a pair of sets of
1,000 agree with a chance of 10^-8.

Cases: null and empty texts and texts without words have n_shingles 0 and link with
nothing; a text of fewer words than a shingle is one shingle; a null id is kept, its
row joins no component and its component_id is null; repeated rows are copies of each
other; an empty table gives an empty result; other columns of the input are ignored.
The input must give the same rows in the same partitions when read again (a table).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigrade.llm import hashing as H
from lexigrade.llm.components import components
from lexigrade.llm.exchange import answered, merged, packed, spare, unpacked
from lexigrade.llm.scratch import Scratch, buckets

#: Classes from which a token is joined by blocks, and classes in a block.
_HOT, _BLOCK = 48, 2048
_INFO = 4  # doc_id, whether it is null, set size, order-free set hash


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every row's distinct shingles; a short row's words are one."""
    n_rows = len(offsets) - 1
    data = H.LOWER[data]
    start, length, row = H.words(data, offsets)
    h = H.word_hashes(data, start, length)
    whole = H.full_windows(row, width)
    keys, at = H.window_hashes(h, width)[whole], row[: len(whole)][whole]
    n_words = np.bincount(row, minlength=n_rows)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        first = np.cumsum(n_words) - n_words
        one = np.full(len(short), 0, dtype=np.uint64)
        for k in range(width - 1):
            has = n_words[short] > k
            one[has] = H.mix(one[has] * np.uint64(3) + h[first[short][has] + k])
        keys, at = np.concatenate([keys, H.mix(one + n_words[short].astype(np.uint64))]), np.concatenate([at, short])
    order = np.lexsort((keys, at))
    keys, at = keys[order], at[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])
    return at[new], keys[new]


def _holder(width: int):
    def hold(batch: pa.RecordBatch) -> Iterator[tuple]:
        for part in H.slices(batch):
            data, offsets = H.text_bytes(part.column(2))
            row, keys = shingle_sets(data, offsets, width)
            n = np.bincount(row, minlength=part.num_rows)
            total = np.zeros(part.num_rows, dtype=np.uint64)
            np.add.at(total, row, H.mix(keys + np.uint64(17)))
            ids = part.column(1)
            info = np.stack([ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), n, total.view(np.int64)], axis=1)
            yield part.column(0).to_numpy(), info.astype(np.int64), row, keys, None

    return hold


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, doc_id, n, set_hash, tokens) of merged answers; tokens packed and sorted."""
    for b in batches:
        info = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64).reshape(-1, _INFO)
        cells = [np.sort(unpacked(x)).tobytes() for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(info[:, 0], mask=info[:, 1] == 1), pa.array(info[:, 2]), pa.array(info[:, 3]), pa.array(cells, pa.binary()), pa.array([len(x) // 8 for x in cells], pa.int64())],
            names=["rid", "doc_id", "n", "set_hash", "tokens", "n_shared"],
        )
        del cells
        spare()


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            cells = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), [len(c) for c in cells])), pa.array(np.concatenate(cells))], names=["rid", "token"])


def least_overlap(n, percent: int):
    return -(-percent * n // 100)


def _prefixes(percent: int):
    """Postings of each class's prefix, of the length that the estimated cost asks for."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for rid, n, tokens, dfs in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                tokens, dfs = np.asarray(tokens, np.int64), np.asarray(dfs, np.int64)
                private, t = n - len(tokens), least_overlap(n, percent)
                if private >= n - t + 1:
                    continue
                pairs = np.cumsum(dfs - 1)
                best = None
                step = 1
                while step <= t:
                    q = min(n - t + step - private, len(tokens))
                    cost = 4 * q + pairs[q - 1] * (1 + n / 64 / step)
                    if best is None or cost < best[0]:
                        best = (cost, q, step)
                    step *= 2
                _, q, step = best
                out[0] += [rid] * q
                out[1] += tokens[:q].tolist()
                for k, v in ((2, n), (3, step), (4, t - step), (5, private)):
                    out[k] += [v] * q
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["rid", "token", "n", "l", "rest", "private"])

    return mapped


def _verified(percent: int):
    """Pairs whose whole sets reach the similarity."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            nx, ny = b.column(1).to_numpy(), b.column(4).to_numpy()
            for k, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(5).to_pylist(), strict=True)):
                both = len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True))
                if 100 * both >= percent * (nx[k] + ny[k] - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3)], names=["u", "v"]).take(pa.array(keep, pa.int64()))

    return mapped


def _block_pairs(percent: int):
    """Pairs to verify between two blocks of classes that hold one frequent token."""

    def reduce(table: pa.Table) -> pa.Table:
        rid, n, rest, most, group, block = (table.column(c).to_numpy() for c in ("rid", "n", "rest", "most", "group", "block"))
        prefix = table.column("prefix").combine_chunks()
        holder = np.repeat(np.arange(len(rid)), np.diff(prefix.offsets.to_numpy()))
        _, token, held = np.unique(prefix.flatten().to_numpy(), return_inverse=True, return_counts=True)
        name = np.cumsum(held > 1) - 1
        keep = held[token] > 1
        holder, token = holder[keep], name[token[keep]]
        order = np.argsort(token, kind="stable")
        holder, token = holder[order], token[order]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        both = np.zeros((len(a), len(b)), np.float32)
        for low in range(0, int(name[-1]) + 1, 1024):
            some = slice(*np.searchsorted(token, [low, low + 1024]))
            has = np.zeros((len(rid), 1024), np.float32)
            has[holder[some], token[some] - low] = 1
            both += has[a] @ has[b].T
        us, vs = [], []
        for k, x in enumerate(a):
            sum_n = n[x] + n[b]
            good = (both[k] > 0) & (group[x] != group[b]) & (percent * np.maximum(n[x], n[b]) <= 100 * np.minimum(n[x], n[b]))
            good &= (100 + percent) * np.minimum(most[x], most[b]) >= percent * sum_n
            good &= (100 + percent) * (both[k] + np.maximum(rest[x], rest[b])) >= percent * sum_n
            y = rid[b[good]]
            y = y[y > rid[x]] if i == j else y
            us.append(np.minimum(y, rid[x]))
            vs.append(np.maximum(y, rid[x]))
        return pa.table({"x": pa.array(np.concatenate(us), pa.int64()), "y": pa.array(np.concatenate(vs), pa.int64())})

    return reduce


def _links(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    x = classes.select(F.col("rid").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx"))
    y = classes.select(F.col("rid").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty"))
    return pairs.select("x", "y").join(x, "x").join(y, "y").select("x", "nx", "tx", "y", "ny", "ty").mapInArrow(_verified(percent), "u long, v long")


def near_duplicates(documents: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``documents(doc_id, text)``."""
    return _joined(documents, width, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(documents: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents, all columns, without those that a kept row stands for.

    A component keeps its row of the smallest id (of repeated ones the first).  Rows
    without words or id stand for themselves.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    gone = _joined(documents, width, percent).where("not kept").select("rid")
    return rows.join(gone, "rid", "left_anti").select("row.*")


def _joined(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """(rid, doc_id, n_shingles, component_id, kept); rid numbers the rows as they are read."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = documents.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n_buckets = buckets(documents)
    answers = answered(packed(rows, _holder(width), n_buckets, "shared"), "shared", n_buckets, info_width=_INFO)
    docs = scratch.save(merged(answers, _INFO).mapInArrow(_unpacked, "rid long, doc_id long, n long, set_hash long, tokens binary, n_shared long"), "docs")

    alive = docs.where((F.col("n") > 0) & F.col("doc_id").isNotNull() & (100 * F.col("n_shared") >= percent * F.col("n")))
    key = ["n", "set_hash"]
    sets = scratch.save(alive.groupBy(*key).agg(F.min(F.struct("doc_id", "rid")).alias("first")).select(*key, "first.doc_id", "first.rid"), "sets")
    firsts = alive.select("rid", "n", "tokens").join(sets.select("rid"), "rid", "left_semi")
    firsts = scratch.save(firsts, "firsts")

    tokens = firsts.select("rid", "tokens").mapInArrow(_exploded, "rid long, token long")
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    held = tokens.join(df, "token").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))
    ordered = held.join(firsts.select("rid", "n"), "rid").select("rid", "n", F.col("held.token").alias("tokens"), F.col("held.df").alias("dfs"))
    postings = scratch.save(ordered.mapInArrow(_prefixes(percent), "rid long, token long, n long, l long, rest long, private long"), "postings")

    sized = f"{percent} * greatest(nx, ny) <= 100 * least(nx, ny)"
    leaders = postings.groupBy("token").agg(F.max(F.struct(-F.col("private"), F.col("n"), -F.col("rid"))).alias("top"), F.count("*").alias("df")).where("df > 1")
    leaders = leaders.select("token", (-F.col("top.col3")).alias("y"), F.col("top.n").alias("ny"))
    star = postings.join(leaders, "token").where("rid <> y").withColumnsRenamed({"rid": "x", "n": "nx"}).where(sized)
    star = star.groupBy("x", "y").agg(F.count("*").alias("both")).groupBy("x").agg(F.max(F.struct("both", (-F.col("y")).alias("y"))).alias("top")).select("x", (-F.col("top.y")).alias("y"))
    tree = scratch.save(_links(star, firsts, percent), "tree")
    up = tree.select(F.col("u").alias("v"), F.col("v").alias("above"))
    groups = scratch.save(tree.join(up, "v", "left").select(F.col("u").alias("rid"), F.coalesce("above", "v").alias("group")), "groups")

    near = postings.join(groups, "rid", "left").withColumn("group", F.coalesce("group", "rid"))
    near = near.select("token", "rid", "n", "rest", (F.col("n") - F.col("private")).alias("most"), "group")
    mixed = near.groupBy("token").agg(F.min("group").alias("a"), F.max("group").alias("b"), F.count("*").alias("held")).where("a <> b").select("token", "held")
    near = scratch.save(near.join(mixed, "token"), "near")
    often = near.where(F.col("held") > _HOT)
    hot = often.groupBy("rid").agg(F.count("*").alias("hot"))
    rare = near.where(F.col("held") <= _HOT).join(hot, "rid", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    x, y = (rare.select("token", *(F.col(c).alias(c + side) for c in ("rid", "n", "rest", "most", "group", "hot"))) for side in "xy")
    within = f"{100 + percent} * least(mostx, mosty) >= {percent} * (nx + ny)"
    pairs = x.join(y, "token").where(f"ridx < ridy and groupx <> groupy and {sized} and {within}")
    pairs = pairs.groupBy(F.col("ridx").alias("x"), F.col("ridy").alias("y")).agg(F.count("*").alias("both"), F.first(F.col("nx") + F.col("ny")).alias("sum_n"), F.first(F.greatest("restx", "resty") + F.least("hotx", "hoty")).alias("rest"))
    pairs = pairs.where(f"{100 + percent} * (both + rest) >= {percent} * sum_n").select("x", "y")
    whole = postings.join(hot.select("rid"), "rid", "left_semi").groupBy("rid").agg(F.collect_list("token").alias("prefix"))
    often = often.withColumn("blocks", F.ceil(F.col("held") / _BLOCK)).withColumn("block", F.pmod(F.xxhash64("rid"), "blocks"))
    often = often.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
    often = often.join(whole, "rid").select("token", "i", "j", "block", "rid", "n", "rest", "most", "group", "prefix")
    pairs = pairs.union(often.groupBy("token", "i", "j").applyInArrow(_block_pairs(percent), "x long, y long")).distinct()
    links = tree.union(_links(pairs, firsts, percent))
    of = groups.select(F.col("rid"), F.col("group"))
    links = links.join(of.withColumnsRenamed({"rid": "u", "group": "gu"}), "u", "left").join(of.withColumnsRenamed({"rid": "v", "group": "gv"}), "v", "left")
    links = links.select(F.coalesce("gu", "u").alias("u"), F.coalesce("gv", "v").alias("v")).where("u <> v").distinct()
    final = components(links, scratch).withColumnRenamed("node", "group")

    classes = sets.withColumnRenamed("rid", "node").join(groups.withColumnRenamed("rid", "node"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    named = classes.join(final, "group", "left").withColumn("component", F.coalesce("component", "group"))
    lowest = named.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("low"))
    named = named.join(lowest, "component").select(*key, F.col("low.doc_id").alias("component_id"), F.col("low.node").alias("keeper"))
    lone = (F.col("n") == 0) | F.col("doc_id").isNull() | (100 * F.col("n_shared") < percent * F.col("n"))
    rest = docs.where(lone).select("rid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    grouped = alive.select("rid", "doc_id", *key).join(named, key)
    return rest.union(grouped.select("rid", "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("rid") == F.col("keeper")).alias("kept")))

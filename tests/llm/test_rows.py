"""Operators on rows, and the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrade.llm import decontaminate, feistel, mixing, perspectives, pii, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_feistel_is_a_permutation_with_an_inverse():
    for n in (1, 2, 7, 1000, 4097):
        p = feistel.permuted(np.arange(n), n, 9)
        assert sorted(p) == list(range(n)) and (feistel.unpermuted(p, n, 9) == np.arange(n)).all()
    assert (feistel.permuted(np.arange(1000), 1000, 9) != feistel.permuted(np.arange(1000), 1000, 8)).any()


def test_sharding(spark):
    rows = [(k % 90 if k else None, "é" * (k % 7) if k % 5 else None, "en", "s", 1) for k in range(100)]
    got = feistel.sharded(spark.createDataFrame(rows, DOCS).repartition(5), keep=["doc_id", "text", "source"]).collect()
    sizes = collections.Counter(r.shard for r in got)
    assert len(got) == 100 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert all(r["size"] == len((r.text or "").encode()) + 1 for r in got)
    assert feistel.sharded(spark.createDataFrame([], DOCS)).count() == 0


def test_sharding_by_the_rule(spark):
    """Numbering, permutation, sizes and checksums against plain Python."""
    import zlib

    rows = [(k * 7 % 61, "é" * (k % 5) if k % 6 else None, "en", "s", 1) for k in range(61)]
    got = {r.doc_id: r for r in feistel.sharded(spark.createDataFrame(rows, DOCS).repartition(4), seed=5).collect()}
    n, mask = len(rows), (1 << 64) - 1
    half = max(1, ((n - 1).bit_length() + 1) // 2)

    def mix(h):
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD & mask
        h ^= h >> 29
        h = h * 0xC4CEB9FE1A85EC53 & mask
        return h ^ h >> 32

    def walked(at):
        while True:
            left, right = at >> half, at & (1 << half) - 1
            for k in range(feistel.ROUNDS):
                key = 5 * 0x9E3779B97F4A7C15 + k * 0xC2B2AE3D27D4EB4F + 1 & mask
                left, right = right, left ^ mix(right + key & mask) & (1 << half) - 1
            at = left << half | right
            if at < n:
                return at

    for number, (doc, text, *_) in enumerate(sorted(rows)):
        data, place = (text or "").encode(), walked(number)
        want = (len(data) + 1, zlib.crc32(data), "rows", place % 8, place // 8, None)
        assert tuple(got[doc])[1:] == want


def test_sharding_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a", "in", 7, "x", "y"), (None, None, None, None, None, None), (1, "a", "in", 7, "x", "y")], "doc_id long, text string, size string, _row long, `a.b` string, slot string")
    got = feistel.sharded(rows, keep=rows.columns)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "text", "size_before", "_row", "a.b", "slot_before"]
    assert sorted((r.size_before or "", r._row or 0, r["a.b"] or "", r.slot_before or "") for r in got.collect()) == [("", 0, "", ""), ("in", 7, "x", "y"), ("in", 7, "x", "y")]


def test_decontamination_takes_ids_of_text_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "tiny item here", "x"), (1, "tiny item here", "x"), (2, "no " * 40_000 + "tiny item", "y")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([("b", "tiny item"), ("a", "item here"), ("c", "other words")], "item_id string, text string")
    for part_bytes in (1 << 20, 10):
        got = decontaminate.contamination(docs, bench, part_bytes=part_bytes).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got) == [(1, 3, 3, 2), (1, 3, 3, 2), (2, 40_002, 2, 1)]
        assert {r.items_sha256 for r in got if r.doc_id == 1} == {hashlib.sha256(b"a,b").hexdigest()}


def test_decontamination(spark):
    docs = spark.createDataFrame([(1, "xx Alpha, beta GAMMA delta é one two three four five six yy"), (2, "nothing"), (3, None), (4, "tiny item here, tiny item")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, "alpha beta gamma delta é one two three four five six"), (2, "tiny item"), (3, ""), (4, None), (None, "nothing")], "item_id long, text string")
    for part_bytes in (1 << 20, 10):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, bench, part_bytes=part_bytes).collect()}
        assert got == {1: (13, 11, 1, True), 2: (1, 1, 0, True), 3: (0, 0, 0, False), 4: (5, 4, 1, True)}
    spans = {(r.doc_id, r.start, r.end) for r in decontaminate.hit_spans(docs, bench).collect()}
    assert (4, 0, 9) in spans and (4, 16, 25) in spans
    assert [r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()] == [3]
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_base_spans_match_the_patterns():
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fits(kind, value):
        digits = re.sub(r"\D", "", value)
        return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    r = random.Random(2)
    texts = ["a@b.c@d.e f@g x.y@z..q", "1.2.3.4.5.6.7.8.9 1..2.3.4.5 999.1.1.1.1.1.1.1", "4111 1111 1111 1111-2 4111-1111-1111-1111", "+1 (2 +12345678901 +1-22-33 44 55 6"]
    texts += ["".join(r.choice("ab1234567890..@@+ -()é") for _ in range(200)) for _ in range(300)]
    for text in texts:
        want = sorted(((k, m.start(), m.end()) for k in kinds for m in re.finditer(kinds[k], text) if fits(k, m.group())), key=lambda s: (s[1], pii.BASE.index(s[0])))
        assert pii.base_spans(text) == want


def test_personal_data(spark):
    text = 'Mail a.b@c.org or call +1 (275) 555-5927, token = "0b96a8c8d79c4a5085c919698889f59b", version 1.2.3'
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "7" * 50_000), (None, "plain words only")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.found(rows).collect()}
    assert (got[1].n_email, got[1].n_phone, got[1].spans.count("secret")) == (1, 1, 1)
    assert [got[k].spans for k in (2, 3, 4, None)] == [""] * 4
    assert pii.redacted(rows).where("doc_id = 1").first().text == 'Mail [EMAIL] or call [PHONE], token = "[SECRET]", version 1.2.3'


def test_personal_data_query_against_the_patterns(spark):
    r = random.Random(6)
    words = ["a.b@c.org", "10.2.3.4", "4111 1111 1111 1111", "+1 (275) 555-5927", "plain", "é", "999.1.1.1", "123-45-6789"]
    texts = [" ".join(r.choice(words) for _ in range(30)) for _ in range(40)]
    rows = spark.createDataFrame([(k % 30, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    want = []
    for k, text in enumerate(texts):
        base = pii.base_spans(text)
        digest = hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in base).encode()).hexdigest()
        want.append((k % 30, *(sum(s[0] == kind for s in base) for kind in pii.BASE), digest))
    got = pii.found(rows).collect()
    assert sorted((x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in got) == sorted(want)
    assert pii.found(rows.where("false")).count() == 0


def test_spans_are_chosen_in_time_near_linear():
    import time

    text = " ".join(f"u{k}@host.org token=XK29DJ38QQ71Z{k}" for k in range(8000))
    began = time.process_time()
    spans = pii.all_spans(text, pii.base_spans(text), pii.model())
    assert len(spans) >= 8000 and all(a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))
    assert time.process_time() - began < 20


def recalled(r, kind):
    """A text with one planted span of the kind, and where it is."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    made = {
        "email": lambda: ("write to ", f"{r.choice('abc')}{digits(3)}@mail{digits(2)}.example.org"),
        "ip": lambda: ("host ", ".".join(str(r.randrange(256)) for _ in range(4))),
        "phone": lambda: ("call ", f"+{r.randint(1, 9)} {digits(3)} {digits(4)} {digits(3)}"),
        "secret": lambda: (r.choice(("token = ", 'password: "', "api_key=")), "".join(r.choice("ABCDEFGHKLMNPQRSTUVWXYZabcdefghkmnpqrstuvwxyz23456789") for _ in range(r.randint(16, 40)))),
    }[kind]()
    head = "the river runs below the old mill " * r.randint(1, 3) + made[0]
    return head + made[1] + " and then goes on", len(head), len(head) + len(made[1])


@pytest.mark.parametrize("kind", ["email", "ip", "phone", "secret"])
def test_planted_personal_data_is_found(kind):
    r = random.Random(13)
    hit = 0
    for _ in range(200):
        text, a, b = recalled(r, kind)
        hit += any(k == kind and x <= a and b <= y for k, x, y in pii.all_spans(text, pii.base_spans(text), pii.model()))
    assert hit >= 180, hit


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 130, None, "late"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (1, None, "ann", "?")]
    got = {(r.conv_id, r.perspective, r.part): r for r in perspectives.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 3 * 3 + 1
    one = got[(1, "ann", 0)]
    assert one.rendered == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    (a, z), = [tuple(map(int, s.split(":"))) for s in one.spans.split(",")]
    assert one.rendered[a:z] == "hi < |im_end|><|im_end|>"
    assert got[(1, "bob", 2)].n_trained == 0 and got[(1, "unknown", 2)].n_trained == 1


@pytest.fixture(scope="module")
def judged(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    docs, labels = [], []
    for k in range(400):
        words = [word() for _ in range(40)]
        bad = r.random() < 0.3
        if bad:
            words[r.randrange(40)] = r.choice(["rotten", "vilest", "zzgrim"])
        for j in range(9, 40, 10):
            words[j] += "."
        docs.append((k, " ".join(words), "en", f"s{k % 3 if k % 2 else 0}", 1))
        labels.append((k, 1, int(bad)))
    docs += [(900, None, None, None, None), (901, "", "en", "s0", 0), (None, "x y", "en", "s1", 1), (5, docs[5][1], "en", "s2", 1)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(judged):
    docs, labels = judged
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.toxic for r in rows) >= 0.95 * len(rows)
    spans = toxicity.offending_sentences(docs, model).limit(20).join(docs, "doc_id").collect()
    assert spans and all(re.search("rotten|vilest|zzgrim", r.text[r.start : r.end]) for r in spans)
    odd = {r.doc_id: r for r in toxicity.scored(docs.where("doc_id >= 900 or doc_id is null"), model).collect()}
    assert len(odd) == 3 and all(r.score < 0.5 for r in odd.values())
    empty = toxicity.train(docs, labels.where("false"))
    assert toxicity.scored(docs, empty).where("score <> 0").count() == 0


def test_toxicity_model_is_the_same_each_time(judged, spark):
    docs, labels = judged
    twice = docs.union(spark.createDataFrame([(k, f"rotten words {k}", "en", "s", 1) for k in range(0, 40)], DOCS))
    one, two = (toxicity.train(twice.repartition(n), labels) for n in (2, 7))
    assert (one.words == two.words).all() and np.allclose(one.weights, two.weights) and one.bias == pytest.approx(two.bias)


def test_noisy_or_by_hand():
    column, sentence, doc_of, labels = np.array([0, 1]), np.array([0, 2]), np.array([0, 0, 1]), np.array([1, 0])
    weights, bias = toxicity.fit(column, sentence, doc_of, labels, 2)
    assert weights[0] > 1 and weights[1] < 0.1  # the toxic document's word, not the clean one's
    p = lambda z: 1 / (1 + np.exp(-z))
    want = [1 - (1 - p(2.0)) * (1 - p(-1.0)), p(0.5), p(-7.0)]
    assert np.allclose(toxicity.noisy_or(np.array([2.0, -1.0, 0.5]), np.array([0, 0, 1]), 3, -7.0), want)


def test_mix_plans():
    tokens = {"a": 900, "b": 90, "c": 10, "d": 0}
    mix = mixing.plan(tokens, repeat_limit=3.0)
    assert max(mix.epochs.values()) == pytest.approx(3 * min(mix.epochs.values())) and min(mix.epochs.values()) == pytest.approx(1)
    goal = 0.9
    assert mixing.entropy(mixing.plan(tokens, target_entropy=goal).weights) == pytest.approx(goal)
    assert mixing.plan({}).weights == {} and mixing.plan(tokens).exponent == 1.0


def test_mixing(judged):
    docs, _ = judged
    sized = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()]
    tokens = collections.Counter()
    for _, s, n in sized:
        tokens[s] += n
    mix = mixing.plan(tokens, repeat_limit=1.5)
    got = mixing.mixed(docs).collect()
    spent = collections.Counter()
    for r in got:
        spent[r.source] += r.n_tokens
    longest = max(n for *_, n in sized)
    for s, e in mix.epochs.items():
        assert e * tokens[s] - 2 * longest <= spent[s] <= e * tokens[s] + 1
    assert {(r.doc_id, r.source) for r in got if r.epoch == 0} == {(d, s) for d, s, _ in sized}
    half = mixing.mixed_documents(docs, budget=sum(tokens.values()) / 2)
    assert half.columns == docs.columns and half.count() < docs.count()


def test_pipeline(spark, judged, tmp_path):
    import corpus_pipeline

    docs, labels = judged
    leak = " ".join(f"leak{k}" for k in range(12))
    docs = docs.union(spark.createDataFrame([(950, f"start {leak} end", "en", "s0", 1), (951, docs.first().text + " more", "en", "s0", 1)], DOCS))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "temperature_mixing", "feistel_sharding"]
    out = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "text", "shard", "slot").collect()
    texts = {r.text for r in out}
    assert not any(t and re.search("rotten|vilest|zzgrim|leak3", t) for t in texts)
    clean = [r.text for r in docs.collect() if r.text and not re.search("rotten|vilest|zzgrim|leak3", r.text)]
    assert len(texts - {None}) >= len(set(clean)) - 3
    sizes = collections.Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert F is not None


def test_long_and_capital_secrets_go_whole(spark):
    r = random.Random(3)
    made = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    token, key = made("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789_-", 600), made("0123456789abcdef", 300)
    assert pii.candidates(f"token={token} x") == [("secret", 6, 606)]
    assert ("secret", 4, 304) in pii.candidates(f"see {key} here")
    assert pii.candidates("THE PASSWORD=XK29DJ38QQ71ZMPL GOES")[0] == ("secret", 13, 29)
    assert pii.candidates("paſſword=XK29DJ38QQ71ZMPL")[0] == ("secret", 9, 25)
    texts = [f"use token={token} now", f"the secret: {key} now", "THE PASSWORD=XK29DJ38QQ71ZMPL GOES"]
    rows = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOCS)
    got = {x.doc_id: x.text for x in pii.redacted(rows).collect()}
    assert got == {0: "use token=[SECRET] now", 1: "the secret: [SECRET] now", 2: "THE PASSWORD=[SECRET] GOES"}


def test_perspectives_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, part string, perspective string, n_messages int"
    rows = [(1, 0, "ann", "hi", "p", "q", 9)] * 2 + [(1, 1, "bob", "w " * 40_000, None, None, None), (2, 0, "system", None, "p", "q", 9), (None, None, None, None, None, None, None)]
    got = {(r.conv_id, r.perspective): r for r in perspectives.rendered(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    assert (got[1, "ann"].n_messages, got[1, "ann"].n_trained, got[1, "bob"].n_trained) == (3, 2, 1)
    assert got[1, "ann"].rendered.startswith("<|im_start|>assistant\nhi<|im_end|>\n" * 2)
    assert got[1, "bob"].rendered.count("w ") == 40_000 and got[None, "unknown"].n_trained == 1
    assert perspectives.rendered(spark.createDataFrame([], schema)).count() == 0


def test_mixing_of_odd_rows(spark):
    schema = "doc_id long, text string, source string, copies int, _at string, `a.b` string, epoch long"
    rows = [(1, "a b c", "x", 7, "q", "r", 3)] * 3 + [(2, None, "x", None, None, None, None), (None, "a b", None, 7, "q", "r", 3), (None, None, None, None, None, None, None), (3, "w " * 30_000, "y", 1, "q", "r", 0), (4, "", "z", 1, "q", "r", 0)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    found, given = (collections.Counter(map(tuple, x)) for x in (got.collect(), rows))
    assert set(found) == set(given) and all(found[r] >= n for r, n in given.items())
    assert all(found[r] == 1 for r in given if not r[1])
    empty = spark.createDataFrame([], schema)
    assert mixing.mixed(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mixing_settles_ties_of_the_budget(spark):
    rows = spark.createDataFrame([(k, "one two three", "x", "s", 1) for k in range(40)], "doc_id long, text string, source string, lang string, n_chars long")
    one, two = (sorted(r.doc_id for r in mixing.mixed(rows.repartition(n), budget=61.0).collect()) for n in (1, 7))
    assert one == two and len(one) == 20 == len(set(one))


def test_toxicity_of_odd_rows(judged, spark):
    docs, labels = judged
    clash = labels.union(spark.createDataFrame([(k, None, 1 - (k % 2)) for k in range(40)] + [(None, 1, 1), (1, 1, None)], labels.schema))
    model = toxicity.train(docs, clash.repartition(3))
    again = toxicity.train(docs.repartition(3), clash)
    assert (model.words == again.words).all() and np.allclose(model.weights, again.weights)
    odd = spark.createDataFrame([(1, "rotten. " * 20_000, "a", 1.0), (1, "plain abc", "b", 2.0), (1, "plain abc", "b", 2.0), (None, None, None, None)], "doc_id long, text string, held_out string, score double")
    rows = toxicity.scored(odd, toxicity.train(docs, labels)).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and [r.predicted for r in rows].count(1) == 1
    assert toxicity.scored(docs.where("false"), model).count() == 0


def test_pipeline_against_brute_force(spark, judged, tmp_path):
    """What is left, document by document; only the toxicity scores are the operator's own."""
    import corpus_pipeline

    docs, labels = judged
    r = random.Random(8)
    leak = " ".join(f"leak{k}" for k in range(12))
    first = docs.where("doc_id = 1").first().text.split()
    near = [(700 + k, " ".join(w if j != k else "zz" for j, w in enumerate(first * 3)), "en", "s1", 1) for k in range(3)]
    spread = [(720 + k, " ".join(r.choice("abcdefgh") * 3 for _ in range(30)) + (f" {leak}" if k % 2 else " leak1 leak2"), "en", "s1", 1) for k in range(6)]
    docs = docs.union(spark.createDataFrame(near + spread, DOCS))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "text", "shard", "slot").collect()

    stored = spark.read.parquet(str(tmp_path / "documents.parquet"))
    toxic = {(x.doc_id, x.predicted) for x in toxicity.scored(stored, toxicity.train(stored, labels)).collect()}
    left = [x for x in stored.collect() if (x.doc_id, 1) not in toxic]

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets, lead = [shingles(x.text) for x in left], {}
    for a, x in enumerate(left):  # the least id of a group stays
        group, todo = {a}, [a]
        while todo:
            one = todo.pop()
            linked = {b for b in range(len(left)) if sets[one] and 100 * len(sets[one] & sets[b]) >= 80 * len(sets[one] | sets[b])} - group
            group |= linked
            todo += linked
        lead[a] = x.doc_id is None or x.doc_id == min(left[b].doc_id for b in group if left[b].doc_id is not None)
    window = [f"leak{k}" for k in range(12)]
    runs = {tuple(window[k : k + 10]) for k in range(3)}
    clean = lambda t: not any(w in runs for w in zip(*(re.findall("[a-z0-9]+", (t or "").lower())[k:] for k in range(10)), strict=False))
    want = {(x.doc_id, x.text) for k, x in enumerate(left) if lead[k] and clean(x.text)}
    assert {(x.doc_id, x.text) for x in out} == want
    assert {720, 722, 724} <= {x.doc_id for x in out} and not {721, 723, 725} & {x.doc_id for x in out}
    assert sorted((x.shard, x.slot) for x in out) == sorted((k % 8, k // 8) for k in range(len(out)))


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

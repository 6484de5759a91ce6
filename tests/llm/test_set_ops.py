"""N-gram join, WARC, sharding, mixing, neighbours, preferences, pipeline: against brute force, and on edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from attestor.llm import ann, mixing, ngram_join, preferences, sharding, warc
from attestor.llm.common import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, size long, shard int"
EDGES = [(1, None, "en", None, 0, 1, 1, 1), (2, "", None, "s", 0, 1, 1, 1), (3, "One Two", "en", "s", 7, 1, 1, 1), (4, "one two", "en", None, 7, 1, 1, 1), (4, "one two", "en", None, 7, 1, 1, 1), (None, "null id words here and there", "fr", "s", 1, 1, 1, 1), (6, "w x y z " * 20000, "en", "t", 1, 1, 1, 1)]


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t), 0, 0, 0) for k, t in enumerate(texts)], DOCS)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def shingles(text, width):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def groups_by_hand(rows, width, percent):
    sets = [(d, shingles(t, width)) for d, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    low = {}
    for k, (d, _) in enumerate(sets):
        if d is not None:
            low[root(k)] = min(low.get(root(k), d), d)
    return sorted(((d, len(s), low.get(root(k), d)) for k, (d, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_against_brute_force(spark, monkeypatch, width, percent):
    monkeypatch.setattr(ngram_join, "FREQUENT", 6)  # so that the small case has frequent tokens
    rng = random.Random(width)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for n, length, edits in ((30, 90, 6), (25, 200, 14), (8, 24, 2), (12, 400, 30)):
        texts += family(rng, [word() for _ in range(length)], n, edits)
    texts += [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(10)]) for _ in range(25)]
    texts += [texts[0]] * 9 + ["short one"] * 3 + ["a b c d"] * 2
    rng.shuffle(texts)
    df = docs_of(spark, texts).unionByName(spark.createDataFrame(EDGES, DOCS).withColumn("doc_id", ngram_join.F.col("doc_id") + 1000))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_groups(df, width, percent).collect()), key=str)
    rows = list(enumerate(texts)) + [(e[0] and e[0] + 1000, e[1]) for e in EDGES]
    assert got == groups_by_hand(rows, width, percent)


def test_ngram_join_bounds():
    rng = np.random.default_rng(1)
    for n in (5, 300, 3000):
        x = np.unique(rng.integers(0, 1 << 62, n))
        y = np.unique(np.concatenate([x[: int(n * 0.93)], rng.integers(0, 1 << 62, n // 20)]))
        if ngram_join.is_linked(x, y, 80):
            apart = int(np.bitwise_count((ngram_join.sketch(x) ^ ngram_join.sketch(y)).view(np.uint64)).sum())
            assert 180 * apart <= 20 * (len(x) + len(y))
            for factor in ngram_join.ORDERS:
                assert np.intersect1d(ngram_join.prefix_under(x, factor, 80), ngram_join.prefix_under(y, factor, 80)).size
        z = np.unique(rng.integers(0, 1 << 62, n))
        assert not ngram_join.is_linked(x, z, 80)
    assert [ngram_join.prefix_size(n, 85) for n in (0, 1, 2, 7, 100)] == [0, 1, 1, 2, 16]


def test_ngram_join_counts_every_shingle():
    n = 5_000_000  # at 40 bits about 11 pairs of hashes fall together
    text = " ".join(map(str, range(n)))
    assert len(ngram_join.shingle_hashes(text, 4, ngram_join._WordHashes())) == n - 3


def test_keep_one_by_rows(spark):
    rng = random.Random(3)
    a, b, c, d = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(4))
    # repeated rows; a copy whose id a different text has too; null ids, alone and beside others; wordless texts
    rows = [(1, a)] * 3 + [(2, a), (2, b), (3, b + " end")] + [(None, c)] * 5 + [(None, d), (9, d), (8, d), (8, d)] + [(4, ""), (4, ""), (None, None)]
    df = spark.createDataFrame([(k, t, "en", "s", 0, n, 0, 0) for n, (k, t) in enumerate(rows)], DOCS).repartition(3)
    out = ngram_join.keep_one(spark, df, "")
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, a), (2, b), (None, c), (8, d), (4, ""), (4, ""), (None, None)], key=str)
    assert ngram_join.keep_one(spark, df.limit(0), "").count() == 0


def test_ngram_join_empty(spark):
    assert ngram_join.join_groups(spark.createDataFrame([], DOCS)).count() == 0


PAGES = "page_id long, url string, html string, record_id string, segment int"


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 40000 + "</p>"
    rows = [(1, "http://a/", "x" * 999), (2, "http://b/", "x" * 999), (3, "u\r\nv", "y" * 1000), (4, None, "y" * 1000), (5, "u", big), (6, "u", big), (7, "u", None), (8, "u", ""), (9, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n0\r\n\r\n" * 50), (10, "u", big + "!"), (10, "u", big + "!"), (None, "u", "z" * 2000), (9007199254740993, "u", "q" * 70000)]
    pages = spark.createDataFrame([(*r, "r", 1) for r in rows], PAGES)
    path = f"{tmp_path}/w"
    warc.write_archives(warc.with_revisits(pages), path, archive_bytes=50_000)
    whole = warc.reassemble(warc.read_records(spark, path))
    got = sorted(map(tuple, warc.digests(whole).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        last = max((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        visit = i is not None and len(b) >= 1000 and last != i
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if visit else "response", last if visit else None))
    assert got == sorted(want, key=str)
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in whole.where("type = 'response'").collect()}
    assert texts[10] == big + "!" and texts[7] == ""


def test_warc_faults(spark):
    body = b"some body" * 1000
    assert warc.unchunked(warc.chunked(body, 7)) == body and warc.unchunked(b"0;ext\r\n\r\n") == b""
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"no size"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    parts = list(warc.parse_archive(b"".join(r + warc.END for r in warc.records_of("1", "u", "h" * 60000, None))))
    assert [p[5] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1][6] == sum(len(p[7]) for p in parts)
    df = spark.createDataFrame(parts[:1] + parts[2:], warc.FIELDS)
    with pytest.raises(Exception, match="segments do not fit"):
        warc.reassemble(df).collect()
    empty = spark.createDataFrame([], PAGES)
    assert warc.with_revisits(empty).count() == 0


def test_sharding(spark):
    rng = random.Random(1)
    texts = ["t" * rng.randrange(2000) for _ in range(1500)] + ["hot text " * 40] * 700
    df = docs_of(spark, texts).unionByName(spark.createDataFrame(EDGES, DOCS))
    for leaf in (500_000, 40):
        rows = sharding.shard_by_bytes(df, 7, leaf_rows=leaf).collect()
        assert len(rows) == len(texts) + len(EDGES)
        size, slots = {}, {}
        for r in rows:
            size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert set(size) <= set(range(7))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        most = max(r["size"] for r in rows)
        mean = sum(size.values()) / 7
        assert all(abs(v - mean) <= most + 0.01 * mean for v in size.values())
    one = next(r for r in rows if r["doc_id"] == 6)
    assert one["text_crc32"] == zlib.crc32(("w x y z " * 20000).encode()) and one["size"] == 160016
    null = next(r for r in rows if r["doc_id"] == 1 and r["size"] == 16)
    assert null["text_crc32"] == 0
    assert sharding.shard_by_bytes(spark.createDataFrame([], DOCS), 7).count() == 0


def test_water_fill(spark):
    src = spark.createDataFrame([("a", 3, 100), ("b", 1, 1000), (None, 2, 50), ("z", 3, 0)], "source string, weight int, source_size long")
    got = {r["source"]: r["target"] for r in mixing.water_fill(src, 1150 * 1.5).collect()}
    assert got["a"] == 200 and got[None] == 100 and got["z"] == 0
    assert got["b"] == pytest.approx(1150 * 1.5 - 300)


def test_mix(spark):
    rng = random.Random(6)
    rows = [(k, "w " * rng.randrange(1, 400), "en", rng.choice(["a", "a", "a", "b", "c", None]), 1, 0, 0, 0) for k in range(900)]
    df = spark.createDataFrame(rows + [(e[0] and e[0] + 5000, *e[1:]) for e in EDGES], DOCS)
    first, again = (sorted(map(tuple, mixing.mix_documents(df).collect()), key=str) for _ in range(2))
    assert first == again and len(first) == len(rows) + len(EDGES)
    out = mixing.mix_documents(df).collect()
    taken, target, mean = {}, {}, {}
    for r in out:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        mean.setdefault(r["source"], []).append(r["size"])
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in out))
    for s in target:
        if s != "t":  # its one document is all of it
            assert abs(taken[s] - target[s]) <= 2 * max(mean[s])
    copies = mixing.take_mix(spark, df, "").groupBy("doc_id").count().collect()
    times = {r["doc_id"]: r["times"] for r in out}
    assert all(r["count"] == times[r["doc_id"]] for r in copies if r["doc_id"] != 5004)
    assert mixing.mix_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_ann_recall_and_edges(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[500:1300] = x[7]  # a hot vector
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    rows += [(9000, None, 1), (9020, [0.0] * 24, 1), (9040, [float("nan")] * 24, 1), (9060, [1.0] * 3, 1), (9080, [None] * 24, 1), (None, [1.0] * 24, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 3000, 20))
    hit = 0
    for q, got in found.items():
        s = ann.exact_products(x.astype(np.float64), x[q])
        best = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        got.sort()
        assert [r for r, *_ in got] == list(range(1, 21)) and all(s[i] == v for _, i, v in got)
        hit += len(set(best) & {i for _, i, _ in got})
    assert hit / (20 * len(found)) >= 0.9
    few = df.where("vec_id < 3")
    assert ann.search(few, few).count() == 6
    none = df.where("vec_id > 10000")
    assert ann.search(none, none).count() == 0


def test_preferences(spark):
    turns = [(0, 0, "user", "hi", "x"), (0, 1, "assistant", "yo", "x"), (0, 2, "user", "bye", "x"), (0, 3, "assistant", "ok", "x"), (1, 0, "user", "a", "x"), (1, 1, "assistant", "ok", "x"), (2, 0, None, None, "x"), (3, 0, "user", "q", "x"), (None, 0, "user", "lost", "x"), (5, 0, "user", "q", "x"), (5, 0, "user", "q", "x"), (5, 1, "assistant", "é", "x"), (4, 1, "assistant", "z", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, prompt string")
    out = {r["pair_id"]: r for r in preferences.format_pairs(preferences.with_swapped_answers(df)).collect()}
    assert set(out) == {0, 1, 2, 3, 4, 5}
    r = out[0]
    assert r["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user|>\nbye<|end|>\n<|assistant|>\nok<|end|>\n"
    assert r["chosen"] == r["rejected"] == "" and r["chosen_spans"] == [], "equal conversations have no completions"
    r = out[5]
    assert r["prompt"].count("<|user|>") == 2 and r["chosen"] == "<|assistant|>\né<|end|>\n"
    (span,) = r["chosen_spans"]
    assert r["chosen"][span["from"] : span["to"]] == "é<|end|>\n"
    assert out[2]["rejected"] is None and out[2]["prompt"] == "<|user|>\n<|end|>\n"
    # where conv_id / 2 is odd, the rejected one parts half-way
    parted = [(6, k, "assistant" if k % 2 else "user", f"a{k}", k) for k in range(6)] + [(7, k, "assistant" if k % 2 else "user", f"b{k}" if k != 2 else "a2", k) for k in range(5)]
    r = {r["pair_id"]: r for r in preferences.format_pairs(preferences.with_swapped_answers(spark.createDataFrame(parted, "conv_id long, turn long, role string, text string, pair int"))).collect()}
    assert r[6]["prompt_turns"] == 3 and "b3" in r[6]["rejected"] and "a5" in r[6]["chosen"], "two turns are shared by the making, a third is found"
    assert r[7]["prompt_turns"] == 1 and r[7]["rejected"].count("<|end|>") == 5
    pair = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "c"), ("user", "d")])], "pair_id long, chosen array<struct<role string, text string>>, rejected array<struct<role string, text string>>")
    r = preferences.format_pairs(pair).first()
    assert r["prompt_turns"] == 1 and r["rejected"].endswith("d<|end|>\n") and len(r["rejected_spans"]) == 1
    assert preferences.format_pairs(preferences.with_swapped_answers(df.limit(0))).count() == 0


def test_pipeline_against_stages_by_hand(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "ba be bi bo ra re ri ro ta te ti to".split() for b in "n l s m x".split()]
    common = "the of and to in".split()
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) + str(rng.randrange(99)) for _ in range(n))
    texts = [prose(80) for _ in range(60)]
    texts += [texts[0], texts[1] + " extra", "short", None, texts[2].upper() + "!! $$$ " * 60, texts[3] + " You idiot, you worthless trash. You moron."]
    rows = [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == set(range(60))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= ids and len(out) > 60
    from attestor.llm import bpe

    codec = bpe.Codec(bpe.vocabulary())
    assert all(codec.decode(r["ids"]) == texts[r["doc_id"]] for r in out)
    assert shared_dir(spark)

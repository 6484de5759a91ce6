"""Verdicts, learning, shards and the pipeline against plain versions over lists, and on rows that repeat, clash or are missing."""

import math
import random
import struct
import zlib
from collections import Counter, defaultdict
from functools import cmp_to_key

import duckdb
import pytest
import xxhash

from attestor.llm import bpe, mixing, ngram_join, quality, sharding, toxicity, warc
from test_set_ops import groups_by_hand

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GAPS = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in GAPS:
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out


def class_of(c):
    if c in " \t\n\r\x0b\x0c":
        return 3
    if c in ".,;:'\"?()-":
        return 4
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 6 if c.isalpha() else 5


def shares(counts, total):
    return {k: n / total for k, n in counts.items()}


def distance(p, q):
    half = lambda x, y: sum(v * math.log2(2 * v / (v + y.get(k, 0))) for k, v in x.items() if v > 0)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def quality_by_hand(rows):
    """rows(text, lang) -> kept, char distance, word distance of each."""
    plain = lambda w: w.strip(".,;:!?\"'()#*$%&|<>").lower()
    chars = lambda t: shares(Counter(map(class_of, t)), len(t))
    refs = {}
    for lang in {x for _, x in rows if x is not None}:
        long = [t for t, x in rows if x == lang and t is not None and len(t) >= quality.MIN_CHARS]
        if len(long) < quality.MIN_DOCUMENTS:
            continue
        mean = defaultdict(float)
        for t in long:
            for k, v in chars(t).items():
                mean[k] += v / len(long)
        worded = [w for w in map(words_of, long) if len(w) >= quality.MIN_WORDS]
        n, share = Counter(), Counter()
        for ws in worded:
            for w, k in Counter(map(plain, ws)).items():
                if w:
                    n[w] += 1
                    share[w] += k / len(ws)
        common = None
        if len(worded) >= quality.MIN_DOCUMENTS:
            top = sorted((w for w in n if n[w] * 10 >= len(worded)), key=lambda w: (n[w], w), reverse=True)[: quality.N_COMMON]
            common = {w: share[w] / len(worded) for w in top} or None
        refs[lang] = mean, common
    out = []
    for text, lang in rows:
        ws, t = words_of(text), text or ""
        windows = Counter(zip(ws, ws[1:], ws[2:]))  # noqa: B905
        repeated = {k + j for k in range(len(ws) - 2) if windows[tuple(ws[k : k + 3])] > 1 for j in range(3)}
        mean, common = refs.get(lang, (None, None))
        cd = distance(chars(t), mean) if mean and len(t) >= quality.MIN_CHARS else None
        wd = None
        if common and len(ws) >= quality.MIN_WORDS:
            times = Counter(map(plain, ws))
            others = [k for w, k in times.items() if w not in common]
            own = {w: times[w] for w in common} | {1: max(others, default=0), 2: sum(others) - max(others, default=0)}
            left = max(0.0, 1 - sum(common.values()))
            most = min(left, min(common.values()))
            wd = distance(shares(own, sum(own.values())), common | {1: most, 2: left - most})
        out.append((len(ws) >= 50 and 100 * len(repeated) <= 50 * len(ws) and (cd or 0) <= quality.MAX_CHAR_DISTANCE and (wd or 0) <= quality.MAX_WORD_DISTANCE, cd, wd))
    return out


def prose(rng, n=90):
    common = "the of and to in".split()
    rare = [f"{a}{b}" for a in "ba be bi bo ra re ri ro ta te ti to".split() for b in "n l s m x".split()]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) + str(rng.randrange(99)) for _ in range(n))


def test_quality_against_lists(spark):
    rng = random.Random(12)
    rows = [(prose(rng, rng.randrange(40, 160)), rng.choice(["en", "en", "de"])) for _ in range(90)]
    rows += [(rows[k][0].upper(), "en") for k in range(5)] + [("$$ ## " * 80 + rows[6][0], "de"), ("word " * 200, "en"), (None, "en"), ("", None), (rows[7][0], None), (rows[8][0], "rare"), ("é中 \U0001f600" * 90, "en")]
    df = spark.createDataFrame([(k, t, x, "s", 1) for k, (t, x) in enumerate(rows)], DOCS)
    got = {r["doc_id"]: r for r in quality.judge(df, quality.references(df)).collect()}
    for k, (kept, cd, wd) in enumerate(quality_by_hand(rows)):
        assert got[k]["kept"] == kept, rows[k][0][:80]
        assert got[k]["char_distance"] == (cd if cd is None else pytest.approx(cd, abs=1e-9)) and got[k]["word_distance"] == (wd if wd is None else pytest.approx(wd, abs=1e-9))


def learned_by_hand(rows, labels):
    """rows(doc_id, text), labels(doc_id, toxic) -> the acceptor."""
    toxic = {}
    for d, x in labels:
        if d is not None and x is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            toxic[d] = max(toxic.get(d, 0), x)
    texts = {}
    for d, t in rows:
        if d in toxic:
            texts[t] = max(texts.get(t, 0), toxic[d])
    n, under = defaultdict(lambda: [0, 0]), Counter()
    for t, x in texts.items():
        tokens = toxicity.TOKENS.findall((t or "").lower())
        words = {w for w in tokens if w[0].isalpha()}
        begins = [w[:k] + "*" for w in words for k in toxicity.STEMS if len(w) >= k]
        before = {a + ">" for a, b in zip(tokens, tokens[1:]) if b in toxicity.TARGETS and a[0].isalpha()}  # noqa: B905
        for entry in words | set(begins) | before:
            n[entry][0 if x else 1] += 1
        under.update(begins if x else [])
    bad, good = sum(texts.values()), len(texts) - sum(texts.values())
    surprise, needed = math.log((bad + good) / bad), math.log(len(n) + 1) + 2
    out = {"*": {}, ">": {}, "": dict.fromkeys(toxicity.INSULTS, 1.0)}
    for e, (a, b) in n.items():
        tag = e[-1] if e[-1] in "*>" else ""
        if a >= 3 and b * 25 <= a and (tag != "*" or under[e] >= 1.5 * a):
            sure = min(1.0, (math.sqrt(a * under[e]) if tag == "*" else a) * surprise / needed)
            out[tag][e.rstrip("*>")] = max(out[tag].get(e.rstrip("*>"), 0), sure)
    for w in {*toxicity.INSULTS, *toxicity.MORE_HARMS}.union(*map(toxicity.forms, toxicity.HARMS)):
        if n[w][1] >= 3 and n[w][1] > n[w][0]:
            out[""][w] = 0.0
    return out[""], out["*"], {w: s for w, s in out[">"].items() if w not in out[""]}


def toxic_rows(rng, n=300):
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice("alpha beta gamma delta epsilon zeta fool jerk znork".split()) for _ in range(25)]
        if toxic := k % 5 == 0:
            for _ in range(3):
                words.insert(rng.randrange(20), "grumf" + rng.choice(["a", "os", "ent", "ik"]))
            words += ["znork", "you"]
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, [*labels, (None, 1), (5, None), (6, 1), (6, 0)]


def test_toxicity_learns_what_lists_say(spark):
    rows, labels = toxic_rows(random.Random(4))
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in [*rows, rows[0], (None, "You fool")]], "doc_id long, text string, toxic int, t_doc_id string")
    got = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    for mine, own in zip(learned_by_hand(rows, labels), got, strict=True):
        assert mine == {w: pytest.approx(s) for w, s in own.items()}
    assert got.harms["znork"] > 0 and got.words["fool"] == 0 and "grumf" in got.stems
    score = toxicity.Scorer(got).score
    assert score("I will znork you") > 0 and score("znork the eggs") <= score("znork you")


def test_toxicity_threats_need_a_person():
    score = toxicity.Scorer(toxicity.Acceptor(dict.fromkeys(toxicity.INSULTS, 1.0), {}, {})).score
    for t in ("You should beat the eggs.", "You can burn this CD for your friend.", "You must hang your coat here.", "Your shot at the title.", "the piece of cake is yours"):
        assert score(t) == 0, t
    for t in ("I will kill you.", "We are going to beat you up", "I'll break your neck", "Ich werde dich töten", "je vais te tuer", "te mataré", "go kill yourself", "You piece of shit"):
        assert score(t) >= 0.7, t
    for t in ("They were stabbing you", "I won't hurt you", "He said I will kill you", "She shot him"):
        assert 0 < score(t) < 0.7, t


def shard_key(doc_id, text):
    low = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    return zlib.crc32((text or "").encode()) << 31 | low & 0x7FFFFFFF


@pytest.mark.parametrize("leaf_rows", [20, 500_000])
def test_shards_against_a_sorted_list(spark, leaf_rows):
    rng = random.Random(9)
    rows = [(k, "t" * rng.randrange(2000) + str(rng.randrange(50))) for k in range(1200)] + [(k, "hot text " * 40) for k in range(2000, 2500)]
    rows += [(7, "again")] * 3 + [(None, "no id"), (None, None), (8, ""), (-5, "é" * 3000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, key int, leaf string").repartition(5)
    got = sharding.shard_by_bytes(df, 7, leaf_rows=leaf_rows).collect()
    line = sorted(((shard_key(d, t), -1 if d is None else d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows), key=lambda x: x[:2])
    mine = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    # in the order of shards and slots, rows are in the order of keys; slots have no gaps
    keys = [shard_key(r["doc_id"], None) & 0x7FFFFFFF | r["text_crc32"] << 31 for r in mine]
    assert keys == [x[0] for x in line] and [(r["size"], r["text_crc32"]) for r in mine] == [x[2:] for x in line]
    for shard in {r["shard"] for r in mine}:
        assert [r["slot"] for r in mine if r["shard"] == shard] == list(range(sum(r["shard"] == shard for r in mine)))
    # every boundary is as near to its aim as a boundary between different keys can be, within the tolerance
    total = sum(x[2] for x in line)
    ends, below = [0], 0
    for k, x in enumerate(line):
        below += x[2]
        if k + 1 == len(line) or line[k + 1][0] != x[0]:
            ends.append(below)
    for s in range(1, 7):
        aim, at = total * s / 7, sum(r["size"] for r in mine if r["shard"] < s)
        assert at in ends and abs(at - aim) <= min(abs(e - aim) for e in ends) + sharding.TOLERANCE * total / 7


def test_shards_are_written(spark, tmp_path):
    rows = [(1, "a" * 50, 1), (1, "a" * 50, 1), (None, "b", 2), (None, "b", 3), (4, None, 4)] + [(k, f"text {k} " * (k % 9), k) for k in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    sharding.write_shards(df, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect())) and back.select("shard").distinct().count() == 4
    with pytest.raises(ValueError, match="shard"):
        sharding.write_shards(df.withColumnRenamed("slot", "Shard"), f"{tmp_path}/no", 4)
    sharding.write_shards(df.limit(0), f"{tmp_path}/none", 4)


def test_warc_of_no_pages_and_of_a_long_one(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>" + "long é " * 500_000)], "page_id long, url string, html string")
    for k, df in enumerate((pages.limit(0), pages)):
        warc.write_archives(warc.with_revisits(df), f"{tmp_path}/{k}")
        out = warc.digests(warc.reassemble(warc.read_records(spark, f"{tmp_path}/{k}"))).collect()
        assert [r["payload_bytes"] for r in out] == [4_000_003] * k


def test_mix_ties_and_clashing_names(spark):
    rows = [(k % 5, "one two three", "en", "s", 1, 7, "c") for k in range(20)] + [(None, "a b", "en", None, 1, 7, "c")] * 2 + [(30, None, "en", "t", 1, 7, "c"), (31, " ", "en", "t", 1, 7, "c")]
    df = spark.createDataFrame(rows, DOCS + ", times long, copy string")
    out = mixing.take_mix(spark, df, "")
    assert out.columns == df.columns
    first, again = (Counter(map(str, mixing.take_mix(spark, df, "").collect())) for _ in range(2))
    assert first == again and all("times=7, copy='c'" in r for r in first)
    assert mixing.take_mix(spark, df.limit(0), "").count() == 0


def pipeline_by_hand(rows, labels):
    """rows(doc_id, text, lang, source) -> how often each (doc_id, text) comes out, with its ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    kept = [r for r, q in zip(rows, quality_by_hand([(t, x) for _, t, x, _ in rows]), strict=True) if q[0]]
    score = toxicity.Scorer(toxicity.Acceptor(*learned_by_hand([r[:2] for r in kept], labels))).score
    kept = [r for r in kept if score(r[1]) < toxicity.THRESHOLD]
    # one row of each group: the smallest id, nulls last; groups by number, as ids may repeat
    group = {k: c for k, _, c in groups_by_hand([(k, r[1]) for k, r in enumerate(kept)], 5, 80)}
    before = cmp_to_key(lambda a, b: (a[0] is None) - (b[0] is None) or ((a[0] or 0) > (b[0] or 0)) - ((a[0] or 0) < (b[0] or 0)))
    best = {}
    for k, r in enumerate(kept):
        if group[k] not in best or before(r) < before(kept[best[group[k]]]):
            best[group[k]] = k
    kept = [kept[k] for k in best.values()]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in kept])
    times = {}
    for d, n in db.execute(f"SELECT doc_id, times FROM ({mixing.mixing_sql()})").fetchall():
        times[d] = max(times.get(d, 0), n)
    t = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    out = Counter()
    for r in kept:
        out[r[0], tuple(t.encode(r[1], add_special_tokens=False).ids)] += times[r[0]]
    return +out


def test_pipeline_against_lists(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    texts = [prose(rng) for _ in range(120)]
    for k in range(0, 60, 5):
        texts[k] += " " + " ".join(f"grumf{rng.choice('abcdef')}x" for _ in range(3))
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(texts)]
    rows += [(200 + k, texts[60 + k] + " more", "en", "s0") for k in range(6)] + [rows[70]] * 3 + [(None, texts[80], "en", None), (None, texts[81] + " x", "en", "s1"), (None, prose(rng), "en", None)]
    rows += [(300, None, "en", "s1"), (301, "", None, "s1"), (302, texts[90].upper() + " $$$ ###" * 90, "en", "s1"), (303, texts[91] + " You idiot, you worthless trash. You moron.", "en", "s2"), (71, prose(rng), "en", "s2")]
    labels = [(k, int("grumf" in t)) for k, t in enumerate(texts)]
    folder = f"{tmp_path}/in"
    extra = spark.createDataFrame([(*r, len(r[1] or ""), "x", 5, "y") for r in rows], DOCS + ", row string, times int, toxic string")
    extra.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == pipeline_by_hand(rows, labels)
    assert 100 < sum(got.values()) and not {300, 301, 302, 303, 200, 205} & {d for d, _ in got}
    extra.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert ngram_join.keep_one(spark, extra.where("doc_id = 70"), "").count() == 1

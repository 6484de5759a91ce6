"""Quality rules, BPE, licences, toxicity: against brute force, and on edge cases."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest

from attestor.llm import bpe, licences, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string"
EDGES = [
    (1, None, "en", None, 0, "x"),
    (2, "", None, "s", 0, None),
    (3, "one two", "en", "s", 7, "x"),
    (4, "the of and " * 30000, "en", "s", 1, "x"),
    (5, "Same text here.\nSame text here.\n\n", "en", "s", 1, "x"),
    (5, "Same text here.\nSame text here.\n\n", "en", "s", 1, "x"),
    (None, "null id é中\U0001f600 <|endoftext|> it's", "fr", "s", 1, "x"),
    (9007199254740993, "You are an idiot. You are trash and scum.", "en", "s", 1, "x"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def repeated_by_hand(words):
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(windows)
    return len({k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(3)})


def test_base_stats_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 30))]
        assert quality.base_stats(" ".join(words), words)[4] == repeated_by_hand(words)
    assert quality.base_stats("a b\na b\n \n#$a", ["a", "b", "a", "b", "#$a"]) == (5, 7, 2, 1, 0)


def test_js_distance():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.0, 1.0])
    assert quality.js_distance(p, p) == 0
    assert quality.js_distance(p, q) == pytest.approx(1.0)


def test_quality_rules(spark, docs, empty):
    rng = random.Random(5)
    vocabulary = "the of and to in is it was for on with lorem ipsum dolor sit amet consectetur adipiscing elit sed".split()
    prose = [(100 + k, " ".join(rng.choice(vocabulary) + str(rng.randrange(30)) * (rng.random() < 0.4) for _ in range(120)) + ".", "en", "s", 1, "x") for k in range(40)]
    junk = [(200, " ".join(w + "!!###$$$" for w in prose[0][1].split()), "en", "s", 1, "x")]
    df = spark.createDataFrame(prose + junk, DOCS).unionByName(docs)
    rows = {r["doc_id"]: r for r in quality.judge(df, quality.references(df)).collect()}
    assert len(rows) == 40 + 1 + 7
    assert all(rows[100 + k]["kept"] for k in range(40))
    assert not rows[200]["kept"] and not rows[200]["base_failed"]
    assert rows[1]["n_words"] == 0 and rows[1]["base_failed"] and not rows[4]["kept"]
    assert rows[4]["n_words"] == 90000 and rows[4]["n_repeat_words"] == 90000
    assert rows[9007199254740993]["n_words"] == 9
    assert quality.judge(empty, quality.references(empty)).count() == 0


def test_quality_rules_of_every_language(spark):
    rng = random.Random(6)

    def prose(letters, lengths):
        vocabulary = ["".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(40)]
        return lambda: " ".join(rng.choice(vocabulary) + str(rng.randrange(30)) * (rng.random() < 0.2) for _ in range(120)) + "."

    latin, arabic, long_words, thai = prose("abcdefghij", (2, 3, 5)), prose("ابتثجحخدذر", (2, 3, 5)), prose("qrstuvwxyz", (9, 12)), prose("กขคงจฉชซ", (3, 4))
    texts = [(t(), lang) for t, lang, n in ((latin, "en", 40), (arabic, "ar", 30), (long_words, "de", 30), (thai, "th", 3), (arabic, None, 2)) for _ in range(n)]
    junk = [(t.replace(" ", "!!###$$$ "), lang) for t, lang in (texts[0], texts[40], texts[70])]
    df = spark.createDataFrame([(k, t, lang, "s", 1, "x") for k, (t, lang) in enumerate(texts + junk)], DOCS)
    refs = quality.references(df)
    assert {r["lang"] for r in refs.collect()} == {"en", "ar", "de"}
    assert all(len(w) >= 9 for w in next(r["r_words"] for r in refs.collect() if r["lang"] == "de"))
    one = {r["doc_id"]: r for r in quality.judge(df, refs).collect()}
    assert [k for k in range(len(texts)) if not one[k]["kept"]] == []
    assert not any(one[len(texts) + k]["kept"] for k in range(3))
    assert all(one[k]["char_distance"] is None and one[k]["word_distance"] is None for k in range(100, 105)), "no reference"
    assert all(one[k]["char_distance"] is not None and one[k]["word_distance"] is not None for k in range(100))
    assert {r["doc_id"]: r for r in quality.judge(df, refs, most=1).collect()} == one, "joined references judge alike"
    kept = {k for k, r in one.items() if r["kept"]}
    for most in (1, quality.MAX_BROADCAST):
        assert sorted(r["doc_id"] for r in quality.keep_good(spark, df, "", most).collect()) == sorted(kept)


def test_bpe_against_the_library(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    out = {r["doc_id"]: r for r in bpe.digests(docs, with_ids=True).collect()}
    for doc_id, text, *_ in EDGES:
        ids = t.encode(text or "", add_special_tokens=False).ids
        r = out[doc_id]
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()}
    assert all(back[d] == (text or "") for d, text, *_ in EDGES)
    assert bpe.digests(empty).count() == 0


def test_bpe_speculation_is_verified(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    rng = random.Random(9)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x3000, 0x9FFF)])) for _ in range(80)) for _ in range(150)]
    texts += ["aaaa" * 200, " " * 50 + "x", "\x1c\x1d a\x85b\xa0c", "THE" * 400]
    codec = bpe.Codec(bpe.vocabulary())
    monkeypatch.setattr(bpe, "MAX_WORDS", 300)  # the table of words starts anew now and then
    for text, runs in zip(texts, codec.encode_batch(texts), strict=True):
        assert [int(i) for r in runs for i in r.split(",")] == t.encode(text, add_special_tokens=False).ids
    keys = rng.sample(sorted(codec.pairs), 500)
    assert all(codec.pairs[k] == (codec.merged(codec.bytes_of[k >> 32] + codec.bytes_of[k & 0xFFFFFFFF]) == [k >> 32, k & 0xFFFFFFFF]) for k in keys)
    word = b"abcabcabcthe" * 40
    assert codec.merged(word) == codec._merged_long([codec.id_of_byte[b] for b in word])


def dice(a, b):
    a, b = set(licences._bigrams(a)), set(licences._bigrams(b))
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_licences_against_brute_force(spark, docs, empty):
    rng, rows = random.Random(4), []
    for k, (name, text) in enumerate(sorted(licences.TEMPLATES.items())):
        words = text.split()
        for j, cut in enumerate((0, 1, len(words) // 4)):
            kept = [w for w in words if rng.random() > cut / len(words)]
            rows.append((1000 + 10 * k + j, "Intro words here.\n" + " ".join(kept).upper() + "\nmore text", "en", "s", 1, "x"))
    df = spark.createDataFrame(rows, DOCS).unionByName(docs)
    got = {r["doc_id"]: r for r in licences.scan(df).collect()}
    for doc_id, text, *_ in rows:
        units = [text, *text.split("\n")]
        score = {(n, u): dice(units[u], t) for n, t in licences.TEMPLATES.items() for u in range(len(units))}
        best = max(score.values())
        r = got[doc_id]
        if best >= licences.THRESHOLD:
            assert r["dice"] == pytest.approx(best, abs=1e-6)
            assert score[(r["licence"], r["unit"])] == pytest.approx(best)
        else:
            assert r["licence"] is None
    assert got[1]["n_units"] == 0 and got[1]["licence"] is None and got[2]["n_units"] == 0
    assert licences.scan(empty).count() == 0


def passages_by_hand(text):
    lines, known = (text or "").split("\n"), [(n, set(licences._bigrams(t))) for n, t in licences.WHOLE.items()]
    found = []
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            words = licences._plain(" ".join(lines[i : j + 1])).split()
            grams = set(zip(words, words[1:]))  # noqa: B905
            if not licences._plain(lines[i]) or not licences._plain(lines[j]) or len(words) > 900:
                continue
            grams = {" ".join(g) for g in grams}
            for name, b in known:
                if 3 / 7 * len(b) <= len(words) - 1 <= 7 / 3 * len(b) and (d := 2 * len(grams & b) / (len(grams) + len(b))) >= 0.6:
                    found.append((-d, name, i + 1, j + 1, len(grams)))
    out = []
    for d, name, i, j, n in sorted(found):
        if all(j < x[2] or x[3] < i for x in out):
            out.append((name, round(-d, 6), i, j, n))
    return out


def test_licence_passages_against_brute_force(spark, docs, empty):
    import textwrap

    rng = random.Random(7)
    prose = lambda n: textwrap.fill(" ".join(rng.choice("the of software person granted lorem ipsum copy dolor sit".split()) for _ in range(n)), 70)
    wrapped = lambda name, width=72: textwrap.fill(licences.WHOLE[name], width)
    texts = [wrapped("mit-full"), prose(400) + "\n\n" + wrapped("mit-full") + "\n\n" + prose(400), licences.WHOLE["mit-full"]]
    texts += [prose(90) + "\n# " + wrapped(name, 60).replace("\n", "\n# ") + "\n" + prose(60) for name in ("bsd-2-clause-full", "bsd-3-clause-full", "isc-full", "apache-2.0-notice", "gpl-2.0-notice", "gpl-3.0-notice")]
    texts += [wrapped("isc-full") + "\n" + prose(50) + "\nReleased under the MIT License.\n" + prose(50) + "\n" + wrapped("gpl-3.0-notice"), prose(300), "Released under the MIT License.\n" * 30]
    df = spark.createDataFrame([(1000 + k, t, "en", "s", 1, "x") for k, t in enumerate(texts)], DOCS).unionByName(docs)
    got = {r["doc_id"]: [tuple(m) for m in r["matches"]] for r in licences.passages(df).collect()}
    for k, t in enumerate(texts):
        assert got[1000 + k] == passages_by_hand(t), k
    at = lambda k: [m[0] for m in got[1000 + k]]
    assert [at(k) for k in range(9)] == [["mit-full"]] * 3 + [["bsd-2-clause-full"], ["bsd-3-clause-full"], ["isc-full"], ["apache-2.0-notice"], ["gpl-2.0-notice"], ["gpl-3.0-notice"]]
    assert sorted(at(9)) == ["gpl-3.0-notice", "isc-full", "mit"] and at(10) == [] and len(at(11)) == 30
    assert got[1] == got[2] == [] and licences.passages(df).count() == len(texts) + 8 and licences.passages(empty).count() == 0


def test_toxicity_scores_clauses_not_words():
    s = toxicity.Scorer(toxicity.Acceptor(dict.fromkeys(toxicity.INSULTS, 1.0), {}, {}))
    at = lambda t: s.score(t)
    assert at(None) == at("") == 0
    assert at("You are an idiot.") >= 0.7 > at("What an idiot.") > at("He said you are an idiot.") > 0
    assert at("You are not an idiot.") < 0.4
    assert at("I will kill you.") >= 0.7 and at("We kill time.") == 0
    assert at('"You idiot", it read.') < 0.7 <= at("idiot. moron.")
    assert at("never. You idiot!") >= 0.7, "a negation ends with its clause"


def test_toxicity_composition_is_the_chain():
    chain = [toxicity.reported_speech(), toxicity.negation(), toxicity.target(), toxicity.insult(), toxicity.threat()]
    following, weights = toxicity.table_of(toxicity.GRAMMAR)
    rng = random.Random(2)
    for _ in range(300):
        state, states = 0, [t.start for t in chain]
        for kind in (rng.randrange(13) for _ in range(12)):
            symbol = (kind, 0)
            for k, t in enumerate(chain):
                states[k], symbol = t.step(states[k], symbol)
            assert weights[state][kind] == symbol
            state = following[state][kind]


def test_toxicity_learns_and_holds_out(spark, empty):
    rng, rows, labels = random.Random(8), [], []
    for k in range(600):
        toxic = k % 6 == 0
        words = [rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(30)]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(30), "grumf" + rng.choice(["a", "os", "ent", "ik"]))
        rows.append((k, " ".join(words), "en", "s", 1, "x"))
        labels.append((k, int(toxic)))
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.learn(docs, lab)).collect()
    truth, held = dict(labels), [r for r in out if r["held_out"]]
    assert len(out) == 600 and 150 < len(held) < 250
    assert all(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert toxicity.score(empty, toxicity.learn(empty, lab)).count() == 0


def test_edge_rows_are_scored(docs):
    words = dict.fromkeys(toxicity.INSULTS, 1.0)
    out = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.Acceptor(words, {}, {})).collect()}
    assert out[1]["score"] == out[2]["score"] == 0 and out[9007199254740993]["predicted"] == 1
    assert out[None]["held_out"] is False


def test_fixed_tables_are_plain():
    assert json.dumps(licences.TEMPLATES) and len(set(toxicity.INSULTS)) == len(toxicity.INSULTS)


def test_a_worker_keeps_few_words():
    """A worker stays for the steps of the pipeline that follow, with what it keeps."""
    from attestor.llm import ngram_join, quality

    words, hashes, codec = [f"w{k}" for k in range(260_000)], ngram_join._WordHashes(), bpe.Codec(bpe.vocabulary())
    ngram_join.shingle_hashes(" ".join(words), 5, hashes)
    quality.word_times(words)
    for _ in codec.encode_batch(" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)):
        pass
    assert max(map(len, (hashes, quality._plain, codec.runs, codec.bytes_of_run))) <= 200_000


def test_bpe_merges_words_together_as_one_by_one():
    codec, rng = bpe.Codec(bpe.vocabulary()), random.Random(3)
    words = [bytes(rng.choice(b"abcdeeetthhan orisst") for _ in range(rng.randrange(1, 25))) for _ in range(2_000)]
    words += [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 25))) for _ in range(500)] + [b"a" * k for k in range(1, 25)]
    assert codec.merged_all(words) == [codec.merged(w) for w in words] and codec.merged_all([]) == []
    longest = lambda w: next(w[:k] for k in range(len(w), 0, -1) if w[:k] in codec.id_of)
    for w in words:
        at = 0
        for i in codec.greedy(w):
            assert codec.bytes_of[i] == longest(w[at:])
            at += len(codec.bytes_of[i])
        assert at == len(w)

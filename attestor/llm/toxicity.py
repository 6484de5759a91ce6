"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as symbols: insult, harm (verbs of it), agent (who announces
something), target (who is spoken to), person, possessive, body, negation,
reported speech, other. An acceptor reads them from words, beginnings of words,
and phrases of several words. Five transducers rewrite them one after the other,
and are composed into one table before any text is read:

- reported speech: after "said" or inside quotes, insults and harm are quoted;
- negation: within three words after "not", they are denied;
- target: an insult in a clause that names someone spoken to is aimed;
- insult: gives weight to what the others left: aimed most, plain less, quoted or denied little;
- threat: arcs over several words, from a verb of harm to a person as its object
  ("hurt you", "break your neck", "te tuer"), give weight; full weight if someone announces it.

The score of a text is 1 - exp(-sum of its clauses' weights), each clause's
weight bounded, so that one outburst isn't all. A lone insult stays under the
threshold of 0.7; two, one that is aimed, or an announced threat are over it. "Beat the eggs" weighs nothing.

The acceptor has fixed lists to start from and learns more from labels: words and
word beginnings that occur in toxic documents and all but never in others are
insults, words that do so before someone spoken to are harm; how sure an entry is,
from 0 to 1, comes from a significance test over document counts, and scales its
weight. The labelled rows used are at most ``TRAIN_ROWS``, those first in hash
order of rows that aren't held out; listed words that the labels speak against
are dropped.

Defined results: null and empty texts score 0; rows that repeat score alike; a
label that is null is no label, of a document's several labels the highest
holds; without labels the fixed list alone works; an empty table gives an empty
result; other columns are ignored, and lang, source and doc_id never enter a
score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, table

#: The bound of what is fitted: labelled rows.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
STEMS = (3, 4, 5, 6)

#: The words each acceptor starts with.
INSULTS = """
    asshole bastard bitch clown cretin disgusting dumbass fool idiot idiots imbecile jerk loser losers moron morons pathetic scum scumbag
    stupid trash vermin worthless
    abruti connard connasse crétin débile idiote imbécile ordure salaud salope
    abschaum arschloch dummkopf dreckskerl idioten schwachkopf trottel wichser
    cabrón escoria estúpido estúpida gilipollas idiota imbécil inútil pendejo
""".split()
#: Insults of several words, and calls to self-harm.
PHRASES = """
    piece of shit;piece of trash;piece of garbage;waste of space;waste of oxygen;son of a bitch;go to hell;go hang yourself;
    kill yourself;hang yourself;drop dead;full of shit;fils de pute;va te faire foutre;ferme ta gueule;hijo de puta;vete al infierno;
    vete a la mierda;halt die fresse;fahr zur hölle;stück dreck
""".replace("\n    ", "").strip().split(";")
#: English verbs of harm by their base; other forms follow by rule.
HARMS = "beat break burn choke crush hang hurt kill murder punch shoot slap smash stab strangle torture whip".split()
#: Further forms of them, and those of other languages.
MORE_HARMS = """
    beaten broke broken hung shot
    buter buterai crever crèverai frapper frapperai massacrer tabasser tuer tuerai tuerons étrangler
    erschlagen ersteche erstechen erwürgen töte töten umbringen verprügeln
    golpear golpearé matar mataré mataremos estrangular degollar
""".split()
AGENTS = """
    i'll we'll i'm gonna going will shall
    vais allons werde werden voy vamos
    buterai crèverai frapperai tuerai tuerons mataré mataremos golpearé
""".split()
TARGETS = """
    u you your yours yourself you're youre
    toi tes tu vous votre
    dich dein deine dir du euch ihr
    te ti tú usted ustedes vosotros
""".split()
#: Objects that may stand before the verb.
BEFORE = "te toi vous dich dir euch os".split()
PERSONS = "him her them us everyone everybody ihn ihm sie lui leur los las le les".split()
POSSESSIVES = "your his her their our ta ton tes votre dein deine deinen tu tus su sus".split()
BODIES = """
    face head neck throat skull bones teeth brains guts family kids children mother father wife son daughter
    gueule tête gorge famille kopf hals gesicht familie cabeza cuello cara familia
""".split()
NEGATIONS = "ain't aren't don't isn't never no not nobody won't wouldn't jamais pas kein keine nicht niemals nie ninguno nunca".split()
REPORTS = """
    according allegedly alleged asked called calls claimed quote quoted quotes reported reportedly said saying says told wrote writes
    a-t-il déclaré disait rapporté selon berichtete laut sagte schrieb zitiert dijo escribió llamó según
""".split()

OTHER, INSULT, HARM, TARGET, NEGATION, REPORT, QUOTE, AGENT, PERSON, POSSESSIVE, BODY, OBJECT, ANNOUNCED = range(13)
#: Marks that transducers put on an insult or on harm.
QUOTED, DENIED, AIMED = 1, 2, 4
#: Weights of an insult: plain, aimed, and the factors of the others.
PLAIN_WEIGHT, AIMED_WEIGHT, QUOTED_FACTOR, DENIED_FACTOR = 0.9, 1.4, 0.3, 0.25
#: Weights of a threat: told, and announced.
TOLD_WEIGHT, THREAT_WEIGHT, CLAUSE_BOUND = 0.7, 1.4, 3.0
NEGATION_REACH = 3
#: Words between a verb of harm and its object, at most one of them another word.
OBJECT_REACH = 2
#: How sure an entry can be, so that one plain insult alone is under the threshold.
MAX_SURE = 1.0


def forms(verb: str) -> set[str]:
    """A verb and its regular forms, with the last letter doubled or a last e dropped where that is usual."""
    stem = verb[:-1] if verb.endswith("e") else verb
    double = verb + verb[-1] if len(verb) < 5 and verb[-1] not in "aeiouwxy" and verb[-2] in "aeiou" and verb[-3] not in "aeiou" else stem
    return {verb, verb + ("es" if verb.endswith(("sh", "ch", "s")) else "s"), double + "ing", double + "ed"}


TOKENS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[\"“”«»„]|[.!?;\n]+")
CLAUSE_END = frozenset(".!?;\n")
QUOTE_MARKS = frozenset("\"“”«»„")


class Transducer:
    """A deterministic transducer: step(state, symbol) -> state, symbol. Symbols are (kind, marks)."""

    def __init__(self, step, start=0):
        self.step, self.start = step, start

    def then(self, after: Transducer) -> Transducer:
        """The composition: what this one writes, ``after`` reads."""

        def step(state, symbol):
            a, middle = self.step(state[0], symbol)
            b, out = after.step(state[1], middle)
            return (a, b), out

        return Transducer(step, (self.start, after.start))


def _mark(symbol, mark, when):
    kind, marks = symbol
    return (kind, marks | mark) if when and kind in (INSULT, HARM, ANNOUNCED) else symbol


def reported_speech() -> Transducer:
    """State: 1 after a verb of saying, 2 inside quotes, both 3."""

    def step(state, symbol):
        if symbol[0] == QUOTE:
            return state ^ 2, symbol
        return state | (symbol[0] == REPORT), _mark(symbol, QUOTED, state)

    return Transducer(step)


def negation() -> Transducer:
    """State: the words that the last negation still reaches."""

    def step(state, symbol):
        if symbol[0] == NEGATION:
            return NEGATION_REACH, symbol
        return max(0, state - 1), _mark(symbol, DENIED, state)

    return Transducer(step)


def target() -> Transducer:
    """State: 1 once someone is spoken to. The clause is read with targets first, see ``clause_weight``."""

    def step(state, symbol):
        return state | (symbol[0] in (TARGET, OBJECT)), _mark(symbol, AIMED, state)

    return Transducer(step)


def insult() -> Transducer:
    """Replaces insults by their weight; other symbols pass."""

    def step(state, symbol):
        kind, marks = symbol
        if kind != INSULT:
            return state, symbol
        w = AIMED_WEIGHT if marks & AIMED else PLAIN_WEIGHT
        return state, w * (QUOTED_FACTOR if marks & QUOTED else 1) * (DENIED_FACTOR if marks & DENIED else 1)

    return Transducer(step)


def threat() -> Transducer:
    """Replaces the end of an arc from harm to its object by a weight, all other symbols by none; weights pass.

    State: whether someone announces; the words that the last verb still reaches,
    and its marks; whether a possessive stands between; the words that an object before the verb still reaches.
    """

    def weight(announced: bool, marks: int) -> float:
        w = THREAT_WEIGHT if announced else TOLD_WEIGHT
        return w * (QUOTED_FACTOR if marks & QUOTED else 1) * (DENIED_FACTOR if marks & DENIED else 1)

    def step(state, symbol):
        announced, reach, marks, owned, before = state
        if isinstance(symbol, float):
            return (announced, 0, 0, False, 0), symbol
        kind, own = symbol
        own &= QUOTED | DENIED
        if kind in (HARM, ANNOUNCED):
            announced |= kind == ANNOUNCED
            return ((announced, 0, 0, False, 0), weight(announced, own)) if before else ((announced, OBJECT_REACH, own, False, 0), 0.0)
        if kind == AGENT:
            return (True, 0, 0, False, before), 0.0
        ends = reach and (kind in (TARGET, PERSON, OBJECT) or (owned and kind == BODY))
        if ends:
            return (announced, 0, 0, False, 0), weight(announced, marks)
        if kind == POSSESSIVE and reach:
            return (announced, OBJECT_REACH, marks, True, 0), 0.0
        left = max(0, reach - 1)
        return (announced, left, marks if left else 0, owned and left > 0, OBJECT_REACH if kind == OBJECT else max(0, before - 1)), 0.0

    return Transducer(step, (False, 0, 0, False, 0))


def table_of(t: Transducer, kinds: int = 13) -> tuple[list[list[int]], list[list[float]]]:
    """All reachable states of a transducer as a table: next state and weight for each state and kind of symbol."""
    number, states, following, weights, k = {t.start: 0}, [t.start], [], [], 0
    while k < len(states):
        row_s, row_w = [], []
        for kind in range(kinds):
            state, w = t.step(states[k], (kind, 0))
            if state not in number:
                number[state] = len(states)
                states.append(state)
            row_s.append(number[state])
            row_w.append(float(w))
        following.append(row_s)
        weights.append(row_w)
        k += 1
    return following, weights


GRAMMAR = reported_speech().then(negation()).then(target()).then(insult()).then(threat())


class Acceptor(NamedTuple):
    """What is learned: insults and beginnings of insults, verbs of harm, and how sure each is; 0: refuted."""

    words: dict[str, float]
    stems: dict[str, float]
    harms: dict[str, float]


class Scorer:
    """The grammar with its acceptor: words, beginnings of words, and phrases."""

    def __init__(self, learned: Acceptor):
        self.following, self.weights = table_of(GRAMMAR)
        self.after_target = self.following[0][TARGET]
        refuted = {w for w, sure in learned.words.items() if not sure}
        self.sure = {w: sure for w, sure in learned.words.items() if sure}
        self.stems = dict(learned.stems)
        harms = set().union(*map(forms, HARMS), MORE_HARMS) - refuted
        insults = set(self.sure)
        self.sure |= {w: sure for w, sure in learned.harms.items() if w not in self.sure}
        lists = ((PERSON, PERSONS), (POSSESSIVE, POSSESSIVES), (BODY, BODIES), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (OBJECT, BEFORE), (AGENT, AGENTS), (HARM, learned.harms), (HARM, harms), (ANNOUNCED, harms & set(AGENTS)), (INSULT, insults))
        self.kinds = {w: k for k, ws in lists for w in ws}
        # one word may be target and possessive: as the latter it can lead to a body, and it names someone spoken to all the same
        self.owning = (frozenset(POSSESSIVES) & frozenset(TARGETS)) - {"tu"}
        self.targets = frozenset(TARGETS)
        self.kinds |= dict.fromkeys(refuted, OTHER)
        self.stem_lengths = sorted({len(s) for s in self.stems})
        self.phrases: dict[str, list[tuple[str, ...]]] = {}
        for p in PHRASES:
            first, *rest = p.split()
            self.phrases.setdefault(first, []).append(tuple(rest))
        last = {p.split()[-1] for p in PHRASES}
        self.sparks = insults | harms | set(learned.harms) | last  # without one of these, or a stem, a text has no weight

    def read(self, token: str) -> tuple[int, float]:
        """The kind of a token, and of an insult or harm how sure it is."""
        if token in self.owning:
            return POSSESSIVE, 1.0
        if (k := self.kinds.get(token)) is not None:
            return k, self.sure.get(token, 1.0)
        if token in QUOTE_MARKS:
            return QUOTE, 1.0
        sure = max((self.stems.get(token[:n], 0.0) for n in self.stem_lengths if len(token) >= n), default=0.0)
        return (INSULT, sure) if sure else (OTHER, 1.0)

    def symbols(self, tokens: list[str]) -> list[tuple[int, float]]:
        """The symbols of a clause; a phrase is one."""
        out, k = [], 0
        while k < len(tokens):
            t = tokens[k]
            rest = next((r for r in self.phrases.get(t, ()) if tuple(tokens[k + 1 : k + 1 + len(r)]) == r), None)
            if rest is None:
                out.append(self.read(t))
                k += 1
            else:
                out += [(TARGET, 1.0)] * (rest[-1:] == ("yourself",)) + [(INSULT, 1.0)]
                k += 1 + len(rest)
        return out

    def clause_weight(self, tokens: list[str]) -> float:
        """The weight of a clause; it starts in the state after a target if it has one anywhere, so that order doesn't matter."""
        clause = self.symbols(tokens)
        state, total = self.after_target if not self.targets.isdisjoint(tokens) else 0, 0.0
        harm = 1.0  # how sure the last verb of harm is, whose arc may end at a later word
        for kind, sure in clause:
            if kind == HARM:
                harm = sure
            total += self.weights[state][kind] * (sure if kind == INSULT else harm)
            state = self.following[state][kind]
        return min(total, CLAUSE_BOUND)

    def sparked(self, distinct: set[str]) -> bool:
        if not self.sparks.isdisjoint(distinct):
            return True
        stems = self.stems
        return any(not stems.keys().isdisjoint({w[:n] for w in distinct}) for n in self.stem_lengths)

    def score(self, text: str | None) -> float:
        tokens = TOKENS.findall((text or "").lower())
        if not self.sparked(set(tokens)):
            return 0.0
        total, clause = 0.0, []
        for t in tokens:
            if t[0] in CLAUSE_END:
                total += self.clause_weight(clause)
                clause = []
            else:
                clause.append(t)
        return 1 - math.exp(-(total + self.clause_weight(clause)))


def held_out(doc_id: Column) -> Column:
    """Whether a row's label may not be learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Acceptor:
    """The acceptor from docs(doc_id, text) and labels(doc_id, toxic); it has entries of at most ``train_rows`` documents."""
    train = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = cut(train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "train")
    sample = sample.withColumnRenamed("doc_id", "t_doc_id")
    # copies of one text are one observation
    texts = docs.select("doc_id", "text")
    rows = texts.join(bounded(sample), texts["doc_id"] == sample["t_doc_id"]).groupBy("text").agg(F.max("toxic").alias("toxic"))

    spoken_to = frozenset(TARGETS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # (entry, documents that are toxic, others, words under a beginning in toxic ones); "" counts documents, "x*" are beginnings, "x>" words before someone spoken to
        for b in batches:
            sums: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                tokens = TOKENS.findall((text or "").lower())
                words = {t for t in tokens if t[0].isalpha()}
                begins = [w[:n] + "*" for w in words for n in STEMS if len(w) >= n]
                of = sums[0 if toxic else 1]
                of.update(words)
                of.update(set(begins))
                of.update({f"{a}>" for a, b in zip(tokens, tokens[1:]) if b in spoken_to and a[0].isalpha()})  # noqa: B905
                of[""] += 1
                if toxic:
                    sums[2].update(begins)
            keys = list(sums[0].keys() | sums[1].keys())
            yield pd.DataFrame({"entry": keys, "toxic": [sums[0][k] for k in keys], "clean": [sums[1][k] for k in keys], "under": [sums[2][k] for k in keys]})

    counts = cut(rows.mapInPandas(count, "entry string, toxic long, clean long, under long").groupBy("entry").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "under"))), "words")
    n = counts.where("entry = ''").first()
    words, stems, harms = dict.fromkeys(INSULTS, 1.0), {}, {}
    if n is None or not n["toxic"] or not n["clean"]:
        return Acceptor(words, stems, harms)
    surprise = math.log((n["toxic"] + n["clean"]) / n["toxic"])  # of one toxic document more, if toxicity didn't matter
    needed = math.log(counts.count()) + 2
    # a beginning counts if toxic documents have several words with it, and then by both
    stem = F.col("entry").endswith("*")
    evidence = F.when(stem, F.sqrt(F.col("toxic") * F.col("under"))).otherwise(F.col("toxic")) * F.lit(surprise / needed)
    found = counts.where("entry <> '' AND toxic >= 3 AND clean * 25 <= toxic").where(~stem | (F.col("under") >= 1.5 * F.col("toxic")))
    for r in found.select("entry", F.least(F.lit(MAX_SURE), evidence).alias("sure")).collect():  # of words of at most ``train_rows`` documents
        of, entry = {"*": stems, ">": harms}.get(r["entry"][-1], words), r["entry"].rstrip("*>")
        of[entry] = max(of.get(entry, 0.0), r["sure"])
    for r in counts.where(F.col("entry").isin(sorted({*INSULTS, *MORE_HARMS}.union(*map(forms, HARMS))))).where("clean >= 3 AND clean > toxic").collect():
        words[r["entry"]] = 0.0
    return Acceptor(words, stems, {w: sure for w, sure in harms.items() if w not in words})


def score(docs: DataFrame, learned: Acceptor, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score, predicted."""
    acceptor = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(acceptor.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": [scorer.score(t) for t in b["text"]]})

    asked = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")  # long with nulls would be float in pandas
    scored = asked.mapInPandas(run, "doc_id string, held_out boolean, score double").withColumn("doc_id", F.col("doc_id").cast("long"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that don't score as toxic; learned from the labels of these rows.

    Null and empty texts score 0 and stay; rows that repeat stay or go together;
    rows with null ids have no label and are scored like others; an empty table stays empty; other columns, whatever their names, are handed on.
    """
    acceptor = spark.sparkContext.broadcast(learn(docs, table(spark, sf_dir, "labels")))

    @F.pandas_udf("boolean")
    def civil(text: pd.Series) -> pd.Series:
        scorer = Scorer(acceptor.value)
        return text.map(lambda t: scorer.score(t) < THRESHOLD).astype(bool)

    return docs.where(civil("text"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}

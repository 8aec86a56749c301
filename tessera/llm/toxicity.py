"""Toxicity by a weighted finite-state pattern grammar.

Transducers read the tokens of a clause (text between sentence marks or line ends) as symbols, one for each set of roles
that a token can have, and write symbols and factors. *Insult* marks tokens of the learned lexicon, *threat* marks harm that
follows an intent, *target* raises what stands within a few tokens of a second person on either side, *negation*
and *reported speech* lower what follows their cues. The five are composed into one machine for each language; its best
path over a clause, found token by token, is the clause's score: the sum of its marks' weights (an insult's log-odds, or the weight
of a threat) times the factors on the path. A document's evidence is the sum of its clauses' scores, and a logistic curve over
evidence, its strongest clause and the number of clauses that score gives the result.

The target transducer is not deterministic: a mark with no target before it may promise one, and paths whose promise
is not kept end. So a target counts from both sides, and only near.

The insult transducer's arcs are learned: of words and word beginnings (3 to 8 letters) of labelled documents,
those that occur mostly in toxic ones, with a log-odds weight. Intents, harms, targets, negations and reports are given for
English, German, French and Spanish; a clause is read by the machine of the language most of whose common words it has, by those of
all languages that have equally many. Learning reads at most ``SAMPLE`` labelled documents, those with the least hash
of their id, which bounds what reaches the driver; no arc that they give is dropped.

Tokens are runs of letters and digits, lower-cased, in learning and matching alike. One Aho-Corasick pass finds arcs and
harms; clauses without one are not tokenised.

Edge cases: null and empty texts, and texts without a match, get the score of no evidence; without labelled
rows the lexicon is empty and only threats count; texts are scored whole; rows with null ids are
scored and never learned from; repeated rows are scored each; of several texts of a labelled id the least is learned from, and
an id labelled both ways counts as toxic; an empty table gives an empty result; other columns are ignored or pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Hashable, Iterable, Iterator
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import materialize, ship, table

#: Labelled documents learned from at most.
SAMPLE = 20_000
#: Documents that must have an arc, and the least log-odds that it must carry.
SUPPORT, LEAST_ODDS = 5, 3.0
PREFIXES = range(3, 9)
#: Times the documents of its best continuation that a beginning must have to stand for all of them.
GENERAL = 1.25

# Common words of each language, by which a clause's language is told, and the grammar's cue words.
COMMON = {
    "en": "the of and to in is that it for was on with as at by this be are from or an have not you your will i we he she they",
    "de": "der die das und ist nicht ein eine zu den mit von auf dem im ich du sie wir ihr dich dir es er war hat wird dass",
    "fr": "le la les un une est et de des du que qui dans pas pour sur ce il elle je tu vous nous au avec sont ne se",
    "es": "el la los las un una es y de del que en no por con para se su lo al como yo usted son fue eres este esta",
}
CUES = {
    "en": {
        "target": "you your yours yourself yourselves u ur",
        "negation": "not no never t nobody neither without",
        "report": "said says quoted wrote writes reported claimed claims called calls alleged",
        "intent": "will gonna should shall must ll going want wanna",
        "harm": "kill hurt beat destroy murder burn shoot stab strangle smash punch",
    },
    "de": {
        "target": "du dich dir dein deine deinen deiner deines euch euer eure ihr sie ihnen",
        "negation": "nicht kein keine keinen keiner nie niemals",
        "report": "sagte sagt schrieb zitierte behauptete meldete nannte angeblich",
        "intent": "werde werden wird wirst soll sollte sollen muss will",
        "harm": "töten toeten umbringen schlagen verletzen zerstören verbrennen erschießen ermorden erstechen verprügeln",
    },
    "fr": {
        "target": "tu te toi ton ta tes vous votre vos",
        "negation": "pas jamais ni aucun aucune sans",
        "report": "dit disait écrit cité déclaré affirmé rapporté appelé prétendu",
        "intent": "vais va vas allons doit dois devrait faut veux",
        "harm": "tuer frapper détruire brûler blesser battre assassiner poignarder étrangler tabasser",
    },
    "es": {
        "target": "tú tu te ti usted ustedes vosotros tus vuestro contigo",
        "negation": "no nunca jamás ni sin ningún ninguna",
        "report": "dijo dice escribió citó declaró afirmó informó llamó supuestamente",
        "intent": "voy vas va vamos debo debe deben hay quiero",
        "harm": "matar matarte golpear golpearte destruir quemar quemarte herir disparar asesinar apuñalar",
    },
}
LANGUAGES = tuple(CUES)
#: Symbols: i insult, h harm, p intent, t target, n negation, r report, as read; I insult, T threat, as marked.
ROLES = {"target": "t", "negation": "n", "report": "r", "intent": "p", "harm": "h"}

#: Tokens that negation, reported speech and intent stay open for, and within which a target is near.
REACH = {"negation": 3, "report": 6, "intent": 3, "target": 6}
NEGATED, REPORTED, TARGETED, THREAT = 0.1, 0.4, 1.5, 4.0
_BREAK = re.compile(r"[.!?;:\n]")
_TOKEN = re.compile(r"[^\W_]+")


class Transducer:
    """States, and arcs by (state, symbol read): (symbol written, factor, next state). Paths end in a final state."""

    def __init__(self, start: Hashable, alphabet: Iterable[str], step: Callable[[Hashable, str], Iterable[tuple[str, float, Hashable]]], final: Callable[[Hashable], bool] = lambda s: True) -> None:
        """All states that ``step`` reaches from ``start`` by symbols of ``alphabet``."""
        self.start, self.alphabet = start, frozenset(alphabet)
        self.arcs: dict[tuple[Hashable, str], list[tuple[str, float, Hashable]]] = {}
        self.states, todo = {start}, [start]
        while todo:
            state = todo.pop()
            for symbol in self.alphabet:
                self.arcs[state, symbol] = arcs = list(step(state, symbol))
                for _, _, to in arcs:
                    if to not in self.states:
                        self.states.add(to)
                        todo.append(to)
        self.final = {s for s in self.states if final(s)}

    def writes(self) -> set[str]:
        return {out for arcs in self.arcs.values() for out, _, _ in arcs}


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that reads as ``a`` and writes what ``b`` makes of what ``a`` writes; factors multiply."""

    def step(state, symbol):
        for out, factor, to in a.arcs[state[0], symbol]:
            for out2, factor2, to2 in b.arcs[state[1], out]:
                yield out2, factor * factor2, (to, to2)

    return Transducer((a.start, b.start), a.alphabet, step, lambda s: s[0] in a.final and s[1] in b.final)


def _marked(symbol: str) -> bool:
    return "I" in symbol or "T" in symbol


def insult(alphabet: Iterable[str]) -> Transducer:
    return Transducer(0, alphabet, lambda s, x: [(x + "I" * ("i" in x), 1.0, 0)])


def threat(alphabet: Iterable[str]) -> Transducer:
    """Harm up to a reach after an intent; the state is the reach that is left."""
    return Transducer(0, alphabet, lambda s, x: [(x + "T" * ("h" in x and s > 0), 1.0, REACH["intent"] if "p" in x else max(0, s - 1))])


def damped(alphabet: Iterable[str], cue: str, factor: float) -> Transducer:
    """Marks up to a reach after a cue count less."""
    return Transducer(0, alphabet, lambda s, x: [(x, factor if s and _marked(x) else 1.0, REACH[cue] if ROLES[cue] in x else max(0, s - 1))])


def targeted(alphabet: Iterable[str]) -> Transducer:
    """Marks up to a reach after a target, or before one, which a path promises: (reach left of a target seen, of one promised)."""
    reach = REACH["target"]

    def step(state, x):
        seen, promised = state
        if "t" in x:
            yield x, TARGETED if _marked(x) else 1.0, (reach, 0)
            return
        if promised == 1:
            return  # the last place for it
        after = (max(0, seen - 1), max(0, promised - 1))
        if not _marked(x):
            yield x, 1.0, after
        elif seen or promised:
            yield x, TARGETED, after
        else:
            yield x, 1.0, after
            yield x, TARGETED, (0, reach)

    return Transducer((0, 0), alphabet, step, lambda s: s[1] == 0)


def roles(language: str) -> dict[str, str]:
    """The symbol of every cue word."""
    out: dict[str, str] = {}
    for cue, words in CUES[language].items():
        for w in words.split():
            out[w] = "".join(sorted(out.get(w, "") + ROLES[cue]))
    return out


def stages(language: str) -> list[Transducer]:
    """The five transducers, each over what the one before it writes."""
    read = {"", *roles(language).values()}
    out = [insult(read | {x + "i" for x in read})]
    for make in (threat, targeted, lambda x: damped(x, "negation", NEGATED), lambda x: damped(x, "report", REPORTED)):
        out.append(make(out[-1].writes()))
    return out


@lru_cache(maxsize=len(CUES))
def machine(language: str) -> tuple[Hashable, dict, frozenset]:
    """Start, arcs and final states of the composed machine; an arc is (next state, factor of an insult, factor of a threat), states are numbers."""
    whole = reduce(compose, stages(language))
    number = {s: i for i, s in enumerate(whole.states)}
    arcs = {(number[s], x): [(number[to], f * ("I" in out), f * ("T" in out)) for out, f, to in found] for (s, x), found in whole.arcs.items()}
    return number[whole.start], arcs, frozenset(number[s] for s in whole.final)


@lru_cache(maxsize=1)
def _language_words() -> tuple[dict[str, tuple[str, ...]], dict[str, dict[str, str]]]:
    common: dict[str, tuple[str, ...]] = {}
    for language, words in COMMON.items():
        for w in words.split():
            common[w] = (*common.get(w, ()), language)
    return common, {x: roles(x) for x in LANGUAGES}


def clause_languages(tokens: list[str]) -> list[str]:
    """The languages that most of a clause's common words belong to."""
    common = _language_words()[0]
    n = dict.fromkeys(LANGUAGES, 0)
    for t in tokens:
        for x in common.get(t, ()):
            n[x] += 1
    most = max(n.values())
    return [x for x in LANGUAGES if n[x] == most]


def clause_score(tokens: list[str], weight: Callable[[str], float]) -> float:
    """The best path's score of one clause; ``weight(token)`` is the insult arc's weight, 0 without one."""
    weights = [weight(t) for t in tokens]
    best = 0.0
    for language in clause_languages(tokens):
        start, arcs, final = machine(language)
        role = _language_words()[1][language]
        paths = {start: 0.0}
        for t, w in zip(tokens, weights, strict=True):
            x = role.get(t, "") + "i" if w else role.get(t, "")
            after: dict[int, float] = {}
            for state, score in paths.items():
                for to, of_insult, of_threat in arcs[state, x]:
                    got = score + of_insult * w + of_threat * THREAT
                    if got >= after.get(to, 0.0):
                        after[to] = got
            paths = after
        best = max(best, *(v for s, v in paths.items() if s in final))
    return best


class Grammar:
    """The composed machines over a lexicon of (kind, text, weight); kind 'w' is a word, 'p' a beginning."""

    def __init__(self, lexicon: list[tuple[str, str, float]]) -> None:
        self.words = {t: w for kind, t, w in lexicon if kind == "w"}
        self.beginnings = {t: w for kind, t, w in lexicon if kind == "p"}
        self._lengths = sorted({len(t) for t in self.beginnings}, reverse=True)
        self._finder = ahocorasick.Automaton()
        harms = {t for x in LANGUAGES for t in CUES[x]["harm"].split()}
        for t in {*self.words, *self.beginnings, *harms}:
            self._finder.add_word(t, len(t))
        self._finder.make_automaton()

    def insult(self, token: str) -> float:
        if (w := self.words.get(token)) is not None:
            return w
        return next((w for n in self._lengths if (w := self.beginnings.get(token[:n])) is not None), 0.0)

    def evidence(self, text: str | None) -> tuple[float, float, int]:
        """Sum and maximum of the clauses' scores, and the number of clauses with one."""
        text = (text or "").lower()
        total, most, n, done = 0.0, 0.0, 0, -1
        for end, size in self._finder.iter(text):
            start = end - size + 1
            if start < done or (start and text[start - 1].isalnum()):
                continue
            stop = _BREAK.search(text, end + 1)
            done = stop.start() if stop else len(text)
            begin = max(text.rfind(c, 0, start) for c in ".!?;:\n") + 1
            score = clause_score(_TOKEN.findall(text, begin, done), self.insult)
            if score:
                total, most, n = total + score, max(most, score), n + 1
        return total, most, n


def in_fold(doc_id: Column) -> Column:
    """Whether a row is held out: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def arcs_of(text: str | None) -> set[str]:
    """Words (after w) and their beginnings (after p) of a text."""
    out = set()
    for t in set(_TOKEN.findall((text or "").lower())):
        out.add(f"w{t}")
        out.update(f"p{t[:n]}" for n in PREFIXES if n < len(t))
    return out


def _learn_lexicon(sample: DataFrame) -> list[tuple[str, str, float]]:
    """Arcs from ``sample`` (doc_id, text, toxic), by the documents of either label that have each word or beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.toxicity import arcs_of

        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1), strict=True):
                arcs = list(arcs_of(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(arcs, pa.string()), pa.array([toxic.as_py()] * len(arcs), pa.int32())], ["arc", "toxic"])

    arcs = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "arc string, toxic int")
    counts = arcs.groupBy("arc").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).where(F.col("bad") >= SUPPORT)
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    # Half a document is added to both counts, so that an arc of few documents weighs less than one of many.
    odds = F.log((F.col("bad") + 0.5) / (n.get(1, 0) + 1.0)) - F.log((F.col("good") + 0.5) / (n.get(0, 0) + 1.0))
    # Bounded by the sample: an arc has SUPPORT of its documents at least.
    rows = [(r.arc[0], r.arc[1:], r.bad, float(r.odds)) for r in counts.withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).collect()]
    # A beginning stays only if it holds clearly more documents than the best arc that extends it; then it covers those.
    further: dict[str, int] = {}
    for kind, arc, bad, _ in rows:
        for k in range(1, len(arc) + (kind == "w")):
            further[arc[:k]] = max(further.get(arc[:k], 0), bad)
    kept = {(kind, arc): w for kind, arc, bad, w in rows if kind == "w" or bad >= GENERAL * further.get(arc, 0)}
    covered = lambda t: any(("p", t[:k]) in kept for k in range(1, len(t)))
    return sorted((k, t, w) for (k, t), w in kept.items() if not covered(t))


def _features(total: np.ndarray, most: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.minimum(most, 20.0) / 10, np.log1p(n)], axis=1)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    w[0], w[1] = -2.0, 1.0
    if len(np.unique(y)) < 2:
        return w.tolist()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def _scored(docs: DataFrame, lexicon: list, curve: list[float] | None) -> DataFrame:
    """doc_id, total, most, n and score of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.toxicity import Grammar, _features

        g = Grammar(lexicon)
        w = np.array(curve or [0.0] * 4)
        for b in batches:
            got = np.array([g.evidence(t.as_py()) for t in b.column(1)], dtype=np.float64).reshape(-1, 3)
            score = 1 / (1 + np.exp(-np.clip(_features(*got.T) @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in got.T), pa.array(score)], ["doc_id", "total", "most", "n", "score"])
        pa.default_memory_pool().release_unused()  # a worker outlives its task

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, total double, most double, n double, score double")


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list, list[float]]:
    """Lexicon and curve from documents (doc_id, text) and labels (doc_id, toxic) outside of the held-out fold."""
    chosen = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~in_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = materialize(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "toxic-sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = materialize(texts, "toxic-texts")
    lexicon = _learn_lexicon(sample)
    rows = _scored(sample, lexicon, None).join(F.broadcast(chosen), "doc_id").select("total", "most", "n", "toxic").collect()  # SAMPLE rows at most
    data = np.array([tuple(r) for r in rows], dtype=np.float64).reshape(-1, 4)
    return lexicon, _fit(_features(*data[:, :3].T), data[:, 3])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    lexicon, curve = learn(docs, labels)
    out = _scored(docs, lexicon, curve)
    return out.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that score 0.5 or more; whole rows pass through the scoring."""
    lexicon, curve = learn(docs, labels)
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.toxicity import Grammar, _features

        g, w = Grammar(lexicon), np.array(curve)
        for b in batches:
            got = np.array([g.evidence(t.as_py()) for t in b.column(at)], dtype=np.float64).reshape(-1, 3)
            yield b.filter(pa.array(_features(*got.T) @ w < 0))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learned from labels outside of the held-out fold."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

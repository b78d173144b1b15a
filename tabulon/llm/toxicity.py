"""Toxicity by a weighted finite-state pattern grammar.

Words are classified (insult, threat, target, negation, reported speech, ...) and a text is cut into clauses: classes and
signs for pauses, colons and quotes. Small transducers each read a clause and write it again, as classes with marks:

* insult: neighbouring insults are one phrase; threat: its object, so that "kill the process" is aimed at nobody
* target: someone who stands near an insult or is a threat's object
* negation: the few words after it
* reported speech: what follows a verb of saying of another than the speaker, over a colon and to the end of its
  quotation; and what stands before one, set off by a pause or a closing quote

They are composed, what one writes being what the next reads, into two machines: one reads a clause from its end, the
other what that one wrote from its beginning. What counts is the marked pattern that remains, not the word alone. A
text's evidence is how many clauses matched each pattern, damped; the weights and the bias come from logistic regression
on labelled rows.

The lexicons hold seed words. Words, and stems that words begin with, that labels show to be as telling are a lexicon of
their own, which is read like insults and weighed apart, each only if no shorter stem of it is. They are in a certain
share of the toxic rows at least, so their number is bounded by the words of such a row over that share. Labels are
taken only from rows whose crc32 of the id as text leaves a remainder other than 0 by ``FOLDS``, at most ``SAMPLE`` of
them by a hash of the id. Only the text is scored.

Nulls and empty texts match nothing and score by the bias. Repeated rows score alike. Very long texts are read whole.
Without labelled rows of both kinds built-in weights are used. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import bounded, split_words

FOLDS, SAMPLE, SEED = 5, 20_000, 11
#: A word or stem joins the lexicon if this share of the toxic rows have it, and so many of them at least, and it is
#: this many times as frequent there.
LEARNED_SHARE, LEARNED_LEAST, LEARNED_RATIO = 0.015, 5, 20.0
#: Lengths of stems.
STEM = range(4, 9)
#: Words that a negation or a target reaches.
SCOPE = 3
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, SELF, ARTICLE, LEARNED, PAUSE, COLON, OPEN, CLOSE = range(13)
LEXICON = {
    INSULT: "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns imbecile fool fools vermin filth filthy jerk creep bastard bitch crap asshole retard "
    "dummkopf trottel abschaum arschloch idioten wertlos imbécile imbéciles débile connard salaud ordure crétin estúpido estúpida imbécil basura escoria inútil asqueroso",
    THREAT: "kill kills murder hurt destroy beat stab shoot burn töten umbringen vernichten tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours you're u he she him her they them their these those people du dich ihr euch sie dein tu te toi vous ton ta votre tú ti usted ustedes vosotros",
    NEGATION: "not no never isn't aren't don't doesn't didn't wasn't won't can't nobody nicht kein keine nie pas jamais aucun nunca jamás",
    REPORT: "said says say wrote writes quoted quote claimed claims reported told called allegedly sagte sagt schrieb dit écrit dijo dice escribió",
    SELF: "i i'm i've i'd i'll we we've ich wir je j'ai nous yo nosotros",
    ARTICLE: "the a an this that some any der das den ein eine einen le la les un une des el los las una",
}
#: Marks that the transducers leave on a match; the last is only for the transducers after it.
TARGETED, NEGATED, REPORTED, ELSEWHERE = 1, 2, 4, 8
PATTERNS = [(kind, marks) for kind in (INSULT, THREAT, LEARNED) for marks in range(8)]
_CLASSES, _MARKS = 16, 16
_HITS, _NAMES, _RESETS = (INSULT, THREAT, LEARNED), (INSULT, LEARNED), (COLON, OPEN, CLOSE)
SYMBOLS = [c + _CLASSES * m for c in range(CLOSE + 1) for m in (range(_MARKS) if c in _HITS else (0,))]
_QUOTES = "\"“”„«»‘‚"
_TRIM = string.punctuation + "“”„«»‘’…¡¿"
_DEFAULT = np.array([2.0, 3.0, 0.5, 0.5, 1.0, 1.0, 0.2, 0.2, 0.0, 2.0, 0.0, 0.2, 0.0, 0.5, 0.0, 0.1, 2.0, 3.0, 0.5, 0.5, 1.0, 1.0, 0.2, 0.2])
_DEFAULT_BIAS = -2.0


class Transducer:
    """A deterministic machine that writes a symbol for each that it reads; a symbol is a class and its marks.

    ``step[state][symbol]`` is the next state and the symbol written; state 0 begins. Only matches bear marks.
    """

    def __init__(self, step: list[dict[int, tuple[int, int]]]) -> None:
        self.step = step

    @classmethod
    def of(cls, states: int, rule: Callable[[int, int, int], tuple[int, int]]) -> Transducer:
        """``rule(state, class, marks)`` gives the next state and the marks to add."""
        return cls([{x: (to, x % _CLASSES + _CLASSES * (x // _CLASSES | more)) for x in SYMBOLS for to, more in [rule(s, x % _CLASSES, x // _CLASSES)]} for s in range(states)])

    def __matmul__(self, first: Transducer) -> Transducer:
        """Composition: ``first`` reads the clause, this one what it writes. Only pairs of states that are reached are kept."""
        at, pairs, step = {(0, 0): 0}, [(0, 0)], []
        for a, b in pairs:
            row = {}
            for symbol, (to_a, mid) in first.step[a].items():
                to_b, out = self.step[b][mid]
                if (to_a, to_b) not in at:
                    at[to_a, to_b] = len(pairs)
                    pairs.append((to_a, to_b))
                row[symbol] = (at[to_a, to_b], out)
            step.append(row)
        return Transducer(step)

    def __call__(self, tape: list[int]) -> list[int]:
        out, row, step = [], self.step[0], self.step
        for symbol in tape:
            to, written = row[symbol]
            out.append(written)
            row = step[to]
        return out


def _reach(cause: int, mark: int, kinds: tuple[int, ...], unless: int = 0) -> Transducer:
    """Marks matches of ``kinds`` in the ``SCOPE + 1`` symbols after ``cause``, but for those that bear ``unless``; colons and quotes end its reach."""

    def rule(state: int, c: int, m: int) -> tuple[int, int]:
        to = SCOPE + 1 if c == cause else 0 if c in _RESETS else max(0, state - 1)
        return to, mark if state and c in kinds and not m & unless else 0

    return Transducer.of(SCOPE + 2, rule)


def _threat_object() -> Transducer:
    """From the end: a threat whose object is a target, or, with an article next to it, something else."""
    blocked = SCOPE + 2

    def rule(state: int, c: int, m: int) -> tuple[int, int]:
        added = 0 if c != THREAT else ELSEWHERE if state == blocked else TARGETED if state else 0
        to = SCOPE + 1 if c == TARGET else blocked if c == ARTICLE else 0 if c in _RESETS or state == blocked else max(0, state - 1)
        return to, added

    return Transducer.of(SCOPE + 3, rule)


def _report_after() -> Transducer:
    """From the end: what stands before a verb of saying that a pause or a closing quote sets off."""
    plain, quoted = SCOPE + 1, SCOPE + 2

    def rule(state: int, c: int, m: int) -> tuple[int, int]:
        added = REPORTED if state >= plain and c in _HITS else 0
        if state == quoted:
            return 0 if c == OPEN else quoted, added
        if state and c == CLOSE:
            return quoted, added
        if state == plain:
            return 0 if c in (COLON, OPEN) else plain, added
        if state and c == PAUSE:
            return plain, added
        if c == REPORT:
            return SCOPE, added
        return 0 if c in (COLON, OPEN, SELF) else max(0, state - 1), added

    return Transducer.of(SCOPE + 3, rule)


def _report_before() -> Transducer:
    """What follows a verb of saying, to the end of the clause or of the quotation that follows it; not the speaker's own."""
    none, own, told, quoted = range(4)

    def rule(state: int, c: int, m: int) -> tuple[int, int]:
        added = REPORTED if state in (told, quoted) and c in _HITS else 0
        if state == quoted:
            return none if c == CLOSE else quoted, added
        if state == told:
            return quoted if c == OPEN else told, added
        return own if c == SELF else told if c == REPORT and state == none else none, added

    return Transducer.of(4, rule)


def _phrase() -> Transducer:
    """Neighbouring insults are one: all but the first become other words."""
    first = {x: (int(x % _CLASSES in _NAMES), x) for x in SYMBOLS}
    return Transducer([first, {x: (to, OTHER if to else x) for x, (to, _) in first.items()}])


FROM_END = _report_after() @ _threat_object() @ _reach(TARGET, TARGETED, _NAMES)
FROM_BEGIN = _reach(TARGET, TARGETED, _HITS, ELSEWHERE) @ _reach(NEGATION, NEGATED, _HITS) @ _report_before() @ _phrase()


def clause_patterns(classes: list[int]) -> list[tuple[int, int]]:
    """Matches of a clause as (kind, marks)."""
    tape = FROM_BEGIN(FROM_END(classes[::-1])[::-1])
    return [(x % _CLASSES, x // _CLASSES & 7) for x in tape if x % _CLASSES in _HITS]


class Grammar:
    """Counts of matched clauses by pattern for batches of texts."""

    def __init__(self, learned: list[str]) -> None:
        self.kinds = dict.fromkeys(learned, LEARNED)
        self.stems = {w for w in learned if len(w) in STEM}
        for kind, words in LEXICON.items():
            self.kinds.update(dict.fromkeys(words.split(), kind))

    def kind(self, word: str) -> int:
        found = self.kinds.get(word, OTHER)
        if found == OTHER and any(word[:n] in self.stems for n in STEM):
            return LEARNED
        return found

    def symbols(self, word: str) -> list[int]:
        """The class of a word between the signs that its punctuation stands for."""
        plain = word.lower().replace("’", "'").strip(_TRIM)
        out = [OPEN] * (word[0] in _QUOTES and len(word) > 1) + [self.kind(plain)]
        end = word.rstrip(string.punctuation + "”“»‘’…")
        tail = word[len(end):] if plain else ""
        if any(c in _QUOTES + "’" for c in tail.rstrip(".,;:!?…")[-1:]) or tail[-1:] in ("”", "»", '"'):
            out.append(CLOSE)
        if "," in tail:
            out.append(PAUSE)
        return [*out, COLON] if ":" in tail else out

    def counts(self, column: pa.Array) -> np.ndarray:
        codes, words, offsets = split_words(column)
        out = np.zeros((len(offsets) - 1, len(PATTERNS)))
        if not len(codes):
            return out
        names = words.to_pylist()
        kind = np.array([self.kind(w.lower().replace("’", "'").strip(_TRIM)) for w in names], np.int8)
        ends = np.array([w[-1] in ".!?;…" for w in names], bool)
        kinds, stop = kind[codes], ends[codes]
        hits = np.nonzero(np.isin(kinds, _HITS))[0]
        # clauses end at a mark and at the end of a text
        last = np.zeros(len(codes), bool)
        last[offsets[1:][np.diff(offsets) > 0] - 1] = True
        clause = np.cumsum(np.r_[0, (stop | last)[:-1]])
        known: dict[int, list[int]] = {}
        for c in np.unique(clause[hits]):
            a, b = np.searchsorted(clause, [c, c + 1])
            doc = np.searchsorted(offsets, a, side="right") - 1
            tape: list[int] = []
            for w in codes[a:b].tolist():
                if w not in known:
                    known[w] = self.symbols(names[w])
                tape += known[w]
            for pattern in set(clause_patterns(tape)):
                out[doc, PLACE[pattern]] += 1
        return out


PLACE = {p: i for i, p in enumerate(PATTERNS)}


def evidence(counts: np.ndarray) -> np.ndarray:
    """The first clause of a pattern tells most."""
    return np.log2(1 + counts)


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps on the penalised likelihood; the bias bears no penalty."""
    z = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * np.maximum(p * (1 - p), 1e-9)) @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _learned(some: DataFrame) -> list[str]:
    words = F.array_distinct(F.transform(F.split(F.replace(F.lower("text"), F.lit("’"), F.lit("'")), "[\\x20\\x09-\\x0D]+"), lambda w: F.btrim(w, F.lit(_TRIM))))
    stems = F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= STEM[0]), lambda w: F.transform(F.sequence(F.lit(STEM[0]), F.least(F.length(w), F.lit(STEM[-1]))), lambda n: F.left(w, n))))
    rows = some.select("toxic", F.explode(F.array_distinct(F.concat(words, stems))).alias("word")).where("word <> ''")
    rows = rows.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    bad, good = some.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not bad or not good:
        return []
    ratio = F.col("bad") / bad / ((F.col("good") + 1) / good)
    told = rows.where((F.col("bad") >= max(LEARNED_LEAST, LEARNED_SHARE * bad)) & (ratio >= LEARNED_RATIO))
    found = [r.word for r in told.select("word").orderBy("word").collect()]
    known = set(found)
    return [w for w in found if not any(w[:n] in known for n in STEM if n < len(w))]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, float]:
    """Learned words, weights and bias from at most ``sample`` labelled rows outside fold 0."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != 0).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "toxic").limit(sample)
    some = docs.join(F.broadcast(known), "doc_id").where("text is not null").select("toxic", F.col("text").cast("string").alias("text"))  # broadcast: at most ``sample`` rows of two numbers
    learned = _learned(some)
    grammar = Grammar(learned)
    names = [f"p{i}" for i in range(len(PATTERNS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            counts = grammar.counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T)], names=["toxic", *names])

    rows = some.mapInArrow(run, "toxic int, " + ", ".join(f"{n} double" for n in names)).groupBy("toxic", *names).count().toPandas()  # equal evidence is one row
    if rows.toxic.nunique() < 2:
        return learned, _DEFAULT, _DEFAULT_BIAS
    rows = rows.sort_values(["toxic", *names]).reset_index(drop=True)
    times = rows["count"].to_numpy()
    weights, bias = regression(np.repeat(evidence(rows[names].to_numpy()), times, axis=0), np.repeat(rows.toxic.to_numpy(), times).astype(float))
    return learned, weights, bias


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, held_out, score, predicted, clauses)``; a null id is not held out."""
    learned, weights, bias = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, sample)
    grammar = Grammar(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            counts = grammar.counts(batch.column(2))
            p = 1 / (1 + np.exp(-np.clip(evidence(counts) @ weights + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(counts.sum(1).astype(np.int64))], names=["doc_id", "held_out", "score", "predicted", "clauses"])

    doc = F.col("doc_id").cast("long")
    rows = docs.select(doc.alias("doc_id"), F.coalesce(fold(doc) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, clauses long")

"""Abusive, hateful and sexual content: a weighted finite-state grammar over clauses.

A text becomes a string of word classes (spelling tricks are undone word by word), and a cascade of transducers runs
over each sentence, each reading what the one before wrote: phrases and persons, benign compounds, negation, reported
speech. Then weighted automata look for clauses: someone is called something (an insult must attach to a person, so
nothing may stand between that makes it a thing of its own), someone is threatened (the verb must take a person), a
group is degraded or to be got rid of, sex is described. Automata belong to parts (insult, threat, hostility, ...); a
sentence's score of a kind is the sum over its parts of the best clause of each, less what technical words weigh; a
text scores its worst sentence. Words without a clause score nothing.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from thalweg.llm import lexicon as X

#: A sentence at this score or above marks its text.
THRESHOLD = 1.0

_INVISIBLE = re.compile("[​-‏⁠﻿­‪-‮]")
_TAG = re.compile(r"<[^<>]{1,300}>")
_WRONG = re.compile(r"[ÂÃâÅ]")
_SPACED = re.compile(r"(?<![^\s\"'(“„«])(?:[^\W_] ){3,}[^\W_](?![^\s.,!?;:\"')”»]|\.\w)")
_DASH = re.compile(r"\s[-–—]\s")


@dataclass(frozen=True)
class Slot:
    """One step of a pattern: a token with any of `any_of`, all of `all_of` and none of `none_of`, at most `gap` tokens
    after the step before, none of them with a class of `bar`."""

    any_of: int
    gap: int = 0
    none_of: int = 0
    bar: int = 0
    all_of: int = 0


@dataclass(frozen=True)
class Pattern:
    kind: str
    part: str
    weight: float
    slots: tuple[Slot, ...]


def _p(part: str, weight: float, *slots) -> Pattern:
    kind = {"hate": "hateful", "ban": "hateful", "sex": "sexual"}.get(part, "abusive")
    return Pattern(kind, part, weight, tuple(s if isinstance(s, Slot) else Slot(*s) if isinstance(s, tuple) else Slot(s) for s in slots))


_CALLED = X.INSULT | X.THING
#: What ends the stretch in which an insult still belongs to the person addressed.
_OWN = X.DET | X.MODAL | X.FIRST | X.YOUR
_PERSON = X.NAME | X.PRONOUN
PATTERNS = [
    # someone is called something: you idiot; you filthy pig; you are a ... pig; your brother is a moron; what a moron you are
    _p("insult", 1.2, X.YOU, (X.INSULT, 2, 0, _OWN | X.BE)),
    _p("insult", 1.1, X.YOU, (X.SLUR_ADJ, 2, 0, _OWN | X.BE), (_CALLED | X.SLUR_ADJ, 2, 0, _OWN)),
    _p("insult", 1.0, X.YOU, Slot(X.THING, 0, all_of=X.END)),
    _p("insult", 1.2, X.YOU, (X.BE, 2, 0, X.MODAL), (X.INSULT, 5, 0, X.YOUR | X.FIRST)),
    _p("insult", 1.1, X.YOU, (X.BE, 2, 0, X.MODAL), (X.THING, 4, 0, X.YOUR | X.FIRST)),
    _p("insult", 1.0, X.YOU, (X.BE, 2, 0, X.MODAL), (X.SLUR_ADJ, 2, 0, X.YOUR | X.DET), (_CALLED | X.SLUR_ADJ, 4, 0, X.YOUR)),
    _p("insult", 1.2, Slot(X.YOU, all_of=X.YOU | X.BE), (X.INSULT, 5, 0, X.YOUR | X.FIRST)),
    _p("insult", 1.1, Slot(X.YOU, all_of=X.YOU | X.BE), (X.THING, 4, 0, X.YOUR | X.FIRST)),
    _p("insult", 1.1, _CALLED, (X.LIKE, 0), (X.YOU, 0)),
    _p("insult", 1.1, X.WHAT, (_CALLED, 4), (X.YOU, 1)),
    _p("insult", 1.0, X.SLUR_ADJ, (X.INSULT | X.SLUR_ADJ, 1), (X.YOU, 2)),
    _p("insult", 1.0, X.INSULT, (X.YOU, 1), (X.BE, 1)),
    _p("insult", 1.0, X.SLUR_ADJ, (X.INSULT, 0), Slot(X.STOP, 1)),
    _p("insult", 1.1, X.YOUR, (X.KIN | X.PEOPLE, 1), (X.BE, 1), (_CALLED | X.DEGRADE, 4)),
    _p("insult", 1.1, _PERSON, (X.BE, 1), (X.INSULT, 4, 0, X.YOUR)),
    _p("insult", 1.0, _PERSON, (X.BE, 1), (X.THING, 3, 0, X.YOUR)),
    _p("insult", 1.1, Slot(X.PRONOUN, all_of=X.PRONOUN | X.BE), (X.INSULT, 4, 0, X.YOUR)),
    _p("insult", 1.0, X.YOU, (X.PEOPLE | X.ALL_OF, 1), (X.BE, 6), (_CALLED | X.SLUR_ADJ, 4)),
    _p("insult", 0.7, X.COMMA, Slot(X.INSULT, 2, all_of=X.END)),
    _p("insult", 0.8, X.THIS, (_CALLED, 3, 0, X.BE)),
    _p("insult", 0.5, X.SLUR_ADJ, (_CALLED, 0)),
    # hostility: go away, be silent, nobody wants you
    _p("hostile", 0.7, X.HOSTILE),
    _p("hostile", 1.0, X.HOSTILE, (X.YOU, 14)),
    _p("hostile", 1.0, X.HOSTILE, (_CALLED | X.SLUR_ADJ, 12)),
    _p("hostile", 0.8, X.SHUT, (X.MOUTH, 2)),
    _p("hostile", 1.0, X.NOBODY, (X.REJECT, 2), (X.YOU, 3)),
    _p("hostile", 1.2, X.SELF),
    _p("hostile", 1.0, X.HOSTILE, (X.DIE | X.SELF, 3)),
    _p("hostile", 0.8, X.DESPISE, (X.YOU, 0), X.PLAIN),
    _p("hostile", 1.0, X.BEGIN | X.COMMA, (X.MODAL, 1), (X.FAVOUR, 4), (X.DIE | X.VIOLENCE | X.HOSTILE | X.SELF | X.BODY, 6)),
    # threat: harm is announced to or wished on someone addressed, or on a part of them; no thing is the object
    _p("threat", 1.2, X.FIRST, (X.VIOLENCE, 5), (X.YOU, 2, 0, X.DET | X.YOUR | X.PREP), X.PLAIN),
    _p("threat", 1.2, X.FIRST, (X.YOU, 4, 0, X.VIOLENCE), (X.VIOLENCE | X.DIE, 5), X.PLAIN),
    _p("threat", 1.2, X.FIRST, (X.VIOLENCE, 5), (X.YOUR, 2, 0, X.DET), (X.BODY | X.KIN, 1)),
    _p("threat", 1.2, X.FIRST, (X.YOU, 4), (X.VIOLENCE, 2), (X.BODY, 1)),
    _p("threat", 1.2, X.FIRST, (X.YOU, 4), (X.BODY, 2), (X.VIOLENCE, 2)),
    _p("threat", 1.1, X.YOU, (X.FIRST, 3), (X.VIOLENCE, 4)),
    _p("threat", 1.0, X.VIOLENCE, (X.YOUR | X.YOU, 2, 0, X.DET), (X.BODY, 1)),
    _p("threat", 1.0, X.VIOLENCE, (X.YOU, 0), (X.PLAIN, 0), (X.YOU | X.YOUR, 8)),
    _p("threat", 1.1, X.WEAPON, (X.YOUR, 3), (X.BODY, 1)),
    _p("threat", 1.2, X.HOPE, (X.YOU | X.YOUR, 2), (X.DIE | X.VIOLENCE, 4), X.PLAIN),
    _p("threat", 1.0, X.BEGIN | X.FIRST, (X.HOPE, 1), (X.YOU | X.YOUR, 2), (X.DIE | X.VIOLENCE, 4), (X.YOU, 3)),
    _p("threat", 1.1, X.YOU, (X.MUST, 3), (X.DIE, 5, 0, X.FIRST), X.PLAIN),
    _p("threat", 1.0, _PERSON, (X.MUST, 3), (X.DIE, 4), X.PLAIN),
    _p("threat", 1.1, X.YOUR, (X.KIN, 1), (X.MUST, 3), (X.DIE, 4)),
    _p("threat", 0.8, X.BEGIN, (X.DIE, 0), (_CALLED | X.SLUR_ADJ | X.YOU, 3)),
    _p("threat", 1.0, X.THIS, (_CALLED, 3), (X.DIE | X.VIOLENCE | X.HOSTILE | X.BODY, 12)),
    _p("threat", 1.0, X.VIOLENCE, (X.THEM | X.PRONOUN | X.NAME, 2), (_CALLED, 6)),
    # hate: what is said of a group
    _p("hate", 1.2, X.GROUP, Slot(X.BE, 3, none_of=X.PAST), (X.DEGRADE | _CALLED, 5)),
    _p("hate", 0.8, X.GROUP, Slot(X.PAST, 3), (X.DEGRADE | _CALLED, 3)),
    _p("hate", 1.2, X.GROUP, (X.DEGRADE, 6), (X.DEGRADE | X.EXCLUDE | X.THEM, 12)),
    _p("hate", 1.1, X.ALL_OF, (X.PEOPLE, 3), (X.BE, 3), (X.DEGRADE, 4)),
    _p("hate", 1.1, X.PEOPLE, (X.BE, 4), (X.DEGRADE, 4), (X.EXCLUDE | X.MUST, 10)),
    _p("hate", 1.0, X.THE, (X.PEOPLE, 1), (X.DEGRADE, 3), (X.DEGRADE | X.EXCLUDE | X.THEM, 10)),
    _p("hate", 1.1, X.ALL_OF, (X.FROM, 0), (X.BE, 3), (X.DEGRADE, 3)),
    # and what is demanded for it
    _p("ban", 1.0, X.GROUP, (X.MUST, 10), (X.EXCLUDE | X.DIE, 6)),
    _p("ban", 1.0, X.GROUP | X.PEOPLE, (X.NEGATION, 8), (X.LIVE, 6)),
    _p("ban", 1.0, X.NEGATION | X.NOBODY, (X.GROUP | X.PEOPLE, 8), (X.EXCLUDE | X.LIVE, 4)),
    _p("ban", 1.0, X.NEGATION, (X.GROUP | X.PEOPLE, 5), (X.OURS, 2)),
    _p("ban", 1.0, X.GROUP | X.PEOPLE, Slot(X.EXCLUDE, 12, bar=X.PAST), (X.THEM | X.EXCLUDE, 8)),
    _p("ban", 1.0, X.FIRST, (X.VIOLENCE, 3), (X.GROUP | X.PEOPLE, 4)),
    _p("ban", 1.0, X.VIOLENCE, (X.GROUP, 1), (X.THEM | X.EXCLUDE | X.DIE, 8)),
    _p("ban", 1.0, X.VIOLENCE | X.EXCLUDE, (X.PEOPLE, 3), (X.EXCLUDE | X.DIE, 12)),
    _p("ban", 1.0, X.THE, (X.PEOPLE, 2), Slot(X.EXCLUDE, 2, bar=X.PAST)),
    _p("ban", 1.0, X.BEGIN | X.FIRST | X.MUST | X.COMMA, (X.EXCLUDE, 2), (X.GROUP, 3)),
    _p("ban", 1.0, X.BEGIN | X.FIRST | X.MUST | X.COMMA, (X.EXCLUDE, 2), (X.PEOPLE, 4)),
    _p("ban", 1.0, X.GROUP, Slot(X.EXCLUDE, 0, none_of=X.MUST), Slot(X.STOP | X.COMMA, 1)),
    _p("ban", 1.0, X.ALL_OF, (X.PEOPLE, 3), Slot(X.EXCLUDE, 4, bar=X.PAST), (X.DEGRADE, 8)),
    _p("ban", 1.0, X.GROUP, Slot(X.EXCLUDE, 4, bar=X.PAST), (X.DEGRADE, 8)),
    # sexual: explicit words, alone or together
    _p("sex", 1.2, X.SEX_STRONG),
    _p("sex", 1.1, X.SEX_MID, (X.SEX_MID, 8)),
    _p("sex", 0.7, X.SEX_MID, (X.SEX_WEAK, 8)),
    _p("sex", 0.7, X.SEX_WEAK, (X.SEX_MID, 8)),
    _p("sex", 1.1, X.SEX_MID, (X.SEX_WEAK, 8), (X.SEX_WEAK | X.SEX_MID, 8)),
    _p("sex", 1.1, X.SEX_WEAK, (X.SEX_MID, 8), (X.SEX_WEAK | X.SEX_MID, 8)),
    _p("sex", 1.1, X.SEX_WEAK, (X.SEX_WEAK, 8), (X.SEX_MID, 8)),
    _p("sex", 1.0, X.SEX_WEAK, (X.SEX_WEAK, 10), (X.SEX_WEAK, 10), (X.SEX_WEAK, 10)),
    _p("sex", 0.5, X.SEX_MID),
]
KINDS = ("abusive", "hateful", "sexual")


def matches(pattern: Pattern, tags: list[int]) -> bool:
    """Whether the automaton accepts: states are (slot, words since it was taken), kept as one bit set per slot."""
    slots = pattern.slots
    n = len(slots)
    alive = [0] * n  # alive[k]: bit g set if slot k was taken g words ago
    for tag in tags:
        for k in range(n - 1, 0, -1):
            alive[k] = (alive[k] << 1) & 0xFFFFFF
            s = slots[k]
            if alive[k - 1] & ((1 << (s.gap + 1)) - 1) and tag & s.any_of and not tag & s.none_of and tag & s.all_of == s.all_of:
                if k == n - 1:
                    return True
                alive[k] |= 1
            if tag & s.bar:
                alive[k - 1] = 0
        alive[0] = (alive[0] << 1) & 0xFFFFFF
        s = slots[0]
        if tag & s.any_of and not tag & s.none_of and tag & s.all_of == s.all_of:
            if n == 1:
                return True
            alive[0] |= 1
    return False


_DENIED = X.INSULT | X.THING | X.SLUR_ADJ | X.DEGRADE


def negate(tags: list[int]) -> list[int]:
    """Negation: after a form of be and a negation, what is said of someone within three words is denied."""
    out, left = list(tags), 0
    for i, tag in enumerate(tags):
        if tag & X.NEGATION and i and (tags[i - 1] | (tags[i - 2] if i > 1 else 0)) & X.BE:
            left = 4
        elif left and tag & _DENIED:
            out[i] = tag & ~_DENIED
        left = max(0, left - 1)
    return out


_SAID = _DENIED | X.HOSTILE | X.SELF | X.VIOLENCE | X.DIE | X.EXCLUDE | X.YOU | X.GROUP | X.SEX_STRONG | X.SEX_MID


def unreport(tags: list[int]) -> list[int]:
    """Reported speech: quotations with a word of saying before or after them, and what is called so by others."""
    out = list(tags)
    speech = [i for i, t in enumerate(tags) if t & X.SPEECH]
    if not speech:
        return out
    start = None
    for i, tag in enumerate(tags):
        if tag & X.OPEN_QUOTE and start is None:
            start = i
        if tag & X.CLOSE_QUOTE and start is not None:
            if any(start - 6 <= s < start or i < s <= i + 5 for s in speech):
                for k in range(start, i + 1):
                    out[k] &= ~_SAID
            start = None
    for s in speech:  # "posts that call others ...": the sentence speaks about it unless it addresses someone
        if not any(t & (X.YOU | X.FIRST) for t in out):
            for k in range(s, len(out)):
                out[k] &= ~(X.INSULT | X.THING | X.DEGRADE | X.EXCLUDE)
    return out


def name(words: list[str], tags: list[int]) -> list[int]:
    """Phrases become one class at their first word, an initial and a name make a person, and starred-out words that
    are noise, not modesty, lose theirs."""
    out = list(tags)
    starred = [t for t in out if t & X.STARRED]
    if any(t & X.UNREAD for t in out) or (len(starred) > 1 and not any(t & X.SURE for t in starred)):
        out = [t & ~_SAID if t & X.STARRED else t for t in out]
    for i, w in enumerate(words):
        if w in X.PHRASE_FIRST:
            out[i] |= X.phrase_at(words, i)
        if out[i] & X.INITIAL and i + 1 < len(out):
            out[i + 1] |= X.NAME
    return out


#: Words that may follow a noun without making a compound of it.
_CLOSED = (
    X.LINK | X.DET | X.BE | X.MODAL | X.YOU | X.YOUR | X.NEGATION | X.PRONOUN | X.FIRST | X.PREP | X.FUNC | X.THEM | X.THIS | X.ALL_OF | X.MUST
    | X.HOSTILE | X.OURS | X.LIKE | X.NOBODY | X.WHAT | X.SHUT | X.NAME | X.INITIAL | X.SELF | X.HOPE | X.CLOSE_QUOTE
)


def compound(tags: list[int]) -> list[int]:
    """An insult that is part of a harmless compound is none, and a thing or animal before another noun is that noun's."""
    out = list(tags)
    for i, t in enumerate(tags[:-1]):
        after = tags[i + 1]
        if t & _CALLED and after & X.BENIGN_NEXT:
            out[i] = t & ~_DENIED
        elif t & X.THING and not t & (X.COMMA | X.END | X.INSULT) and not after & (_CLOSED | _CALLED):
            out[i] = t & ~X.THING
    return out


#: What may follow a person without turning them into the receiver, or the loser of a race, of what is done.
_SOFT = X.DET
_TO = {"to", "at", "of", "out", "zu", "a"}


def bounded(words: list[str], tags: list[int]) -> list[int]:
    """The sentence between its bounds, with the words that begin no object of their own marked."""
    plain = [t if t & _SOFT or w in _TO else t | X.PLAIN for w, t in zip(words, tags)]
    return [X.BEGIN, *plain, X.STOP | X.PLAIN]


def score_sentence(words: list[str], tags: list[int]) -> dict[str, float]:
    """Score per kind of one sentence."""
    tags = bounded(words, unreport(negate(compound(name(words, tags)))))
    clinical = sum(1 for t in tags if t & X.CLINICAL)
    present = 0
    for t in tags:
        present |= t
    best: dict[tuple[str, str], float] = {}
    for p in PATTERNS:
        if p.weight > best.get((p.kind, p.part), 0.0) and all(s.any_of & present for s in p.slots) and matches(p, tags):
            best[p.kind, p.part] = p.weight
    out: dict[str, float] = {}
    for (kind, _), weight in best.items():
        out[kind] = out.get(kind, 0.0) + weight
    if clinical and "sexual" in out and not present & X.SEX_STRONG:
        out["sexual"] = max(0.0, out["sexual"] - 0.7 * clinical)
    return out


def prepare(text: str) -> str:
    """One line of lower-case text: invisible signs and tags go, wrong decoding is undone, line ends end sentences."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        if _WRONG.search(text):
            fixed = text.encode("cp1252", "ignore").decode("utf-8", "ignore")
            if len(fixed) > 0.7 * len(text) and fixed != text and "Ã" in text:
                text = fixed
        text = _INVISIBLE.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = text.replace("\r", " ").replace("\n", " . ").lower()
    return _SPACED.sub(lambda m: X.parted(m.group().replace(" ", "")), text)


@functools.cache
def _possible(present: int) -> bool:
    """Whether some pattern finds all its classes among these. Scoring adds classes by phrases and names only."""
    return any(all(s.any_of & present for s in p.slots) for p in PATTERNS)


_CLASSES = 0
for _pattern in PATTERNS:
    for _slot in _pattern.slots:
        _CLASSES |= _slot.any_of


def worth_scoring(pairs: list[tuple[str, int]], present: int) -> bool:
    """False only if the grammar accepts nothing in a sentence of these (word, classes), `present` being all classes."""
    named = present & _CLASSES | X.BEGIN | X.STOP | X.PLAIN | (X.NAME if present & X.INITIAL else 0)
    if present & X.PHRASE and not _possible(named):
        words = [w for w, _ in pairs]
        for i, (_, tag) in enumerate(pairs):
            if tag & X.PHRASE:
                named |= X.phrase_at(words, i)
    return _possible(named)


def score_text(text: str | None, tagger: X.Tagger) -> tuple[float, dict[str, float]]:
    """(score, score per kind) of a text: those of its worst sentence; nothing for null and empty texts."""
    worst: dict[str, float] = {}
    if text:
        tokens = prepare(text).split()
        pairs = [tagger[t] for t in tokens]
        start, present = 0, 0
        for i, (_, tag) in enumerate(pairs):
            present |= tag
            if tag & X.END or i + 1 == len(pairs):
                part = pairs[start : i + 1]
                if worth_scoring(part, present):
                    for kind, s in score_sentence([w for w, _ in part], [t for _, t in part]).items():
                        if s > worst.get(kind, 0.0):
                            worst[kind] = s
                start, present = i + 1, 0
    return max(worst.values(), default=0.0), worst


_TAGGER = X.Tagger()


def _scorer(key_type: pa.DataType):
    def run(batches):
        for batch in batches:
            scores, kinds = [], {k: [] for k in KINDS}
            for text in batch.column(1).to_pylist():
                score, per = score_text(text, _TAGGER)
                scores.append(score)
                for k in KINDS:
                    kinds[k].append(per.get(k, 0.0))
            cols = [batch.column(0).cast(key_type), batch.column(2), pa.array(scores, pa.float64()), *[pa.array(kinds[k], pa.float64()) for k in KINDS]]
            yield pa.RecordBatch.from_arrays(cols, ["k", "s", "score", *KINDS])

    return run


def score_documents(df: DataFrame, key: str, text: str, source: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(key, source, score, abusive, hateful, sexual, marked): one row per row of df.

    Null and empty texts score 0 and are not marked. Rows with a null key or source keep it. Repeated rows are scored
    each. Texts of any length are read whole. Other columns are ignored, whatever their names.
    """
    s = F.col(source).cast("string") if source else F.lit(None).cast("string")
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), s.alias("s"))
    schema = f"k {dict(rows.dtypes)['k']}, s string, score double, " + ", ".join(f"{k} double" for k in KINDS)
    scored = rows.mapInArrow(_scorer(to_arrow_type(rows.schema["k"].dataType)), schema)
    return scored.select(F.col("k").alias(key), F.col("s").alias("source"), "score", *KINDS, (F.col("score") >= threshold).alias("marked"))


def rates(scored: DataFrame) -> DataFrame:
    """(source, n_docs, n_marked, rate): the part of marked documents per source; documents without one are one group."""
    marked = F.count_if(F.col("marked"))
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), marked.alias("n_marked"), F.round(marked / F.count(F.lit(1)), 6).alias("rate")
    )

import random
import sys
from pathlib import Path

import pytest

from thalweg.llm import abuse as A
from thalweg.llm import lexicon as X

sys.path.insert(0, str(Path(__file__).parent))
from unseen import AFFECTED, HARMLESS  # noqa: E402

T = X.Tagger()


def kinds(text):
    score, per = A.score_text(text, T)
    return {k for k, v in per.items() if v >= A.THRESHOLD}


@pytest.mark.parametrize(
    "text, kind",
    [
        ("You are a worthless idiot.", "abusive"), ("What a pathetic moron you are!", "abusive"), ("K. Miller is a filthy bastard.", "abusive"),
        ("We know where you live and we will cut you.", "abusive"), ("I will break your neck.", "abusive"), ("Du bist ein verdammter Idiot.", "abusive"),
        ("Ich bringe dich um, ich schlag dir die Zähne aus.", "abusive"), ("Tu es un pauvre con.", "abusive"), ("He's an idiot and a liar.", "abusive"), ("Je vais te casser les dents.", "abusive"), ("Fuck off and die.", "abusive"), ("Te voy a matar, imbécil.", "abusive"),
        ("Immigrants are vermin.", "hateful"), ("Women are stupid and belong in the kitchen.", "hateful"), ("All foreigners should be shot.", "hateful"),
        ("Ausländer raus, das sind alles Ratten.", "hateful"), ("Les femmes sont des animaux, brûlez les.", "hateful"), ("Los gitanos son basura.", "hateful"),
        ("Free porn videos.", "sexual"), ("Hot naked girls on cam tonight.", "sexual"), ("Nackte geile Frauen live.", "sexual"), ("He moaned as she stripped naked.", "sexual"),
    ],
)
def test_own_voice(text, kind):
    assert kind in kinds(text)


@pytest.mark.parametrize(
    "text",
    [
        "You are not an idiot.", "The report condemns calling immigrants vermin.", "She wrote: “you are a worthless idiot” and left.", "Rats and other vermin were found.",
        "The museum shows nude paintings.", "The clinic offers breast screening and sexual health advice.", "He killed the engine.", "Refugees were housed in the hall.",
        "An idiot-proof valve.", "The naked eye can see it.", "The play is about a bastard son of the king.", "Pigs were sold at the market.", "Stupid mistakes happen.",
        "I will cut you a slice of cake.", "We will kick you out of the chat if you spam.", "I will kill you two birds with one stone.", "He is a dog lover.",
        "You should burn more calories.", "I hope you burn fewer candles this year.", "You dirty dog owners should clean up.", "I want to hunt with you.",
        "I will cut the bread.", "Women and children first.", "", "Kill the process and burn the disc.",
    ],
)
def test_technical_reported_or_harmless(text):
    assert not kinds(text)


def test_spelling_tricks():
    for word in ("idiot", "1d10t", "id!ot", "i d i o t", "i.d.i.o.t", "idiooot", "iddiot", "IDIOT", "idi*t", "ıdiot", "idio​t", "іdіot", "i&#8203;diot"):
        assert "abusive" in kinds(f"You are a complete {word}, go away."), word
    for word in ("vermin", "vermmin", "vemrin", "v3rmin", "ver-min", "v*rmin"):
        assert "hateful" in kinds(f"Immigrants are {word}."), word
    bad = "Eres un imbécil de mierda."
    assert "abusive" in kinds(bad) and "abusive" in kinds(bad.encode().decode("cp1252"))


def test_sentences_do_not_mix():
    assert not kinds("You should read this. The word idiot is Greek.")
    assert kinds("line one\nYou idiot\nline three")


@pytest.mark.parametrize(
    "text, kind",
    [
        ("You are pathetic and useless.", "abusive"), ("No immigrants near our schools.", "hateful"),
        ("Get out of here, you.", "abusive"), ("Sexy girls live webcams tonight.", "sexual"),
    ],
)
def test_sentences_without_a_strong_word(text, kind):
    assert kind in kinds(text)


def test_prefilter_rejects_nothing_the_grammar_accepts():
    rng = random.Random(5)
    words = [w for w in X.LEXICON if w.isalpha()] + [" ".join(p) for p in X.PHRASES] + ["k.", "miller", "house", "runs"]
    for _ in range(20_000):
        pairs = [T[t] for t in " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))).split()]
        present = 0
        for _, tag in pairs:
            present |= tag
        if A.score_sentence([w for w, _ in pairs], [t for _, t in pairs]):
            assert A.worth_scoring(pairs, present), pairs


def test_sentences_nobody_fitted_it_to():
    affected, harmless = sum(bool(kinds(t)) for t in AFFECTED), sum(bool(kinds(t)) for t in HARMLESS)
    assert affected >= 0.6 * len(AFFECTED) and harmless <= 0.06 * len(HARMLESS)


def test_weights_of_different_clauses_add_up():
    call, more = A.score_text("This stupid trash.", T)[0], A.score_text("This stupid trash, shut your mouth.", T)[0]
    assert 0 < call < A.THRESHOLD <= more


def test_ratings_by_hand(spark, small):
    rows = spark.read.parquet(f"{small}/label_texts.parquet").collect()
    right = sum(bool(kinds(r["text"])) == (r["label"] != "none") for r in rows)
    assert right / len(rows) > 0.96  # a few ratings are wrong


def test_documents_with_nulls_and_long_texts(spark):
    long = "The gate was closed. " * 100_000 + "You are a worthless idiot."
    rows = [(1, "You idiot!", "a", "x"), (2, None, "a", "x"), (3, "", None, "x"), (None, "fine", "b", "x"), (4, long, "b", "x"), (1, "You idiot!", "a", "x"), (5, "!!! ... *** “”", "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score string")
    out = A.score_documents(df, "doc_id", "text", "source")
    got = out.collect()
    assert len(got) == 7 and sorted(r["doc_id"] for r in got if r["marked"]) == [1, 1, 4] and all(r["score"] == 0 for r in got if not r["marked"])
    assert {(r["source"], r["n_docs"], r["n_marked"], r["rate"]) for r in A.rates(out).collect()} == {("a", 3, 2, 0.666667), (None, 1, 0, 0.0), ("b", 3, 1, 0.333333)}
    assert A.score_documents(df.where("false"), "doc_id", "text", "source").count() == 0


def test_automaton_against_search_over_all_places():
    rng = random.Random(5)

    def plain(pattern, tags, k=0, last=None):
        if k == len(pattern.slots):
            return True
        s = pattern.slots[k]
        lo, hi = (0, len(tags)) if last is None else (last + 1, min(len(tags), last + 2 + s.gap))
        fits = lambda t: t & s.any_of and not t & s.none_of and t & s.all_of == s.all_of
        return any(fits(tags[i]) and not any(t & s.bar for t in tags[lo:i] if k) and plain(pattern, tags, k + 1, i) for i in range(lo, hi))

    for _ in range(3000):
        p = A.Pattern("x", "y", 1.0, tuple(A.Slot(rng.choice([1, 2, 3, 4]), rng.randrange(4), rng.choice([0, 0, 4]), rng.choice([0, 0, 1, 2]), rng.choice([0, 0, 1])) for _ in range(rng.randrange(1, 4))))
        tags = [rng.choice([0, 0, 1, 2, 4, 5]) for _ in range(rng.randrange(0, 14))]
        assert A.matches(p, tags) == bool(plain(p, tags))

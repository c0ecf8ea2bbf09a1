import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from thalweg.llm import leakage as L


def edit_to_substring(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(0, 4), max_size=30))
@settings(max_examples=200, deadline=None)
def test_myers_against_dynamic_programming(pattern, text):
    text = text or [0]
    got, _ = L.myers_batch(np.array([pattern]), np.array([len(pattern)]), np.array([text]))
    assert got[0] == edit_to_substring(pattern, [x if x else -1 for x in text])


def test_myers_rows_are_independent():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 17, 60)
    patterns, texts = rng.integers(1, 6, (60, 16)), rng.integers(0, 6, (60, 25))
    got, _ = L.myers_batch(patterns, sizes, texts)
    want = [edit_to_substring(p[:s].tolist(), [x if x else -1 for x in t]) for p, s, t in zip(patterns, sizes, texts)]
    assert got.tolist() == want


WORDS = [f"{a}{b}" for a in ("ka", "mo", "ti", "ru", "se", "la") for b in ("ren", "dis", "pol", "vam", "gut", "hek", "zor", "bim")]


def passage(rng, n=70):
    return [rng.choice(WORDS) for _ in range(n)]


def mutate(rng, words, rate):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < rate / 3 else [w, "extra"] if x < 2 * rate / 3 else ["other"] if x < rate else [w]
    return out


def found(ps, text, least=0.5):
    return {k for _, p, _ in L.search(ps, [text], least) for k in ps.keys[p]}


def test_whole_changed_cut_and_scattered_passages():
    rng = random.Random(7)
    items = [(i, " ".join(passage(rng))) for i in range(40)]
    ps = L.Passages(items)
    noise = lambda n: " ".join(passage(rng, n))
    for i, text in items:
        w = text.split()
        for t in (
            text, f"{noise(200)} {text} {noise(90)}", text.upper().replace(" ", " - ", 9), text.replace(" ", "\n"), "<p>" + text.replace(" ", "</b> <b>") + "</p>",
            " ".join(mutate(rng, w, 0.1)), " ".join(w[:44]), " ".join(w[30:]), f"{' '.join(w[:25])} {noise(50)} {' '.join(w[25:50])} {noise(9)}",
        ):
            assert i in found(ps, t)
        assert i not in found(ps, " ".join(w[:20])) and i not in found(ps, noise(70) + " ".join(w[10:25]))
        assert not found(ps, noise(400))
        assert i not in found(ps, " ".join(w[60:] + w[40:60] + w[20:40] + w[:20]), 0.9)  # not in its order


def test_damaged_characters():
    a = "Þe mølle wärden ófn the bridge wrote thät nine ships had come tö harbour since the spring and none would leave before the feast of the old king began again there"
    ps = L.Passages([(1, a)])
    for t in (a.encode().decode("latin-1"), a.encode().decode("cp1252", "replace"), "".join(c if c.isascii() else "�" for c in a), a.replace(" ", "�", 5), a.replace("ä", "&auml;"), a.replace("a", "á", 3)):
        assert found(ps, t) == {1}


def test_tables_with_nulls_repeats_and_clashing_names(spark):
    rng = random.Random(8)
    p = [" ".join(passage(rng)) for _ in range(4)]
    items = [(1, p[0], "x"), (2, p[0].upper(), "x"), (3, p[1], "x"), (3, p[1], "x"), (None, p[2], "x"), (4, None, "x"), (5, "", "x"), (6, "too short", "x"), (7, "--", "x")]
    docs = [(10, p[0], 1), (10, p[0], 1), (11, None, 1), (12, "", 1), (None, p[1], 1), (13, p[2], 1), (14, "word " * 300_000 + p[1], 1), (15, p[1] + " " + p[0], 1), (16, "it is TOO, short!", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items, "item_id long, passage string, doc_id string")
    for block in (2, 1000):
        out = L.find_leaks(d, "doc_id", "text", i, "item_id", "passage", items_per_block=block)
        assert sorted((r["doc_id"], r["item_id"]) for r in out.collect()) == [(10, 1), (10, 2), (14, 3), (15, 1), (15, 2), (15, 3), (16, 6)]
    assert L.find_leaks(d.where("false"), "doc_id", "text", i, "item_id", "passage").count() == 0
    assert L.find_leaks(d, "doc_id", "text", i.where("false"), "item_id", "passage").count() == 0


def test_passages_of_all_scripts_and_short_ones():
    items = {
        1: "Сторож северной башни открыл старые ворота до рассвета, и двенадцать лодок с мукой ушли вверх по реке к дальнему монастырю без единого слова.",
        2: "北塔的守卫在黎明前打开了旧城门十二条装满面粉的船沿河而上驶向远方的修道院没有人说一句话",
        3: "فتح حارس البرج الشمالي البوابة القديمة قبل الفجر ومضت اثنتا عشرة سفينة محملة بالدقيق صعودا في النهر إلى الدير البعيد",
        4: "nine ships left harbour early", 5: "Девять кораблей вышли", 6: "九艘船", 7: "harbourmaster",
    }
    ps = L.Passages(list(items.items()))
    for i, t in items.items():
        assert found(ps, f"Some words before — вЂ” {t} and some after.") == {i} and found(ps, t.upper()) == {i}
    w = items[1].split()
    assert found(ps, " ".join([*w[:5], "вдруг", *w[5:14]])) == {1} and not found(ps, " ".join(w[:6]))
    assert found(ps, "说" + items[2][:20] + "了" + items[2][20:26]) == {2}
    assert not found(ps, "nine ships left the harbour early") and not found(ps, "harbourmasters") and not found(ps, "Девять кораблей не вышли")
    assert L.words_of("mГёlle вЂ” bridge", {"mlle", "bridge"}) == ["mlle", "bridge"]  # wrongly decoded signs are no words


def test_runs_that_no_block_holds_as_a_whole_count():
    rng = random.Random(11)
    items = [(i, " ".join(passage(rng, 48))) for i in range(20)]
    ps = L.Passages(items)
    noise = lambda n: " ".join(passage(rng, n))
    for i, text in items:
        w = text.split()
        assert i in found(ps, f"{noise(60)} {' '.join(w[4:28])} {noise(60)}")  # twelve words of each of two blocks
        assert i in found(ps, f"{' '.join(w[4:16])} {noise(30)} {' '.join(w[20:32])} {noise(30)}")
        assert i not in found(ps, f"{' '.join(w[4:10])} {noise(30)} {' '.join(w[20:26])} {noise(30)} {' '.join(w[36:42])}")


def test_documents_with_many_hits_are_searched_in_halves(monkeypatch):
    rng = random.Random(12)
    items = [(i, " ".join(passage(rng))) for i in range(6)]
    ps, texts = L.Passages(items), [t for _, t in items] + [None, "", items[0][1] + " " + items[5][1]]
    want = sorted(L.search(ps, texts))
    monkeypatch.setattr(L, "MOST_HITS", 3)
    assert sorted(L.search(ps, texts)) == want and len(want) == 8


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev, row = row, [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[-1]))
    return row[-1]


def test_pairs_found_in_the_test_data_hold_half_of_the_words_in_order(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/eval_items.parquet")
    out = L.find_leaks(docs, "doc_id", "text", items, "item_id", "passage").collect()
    text = {r["doc_id"]: L.words_of(r["text"]) for r in docs.collect()}
    want = {r["item_id"]: L.words_of(r["passage"]) for r in items.collect()}
    assert all(lcs(want[r["item_id"]], text[r["doc_id"]]) >= 0.5 * len(want[r["item_id"]]) for r in out)
    exact = {(d, i) for d, t in text.items() for i, w in want.items() if f" {' '.join(w)} " in f" {' '.join(t)} "}
    assert exact <= {(r["doc_id"], r["item_id"]) for r in out}

"""Operators that read one text at a time, against plain versions of what they compute."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from busloom.llm import bpe, decontaminate, forest, html_text, pii, stats, tagger

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_TEXTS = ["", " ", "\n\n", "a", "a b", "a b c", "\x0b\x0c", "é é é", "x " * 500, "one two three " * 3, "🙂 " * 40, "a\nb\na\n \n", "\ud800 lone"]


def plain_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_counts_of_odd_texts(text):
    assert stats.counts(text)[:5] == plain_counts(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#é| ", max_size=80))
def test_counts(text):
    assert stats.counts(text)[:5] == plain_counts(text)


def test_forest_sets_the_odd_apart():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 4)), rng.normal(9, 1, (5, 4))])
    s = forest.grow(x).score(x)
    assert s[500:].min() > np.percentile(s[:500], 99)
    assert np.isfinite(forest.grow(np.zeros((3, 2))).score(np.zeros((3, 2)))).all()


@pytest.fixture(scope="module")
def codecs():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.codec(path), Tokenizer.from_file(path)


def test_tokens_of_random_texts(codecs):
    own, library = codecs
    rnd = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz ABCÀÉéßΣσςİıŁ'’!?.,<|>/w1٣½²漢字かな🙂👍🏽힣\u0085​\n\t_-—ﬁ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["<|startoftext|>a<|endoftext|><|endoftext|>", "<|STARTOFTEXT|>", "</w>", "it's WE'LL 'Tis", "z" * 5000, "!" * 3000, "", "   ", " end", "the of and " * 2000]
    for t, ids in zip(texts, own.encode(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == want, t[:60]
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_failing_words_and_full_tables(codecs, monkeypatch):
    own, library = codecs
    monkeypatch.setattr(bpe, "PAIRS", 50)
    monkeypatch.setattr(bpe, "WORDS", 20)
    rnd = random.Random(8)
    for _ in range(40):
        t = " ".join("".join(rnd.choice("thienarso") for _ in range(rnd.randint(1, 14))) for _ in range(30))
        assert own.encode([t])[0] == library.encode(t, add_special_tokens=False).ids


def plain_base(text):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            odd = sum(int(c) for c in d[-1::-2]) + sum(int(c) * 2 - 9 * (int(c) > 4) for c in d[-2::-2])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(d) <= 19 and odd % 10 == 0 or k == 3 and 10 <= len(d) <= 15:
                out.append((*m.span(), k))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1234.@+-() %\n05é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_spans_of_known_and_long_texts():
    card = "4111 1111-1111 1111"
    text = f"x{card} y a@b.c.d@e.f +1 (234) 567-8901. 1.2.3.4.5.6.7.8 256.1.1.1 "
    assert pii.base_spans(text) == plain_base(text)
    for long in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "@" * 100_000, "+1" * 50_000, "1." * 50_000):
        pii.base_spans(long)


def test_tagger_gradients_and_reading():
    rng = np.random.default_rng(1)
    m = tagger.start(3, 5, rng)
    x, y = rng.integers(0, tagger.SYMBOLS, (2, 7)), rng.integers(0, 5, (2, 7))
    _, g = tagger.gradients(m, x, y)
    for name in m.names():
        a = getattr(m, name)
        i = np.unravel_index(np.abs(g[name]).argmax(), a.shape)
        a[i] += 1e-5
        up, _ = tagger.gradients(m, x, y)
        a[i] -= 2e-5
        down, _ = tagger.gradients(m, x, y)
        a[i] += 1e-5
        assert abs((up - down) / 2e-5 - g[name][i]) < 1e-4
    # the best path, against all paths
    from itertools import product

    e = rng.normal(0, 1, (4, 5))
    worth = lambda p: m.first[p[0]] + sum(e[k, t] for k, t in enumerate(p)) + sum(m.step[a, b] for a, b in zip(p, p[1:]))
    assert tuple(tagger.best_path(m, e)) == max(product(range(5), repeat=4), key=worth)


def test_tagger_finds_what_patterns_miss():
    rnd = random.Random(3)

    def card():
        d = [rnd.randrange(10) for _ in range(15)]
        return next(s for c in range(10) if pii.luhn(s := "".join(map(str, d)) + str(c)))

    words = lambda n: " ".join("".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    kinds = [card, lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)), lambda: f"{words(1)}@mail{rnd.randrange(9)}.example.com", lambda: f"+1 ({rnd.randrange(100, 999)}) 555-{rnd.randrange(1000, 9999)}"]
    texts = [f"{words(8)} {rnd.choice(kinds)()} {words(8)}" for _ in range(500)]
    windows = [w for t in texts for w in pii.labelled_windows(t)]
    windows += pii.recombined(windows, 500, np.random.default_rng(0))
    model = tagger.train(*pii.rows_of(windows), tags=9, steps=150)
    hits = 0
    for _ in range(20):
        a, b = card(), card()
        text = f"{words(5)} {a} {b} {words(5)}"  # one run of 32 digits to the pattern
        own, all_ = pii.find(model, [text])[0]
        assert own == plain_base(text)
        hits += [text[x:y] for x, y, _ in all_] == [a, b]
    assert hits >= 16
    clean = [words(60) for _ in range(20)] + ["", "12 of 30", "room 101."]
    assert all(not all_ for _, all_ in pii.find(model, clean))
    assert pii.find(None, ["a@b.c"])[0][1] == [(0, 5, 0)]
    assert pii.masked("x a@b.c y 1.2.3.4", [(2, 7, 0), (10, 17, 1)]) == "x <email> y <ip>"


def test_windows_agree_on_a_long_stretch():
    rng = np.random.default_rng(2)
    m = tagger.start(4, 9, rng)
    text = "1 2@" * 100
    assert pii.tagged(m, [text, "", text])[0] == pii.tagged(m, [text])[0]


ITEM = "The quick brown fox, it is said, jumps over the lazy dog while nobody in the whole village looks; then it sleeps until the evening bells ring twice."


def test_passages():
    ix = decontaminate.index([(7, ITEM), (8, "short"), (9, ""), (10, None), (11, ITEM)])
    assert ix.ids == [7, 11]
    around = "Nothing of note was written here before. {} And after that came other things entirely."
    for found in (ITEM, ITEM.upper(), ITEM.replace(" ", "\n--"), ITEM.replace("fox", "fax").replace("lazy", "lzy")):
        text = around.format(found)
        got = decontaminate.regions(ix, text)
        assert [ix.ids[r[0]] for r in got] == [7, 11]
        assert got[0][1] >= 38 and got[0][2] <= len(text) - 40
    half = " ".join(ITEM.split()[:18])
    assert decontaminate.regions(ix, around.format(half))  # over REGION characters of it
    assert not decontaminate.regions(ix, around.format(" ".join(ITEM.split()[:8])))
    assert len(decontaminate.regions(ix, around.format(ITEM) + "pad " * 50 + ITEM)) == 4
    for odd in ODD_TEXTS:
        assert decontaminate.regions(ix, odd) == []


def plain_align(item, text):
    """Best score of any local alignment."""
    best, row = 0, [0] * (len(text) + 1)
    for a in item:
        new = [0]
        for j, b in enumerate(text):
            new.append(max(0, row[j] + (1 if a == b else -decontaminate.COST), row[j + 1] - decontaminate.COST, new[j] - decontaminate.COST))
        best, row = max(best, *new), new
    return best


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=40), st.data())
def test_banded_alignment(s, data):
    t = data.draw(st.text(alphabet="abc", max_size=6)) + s + data.draw(st.text(alphabet="abc", max_size=6))
    item, text = decontaminate.plain(s)[0], decontaminate.plain(t)[0]
    a, b, c, d, edits = decontaminate.align(item, text, -len(item), len(item) + len(text) + 1)
    matched = plain_align(item.tolist(), text.tolist())
    assert matched == len(item) and (b - a, d - c, edits) == (len(item), len(item), 0)


def test_lemma_loses_no_region():
    rnd = random.Random(6)
    found = 0
    ix = decontaminate.index([(1, ITEM)])
    for _ in range(100):
        s = list(decontaminate.plain(ITEM)[0])
        for _ in range(int(len(s) * decontaminate.RATE) - 2):
            p = rnd.randrange(5, len(s) - 5)
            s[p] = ord(rnd.choice("qxz"))
        text = "unrelated words go first " + "".join(map(chr, s)) + " unrelated words go last"
        found += bool(decontaminate.regions(ix, text))
    assert found == 100


def plain_within_budget(item, text):
    """Whether any stretch of the item that counts is in the text within its edits, by all stretches."""
    least = min(decontaminate.REGION, len(item))
    for a in range(len(item) - least + 1):
        row = np.zeros(len(text) + 1, np.int64)
        at = np.arange(len(text) + 1)
        for b in range(a, len(item)):
            best = np.minimum(row + 1, np.append(b - a + 1, row[:-1] + (text != item[b])))
            row = np.minimum.accumulate(best - at) + at
            if b + 1 - a >= least and row.min() <= int((b + 1 - a) * decontaminate.RATE):
                return True
    return False


def edited(s, places, rnd):
    for p in sorted(places, reverse=True):
        s = s[:p] + rnd.choice(["#", "", "#" + s[p : p + 1]]).replace("#", rnd.choice("qxz")) + s[p + 1 :]
    return s


def test_edits_up_to_the_budget_anywhere():
    rnd = random.Random(9)
    letters = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    held = lambda item, text: bool(decontaminate.regions(decontaminate.index([(1, item)]), f"klmno {text} onmlk"))
    item = letters(85)
    assert held(item, item[:6] + "x" + item[7:])
    for n in (20, 23, 24, 30, 59, 80, 85):
        item, budget = letters(n), int(min(n, 80) * decontaminate.RATE)
        for p in range(n):  # one edit at each place, and all of them in a row
            assert held(item, edited(item, [p], rnd))
            p = min(p, n - budget)
            assert held(item, item[:p] + "x" * budget + item[p + budget :])
        assert held(item, edited(item, range(budget), rnd)) and held(item, edited(item, range(n - budget, n), rnd))
    # a good stretch amid edits that are too many, but few enough for the best alignment to bridge them
    item = letters(300)
    text = edited(item, [*range(6, 100, 12), *range(200, 300, 12)], rnd)
    assert held(item, text)
    assert not held(item, edited(item, range(6, 300, 12), rnd))


def test_budget_against_all_stretches():
    rnd, seen = random.Random(10), Counter()
    for _ in range(150):
        n = rnd.choice([20, 40, 79, 80, 84, 100, 130])
        item = "".join(rnd.choice("abcd") for _ in range(n))
        places = rnd.sample(range(n), min(n, rnd.randint(0, int(n * 0.09) + 1)))
        if rnd.random() < 0.5:  # clustered
            places = sorted({min(n - 1, p // 3) for p in places})
        text = edited(item, places, rnd)
        ix = decontaminate.index([(1, item)])
        got = decontaminate.regions(ix, text)
        want = plain_within_budget(ix.forms[0], decontaminate.plain(text)[0])
        assert bool(got) == want, (item, text)
        for _, _, _, a, b, edits in got:
            assert b - a >= min(n, 80) and edits <= int((b - a) * decontaminate.RATE)
        seen[want] += 1
    assert min(seen.values()) > 20


PAGES = [
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One\n two<br>three</p><p>x</p></article><footer>f</footer></body></html>", "T & U\nOne two three\nx"),
    ("<article><p>only &lt;b&gt; <i>this</i></p><div class='ad'>Buy</div><p>and this", "only <b> this\nand this"),
    ("<body><div id=cookie-notice>We set cookies.</div><div class=content><h1>Head</h1><p>" + "Long enough to surge above the threshold, surely it is. " * 2 + "</p><ul><li>a<li>b</ul></div><div class=sidebar><p>" + "Other text that is long as well. " * 9 + "</p></div><section class=comments><p>" + "I say. " * 40 + "</p></section></body>", "Head\n" + ("Long enough to surge above the threshold, surely it is. " * 2).strip() + "\na\nb"),
    ("", ""), ("<p></p>", ""), ("plain", "plain"), ("<script>x</script><style>y</style>", ""), ("<article><p>a < b</p>", "a < b"),
    ("<nav>left open<article><p>Text &copy; 2024</p></article>", "Text © 2024"), ("<article><p>cut<a hr", "cut"),
    ("<ARTICLE><P>Upper</P><ASIDE>no</ASIDE><P hidden>no</P></ARTICLE>", "Upper"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


A, B, C = ("A long first part. " * 11).strip(), ("The second part. " * 9).strip(), ("Third part here. " * 6).strip()
DIVIDED = [
    (f"<div><div><p>{A}</p></div><div class=ad>x</div><div><p>{B}</p></div></div>", [A, B]),
    (f"<body><div><section><p>{B}</p></section><form>x</form><section><p>{A}</p></section><aside>y</aside><section><p>{C}</p><p>End.</p></section></div></body>", [B, A, C, "End."]),
    (f"<div><p>{A}</p><p><a href=x>a paragraph that is a link</a></p><p>&copy; is a sign of law.</p><p>\u00ae too</p><p>{B}</p></div>", [A, "a paragraph that is a link", "© is a sign of law.", "® too", B]),
    (f"<div><p>{A}</p><p><a href=x>one</a></p><p><a href=x>two</a></p><p><a href=x>three</a></p><p>{B}</p></div>", [A, "one", "two", "three", B]),
    (f"<div>Top</div><div><h2>Head</h2><div class=ad>x</div><div><p>{A}</p></div><div><p>{B}</p></div><div class=ad>x</div><div><p>Short end.</p></div></div><div class=related>{C}</div>", ["Head", A, B, "Short end."]),
    (f"<div><a href=x>Home</a></div><div><a href=x>News</a></div><div><p>{A}</p></div><div><p>{B}</p></div><div><a href=x>Home</a></div>", [A, B]),
    (f"<nav>{C}</nav><div><p>{A}</p><div class=ad>x</div><p>{B}</p></div><footer>{C}</footer>", [A, B]),
]


@pytest.mark.parametrize("page,parts", DIVIDED)
def test_divided_main_text(page, parts):
    assert html_text.main_text(page) == "\n".join(parts)


def test_containers_of_any_number():
    assert html_text.main_text("".join(f"<div><p>{i} {A}</p></div>" for i in range(5000))).count("\n") == 4999
    assert html_text.main_text("".join(f"<div><p>{A}</p>" for i in range(2000))).count("\n") == 1999
    assert html_text.main_text("".join(f"<div><p>{A}</p><div class=ad>x</div>" for i in range(2000))).count("\n") == 1999


def test_pages_of_any_size():
    body = "".join(f"<p>Paragraph {i} has some text in it.</p>" for i in range(20_000))
    assert html_text.main_text(f"<article>{body}</article>").count("\n") == 19_999
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"


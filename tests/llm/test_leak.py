import itertools
import random

import pytest

from pepspark.llm import leak as L

RNG = random.Random(5)
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "so", "ti", "vu") for c in ("x", "ne", "dol", "6")]


def words(n, rng=RNG):
    return [rng.choice(WORDS) for _ in range(n)]


ITEMS = {i: " ".join(words(60)) + "." for i in range(1, 9)}
FILLER = lambda n: " ".join(f"filler{RNG.randint(0, 9999)}" for _ in range(n))


def part(i, a, n):
    return ITEMS[i].split()[a : a + n]


def changed(w, at):
    w = list(w)
    for k in at:
        w[k] = "changed"
    return w


def cases():
    long = part(3, 10, 30)
    return [
        ("whole", f"{FILLER(20)} {ITEMS[1]} {FILLER(5)}", [1]),
        ("18 words", f"{FILLER(20)} {' '.join(part(2, 7, 18))} {FILLER(5)}", [2]),
        ("capitals", " ".join(part(2, 0, 25)).upper(), [2]),
        ("punctuation", ", ".join(part(2, 0, 25)), [2]),
        ("full width", "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in " ".join(part(4, 5, 20))), [4]),
        ("markup", "<p class='q'>" + " ".join(f"<b>{w}</b>" if k % 3 else f"{w}&nbsp;" for k, w in enumerate(part(5, 0, 22))) + "</p>", [5]),
        ("escaped", "\\n".join(" ".join(part(5, k, 4)) for k in range(0, 24, 4)), [5]),
        ("soft hyphens", " ".join(w[:2] + "­" + w[2:] for w in part(6, 3, 20)), [6]),
        ("changed words", " ".join(changed(long, [6, 20])), [3]),
        ("dropped words", " ".join(w for k, w in enumerate(long) if k not in (7, 19)), [3]),
        ("added words", " ".join(long[:9] + ["added"] + long[9:22] + ["also"] + long[22:]), [3]),
        ("halves apart", " ".join(part(7, 0, 12)) + " " + FILLER(60) + " " + " ".join(part(7, 12, 12)), [7]),
        ("two items", " ".join(part(1, 0, 20)) + " " + FILLER(10) + " " + " ".join(part(8, 30, 20)), [1, 8]),
        ("six words", f"{FILLER(20)} {' '.join(part(1, 5, 6))} {FILLER(30)}", []),
        ("same pattern", " ".join(w if k % 3 else f"other{k}" for k, w in enumerate(part(1, 0, 40))), []),
        ("nothing", FILLER(100), []),
        ("empty", "", []),
        ("null", None, []),
        ("long", FILLER(20000) + " " + " ".join(part(1, 0, 30)), [1]),
    ]


def test_found():
    ix = L.ItemIndex()
    for i, t in ITEMS.items():
        ix.add(i, t)
    for name, text, want in cases():
        assert sorted(ix.found(text)) == want, name


def test_segments_of_long_texts(monkeypatch):
    ix = L.ItemIndex()
    for i, t in ITEMS.items():
        ix.add(i, t)
    monkeypatch.setattr(L, "SEGMENT_CHARS", 900)
    monkeypatch.setattr(L, "BATCH_WORDS", 50)
    for name, text, want in cases():
        if name != "markup":
            assert sorted(ix.found(text)) == want, name
    assert ix.found("x" * 5000) == []


def test_documents(spark):
    rows = [(k, t, 7) for k, (_, t, _) in enumerate(cases())]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([*ITEMS.items(), (1, ITEMS[1]), (50, None), (51, "")], "item_id bigint, text string")
    want = sorted((k, i) for k, (_, _, found) in enumerate(cases()) for i in found)
    for block in (L.BLOCK_WORDS, 100):
        got = [tuple(r) for r in L.leaked_items(docs, items, block_words=block).collect()]
        assert sorted(got) == want
    assert L.leaked_items(docs.limit(0), items).count() == 0
    assert L.leaked_items(docs, items.limit(0)).count() == 0


def test_short_item():
    ix = L.ItemIndex()
    ix.add(1, "just two")
    ix.add(2, "a somewhat longer item of eight words here")
    assert ix.found("we have just two of them") == [1] and ix.found("just one") == []
    assert ix.found("see a somewhat longer item of eight words here") == [2]


def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(30))
def test_myers(seed):
    rng = random.Random(seed)
    p, t = [rng.choice("abcd") for _ in range(rng.randint(1, 70))], [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
    assert L.myers_distance(p, t) == brute_distance(p, t)


@pytest.mark.parametrize("n,edits", [(18, 2), (19, 2), (20, 2), (16, 1)])
def test_every_placement_of_changed_words(n, edits):
    """Passages of n words, or items of no more than n, with words changed anywhere, at both ends of a text and inside it."""
    ix = L.ItemIndex()
    for i, t in ITEMS.items():
        ix.add(i, t if n >= 18 else " ".join(t.split()[:n]))
    for at in itertools.combinations(range(n), edits):
        passage = " ".join(changed(part(2, 7 if n >= 18 else 0, n), at))
        for text in (passage, f"{FILLER(9)} {passage} {FILLER(9)}"):
            assert ix.found(text) == [2], at
    assert ix.found(" ".join(changed(part(2, 7 if n >= 18 else 0, n), range(4, n, 3)))) == []


@pytest.mark.parametrize("edits", [1, 2])
def test_halves_apart_with_changed_words(monkeypatch, edits):
    ix = L.ItemIndex()
    for i, t in ITEMS.items():
        ix.add(i, t)
    gap = FILLER(60)
    apart = lambda w: f"{FILLER(5)} {' '.join(w[:9])} {gap} {' '.join(w[9:])} {FILLER(5)}"
    texts = [apart(changed(part(7, 5, 18), at)) for at in itertools.combinations(range(18), edits)]
    assert all(ix.found(t) == [7] for t in texts)
    assert ix.found(apart(changed(part(7, 5, 18), (2, 5, 12, 15)))) == []
    assert ix.found(f"{' '.join(part(7, 5, 9))} {gap}") == []
    monkeypatch.setattr(L, "SEGMENT_CHARS", 60)
    assert all(ix.found(t) == [7] for t in texts)


def edited(w, edits, rng):
    """Words changed, added or dropped at random places."""
    w = list(w)
    for k in sorted(rng.sample(range(len(w)), edits), reverse=True):
        kind = rng.choice("cad")
        w[k : k + 1] = {"c": ["changed"], "a": [w[k], "added"], "d": []}[kind]
    return w


def recall(n, edits, cut=None, tries=200, seed=1):
    rng = random.Random(seed)
    ix = L.ItemIndex()
    ix.add(2, ITEMS[2])
    texts = []
    for _ in range(tries):
        a = rng.randint(0, 60 - n)
        p = part(2, a, n)
        if cut is None:
            body = " ".join(edited(p, edits, rng))
        else:
            first = rng.randint(0, edits)
            x, y = edited(p[:cut], min(first, cut), rng), edited(p[cut:], edits - min(first, cut), rng)
            body = f"{' '.join(x)} {FILLER(30)} {' '.join(y)}"
        texts.append(f"{FILLER(8)} {body} {FILLER(8)}")
    return len(ix.search(texts)) / tries


@pytest.mark.parametrize("n,edits,cut,least", [(18, 0, None, 1), (18, 1, None, 1), (18, 2, None, 1), (24, 2, None, 1), (24, 3, None, 0.85), (36, 4, None, 0.9), (18, 0, 9, 1), (18, 1, 9, 1), (18, 2, 9, 1), (18, 0, 6, 1), (18, 2, 12, 1), (24, 2, 12, 1)])
def test_recall_of_edits(n, edits, cut, least):
    assert recall(n, edits, cut) >= least


def test_shorter_quotations_are_no_passages():
    ix = L.ItemIndex()
    for i, t in ITEMS.items():
        ix.add(i, t)
    # 16 and 17 words can't be told from a passage whose end words were changed
    assert [ix.found(f"{FILLER(9)} {' '.join(part(2, 5, n))} {FILLER(9)}") for n in (6, 12, 14, 15, 16, 18)] == [[], [], [], [], [2], [2]]


def test_short_items_of_every_length():
    ix = L.ItemIndex()
    for n in range(1, 8):
        ix.add(n, " ".join(f"w{n}x{k}" for k in range(n)))
    for n in range(1, 8):
        assert ix.found(f"some w{n}x0 text {' '.join(f'w{n}x{k}' for k in range(n))} end") == [n]
    assert ix.found("w7x0 w7x1 w7x2 w7x3 w7x4 w7x6") == []


def test_long_tags_are_dropped():
    ix = L.ItemIndex()
    ix.add(1, ITEMS[1])
    link = f"<a href='{'x' * 5000}'>"
    assert ix.found(" ".join(link + w + "</a>" for w in part(1, 3, 20))) == [1]

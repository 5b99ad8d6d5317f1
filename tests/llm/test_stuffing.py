import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm import stuffing
from shelfspark.llm.stuffing import covered, measures, repeats, spam_pages

PROSE = "The archivist of {0} found the {1} near the old bridge, although nobody had asked for it. We then moved it to {2} because the disk was full. "
NAMES = [a + b for a in ("Tor", "Bel", "Ka", "Zan", "Mor") for b in ("ville", "ford", "wick", "by", "mond", "gate")]
THINGS = ["lamp", "reel", "folder", "camera", "note", "drive", "caption", "sketch", "tripod", "screen"]


def prose(rng, n):
    return "".join(PROSE.format(rng.choice(NAMES), rng.choice(THINGS), rng.choice(NAMES)) for _ in range(n))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30))
def test_longest_repeats(tokens):
    longest = repeats(tokens)
    n = len(tokens)
    for i in range(n):
        ends = [k for k in range(1, i + 2) if sum(tokens[j : j + k] == tokens[i - k + 1 : i + 1] for j in range(n - k + 1)) > 1]
        assert longest[i] == max(ends, default=0)
    marked = {j for i in range(n) if longest[i] >= 2 for j in range(i - longest[i] + 1, i + 1)}
    assert set(covered(longest, 2).nonzero()[0].tolist()) == marked


@settings(max_examples=200, deadline=None)
@given(st.text("ab滤\U0010ffff", max_size=40), st.integers(1, 18))
def test_repeats_without_the_automaton(text, least):
    codes = np.array([ord(c) for c in text], "<u4")
    assert stuffing.windows(codes, least).tolist() == covered(repeats(text), least).tolist()


def pages():
    rng = random.Random(2)
    words = ["ring light", "cable adapter", "memory card", "slide scanner"]
    extra = ["cheap", "best", "new", "discount", ""]
    combo = lambda: f"{rng.choice(extra)} {rng.choice(words)} {rng.choice(extra)}".strip()
    link = lambda: f"http://shop.{rng.choice(NAMES).lower()}-deals.test/tag/{rng.randrange(10**5)}"
    spam = {
        1: " | ".join(combo() for _ in range(60)),
        2: "\n".join("#" + combo().replace(" ", "_") for _ in range(60)),
        3: "\n".join(f'<a href="{link()}">{rng.choice([combo(), rng.choice(NAMES)])}</a>' for _ in range(40)),
        4: " ★ ".join(f"{rng.choice(NAMES)} Desk {combo()} X{rng.randrange(900)} 64GB €{rng.randrange(400)}.99" for _ in range(40)),
        5: "\n".join(f"Our ring light is the {e} ring light for ring light fans who want a ring light in {rng.choice(NAMES)}." for e in extra[:4] * 4),
        6: "。".join(rng.choice(["高清滤镜", "滤镜推荐", "便宜滤镜", "录屏软件", "免费录屏软件"]) for _ in range(50)),
        7: prose(rng, 2) + "\n" + "\n".join(combo() for _ in range(80)),
        8: "1. " + " ".join(f"{combo()} {link()}".upper() for _ in range(40)),
        9: "\n".join(f"{combo()} in {rng.choice(NAMES)}" for _ in range(60)),
        10: " ".join(f"{combo()} near {rng.choice(NAMES)}" for _ in range(60)),
    }
    fine = {
        20: prose(rng, 12),
        21: prose(rng, 10) + "\nTags: #lamp #reel #note\n" + "\n".join(f"- [{n}]({link()})" for n in NAMES[:5]),
        22: "\n".join(f"[00:{k:02}:01] {prose(rng, 1)}" for k in range(30)),
        23: "\n".join(f"{n}: {PROSE.format(n, rng.choice(THINGS), n)}" for n in NAMES),
        24: "\n".join(f"{k}.{k + 1}.0 - We fixed the {rng.choice(THINGS)} that was broken in {n}." for k, n in enumerate(NAMES)),
        25: "\n".join(f"- [{n}]({link()}): {prose(rng, 1)}" for n in NAMES[:12]),
        26: "",
        27: None,
        28: "   \n ",
        29: prose(rng, 900),
    }
    return spam, fine


def test_pages(spark):
    spam, fine = pages()
    df = spark.createDataFrame([*spam.items(), *fine.items()], "doc_id long, text string").selectExpr("*", "'x' as page_id", "1 as loose_share")
    assert {r.page_id for r in spam_pages(df, "doc_id", "text").collect()} == set(spam)
    assert spam_pages(df.limit(0), "doc_id", "text").collect() == []
    assert spam_pages(df.unionByName(df), "doc_id", "text").count() == 2 * len(spam)


@pytest.mark.parametrize("text", ["", "\n", "1", "<b>", "a" * 100_000, "ab " * 50_000, "퟿￿ \x00"])
def test_odd_texts(text):
    total, loose, stuffed, again, _ = measures(text)
    assert total >= 0 and (loose is None or 0 <= loose + stuffed <= 1 and 0 <= again <= 1)


SPANISH = [
    "El archivero encontró la cinta en un cajón, aunque nadie la había pedido en todo el año.",
    "Después de la última proyección, el técnico guardó la bombilla junto con el trípode viejo.",
    "Los estudiantes querían ver la película otra vez porque el final no les quedó claro.",
    "Nunca supimos quién había cortado la escena del puente ni por qué lo hizo de noche.",
]


def test_other_languages(spark):
    """No language is known: prose of one that nobody listed is no spam, keyword lists of it are."""
    rng = random.Random(6)
    keywords = ["trípode barato", "oferta trípode", "trípode oferta envío", "lámpara barata", "comprar lámpara"]
    rows = [(1, " ".join(SPANISH)), (2, "\n".join(SPANISH * 3)), (3, " ".join(s.rstrip(".").lower() for s in SPANISH)), (4, "\n".join(rng.choice(keywords) for _ in range(60)))]
    rows += [(5, ". ".join(rng.choice(keywords) for _ in range(60)))]
    assert {r.page_id for r in spam_pages(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()} == {4, 5}


def test_the_automaton_decides():
    """Lists without clauses are no spam unless they repeat themselves, crowded clauses are none unless they are alike."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    total, loose, stuffed, again, _ = measures("\n".join(f"{word()} {word()}" for _ in range(80)))
    assert loose == 1 and again < 0.05
    alike = " ".join(f"Our ring light is the ring light for fans of a ring light in {rng.choice(NAMES)}." for _ in range(20))
    apart = " ".join(f"{word()} {word()} lanterns {word()} {word()} lanterns {word()} {word()} lanterns {word()}." for _ in range(20))
    assert measures(alike)[2] > 0.9 and measures(apart)[2] == 0 < measures(apart)[0]
    assert measures(prose(rng, 9))[1] is None


def test_long_pages_are_read_in_stretches(monkeypatch):
    monkeypatch.setattr(stuffing, "STRETCH", 400)
    text = "\n".join(["cheap ring light", "ring light sale", "best ring light"] * 60)
    total, loose, _, again, _ = measures(text)
    assert loose == 1 and again > 0.9
    tag = f"<div class='{'x ' * 2000}'>" + prose(random.Random(1), 3) + "</div>"
    assert measures(tag)[1] is None


def test_repeats_may_stand_far_apart(monkeypatch):
    """What a page repeats does not depend on how long it is."""
    rng = random.Random(3)
    once = "\n".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(2 * stuffing.STRETCH // 10))
    assert measures(once)[3] < 0.05
    far = measures(f"{once}\n{once}")
    assert far[1] == 1 and far[3] > 0.99
    spam, fine = ([t for t in part.values() if t] for part in pages())
    by_automaton = [measures(t) for t in spam + fine]
    monkeypatch.setattr(stuffing, "STRETCH", 10)
    assert [measures(t) for t in spam + fine] == by_automaton

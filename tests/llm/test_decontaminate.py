"""Benchmark decontamination against brute force and on re-parameterised questions."""

import random
import re

import pytest

from sightline.llm import decontaminate as D
from sightline.llm.decontaminate import contaminated

SCHEMA = "doc_id long, text string, item_id string"
QUESTION = "A baker named Anna sold 12 loaves and 7 cakes; later Anna gave 12 loaves away within 3 hours to feed the poor of Dover."


def found(spark, docs, items, **options):
    rows = contaminated(
        spark.createDataFrame([(i, t, "clash") for i, t in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string"), **options
    ).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


@pytest.mark.parametrize("options", [{}, {"broadcast_windows": 0}])
def test_reparameterised_questions(spark, options):
    other = QUESTION.replace("Anna", "Bob").replace("12", "30").replace("3 hours", "5 days").replace("Dover", "Calais")
    mixed = QUESTION.replace("12", "30", 1)  # the repeated value no longer repeats
    docs = [
        (1, f"Some words before. {QUESTION} And after."), (2, f"Intro here: {other}"), (3, mixed), (4, None), (5, ""), (6, "clean text of its own"),
        (7, QUESTION.lower().replace("anna", "Anna")), (8, f"{other} {QUESTION}"), (9, QUESTION), (9, QUESTION), (None, QUESTION), (10, "short item of five words"),
        (11, "only four words match"), (12, "x" * 100_000 + " " + "y1" * 50_000 + " \n\t" + QUESTION.replace(" ", "\n")),
    ]
    got = found(spark, docs, [(100, QUESTION), (101, "Short item of five words!"), (102, "only four words match"), (103, None), (104, "")], **options)
    assert {k for k in got} >= {(1, 100), (2, 100), (8, 100), (9, 100), (None, 100), (10, 101), (12, 100)}
    assert not {k for k in got if k[0] in (3, 4, 5, 6, 11)}
    assert not got[1, 100].reparameterised and got[2, 100].reparameterised and not got[8, 100].reparameterised
    assert got[1, 100].n_windows == got[1, 100].n_exact == got[1, 100].item_windows
    assert got[2, 100].n_exact == 0 and got[8, 100].occurrences == 2


def test_exact_passages_like_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 7))) for _ in range(50)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([6, 13, 20, 40])))) for k in range(20)]
    docs = []
    for i in range(150):
        own = [rng.choice(words) for _ in range(rng.randrange(80))]
        if i % 3 == 0:
            item = rng.choice(items)[1].split()
            at = rng.randrange(len(item))
            own[len(own) // 2 : len(own) // 2] = item[at:] if i % 2 else item
        docs.append((i, rng.choice([" ", "\n", ", "]).join(own)))
    want = set()
    for i, text in docs:
        tokens = text.replace(",", "").split()
        for k, item in items:
            parts = item.split()
            w = min(13, len(parts))
            grams = {tuple(parts[a : a + w]) for a in range(len(parts) - w + 1)}
            if any(tuple(tokens[a : a + w]) in grams for a in range(len(tokens) - w + 1)):
                want.add((i, k))
    assert set(found(spark, docs, items)) == want


def test_empty_tables(spark):
    assert found(spark, [], [(1, QUESTION)]) == {}
    assert found(spark, [(1, QUESTION)], []) == {}


@pytest.mark.parametrize("options", [{}, {"broadcast_windows": 0}])
def test_copied_windows_count_whatever_their_values(spark, options):
    """One of two equal values changed, hardly any literal, and a first word after other punctuation than in the item."""
    table = "Mon 12 kg 13 kg Tue 14 kg 15 kg Wed 16 kg 17 kg"
    short = "Peter asked where the river ends"
    docs = [(1, QUESTION.replace("12", "30", 1)), (2, f"as follows, {table} and more"), (3, f"once, {short}"), (4, table.replace("16", "99")), (5, "clean text")]
    got = found(spark, docs, [(100, QUESTION), (101, table), (102, short)], partial_copies=True, **options)
    assert set(got) == {(1, 100), (2, 101), (3, 102)}
    tokens = QUESTION.replace(",", "").split()
    changed = tokens.index("12")
    copied = sum(not k <= changed < k + 13 for k in range(len(tokens) - 12))
    assert got[1, 100].n_windows == got[1, 100].n_exact == copied > 0 and not got[1, 100].reparameterised


def plain_tokens(text):
    """(words, template) of a text of ASCII letters, digits and punctuation."""
    text = re.sub(r"[ \t\n]+", " ", text)
    text = re.sub(r"(?<=[^.!?: ] )(?=[A-Z])", "\ue000", text)
    words, template = [], []
    for token in re.sub("[^A-Za-z0-9\ue000 ]", "", text).split(" "):
        if token:
            word = token.replace("\ue000", "").lower()
            words.append(word)
            slot = (
                "number" if re.search("[0-9]", token) or (not token.startswith("\ue000") and word in D.NUMBER_WORDS)
                else "name" if token.startswith("\ue000") else "unit" if word in D.UNITS else None
            )
            template.append(("slot", slot) if slot else word)
    return words, template


def plain_matches(docs, items, width, min_literals, partial, min_tokens):
    """Every alignment of every document and item, window by window."""
    for doc_id, text in docs:
        words, template = plain_tokens(text)
        for item_id, item_text in items:
            raw, shape = plain_tokens(item_text)
            w = min(width, len(raw))
            if len(raw) < min_tokens:
                continue
            found = []
            for shift in range(-len(raw), len(words)):
                n = exact = 0
                values = set()
                for k in range(len(raw) - w + 1):
                    at = k + shift
                    if at < 0 or at + w > len(words):
                        continue
                    enough = sum(not isinstance(t, tuple) for t in shape[k : k + w]) * width >= w * min_literals
                    copy = words[at : at + w] == raw[k : k + w]
                    if copy or (enough and template[at : at + w] == shape[k : k + w]):
                        n, exact = n + 1, exact + copy
                        if enough:
                            values |= {(t, raw[k + j], words[at + j]) for j, t in enumerate(shape[k : k + w]) if isinstance(t, tuple)}
                agrees = len({v[:2] for v in values}) == len(values)
                if n and (agrees or (partial and exact)):
                    found.append((n if agrees else exact, exact))
            if found:
                yield doc_id, item_id, max(n for n, _ in found), max(e for _, e in found), len(raw) - w + 1, len(found), all(e < n for n, e in found)


@pytest.mark.parametrize("partial", [False, True])
def test_random_texts_like_brute_force(spark, partial):
    rng = random.Random(21)
    vocabulary = "the of a cat sat mat Anna Bob Carl 3 17 five km kg days runs and.".split()
    draw = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, draw(rng.randrange(2, 14))) for k in range(25)]
    docs = []
    for k in range(80):
        text = rng.choice(items)[1].split()
        if rng.random() < 0.7:  # the same question with other values, here and there
            swap = {"Anna": "Dora", "3": "44", "five": "seven", "km": "kg", "17": "3"}
            text = [swap.get(t, t) if rng.random() < 0.6 else t for t in text]
        docs.append((k, f"{draw(rng.randrange(8))} {' '.join(text)} {draw(rng.randrange(8))}"))
    found = contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), width=5, min_literals=3,
        partial_copies=partial, min_item_tokens=3,
    )
    columns = ("doc_id", "item_id", "n_windows", "n_exact", "item_windows", "occurrences", "reparameterised")
    got = sorted(tuple(r[c] for c in columns) for r in found.collect())
    assert got == sorted(plain_matches(docs, items, 5, 3, partial, 3))
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)

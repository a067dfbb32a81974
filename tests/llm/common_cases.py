"""Documents with the odd cases that every operator must survive."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n, vocabulary=400):
    return " ".join(rng.choice(("alpha", "be", "gam", "delta", "épsilon", "zê"))[: rng.randrange(2, 6)] + str(rng.randrange(vocabulary)) for _ in range(n))


def documents(seed=5):
    """(doc_id, text): passages that repeat across documents, exact and near copies, self-repeats, periodic and odd texts."""
    rng = random.Random(seed)
    shared = [sentence(rng, 60) for _ in range(3)]
    out = []
    for i in range(40):
        text = sentence(rng, rng.randrange(5, 150))
        if i % 4 == 0:
            text += " " + rng.choice(shared) + " " + sentence(rng, 20)
        if i % 9 == 0:
            text = text + "\n\t " + text
        out.append((i, text))
    out += [(100 + i, out[3][1]) for i in range(4)]
    for i in range(5):
        w = out[5][1].split()
        w[rng.randrange(len(w))] = f"edit{i}"
        out.append((110 + i, " ".join(w)))
    out += [(200, None), (201, ""), (202, " \n "), (203, "a"), (204, "A b"), (205, "a B"), (206, "x" * 3000), (207, "ab " * 700), (208, "é" * 130 + "x" + "é" * 130), (209, "!!! 123 ???"), (210, sentence(rng, 20_000, 10**6))]
    return out

"""Small documents with the awkward cases: nulls, empties, ties, repeats, a long text, clashing columns."""

import random
import re

WORDS = [a + b for a in "ka te mo ri su la ne vo".split() for b in "pan dor lis meg tun sar".split()]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed=5):
    """(doc_id, text) rows."""
    rng = random.Random(seed)
    passage, common = sentence(rng, 60), "this line is common to all of the documents here and there"
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(25)]
    base = sentence(rng, 150).split()
    for _ in range(12):  # near copies
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(150)] = rng.choice(WORDS)
        texts.append(" ".join(own))
    texts += [texts[0], texts[0].upper(), texts[3], "", " \n\t ", None, None, "one", "two words", "ONE", "é ñandú — ☃", "Zs\u0085x y\x1cz"]
    texts += [f"{sentence(rng, 9)}\n{common}\n{passage[:200]} {sentence(rng, 20)}\n{common}\n" for _ in range(4)]
    texts += [sentence(rng, 30) + " " + passage + " " + sentence(rng, 20) for _ in range(3)]
    texts += ["a b\nc d\n\ne f g\n" + sentence(rng, 12), "a b\nc d\ne f g\nshort", "\n".join(["x y z w"] * 9), "loop " * 90]
    texts.append("\n".join(sentence(rng, 11) for _ in range(2000)))  # long
    rng.shuffle(texts)
    return list(enumerate(texts))


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")

"""Awkward rows for the tests of document operators."""

import random


def make_rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice(["the", "en", "ré", "on", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(i, say(rng.randint(1, 200))) for i in range(60)]
    passage = say(90)
    for i in range(60, 75):
        rows.append((i, f"{say(30)} {passage}\n{say(20)}"))
    rows += [(i, rows[3][1]) for i in range(75, 85)]  # exact copies
    near = rows[61][1].split(" ")
    for i in range(85, 100):  # near copies
        w = list(near)
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "one two"), (105, "a " * 500), (106, "a " * 700), (107, say(5000)), (107, say(50)), (108, rows[7][1]), (108, rows[7][1]), (109, "line x\n" * 30), (110, "Ünï 日本語 🙂   x\x0bz ''s don't  12345\r\n\r\n  q")]
    return rows

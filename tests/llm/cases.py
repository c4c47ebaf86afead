"""Documents with every awkward trait: nulls, blanks, ties, repeats, long texts, columns that clash with inner names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, hash string, maybe boolean, spans int"


def documents(seed: int = 3, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def prose(k: int) -> str:
        return "\n".join(" ".join(rng.choice(lexicon) for _ in range(rng.randint(4, 9))) for _ in range(k))

    shared = prose(6)
    texts: list[str | None] = [None, "", "   ", "\n\n", "one", "One", "a" * 450, prose(300)]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and len(texts) > 9:
            texts.append(rng.choice(texts[8:]))
        elif kind < 0.4 and len(texts) > 9:
            words = rng.choice(texts[8:]).split(" ")
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        elif kind < 0.6:
            texts.append(prose(3) + "\n" + shared + "\n" + prose(2))
        else:
            texts.append(prose(rng.randint(1, 12)))
    rows = [(i * 3 % 101, t, rng.choice(["en", "de", None]), None, len(t or ""), i, "x", None, 1) for i, t in enumerate(texts)]
    return rows + [rows[-1], (None, "no id here", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]

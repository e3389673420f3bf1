"""Awkward documents, and random ones that share passages."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward() -> list[tuple]:
    long_text = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [None, "", " ", "\n\n", "a", "A b\tc\x0bd", "é è ü ñ", "x\u00a0y z", "1 2 3", "#*$ %&| <>", "same line\nsame line\n\n same line\nsame line", long_text, long_text, "tie", "tie", "<|endoftext|> x<|endoftext|>", "don't we'll I'M  two   spaces \n\n end "]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return [*rows, rows[-1], (None, "null id text", "en", "s", 1), (None, None, None, None, None)]


def shared(seed: int, n: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéü") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    passages = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(14, 160))) for _ in range(5)]
    out = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.3 and out:
            words = rnd.choice(out)[1].split(" ")
            for _ in range(rnd.randint(0, max(1, len(words) // 25))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            text = " ".join(words)
        else:
            parts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120)))]
            parts += [rnd.choice(passages) for _ in range(rnd.randint(0, 2))]
            rnd.shuffle(parts)
            text = rnd.choice([" ", "\n"]).join(parts)
        out.append((i, text, rnd.choice(["en", "fr"]), "s", len(text)))
    return out


def frame(spark, rows):
    """With extra columns whose names an operator might use itself."""
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOC_SCHEMA + ", rule string, count long, digest string")

"""Rows that the operators are tried on."""

#: Columns whose names clash with what the operators use inside.
EXTRA = "h1 string, t1 string, row string, size long, source_size long, print string, class string, k1 string, shard int, id string, text_ string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
LINE = "all sites show this very line about cookies and consent"
LONG = " ".join(f"w{i * 7919 % 1009} x{i}" for i in range(60000))
BODY = " ".join(f"body{i} of{i % 13} text{i * i % 101}" for i in range(120))
NEAR = BODY.replace("body60 ", "changed ")


def rows():
    texts = [
        (None, "a text without an id that is long enough to be judged by all the rules here"), (None, None), (1, None), (2, ""), (3, " \t\n "),
        (4, LONG), (5, BODY), (6, BODY), (7, NEAR), (8, "short"), (8, "short"), (8, "other text of the same id"), (9, f"{LINE}\nnine"),
        (10, f"{LINE}\nten\n\n{LINE} "), (11, "one two three four five six seven " * 6), (12, "Schöne Grüße, ça va? Été — naïve ß\x85　ok\n\n" * 3),
        (13, "x" * 120), (14, "y" + "x" * 119), (15, f"before it {BODY} and after it"), (16, "line\n" * 4 + "end"),
    ]
    return [(i, t, "en" if n % 3 else None, None if n % 7 == 0 else f"src{n % 5}", 0, *(["clash"] * 3 + [1, 2] + ["c"] * 3 + [3] + ["c"] * 2)) for n, (i, t) in enumerate(texts)]

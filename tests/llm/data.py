"""Small inputs that the tests of the training-data operators share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "a",
    "  two  leading and  double  spaces  ",
    "tabs\tand\r\nline ends\x0b\x0c \n x",
    "no break   em  space \x1c file sep \x85 next line",
    "it's we'll I'd they've 's 't  'm",
    "café é ́ combining \U0001f600\U0001f468‍\U0001f469 emoji 你好世界",
    "<|endoftext|> <|startoftext|> is text here<|endoftext|>",
    "x" * 700 + " " + "ab" * 400 + " " + "é" * 300,
    "MIXED Case İstanbul STRASSE ΣΣ Σ",
    "1234567890 3.14 -- ### $$$ a|b <c> & * %",
    "same line\nsame line\nsame line\nother",
    "GIF89a and BM and RIFF and PK\x03\x04 and %PDF-1.4 %%EOF",
    "word " * 3000,
    "the cat sat on the mat " * 12,
]


def documents(n=120, seed=5):
    """Prose with exact and near copies, then the odd texts, then repeated rows."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice((20, 80, 300, 900)))).capitalize() + "." for _ in range(n)]
    for i in range(0, n, 6):
        texts.append(texts[i])
        near = texts[i].split()
        near[len(near) // 2] = "changed"
        texts.append(" ".join(near))
    texts += ODD_TEXTS
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "a row without an id", None, None, None), (None, None, None, None, None)]

"""Brute force in plain Python: the semantics once more, for small inputs only."""

import re

# The same patterns the library states, in Python form.
URL = re.compile(r'https?://[^\s<>"{}|\\^`\[\]]+')
RUN = re.compile(r"(?<![0-9])(\d[\d\-\s]{8,16}[\dXx])\b")
SEPARATOR = re.compile(r"[-\s]")


def clean(isbn: str) -> str:
    return SEPARATOR.sub("", isbn)


def shaped(form: str) -> bool:
    if len(form) == 13:
        return form.isdecimal()
    return len(form) == 10 and form[:9].isdecimal() and (form[9].isdecimal() or form[9] == "X")


def find(text: str, context: int = 50, proximity: int = 6) -> list[tuple[str, str, int]]:
    """Hits by definition: a number whose own stretch of text, looking back from its first
    character, is some reach of characters, none of which starts the word anew, after the word."""
    text = URL.sub(" ", text)
    # On a lower-cased window: the word, then what is left of it, without the word in it again.
    led = re.compile(r"isbn((?:(?!isbn).)*)\Z", re.DOTALL)
    out = []
    for m in RUN.finditer(text):
        before, after = text[: m.start()], text[m.end() :]
        near = led.search(before[-(proximity + len("isbn")) :].lower())
        if shaped(clean(m[1]).upper()) and near and len(near[1]) <= proximity:
            around = before[len(before) - min(context, len(before)) :] + m[1] + after[:context]
            out.append((m[1], around.strip(), m.start()))
    return out


def valid(isbn: str) -> bool:
    form = clean(isbn).upper()
    if not shaped(form):
        return False
    digits = [10 if c == "X" else int(c) for c in form]
    if len(digits) == 10:
        return sum(d * (10 - i) for i, d in enumerate(digits)) % 11 == 0
    return sum(d * (3 if i % 2 else 1) for i, d in enumerate(digits)) % 10 == 0

"""The two functions without an expression form, as vectorised UDFs."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

# Words that link names, labels that end one, the signs a name may hold, and how far it may reach back.
LINKS = {"de", "da", "do", "dos", "das", "e"}
LABELS = {
    "ADVOGADO", "ADVOGADA", "ADV", "ADVOGADO(A)", "ADVOGADOS", "ADVOGADA(O)", "DR", "DRA", "PROCURADOR", "PROCURADORA", "INTIMAÇÃO", "INTIMACAO", "REQUERENTE", "REQUERIDO",
    "EXEQUENTE", "EXECUTADO", "AUTOR", "RÉU", "REU",
}
REACH, MOST_WORDS, SHORTEST = 71, 8, 5
_BAR = re.compile(r"\s*[(\[]?\s*OAB")
_RUN = re.compile(r"[A-Za-zÀ-ÿ'`.\s]*\Z")


def _name_at_end(run: str) -> str:
    """The name at the end of a run of letters: capitalised words read backwards, links between them allowed."""
    words: list[str] = []
    for token in reversed(run.split()):
        word = token.strip(".'`")
        if not word:
            continue
        link = word.lower() in LINKS
        if word.upper() in LABELS or not (link or word[0].isupper()):
            break
        words.append(word)
        if not link and len(words) >= MOST_WORDS:
            break
    while words and words[-1].lower() in LINKS:
        words.pop()
    name = " ".join(reversed(words))
    return name if len(words) >= 2 and len(name) >= SHORTEST else ""


def names_before_bar(text: str | None, most: int = 40) -> list[str]:
    """Names that stand right before a bar registration or its bracket, as they are written, without repeats."""
    text, done, out = text or "", 0, []
    for m in _BAR.finditer(text):
        run = _RUN.search(text[max(done, m.start() - REACH) : m.start()]).group()
        done = m.end()
        if (name := _name_at_end(run)) and name not in out:
            out.append(name)
            if len(out) == most:
                break
    return out


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def page_text(html: str | None) -> str:
    p = _Text()
    p.feed(html or "")
    return " ".join(" ".join(p.parts).split())


def lawyer_names():
    @F.pandas_udf("array<string>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(names_before_bar)

    return f


def html_text():
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(page_text)

    return f

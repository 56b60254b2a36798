"""Providers that need no service: word lists and the glossary, for tests and dry runs."""

from __future__ import annotations

import regex

from commentloom.functions import wordlists
from commentloom.functions.text import WORD


class WordListDetector:
    """Language with the highest word score, ties to the first code; '' if none."""

    provider_id = "word-lists"

    def __call__(self, texts: list[str], lang: str | None) -> list[str]:
        weights = sorted(wordlists.language_weights().items())
        found = []
        for text in texts:
            tokens = regex.findall(WORD, text.lower())
            scores = [(sum(listed.get(t, 0) for t in tokens), code) for code, listed in weights]
            best = max((score for score, _ in scores), default=0)
            found.append(next(code for score, code in scores if score == best) if best else "")
        return found


class GlossaryTranslator:
    """Word-for-word English; unknown words are kept."""

    provider_id = "glossary"

    def __call__(self, texts: list[str], lang: str | None) -> list[str]:
        english = wordlists.GLOSSARY.get(lang or "", {})
        return [" ".join(english.get(t, t) for t in regex.findall(WORD, text.lower())) for text in texts]

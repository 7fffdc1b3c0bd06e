"""Terms of a question, on the driver: a question has a dozen of them at most."""

from __future__ import annotations

import regex

from tessera.functions.constants import MAX_TERMS, STOP_WORDS


def stem(term: str) -> str:
    """Lower case without a plain English ending; lengths are in bytes."""
    low = term.lower()
    size = len(low.encode())
    if low.endswith("tted") and size > 6:
        return low[:-3]
    if low.endswith("ed") and size > 5 or low.endswith("es") and size > 4:
        return low[:-2]
    if low.endswith("s") and size > 3 and not low.endswith(("ss", "us", "is")):
        return low[:-1]
    return low


def split_words(term: str) -> list[str]:
    """The words of a compound identifier: at separators, humps and the last capital of an acronym."""
    spaced = regex.sub(r"[_\-.:/]+", " ", term)
    spaced = regex.sub(r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " ", spaced)
    spaced = regex.sub(r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ", spaced)
    return spaced.split()


def query_terms(question: str) -> list[str]:
    """The searchable terms in order, one for each stem."""
    out, seen = [], set()
    for token in regex.split(r"[^\p{L}\p{N}_:.\-/]+", question):
        token = token.strip(".:/-")
        short = len(token) == 2 and (regex.fullmatch(r"[A-Z]+", token) or regex.search(r"[0-9]", token))
        if len(token) < 3 and not short or token.lower() in STOP_WORDS:
            continue
        if stem(token) not in seen:
            seen.add(stem(token))
            out.append(token)
    return out[:MAX_TERMS]


def term_forms(term: str) -> list[str]:
    """The spellings that count as the term."""
    words = split_words(term)
    forms = [stem(term)]
    if len(words) > 1:
        forms += [stem(joiner.join(words)) for joiner in ("_", "-", "")]
    return list(dict.fromkeys(forms))


def is_identifier_like(term: str) -> bool:
    return any(s in term for s in ("_", "::", ".")) or regex.search(r".[A-Z]", term, regex.S) is not None


def intrinsic_weights(terms: list[str]) -> list[int]:
    """3 for identifiers, 2 for long words, else 1; the first term counts one more."""
    return [(3 if is_identifier_like(t) else 2 if len(t.encode()) >= 8 else 1) + (i == 0) for i, t in enumerate(terms)]

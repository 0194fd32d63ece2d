"""How texts end: what may be cut off, notices that more followed, and the marks of a finished text."""

from __future__ import annotations

import re

# Notices that more followed; the mark of half a character.
NOTICE = re.compile(r"(?:[\[<(]\s*(?:\.\.\.|…)?\s*(?:output |text |response )?(?:truncated|cut|cut off|more|continued|continues|snip|omitted)\s*(?:\.\.\.|…)?\s*[\]>)]|…|\.\.\.)$", re.I)
BROKEN = "�"
_SENTENCE_END = re.compile(r"[.?!。？！][\"'”»)\]}|_*\s]*$|\}[\s|$*]*$|_{2,}\W*$")
_SHORT_ANSWER = re.compile(r"(?:(?:answer|result|antwort|lösung|ergebnis|respuesta|réponse|ответ|答案|solución|solution)\s{0,2}(?::|is|ist|es|est|равен|是|=)|\([A-J]\))[\s*]{0,4}(?:[A-J]|[-+]?\d[\d.,/%°²]*\s?[^\W\d_]{0,7})[\s*]{0,4}$", re.I)


def body(text: str) -> str:
    """The text without white space and special tokens at its end."""
    while True:
        text = text.rstrip()
        if not text.endswith("|>"):
            return text
        i = text.rfind("<|")
        if i < 0 or len(text) - i > 44 or "<" in text[i + 1 :]:
            return text
        text = text[:i]


def has_notice(t: str) -> bool:
    return t[-1:] in "]>)….…" and bool(NOTICE.search(t[-60:]))


_TAG_CUT = re.compile(r"<[/|]?[a-z_|]{0,20}$")


def is_open(t: str) -> bool:
    """A thought is opened and never closed, or a tag is cut."""
    return "<think>" in t and t.count("<think>") > t.count("</think>") or bool(_TAG_CUT.search(t[-24:]))


def in_pairs(t: str) -> bool:
    return t.count("{") == t.count("}") and t.count("$") % 2 == 0


_MARK = re.compile(r"[.?!。？！][\"'”»)\]|_*\s]*$|\}[\s|$*]*$")


def ends_sentence(t: str) -> bool:
    """Whether a body ends with the mark of a sentence or a closed box, braces and dollars in pairs."""
    return in_pairs(t) and bool(_MARK.search(t[-40:]))


def is_finished(t: str) -> bool:
    """Whether a body ends as a finished one does: with the mark of a sentence, a closed box or a short answer, braces and dollars in pairs."""
    if not t or t.endswith(BROKEN) or has_notice(t) or is_open(t) or not in_pairs(t):
        return False
    return bool(_SENTENCE_END.search(t[-40:]) or _SHORT_ANSWER.search(t[-80:]))

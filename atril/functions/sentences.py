"""Sentence assembly from growing text (survey id ST7), one message at a time."""

from __future__ import annotations

import regex

from atril.functions.text import ABBREVIATIONS, MIN_SENTENCE_CHARS

#: What closes a sentence: line breaks, several marks together, or one mark; a single full stop neither
#: between two digits nor behind an abbreviation.
_CLOSING = regex.compile(
    rf"\n+|[.!?…]{{2,}}|[!?…]|(?<!(?<!\p{{L}})(?:{'|'.join(ABBREVIATIONS)})\s*)\.(?!(?<=\p{{Nd}}\.)\p{{Nd}})", regex.IGNORECASE)


#: Every closing holds one of these.
_MARK = regex.compile(r"[\n.!?…]")


def take_sentences(pending: str) -> tuple[list[str], str]:
    """Completed sentences of `pending` and what remains: stretches between closings, joined until long enough."""
    whole, begin = [], 0
    for end in [m.end() for m in _CLOSING.finditer(pending)]:
        stretch = pending[begin:end].strip()
        if len(stretch) >= MIN_SENTENCE_CHARS:
            whole.append(stretch)
            begin = end
    return whole, pending[begin:]


def visible(delta: str, hidden: bool) -> tuple[str, bool]:
    """The part of a delta outside <think> spans, and whether a span stays open."""
    low = delta.lower()
    if hidden:
        close = low.find("</think>")
        return ("", True) if close < 0 else (delta[close + 8:], False)
    start = low.find("<think>")
    if start < 0:
        return delta, False
    rest, still = visible(delta[start + 7:], True)
    return delta[:start] + rest, still


class Assembler:
    """Pending text and open-span flag of one message."""

    def __init__(self, pending: str = "", hidden: bool = False):
        self.pending, self.hidden = pending, hidden

    def feed(self, delta: str) -> list[str]:
        shown, self.hidden = visible(delta or "", self.hidden)
        if not _MARK.search(shown):  # what is pending has no sentence, and text without a mark completes none
            self.pending += shown
            return []
        done, self.pending = take_sentences(self.pending + shown)
        return done

    def flush(self) -> list[str]:
        rest, self.pending = self.pending.strip(), ""
        return [rest] if rest else []


def split_sentences(text: str) -> list[str]:
    a = Assembler()
    return a.feed(text) + a.flush()

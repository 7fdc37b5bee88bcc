"""Text rewriting that remembers where every character came from."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

#: Letters of other scripts that look like Latin ones, in pairs.
LOOKALIKES = (
    "аa еe оo рp сc хx уy кk іi ѕs јj ԁd ɡg һh ӏl νv αa οo ρp τt υu ιi κk АA ВB ЕE КK МM НH ОO РP СC ТT ХX УY "
    "ІI ЅS ЈJ ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
)
_FOLD = {ord(pair[0]): pair[1] for pair in LOOKALIKES.split()}
_FOLD.update({ord(c): "-" for c in "‐‑‒–—−﹣－"})
_FOLD.update({ord(c): "'" for c in "‘’ʼ´`"})
_FOLD.update({ord(c): '"' for c in "“”„«»"})
_FOLD.update({ord(c): " " for c in "\u00a0\u2007\u202f\u2009\u200a"})
_FOLD.update({ord(c): "" for c in "\u200b\u200c\u200d\u2060\ufeff\u00ad"})


class Spans:
    """A text and, for each of its characters, the start and end in the source text.

    While nothing was rewritten the offsets are the identity and are not stored.
    """

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def _offsets(self) -> None:
        if self.starts is None:
            self.starts = list(range(len(self.text)))
            self.ends = list(range(1, len(self.text) + 1))

    def fold(self) -> "Spans":
        """Lookalike letters, wide forms, dashes, quotes and invisible characters, one by one."""
        if self.text.isascii():
            return self
        self._offsets()
        out, starts, ends = [], [], []
        for i, ch in enumerate(self.text):
            code = ord(ch)
            if code < 128:
                new = ch
            else:
                new = _FOLD.get(code)
                if new is None:
                    new = unicodedata.normalize("NFKC", ch) if not ch.isalpha() or code > 0x2000 else ch
                    new = new if new.isprintable() and new.strip() else ch
            for c in new:
                out.append(c)
                starts.append(self.starts[i])
                ends.append(self.ends[i])
        self.text, self.starts, self.ends = "".join(out), starts, ends
        return self

    def rewrite(self, pattern: re.Pattern, replacement: Callable[[re.Match], str]) -> "Spans":
        """Replace each match; each new character stands for the whole matched source span."""
        out, last, starts, ends = [], 0, [], []
        for m in pattern.finditer(self.text):
            new = replacement(m)
            if new == m[0]:
                continue
            self._offsets()
            out.append(self.text[last : m.start()])
            starts += self.starts[last : m.start()]
            ends += self.ends[last : m.start()]
            out.append(new)
            starts += [self.starts[m.start()]] * len(new)
            ends += [self.ends[m.end() - 1]] * len(new)
            last = m.end()
        if last:
            out.append(self.text[last:])
            self.starts = starts + self.starts[last:]
            self.ends = ends + self.ends[last:]
            self.text = "".join(out)
        return self

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of the rewritten text."""
        if self.starts is None:
            return start, end
        return self.starts[start], self.ends[end - 1]

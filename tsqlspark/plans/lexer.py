"""Tokens of T-SQL text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import TsqlError

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*)
      | (?P<str>[nN]?'(?:[^']|'')*')
      | (?P<bin>0[xX][0-9a-fA-F]*)
      | (?P<money>\$[+-]?\d+(?:\.\d*)?)
      | (?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
      | (?P<qid>\[(?:[^\]]|\]\])*\]|"(?:[^"]|"")*")
      | (?P<var>@@?[\w$#@]+)
      | (?P<id>[^\W\d][\w$#@]*|\#\#?[\w$#@]+)
      | (?P<op><>|!=|<=|>=|!<|!>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%=<>&|^~(),.;:?])""",
    re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    @property
    def word(self) -> str:
        """Upper-case text of a bare word, else empty."""
        return self.text.upper() if self.kind == "id" else ""

    @property
    def value(self) -> str:
        """The name or string that a quoted token stands for."""
        if self.kind == "qid":
            return self.text[1:-1].replace("]]" if self.text[0] == "[" else '""', self.text[-1])
        if self.kind == "str":
            return self.text[self.text.index("'") + 1 : -1].replace("''", "'")
        return self.text


def tokenize(text: str) -> list[Token]:
    tokens, at = [], 0
    while at < len(text):
        if text.startswith("/*", at):
            depth, end = 1, at + 2
            while depth:
                mark = re.compile(r"/\*|\*/").search(text, end)
                if not mark:
                    raise TsqlError(113, "Missing end comment mark '*/'.")
                depth += 1 if mark[0] == "/*" else -1
                end = mark.end()
            at = end
            continue
        found = _TOKEN.match(text, at)
        # after a name, ".5" is a dot and a number's digits belong to nothing
        if found and found.lastgroup == "num" and found[0].startswith(".") and tokens and tokens[-1].kind in ("id", "qid") and tokens[-1].at + len(tokens[-1].text) == at:
            found = re.compile(r"(?P<op>\.)").match(text, at)
        if not found:
            raise TsqlError(105 if text[at] in "'\"" else 102, f"Incorrect syntax near '{text[at]}'.")
        if found.lastgroup != "space":
            tokens.append(Token(found.lastgroup, found[0], at))
        at = found.end()
    return [*tokens, Token("eof", "", len(text))]

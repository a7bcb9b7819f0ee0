"""The match language: terms, "phrases", a + b, prefix*, ^initial, column:x, {a b}:x, NEAR(a b, k), AND, OR, NOT, ().

Adjacent phrases are joined by AND. NOT binds tighter than AND, AND tighter than OR. A query that doesn't
parse is read again inside quotes; if that fails too it matches nothing.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

#: Indexed columns and their weights in the rank.
COLUMNS = {"title": 10.0, "authors": 5.0, "text": 1.0}
_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([(){}:+^,*])|([^\s"(){}:+^,*]+))')


def fold_map() -> tuple[str, str]:
    """Letters below U+0250 that are a base letter with one mark, and their bases; from Unicode's own rule."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250) if chr(c).islower()]
    pairs = [(c, d[0]) for c, d in pairs if len(d) == 2 and d[0] != c and ord(d[0]) < 0x80]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = fold_map()


def tokens(text: str) -> list[str]:
    """Runs of letters, digits and marks, lower-cased, without diacritics."""
    return re.findall(r"[^\W_]+", text.lower().translate(str.maketrans(_FROM, _TO)))


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False
    initial: bool = False
    columns: tuple[str, ...] = tuple(COLUMNS)


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int


@dataclass(frozen=True)
class Bool:
    op: str  # and, or, not
    left: object
    right: object


class _Parser:
    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QuerySyntaxError(text[at:])
            at = m.end()
            if m[1] is not None:
                self.items.append(("string", m[1].replace('""', '"')))
            elif m[2]:
                self.items.append(("mark", m[2]))
            elif m[3] in ("AND", "OR", "NOT"):
                self.items.append(("op", m[3]))
            elif re.fullmatch(r"[\w\x80-\U0010ffff]+", m[3]):
                self.items.append(("word", m[3]))
            else:
                raise QuerySyntaxError(m[3])
        self.at = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.items[self.at + k] if self.at + k < len(self.items) else ("end", "")

    def take(self, *wanted: tuple[str, str]) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def need(self, kind: str) -> str:
        got = self.peek()
        if got[0] != kind:
            raise QuerySyntaxError(str(got))
        self.at += 1
        return got[1]

    def parse(self):
        tree = self.disjunction()
        if self.peek()[0] != "end":
            raise QuerySyntaxError(str(self.peek()))
        return tree

    def disjunction(self):
        left = self.conjunction()
        while self.take(("op", "OR")):
            left = Bool("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.take(("op", "AND")):
            left = Bool("and", left, self.negation())
        return left

    def negation(self):
        left = self.adjacent()
        while self.take(("op", "NOT")):
            left = Bool("not", left, self.adjacent())
        return left

    def adjacent(self):
        """Phrases side by side; a group in parentheses stands alone."""
        if self.peek() == ("mark", "("):
            return self.group(tuple(COLUMNS))
        left = self.unit()
        while self.peek()[0] in ("string", "word") or self.peek() in (("mark", "^"), ("mark", "{")):
            left = Bool("and", left, self.unit())
        return left

    def group(self, columns):
        self.at += 1
        inner = self.disjunction()
        if not self.take(("mark", ")")):
            raise QuerySyntaxError("unbalanced parenthesis")
        return _narrow(inner, columns)

    def unit(self):
        columns = None
        if self.peek() == ("mark", "{"):
            self.at += 1
            columns = []
            while self.peek()[0] in ("word", "string"):
                columns.append(self.peek()[1].lower())
                self.at += 1
            if not columns or not self.take(("mark", "}")) or not self.take(("mark", ":")):
                raise QuerySyntaxError("column list")
        elif self.peek()[0] in ("word", "string") and self.peek(1) == ("mark", ":"):
            columns = [self.peek()[1].lower()]
            self.at += 2
        if columns is not None:
            if any(c not in COLUMNS for c in columns):
                raise QuerySyntaxError("no such column")
            if self.peek() == ("mark", "("):
                return self.group(tuple(columns))
        got = self.near() if self.peek() == ("word", "NEAR") and self.peek(1) == ("mark", "(") else self.phrase()
        return _narrow(got, tuple(columns)) if columns else got

    def near(self) -> Near:
        self.at += 2
        phrases = []
        while self.peek()[0] in ("word", "string"):
            phrases.append(self.phrase())
        distance = 10
        if self.take(("mark", ",")):
            word = self.need("word")
            if not word.isdigit():
                raise QuerySyntaxError(word)
            distance = int(word)
        if not phrases or not self.take(("mark", ")")):
            raise QuerySyntaxError("NEAR")
        return Near(tuple(phrases), distance)

    def phrase(self) -> Phrase:
        initial = self.take(("mark", "^"))
        terms: list[str] = []
        while True:
            if self.peek()[0] not in ("word", "string"):
                raise QuerySyntaxError(str(self.peek()))
            terms += tokens(self.peek()[1])
            self.at += 1
            if not self.take(("mark", "+")):
                break
        return Phrase(tuple(terms), self.take(("mark", "*")), initial)


def _narrow(node, columns):
    if isinstance(node, Phrase):
        return Phrase(node.terms, node.prefix, node.initial, tuple(c for c in node.columns if c in columns))
    if isinstance(node, Near):
        return Near(tuple(_narrow(p, columns) for p in node.phrases), node.distance)
    return Bool(node.op, _narrow(node.left, columns), _narrow(node.right, columns))


def parse(query: str):
    """The tree of a query; None if nothing can match."""
    query = query.strip()
    if not query:
        return None
    for text in (query, f'"{query}"'):
        try:
            return _Parser(text).parse()
        except QuerySyntaxError:
            continue
    return None


def scored(node) -> list[Phrase]:
    """The phrases that count for the rank: all but those under NOT."""
    if isinstance(node, Phrase):
        return [node] if node.terms else []
    if isinstance(node, Near):
        return [p for p in node.phrases if p.terms]
    return scored(node.left) + ([] if node.op == "not" else scored(node.right))

"""Licence scan: Aho-Corasick over identifier tags and notice phrases, and a shunting-yard parser for expressions.

The automaton runs over each text reduced to lower-case words with one space around them, so
a match is a run of whole words. A text with an identifier tag has the expressions behind its
tags parsed, with the precedence WITH, AND, OR.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.llm.common import arrow_batches, shipped, without

shipped(__name__)

#: The phrases every scan must find, with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases and their labels.
NOTICE_PHRASES = {
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons": "cc",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "unlicense": "unlicense",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: Identifier families: an identifier is the family's name, or begins with it and a hyphen. With label and whether reuse is free of conditions on
#: derived work; longer names come first where one begins another.
FAMILIES = (
    ("agpl", "agpl", False), ("lgpl", "lgpl", False), ("gpl", "gpl", False), ("mpl", "mpl", False), ("epl", "epl", False),
    ("apache", "apache", True), ("mit", "mit", True), ("bsd", "bsd", True), ("isc", "isc", True), ("unlicense", "unlicense", True),
    ("cc0", "cc0", True), ("cc-by-nc", "cc-by-nc", False), ("cc-by-nd", "cc-by-nd", False), ("cc-by-sa", "cc-by-sa", False), ("cc-by", "cc-by", True))
UNKNOWN = "unknown"

SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "expressions array<string>, binding string, permissive boolean")
_ADDED = tuple(x.split()[0] for x in SCHEMA.split(", "))

_RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_TAGGED = re.compile(r"spdx[^0-9a-z\x80-\U0010ffff\n]license[^0-9a-z\x80-\U0010ffff\n]identifier[ \t]*:[ \t]*([^\n]*)", re.IGNORECASE)
# every ASCII byte that is no letter or digit separates words; bytes of other characters belong to words
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def postfix(expression: str) -> list[str] | None:
    """The expression's tokens in postfix order; None if it is no complete expression.

    Reading ends where the text stops looking like an expression, such as at a comment's end.
    """
    out, stack, at, operand = [], [], 0, True
    while m := _TOKEN.match(expression, at):
        token, low = m[1], m[1].lower()
        if operand and token == "(":
            stack.append(token)
        elif operand and token != ")" and low not in _RANK:
            out.append(token)
            operand = False
        elif not operand and token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        elif not operand and low in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif not operand:
            break
        else:
            return None
        at = m.end()
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def family(identifier: str) -> tuple[str, bool]:
    """Label of an identifier and whether its licence is permissive; `unknown` if it belongs to no family."""
    name = identifier.lower()
    return next(((label, free) for start, label, free in FAMILIES if name == start or name.startswith(f"{start}-")), (UNKNOWN, False))


def evaluate(tokens: list[str]) -> tuple[set[str], set[str], bool]:
    """Of a postfix expression: the labels it names, those that bind a careful user, and whether these are all permissive.

    AND binds to both sides. OR lets the user choose: a permissive side before one that is not, a known one before an unknown one, then the one with fewer
    labels, then the first in alphabetical order. WITH grants an exception to its left side.
    """
    stack: list[tuple[set[str], set[str], bool]] = []
    for token in tokens:
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            if token == "or":
                _, binding, free = min(left, right, key=lambda x: (not x[2], UNKNOWN in x[1], len(x[1]), sorted(x[1])))
                stack.append((left[0] | right[0], binding, free))
            elif token == "and":
                stack.append((left[0] | right[0], left[1] | right[1], left[2] and right[2]))
            else:
                stack.append(left)
        else:
            label, free = family(token)
            stack.append(({label}, {label}, free))
    return stack[0]


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in (BASE_PHRASES | NOTICE_PHRASES).items():
        found.add_word(f" {phrase} ", (len(phrase) + 1, label, phrase in BASE_PHRASES))
    found.add_word(f" {TAG} ", (len(TAG) + 1, None, False))
    found.make_automaton()
    return found


def scan(text: str | None, automaton: ahocorasick.Automaton) -> tuple:
    """One text's row, in the order of SCHEMA."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    n_base, first, last, base, labels, evidence, tags = 0, None, None, set(), set(), 0, 0
    free: list[bool] = []
    counted = position = 0
    for end, (back, label, is_base) in automaton.iter(line):
        start = end - back
        if label is None:
            tags += 1
            continue
        labels.add(label)
        evidence += 1
        if is_base:
            # matches come by their ends; count spaces on from the last one
            position += line.count(" ", counted, start) if start >= counted else -line.count(" ", start, counted)
            counted = start
            n_base += 1
            base.add(label)
            first = position if first is None else min(first, position)
            last = position if last is None else max(last, position)
    expressions, binding = [], set(labels)
    if tags:
        for m in _TAGGED.finditer(text):
            tokens = postfix(m[1])
            named, bound, permissive = evaluate(tokens) if tokens else (set(), set(), False)
            if named - {UNKNOWN}:  # words behind a tag that name no licence are no expression
                labels |= named
                binding |= bound
                free.append(permissive)
                expressions.append(" ".join(tokens))
                evidence += 2
    known = {f[1]: f[2] for f in FAMILIES}
    permissive = all(free) if free else all(known.get(x, False) for x in labels) if labels else None
    return (len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 - 0.5**min(evidence, 50), expressions, ",".join(sorted(binding)), permissive)


def license_scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns `keep` (default: all but the text) of `docs` plus those of SCHEMA.

    `binding` has the labels of notices and of what expressions bind to, `permissive` the verdict: of the expressions if there are any, else of the notices.
    A null text counts as empty: no words, empty labels, score 0, no verdict. The score is
    1 - 2^-(evidence): a phrase counts 1, a parsed expression 2. Every row is scanned whole and
    on its own, so ties, repeated rows and hot keys do not matter. Input columns named like an
    added one are replaced.
    """
    arrow_batches(docs.sparkSession)
    keep = tuple(c for c in docs.columns if c != text) if keep is None else keep
    source = without(docs.select(*keep), *_ADDED)
    names = source.columns
    packed = docs.select(F.struct(*names).alias("_row"), F.col(text).cast("string").alias("_text"))
    schema = f"_row {source.select(F.struct(*names)).schema[0].dataType.simpleString()}, {SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for b in batches:
            rows = [scan(t, automaton) for t in b.column("_text").to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ADDED]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column("_row"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["_row", *_ADDED])

    return packed.mapInArrow(run, schema).select("_row.*", *_ADDED)

"""Licence scans: Aho-Corasick over words and texts, shunting-yard over licence expressions.

One automaton over the lower-cased words of a text finds notice phrases wherever their words stand
consecutively; a second over the raw text finds identifier tags ("SPDX-License-Identifier:"). The expression
behind a tag is parsed by the shunting-yard algorithm (or < and < with, parentheses) and evaluated to a
permissiveness from 0 to 1: "or" takes the larger, "and" the smaller, "with" adds half of what is missing to 1.
Each licence of a well-formed expression adds its identifier as a label; of a malformed one the known
identifiers before the fault count. score is the best over the tags and the phrases found; 0 without any.

Edge cases: null counts as empty: no words, no labels, score 0, null first_word and last_word. Overlapping and
repeated places all count. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import WORD, released, rows_out

#: Notice phrases (words) and their labels: fixed values of the query's contract.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases of this scan.
EXTRA_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Permissiveness by the head of an identifier; others count as UNKNOWN.
PERMISSIVE = {
    "mit": 1.0,
    "bsd": 1.0,
    "isc": 1.0,
    "apache": 1.0,
    "unlicense": 1.0,
    "cc0": 1.0,
    "zlib": 1.0,
    "cc-by": 0.9,
    "mpl": 0.6,
    "lgpl": 0.5,
    "cc-by-sa": 0.5,
    "gpl": 0.3,
    "cc-by-nd": 0.2,
    "cc-by-nc": 0.2,
    "agpl": 0.2,
    "proprietary": 0.0,
}
UNKNOWN = 0.1
TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*)")
BINDS = {"or": 1, "and": 2, "with": 3}


def permissiveness(identifier: str) -> float:
    """By the longest known head of the identifier: gpl-3.0-only counts as gpl."""
    parts = identifier.lower().rstrip("+").split("-")
    return next((PERMISSIVE[h] for n in range(len(parts), 0, -1) if (h := "-".join(parts[:n])) in PERMISSIVE), UNKNOWN)


def tokens(text: str, at: int) -> list[str]:
    """Tokens of an expression that starts at `at` and runs to the end of its line; a word ends it unless an operator stands between."""
    out: list[str] = []
    operand = False  # whether the last token completes an operand
    while m := TOKEN.match(text, at):
        t = m[1]
        joins = t.lower() in BINDS
        if operand != (joins or t == ")"):
            break
        out.append(t)
        operand, at = not (joins or t == "("), m.end()
    return out


def to_postfix(infix: list[str]) -> list[str] | None:
    """Shunting-yard; None if the parentheses or operators don't match."""
    out: list[str] = []
    stack: list[str] = []
    for t in infix:
        if t == "(":
            stack.append(t)
        elif t == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif (low := t.lower()) in BINDS:
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
        else:
            out.append(t)
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return out


def evaluate(postfix: list[str]) -> tuple[float, list[str]] | None:
    """(permissiveness, licence identifiers); None if malformed. The right side of "with" is an exception, no licence."""
    stack: list[tuple[float, list[str]]] = []
    for t in postfix:
        if t not in BINDS:
            stack.append((permissiveness(t), [t.lower()]))
            continue
        if len(stack) < 2:
            return None
        b, a = stack.pop(), stack.pop()
        if t == "with":
            stack.append((a[0] + (1 - a[0]) / 2, a[1]))
        else:
            stack.append(((max if t == "or" else min)(a[0], b[0]), a[1] + b[1]))
    return stack[0] if len(stack) == 1 else None


def expression(text: str, at: int) -> tuple[float, list[str]]:
    infix = tokens(text, at)
    while infix and (infix[-1] == "(" or infix[-1].lower() in BINDS):
        infix.pop()
    postfix = to_postfix(infix)
    found = evaluate(postfix) if postfix else None
    if found:
        return found
    known = [t.lower() for t in infix if t not in "()" and t.lower() not in BINDS]
    return min(map(permissiveness, known), default=0.0), known


def _automaton(patterns: dict) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, v in patterns.items():
        out.add_word(k, v)
    out.make_automaton()
    return out


def scan_text(text: str, phrases: ahocorasick.Automaton, tags: ahocorasick.Automaton) -> dict:
    raw = text.encode("utf-8", "replace").lower()
    found = WORD.findall(raw)
    line = (b" " + b" ".join(found) + b" ").decode("latin-1")
    starts, base, labels, score = [], set(), set(), 0.0
    for end, (pattern, label, is_base) in phrases.iter(line):
        if is_base:
            starts.append(end + 1 - len(pattern))
            base.add(label)
        labels.add(label)
        score = max(score, permissiveness(label))
    if b"identifier:" in raw or b"expression:" in raw:
        plain = raw.decode("latin-1")
        for end, _ in tags.iter(plain):
            value, own = expression(plain, end + 1)
            labels |= set(own)
            score = max(score, value)
    count = [line.count(" ", 0, s) for s in (min(starts), max(starts))] if starts else [None, None]
    return {"n_words": len(found), "n_base": len(starts), "first_word": count[0], "last_word": count[1], "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": float(score)}


def scanners(base: dict = PHRASES, extra: dict = EXTRA_PHRASES) -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    pad = {f" {k} ": (f" {k} ", v, is_base) for group, is_base in ((extra, False), (base, True)) for k, v in group.items()}
    return _automaton(pad), _automaton({t: t for t in TAGS})


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row."""
    kinds = {"id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, tags = scanners()
        for batch in batches:
            rows = [{"id": i.as_py()} | scan_text(t.as_py() or "", phrases, tags) for i, t in zip(batch.column(0), batch.column(1))]
            yield rows_out({k: ([r[k] for r in rows], t) for k, t in kinds.items()})

    schema = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)

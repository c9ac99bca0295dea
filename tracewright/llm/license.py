"""License scans (operator 3).

Method: one Aho-Corasick automaton finds identifier tags
(`SPDX-License-Identifier:`) and notice phrases; what follows a tag up to the
end of its line is a licence expression, which a shunting-yard parser turns
into postfix form and evaluates: OR takes the freer side, AND the stricter, and
WITH a known exception loosens its licence by a step (with anything else it is
broken). A phrase that begins a longer one at the same place gives way to it. A document's own verdict is
the strictest of its findings, as every one of them binds. Phrases are matched
over a copy in which each run of white space and comment marks is one space, so
a notice may be wrapped over the lines of a comment; tags keep their lines.

Classes, from free to strict: 0 permissive, 1 weak copyleft, 2 strong copyleft,
3 network copyleft or non-commercial, 4 unknown or broken.

Edge cases: a null or empty text has no findings (empty lists, null class, kept
as allowed); an expression that doesn't parse is class 4 and marked; rows with
a null doc_id and repeated rows are scanned each by itself; doc_id may be of any
type; ties (several findings, or a notice given twice) all count, the licences
are named once, in order; an empty table gives no rows; other columns, whatever
their names, are ignored. The time for a text goes by its length, and a task
holds a very long one three times.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kind, need
from .spdx import CLASS_OF, EXCEPTIONS, NOTICES

TAG = "spdx-license-identifier:"
#: A document whose class is at most this may be used.
MOST = 1
UNKNOWN = 4
_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+:-]*")
#: A run of white space and comment marks with white space in it, other than a lone space between words.
_GAP = re.compile(r"(?<![\s/*#;%!>|<-])(?! [^\s/*#;%!>|<-])[/*#;%!>|<-]*\s[\s/*#;%!>|<-]*")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard; None if the expression is broken. Case doesn't matter.
    After the first whole expression, comment ends (*/, -->) may follow."""
    expression = re.sub(r"(\*/|-->|#|\").*$", "", expression.lower().strip()).rstrip().rstrip(".,;")
    if re.sub(r"[\s()a-z0-9.+:-]", "", expression):
        return None
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        if token == "(":
            if not operand_next:
                return None
            waiting.append(token)
        elif token == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif token in _PRECEDENCE:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and _PRECEDENCE[waiting[-1]] >= _PRECEDENCE[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def class_of(licence: str) -> int:
    return CLASS_OF.get(bare(licence), UNKNOWN)


def bare(licence: str) -> str:
    """Without the mark of later versions."""
    return licence[:-1] if licence.endswith("+") else licence


def evaluate(postfix: list[str]) -> tuple[int, set[str]] | None:
    """(class, licences). None if WITH's right side isn't a known exception or
    its left side a lone licence."""
    stack: list[tuple[int, set[str], str | None]] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            stack.append((class_of(token), {bare(token)}, token))
            continue
        (rc, rs, r), (lc, ls, left) = stack.pop(), stack.pop()
        if token == "with":
            if r not in EXCEPTIONS or left is None:
                return None
            stack.append((lc if lc in (0, UNKNOWN) else lc - 1, ls, None))
        else:
            stack.append((min(lc, rc) if token == "or" else max(lc, rc), ls | rs, None))
    return stack[0][0], stack[0][1]


def on_one_line(folded: str) -> str:
    return _GAP.sub(" ", folded)


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word(TAG, (len(TAG), ""))
    for phrase, licence in NOTICES.items():
        key = on_one_line(phrase)
        found.add_word(key, (len(key), licence))
    found.make_automaton()
    return found


def scan_text(text: str, found) -> tuple[list[str], list[str], int, int, int | None]:
    """(licences, expressions, notices, broken expressions, class)."""
    folded = text.lower()
    expressions: list[str] = []
    broken = 0
    # The longest phrase from each place.
    notices = {last + 1 - size: licence for last, (size, licence) in found.iter(on_one_line(folded)) if licence}
    licences = {*notices.values()}
    kinds = [class_of(x) for x in licences]
    for last, (_, licence) in found.iter(folded):
        if not licence:
            end = folded.find("\n", last + 1)
            line = folded[last + 1 : end if end >= 0 else len(folded)]
            expressions.append(line.strip())
            postfix = to_postfix(line)
            value = evaluate(postfix) if postfix else None
            if value is None:
                broken += 1
                kinds.append(UNKNOWN)
            else:
                kinds.append(value[0])
                licences |= value[1]
    return sorted(licences), expressions, len(notices), broken, max(kinds, default=None)


def _scanner(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        nothing: tuple[list[str], list[str], int, int, int | None] = ([], [], 0, 0, None)
        for batch in batches:
            rows = [scan_text(t, found) if t else nothing for t in batch.column(1).to_pylist()]
            kind = [r[4] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array(kind, pa.int32()), pa.array([k is None or k <= most for k in kind])],
                names=["doc_id", "licences", "expressions", "n_notices", "n_broken", "licence_class", "allowed"],
            )

    return run


def scan(df: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, licences, expressions, n_notices, n_broken, licence_class,
    allowed) of every row; allowed: without findings, or of a class up to `most`."""
    return need(df, "doc_id", "text").mapInArrow(_scanner(most), f"doc_id {kind(df, 'doc_id')}, licences array<string>, expressions array<string>, n_notices long, n_broken long, licence_class int, allowed boolean")

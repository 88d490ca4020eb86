"""Column expressions over draft text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from glossaleaf.schemas import SPAN

# The characters str.strip() removes and \s matches in a Python str pattern.
PY_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
PY_SPACE_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
)
# The bracket patterns.
BRACKET = r"\[[^\]]+\]"
BRACKET_GREEDY = r"\[.+\]"


def brackets(draft: Column) -> Column:
    """All bracketed expressions, brackets kept; ``[]`` is not one."""
    return F.regexp_extract_all(draft, F.lit(BRACKET), F.lit(0))


def without_brackets(draft: Column, greedy: bool = False) -> Column:
    """The draft with its bracketed parts cut out.

    ``greedy`` cuts from the first ``[`` to the last ``]`` of each line.
    """
    return F.regexp_replace(draft, BRACKET_GREEDY if greedy else BRACKET, "")


def annotation_text(expressions: Column) -> Column:
    """The bracketed expressions as one text, the input of language detection."""
    return F.array_join(expressions, " ")


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(PY_SPACE))


def drop_square_brackets(value: Column) -> Column:
    return F.translate(value, "[]", "")


def flat_space(value: Column) -> Column:
    """Every white-space character as one blank; positions stay the same."""
    return F.translate(value, PY_SPACE, " " * len(PY_SPACE))


def single_spans(body: Column, phrases: Column) -> Column:
    """Per phrase the span of its one literal occurrence in ``body``; null if it occurs
    never, more than once, or is empty. 0-based, half-open, in code points. A null body or list
    gives null.

    An automaton of all phrases reads the body once, so the time is in proportion to the body and
    the phrases together.
    """
    return _single_spans(body, phrases)


@F.pandas_udf(T.ArrayType(SPAN))
def _single_spans(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for bodies, lists in batches:
        yield pd.Series([_only_spans(b, p) if b is not None and p is not None else None for b, p in zip(bodies, lists)], dtype=object)


def _only_spans(body: str, phrases: Iterable[str]) -> list[dict | None]:
    """A phrase that overlaps itself occurs again only behind its first place."""
    automaton = ahocorasick.Automaton()
    for phrase in phrases:
        if phrase:
            automaton.add_word(phrase, phrase)
    first: dict[str, int | None] = {}
    if len(automaton):
        automaton.make_automaton()
        for last, phrase in automaton.iter(body):
            start = last + 1 - len(phrase)
            if phrase not in first:
                first[phrase] = start
            elif first[phrase] is not None and start >= first[phrase] + len(phrase):
                first[phrase] = None
    found = {p: {"start": s, "end": s + len(p)} for p, s in first.items() if s is not None}
    return [found.get(p) for p in phrases]


SUBSTITUTED = T.StructType(
    [T.StructField("before", T.ArrayType(SPAN)), T.StructField("replaced", T.StringType()), T.StructField("after", T.ArrayType(SPAN))]
)


# drafts that are Python objects at a time; the rest of a batch stays in Arrow
AT_ONCE = 64


@F.arrow_udf(SUBSTITUTED)
def substituted(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """(body, old, new) to the spans of each old without its brackets in the body, white space being
    alike, the body with each old replaced by its new, and the spans of the new there. What follows a miss is null."""
    other_space = re.compile(f"[{PY_SPACE.replace(' ', '')}]")
    brackets_off = str.maketrans("", "", "[]")

    def flat(value):
        return other_space.sub(" ", value)

    def one(body, old, new):
        if body is None or old is None:
            return dict.fromkeys(SUBSTITUTED.names)
        before = _only_spans(flat(body), [o and flat(o.translate(brackets_off)) for o in old])
        if None in before:
            return {"before": before}
        replaced = replace_all(body, old, new)
        return {"before": before, "replaced": replaced, "after": _only_spans(replaced, new)}

    kind = to_arrow_type(SUBSTITUTED)
    for columns in batches:
        made = []
        for at in range(0, len(columns[0]), AT_ONCE):
            some = [c.slice(at, AT_ONCE).to_pylist() for c in columns]
            made.append(pa.array([one(*row) for row in zip(*some)], kind))
        yield pa.concat_arrays(made) if made else pa.array([], kind)


def replace_all(body: str, old: Iterable[str], new: Iterable[str]) -> str:
    """Bracketed parts that do not nest are replaced side by side: no replacement can make or break
    another, unless it brings brackets itself. Anything else goes one after the other."""
    pairs = dict(zip(reversed(list(old)), reversed(list(new))))
    apart = all(re.fullmatch(BRACKET, o) and "[" not in o[1:] for o in pairs) and not any(c in n for n in pairs.values() for c in "[]")
    if apart and not re.search(r"\[[^\]]*\[", body):
        return re.sub(BRACKET, lambda m: pairs.get(m[0], m[0]), body)
    for o, n in zip(old, new):
        body = body.replace(o, n) if o else body
    return body


def all_found(spans: Column) -> Column:
    return F.forall(spans, lambda s: s.isNotNull())

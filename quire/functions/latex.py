r"""LaTeX clean-up. Regular expressions run in the JVM; the two scanners that need a stack (braces, pairs of \left and \right)
are plain functions behind one vectorised UDF."""

from __future__ import annotations

import re
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import let

#: Environments that are balanced, delimiters that may follow \left and \right, commands that go, and replacements, in order.
ENVIRONMENTS = ("array", "matrix", "pmatrix", "bmatrix", "vmatrix", "Bmatrix", "Vmatrix", "cases", "aligned", "gathered", "align", "align*")
DELIMITERS = (
    "(", ")", "[", "]", "{", "}", "/", "|", r"\{", r"\}", r"\lceil", r"\rceil", r"\lfloor", r"\rfloor", r"\backslash",
    r"\uparrow", r"\downarrow", r"\Uparrow", r"\Downarrow", r"\|", r"\.",
)
DROPPED = ("lefteqn", "boldmath", "ensuremath", "centering", "textsubscript", "sides", "textsl", "textcent", "emph", "protect", "null")
REPLACEMENTS = (
    (r"\underbar", r"\underline"), (r"\Bar", r"\hat"), (r"\Hat", r"\hat"), (r"\Tilde", r"\tilde"), (r"\slash", "/"), (r"\textperthousand", "‰"), (r"\sun", "☉"),
    (r"\textunderscore", r"\_"), (r"\fint", "⨏"), ("\\up ", "\\ "), (r"\vline = ", r"\models "), (r"\vDash ", r"\models "), (r"\sq \sqcup ", r"\square "),
    (r"\copyright", "©"), (r"\Dot", r"\dot"),
)


def _escaped(s: str, i: int) -> bool:
    j = i
    while j and s[j - 1] == "\\":
        j -= 1
    return (i - j) % 2 == 1


def drop_unpaired_braces(s: str) -> str:
    """Without braces that have no partner; escaped ones are text."""
    open_, bad = [], set()
    for m in re.finditer(r"[{}]", s):
        i = m.start()
        if _escaped(s, i):
            continue
        if m[0] == "{":
            open_.append(i)
        elif open_:
            open_.pop()
        else:
            bad.add(i)
    bad.update(open_)
    return "".join(c for i, c in enumerate(s) if i not in bad)


def _group_end(s: str, start: int, depth: int) -> int | None:
    """Place of the brace that closes the group around ``start``."""
    level = depth
    for m in re.compile(r"[{}]").finditer(s, start):
        if _escaped(s, m.start()):
            continue
        level += 1 if m[0] == "{" else -1
        if level < depth:
            return m.start()
    return None


def move_rights(s: str) -> str:
    r"""Moves a \right with its delimiter to the end of its \left's group where the two stand at different depths of braces."""
    depth, lefts, moves = 0, [], []
    i, n = 0, len(s)
    while i < n:
        if _escaped(s, i):
            i += 1
        elif s.startswith(r"\left", i) and i + 5 < n:
            lefts.append((i, depth))
            i += 6
        elif s.startswith(r"\right", i) and i + 6 < n:
            if lefts:
                at, was = lefts.pop()
                if was != depth and (to := _group_end(s, at, was)) is not None:
                    moves.append((i, to))
            i += 7
        else:
            depth = depth + 1 if s[i] == "{" else max(0, depth - 1) if s[i] == "}" else depth
            i += 1
    # Places are those before any move; the rearmost is moved first.
    for at, to in sorted(moves, reverse=True):
        end = at + 7
        if end <= len(s):
            part, s = s[at:end], s[:at] + s[end:]
            to = min(to, len(s))
            s = s[:to] + part + s[to:]
    return s


def balance_left_right(s: str) -> str:
    r"""\left and \right with a delimiter that isn't known get a dot instead of what follows up to white space. If their numbers are then equal,
    misplaced \right are moved, else all of both are taken out."""

    def known(m: re.Match) -> str:
        return m[0] if m[2] in DELIMITERS else f"{m[1]}."

    for side in ("left", "right"):
        s = re.sub(rf"(\\{side})(\S*)", known, s)
    lefts, rights = (len(re.findall(rf"\\{side}(?![a-zA-Z])", s)) for side in ("left", "right"))
    return move_rights(s) if lefts == rights else re.sub(r"\\(?:left|right)\.?", "", s)


@F.pandas_udf(T.StringType())
def paired_braces(s: pd.Series) -> pd.Series:
    return s.map(drop_unpaired_braces, na_action="ignore")


@F.pandas_udf(T.StringType())
def paired_sides(s: pd.Series) -> pd.Series:
    return s.map(balance_left_right, na_action="ignore")


@F.pandas_udf(T.StringType())
def _scanned(s: pd.Series) -> pd.Series:
    return s.map(lambda x: balance_left_right(drop_unpaired_braces(x)), na_action="ignore")


def without_sides(s: Column) -> Column:
    return F.regexp_replace(s, r"\\left\.?|\\right\.?", "")


def command_count(s: Column, command: str) -> Column:
    r"""How often a command stands that no letter follows."""
    return F.regexp_count(s, F.lit(rf"\\{command}(?![a-zA-Z])"))


def balanced_environments(s: Column) -> Column:
    r"""Missing \begin are put in front, with the format that the environment's first \begin has (an array's is {c} without), missing \end behind."""
    for env in ENVIRONMENTS:
        s = let(s, partial(_balanced, env))
    return s


def _balanced(env: str, s: Column) -> Column:
    begins, ends = (F.regexp_count(s, F.lit(rf"\\{side}\{{\Q{env}\E\}}")) for side in ("begin", "end"))
    found = rf"\\begin\{{\Q{env}\E\}}(\{{[^}}]*\}})"
    form = F.when(s.rlike(found), F.regexp_extract(s, found, 1)).otherwise(F.lit("{c}" if env == "array" else ""))
    before = F.repeat(F.concat(F.lit(rf"\begin{{{env}}}"), form, F.lit(" ")), F.greatest(ends - begins, F.lit(0)))
    return F.concat(before, s, F.repeat(F.lit(rf" \end{{{env}}}"), F.greatest(begins - ends, F.lit(0))))


def without_up(s: Column) -> Column:
    r"""\upalpha and the like lose their up; \uparrow, \updownarrow, \uplus and \upsilon are names of their own."""
    return F.regexp_replace(s, r"\\up(?!(?:arrow|downarrow|lus|silon)(?![a-zA-Z]))([a-zA-Z]+)", r"\\$1")


def without_unsupported(s: Column) -> Column:
    return F.regexp_replace(s, rf"\\(?:{'|'.join(DROPPED)})", "")


def replaced(s: Column) -> Column:
    for old, new in REPLACEMENTS:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def spaced_backslashes(s: Column) -> Column:
    """A backslash gets a blank behind it unless a special sign, two letters, a line's end or nothing follows; pairs of backslashes are left alone."""
    return F.regexp_replace(s, r"(?<!\\)((?:\\\\)*)\\(?=[^\n])(?![#$%&~_^|\\{} \t\r\u000B\f]|[a-zA-Z]{2})", r"$1\\ ")


def spaced_quads(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\\qquad(?!\s)", r"\\qquad ")


def cleaned(s: Column) -> Column:
    """The whole clean-up, in its fixed order."""
    s = balanced_environments(_scanned(s))
    s = spaced_backslashes(replaced(without_unsupported(without_up(s))))
    return F.regexp_replace(spaced_quads(s), r"\\+\z", "")

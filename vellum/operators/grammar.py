"""What is not regular: balanced braces, BibTeX entries, and the checklist's nesting. Arrow-batched functions from text to arrays of structs; everything after them is Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

BRACE = re.compile(r"[{}]")


def on_batches(f, kind: str):
    """f, from series to series, as a function of a column. The UDF is made when it is used: workers import this module without a session."""
    return lambda column: F.pandas_udf(f, kind)(column)


def _after(text: str, i: int) -> int:
    """Where the group that was opened before i ends: the place after its closing brace, or one past the text."""
    depth = 1
    for m in BRACE.finditer(text, i):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(text) + 1


def braced(heads: str):
    """A function of text: array of (start, end, name, inner) for each match of heads that is followed by a braced argument. Group 1 of heads is the name."""
    pattern = re.compile(heads)

    def find(texts: pd.Series) -> pd.Series:
        def one(text: str) -> list:
            out = []
            for m in pattern.finditer(text or ""):
                if text[m.end() : m.end() + 1] == "{":
                    end = _after(text, m.end() + 1)
                    out.append((m.start(), end, m[1], text[m.end() + 1 : end - 1]))
            return out

        return texts.map(one)

    return on_batches(find, "array<struct<start:int,end:int,name:string,inner:string>>")


# ---- BibTeX ----

ENTRY = re.compile(r"@(\w+)\s*\{")
FIELD = re.compile(r"[ \t\n\r,]*(\w+)\s*=\s*")
QUOTED = re.compile(r'"((?:\\[\s\S]|[^"\\]|\\\Z)*)"?')
BARE = re.compile(r"[\w\-]+")
NOT_ENTRIES = {"comment", "preamble", "string"}


def _fields(body: str) -> dict[str, str]:
    out, i = {}, 0
    while m := FIELD.match(body, i):
        i = m.end()
        if body[i : i + 1] == "{":
            end = _after(body, i + 1)
            value = body[i + 1 : end - 1]
        elif q := QUOTED.match(body, i):
            value, end = q[1], q.end()
        elif b := BARE.match(body, i):
            value, end = b[0], b.end()
        else:
            break
        out[m[1].lower()] = value
        i = end
    return out


def entries(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(key, type, raw fields): the last entry of a key, at the place of its first."""
    found: dict[str, tuple] = {}
    i = 0
    while m := ENTRY.search(text, i):
        kind, i = m[1].lower(), m.end()
        if kind in NOT_ENTRIES:
            continue
        end = min(_after(text, i), len(text))
        key, comma, rest = text[i : end - 1].partition(",")
        i = end
        if comma and key.strip():
            found[key.strip()] = (key.strip(), kind, _fields(rest))
    return list(found.values())


def _bib(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [(k, kind, f) for k, kind, f in entries(t or "")])


parse_bib = on_batches(_bib, "array<struct<key:string,type:string,fields:map<string,string>>>")


# ---- reproducibility checklist ----

STEP = re.compile(r"\\(checksubsection|question|ifyespoints)\b|\\(begin|end)\s*\{\s*itemize\s*\}")
BLANKS = re.compile(r"[ \t\r\n]*")
ITEM = "array<struct<section:string,question:string,options:string,response:string,gate:int>>"


def _argument(text: str, i: int) -> tuple[str | None, int]:
    """The braced argument that starts at i after blanks, and where it ends; (None, i) if there is none."""
    j = BLANKS.match(text, i).end()
    if text[j : j + 1] != "{":
        return None, i
    end = _after(text, j + 1)
    return text[j + 1 : end - 1], end


def checklist_items(text: str, is_gate) -> list[tuple]:
    """(section, question, options, response, number of the gate's item): raw fragments in order.

    A gate owns the items of the list that opens right after it, at that list's depth and below.
    """
    out: list[tuple] = []
    section = None
    depth, waiting, owner, level = 0, None, None, 0
    i = 0
    while m := STEP.search(text, i):
        i = m.end()
        if m[1] == "checksubsection":
            name, i = _argument(text, i)
            section = section if name is None else name
            depth, waiting, owner = 0, None, None
        elif m[1] == "question":
            question, i = _argument(text, i)
            if question is None:
                continue
            options, i = _argument(text, i)
            following = STEP.search(text, i)
            response = text[i : following.start() if following else len(text)]
            out.append((section, question, options or "", response, owner if owner is not None and depth >= level else None))
            waiting = len(out) - 1 if is_gate(question, options or "") else None
        elif m[1] == "ifyespoints":
            _, i = _argument(text, i)
        elif m[2] == "begin":
            depth += 1
            if waiting is not None:
                owner, level, waiting = waiting, depth, None
        else:
            waiting = None
            if owner is not None and depth <= level:
                owner = None
            depth = max(0, depth - 1)
    return out


def _plain(s: str) -> str:
    """As text.flatten_answer does it, for telling gates while parsing."""
    for _ in range(3):
        s = re.sub(r"\\(?:textbf|textit|emph|texttt|textsc|textsf|textrm)\s*\{([^{}]*)\}", r"\1", s)
    return " ".join(re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+\*?", " ", s)).replace("~", " ").split())


def opens_points(question: str, options: str) -> bool:
    """A gate is a yes/no question about what the paper does."""
    return re.findall("[a-z]+", options.lower()) == ["yes", "no"] and _plain(question).lower().startswith("does this paper")


def _checklist(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: checklist_items(re.sub(r"(?<!\\)%[^\n]*", "", t or ""), opens_points))


parse_checklist = on_batches(_checklist, ITEM)


# ---- numbers ----


def _general(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if pd.isna(v) else f"{v:g}")


#: C's %g, which format_string does not give.
general_format = on_batches(_general, "string")

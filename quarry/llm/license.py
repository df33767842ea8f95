"""Licence scan: an Aho-Corasick pass over the words, and a parser for tag expressions.

The automaton holds notice phrases as word sequences and the tag that announces a
licence expression. An expression is put into reverse Polish order by the
shunting-yard rule (with binds tightest, then and, then or) and evaluated to its
simplest form: chains of one operator are flat, and what another part already asks for
or allows is gone. Each licence named is a label; where the form leaves a choice, the
form is a label, too ("choice:..."), so that "a or b" and "a and b" differ. An
expression ends where something else begins; one that doesn't parse adds no labels.

Defined cases: a null or empty text has no words, no places and no labels, score 0;
matches may overlap and repeat, each place counts; rows are independent, those of a
null or repeated doc_id, too; texts are scanned whole, in time linear in their length;
names that only stand for one licence in two ways have one label (see canonical).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from quarry.llm.common import alnum_words, binary_column, clashless

#: The phrases of the contract.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notice phrases that add labels of their own.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "the mit license": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc0": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
_LINE = re.compile(r"spdx[-_ ]licen[sc]e[-_ ]identifier\s*:?[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?|[^\s()]")
#: How names of licences begin in tag expressions, beside "licenseref-".
FAMILIES = frozenset("0bsd afl agpl apache artistic blueoak boost bsd bsl cc cc0 cddl cecill cpl ecl efl epl eupl gfdl gpl icu isc lgpl lppl mit mpl ms mulanpsl ncsa odbl ofl openssl osl php postgresql psf python ruby sspl unicode unlicense upl vim wtfpl x11 zlib zpl".split())
#: How much one kind of evidence is worth on its own.
WORTH = {"base": 0.9, "notice": 0.6, "expression": 0.95}
_BINDS = {"or": 1, "and": 2, "with": 3}


def canonical(name: str) -> str:
    """One label a licence: versions without ".0", none for Creative Commons, "only" unsaid, "+" as "or later"."""
    name = re.sub(r"\.0(?![0-9.])", "", name.lower())
    name = re.sub(r"\+$", "-or-later", re.sub(r"-only$", "", name))
    return re.sub(r"-[0-9][0-9.]*$", "", name) if name.startswith("cc-") else name


def is_licence(name: str) -> bool:
    return name.startswith("licenseref-") or re.split(r"[-0-9]", name, maxsplit=1)[0] in FAMILIES or name.split("-")[0] in FAMILIES


def to_postfix(expression: str, known=None) -> list[str]:
    """Reverse Polish order of a licence expression, lower-cased. ValueError where it isn't one.

    known tells names of licences from other words: with it, the expression ends before an operator that no licence follows.
    """
    tokens = _TOKEN.findall(expression.lower())
    out: list[str] = []
    waiting: list[str] = []
    want_name = True
    for k, token in enumerate(tokens):
        if token == "(":
            if not want_name:
                break  # an expression ends where something else begins
            waiting.append(token)
        elif token == ")":
            if want_name or "(" not in waiting:
                break
            while (top := waiting.pop()) != "(":
                out.append(top)
        elif token in _BINDS:
            if want_name:
                raise ValueError(f"{token} without a licence before it")
            after = next((x for x in tokens[k + 1 :] if x != "("), "")
            if known and token != "with" and not known(after):
                break
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
            want_name = True
        elif want_name and token[0].isalnum() and (known is None or known(token) or waiting[-1:] == ["with"]):
            out.append(token)
            want_name = False
        else:
            break
    if want_name:
        raise ValueError("an expression ends with a licence")
    while waiting:
        if (top := waiting.pop()) == "(":
            raise ValueError("unclosed parenthesis")
        out.append(top)
    return out


@dataclass(frozen=True)
class Form:
    """An expression in its simplest form: a name, or parts that all ("and") or one of which ("or") must hold."""

    kind: str
    parts: frozenset = frozenset()
    name: str = ""

    def names(self) -> set[str]:
        out, left = set(), [self]
        while left:
            form = left.pop()
            out |= {form.name} if form.kind == "name" else set()
            left.extend(form.parts)
        return out

    def __str__(self) -> str:
        if self.kind == "name":
            return self.name
        return f" {self.kind} ".join(sorted(f"({p})" if p.kind != "name" else str(p) for p in self.parts))


def _joined(kind: str, sides: list[Form]) -> Form:
    parts: set[Form] = set()
    for side in sides:
        parts |= side.parts if side.kind == kind else {side}
    # a or (a and b) is a; a and (a or b) is a
    kept = frozenset(p for p in parts if p.kind == "name" or not (p.parts & parts))
    return next(iter(kept)) if len(kept) == 1 else Form(kind, kept)


def evaluate(postfix: list[str]) -> Form:
    """The simplest form of an expression; a chain of one operator is joined at once."""
    stack: list[tuple[str, list[Form]]] = []  # an operator's sides wait until another operator comes

    def settled(entry: tuple[str, list[Form]]) -> Form:
        kind, sides = entry
        return sides[0] if len(sides) == 1 else _joined(kind, sides)

    for token in postfix:
        if token not in _BINDS:
            stack.append(("", [Form("name", name=canonical(token))]))
            continue
        if len(stack) < 2:
            raise ValueError("an operator lacks a side")
        right, left = stack.pop(), stack.pop()
        if token == "with":
            exception, held = settled(right), settled(left)
            if exception.kind != "name" or held.kind != "name":
                raise ValueError("with joins a licence and an exception")
            stack.append(("", [Form("name", name=f"{held.name} with {exception.name}")]))
        elif left[0] == token:
            left[1].append(settled(right))
            stack.append(left)
        else:
            stack.append((token, [settled(left), settled(right)]))
    if len(stack) != 1:
        raise ValueError("operators are missing")
    return settled(stack[0])


def choices(form: Form) -> bool:
    """Whether the form leaves a choice between licences."""
    return form.kind == "or" or any(p.kind == "or" for p in form.parts)


def automaton(phrases: dict[str, str], notices: dict[str, str]):
    import ahocorasick

    found: dict[str, list[tuple[str, str, int]]] = {}
    for kind, table in (("base", phrases), ("notice", notices), ("tag", {TAG: ""})):
        for phrase, label in table.items():
            found.setdefault(f" {phrase} ", []).append((kind, label, len(phrase) + 2))
    out = ahocorasick.Automaton()
    for phrase, what in found.items():
        out.add_word(phrase, what)
    out.make_automaton()
    return out


def scan_text(text: bytes, machine) -> dict:
    words = alnum_words(text)
    joined = f" {b' '.join(words).decode()} " if words else ""
    starts = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 32)[:-1]  # the space before each word
    places, base, more, kinds, tagged = [], set(), set(), set(), False
    for end, whats in machine.iter(joined):
        for kind, label, length in whats:
            if kind == "tag":
                tagged = True
                continue
            kinds.add(kind)
            (base if kind == "base" else more).add(label)
            if kind == "base":
                places.append(end - length + 1)
    for line in _LINE.findall(text.decode()) if tagged else ():
        try:
            form = evaluate(to_postfix(line, is_licence))
        except ValueError:
            continue
        kinds.add("expression")
        more |= form.names()
        if choices(form):
            more.add(f"choice:{form}")
    places = np.searchsorted(starts, places).tolist()
    miss = 1.0
    for kind in sorted(kinds):
        miss *= 1 - WORTH[kind]
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | more)),
        "score": 1 - miss if kinds else 0.0,
    }


def scan_documents(docs: DataFrame, phrases=None, notices=None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document with its words, base places, labels and a score from 0 to 1."""
    phrases, notices = phrases or BASE, NOTICES if notices is None else notices
    fields = {"n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}
    kinds = {"bigint": "int64", "string": "string", "double": "float64"}

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        machine = automaton(phrases, notices)
        for batch in batches:
            rows = [scan_text(t, machine) for t in binary_column(batch, text_column)]
            columns = [pa.array([r[k] for r in rows], getattr(pa, kinds[v])()) for k, v in fields.items()]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *columns], [id_column, *fields])

    schema = f"`{id_column}` {dict(docs.dtypes)[id_column]}, " + ", ".join(f"{k} {v}" for k, v in fields.items())
    return clashless(docs, id_column, text_column).mapInArrow(scan, schema)

"""Order-dependent text rules that built-in expressions cannot state: plain functions, wrapped where they are used."""

from __future__ import annotations

import re

from .. import config as C

_NUMBERED = re.compile(C.NUMBERED)
_FILL = re.compile(C.FILL_IN)
_LETTER = re.compile(r"[^\W\d_]")
_STOPS, _COLONS = (".", "!", "?", "؟"), (":", "：")
_ABBREVIATED = re.compile(r"(?:\b(?:" + "|".join(C.ABBREVIATIONS) + r")\.|\b[^\W\d_]\.|\b\d+\.)\Z")
_RTL = re.compile("[" + "".join(f"{chr(int(a, 16))}-{chr(int(b, 16))}" for a, b in C.RTL) + "]")
_ALONE = re.compile(rf"(?<!\S)[{C.BULLETS}](?!\S)")
_BARE_NUMBER = re.compile(r"(?<!\S)[\d%/.,]+\s*\Z")


def bare_label(s: str) -> bool:
    return len(s) <= C.BARE_MAX and bool(_LETTER.search(s)) and not re.search("[:：]", s) and not s.endswith((*_STOPS, ";", ",", "،"))


def bullet(s: str) -> bool:
    return bool(s) and s[0] in C.BULLETS and (len(s) == 1 or s[1].isspace())


def label_value(s: str) -> bool:
    parts = re.split("[:：]", s, maxsplit=1)
    return len(parts) == 2 and len(parts[0]) <= C.LABEL_MAX and bool(_LETTER.search(parts[0])) and bool(parts[1].strip())


def form_row(s: str) -> bool:
    return label_value(s) and len(re.split("[:：]", s, maxsplit=1)[1].strip()) <= C.VALUE_MAX


def joins(label: str, value: str) -> bool:
    return bare_label(label) and "\n" not in label + value and len(value) <= C.JOINED_MAX and not (_NUMBERED.match(value) or bullet(value) or value.endswith(_STOPS))


def split_at_stops(line: str) -> list[str]:
    """Sentences of a line: cut at blanks behind an end mark, except behind an abbreviation, initial or number."""
    out: list[str] = []
    for piece in re.split(r"(?<=[.!?؟])\s+", line):
        if out and _ABBREVIATED.search(out[-1]):
            out[-1] += " " + piece
        else:
            out.append(piece)
    return [s for s in map(str.strip, out) if s]


def list_items(line: str) -> list[str]:
    """What stands between bullets that stand alone. In right-to-left text a bare number before a bullet belongs behind it."""
    out, at, carried = [], 0, ""
    for m in _ALONE.finditer(line):
        before, moved = line[at : m.start()], ""
        letter = next((c for c in line[m.start() :] if c.isalpha() and c not in "Øç"), "")
        number = _BARE_NUMBER.search(before) if _RTL.match(letter) else None
        if number:
            before, moved = before[: number.start()], number.group().strip() + " "
        out.append(carried + (before.lstrip() if carried else before))
        at, carried = m.end(), moved
    rest = line[at:]
    return [*out, carried + (rest.lstrip() if carried else rest)]


def sentences_of(text: str | None) -> list[str]:
    out: list[str] = []
    for line in filter(None, map(str.strip, plain(text or "").split("\n"))):
        if out and len(line) > len(out[-1]) and line.startswith(out[-1]):
            out.pop()  # the line says again what came before, and more
        # a row behind an introduction keeps its own label, so its first sentence is joined to nothing
        own = bool(out) and out[-1].endswith(_COLONS) and form_row(line)
        glue = _glue(out[-1], line) if out and not own else None
        for i, s in enumerate(s for item in list_items(line) for s in split_at_stops(item)):
            if i == 0 and glue:
                out[-1] += glue + s
            elif out and out[-1].endswith((*_COLONS, "?", "؟")) and not (i == 0 and own):
                out[-1] += " " + s
            else:
                out.append(s)
    return out


def _glue(last: str, line: str) -> str | None:
    """What joins a line to the sentence before it, beyond lead-ins; null if it begins a sentence of its own."""
    if joins(last, line):
        return ": "
    if bullet(line):
        return None
    wrapped = len(last) > C.PROSE_MIN and not last.endswith((*_STOPS, *_COLONS, ";")) and not label_value(last) and not label_value(line)
    return " " if bare_label(last) or wrapped else None


def plain(text: str) -> str:
    return re.sub(r"\*\*|</?u>", "", text)


def table_sentences(lines: list[str]) -> list[str]:
    """Rows of a Markdown table as sentences: 'head: cell, …' with three heads or more, else 'first: rest'."""
    rows = [[c for c in map(str.strip, line.split("|")) if c] for line in lines]
    rows = [r for r in rows if not all(set(c) <= set("-: ") for c in r)]
    if len(rows) > 1 and len(rows[0]) >= 3:
        heads = rows[0]
        return [", ".join(f"{heads[i]}: {c}" if i < len(heads) else c for i, c in enumerate(r)) for r in rows[1:]]
    return [f"{r[0]}: {', '.join(r[1:])}" if len(r) > 1 else r[0] for r in rows]


def clean_paragraph(par: str) -> str:
    """A paragraph without markup and fill-in lines, its tables as sentences."""
    out, table = [], []
    for line in [*map(str.strip, plain(par).split("\n")), ""]:
        if line.startswith("|"):
            table.append(line)
            continue
        out += table_sentences(table)
        table = []
        line = " ".join(_FILL.sub(" ", line).split())
        if line:
            out.append(line)
    return "\n".join(out)


def chunk_pages(pages: list[tuple[int, str]], heading_paragraph: bool = False) -> list[tuple[int, str, str | None]]:
    """(page, text, section) of the paragraphs of a document's pages, in order."""
    out: list[list] = []
    section = None
    for page, text in pages:
        heads = [x for x in (text or "").split("\n") if x.startswith("#")]
        first = heads[0].lstrip("# ").strip() if heads else ""
        for par in (text or "").split("\n\n"):
            body = clean_paragraph(par.strip())
            heading = par.lstrip().startswith("#")
            if not body or heading_paragraph and par.startswith("#"):
                continue
            body = (f"{first}. {body}" if first else body) if heading_paragraph else body.lstrip("#").lstrip()
            last = out[-1] if out and out[-1][0] == page else None
            if last and last[1].endswith(_COLONS):
                last[1] += " " + body
            elif last and not heading and last[1] != (section or "") and joins(last[1], body):
                last[1] += ": " + body
            else:
                out.append([page, body, None if heading else section])
            if heading:
                section = body
    return [tuple(x) for x in out]


def printed_rows(par: str, lines: list[str]) -> str | None:
    """A paragraph of run-together rows cut where the printed lines end; null unless those lines use up all of it, give
    three rows or more, and half of them are rows. Letters and digits alone are compared."""
    key = lambda t: "".join(c.lower() for c in t if c.isalnum())
    left = key(plain(par))
    keyed = [(key(x), " ".join(x.split())) for x in lines]
    keyed = [x for x in keyed if x[0]]
    begin = next((i for i, (k, _) in enumerate(keyed) if left.startswith(k)), len(keyed))
    taken = []
    for k, line in keyed[begin:]:
        if not left:
            break
        if not left.startswith(k):
            return None
        left = left[len(k) :]
        taken.append(line)
    rows = sum(map(form_row, taken))
    return "\n".join(taken) if not left and rows >= 3 and 2 * rows >= len(taken) else None


def nms(boxes: list[tuple[float, float, float, float, float]], most: float = C.MAX_OVERLAP) -> list[int]:
    """Indices of boxes (score, l, t, r, b) kept by greedy suppression, strongest first, the first of equals."""
    kept: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda i: -boxes[i][0]):
        _, left, top, right, bottom = boxes[i]
        ok = True
        for j in kept:
            _, a, b, c, d = boxes[j]
            w, h = min(right, c) - max(left, a), min(bottom, d) - max(top, b)
            inter = max(0.0, w) * max(0.0, h)
            if inter / ((right - left) * (bottom - top) + (c - a) * (d - b) - inter + 1e-9) > most:
                ok = False
                break
        if ok:
            kept.append(i)
    return sorted(kept)


def visual_rows(tops: list[float], bottoms: list[float]) -> list[int]:
    """Row number of each piece: by top, joining the last row on half the smaller height, which then widens."""
    rows, out = [], [0] * len(tops)
    for i in sorted(range(len(tops)), key=lambda i: tops[i]):
        top, bottom = min(tops[i], bottoms[i] - 1), bottoms[i]
        if rows:
            r = rows[-1]
            if min(r[1], bottom) - max(r[0], top) >= 0.5 * min(r[1] - r[0], bottom - top):
                r[0], r[1] = min(r[0], top), max(r[1], bottom)
                out[i] = len(rows) - 1
                continue
        rows.append([top, bottom])
        out[i] = len(rows) - 1
    return out


def first_rows(tops: list[float], bottoms: list[float]) -> list[int]:
    """Row number of each line, from top to bottom, joining the last row on half the smaller height with its first line."""
    out, first, n = [0] * len(tops), None, -1
    for i in sorted(range(len(tops)), key=lambda i: tops[i]):
        if first is None or min(bottoms[first], bottoms[i]) - max(tops[first], tops[i]) < 0.5 * min(bottoms[first] - tops[first], bottoms[i] - tops[i]):
            first, n = i, n + 1
        out[i] = n
    return out

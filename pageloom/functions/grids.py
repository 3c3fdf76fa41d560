"""Pages that are forms, read row by row: pieces of PDF text (y upward) and lines of words from pictures (y downward)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .. import config as C
from .folds import _FILL, first_rows, visual_rows

_COLONS = (":", "：")
_OCR_RTL = re.compile("[" + "".join(f"{chr(int(a, 16))}-{chr(int(b, 16))}" for a, b in C.OCR_RTL) + "]")


def upper_median(values: list[float], default: float) -> float:
    return sorted(values)[len(values) // 2] if values else default


def letters(text: str) -> int:
    return sum(map(str.isalpha, text))


def mostly_rtl(text: str) -> bool:
    return 2 * len(_OCR_RTL.findall(text)) > letters(text)


# PDF text


@dataclass
class Piece:
    """A run of text: left edge, lower edge, size, and whether it is what a form field holds."""

    x: float
    y: float
    width: float
    height: float
    text: str
    field: bool


def rows_of(pieces: list[Piece]) -> list[list[Piece]]:
    """The visual rows of a page from top to bottom, each from left to right."""
    numbers = visual_rows([-(p.y + p.height) for p in pieces], [-p.y for p in pieces])
    rows: list[list[Piece]] = [[] for _ in range(max(numbers, default=-1) + 1)]
    for i in sorted(range(len(pieces)), key=lambda i: -(pieces[i].y + pieces[i].height)):
        rows[numbers[i]].append(pieces[i])
    return [sorted(row, key=lambda p: p.x) for row in rows]


def printed_lines(pieces: list[Piece]) -> list[str]:
    return [" ".join(p.text.strip() for p in row) for row in rows_of(pieces)]


def _row_text(row: list[Piece], gap: float) -> str:
    """A row as 'label: value', with one colon at its first wide space."""
    said, valued, edge = "", False, None
    for p in row:
        own = " ".join(_FILL.sub(" ", p.text.strip()).split())
        if not own:
            continue
        wide = edge is None or p.x - edge >= gap
        edge = p.x + p.width
        if said and own.startswith(said):
            said, valued = own, True  # a field that says its label again
        elif said:
            said += (": " if wide and not valued and not said.endswith(_COLONS) else " ") + own
            valued = valued or wide
        else:
            said = own
    return said


def piece_grid(pieces: list[Piece]) -> str | None:
    """A page's text row by row, if five rows or more are there and a third of them have a short label with more text
    well to its right; else null. Large type alone on its row is a heading."""
    size = max(1.0, upper_median([p.height for p in pieces if not p.field], C.DEFAULT_HEIGHT))
    rows, gap = rows_of(pieces), 2.0 * size

    def labelled(row: list[Piece]) -> bool:
        chars = 0
        for p, after in zip(row, row[1:], strict=False):
            chars += len(p.text.strip())
            if chars <= C.LABEL_MAX and after.x - (p.x + p.width) >= gap:
                return True
        return False

    if len(rows) < 5 or 3 * sum(map(labelled, rows)) < len(rows):
        return None
    out, last = "", None
    for row in rows:
        said = _row_text(row, gap)
        if not said:
            continue
        heading = len(row) == 1 and not row[0].field and row[0].height >= 1.3 * size
        if last is not None:
            apart = last[0] - max(p.y + max(p.height, 1.0) for p in row) > 2.0 * size
            out += "\n\n" if heading or last[1] or apart else "\n"
        out += ("# " if heading else "") + said
        last = (min(p.y for p in row), heading)
    return out


# Words from pictures


@dataclass
class Line:
    """Words of one line with their edges, and the line's box."""

    block: int
    words: list[tuple[str, float, float]] = field(default_factory=list)
    left: float = float("inf")
    top: float = float("inf")
    right: float = float("-inf")
    bottom: float = float("-inf")

    def add(self, text: str, left: float, top: float, right: float, bottom: float) -> None:
        self.words.append((text, left, right))
        self.left, self.top = min(self.left, left), min(self.top, top)
        self.right, self.bottom = max(self.right, right), max(self.bottom, bottom)

    @property
    def text(self) -> str:
        return " ".join(w[0] for w in self.words)

    @property
    def height(self) -> float:
        return self.bottom - self.top


def line_rows(lines: list[Line]) -> list[list[int]]:
    """Indices of lines by row, rows from top to bottom; a line joins a row by its overlap with the row's first line."""
    numbers = first_rows([x.top for x in lines], [x.bottom for x in lines])
    rows: list[list[int]] = [[] for _ in range(max(numbers, default=-1) + 1)]
    for i in sorted(range(len(lines)), key=lambda i: lines[i].top):
        rows[numbers[i]].append(i)
    return rows


def cells_of(lines: list[Line], median: float) -> list[tuple[str, float, float]]:
    """(text, left, right) of a row's words, apart where the space is more than 1.5 medians."""
    out: list[tuple[str, float, float]] = []
    for word, left, right in sorted((w for x in lines for w in x.words), key=lambda w: w[1]):
        if out and left - out[-1][2] <= C.CELL_GAP * median:
            text, start, edge = out.pop()
            out.append((f"{text} {word}", start, max(edge, right)))
        else:
            out.append((word, left, right))
    return out


def stacked_pair(upper: list[Line], lower: list[Line], median: float) -> list[str] | None:
    """'label: value' of a row of labels over a row of values, if every value begins where a label does; else null."""
    labels, values = cells_of(upper, median), cells_of(lower, median)
    edge = 2 if mostly_rtl("".join(v[0] for v in values)) else 1
    high, low = max(x.height for x in upper), max(x.height for x in lower)
    near = min(x.top for x in lower) - max(x.bottom for x in upper) <= 1.5 * median
    sized = high <= 1.1 * low and (len(labels) > 1 or high <= 0.85 * low)
    named = all(len(t) <= C.LABEL_MAX and letters(t) >= 3 and not t.endswith((".", "!", "?", *_COLONS)) for t, _, _ in labels)
    short = all(len(t) <= C.VALUE_MAX and ". " not in t for t, _, _ in values)
    if not (values and near and sized and named and short):
        return None
    pairs = [(next((k[0] for k in labels if abs(k[edge] - v[edge]) <= median), None), v[0]) for v in values]
    return None if any(k is None for k, _ in pairs) else [f"{k}: {v}" for k, v in pairs]


def stacked_fields(lines: list[Line], median: float) -> tuple[dict[int, str], set[int]]:
    """Rows of 'label: value' by the first line they stand for, and all lines that they use up."""
    found, used = {}, set()
    rows, k = line_rows(lines), 0
    while median > 0 and k + 1 < len(rows):
        pair = stacked_pair([lines[i] for i in rows[k]], [lines[i] for i in rows[k + 1]], median)
        if pair:
            found[min(rows[k])] = "\n".join(pair)
            used.update(rows[k] + rows[k + 1])
        k += 2 if pair else 1
    return found, used


def _across(row: list[Line]) -> list[tuple[Line, float]]:
    """A row's lines in reading order with the space before each."""
    if mostly_rtl("".join(x.text for x in row)):
        row = sorted(row, key=lambda x: -x.right)
        spaces = [a.left - b.right for a, b in zip(row, row[1:], strict=False)]
    else:
        row = sorted(row, key=lambda x: x.left)
        spaces = [b.left - a.right for a, b in zip(row, row[1:], strict=False)]
    return list(zip(row, [0.0, *spaces], strict=True))


def line_grid(lines: list[Line], median: float) -> str | None:
    """A page's text row by row, if labels in one block have their values in another, well along the row; else null."""
    if median <= 0:
        return None
    flat, tall = [x for x in lines if x.height <= 3 * median], [x for x in lines if x.height > 3 * median]
    rows, wide = [_across([flat[i] for i in row]) for row in line_rows(flat)], 2.0 * median
    split = labelled = 0
    for row in rows:
        cut = next((i for i in range(1, len(row)) if row[i][1] >= wide and row[i][0].block != row[i - 1][0].block), None)
        if cut is None:
            continue
        split += 1
        parts = [x.text for x, _ in row[:cut]]
        label = " ".join(parts)
        named = letters(label) >= 3 or (letters(label) == 2 and label.rstrip().endswith(_COLONS))
        labelled += named and sum(map(len, parts)) <= C.LABEL_MAX
    if labelled < 3 or 4 * labelled < len(rows) or 5 * labelled < 3 * split:
        return None
    out, bottom = "", None
    for row in rows:
        if bottom is not None:
            out += "\n\n" if min(x.top for x, _ in row) - bottom > wide else "\n"
        valued = False
        for i, (x, space) in enumerate(row):
            if i:
                out += ": " if space >= wide and not valued and not out.endswith(_COLONS) else " "
                valued = valued or space >= wide
            out += x.text
        bottom = max(x.bottom for x, _ in row)
    return out + "".join(f"\n\n{x.text}" for x in tall)


def paragraphs(lines: list[Line], median: float) -> str:
    """A page's text by paragraphs, with stacked fields as rows in place of their first line."""
    found, used = stacked_fields(lines, median)
    parts: list[str] = []  # of separator and text in turn
    last, fields = None, False
    for i, x in enumerate(lines):
        if i in found:
            parts += ["\n" if fields else "\n\n", found[i]]
            last, fields = None, True
        elif i not in used:
            near = last is not None and x.block == last.block and x.top - last.bottom <= C.PARAGRAPH_GAP * median
            parts += [" " if near else "\n\n", x.text]
            last, fields = x, False
    return "".join(parts[1:])


def page_text(lines: list[Line]) -> str:
    median = upper_median([x.height for x in lines], 0.0)
    grid = line_grid(lines, median)
    return grid if grid is not None else paragraphs(lines, median)

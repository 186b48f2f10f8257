"""The fold of Q5 (`repair.joined_sideways`): pieces of clipped texts are placed and laid over the lines of their text.

Many texts are read at once: their stems are one array of digests, sorted once a round, and never a row
each. What a stem says of a text depends on that text alone, so nothing of it leaves the task. Of a text
larger than a batch the stems are taken in slices of their digests, and shifts in slices of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GRAM, LEAST_ROWS, MOST_PLACES = 8, 3, 64
#: Characters of a batch of texts, stems of one slice, and pairs of stems made at a time.
BATCH, SLICE, PAIRS = 1 << 18, 1 << 21, 1 << 20


class Text:
    """Lines (n, line) of one text, its pieces [(ord, rows (n, line))] that have no place yet, and places (ord, rows, columns, conflicts)."""

    def __init__(self, key):
        self.key, self.lines, self.pieces, self.places = key, [], [], []

    def shown(self) -> dict[int, list[str]]:
        """What stands in each row, without blanks at its end."""
        at: dict[int, list[str]] = {}
        for n, line in self.lines:
            if n is not None and line is not None:
                at.setdefault(n, []).append(line.rstrip(" "))
        return at

    def sound(self, at: dict[int, list[str]], piece: int, shift: int, columns: int) -> bool:
        """No row that the shift covers contradicts it, and it covers some; at: what is `shown`."""
        met, low, front = False, max(0, columns), max(0, -columns)
        for n, line in self.pieces[piece][1]:
            if n is None or line is None or n + shift not in at:
                continue
            shown = line.rstrip(" ")[front:]
            for base in at[n + shift]:
                inside = base[low:]
                if not (inside.startswith(shown) or shown.startswith(inside)):
                    return False
                met = True
        return met

    def lay(self, piece: int, shift: int, columns: int) -> None:
        """The piece goes over the lines; lines it does not cover move along where it has columns further left."""
        order, rows = self.pieces.pop(piece)
        laid: dict = {}
        for n, line in rows:
            laid.setdefault(None if n is None else n + shift, []).append(line)
        used, done, conflicts, push = set(), [], 0, " " * max(0, -columns)
        for n, line in self.lines:
            if n is None or n not in laid:
                done.append((n, push + line if push and line is not None and line.strip(" ") else line))
                continue
            used.add(n)
            for over in laid[n]:
                grown, equal = _grown(line, over, columns)
                conflicts += not equal
                done.append((n, grown))
        done += [(n, _grown(None, over, columns)[0]) for n, lines in laid.items() if n not in used for over in lines]
        self.lines = done
        self.places.append((order, shift, columns, conflicts))


def _grown(line: str | None, over: str | None, columns: int) -> tuple[str, bool]:
    """A line with a row of a piece at a column, and whether both show the same where they meet; where not, the line stays."""
    base, piece = (line or "").rstrip(" "), (over or "").rstrip(" ")
    at, shown = (columns, piece) if columns >= 0 else (0, piece[-columns:])
    inside = base[at:]
    both = min(len(inside), len(shown))
    equal = inside[:both] == shown[:both]
    if piece and equal:
        grown = base[:at].ljust(at) + shown if len(shown) > len(inside) else base
        front = piece[:-columns].ljust(-columns) if columns < 0 else ""
    else:
        grown, front = base, " " * max(0, -columns)
    return (front + grown).rstrip(" "), equal


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers as digests (splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FACTORS = _mixed(np.arange(GRAM + 1)) | np.uint64(1)


class Rows:
    """The rows with stems of many texts: of (the text), group (text and piece), text (is it a line), n, line (rows of one group and n), first (where it begins)."""

    def __init__(self, texts: list[Text]):
        lines, of, piece, n = [], [], [], []
        for i, t in enumerate(texts):
            for p, rows in enumerate([t.lines, *(rows for _, rows in t.pieces)]):
                for at, line in rows:
                    if line is not None and at is not None and len(line) >= GRAM:
                        lines.append(line)
                        of.append(i)
                        piece.append(p)
                        n.append(at)
        self.of, self.piece, self.n = (np.array(x, np.int64) for x in (of, piece, n))
        self.size = np.fromiter(map(len, lines), np.int64, len(lines))
        self.first = np.cumsum(self.size) - self.size
        changed = lambda *xs: np.cumsum(np.concatenate([[False], np.logical_or.reduce([x[1:] != x[:-1] for x in xs])])) if len(of) else self.of
        self.group, self.line = changed(self.of, self.piece), changed(self.of, self.piece, self.n)
        whole = "".join(lines)
        try:
            self.codes = np.frombuffer(whole.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            self.codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)

    def stems(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(digest, place) of the stems, in as many slices as are needed; all equal ones of a text are in one slice. The last bit of a digest tells whether the row is a line of the text."""
        slices = np.uint64(1 + len(self.codes) // SLICE)
        cuts = sorted({0, len(self.first), *map(int, np.searchsorted(self.first, np.arange(SLICE, len(self.codes) + SLICE, SLICE)))})
        for s in range(int(slices)):
            found = [self._stems(a, b, np.uint64(s), slices) for a, b in zip(cuts, cuts[1:], strict=False)]
            if found:
                yield found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _stems(self, a: int, b: int, s: np.uint64, slices: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        low, ends = self.first[a], self.first[a:b] + self.size[a:b] - self.first[a]
        codes = self.codes[low : low + ends[-1]]
        many = len(codes) - GRAM + 1
        inked = np.zeros(len(codes) + 1, np.int32)
        np.cumsum((codes != 32) & ((codes < 9) | (codes > 13)), out=inked[1:])
        good = inked[GRAM:] - inked[:-GRAM] >= GRAM // 2
        over = (ends[:-1, None] - np.arange(1, GRAM)).ravel()  # places where a stem would reach into the next row
        good[over] = False
        if codes.dtype == np.uint8:  # eight characters are one number
            h = np.ndarray(many, "<u8", codes.tobytes(), strides=(1,)) * FACTORS[GRAM]
        else:
            m = _mixed(codes)
            h = m[:many] * FACTORS[0]
            for i in range(1, GRAM):
                h += m[i : many + i] * FACTORS[i]
        h ^= np.repeat(_mixed(self.of[a:b]), self.size[a:b])[:many]
        h &= ~np.uint64(1)
        h |= np.repeat((self.piece[a:b] == 0).astype(np.uint64), self.size[a:b])[:many]
        at = np.flatnonzero(good if slices == 1 else good & ((h >> np.uint64(20)) % slices == s))
        return h[at], at + low


def _shifts(rows: Rows, met: Met, asked: np.ndarray, least: int) -> list[np.ndarray]:
    """(group, rows, columns, c): how many rows of a piece have a stem, of those in `asked`, that stands in a line so far away; at least `least`."""
    found, slices = [], 1 + int(met.pieces[3, asked].sum()) // (8 * SLICE)
    for s, (piece, text, columns) in ((s, x) for s in range(slices) for x in met.pairs(asked)):
        if slices > 1:
            mine = ((rows.n[text] - rows.n[piece]) * 31 + columns) % slices == s
            piece, text, columns = piece[mine], text[mine], columns[mine]
        if not len(piece):
            continue
        kinds = np.stack([rows.group[piece], rows.n[text] - rows.n[piece], columns])
        low, span = kinds.min(1), np.ptp(kinds, 1) + 1
        if int(span[0]) * int(span[1]) * int(span[2]) < 1 << 62:
            code = ((kinds[0] - low[0]) * span[1] + kinds[1] - low[1]) * span[2] + kinds[2] - low[2]
        else:
            code = np.unique(kinds, axis=1, return_inverse=True)[1].ravel()
        _, first, code = np.unique(code, return_index=True, return_inverse=True)
        many = int(rows.line[-1]) + 1
        once = np.unique(code * many + rows.line[piece]) // many
        found.append(np.vstack([kinds[:, first], np.bincount(once, minlength=len(first))]))
        if len(found) > 1 and sum(x.shape[1] for x in found[1:]) > 8 * SLICE:
            found = [_summed(found)]
    if not found:
        return [np.zeros(0, np.int64)] * 4
    total = _summed(found)
    return list(total[:, total[3] >= least])


def _summed(found: list[np.ndarray]) -> np.ndarray:
    each = np.hstack(found)
    if len(found) == 1:
        return each
    each = each[:, np.lexsort(each[2::-1])]
    starts = np.flatnonzero(np.concatenate([[True], (each[:3, 1:] != each[:3, :-1]).any(0)]))
    return np.vstack([each[:3, starts], np.add.reduceat(each[3], starts)])


class Met:
    """Stems that a text and a piece of it show, neither of them too often. texts: row, column; pieces: row, column, the first of the text's stems that are equal and their count, whether it stands once in both."""

    def __init__(self, rows: Rows):
        texts, pieces, base, self.line = [], [], 0, rows.line
        for h, at in rows.stems():
            if not len(h):
                continue
            order = np.argsort(h)
            h = h[order]
            of_text, h = (h & np.uint64(1)).astype(bool), h >> np.uint64(1)
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size, lines = np.diff(np.append(starts, len(h))), np.add.reduceat(of_text, starts, dtype=np.int64)
            kept = (lines > 0) & (lines <= MOST_PLACES) & (size > lines)
            mine = np.repeat(kept, size)
            at, of_text, lines = at[order[mine]], of_text[mine], lines[kept]
            gram = np.repeat(np.arange(len(lines)), size[kept])
            row = np.searchsorted(rows.first, at, side="right") - 1
            col = at - rows.first[row]
            texts.append(np.stack([row[of_text], col[of_text]]))
            row, col, gram = row[~of_text], col[~of_text], gram[~of_text]
            groups = int(rows.group[-1]) + 1
            _, back, often = np.unique(gram * groups + rows.group[row], return_inverse=True, return_counts=True)
            often = often[back]
            pieces.append(np.stack([row, col, (np.cumsum(lines) - lines)[gram] + base, lines[gram], (often == 1) & (lines[gram] == 1)])[:, often <= MOST_PLACES])
            base += texts[-1].shape[1]
        self.texts = np.hstack(texts) if texts else np.zeros((2, 0), np.int64)
        self.pieces = np.hstack(pieces) if pieces else np.zeros((5, 0), np.int64)

    def pairs(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of a piece, row of the text, columns) of the stems in `asked`, some at a time; all of a line come together."""
        row, col, first, count, _ = self.pieces[:, asked][:, np.argsort(self.pieces[0, asked], kind="stable")]
        done, line, low = np.cumsum(count), self.line[row], 0
        while low < len(row):
            high = max(int(np.searchsorted(done, done[low] - count[low] + PAIRS)), low + 1)
            high = int(np.searchsorted(line, line[high - 1], side="right"))
            r, c = row[low:high], count[low:high]
            text = self.texts[:, np.repeat(first[low:high] - np.cumsum(c) + c, c) + np.arange(c.sum())]
            yield np.repeat(r, c), text[0], text[1] - np.repeat(col[low:high], c)
            low = high


def _chosen(texts: list[Text]) -> list[tuple[int, int, int] | None]:
    """For each text the piece that is placed next, and by which shift of rows and columns."""
    rows = Rows(texts)
    best: list[tuple[int, int, int, int] | None] = [None] * len(texts)
    if not len(rows.n):
        return best
    first_row = np.flatnonzero(np.concatenate([[True], rows.group[1:] != rows.group[:-1]]))
    text_of, piece_of = rows.of[first_row], rows.piece[first_row]

    def offer(group: int, shift: int, columns: int, c: int) -> None:
        i = text_of[group]
        if best[i] is None or c > best[i][3]:  # of as many rows the earlier piece counts
            best[i] = (int(piece_of[group]) - 1, shift, columns, c)

    met = Met(rows)
    group, shift, columns, c = _shifts(rows, met, met.pieces[4] == 1, 1)
    order = np.lexsort((columns, shift, -c, group))
    group, shift, columns, c = (x[order] for x in (group, shift, columns, c))
    same = np.append(group[1:] == group[:-1], False)
    second = np.where(same, np.append(c[1:], 0), 0) if len(c) else c
    sure = np.concatenate([[True], ~same[:-1]])[: len(c)] & (c >= LEAST_ROWS) & (c >= 2 * second)
    for x in zip(*(x[sure].tolist() for x in (group, shift, columns, c)), strict=True):
        offer(*x)

    stuck = np.array([x is None for x in best])
    asked = stuck[rows.of[met.pieces[0]]]
    sound, shown = {}, {}
    for group, shift, columns, c in zip(*(x.tolist() for x in _shifts(rows, met, asked, LEAST_ROWS)), strict=True):
        i = int(text_of[group])
        if i not in shown:
            shown[i] = texts[i].shown()
        if texts[i].sound(shown[i], int(piece_of[group]) - 1, shift, columns):
            sound.setdefault(group, []).append((group, shift, columns, c))
    for _, offers in sorted(sound.items()):
        if len(offers) == 1:
            offer(*offers[0])
    return [x and x[:3] for x in best]


def placed(texts: list[Text]) -> list[Text]:
    """The texts, with all pieces placed that have a place; one piece a text and round, so that the next one meets what this one added."""
    left = [t for t in texts if t.pieces and t.lines and t.key is not None]
    while left:
        chosen, more = _chosen(left), []
        for t, x in zip(left, chosen, strict=True):
            if x is not None:
                t.lay(*x)
                if t.pieces:
                    more.append(t)
        left = more
    return texts


def fold(key: pa.DataType, order: pa.DataType, n: pa.DataType):
    """Rows (key, ord, n, line, part), sorted by key, part, ord and n, to lines (key, n, line) and places (key, ord, rows, columns, conflicts), where `placed`."""
    names = ["key", "n", "line", "placed", "ord", "rows", "columns", "conflicts"]
    kinds = [key, n, pa.string(), pa.bool_(), order, n, pa.int32(), pa.int64()]

    def told(texts: list[Text]) -> pa.RecordBatch:
        out = []
        for t in placed(texts):
            out += [(t.key, n, line, False, None, None, None, None) for n, line in t.lines]
            out += [(t.key, None, None, True, *x) for x in t.places]
        columns = zip(*out, strict=True) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, chars = [], 0
        for batch in batches:
            for of, order_, at, line, part in zip(*[batch.column(c).to_pylist() for c in ("key", "ord", "n", "line", "part")], strict=True):
                if not texts or of != texts[-1].key:
                    if chars >= BATCH:
                        yield told(texts)
                        texts, chars = [], 0
                    texts.append(Text(of))
                if not part:
                    texts[-1].lines.append((at, line))
                elif order_ is not None:
                    if not texts[-1].pieces or texts[-1].pieces[-1][0] != order_:
                        texts[-1].pieces.append((order_, []))
                    texts[-1].pieces[-1][1].append((at, line))
                chars += len(line or "") + 1
        if texts:
            yield told(texts)

    return folded

"""Sheets of old workbooks (.xls): the streams of a compound file, and the cell records of its workbook."""

from __future__ import annotations

import struct
from collections.abc import Iterator

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
END = 0xFFFFFFFA  # numbers from here on are no sectors
BOF, EOF, CONTINUE, FILEPASS, BOUNDSHEET, SST = 0x809, 0x0A, 0x3C, 0x2F, 0x85, 0xFC
LABELSST, LABEL, NUMBER, RK, MULRK, FORMULA, STRING, BOOLERR = 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x205
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}


class Compound:
    """A compound file: chains of sectors, with a directory of streams."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("no compound file")
        self.data = data
        shift, mini = struct.unpack_from("<HH", data, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini
        first_dir, _, self.cutoff, first_mini, _, first_difat, _ = struct.unpack_from("<IIIIIII", data, 48)
        listed = list(struct.unpack_from("<109I", data, 76))
        seen = set()
        while first_difat < END:
            if first_difat in seen:
                raise ValueError("sectors in a circle")
            seen.add(first_difat)
            entries = struct.unpack(f"<{self.size // 4}I", self.sector(first_difat))
            listed += entries[:-1]
            first_difat = entries[-1]
        self.next = [n for s in listed if s < END for n in struct.unpack(f"<{self.size // 4}I", self.sector(s))]
        self.mini_next = [n for s in self.chain(first_mini, self.next) for n in struct.unpack(f"<{self.size // 4}I", self.sector(s))]
        directory = b"".join(map(self.sector, self.chain(first_dir, self.next)))
        self.streams = {}
        for at in range(0, len(directory) - 127, 128):
            length, kind = struct.unpack_from("<HB", directory, at + 64)
            start, size = struct.unpack_from("<II", directory, at + 116)
            if kind in (2, 5):
                self.streams[directory[at : at + max(length - 2, 0)].decode("utf-16-le", "replace")] = (kind, start, size)

    def sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        if at >= len(self.data):
            raise ValueError("a sector beyond the end")
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    def chain(self, first: int, following: list[int]) -> list[int]:
        out = []
        while first < END:
            if first >= len(following) or len(out) > len(following):
                raise ValueError("a broken chain of sectors")
            out.append(first)
            first = following[first]
        return out

    def stream(self, name: str) -> bytes:
        _, start, size = self.streams[name]
        if size >= self.cutoff:
            return b"".join(map(self.sector, self.chain(start, self.next)))[:size]
        root = next(v for v in self.streams.values() if v[0] == 5)
        small = b"".join(map(self.sector, self.chain(root[1], self.next)))
        return b"".join(small[n * self.mini_size : (n + 1) * self.mini_size] for n in self.chain(start, self.mini_next))[:size]


def records(book: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """Kinds of records with their bodies, each a list: what is continued has several."""
    held: tuple[int, list[bytes]] | None = None
    while at + 4 <= len(book):
        kind, size = struct.unpack_from("<HH", book, at)
        body = book[at + 4 : at + 4 + size]
        if len(body) < size:
            raise ValueError("a record beyond the end")
        at += 4 + size
        if kind == CONTINUE and held:
            held[1].append(body)
            continue
        if held:
            yield held
        held = (kind, [body])
    if held:
        yield held


def text_at(body: bytes, at: int, count: int) -> tuple[str, int]:
    """A text of so many characters behind its flags, and where it ends."""
    wide = body[at] & 1
    end = at + 1 + (count << wide)
    return body[at + 1 : end].decode("utf-16-le" if wide else "latin-1", "replace"), end


def shared_texts(bodies: list[bytes]) -> list[str]:
    """The table of texts. A text that is continued in the next body has its width there again."""
    (count,) = struct.unpack_from("<I", bodies[0], 4)
    out, part, at = [], 0, 8

    def room() -> None:
        nonlocal part, at
        while at >= len(bodies[part]):
            part, at = part + 1, 0

    def skip(n: int) -> None:
        nonlocal at
        while n:
            room()
            step = min(n, len(bodies[part]) - at)
            at, n = at + step, n - step

    for _ in range(count):
        room()
        left, flags = struct.unpack_from("<HB", bodies[part], at)
        at += 3
        runs = extra = 0
        if flags & 8:
            (runs,) = struct.unpack_from("<H", bodies[part], at)
            at += 2
        if flags & 4:
            (extra,) = struct.unpack_from("<I", bodies[part], at)
            at += 4
        wide, pieces = flags & 1, []
        while left:
            if at >= len(bodies[part]):
                part, at = part + 1, 1
                wide = bodies[part][0] & 1
            step = min(left, (len(bodies[part]) - at) >> wide)
            if not step:
                raise ValueError("a text beyond the end")
            pieces.append(bodies[part][at : at + (step << wide)].decode("utf-16-le" if wide else "latin-1", "replace"))
            at, left = at + (step << wide), left - step
        skip(4 * runs + extra)
        out.append("".join(pieces))
    return out


def number(value: float) -> str:
    return str(int(value)) if value == int(value) else repr(value)


def packed(rk: int) -> float:
    """A number of 30 bits: whole, or the upper part of a double, either a hundredth."""
    value = float(struct.unpack("<i", struct.pack("<I", rk))[0] >> 2) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & 0xFFFFFFFC) << 32))[0]
    return value / 100 if rk & 1 else value


def cells(book: bytes, at: int, texts: list[str]) -> Iterator[tuple[int, int, str]]:
    """Rows, columns (from 0) and texts of a sheet's cells that aren't blank."""
    pending = None
    for kind, (body, *_) in records(book, at):
        if kind == EOF:
            return
        if kind == STRING and pending:
            (count,) = struct.unpack_from("<H", body)
            yield *pending, text_at(body, 2, count)[0]
        pending = None
        if kind in (LABELSST, LABEL, NUMBER, RK, MULRK, FORMULA, BOOLERR):
            row, column = struct.unpack_from("<HH", body)
        if kind == LABELSST:
            yield row, column, texts[struct.unpack_from("<I", body, 6)[0]]
        elif kind == LABEL:
            yield row, column, text_at(body, 8, struct.unpack_from("<H", body, 6)[0])[0]
        elif kind == NUMBER:
            yield row, column, number(struct.unpack_from("<d", body, 6)[0])
        elif kind == RK:
            yield row, column, number(packed(struct.unpack_from("<I", body, 6)[0]))
        elif kind == MULRK:
            for i in range((len(body) - 6) // 6):
                yield row, column + i, number(packed(struct.unpack_from("<I", body, 6 + 6 * i)[0]))
        elif kind == BOOLERR:
            yield row, column, ERRORS.get(body[6], "#?") if body[7] else str(bool(body[6]))
        elif kind == FORMULA:
            if body[12:14] != b"\xff\xff":
                yield row, column, number(struct.unpack_from("<d", body, 6)[0])
            elif body[6] == 0:
                pending = row, column  # its text is the next record
            elif body[6] == 1:
                yield row, column, str(bool(body[8]))
            elif body[6] == 2:
                yield row, column, ERRORS.get(body[8], "#?")


def sheets(content: bytes) -> Iterator[tuple[str, dict[int, dict[int, str]]]]:
    """Names of the sheets, with their cells by row and column."""
    compound = Compound(content)
    name = next((n for n in ("Workbook", "Book") if n in compound.streams), None)
    if name is None:
        raise ValueError("no workbook")
    book, texts, listed = compound.stream(name), [], []
    for kind, bodies in records(book):
        if kind == FILEPASS:
            raise ValueError("an encrypted workbook")
        if kind == SST:
            texts = shared_texts(bodies)
        elif kind == BOUNDSHEET and bodies[0][5] == 0:
            listed.append((struct.unpack_from("<I", bodies[0])[0], text_at(bodies[0], 7, bodies[0][6])[0]))
        elif kind == EOF:
            break
    for at, title in listed:
        rows: dict[int, dict[int, str]] = {}
        for row, column, value in cells(book, at, texts):
            rows.setdefault(row, {})[column] = value
        yield title, rows

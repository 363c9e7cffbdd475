"""Repeated passages across documents: sampled suffix arrays in a logarithmic family of levels."""

from __future__ import annotations

import hashlib
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycadence.llm import textkit as tk
from skycadence.llm.shared import documents

LENGTH = 50  # bytes of a passage that counts as repeated
GRAM = 24  # bytes that decide which suffixes are sampled
SIDE = (LENGTH - GRAM) // 2  # bytes beside a gram, on one side at least, that a repeated passage shares too
PART = 4  # passages of a cell that are compared together before they are compared one by one
PIECE = 1 << 19  # bytes that are hashed at once
SLOT = 1 << 25  # bytes of text of a slot, or less
SIDE_BITS = 48  # bits of a side's hash: sides only rule passages out, so equal hashes of unlike sides do no harm
REPEATED, OPEN, SHARED = np.uint8(1), np.uint8(2), np.uint8(4)  # marks of an entry
_LOW = np.uint64(0xFFFFFFFF)
_HIGH = np.uint64(0xFFFFFFFF00000000)


class Sampled:
    """The sampled suffixes of a slice of rows.

    Every passage of LENGTH bytes samples the place in it whose gram of GRAM bytes has the smallest hash, the leftmost
    of equals: a choice that depends on the passage alone, so equal passages sample the same place. The passages that
    sample a place follow each other; they start at lo..hi and span the cell [lo, hi + LENGTH). `key` is the hash of the
    cell's bytes, with the gram's place in them; all 64 bits count where cells are told apart. `gram` is the gram's."""

    def __init__(self, part: np.ndarray, cut: np.ndarray):
        n = len(part)
        ends = np.repeat(cut[1:], np.diff(cut))
        if n < LENGTH:
            self.row = self.lo = self.hi = self.at = np.zeros(0, np.int64)
            self.key = self.gram = np.zeros(0, np.uint64)
            self._part, self._down = part[:0], np.ones(1, np.uint64)
            return
        self._part, self._down = part, tk.powers(n + 1)[1]
        total = self._sums()
        gram = (total[GRAM:] - total[:-GRAM]) * self._down[:n - GRAM + 1]
        tk.scramble(gram)
        low = (gram & _HIGH) | np.arange(len(gram), dtype=np.uint64)
        width, covered = LENGTH - GRAM + 1, 1
        while covered < width:
            step = min(covered, width - covered)
            low = np.minimum(low[:-step], low[step:])
            covered += step
        start = np.flatnonzero(np.arange(len(low)) + LENGTH <= ends[:len(low)])
        at = (low[start] & _LOW).astype(np.int64)
        fresh = np.ones(len(at), bool)
        fresh[1:] = at[1:] != at[:-1]
        first = np.flatnonzero(fresh)
        self.at, self.lo = at[first], start[first]
        at = self.at
        self.hi = start[np.append(first[1:], len(start)) - 1] if len(start) else self.lo
        self.row = np.searchsorted(cut, self.lo, "right") - 1
        cell = (total[self.hi + LENGTH] - total[self.lo]) * self._down[self.lo]
        cell += ((at - self.lo) * 1000 + self.hi - self.lo).astype(np.uint64)
        self.key, self.gram = tk.scramble(cell), gram[at]

    def _sums(self) -> np.ndarray:
        """Running sums of the weighted bytes; they take eight times the text, so none are kept."""
        total = np.zeros(len(self._part) + 1, np.uint64)
        np.cumsum(tk.BYTE[self._part] * tk.powers(len(self._part))[0], out=total[1:])
        return total

    def passages(self, start: np.ndarray) -> np.ndarray:
        """Hash of the passage at each start."""
        total = self._sums()
        return tk.scramble((total[start + LENGTH] - total[start]) * self._down[start])

    def sides(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, first start, last start, key) of the cells' sides: a gram with the SIDE bytes before it, or behind it.

        A passage has SIDE bytes or more on one side of the gram it samples, and shares them where it is repeated. So
        only the passages from the first to the last start, those that hold a side, can be repeated through it."""
        at, lo, hi = self.at[cells], self.lo[cells], self.hi[cells]
        left, right = np.flatnonzero(lo <= at - SIDE), np.flatnonzero(hi >= at + GRAM + SIDE - LENGTH)
        start = np.concatenate([at[left] - SIDE, at[right]])
        total = self._sums()
        key = (total[start + GRAM + SIDE] - total[start]) * self._down[start]
        key[len(left):] += np.uint64(1)
        return (cells[np.concatenate([left, right])], np.concatenate([lo[left], np.maximum(lo, at + GRAM + SIDE - LENGTH)[right]]),
                np.concatenate([np.minimum(hi, at - SIDE)[left], hi[right]]), tk.scramble(key) >> np.uint64(64 - SIDE_BITS))

    def parts(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, lo, hi, key, core) of the cells' parts: PART passages at fixed distances from the sampled place.

        The core is a hash of the bytes that all passages at these distances have in common, the key one of the bytes
        the part spans. Two documents that share a passage have the same common bytes there; where those
        hold a difference, as around an edit, no passage of the part can be repeated."""
        low, high = (self.at - self.hi)[cells] // PART, (self.at - self.lo)[cells] // PART
        owner = np.repeat(cells, high - low + 1)
        group = _ranges(low, high)
        nearest = self.at[owner] - PART * group
        lo, hi = np.maximum(self.lo[owner], nearest - PART + 1), np.minimum(self.hi[owner], nearest)
        total = self._sums()
        core = (total[nearest + LENGTH - PART + 1] - total[nearest]) * self._down[nearest] + group.astype(np.uint64)
        span = (total[hi + LENGTH] - total[lo]) * self._down[lo]
        span += ((self.at[owner] - lo) * 1000 + hi - lo).astype(np.uint64)
        return owner, lo, hi, tk.scramble(span), tk.scramble(core)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0]..hi[0], lo[1]..hi[1], ... as one array."""
    n = hi - lo + 1
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def sampled(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, Sampled]]:
    """(first row, place in the buffer, suffixes) of slices of about PIECE bytes; longer rows come in overlapping pieces.

    A cell at a seam is cut in two; both parts share the gram with whole cells elsewhere, so their passages are
    compared one by one and nothing is lost."""
    for lo, hi in tk.slices(offs, PIECE):
        if offs[hi] - offs[lo] <= 2 * PIECE:
            yield lo, int(offs[lo]), Sampled(buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
        else:
            for at in range(int(offs[lo]), int(offs[hi]) - LENGTH + 1, PIECE):
                part = buf[at:min(offs[hi], at + PIECE + LENGTH - 1)]
                yield lo, at, Sampled(part, np.array([0, len(part)]))


class Family:
    """Levels of sorted arrays (order, rest, doc, told, number); a new batch is merge-scanned against each and then becomes one.

    Levels of about equal size merge, so sizes grow geometrically and their number with the logarithm of the entries.
    A key is in one level, with the first document that has it. Batches may come in any order of documents. A cell's
    `order` has 32 bits of its gram and the first half of its key, `rest` has the other half (see _order). What is found
    out is marked on the entries, which are numbered as they come."""

    def __init__(self, cells: bool):
        self.cells, self.levels, self.size = cells, [], 0
        self._marks, self._same = np.zeros(1024, np.uint8), []

    @staticmethod
    def _find(level: np.ndarray, level_rest: np.ndarray, order: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the level, whether it holds the entry)."""
        at = np.minimum(np.searchsorted(level, order), len(level) - 1)
        hit = level[at] == order
        off = np.flatnonzero(hit & (level_rest[at] != rest))
        while len(off):  # entries that agree in `order` only follow each other
            hit[off] = False
            off = off[at[off] + 1 < len(level)]
            at[off] += 1
            off = off[level[at[off]] == order[off]]
            hit[off] = True
            off = off[level_rest[at[off]] != rest[off]]
        return at, hit

    def _numbered(self, n: int) -> np.ndarray:
        if self.size + n > len(self._marks):
            self._marks = np.concatenate([self._marks, np.zeros(max(len(self._marks), n), np.uint8)])
        self.size += n
        return np.arange(self.size - n, self.size, dtype=np.uint32)

    def add(self, order: np.ndarray, rest: np.ndarray, docs: np.ndarray, told: np.ndarray) -> None:
        """Take a batch of sorted, different keys in.

        `told` marks the keys that are open already, because the batch they come from holds their gram in other cells."""
        known, number = np.zeros(len(order), bool), self._numbered(len(order))
        marks = self._marks
        for level, level_rest, first, level_told, holder in self.levels:
            at, hit = self._find(level, level_rest, order, rest)
            hit = np.flatnonzero(hit)
            at = at[hit]
            known[hit] = True
            late, early, same = docs[hit] > first[at], docs[hit] < first[at], docs[hit] == first[at]
            marks[number[hit[late]]] |= REPEATED
            marks[holder[at[early]]] |= REPEATED
            marks[number[hit[same]]] |= SHARED
            marks[holder[at[same]]] |= SHARED
            self._same.append((number[hit[same]], holder[at[same]]))
            first[at[early]], holder[at[early]] = docs[hit[early]], number[hit[early]]
            fresh = at[told[hit] | level_told[at]]
            level_told[fresh] = True
            marks[holder[fresh]] |= OPEN
        order, rest, docs, told, number = (x[~known] for x in (order, rest, docs, told, number))
        if self.cells and len(order):
            gram, place = np.unique(order & _HIGH, return_inverse=True)
            told |= (np.bincount(place) > 1)[place]
            for level, level_rest, first, level_told, holder in self.levels:
                a, b = np.searchsorted(level, gram), np.searchsorted(level, gram | _LOW, "right")
                told |= (b > a)[place]
                near = _ranges(a[b > a], b[b > a] - 1)
                near = near[~level_told[near]]
                level_told[near] = True
                marks[holder[near]] |= OPEN
            marks[number[told]] |= OPEN
        if len(order):
            self.levels.append([order, rest, docs, told, number])
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            one, two = self.levels[-2:]
            order = np.concatenate([one[0], two[0]])
            by = np.argsort(order, kind="stable")
            self.levels[-2:] = [[order[by], *(np.concatenate([a, b])[by] for a, b in zip(one[1:], two[1:]))]]

    def marks(self) -> np.ndarray:
        """REPEATED, OPEN and SHARED of each entry; a document's entries of one key have the same."""
        for number, holder in self._same:
            self._marks[number] |= self._marks[holder]
        return self._marks[:self.size]


def _order(key: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rest) of cells: 32 bits of the gram before the key, so that cells of one gram stand side by side.

    Sampled grams are the smallest of their surroundings; hashed again, they are even."""
    return (tk.scramble(gram.copy()) & _HIGH) | (key >> np.uint64(32)), (key & _LOW).astype(np.uint32)


def _keys(order: np.ndarray, rest: np.ndarray, cells: bool) -> np.ndarray:
    """The 64-bit keys again."""
    return (order << np.uint64(32)) | rest.astype(np.uint64) if cells else order


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _pack(keys: np.ndarray, rest: np.ndarray, docs: np.ndarray) -> bytes:
    """A sorted array as bytes: differences of the keys by byte planes, the rest, and places in a list of documents."""
    names, place = np.unique(docs, return_inverse=True)
    raw = b"".join([np.array([len(keys), len(names)]).tobytes(), _planes(np.diff(names, prepend=np.int64(0))),
                    _planes(np.diff(keys, prepend=np.uint64(0))), _planes(place.astype(np.uint32)), rest.tobytes()])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n, m = np.frombuffer(raw, np.int64, 2)

    def planes(size: int, count: int, at: int, kind: type) -> np.ndarray:
        return np.frombuffer(raw, np.uint8, size * count, at).reshape(size, count).T.copy().view(kind).ravel()

    names = np.cumsum(planes(8, m, 16, np.int64), dtype=np.int64)
    keys = np.cumsum(planes(8, n, 16 + 8 * m, np.uint64), dtype=np.uint64)
    return keys, np.frombuffer(raw, np.uint32, n, 16 + 8 * m + 12 * n), names[planes(4, n, 16 + 8 * m + 8 * n, np.uint32)]


def _pack_marks(marks: np.ndarray) -> bytes:
    return pa.compress(np.packbits([marks & m for m in (REPEATED, OPEN, SHARED)], axis=1).tobytes(), codec="zstd", asbytes=True)


def _unpack_marks(blob: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(blob, decompressed_size=3 * -(-n // 8), codec="zstd", asbytes=True)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(3, -1), axis=1, count=n)
    return bits[0] * REPEATED | bits[1] * OPEN | bits[2] * SHARED


_SENT = "part int, kind int, entries binary, slot int"
_TOLD = "slot int, step int, part int, marks binary"
_SINGLE, _OPEN, _WITNESS = 0, 2, 3


class Entries:
    """The sorted arrays that a slot sends, one for each partition of the family; only cells, and parts of them, have grams.

    A key that a smaller document of the slot has is settled as repeated here, so one entry per key and slot is left
    to compare, however common the key is. Partitions are ranges of hashes, so an array's keys stand as close as the
    slot's, into however many it is cut. Cells whose gram the slot holds once go by gram. Where it holds several
    different cells of a gram they are open, whatever others have, and go by the whole key; one of them also goes by gram, as the
    witness that opens other slots' cells. So one gram, however common, has at most one entry per slot in its
    partition. A cell may stand in a slot of either sort; both are open then, and what they share is settled by their
    parts or passages. Sides go without documents.

    The order of the slot's rows does not matter, so the marks that come back fit whenever it is sampled again."""

    def __init__(self, keys: list[np.ndarray], docs: list[np.ndarray], parts: int, grams: list[np.ndarray] | None = None, bits: int = 64):
        key = np.concatenate([np.zeros(0, np.uint64), *keys])
        doc = np.concatenate([np.zeros(0, np.int64), *docs])
        rest = np.zeros(len(key), np.uint32)
        if grams is not None:
            key, rest = _order(key, np.concatenate([np.zeros(0, np.uint64), *grams]))
        order = np.argsort(key)
        fresh = np.ones(len(key), bool)
        fresh[1:] = np.diff(key[order]) != 0
        if grams is not None and (rest[order][1:] != rest[order][:-1])[~fresh[1:]].any():
            order = np.lexsort((rest, key))
            fresh[1:] = (np.diff(key[order]) != 0) | (np.diff(rest[order]) != 0)
        first, of = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        least = np.minimum.reduceat(doc[order], first) if len(first) else doc
        self._of = np.empty(len(key), np.int64)
        self._of[order] = of
        self._late = doc > least[self._of]
        self.key, self.rest = key[order[first]], rest[order[first]]
        self.doc = least if bits == 64 else np.zeros(len(first), np.int64)
        entry, kind, place = np.arange(len(first)), np.full(len(first), _SINGLE), self.key >> np.uint64(bits - 32)
        if grams is not None:
            follows = np.zeros(len(first) + 1, bool)
            follows[1:-1] = place[1:] == place[:-1]
            several, lead = np.flatnonzero(follows[:-1] | follows[1:]), np.flatnonzero(~follows[:-1] & follows[1:])
            entry, kind, place = np.append(entry, lead), np.append(kind, np.full(len(lead), _WITNESS)), np.append(place, place[lead])
            kind[several], place[several] = _OPEN, self.key[several] & _LOW
        group = 4 * (place * np.uint64(parts) >> np.uint64(32)).astype(np.int64) + kind
        by = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[by], prepend=-1))
        self.runs = list(zip(*divmod(group[by][cuts], 4), np.split(entry[by], cuts[1:]))) if len(by) else []

    def batch(self, slot: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([p for p, _, _ in self.runs], pa.int32()), pa.array([k for _, k, _ in self.runs], pa.int32()),
             pa.array([_pack(self.key[r], self.rest[r], self.doc[r]) for _, _, r in self.runs], pa.binary()),
             pa.array(np.full(len(self.runs), slot, np.int32))], ["part", "kind", "entries", "slot"])

    def marks(self, told: dict[int, bytes]) -> np.ndarray:
        """The marks of each key that was given, from what each partition told of its runs by kind."""
        marks, runs = np.zeros(len(self.key), np.uint8), {}
        for part, _, run in self.runs:
            runs.setdefault(part, []).append(run)
        for part, blob in told.items():
            some = _unpack_marks(blob, sum(map(len, runs[part])))
            for run in runs[part]:
                marks[run] |= some[:len(run)]
                some = some[len(run):]
        marks[self._of[self._late]] |= SHARED
        marks = marks[self._of]
        marks[self._late] |= REPEATED
        return marks


def _batch(keys: list[np.ndarray], docs: list[np.ndarray], parts: int, grams: list[np.ndarray] | None = None) -> pa.RecordBatch:
    """The rows that a slot would send."""
    return Entries(keys, docs, parts, grams).batch(0)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _scanned(sent: DataFrame, step: int, cells: bool) -> DataFrame:
    """What is told to the slots: marks of the entries they sent, in the entries' order.

    The slots' arrays meet in partitions (see Entries) and pass an index family there. A cell, or a part of one, is open
    if its gram or core also occurs with another key."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, runs = Family(cells), {}
        for batch in rows:
            for slot, part, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("slot", "part", "kind")), batch.column("entries")):
                order, rest, docs = _unpack(blob.as_py())
                runs.setdefault((slot, part), []).append((kind, family.size, family.size + len(order)))
                family.add(order, rest, docs, np.full(len(order), kind in (_OPEN, _WITNESS)))
        marks = family.marks()
        del family
        places = list(runs)
        for k in range(0, len(places), 1000):
            found = ((place, np.concatenate([marks[a:b] for _, a, b in sorted(runs[place])])) for place in places[k:k + 1000])
            some = [(*place, _pack_marks(m)) for place, m in found if m.any()]
            slot, part, blobs = zip(*some) if some else ((),) * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot, pa.int32()), pa.array([step] * len(some), pa.int32()), pa.array(part, pa.int32()), pa.array(blobs, pa.binary())],
                ["slot", "step", "part", "marks"])

    return sent.repartitionById(_parts(sent), F.col("part")).mapInArrow(run, _TOLD).repartition("slot")


_CELLS, _SIDES, _PARTS, _PASSAGES, _CUT = range(5)


def _examined(ids: np.ndarray, found: list[tuple[int, int, Sampled]], parts: int) -> Generator[Entries, dict, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The steps of a slot: yields the entries of each step, is sent what was told about them, returns (row, start, end).

    The stretches that are returned are the repeated passages; places count from the start of the buffer."""
    rows, starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(piece: tuple[int, int, Sampled], cell: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        first, base, f = piece
        rows.append(first + f.row[cell])
        starts.append(base + lo)
        ends.append(base + hi + LENGTH)

    def docs(owners: list[np.ndarray]) -> list[np.ndarray]:
        return [ids[first + f.row[cell]] for (first, _, f), cell in zip(found, owners)]

    def by_piece(marks: np.ndarray, owners: list[np.ndarray]) -> list[np.ndarray]:
        return np.split(marks, np.cumsum([len(x) for x in owners[:-1]])) if owners else []

    def settled_and_open(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.flatnonzero(marks & REPEATED), np.flatnonzero(marks & (REPEATED | OPEN) == OPEN)

    all_cells = [np.arange(len(f.key)) for _, _, f in found]
    entries = Entries([f.key for _, _, f in found], docs(all_cells), parts, [f.gram for _, _, f in found])
    marks = entries.marks((yield entries))
    del entries
    picked = []
    for piece, m in zip(found, by_piece(marks, all_cells)):
        settled, open_ = settled_and_open(m)
        add(piece, settled, piece[2].lo[settled], piece[2].hi[settled])
        picked.append(open_)

    sides = [f.sides(cells) for (_, _, f), cells in zip(found, picked)]
    owners = [s[0] for s in sides]
    entries = Entries([s[3] for s in sides], docs(owners), parts, bits=SIDE_BITS)
    marks = entries.marks((yield entries))
    some = []
    for (_, _, f), (cell, lo, hi, _), m in zip(found, sides, by_piece(marks & SHARED > 0, owners)):
        low, high = np.full(len(f.key), 1 << 62), np.full(len(f.key), -1)
        np.minimum.at(low, cell[m], lo[m])
        np.maximum.at(high, cell[m], hi[m])
        cell, lo, hi, key, core = f.parts(np.flatnonzero(high >= 0))
        use = (hi >= low[cell]) & (lo <= high[cell])
        some.append([x[use] for x in (cell, lo, hi, key, core)])

    owners = [s[0] for s in some]
    entries = Entries([s[3] for s in some], docs(owners), parts, [s[4] for s in some])
    marks = entries.marks((yield entries))
    passages = []
    for piece, (cell, lo, hi, _, _), m in zip(found, some, by_piece(marks, owners)):
        settled, open_ = settled_and_open(m)
        add(piece, cell[settled], lo[settled], hi[settled])
        passages.append((np.repeat(cell[open_], hi[open_] - lo[open_] + 1), _ranges(lo[open_], hi[open_])))

    owners = [p[0] for p in passages]
    entries = Entries([f.passages(start) if len(start) else np.zeros(0, np.uint64) for (_, _, f), (_, start) in zip(found, passages)], docs(owners), parts)
    marks = entries.marks((yield entries))
    for piece, (cell, start), m in zip(found, passages, by_piece(marks, owners)):
        settled = np.flatnonzero(m & REPEATED)
        add(piece, cell[settled], start[settled], start[settled])
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(ends)


def _step(texts: pa.Table, told: pa.Table | None, parts: int, step: int):
    """The entries that a slot of texts with ids sends in a step, or at last its repeated stretches (row, start, end)."""
    heard = [{} for _ in range(step)]
    if told is not None:
        for at, part, marks in zip(*(told.column(c).to_pylist() for c in ("step", "part", "marks"))):
            heard[at][part] = marks
    exam = _examined(np.asarray(texts.column("doc_id")), list(sampled(*_unzipped(texts))), parts)
    try:
        entries = next(exam)
        for marks in heard:
            entries = exam.send(marks)
    except StopIteration as end:
        return end.value
    return entries


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row: `kept` is the text's bytes without repeated passages.

    A byte goes if a passage of LENGTH bytes that covers it also starts in a document with a smaller doc_id. Texts are
    whole UTF-8 byte strings, NULL is empty, passages never cross documents, and all are judged on the input. Texts
    shorter than LENGTH keep everything. Rows that repeat a doc_id do not make each other's passages repeated; a row
    with a NULL doc_id keeps everything and makes nothing repeated. Other columns are not read; an empty table gives an
    empty result.

    Texts are dealt into slots of about SLOT bytes at most, by id and text. Cells of sampled suffixes are compared first: an equal cell in a smaller
    document settles all its passages. Where equal grams stand in different cells, at the edges of matches or by chance, the
    gram and what stands on one side of it must be equal too; of cells where it is, parts are compared, and where those agree
    in what their passages have in common, the passages themselves. Equality is that of 64-bit hashes in each step. A slot
    sends sorted arrays and gets a few bits for each entry back, in the same order; it is sampled again to read them. Each
    task keeps 25 bytes per different key of its partition and one per entry, a sampled suffix per 14 bytes of text, so
    spark.sql.shuffle.partitions bounds its memory. Texts are shuffled once, compressed.
    """
    parts = _parts(docs)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slots = max(parts, -(-total // SLOT))

    def zip_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            texts = [(x.as_py() or "").encode() for x in batch.column("text")]
            spread = np.asarray(batch.column("spread")).view(np.uint64)
            _, same, count = np.unique(spread, return_inverse=True, return_counts=True)
            nth = np.empty(len(same), np.uint64)  # copies of a row go to different slots
            nth[np.argsort(same, kind="stable")] = _ranges(np.zeros(len(count), np.int64), count - 1)
            slot = tk.scramble(spread + nth * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(slots)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot.astype(np.int32)), batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([codec.compress(t, asbytes=True) if t else b"" for t in texts], pa.binary())], ["slot", "doc_id", "n_bytes", "zipped"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("spread", F.xxhash64("doc_id", "text"))
    texts = rows.mapInArrow(zip_texts, "slot int, doc_id long, n_bytes long, zipped binary").repartition("slot")

    def send(step: int):
        def sent(table: pa.Table, told: pa.Table | None = None) -> pa.Table:
            slot = table.column("slot")[0].as_py()
            return pa.Table.from_batches([_step(_known(table), told, parts, step).batch(slot)])
        return sent

    told = _scanned(texts.groupBy("slot").applyInArrow(lambda table: send(_CELLS)(table), _SENT), _CELLS, cells=True)
    for step in (_SIDES, _PARTS, _PASSAGES):
        sent = texts.groupBy("slot").cogroup(told.groupBy("slot")).applyInArrow(send(step), _SENT)
        told = told.union(_scanned(sent, step, cells=step == _PARTS))

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        with_id, without = _known(table), table.filter(table.column("doc_id").is_null())
        buf, offs = _unzipped(with_id)
        row, start, end = _step(with_id, told, parts, _CUT)
        by = np.argsort(row, kind="stable")
        spans = np.split(by, np.searchsorted(row[by], np.arange(1, with_id.num_rows)))
        out = [_without(buf[a:b], start[some] - a, end[some] - a) if len(some) else (b - a, 0, 0, buf[a:b].tobytes())
               for some, a, b in zip(spans, offs[:-1].tolist(), offs[1:].tolist())]
        buf, offs = _unzipped(without)
        out += [(b - a, 0, 0, buf[a:b].tobytes()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        ids = with_id.column("doc_id").to_pylist() + [None] * without.num_rows
        return pa.Table.from_arrays(
            [pa.array(ids, pa.int64()), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.groupBy("slot").cogroup(told.groupBy("slot")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _known(texts: pa.Table) -> pa.Table:
    return texts.filter(texts.column("doc_id").is_valid())


def _unzipped(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    codec, sizes = pa.Codec("zstd"), batch.column("n_bytes").to_pylist()
    texts = [codec.decompress(z.as_buffer(), n, asbytes=True) if n else b"" for z, n in zip(batch.column("zipped"), sizes)]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _without(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, bytes]:
    """(bytes, removed bytes, removed runs, what is left) of a text without the stretches."""
    edge = np.bincount(starts, minlength=len(text) + 1) - np.bincount(ends, minlength=len(text) + 1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return len(text), int(gone.sum()), runs, text[~gone].tobytes()


def op8_suffix_family_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, s, substr(x, 2 * s + 1, {2 * LENGTH}) AS g
      FROM (SELECT doc_id, x, unnest(generate_series(0, n - {LENGTH})) AS s FROM h WHERE n >= {LENGTH})),
m AS (SELECT g, min(doc_id) AS d FROM w GROUP BY g),
r AS (SELECT w.doc_id, s, coalesce(s - lag(s) OVER (PARTITION BY w.doc_id ORDER BY s) > {LENGTH}, true) AS fresh
      FROM w JOIN m USING (g) WHERE m.d < w.doc_id),
i AS (SELECT doc_id, s, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM r),
p AS (SELECT doc_id, min(s) AS a, max(s) + {LENGTH} AS b FROM i GROUP BY doc_id, run),
q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
k AS (SELECT q.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS pre, max(b) AS rest,
             sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM q JOIN h USING (doc_id) GROUP BY q.doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(pre, '') || substr(x, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id)
"""

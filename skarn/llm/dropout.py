"""SentencePiece BPE encoding with seeded merge dropout, and decoding.

A merge type's agenda is processed best score first, leftmost first among equals.
Each candidate that comes up is skipped for good with the dropout rate's probability,
by hashes keyed by seed, document id and the place of its unit in the text. So each
occurrence of a word is cut by draws of its own, a run with the same seed gives the
same pieces anywhere, and all decode to the text. What is drawn is how many candidates
pass until the next skip, which is the same as a draw for each one.
Texts are cut where no piece can reach across (before a run of blanks, around
newlines). A worker keeps each stretch's pieces without skips; a batch's occurrences
that have a skip are worked off side by side, one candidate of each at a time, in
arrays. Long stretches and those with letters outside the vocabulary go one by one.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

BLANK = "▁"
M64 = (1 << 64) - 1
NEVER = float("inf")
#: Marks that follow words.
MARKS = ".,;:!?#*$%&|"
#: Stretches up to this length are worked off side by side, in arrays of these widths; else up to it an agenda is a list.
WIDTHS = (6, 10, 16, 24)
SHORT = WIDTHS[-1]
#: Stands for a blank sign that is in the text itself.
SIGN = "\0sign"
#: Rank of a pair that is no piece.
NO_PIECE = 2**31 - 1
#: Longest gap between two skips that one hash draws; a longer one takes several.
LONGEST = 1024
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class PairTable:
    """Pairs of piece numbers to the piece that they make and its rank, for whole arrays at once: slots by hash, collisions in further tables."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray, ranks: np.ndarray, n: int) -> None:
        self.n, self.made, self.ranks = np.int64(n), np.append(made, -1).astype(np.int32), np.append(ranks, NO_PIECE).astype(np.int32)
        keys, at, bits = left.astype(np.int64) * n + right, np.arange(len(made)), max(10, int(len(made)).bit_length() + 3)
        self.levels = []
        while len(at):
            slots = self._slots(keys[at], bits)
            found = np.full(1 << bits, -1, np.int64), np.full(1 << bits, len(made), np.int32)
            found[0][slots], found[1][slots] = keys[at], at  # the last of those that share a slot has it
            self.levels.append((bits, *found))
            at = at[found[0][slots] != keys[at]]
            bits = max(8, int(len(at)).bit_length() + 3)

    @staticmethod
    def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(GOLDEN + 2 * bits)) >> np.uint64(64 - bits)).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where in ``made`` and ``ranks`` each pair stands; the last place is that of pairs which make nothing."""
        keys = left.astype(np.int64) * self.n + right
        out = np.full(len(keys), len(self.made) - 1, np.int64)
        for bits, known, at in self.levels:
            slots = self._slots(keys, bits)
            hit = known[slots] == keys
            out[hit] = at[slots[hit]]
        return out


class Column:
    """An array that grows at its end."""

    def __init__(self, dtype: str) -> None:
        self.data, self.n = np.empty(1024, dtype), 0

    def extend(self, values: np.ndarray | list) -> int:
        """Where the values stand."""
        at, self.n = self.n, self.n + len(values)
        if self.n > len(self.data):
            self.data = np.concatenate([self.data[:at], np.empty(max(self.n, 2 * at) - at, self.data.dtype)])
        self.data[at : self.n] = values
        return at


class DropoutEncoder:
    """Pieces of a merge-type (BPE) model with byte fallback.

    ``rate`` 0 gives the library's own segmentation. Draws follow from ``seed``, a
    text's ``key`` and the place in the text. A blank sign in the text itself is spelled in bytes,
    so that decoding restores it.
    """

    def __init__(self, path: str, rate: float = 0.1, seed: int = 0, limit: int = 600_000) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {names[i]: i for i in plain}
        self.scores = {names[i]: -sp.get_score(i) for i in plain}  # least first
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.ids):
            raise ValueError("pieces reach across blanks")
        #: Letters that stand next to each other in a piece; no piece reaches across others.
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.values = [b""] * n
        for i in plain:
            self.values[i] = names[i].replace(BLANK, " ").encode()
        for b, i in self.bytes.items():
            self.values[i] = bytes([b])
        self.dtype = "<u2" if n <= 1 << 16 else "<u4"
        self.rate, self.seed, self.limit = rate, seed, limit
        #: Chances that at least 1, 2, ... candidates pass before a skip, in 2**-64, least first.
        self.passing = np.array([min(int((1 - rate) ** k * 2**64), M64) for k in range(LONGEST, 0, -1)], np.uint64)
        made = [(self.ids[p[:i]], self.ids[p[i:]], x) for p, x in self.ids.items() for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids]
        a, b, x = (np.array(c, np.int64) for c in zip(*made, strict=True))
        _, ranks = np.unique([self.scores[names[i]] for i in x.tolist()], return_inverse=True)
        self.pairs = PairTable(a, b, x, ranks, n)
        #: By code point: the letter's own piece, or -1.
        self.letters = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.letters[ord(p)] = i
        self._forget()

    def _forget(self) -> None:
        """Nothing is kept: units' numbers; by number the candidates that come up without skips, where its stretch's letters, its ids and those of marks after the stretch are, and how many."""
        self.kept: dict[str, int] = {}
        self.came, self.letters_at, self.letters_n, self.ids_at, self.ids_n, self.tail_at, self.tail_n = (Column("<i8") for _ in range(7))
        self.all_letters, self.all_ids = Column("<i4"), Column(self.dtype)

    def _gaps(self, text: np.ndarray, place: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """The gap that each draw gives; LONGEST stands for one that goes on."""
        x = text + ((place << np.uint64(24)) | draw) * np.uint64(GOLDEN)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
        return LONGEST - np.searchsorted(self.passing, x ^ (x >> np.uint64(31)), "right")

    def gaps(self, text: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Units' first gaps: how many candidates pass before the first skip."""
        if not self.rate:
            return np.full(len(text), NEVER)
        out = self._gaps(text, place, np.uint64(0))
        for k in np.flatnonzero(out == LONGEST).tolist():
            out[k] = next(self.more(int(text[k]), int(place[k]), 0))
        return out

    def more(self, text: int, place: int, draw: int = 1) -> Iterator[float]:
        """The gaps of the unit at a place, from a draw on."""
        gap = 0
        while True:
            x = text + (place << 24 | draw) * GOLDEN & M64
            x = (x ^ (x >> 30)) * MIX1 & M64
            x = (x ^ (x >> 27)) * MIX2 & M64
            drawn = LONGEST - int(np.searchsorted(self.passing, np.uint64(x ^ (x >> 31)), "right"))
            draw += 1
            gap += drawn
            if drawn < LONGEST:
                yield gap
                gap = 0

    def segment(self, unit: str, gaps: Iterator[float]) -> tuple[list[int], int, float]:
        """Ids of a stretch, how many candidates came up, and what is left of the last gap; blanks are the blank sign here."""
        n = len(unit)
        left, came = next(gaps), 0
        if n == 1:
            return self._ids([unit]), came, left
        if n <= SHORT:
            return self._segment_short(unit, left, gaps)
        scores, push, pop = self.scores, heapq.heappush, heapq.heappop
        sym: list[str | None] = list(unit)
        prev, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(s, i, i + 1, p) for i in range(n - 1) if (s := scores.get(p := unit[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, piece = pop(agenda)
            a, b = sym[i], sym[j]
            if a is None or b is None or len(a) + len(b) != len(piece) or after[i] != j:
                continue  # one of its parts was merged meanwhile
            came += 1
            if not left:
                left = next(gaps)
                continue
            left -= 1
            sym[i], sym[j] = piece, None
            k = after[i] = after[j]
            if k < n:
                prev[k] = i
                new = piece + sym[k]
                if (s := scores.get(new)) is not None:
                    push(agenda, (s, i, k, new))
            k = prev[i]
            if k >= 0:
                new = sym[k] + piece
                if (s := scores.get(new)) is not None:
                    push(agenda, (s, k, i, new))
        return self._ids([x for x in sym if x is not None]), came, left

    def _ids(self, symbols: list[str]) -> list[int]:
        try:
            return [self.ids[x] for x in symbols]
        except KeyError:
            return [i for x in symbols for i in ([self.ids[x]] if x in self.ids else [self.bytes[b] for b in x.encode("utf-8", "surrogatepass")])]

    def _segment_short(self, unit: str, left: float, gaps: Iterator[float]) -> tuple[list[int], int, float]:
        """The same agenda as a list of pair scores, which is faster to search than a heap to keep for a few letters."""
        get, came = self.scores.get, 0
        sym = list(unit)
        agenda = [get(unit[i : i + 2], NEVER) for i in range(len(unit) - 1)]
        best = min(agenda)
        while best != NEVER:
            i = agenda.index(best)
            came += 1
            if not left:
                left = next(gaps)
                agenda[i] = NEVER
            else:
                left -= 1
                piece = sym[i] = sym[i] + sym[i + 1]
                del sym[i + 1], agenda[i]
                if i < len(agenda):
                    agenda[i] = get(piece + sym[i + 1], NEVER)
                if i:
                    agenda[i - 1] = get(sym[i - 1] + piece, NEVER)
                if not agenda:
                    break
            best = min(agenda)
        return self._ids(sym), came, left

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _by_width(self, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, *draws: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of about one length with how many candidates of each came up, the ids of all, and their numbers."""
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            if len(rows):
                yield rows, *self._side_by_side(letters, starts[rows], lengths[rows], width, *(x[rows] for x in draws))

    def _side_by_side(self, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, left: np.ndarray, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: how many candidates came up, its ids in one run, and how many they are."""
        n, cols = len(starts), np.arange(width)
        there = cols < lengths[:, None]
        sym = np.where(there, letters[np.where(there, starts[:, None] + cols, 0)], 0).ravel()
        alive = there.ravel().copy()
        after, before = np.tile(cols + 1, n), np.tile(cols - 1, n)
        agenda = np.full(n * width, NO_PIECE, np.int32)
        first = np.flatnonzero((cols + 1 < lengths[:, None]).ravel())
        agenda[first] = self.pairs.ranks[self.pairs(sym[first], sym[first + 1])]
        agenda = agenda.reshape(n, width)
        flat = agenda.reshape(-1)
        came, left, draw = np.zeros(n, np.int64), left.copy(), np.ones(n, np.uint64)
        act = np.arange(n)
        while True:
            now = agenda[act]
            i = now.argmin(1)
            on = now[np.arange(len(act)), i] != NO_PIECE
            act, i = act[on], i[on]
            if not len(act):
                break
            came[act] += 1
            at = act * width + i
            skip = left[act] == 0
            left[act] -= 1
            if skip.any():
                flat[at[skip]] = NO_PIECE
                self._draw_again(act[skip], left, draw, text, place)
                row, i, at = act[~skip], i[~skip], at[~skip]
            else:
                row = act
            base = row * width
            gone = base + after[at]
            piece = sym[at] = self.pairs.made[self.pairs(sym[at], sym[gone])]
            alive[gone] = False
            flat[gone] = NO_PIECE
            k = after[at] = after[gone]
            has = k < lengths[row]
            flat[at[~has]] = NO_PIECE
            at_, right = at[has], (base + k)[has]
            before[right] = i[has]
            flat[at_] = self.pairs.ranks[self.pairs(piece[has], sym[right])]
            k = before[at]
            has = k >= 0
            prior = (base + k)[has]
            flat[prior] = self.pairs.ranks[self.pairs(sym[prior], piece[has])]
        return came, sym[alive].astype(self.dtype), alive.reshape(n, width).sum(1)

    def _draw_again(self, rows: np.ndarray, left: np.ndarray, draw: np.ndarray, text: np.ndarray, place: np.ndarray) -> None:
        """The next gap of each row."""
        drawn = self._gaps(text[rows], place[rows], draw[rows])
        draw[rows] += np.uint64(1)
        left[rows] = drawn
        for r in rows[drawn == LONGEST].tolist():
            gap = LONGEST
            while True:
                drawn = int(self._gaps(text[r : r + 1], place[r : r + 1], draw[r : r + 1])[0])
                draw[r] += np.uint64(1)
                gap += drawn
                if drawn < LONGEST:
                    break
            left[r] = gap

    def _drawn(self, stretch: str, gap: float, more: Iterator[float]) -> tuple[bytes, float]:
        """A stretch's ids by its gaps, and what is left of the last one, as nothing is known yet of what follows."""
        ids, _, left = self.segment(stretch, chain((gap,), more))
        return self._pack(ids), left

    def _parts(self, unit: str) -> tuple[str, ...]:
        """A unit's stretches. Marks after a word are one of their own where no piece joins them to it."""
        body = unit.rstrip(MARKS)
        if not body or len(body) == len(unit) or body[-1] + unit[len(body)] in self.joined:
            return (unit,)
        return body, unit[len(body) :]

    def _learn(self, units: list[str]) -> None:
        """Keeps what is to be known of units: their pieces without skips."""
        parts = [(SIGN,) if u == SIGN else self._parts(u) for u in units]
        stretches = list(dict.fromkeys(chain.from_iterable(parts)))
        lengths = np.array([len(x) for x in stretches], np.int64)
        starts = np.cumsum(lengths) - lengths
        letters = self.letters[np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), "<u4")]
        fine = (lengths <= SHORT) & (np.minimum.reduceat(letters, starts) >= 0)
        came, at, n = np.zeros((3, len(stretches)), np.int64)
        some = np.flatnonzero(fine)
        none = np.zeros(len(some), np.uint64)
        for rows, c, ids, counts in self._by_width(letters, starts[some], lengths[some], np.full(len(some), 1 << 40), none, none):
            rows = some[rows]
            came[rows], n[rows] = c, counts
            at[rows] = self.all_ids.extend(ids) + np.cumsum(counts) - counts
        for k in np.flatnonzero(~fine).tolist():
            if stretches[k] == SIGN:
                ids = [self.bytes[b] for b in BLANK.encode()]
            else:
                ids, came[k], _ = self.segment(stretches[k], iter((NEVER,)))
            at[k], n[k] = self.all_ids.extend(ids), len(ids)
        starts += self.all_letters.extend(letters)
        number = {x: k for k, x in enumerate(stretches)}
        first = np.array([number[x[0]] for x in parts])
        tail = np.array([number[x[1]] if len(x) > 1 else -1 for x in parts])
        has = tail >= 0
        came_tail, n_tail = np.where(has, came[tail], 0), np.where(has, n[tail], 0)
        # a unit's own ids are those of its stretch; with marks, both stand next to each other anew
        own_at, own_n = at[first], n[first]
        both = np.flatnonzero(has)
        if len(both):
            ids = self._gathered(self.all_ids.data, np.stack([own_at[both], at[tail[both]]], 1).ravel(), np.stack([own_n[both], n_tail[both]], 1).ravel())
            own_n[both] += n_tail[both]
            own_at[both] = self.all_ids.extend(ids) + np.cumsum(own_n[both]) - own_n[both]
        base = self.came.extend(came[first] + came_tail)
        self.letters_at.extend(starts[first])
        self.letters_n.extend(np.where(fine[first] & (came_tail == 0), lengths[first], 0))  # 0 where occurrences with a skip have to go one by one
        self.ids_at.extend(own_at)
        self.ids_n.extend(own_n)
        self.tail_at.extend(np.where(has, at[tail], 0))
        self.tail_n.extend(n_tail)
        self.kept.update(zip(units, range(base, base + len(units)), strict=True))

    @staticmethod
    def _gathered(source: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The runs of ``source`` from each place on, one after another."""
        total = int(n.sum())
        return source[np.repeat(at - np.cumsum(n) + n, n) + np.arange(total)]

    def _units(self, text: str) -> list[str]:
        if "\n" in text and not (BLANK in text or "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " "):
            return self._lines(text)
        if "\n" in text or BLANK in text or "  " in text or text[0] == " " or text[-1] == " ":
            units = []
            for part in re.split(f"(\n|{BLANK})", BLANK.join(["", *text.split(" ")]) if BLANK not in text else " " + text):
                if BLANK in text:  # the sign itself stands alone, blanks become signs afterwards
                    if part in ("\n", BLANK):
                        units.append("\n" if part == "\n" else SIGN)
                    elif part:
                        units += re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", part.replace(" ", BLANK))
                elif part:
                    units.append(part)
            if BLANK in text:
                return units
            out, run = [], ""
            for u in units:  # runs of signs belong to the word after them
                if u == BLANK:
                    run += u
                elif u == "\n":
                    out += [run, u] if run else [u]
                    run = ""
                else:
                    out.append(run + u)
                    run = ""
            return [*out, run] if run else out
        return [BLANK + w for w in text.split(" ")]

    @staticmethod
    def _lines(text: str) -> list[str]:
        """Units of a text whose blanks all stand between two words of a line."""
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if k:
                out.append("\n")
                if words[0]:
                    out.append(words[0])
            else:
                out.append(BLANK + words[0])
            out += [BLANK + w for w in words[1:]]
        return out

    def _one(self, unit: str, gap: float, start: int, place: int) -> bytes:
        """An occurrence's ids, worked off by itself."""
        more, found = self.more(start, place), []
        for x in self._parts(unit):
            ids, gap = self._drawn(x, gap, more)
            found.append(ids)
        return b"".join(found)

    def encode_all(self, texts: list[str], keys: list[object]) -> list[np.ndarray]:
        """Ids of each text, its draws by its key."""
        if len(self.kept) > self.limit:
            self._forget()
        units: list[str] = []
        ends = []
        for t in texts:
            if t:
                units += self._units(t)
            ends.append(len(units))
        if not units:
            return [np.empty(0, self.dtype) for _ in texts]
        if missing := [u for u in dict.fromkeys(units) if u not in self.kept]:
            self._learn(missing)
        of = np.array([self.kept[u] for u in units])
        counts = np.diff(ends, prepend=0)
        text = np.repeat(np.array([xxhash.xxh3_64_intdigest(repr((self.seed, k)).encode()) for k in keys], np.uint64), counts)
        place = (np.arange(len(units)) - np.repeat(np.array(ends) - counts, counts)).astype(np.uint64)
        gaps = self.gaps(text, place)
        at, n = (np.stack([c.data[of], np.zeros(len(units), np.int64)], 1) for c in (self.ids_at, self.ids_n))
        skipped = np.flatnonzero(gaps < self.came.data[of])
        lengths = self.letters_n.data[of[skipped]]
        jobs, extra, have = skipped[lengths > 0], [self.all_ids.data[: self.all_ids.n]], self.all_ids.n
        if len(jobs):
            u = of[jobs]
            at[jobs, 1], n[jobs, 1] = self.tail_at.data[u], self.tail_n.data[u]
            for rows, _, ids, some in self._by_width(self.all_letters.data, self.letters_at.data[u], self.letters_n.data[u], gaps[jobs].astype(np.int64), text[jobs], place[jobs]):
                at[jobs[rows], 0], n[jobs[rows], 0] = have + np.cumsum(some) - some, some
                extra.append(ids)
                have += len(ids)
        for k in skipped[lengths == 0].tolist():
            ids = np.frombuffer(self._one(units[k], int(gaps[k]), int(text[k]), int(place[k])), self.dtype)
            at[k, 0], n[k, 0] = have, len(ids)
            extra.append(ids)
            have += len(ids)
        found = self._gathered(np.concatenate(extra), at.ravel(), n.ravel())
        cuts = np.concatenate([[0], np.cumsum(n.sum(1))])[np.array([0, *ends])]
        return [found[lo:hi] for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, text: str, key: object) -> np.ndarray:
        return self.encode_all([text], [key])[0]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.values.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")


def encode_pieces(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 16 bits, 32 for large models) and n_ids of each row, drawn by its id.

    Null and empty texts have no ids. One pass, no shuffle; rows that repeat get equal ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = DropoutEncoder(model, rate, seed)
        for batch in slices(batches):
            ids = enc.encode_all([t or "" for t in batch.column(1).to_pylist()], batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())], names=["doc_id", "ids", "n_ids"]
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, ids binary, n_ids long")


def decode_pieces(rows: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, n_ids and the decoded text of rows as ``encode_pieces`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = DropoutEncoder(model)
        for batch in slices(batches):
            texts = [enc.decode(np.frombuffer(x or b"", enc.dtype)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "n_ids", "text"])

    return rows.select("doc_id", "ids", "n_ids").mapInArrow(run, "doc_id long, ids binary, n_ids long, text string")


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` encoded with merge dropout and decoded again: number and digest of ids, digest of the decoded text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), model, 0.1, 20240101), model)
    return rows.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))

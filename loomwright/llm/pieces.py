"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut where no piece of the vocabulary can cross: before each run of
spaces and between bytes that no piece has side by side. The distinct cuts that are new to
the worker are concatenated, in runs of bounded size. A suffix array indexes such a run;
every piece finds its range of occurrences there by binary search; the occurrences are
edges, sorted by position; and one pass relaxes them: the encoding that ends at a position
ends with the one edge that stands together with the last piece of the encoding that ends
where the edge begins. Two pieces stand together if the merges of the vocabulary, applied
to their joint text, give the two again. That gives exactly the pieces that merging by
score gives. Places that no edge crosses part a run into independent parts, which are
relaxed side by side; a part that is still long goes place by place, and a cut longer than
a run is relaxed run by run. Code points without a piece become bytes.

The vocabulary is read once from a model file, by its path; it isn't trained here. A worker
builds the tables for it once, whatever the number of its tasks, and remembers the cuts that
it has encoded up to a number of bytes; cuts are told apart by their bytes.

Cases: null and empty texts have no ids. The marker of spaces (U+2581) in a text counts
as a space, as the vocabulary writes it, so decoding gives a space there and ``exact`` is
false. Very long texts and texts without spaces are encoded whole, in time in proportion to
their length. Repeated rows give repeated results, empty tables none. Only the id and text
columns are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .storage import small_batches

SCHEMA = "doc_id long, n_tokens long, ids array<int>, exact boolean"
MARK = "▁"
#: Bytes of cuts and their ids that a worker remembers, about; beyond that it starts anew. Longer cuts aren't remembered.
REMEMBERED, LONGEST_REMEMBERED = 16 << 20, 1 << 10
#: Bytes of text that are encoded at a time, and bytes of new cuts that are indexed together.
SLICE, RUN = 1 << 20, 1 << 17
#: Parts up to so many bytes are relaxed side by side.
SIDE_BY_SIDE = 128


class Vocabulary:
    """Pieces, scores and byte ids of a model, as plain values that can be shipped to executors."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: set[int], unknown: int):
        self.pieces, self.byte_ids, self.special, self.unknown = pieces, byte_ids, special, unknown
        self.rank = {p.replace(MARK, " ").encode(): (-s, i) for i, (p, s) in enumerate(zip(pieces, scores)) if i not in special}
        self.text = [b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for value, i in enumerate(byte_ids):
            self.text[i] = bytes([value])
        #: Whether spaces stand only at the front of pieces, so that nothing crosses into a run of spaces.
        self.cut_at_spaces = not any(b" " in p.lstrip(b" ") for p in self.rank)
        self.name = hashlib.sha256(repr((pieces, scores, byte_ids, sorted(special), unknown)).encode()).hexdigest()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        by_byte = {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        special = {i for i in range(n) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i)}
        return cls(pieces, [model.get_score(i) for i in range(n)], [by_byte[b] for b in range(256)] if len(by_byte) == 256 else [], special, model.unk_id())


def characters(raw: bytes) -> list[bytes]:
    return [c.encode() for c in raw.decode()]


def merged(symbols: list[bytes], rank: dict[bytes, tuple[float, int]], leave: int = 1) -> list[bytes]:
    """Merges of the best-scored neighbours until there are none or few left; the leftmost of equals first."""
    while len(symbols) > leave:
        best = min(((rank[x][0], k) for k in range(len(symbols) - 1) if (x := symbols[k] + symbols[k + 1]) in rank), default=None)
        if best is None:
            break
        k = best[1]
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
    return symbols


def _packed(data: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each position on, as numbers in the order of the bytes."""
    room = np.zeros(n + 8, np.uint8)
    room[: len(data)] = data
    return np.ndarray((n,), ">u8", room.data, 0, (1,)).astype(np.uint64)


def suffix_array(heads: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` bytes at least, by the eight bytes from each position on."""
    keys, width = heads[:n], 8
    while True:
        order = np.argsort(keys)
        if width >= depth:
            return order.astype(np.int32)
        ranked = keys[order]
        fresh = np.ones(n, np.int64)
        fresh[1:] = ranked[1:] != ranked[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        keys = rank << 32
        keys[: max(n - width, 0)] |= rank[width:]
        width *= 2


class Encoder:
    """Encodes batches; lives in a worker and remembers the cuts that it has encoded."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._learn_merges(vocabulary.rank)
        self.sorted = sorted(self.number)
        self.numbers = np.array([self.number[p] for p in self.sorted], np.int64)
        self.lengths = np.array([len(p) for p in self.sorted], np.int64)
        self.depth = int(self.lengths.max(initial=1))
        steps = -(-self.depth // 8)
        table = np.zeros((len(self.sorted), steps * 8), np.uint8)
        for k, p in enumerate(self.sorted):
            table[k, : len(p)] = np.frombuffer(p, np.uint8)
        self.keys = table.reshape(len(self.sorted), steps, 8).astype(np.uint64)
        weights = np.array([1 << (56 - 8 * k) for k in range(8)], np.uint64)
        self.keys = (self.keys * weights).sum(2, dtype=np.uint64)
        kept = np.clip(self.lengths[:, None] - 8 * np.arange(steps), 0, 8)
        masks = np.array([((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1) for k in range(9)], np.uint64)
        self.masks = masks[kept]
        self.forms = np.frombuffer(b"".join(vocabulary.text), np.uint8)
        self.form_at = np.concatenate([[0], np.cumsum([len(x) for x in vocabulary.text])]).astype(np.int64)
        self.crossed = np.zeros(1 << 16, bool)
        for p in self.number:
            q = np.frombuffer(p, np.uint8).astype(np.int64)
            self.crossed[(q[:-1] << 8) | q[1:]] = True
        self.alone: dict[int, bool] = {}
        self._forget()

    def _learn_merges(self, rank: dict[bytes, tuple[float, int]]) -> None:
        """Numbers the pieces that merging can reach: single code points first, then by the order of merges.

        ``split`` has the two pieces that each one is merged from last, ``pair_keys`` and ``pair_to`` what
        any two neighbours would merge to.
        """
        halves = {p: merged(characters(p), rank, leave=2) for p in rank}
        single = sorted(p for p, x in halves.items() if len(x) == 1)
        joined = sorted((p for p, x in halves.items() if len(x) == 2 and merged(list(x), rank) == [p]), key=lambda p: rank[p][0])
        self.leaves, self.count = len(single), len(single) + len(joined)
        self.number = {p: k for k, p in enumerate(single + joined)}
        self.ids = np.array([rank[p][1] for p in self.number], np.int64)
        self.size_of = np.array([len(p) for p in self.number], np.int64)
        self.split = np.array([[k, k] for k in range(self.leaves)] + [[self.number[x] for x in halves[p]] for p in joined], np.int64).reshape(-1, 2)
        levels = {x: k for k, x in enumerate(sorted({rank[p][0] for p in joined}), 1)}
        self.level = np.array([0] * self.leaves + [levels[rank[p][0]] for p in joined], np.int64)
        pairs = sorted((self.number[p[:k]] * self.count + self.number[p[k:]], self.number[p]) for p in joined for k in range(1, len(p)) if p[:k] in self.number and p[k:] in self.number)
        self.pair_keys, self.pair_to = np.array(pairs or [(-1, 0)], np.int64).T.copy()
        self.merge = dict(pairs)
        self.halves, self.steps = self.split.tolist(), self.level.tolist()

    def _forget(self) -> None:
        """Remembered cuts by the order of their hashes: their bytes and their ids, one after the other each."""
        self.keys_known = np.zeros(0, np.uint64)
        self.cut_bytes, self.cut_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.cut_ids, self.id_at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.place_known = np.zeros(0, np.int64)

    def occurrences(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every place of every piece: its position and the piece's number, by binary search in a suffix array."""
        n = len(data)
        heads = _packed(data, n + self.depth + 8)
        order = suffix_array(heads, n, self.depth)
        count = len(self.sorted)

        def bound(strict: bool) -> np.ndarray:
            low, high = np.zeros(count, np.int64), np.full(count, n, np.int64)
            while (open_ := low < high).any():
                middle = (low + high) // 2
                at = order[np.minimum(middle, n - 1)]
                before, equal = np.zeros(count, bool), np.ones(count, bool)
                for step in range(self.keys.shape[1]):
                    here = heads[at + 8 * step] & self.masks[:, step]
                    before |= equal & (here < self.keys[:, step])
                    equal &= here == self.keys[:, step]
                right = before | equal if strict else before
                low = np.where(open_ & right, middle + 1, low)
                high = np.where(open_ & ~right, middle, high)
            return low

        first, last = bound(False), bound(True)
        found = last - first
        piece = np.repeat(np.arange(count), found)
        return order[tb.ragged(first, found)].astype(np.int64), self.numbers[piece]

    def together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging by score leaves the border between two neighbours alone.

        The last merges inside the two are taken back one by one, the latest first. If the pieces that
        then meet at the border could have merged before the merge just taken back, they would have.
        Of merges of equal score the leftmost comes first.
        """
        good = np.ones(len(left), bool)
        todo = np.flatnonzero((left >= 0) & (left < self.count) & (right < self.count))
        left, right, limit = left[todo], right[todo], np.full(len(todo), np.iinfo(np.int64).max)
        while len(todo):
            keys = left * self.count + right
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            crossing = (self.pair_keys[at] == keys) & (self.level[self.pair_to[at]] < limit)
            good[todo[crossing]] = False
            open_left, open_right = left >= self.leaves, right >= self.leaves
            take_left = open_left & (self.level[left] > self.level[right])
            limit = np.where(take_left, self.level[left], self.level[right] + 1)
            left, right = np.where(take_left, self.split[left, 1], left), np.where(take_left, right, self.split[right, 0])
            on = ~crossing & (open_left | open_right)
            todo, left, right, limit = todo[on], left[on], right[on], limit[on]
        return good

    def stand_together(self, left: int, right: int) -> bool:
        """The same for one pair; what was found is remembered."""
        name = left * self.count + right
        known = self.alone.get(name)
        if known is None:
            if len(self.alone) >= 1 << 18:
                self.alone.clear()
            known = self.alone[name] = left < 0 or left >= self.count or right >= self.count or self._meet(left, right)
        return known

    def _meet(self, left: int, right: int) -> bool:
        limit = np.inf
        while True:
            to = self.merge.get(left * self.count + right)
            if to is not None and self.steps[to] < limit:
                return False
            open_left, open_right = left >= self.leaves, right >= self.leaves
            if not open_left and not open_right:
                return True
            if open_left and self.steps[left] > self.steps[right]:
                limit, left = self.steps[left], self.halves[left][1]
            else:
                limit, right = self.steps[right] + 1, self.halves[right][0]

    def edges(self, data: np.ndarray, strange: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and number of each piece's occurrences; a code point that is no piece itself is an edge as well.

        Such a code point gets a number after the pieces, by ``strange``, which grows.
        """
        start, piece = self.occurrences(data)
        stop = start + self.size_of[piece]
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        tails = np.append(heads[1:], len(data))
        single = np.zeros(len(data), bool)
        single[start[piece < self.leaves]] = True
        lone = np.flatnonzero(~single[heads])
        if len(lone):
            texts = [data[heads[k] : tails[k]].tobytes() for k in lone.tolist()]
            numbers = [strange.setdefault(x, self.count + len(strange)) for x in texts]
            start, stop = np.concatenate([start, heads[lone]]), np.concatenate([stop, tails[lone]])
            piece = np.concatenate([piece, np.array(numbers, np.int64)])
        return start, stop, piece

    def encode_cuts(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all cuts together, in runs, and the number of each cut's; ``data`` has the cuts one after the other."""
        ends = np.cumsum(sizes)
        out, counts, k = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while k < len(sizes):
            begin = int(ends[k] - sizes[k])
            if sizes[k] > RUN:
                until = k + 1
                ids = self._ids(*self._numbers_of_long(data[begin : ends[k]]))[0]
                out.append(ids)
                counts.append(np.array([len(ids)]))
            else:
                until = max(k + 1, int(np.searchsorted(ends, begin + RUN, "right")))
                ids, each = self._encode_run(data[begin : ends[until - 1]], sizes[k:until])
                out.append(ids)
                counts.append(each)
            k = until
        return np.concatenate(out), np.concatenate(counts)

    def _encode_run(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the cuts of a run by one suffix array over all of them."""
        n, ends, strange = len(data), np.cumsum(sizes), {}
        begins = ends - sizes
        start, stop, piece = self.edges(data, strange)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        fits = stop <= ends[owner[start]]
        start, stop, piece = start[fits], stop[fits], piece[fits]
        # Parts end where no edge goes on.
        crossing = np.cumsum(np.bincount(start + 1, minlength=n + 1) - np.bincount(stop, minlength=n + 1))
        border = crossing[:n] == 0
        border[begins] = True
        first = np.flatnonzero(border)
        part = np.cumsum(border) - 1
        last_place = np.append(first[1:], n)
        # A part's last place is the next one's first, so places count one more for each part before.
        own = part[start]
        reach = stop - first[own]
        long = last_place - first > SIDE_BY_SIDE
        short = ~long[own]
        order = np.flatnonzero(short)
        order = order[np.argsort(reach[order].astype(np.uint8), kind="stable")]
        last, source = np.full(n + len(first), -2, np.int64), np.zeros(n + len(first), np.int64)
        last[first + np.arange(len(first))] = -1
        from_, to, with_ = start[order] + own[order], stop[order] + own[order], piece[order]
        until = np.searchsorted(reach[order], np.arange(1, SIDE_BY_SIDE + 2))
        for a, b in zip(until[:-1].tolist(), until[1:].tolist()):
            if a == b:
                continue
            before = last[from_[a:b]]
            here = np.flatnonzero(before >= -1)
            here = here[self.together(before[here], with_[a:b][here])] + a
            last[to[here]] = with_[here]
            source[to[here]] = from_[here]
        rest = np.flatnonzero(~short)
        rest = rest[np.argsort(stop[rest], kind="stable")]
        numbers_of_long = np.flatnonzero(long)
        for k, a, b in zip(numbers_of_long.tolist(), np.searchsorted(own[rest], numbers_of_long).tolist(), np.searchsorted(own[rest], numbers_of_long, "right").tolist()):
            mine = rest[a:b]
            size = int(last_place[k] - first[k])
            found = array("q", [-1]) + array("q", [-2]) * size
            self._by_place(found, start[mine] - first[k], stop[mine] - first[k], piece[mine], strange)
            places, numbers = self._back(found, strange)
            last[first[k] + k + places] = numbers
            source[first[k] + k + places] = first[k] + k + np.concatenate([[0], places[:-1]])
        # Back from the ends, all parts side by side, but long ones on their own.
        at = np.arange(len(first))
        place, taken = last_place + at, []
        while len(at):
            taken.append((place, last[place]))
            place = source[place]
            more = place > first[at] + at
            at, place = at[more], place[more]
        place, number = (np.concatenate(x) for x in zip(*taken))
        order = np.argsort(place)
        place, number = place[order], number[order]
        # A place counts the parts before it, so the place of a cut's end is that of its last part.
        bound = ends + part[ends - 1]
        ids, lengths = self._ids(number, strange)
        total = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(place, bound, "right")]
        return ids, np.diff(total, prepend=0)

    def _by_place(self, found: array, start: np.ndarray, stop: np.ndarray, piece: np.ndarray, strange: dict[bytes, int]) -> None:
        """Relaxes edges in the order of their ends, one by one; ``found`` has the last piece of what ends at each place."""
        for s, e, p in zip(start.tolist(), stop.tolist(), piece.tolist()):
            before = found[s]
            if before >= -1 and found[e] == -2 and self.stand_together(before, p):
                found[e] = p

    def _back(self, found: array, strange: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """The ends and numbers of the pieces that lead to the last place."""
        sizes = [len(x) for x in strange]
        places, numbers, at = [], [], len(found) - 1
        while at > 0:
            number = found[at]
            places.append(at)
            numbers.append(number)
            at -= int(self.size_of[number]) if number < self.count else sizes[number - self.count]
        return np.array(places[::-1], np.int64), np.array(numbers[::-1], np.int64)

    def _numbers_of_long(self, data: np.ndarray) -> tuple[np.ndarray, dict[bytes, int]]:
        """Numbers of the pieces of one cut that is longer than a run: runs overlap by the longest piece."""
        n, strange = len(data), {}
        found = array("q", [-1]) + array("q", [-2]) * n
        held = [np.zeros(0, np.int64)] * 3
        for at in range(0, n, RUN):
            start, stop, piece = self.edges(data[at : at + RUN + self.depth + 8], strange)
            # What is cut off at the run's end is found whole in the next one.
            mine = start < RUN
            more = start[mine] + at, stop[mine] + at, piece[mine]
            edges = [np.concatenate(x) for x in zip(held, more)]
            now = edges[1] <= at + RUN
            held = [x[~now] for x in edges]
            start, stop, piece = (x[now] for x in edges)
            order = np.argsort(stop, kind="stable")
            self._by_place(found, start[order], stop[order], piece[order], strange)
        return self._back(found, strange)[1], strange

    def _ids(self, number: np.ndarray, strange: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by their numbers, and how many each has: strange code points become bytes."""
        ids, lengths = self.ids[np.minimum(number, len(self.ids) - 1)], np.ones(len(number), np.int64)
        odd = np.flatnonzero(number >= self.count)
        if len(odd):
            forms = list(strange)
            fallback = [[self.v.byte_ids[b] for b in forms[k - self.count]] if self.v.byte_ids else [self.v.unknown] for k in number[odd].tolist()]
            lengths[odd] = [len(x) for x in fallback]
            ids = np.repeat(ids, lengths)
            ids[tb.ragged((np.cumsum(lengths) - lengths)[odd], lengths[odd])] = [i for x in fallback for i in x]
        return ids.astype(np.int32), lengths

    def _looked_up(self, data: np.ndarray, hasher: tb.Hasher, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these different cuts together, and the number of each one's; new cuts are encoded and remembered."""
        keys = hasher(start, end)
        at = np.minimum(np.searchsorted(self.keys_known, keys), max(len(self.keys_known) - 1, 0))
        hit = self.keys_known[at] == keys if len(self.keys_known) else np.zeros(len(keys), bool)
        where = self.place_known[at[hit]]
        known = tb.Hasher(self.cut_bytes)
        hit[hit] = hasher.same(start[hit], end[hit], known, self.cut_at[where], self.cut_at[where + 1])
        place = np.full(len(keys), -1, np.int64)
        place[hit] = self.place_known[at[hit]]
        new = np.flatnonzero(~hit)
        sizes = (end - start)[new]
        fresh = data[tb.ragged(start[new], sizes)]
        ids, counts = self.encode_cuts(fresh, sizes)
        place[new] = len(self.cut_at) - 1 + np.arange(len(new))
        ids_at = np.concatenate([self.id_at, self.id_at[-1] + np.cumsum(counts)])
        flat = np.concatenate([self.cut_ids, ids])
        mine = ids_at[place + 1] - ids_at[place]
        out = flat[tb.ragged(ids_at[place], mine)], mine
        self._remember(keys[new], fresh, sizes, ids, counts)
        return out

    def _remember(self, keys: np.ndarray, data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        if len(self.cut_bytes) + 4 * len(self.cut_ids) + 40 * len(self.keys_known) > REMEMBERED:
            self._forget()
        # A hash that is known for another cut stays with that one.
        _, first = np.unique(keys, return_index=True)
        some = np.zeros(len(keys), bool)
        some[first] = True
        some &= sizes <= LONGEST_REMEMBERED
        some &= ~np.isin(keys, self.keys_known)
        some = np.flatnonzero(some)
        if not len(some):
            return
        begin, from_ = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
        place = len(self.cut_at) - 1 + np.arange(len(some))
        self.cut_bytes = np.concatenate([self.cut_bytes, data[tb.ragged(begin[some], sizes[some])]])
        self.cut_at = np.concatenate([self.cut_at, self.cut_at[-1] + np.cumsum(sizes[some])])
        self.cut_ids = np.concatenate([self.cut_ids, ids[tb.ragged(from_[some], counts[some])]])
        self.id_at = np.concatenate([self.id_at, self.id_at[-1] + np.cumsum(counts[some])])
        keys, place = np.concatenate([self.keys_known, keys[some]]), np.concatenate([self.place_known, place])
        order = np.argsort(keys)
        self.keys_known, self.place_known = keys[order], place[order]

    def _encode_group(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all these cuts together and the number of each one's; equal cuts are looked up once."""
        hasher = tb.Hasher(data)
        _, first, number = np.unique(tb.numbered(hasher, start, end), return_index=True, return_inverse=True)
        flat, sizes = self._looked_up(data, hasher, start[first], end[first])
        mine = sizes[number]
        return flat[tb.ragged((np.cumsum(sizes) - sizes)[number], mine)], mine

    def _unlike(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The cuts whose ids don't decode to their bytes."""
        lengths = np.diff(self.form_at)[ids]
        back = self.forms[tb.ragged(self.form_at[ids], lengths)]
        if len(back) == len(data) and (back == data).all():
            return np.zeros(0, np.int64)
        back_at = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        a, b, at = data.tobytes(), back.tobytes(), np.concatenate([[0], np.cumsum(sizes)])
        return np.array([k for k in range(len(sizes)) if a[at[k] : at[k + 1]] != b[back_at[k] : back_at[k + 1]]], np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts together, where each text's begin, and whether decoding gives the text again."""
        column = pc.fill_null(column, "")
        source, source_at = tb.buffers(column)
        marked = pc.replace_substring(column, MARK, " ") if pc.any(pc.match_substring(column, MARK)).as_py() else column
        plain, plain_at = tb.buffers(marked)
        filled = np.flatnonzero(np.diff(plain_at))
        data = np.insert(plain, plain_at[filled], 32)
        at = plain_at + np.concatenate([[0], np.cumsum(np.diff(plain_at) > 0)])
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64), np.ones(len(at) - 1, bool)
        pairs = data[:-1].astype(np.uint16) << 8
        pairs |= data[1:]
        cut = np.ones(len(data), bool)
        np.logical_not(self.crossed[pairs], out=cut[1:])
        del pairs
        cut &= (data & 0xC0) != 0x80
        cut[at[filled]] = True
        if self.v.cut_at_spaces:
            space = data == 32
            cut[1:] |= space[1:] & ~space[:-1]
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        # Cuts go on in groups of bounded size, so that a very long text takes little more than its bytes.
        flat, counts, exact, k = [], [], np.ones(len(at) - 1, bool), 0
        while k < len(start):
            until = max(k + 1, int(np.searchsorted(end, start[k] + SLICE, "right")))
            part = data[start[k] : end[until - 1]]
            ids, mine = self._encode_group(part, start[k:until] - start[k], end[k:until] - start[k])
            wrong = self._unlike(ids, mine, part, end[k:until] - start[k:until])
            exact[np.searchsorted(at, start[k:until][wrong], "right") - 1] = False
            flat.append(ids)
            counts.append(mine)
            k = until
        token_at = np.concatenate([[0], np.cumsum(np.concatenate(counts))])[np.searchsorted(start, at)]
        exact &= np.diff(plain_at) == np.diff(source_at)
        ids = np.concatenate(flat)
        return ids, token_at, exact

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts of ids as bytes, without the space that encoding puts in front."""
        sizes = np.diff(self.form_at)[ids]
        data = self.forms[tb.ragged(self.form_at[ids], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])[at]
        first = total[:-1][np.diff(total) > 0]
        drop = first[data[first] == 32]
        return np.delete(data, drop), total - np.searchsorted(drop, total, "left")


_encoders: dict[str, Encoder] = {}


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder for this vocabulary; one is kept."""
    if vocabulary.name not in _encoders:
        _encoders.clear()
        _encoders[vocabulary.name] = Encoder(vocabulary)
    return _encoders[vocabulary.name]


def encode_pieces(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Ids of every whole text, and whether they decode to it, one row for each row of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shipped.value)
        for part in tb.parts(batches, "text", SLICE):
            ids, at, exact = encoder.encode(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at), pa.int64()), lists, pa.array(exact)], [x.split()[0] for x in SCHEMA.split(", ")])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def decode_pieces(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The text of each list of ids: ``doc_id, text``. A null list gives an empty text."""
    shipped = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shipped.value)
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            data, text_at = encoder.decode(np.fromiter((i for x in lists for i in x), np.int64, int(at[-1])), at)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[text_at[k] : text_at[k + 1]].decode(errors="replace") for k in range(len(lists))], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")

"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda (a heap) of adjacent symbol pairs that form a piece,
best score first and leftmost among equals, and merges the head until none is
left; symbols that are no piece fall back to their UTF-8 bytes.  A merge can
only join characters that stand next to each other inside some piece, so the
text is first cut wherever two neighbours never do: the cuts change no result,
the parts are short, and a part that comes again need not be encoded again.
In every Arrow batch the parts that are new are encoded together, one merge of
each at a step, and held against the sentencepiece library, as is the decoding
of every text; should they ever differ, the library's result is kept and
``agrees`` is false.  (Vocabularies whose pieces hold inner spaces can't be
cut; their texts are compared whole.)

Cases: null and empty texts have no ids; very long texts without spaces are
one agenda of n log n steps; rows are independent, so repeated rows and extra
columns need no care; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoloom.llm.words import giving_back, slices

MARK = "▁"
#: Parts kept a worker; beyond that the store starts anew.
CACHE_PARTS = 250_000
ROWS_A_BATCH = 512
#: Parts up to this length keep their agenda in a flat list, longer ones in a heap.
SHORT = 24
NONE = 1 << 60


class Words(dict):
    """word -> ids (packed int32) of the word with the mark in front."""

    def __init__(self, encoder: MergeEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        return self.encoder[MARK + word]


def packed(ids) -> bytes:
    return np.array(ids, np.int32).tobytes()


class MergeEncoder(dict):
    """part of a text -> its ids, packed as int32; a dict that fills itself."""

    def __init__(self, processor):
        super().__init__()
        n = processor.get_piece_size()
        pieces = [processor.id_to_piece(i) for i in range(n)]
        special = [processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        # place of every piece when all are ordered by score, equal scores sharing one
        places = {x: k for k, x in enumerate(sorted({processor.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.places = {p: places[processor.get_score(i)] for p, i in self.ids.items()}
        self.bytes = {int(pieces[i][3:-1], 16): i for i in range(n) if processor.is_byte(i)}
        self.unknown = processor.unk_id()
        self.words = Words(self)
        self.processor, self.runs, self.differing = processor, {}, set()
        self.near = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.spaced = any(MARK in p.lstrip(MARK) for p in self.ids)
        surface = [b"" if processor.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for value, i in self.bytes.items():
            surface[i] = bytes([value])
        surface[self.unknown] = " ⁇ ".encode()
        self.surface = surface

    def __missing__(self, part: str) -> bytes:
        pieces = self.cut(part)
        if len(pieces) > 1:
            found = b"".join([self[x] for x in pieces])
        else:
            found = packed(self.short_agenda(part) if len(part) <= SHORT else self.agenda(part))
        if len(part) <= 48:
            self[part] = found
        return found

    def pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (left symbol << 32 | right symbol) of pairs that form a piece, and its place << 32 | id."""
        if not hasattr(self, "_pairs"):
            keys, values = [], []
            for piece, i in self.ids.items():
                for cut in range(1, len(piece)):
                    a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                    if a is not None and b is not None:
                        keys.append(a << 32 | b)
                        values.append(self.places[piece] << 32 | i)
            order = np.argsort(np.array(keys, np.int64))
            self._pairs = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
            single = {p: i for p, i in self.ids.items() if len(p) == 1}
            self._chars = np.full(0x110000, -1, np.int64)
            self._chars[[ord(c) for c in single]] = list(single.values())
        return self._pairs

    def agendas(self, parts: list[str]) -> list[bytes]:
        """The agendas of many parts, one merge of each at a step.

        Symbols are a matrix, a part a row; ``waiting`` holds the place of every
        adjacent pair.  A step takes the least place of each row, the first
        among equals, merges there and looks up the two pairs beside it.
        Characters that are no piece stand as -2 - code point and never merge.
        """
        keys, values = self.pair_table()
        none = np.int64(NONE)

        def look(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = (a << 32) | b
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where((keys[at] == key) & (a >= 0) & (b >= 0), values[at], none)

        lengths = np.array([len(p) for p in parts])
        width = int(lengths.max()) + 1
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
        ids = self._chars[codes]
        inside = np.arange(width)[None, :] < lengths[:, None]
        symbols = np.full((len(parts), width), -1, np.int64)
        symbols[inside] = np.where(ids >= 0, ids, -2 - codes)
        waiting = np.full_like(symbols, none)
        waiting[:, :-1] = look(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(len(parts))
        columns = np.arange(width)[None, :]
        done_symbols = np.full_like(symbols, -1)
        while len(rows):
            at = waiting.argmin(axis=1)
            k = np.arange(len(rows))
            head = waiting[k, at]
            go = head < none
            if not go.all():
                done_symbols[rows[~go]] = symbols[~go]
                rows, symbols, waiting, at, head = rows[go], symbols[go], waiting[go], at[go], head[go]
                if not len(rows):
                    break
                k = np.arange(len(rows))
            later = columns[:, :-1] > at[:, None]  # what lies right of the merge moves up by one
            symbols[:, :-1] = np.where(later, symbols[:, 1:], symbols[:, :-1])
            symbols[:, -1] = -1
            waiting[:, :-1] = np.where(columns[:, :-1] >= at[:, None], waiting[:, 1:], waiting[:, :-1])
            waiting[:, -1] = none
            joined = head & 0xFFFFFFFF
            symbols[k, at] = joined
            waiting[k, at] = look(joined, symbols[k, np.minimum(at + 1, width - 1)])
            left = at > 0
            waiting[k[left], at[left] - 1] = look(symbols[k[left], at[left] - 1], joined[left])
        sizes = (done_symbols != -1).sum(axis=1)
        strange = set(np.flatnonzero((done_symbols < -1).any(axis=1)).tolist())
        raw, step = done_symbols.astype(np.int32).tobytes(), 4 * width
        out = [raw[i * step : i * step + 4 * n] for i, n in enumerate(sizes.tolist())]
        for i in strange:
            out[i] = packed(self.numbered([chr(-2 - x) if x < 0 else x for x in done_symbols[i, : sizes[i]].tolist()]))
        return out

    def learn(self, texts: list[str]) -> None:
        """Encode the words of a batch that are new, all together, and hold them against the library in one call."""
        if self.spaced:
            return
        seen = set()
        for t in texts:
            seen.update(t.split(" "))
        new = [w for w in seen.difference(self.words) if w and MARK not in w]
        if len(self.words) + len(new) > CACHE_PARTS:
            self.words.clear()
            self.clear()
            new = [w for w in seen if w and MARK not in w]
        new.sort(key=len)  # a matrix of agendas is as wide as its longest part
        plain = [w for w in new if len(w) < SHORT and "\n" not in w]
        for at in range(0, len(plain), 8192):
            some = plain[at : at + 8192]
            self.words.update(zip(some, self.agendas([MARK + w for w in some])))
        rest = {w: self.cut(MARK + w) for w in set(new).difference(plain)}  # cut where no piece reaches across
        short = sorted({x for parts in rest.values() for x in parts if len(x) <= SHORT}.difference(self), key=len)
        for at in range(0, len(short), 8192):
            some = short[at : at + 8192]
            self.update(zip(some, self.agendas(some)))
        self.words.update([(w, b"".join([self[x] for x in parts])) for w, parts in rest.items()])
        theirs = self.processor.encode(new, num_threads=1)
        flat = np.fromiter(chain.from_iterable(theirs), np.int32)
        mine = [self.words[w] for w in new]
        same = b"".join(mine) == flat.tobytes() and list(map(len, mine)) == [4 * n for n in map(len, theirs)]
        if not same:
            for w, t in zip(new, theirs):
                if self.words[w] != packed(t):
                    self.words[w] = packed(t)
                    self.differing.add(w)

    def run_of_marks(self, part: str) -> bytes:
        """Ids of several marks and the word after them, held against the library."""
        if part not in self.runs:
            own, theirs = self[part], packed(self.processor.encode(part[1:].replace(MARK, " ")))
            if own != theirs:
                self.differing.add(part)
            self.runs[part] = theirs
        return self.runs[part]

    def cut(self, part: str) -> list[str]:
        at = [0, *(i for i in range(1, len(part)) if part[i - 1 : i + 1] not in self.near), len(part)]
        return [part[a:b] for a, b in zip(at, at[1:])]

    def short_agenda(self, part: str) -> list[int]:
        """The agenda as a flat list of places: its least entry, the first among equals, is the next merge."""
        symbols, place = list(part), self.places.get
        waiting = [place(a + b, NONE) for a, b in zip(part, part[1:])]
        while waiting and (head := min(waiting)) < NONE:
            i = waiting.index(head)
            symbols[i : i + 2] = [joined := symbols[i] + symbols[i + 1]]
            del waiting[i]
            if i:
                waiting[i - 1] = place(symbols[i - 1] + joined, NONE)
            if i < len(waiting):
                waiting[i] = place(joined + symbols[i + 1], NONE)
        return self.numbered(symbols)

    def agenda(self, part: str) -> list[int]:
        """The agenda as a heap of (place, position) over a linked list of symbols."""
        symbols, n, places = list(part), len(part), self.places
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(places[a + b], i, a + b) for i, (a, b) in enumerate(zip(part, part[1:])) if a + b in places]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != joined:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = joined, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (pair := symbols[left] + symbols[after[left]]) in places:
                    heapq.heappush(heap, (places[pair], left, pair))
        return self.numbered([s for s in symbols if s is not None])

    def numbered(self, symbols: list) -> list[int]:
        """Ids of symbols, which are strings or ids already; bytes for what is no piece."""
        ids = [s if isinstance(s, int) else self.ids.get(s) for s in symbols]
        if None not in ids:
            return ids
        out: list[int] = []
        for s, i in zip(symbols, ids):
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a text; the dummy mark goes in front of any text that isn't empty."""
        if not text:
            return b""
        parts = text.replace(MARK, " ").split(" ")
        if self.spaced:
            return self[MARK + MARK.join(parts)]
        if "" not in parts:
            return b"".join([self.words[p] for p in parts])
        out: list[bytes] = []
        marks = ""
        for p in parts:
            marks += MARK
            if p:
                out.append(self.words[p] if marks == MARK else self.run_of_marks(marks + p))
                marks = ""
        if marks:
            out.append(self.run_of_marks(marks) if len(marks) > 1 else self[marks])
        if len(self.runs) > CACHE_PARTS // 10:
            self.runs.clear()
        return b"".join(out)

    def agreed(self, text: str) -> bool:
        """Whether all parts of a text were encoded as the library encodes them."""
        return not self.differing or self.differing.isdisjoint(text.replace(MARK, " ").split(" "))

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.surface[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _load(model_path: str):
    """The library's processor and our encoder; kept while the Python worker lives."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return processor, MergeEncoder(processor)


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ids array<int>, decoded string, agrees boolean; one row a row of ``docs``.

    ``model_path`` is a file that every executor has.
    """
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ids array<int>, decoded string, agrees boolean"

    def run(batches):
        processor, own = _load(model_path)
        gc.disable()  # nothing here makes cycles, and the store of parts is costly to walk
        try:
            yield from coded(batches, processor, own)
        finally:
            gc.enable()

    def coded(batches, processor, own):
        for batch in giving_back(batches):
            for a, b in slices(batch.column(len(keep)), most_rows=ROWS_A_BATCH):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(len(keep)).to_pylist()]
                own.learn(texts)
                raw = [own.encode(t) for t in texts]
                ids = [np.frombuffer(x, np.int32).tolist() for x in raw]
                if own.spaced:  # no cuts to rely on: whole texts are compared
                    theirs = processor.encode(texts, num_threads=1)
                    agrees, ids = [a == b for a, b in zip(ids, theirs)], theirs
                    raw = [packed(x) for x in ids]
                else:
                    agrees = [own.agreed(t) for t in texts]
                decoded = [own.decode(x) for x in ids]
                for i, back in enumerate(processor.decode(ids)):
                    if back != decoded[i]:
                        decoded[i], agrees[i] = back, False
                offsets = np.zeros(len(texts) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in raw], out=offsets[1:])
                flat = np.frombuffer(b"".join(raw), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())],
                    names=[*keep, "ids", "decoded", "agrees"],
                )

    return docs.select(*keep, text_col).mapInArrow(run, schema)

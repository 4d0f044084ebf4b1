"""Sum-of-squares online packing of token streams into fixed windows.

Each scan partition packs its own documents in the order they come.  Whole windows are cut from long
documents, and what remains of each goes where the sum of the squared counts of partially filled windows
per fill level becomes smallest; the counts are an array of ``LEVELS`` entries.  A window that reaches
the top level lacks less than one level's width: the head of the next document, cut off, fills it.  What
is open when the partition ends, or beyond ``MOST_OPEN`` windows, is poured together, cutting freely,
into full windows, and the very last tokens into windows of power-of-two length; so nothing is padded.
No shuffle; memory holds at most ``MOST_OPEN`` windows beside the batch at hand.

Contract: a null or empty text is a document of one id, the end id; a document of any length is cut into
windows; repeated rows are packed as often as they occur, equal ids apart; of levels that tie the fullest
is taken; an empty table gives no rows; extra input columns are dropped, whatever their names.  Sequence
ids are unique: the partition in the upper bits.
"""

from __future__ import annotations

import json
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import python_ready, texts
from .idtable import IdTable, batches_of, flattened, ranges

CAPACITY, LEVELS, MOST_OPEN = 2048, 32, 4096
END_ID = 1
#: Words remembered per Python worker.
WORD_CACHE = 600_000
#: Bytes of text encoded at once; a longer text is encoded in parts, cut at spaces.
BATCH_BYTES, OUT_BYTES = 4 << 20, 4 << 20
#: Latin letters lie below this; of them the dotted capital I ends in a composing mark once lower-cased.
LATIN_END, DOTTED_I = chr(0x250), chr(0x130)
#: Marks that join a-z, but not A-Z, to one character (as U+1E96): the library composes before it lower-cases.
LOWER_MARKS = "".join(map(chr, (0x308, 0x30A, 0x30C, 0x331, 0x344)))
STOPS = string.punctuation.replace("|", "").replace("'", "")
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, which gets each space-separated word once while it is remembered.

    The vocabulary drops white space and never joins across it, so words can be encoded apart; many new
    words go through the library in one call, with a mark between them.
    """

    def __init__(self, tokenizer_json: bytes):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(tokenizer_json.decode())
        self.lib.no_truncation()
        self.lib.no_padding()
        mark = self._each(["|"])[0]
        self.mark = int(np.frombuffer(mark, "<u4")[0]) if len(mark) == 4 else None
        spec = json.loads(tokenizer_json)
        self.ascii, self.latin = self._letters_only(spec)
        suffix, vocab = spec["model"].get("end_of_word_suffix"), spec["model"]["vocab"]
        self.last = np.zeros(1 + max(vocab.values()), bool)
        self.last[[i for w, i in vocab.items() if suffix and w.endswith(suffix)]] = True
        self.words = IdTable(self._learn, WORD_CACHE)

    @staticmethod
    def _letters_only(spec: dict) -> tuple:
        """The library with the same model for words of lower-case letters, ASCII or Latin: one pre-token each, nothing to
        normalise. (None, None) for a file that lower-cases or cuts otherwise."""
        from tokenizers import Tokenizer

        norm, pre = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        kinds = [p["type"] for p in pre.get("pretokenizers", [])], [n["type"] for n in norm.get("normalizers", [])]
        if not spec["model"].get("end_of_word_suffix") or kinds != (["Split", "ByteLevel"], ["NFC", "Replace", "Lowercase"]) or r"[\p{L}]+" not in pre["pretokenizers"][0]["pattern"].get("Regex", "") or any(t["content"].isalpha() for t in spec["added_tokens"]):
            return None, None
        spaces, level = {"type": "WhitespaceSplit"}, pre["pretokenizers"][1]
        made = [Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "post_processor": None, "added_tokens": [], "truncation": None, "padding": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": p}})) for p in ([spaces], [spaces, level])]
        return made[0], made[1]

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of words without the mark; a word that makes the mark itself shows by the count of marks."""
        out = []
        for k in range(0, len(words), 2000):
            some = words[k : k + 2000]
            ids = np.array(self.lib.encode_batch_fast([" | ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.mark)
            if len(at) == len(some) - 1:
                raw, edges = ids.tobytes(), (np.concatenate([[-1], at, [len(ids)]]) * 4).tolist()
                out += [raw[a + 4 : b] for a, b in zip(edges, edges[1:], strict=False)]
            else:
                out += self._each(some)
        return out

    def _letters(self, lib, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters only. The last token of a word, and no other, carries the vocabulary's mark of a word's end."""
        if not words:
            return flattened([])
        ids = np.concatenate([np.array(lib.encode_batch_fast([" ".join(words[k : k + 2000])], add_special_tokens=False)[0].ids, "<u4") for k in range(0, len(words), 2000)])
        return ids, np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words. Letters and a run of ASCII marks after them are two pre-tokens, so they are encoded apart: each word is a pair of a head and a tail."""
        column = pa.array(words, pa.string())
        heads = pc.utf8_rtrim(column, STOPS)
        easy = pc.and_(pc.ascii_is_alpha(heads), self.ascii is not None)
        head = pc.ascii_lower(heads.filter(easy)).dictionary_encode()
        tail = pc.utf8_ltrim(column.filter(easy), string.ascii_letters).dictionary_encode()
        parts = [self._letters(self.ascii, head.dictionary.to_pylist()), flattened(self._each(tail.dictionary.to_pylist())), flattened(self._others(column.filter(pc.invert(easy)).to_pylist()))]
        ids, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        n_heads, n_tails, easy = len(parts[0][1]), len(parts[1][1]), easy.to_numpy(zero_copy_only=False)
        count = np.append(count, 0)  # the tail of the others
        pairs = np.full((len(words), 2), len(count) - 1)
        pairs[easy, 0], pairs[easy, 1] = head.indices.to_numpy(), n_heads + tail.indices.to_numpy()
        pairs[~easy, 0] = n_heads + n_tails + np.arange((~easy).sum())
        return ids[ranges((np.cumsum(count) - count)[pairs.ravel()], count[pairs.ravel()])], count[pairs].sum(axis=1)

    def _others(self, words: list[str]) -> list[bytes]:
        """Ids of words other than ASCII letters with marks. Tails are cut off Latin letters too, not beyond: there a word may end in a composing mark once normalised."""
        latin, joined, each = {}, {}, {}
        heads: list[str] = []
        for w in words:
            head = w.rstrip(STOPS)
            if self.latin is not None and head.isalpha() and max(head) < LATIN_END and DOTTED_I not in head:
                head = head.lower()
                latin[head] = b""
            else:
                head = w
                (each if "|" in w or len(w) > 200 or self.mark is None else joined)[w] = b""
            heads.append(head)
        if latin:
            ids, count = self._letters(self.latin, list(latin))
            raw, ends = ids.tobytes(), (4 * np.cumsum(count)).tolist()
            latin = dict(zip(latin, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        known = latin | dict(zip(joined, self._joined(list(joined)), strict=True)) | dict(zip(each, self._each(list(each)), strict=True))
        tails = {w[len(h) :] for w, h in zip(words, heads, strict=True)}
        ends_of = dict(zip(tails, self._each(list(tails)), strict=True))
        return [known[h] + ends_of[w[len(h) :]] for w, h in zip(words, heads, strict=True)]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text; none may be null."""
        self.words.make_room()
        folded = _folded(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        cut = pc.ascii_split_whitespace(folded)
        flat, edges = self.words.ids(self.words.codes(cut.flatten()))
        at, raw = (edges[cut.offsets.to_numpy() - cut.offsets[0].as_py()] * 4).tolist(), flat.tobytes()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def encode_long(self, text: str, most: int = BATCH_BYTES) -> bytes:
        """Ids of one text of any length, part by part, cut at spaces."""
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + most)
            end = len(text) if end < 0 else end
            out += self.encode([text[at:end]])
            at = end
        return b"".join(out)


def _folded(column: pa.Array) -> pa.Array:
    """A-Z lower-cased, as the vocabulary does itself; not in texts where it looks before that: for added tokens and marks."""
    raw = pc.match_substring(column, "<|")
    for m in LOWER_MARKS:
        raw = pc.or_(raw, pc.match_substring(column, m))
    return pc.if_else(raw, column, pc.ascii_lower(column))


_TOKENIZERS: dict[int, WordTokenizer] = {}


def word_tokenizer(tokenizer_json: bytes) -> WordTokenizer:
    k = hash(tokenizer_json)
    if k not in _TOKENIZERS:
        _TOKENIZERS[k] = WordTokenizer(tokenizer_json)
    return _TOKENIZERS[k]


class Piece:
    """Some ids of a document, a view of its bytes: cutting copies nothing."""

    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id, start: int, ids: memoryview, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, tokens: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[: 4 * tokens], self.doc_tokens), Piece(self.doc_id, self.start + tokens, self.ids[4 * tokens :], self.doc_tokens)


class Window:
    __slots__ = ("pieces", "fill")

    def __init__(self):
        self.pieces: list[Piece] = []
        self.fill = 0

    def put(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.fill += len(piece)


class SumOfSquares:
    """The level array and the open windows of one packing run; add() and drain() yield finished windows.

    ``placed`` and ``poured`` count the tokens beyond whole windows that the levels placed for good, and
    those poured together at an end.
    """

    def __init__(self, capacity: int = CAPACITY, levels: int = LEVELS, most_open: int = MOST_OPEN):
        self.capacity, self.width, self.most_open = capacity, max(1, capacity // levels), most_open
        self.top = self.level(capacity)
        self.count = [0] * (self.top + 1)  # at the ends always 0: empty and full windows are not partial
        self.open: list[list[Window]] = [[] for _ in self.count]
        self.short: Window | None = None  # at the top level, yet to be filled
        self.placed = self.poured = 0

    def level(self, fill: int) -> int:
        return -(-fill // self.width)

    def level_for(self, size: int) -> int:
        """The level, 0 for a new window, whose last window takes ``size`` tokens so that the sum of squares is least; of equals the fullest."""
        best, least = 0, 2 * self.count[self.level(size)] + 1 if self.level(size) < self.top else 0
        for h in range(1, self.top):
            if self.count[h] and (fill := self.open[h][-1].fill + size) <= self.capacity:
                reached = self.level(fill)
                change = 0 if reached == h else 1 - 2 * self.count[h] + (2 * self.count[reached] + 1 if reached < self.top else 0)
                if change <= least:
                    best, least = h, change
        return best

    def add(self, doc_id, ids: bytes) -> Iterator[list[Piece]]:
        rest, c = Piece(doc_id, 0, memoryview(ids), len(ids) // 4), self.capacity
        if self.short is not None and len(rest):
            head, rest = rest.cut(min(len(rest), c - self.short.fill))
            self.short.put(head)
            self.placed += len(head)
            if self.short.fill == c:
                yield self.short.pieces
                self.short = None
        while len(rest) >= c:
            whole, rest = rest.cut(c)
            yield [whole]
        if not len(rest):
            return
        if rest.start:
            rest.ids = memoryview(bytes(rest.ids))  # lets go of the rest of a long document
        self.placed += len(rest)
        h = self.level_for(len(rest))
        window = self.open[h].pop() if h else Window()
        self.count[h] -= bool(h)
        window.put(rest)
        reached = self.level(window.fill)
        if window.fill == c:
            yield window.pieces
        elif reached == self.top and self.short is None:
            self.short = window
        else:
            self.open[reached].append(window)
            self.count[reached] += reached < self.top
        if sum(map(len, self.open)) > self.most_open:
            yield from self.pour()

    def pour(self, last: bool = False) -> Iterator[list[Piece]]:
        """Open windows poured together into full ones; what is over stays one open window, or, at the last, fills windows of power-of-two length."""
        left = [w for h in range(self.top, 0, -1) for w in self.open[h]] + ([self.short] if self.short else [])
        total = sum(w.fill for w in left)
        self.placed -= total
        self.poured += total
        sizes = [self.capacity] * (total // self.capacity)
        tail = total % self.capacity
        sizes += [1 << b for b in range(self.capacity.bit_length(), -1, -1) if tail >> b & 1] if last else [tail] * bool(tail)
        pieces = (p for w in left for p in w.pieces)
        over: Piece | None = None
        self.open, self.count, self.short = [[] for _ in self.count], [0] * len(self.count), None
        for size in sizes:
            window = Window()
            while window.fill < size:
                p = over if over is not None else next(pieces)
                over = None
                if len(p) > size - window.fill:
                    p, over = p.cut(size - window.fill)
                window.put(p)
            if size == self.capacity or last:
                yield window.pieces
            else:
                self.placed += size
                self.poured -= size
                self.open[self.level(size)].append(window)
                self.count[self.level(size)] += self.level(size) < self.top

    def drain(self) -> Iterator[list[Piece]]:
        return self.pour(last=True)


def pack_documents(docs: DataFrame, tokenizer_json: bytes, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", levels: int = LEVELS) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence, and its ids (little-endian unsigned 32-bit)."""
    python_ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = word_tokenizer(held.value), SumOfSquares(capacity, levels)
        end, rows, held_bytes = np.array([end_id], "<u4").tobytes(), [], 0
        sequence = TaskContext.get().partitionId() << 36

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
            rows.clear()
            return batch

        def close(window: list[Piece]) -> int:
            nonlocal sequence
            offset = 0
            for p in window:
                rows.append((p.doc_id, p.start, len(p), p.doc_tokens, sequence, offset, bytes(p.ids)))
                offset += len(p)
            sequence += 1
            return 4 * offset

        def encoded(part: pa.RecordBatch) -> list[bytes]:
            if part.num_rows == 1:
                return [tokenizer.encode_long(part.column(1)[0].as_py())]
            return tokenizer.encode(part.column(1))

        for batch in batches:
            for part in batches_of(batch, 1, BATCH_BYTES):
                for i, ids in zip(part.column(0).to_pylist(), encoded(part), strict=True):
                    for window in packer.add(i, ids + end):
                        held_bytes += close(window)
                        if held_bytes > OUT_BYTES:
                            yield out()
                            held_bytes = 0
        for window in packer.drain():
            held_bytes += close(window)
            if held_bytes > OUT_BYTES:
                yield out()
                held_bytes = 0
        if rows:
            yield out()

    return texts(docs, text, doc_id).mapInArrow(run, SCHEMA)

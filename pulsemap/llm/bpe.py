"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a pre-token exactly one vocabulary entry can be the last token of its encoding: the
entry that is a suffix of the prefix and is compatible with the last token of the shorter prefix before
it.  An Aho-Corasick automaton over the vocabulary yields the suffixes, a walk along the two merge
spines that meet at the boundary decides compatibility, and following the stored last tokens back from
the end gives the exact ids.  Time is linear in the text, also for pre-tokens of a megabyte.

Contract: a null text is an empty text and has no ids; an empty text has no ids; very long texts are
encoded whole; repeated rows give repeated rows; an empty table gives no rows; ties cannot arise, since
one entry at most fits each prefix; extra input columns are dropped, whatever their names; the result has
``doc_id`` and ``ids`` (little-endian unsigned 32-bit), after decoding also ``text``.
"""

from __future__ import annotations

import json
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import python_ready, texts
from .idtable import IdTable, batches_of, flattened, ranges

#: What a Python worker remembers, in words, pre-tokens and token pairs; results do not depend on it.
WORD_CACHE, TOKEN_CACHE, PAIR_CACHE = 300_000, 300_000, 1_000_000
#: Characters joined for one pass of the automaton.
PASS_CHARS = 200_000
#: Bytes of text encoded at once; a longer text is encoded in parts, cut where no pre-token is.
BATCH_BYTES = 4 << 20

#: The pre-token pattern of the vocabulary files, and Unicode's white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"

_START, _OPEN = -2, -1
_NEVER = 1 << 30


def byte_symbols() -> dict[str, int]:
    """Symbol to byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    def __init__(self, tokenizer_json: bytes):
        import ahocorasick
        import regex

        spec = json.loads(tokenizer_json)
        symbol = byte_symbols()
        vocab = spec["model"]["vocab"]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.key: list[str] = [""] * self.size  # bytes of a token as Latin-1
        for word, i in vocab.items():
            self.key[i] = "".join(chr(symbol[c]) for c in word)
        self.bytes_of = [k.encode("latin-1") for k in self.key]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.halves: list[tuple[int, int] | None] = [None] * self.size
        self.rank = [-1] * self.size
        self.pair_rank: dict[int, int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole, x, y = vocab[a + b], vocab[a], vocab[b]
            self.pair_rank.setdefault(x * self.size + y, r)
            if self.halves[whole] is None:
                self.halves[whole], self.rank[whole] = (x, y), r
        self._right: dict[int, list[int]] = {}
        self._left: dict[int, list[int]] = {}
        self.fits: dict[int, bool] = {}
        self.whole: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        alive = [False] * self.size
        order = sorted((i for i in vocab.values()), key=lambda i: self.rank[i])
        for i in order:
            if self.halves[i] is None:
                alive[i] = len(self.key[i]) == 1
            else:
                x, y = self.halves[i]
                alive[i] = alive[x] and alive[y] and self._apart(x, y, top=False)
            if alive[i]:
                self.whole[self.key[i]] = i
                self.automaton.add_word(self.key[i], (i, len(self.key[i])))
        self.automaton.make_automaton()
        self.find = regex.compile(PATTERN).findall
        self.find_safe = regex.compile(r"\w(?= \w)").search  # an added token with such a place would be cut: none has one
        if any(self.find_safe(t) for t in self.added):
            raise ValueError("an added token holds a space between word characters")
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.tokens = IdTable(self._solve, TOKEN_CACHE)
        self.spaced = IdTable(lambda words: self._words(words, " "), WORD_CACHE)
        self.bare = IdTable(self._words, WORD_CACHE)

    def _spine(self, i: int, side: int) -> list[int]:
        """The nodes of i's merge tree along one edge, leaf first."""
        memo = (self._left, self._right)[side]
        if i not in memo:
            nodes, at = [i], i
            while self.halves[at] is not None:
                at = self.halves[at][side]
                nodes.append(at)
            memo[i] = nodes[::-1]
        return memo[i]

    def _apart(self, a: int, b: int, top: bool = True) -> bool:
        """Whether a and b stay separate tokens side by side. Both are grown leaf to root in merge order; they
        are torn apart if a pair across the boundary may merge before either side has grown past it.
        top: whether a merge of a and b themselves counts."""
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            grow_a = self.rank[left[i + 1]] if i + 1 < len(left) else _NEVER
            grow_b = self.rank[right[j + 1]] if j + 1 < len(right) else _NEVER
            across = self.pair_rank.get(left[i] * self.size + right[j], _NEVER)
            if grow_a == grow_b == _NEVER:
                return across == _NEVER or not top
            if across < grow_a and across <= grow_b:
                return False
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1

    def _dp(self, words: list[str]) -> list[bytes]:
        text = "Ā".join(words)
        last = [_OPEN] * (len(text) + 1)
        start, spans = 0, []
        for w in words:
            last[start] = _START
            spans.append((start, start + len(w)))
            start += len(w) + 1
        size, fits = self.size, self.fits
        for end, (token, n) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - n]
            if before >= 0:
                pair = before * size + token
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) >= PAIR_CACHE:
                        fits.clear()
                    ok = fits[pair] = self._apart(before, token)
                if not ok:
                    continue
            last[end] = token
        key, out = self.key, []
        for start, end in spans:
            ids = []
            while end > start:
                ids.append(last[end])
                end -= len(key[last[end]])
            ids.reverse()
            out.append(array("I", ids).tobytes())
        return out

    def _solve(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens."""
        out, raw, long = [], [], 0
        for w in tokens:
            raw.append(w.encode().decode("latin-1"))
            long += len(raw[-1]) + 1
            if long > PASS_CHARS:
                out += self._dp(raw)
                raw, long = [], 0
        return flattened(out + self._dp(raw))

    def _words(self, words: list[str], space: str = "") -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are pre-tokenised on their own, each after ``space``. ASCII letters with marks behind are two pre-tokens, others are cut by the pattern."""
        column = pa.array(words, pa.string())
        heads = pc.utf8_rtrim(column, string.punctuation)
        easy = pc.ascii_is_alpha(heads)
        head, tail = heads.filter(easy), pc.utf8_ltrim(column.filter(easy), string.ascii_letters)
        found = [self.find(space + w) for w in column.filter(pc.invert(easy)).to_pylist()]
        easy, tailed = easy.to_numpy(zero_copy_only=False), pc.binary_length(tail).to_numpy() > 0
        size = np.zeros(len(words), np.int64)
        size[easy] = 1 + tailed
        size[~easy] = np.fromiter(map(len, found), np.int64, len(found))
        at = np.cumsum(size) - size
        codes = np.zeros(size.sum(), np.int64)
        if space:
            head = pc.binary_join_element_wise("", head, space)
        pieces = pa.concat_arrays([head, tail.filter(pa.array(tailed)), pa.array([w for f in found for w in f], pa.string())])
        order = np.concatenate([at[easy], at[easy][tailed] + 1, ranges(at[~easy], size[~easy])])
        codes[order] = self.tokens.codes(pieces)
        ids, edges = self.tokens.ids(codes)
        return ids, np.diff(edges[np.append(at, len(codes))])

    def _cut(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts without added tokens. No pre-token crosses a place before a space between two other characters, so words, spaces at their heads, are looked up whole."""
        odd = pc.match_substring_regex(texts, f" [{WHITE}]|[{WHITE}] ")
        cut = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        at = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        words, first = cut.flatten(), np.zeros(at[-1], bool)
        first[at[:-1]] = True
        heads, head_edges = self.bare.ids(self.bare.codes(words.filter(pa.array(first))))
        rest, rest_edges = self.spaced.ids(self.spaced.codes(words.filter(pa.array(~first))))
        a, b = (4 * head_edges).tolist(), (4 * rest_edges[at - np.arange(len(at))]).tolist()
        heads, rest = heads.tobytes(), rest.tobytes()
        plain = iter([heads[a[k] : a[k + 1]] + rest[b[k] : b[k + 1]] for k in range(len(cut))])
        units = [self._units(t) for t in texts.filter(odd).to_pylist()]
        ids, edges = self.bare.ids(self.bare.codes(pa.array([u for us in units for u in us], pa.string())))
        ends, raw = (4 * edges[np.cumsum([0, *map(len, units)])]).tolist(), ids.tobytes()
        other = iter([raw[x:y] for x, y in zip(ends, ends[1:], strict=False)])
        return [next(other if o else plain) for o in odd.to_pylist()]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text; none may be null."""
        for known in (self.tokens, self.spaced, self.bare):
            known.make_room()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        special = np.zeros(len(texts), bool)
        for content in self.added:
            special |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if not special.any():
            return self._cut(texts)
        plain = iter(self._cut(texts.filter(pa.array(~special))))
        pieces = [self.split_added(t) for t in texts.filter(pa.array(special)).to_pylist()]
        between = iter(self._cut(pa.array([p for ps in pieces for p in ps if p not in self.added], pa.string())))
        other = iter([b"".join([array("I", [self.added[p]]).tobytes() if p in self.added else next(between) for p in ps]) for ps in pieces])
        return [next(other if s else plain) for s in special.tolist()]

    def encode_long(self, text: str, most: int = BATCH_BYTES) -> bytes:
        """Ids of one text of any length, part by part."""
        out, at = [], 0
        edge = self.safe(text, most)
        while edge:
            out += self.encode([text[at:edge]])
            at = edge
            edge = self.safe(text, at + most)
        return b"".join(out + self.encode([text[at:]]))

    def safe(self, text: str, at: int) -> int:
        """The first place from ``at`` on before a space between two word characters, outside added tokens; 0 if there is none."""
        found = self.find_safe(text, at)
        return found.start() + 1 if found else 0

    @staticmethod
    def _units(text: str) -> list[str]:
        """Cuts after each run of other characters, before white space: no pre-token crosses such a place."""
        import re

        return re.findall(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+", text)

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def codec(tokenizer_json: bytes) -> Codec:
    """One codec per Python worker and vocabulary."""
    k = hash(tokenizer_json)
    if k not in _CODECS:
        _CODECS[k] = Codec(tokenizer_json)
    return _CODECS[k]


def _recoded(docs: DataFrame, tokenizer_json: bytes, decode: bool) -> DataFrame:
    python_ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value)
        for batch in batches:
            for part in batches_of(batch, 1, BATCH_BYTES):
                ids = c.encode(part.column(1)) if part.num_rows > 1 else [c.encode_long(part.column(1)[0].as_py())]
                more = [pa.array([c.decode(x) for x in ids], pa.string())] if decode else []
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), *more], ["doc_id", "ids", "text"][: 2 + decode])

    return docs.mapInArrow(run, "doc_id long, ids binary" + ", text string" * decode)


def encode_documents(docs: DataFrame, tokenizer_json: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): one row for each row, in place, without a shuffle."""
    return _recoded(texts(docs, text, doc_id), tokenizer_json, decode=False)


def recode_documents(docs: DataFrame, tokenizer_json: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, text): the ids and the text decoded from them, in one pass."""
    return _recoded(texts(docs, text, doc_id), tokenizer_json, decode=True)


def decode_documents(encoded: DataFrame, tokenizer_json: bytes) -> DataFrame:
    """(doc_id, ids, text) from (doc_id, ids); ids outside the vocabulary raise."""
    python_ready(encoded.sparkSession)
    held = encoded.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value)
        for batch in batches:
            for part in batches_of(batch, 1, 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([None if x is None else c.decode(x) for x in part.column(1).to_pylist()], pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")

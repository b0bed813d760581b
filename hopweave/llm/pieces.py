"""Operator 7, SentencePiece encoding and decoding with byte offsets.

A text is normalised by walking the model's compiled character map: at each place the longest key of the
map (a double-array trie) that prefixes the rest is replaced by its value, else one character is copied.
Every character written remembers the source byte it came from, and each piece of the encoding is projected
through that record to the span of original bytes it covers. Runs in which no key of the map can begin are
copied as a whole, with their bytes as record; with an empty map, as in the model of op7, that is the whole text.
Ids, decoded text and the digests of spans that the query returns all come from this normalised text and its record.

Encoding merges the pair of neighbouring symbols whose concatenation is the best-scored piece, leftmost
first on ties, until none is left; characters without a piece fall back to their bytes. No piece of the
model has a space mark after another character (checked when it is loaded; otherwise texts stay whole),
so a text falls into words that are merged on their own. Equal words are merged once per batch, and words
of equal length together, as one matrix.

Decoding joins the pieces, turns space marks into spaces, drops the one dummy space and reads runs of
byte pieces as UTF-8 with U+FFFD for what is not.

Nothing is shuffled; memory is a bounded cache of words and a few rows (``common.BATCH``), of long texts the normalised
text with its record and the words of one block. Defined cases: null and empty
texts have no ids and decode to the empty text; repeated rows and null ids are kept and encoded alike; unknown ids decode to
the model's unknown surface, control ids to nothing; an empty table gives an empty result; only id and text are looked
at, so no other column clashes (``decode`` replaces a column of the name it is given).
"""

from __future__ import annotations

import heapq
import re
import struct
from functools import lru_cache
from hashlib import sha256
from itertools import islice
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, small_batches, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
CACHE_WORDS, BLOCK_WORDS, LONG_WORD, LONG_TEXT = 250_000, 200_000, 40, 200_000
NONE = np.iinfo(np.int32).max


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {kind} in the model file")


class CharMap:
    """A compiled character map: u32 size of the trie, the trie's u32 units, the values, each ended by 0."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4) if blob else ()
        self.values = blob[4 + n :] if blob else b""
        #: Bytes with which a key can begin.
        self.first = np.array([self._begins(b) for b in range(256)])

    def _begins(self, byte: int) -> bool:
        if not self.units:
            return False
        node = self._offset(self.units[0]) ^ byte
        return node < len(self.units) and self.units[node] & 0x800000FF == byte

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key that data has at ``at``."""
        units, found = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, value)
        if not found:
            return None
        return found[0], self.values[found[1] : self.values.index(b"\0", found[1])]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)


class Model:
    def __init__(self, blob: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.add_dummy, self.remove_extra, self.escape, charmap = True, True, True, b""
        self.byte_fallback, self.suffix, model_type = False, False, 1
        self.unk_surface = " ⁇ "
        for num, val in _fields(blob):
            if num == 1:
                piece, score, kind = b"", 0.0, NORMAL
                for k, v in _fields(val):
                    if k == 1:
                        piece = v
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                self.pieces.append(piece.decode())
                self.scores.append(score)
                self.kinds.append(kind)
            elif num == 2:
                for k, v in _fields(val):
                    if k == 3:
                        model_type = v
                    elif k == 24:
                        self.suffix = bool(v)
                    elif k == 35:
                        self.byte_fallback = bool(v)
                    elif k == 44:
                        self.unk_surface = v.decode()
            elif num == 3:
                for k, v in _fields(val):
                    if k == 2:
                        charmap = v
                    elif k == 3:
                        self.add_dummy = bool(v)
                    elif k == 4:
                        self.remove_extra = bool(v)
                    elif k == 5:
                        self.escape = bool(v)
        if max(map(len, self.pieces), default=0) > 255:
            raise ValueError("pieces of more than 255 characters are not supported")
        if model_type != 2 or self.suffix or not self.escape or USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("only BPE models with leading space marks and without user-defined pieces are supported")
        self.charmap = CharMap(charmap)
        self.unk = self.kinds.index(UNKNOWN)
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        order = {s: n for n, s in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.size = len(self.pieces) + 1  # the last number stands for any character without a piece
        pairs = {}
        self.lone = set()  # characters that are in pieces but aren't pieces: merging needs the strings then
        for p, i in self.ids.items():
            self.lone |= {c for c in p if c not in self.ids}
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (order[self.scores[i]], i)
        if self.lone:
            raise ValueError(f"characters within pieces that are no pieces: {sorted(self.lone)[:9]}")
        self.pairs = pairs
        self.keys = np.array(sorted(pairs) or [-1], dtype=np.int64)
        self.rank = np.array([pairs[k][0] for k in sorted(pairs)] or [NONE], dtype=np.int32)
        self.merged = np.array([pairs[k][1] for k in sorted(pairs)] or [0], dtype=np.int32)
        self.char_id = np.full(0x110000, self.size - 1, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        line = "" if any("\n" in p for p in self.ids) else "\n"
        self.words = re.compile(r"(?s).+" if inner else f"{line or '(?!)'}|{MARK}*[^{MARK}{line}]+|{MARK}+")
        self.id_text = [str(i) for i in range(len(self.pieces))]
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        self.n_chars = [len(p) for p in self.pieces]
        self.cache: dict[str, tuple[str, str, bytes]] = {}

    # Normalisation -------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its characters and its end, the source byte it comes from."""
        data = text.encode()
        raw = np.frombuffer(data, np.uint8)
        source = np.flatnonzero((raw & 0xC0) != 0x80).astype(np.int32)  # where characters begin
        keys = source[self.charmap.first[raw[source]]].tolist()
        if keys:
            text, source = self._mapped(data, source, keys)
        end = len(data)
        if self.remove_extra and text:
            space = np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32
            kept = np.flatnonzero(~space | ~np.concatenate([[True], space[:-1]]))
            if len(kept) and space[kept[-1]]:
                kept = kept[:-1]
            if len(kept) and kept[-1] + 1 < len(source):
                end = int(source[kept[-1] + 1])
            text, source = "".join([text[i] for i in kept.tolist()]), source[kept]
        if not text:
            return "", np.array([end], np.int32)
        dummy = self.add_dummy
        return ((" " if dummy else "") + text).replace(" ", MARK), np.concatenate([source[:1] if dummy else source[:0], source, np.array([end], np.int32)])

    def _mapped(self, data: bytes, source: np.ndarray, keys: list[int]) -> tuple[str, np.ndarray]:
        """data with the longest key at each place replaced; keys: the places where one can begin."""
        out, record, at = [], [], 0

        def copy(to: int):
            if to > at:
                out.append(data[at:to].decode())
                a, b = np.searchsorted(source, (at, to))
                record.append(source[a:b])

        for place in keys:
            if place >= at and (hit := self.charmap.longest(data, place)):
                copy(place)
                value = hit[1].decode()
                out.append(value)
                record.append(np.full(len(value), place, np.int32))
                at = place + hit[0]
        copy(len(data))
        return "".join(out), np.concatenate(record) if record else source[:0]

    # Encoding ------------------------------------------------------------------------------------

    def _long(self, symbols: list[int]) -> list[int]:
        """One long word with a heap of pairs."""
        n, size, pairs = len(symbols), self.size, self.pairs
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list = []

        def add(i):
            j = right[i]
            if j >= 0 and (hit := pairs.get(symbols[i] * size + symbols[j])):
                heapq.heappush(heap, (hit[0], i, symbols[i], symbols[j], hit[1]))

        for i in range(n - 1):
            add(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            add(i)
            if left[i] >= 0:
                add(left[i])
        return [s for s in symbols if s >= 0]

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), self.merged[at]

    def _same_length(self, m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows of symbols, all of one length, merged together: (row numbers, their final symbols)."""
        rows, out = np.arange(len(m)), []
        if m.shape[1] < 2:
            return [(rows, m)]
        rank, new = self._lookup(m[:, :-1], m[:, 1:])
        while len(rows) and m.shape[1] > 1:
            best = rank.argmin(axis=1)
            every = np.arange(len(rows))
            open_ = rank[every, best] != NONE
            if not open_.all():
                out.append((rows[~open_], m[~open_]))
                rows, m, rank, new, best = rows[open_], m[open_], rank[open_], new[open_], best[open_]
                every = np.arange(len(rows))
            if not len(rows):
                return out
            m[every, best] = new[every, best]
            width = m.shape[1] - 1
            gone = np.ones(m.shape, bool)
            gone[every, best + 1] = False
            m = m[gone].reshape(len(rows), width)
            gone = np.ones(rank.shape, bool)
            gone[every, best] = False
            rank, new = rank[gone].reshape(len(rows), width - 1), new[gone].reshape(len(rows), width - 1)
            for side in (best - 1, best):
                ok = np.flatnonzero((side >= 0) & (side < width - 1))
                s = side[ok]
                rank[ok, s], new[ok, s] = self._lookup(m[ok, s], m[ok, s + 1])
        out.append((rows, m))
        return out

    def _symbols(self, words: list[str]) -> np.ndarray:
        return self.char_id[np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)]

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """Final symbols of each word; the number size - 1 stands for a character without a piece."""
        out: list = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            if n > LONG_WORD or len(at) < 8:
                for i in at.tolist():
                    out[i] = self._long(self._symbols([words[i]]).tolist())
                continue
            for rows, m in self._same_length(self._symbols([words[i] for i in at.tolist()]).reshape(len(at), n)):
                for i, symbols in zip(at[rows].tolist(), m.tolist(), strict=True):
                    out[i] = symbols
        return out

    def _with_bytes(self, word: str, symbols: list[int]) -> list[tuple[int, int]]:
        """(id, characters covered): a character without a piece becomes its bytes, the last covers it."""
        out, at = [], 0
        for s in symbols:
            if s < self.size - 1:
                n = len(self.pieces[s])
                out.append((s, n))
            else:
                n = 1
                if self.byte_fallback:
                    data = word[at].encode()
                    out += [(self.byte_id[b], int(k == len(data) - 1)) for k, b in enumerate(data)]
                else:
                    out.append((self.unk, 1))
            at += n
        return out

    def blocks(self, norm: str, words: list[str] | None = None):
        """What the cache has of a normalised text's words, a bounded number at a time. words: they are in the cache already."""
        if words is not None:
            if words:
                yield [self.cache[w] for w in words]
            return
        found = (m.group() for m in self.words.finditer(norm))
        while part := list(islice(found, BLOCK_WORDS)):
            self.learn(set(part))
            yield [self.cache[w] for w in part]

    def encode_spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, first bytes and end bytes of all pieces, in bytes of the text as given."""
        norm, source = self.normalise(text)
        got = [w for block in self.blocks(norm) for w in block]
        ids = np.array([int(i) for w in got for i in w[0].split(",")], np.int32)
        covered = np.frombuffer(b"".join([w[2] for w in got]), np.uint8)
        ends = np.cumsum(covered, dtype=np.int64)
        return ids, source[ends - covered], source[ends]

    def learn(self, words: set[str]) -> None:
        """Puts words into the cache: their ids as text, what these decode to with a space for each mark, and the number of
        characters that each piece covers (a byte each: the pieces are that short)."""
        cache, id_text, shown, n_chars = self.cache, self.id_text, self.shown, self.n_chars
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new = [w for w in words if w not in cache]
        other = self.size - 1
        for w, symbols in zip(new, self.merge_words(new), strict=True):
            if other not in symbols:
                cache[w] = (",".join([id_text[i] for i in symbols]), "".join([shown[i] for i in symbols]), bytes([n_chars[i] for i in symbols]))
            else:
                got = self._with_bytes(w, symbols)
                ids = [i for i, _ in got]
                cache[w] = (",".join([id_text[i] for i in ids]), self.decode_run(ids), bytes([n for _, n in got]))

    # Decoding ------------------------------------------------------------------------------------

    def decode_run(self, ids) -> str:
        """ids in the middle of a text: no dummy space is dropped."""
        out, run = [], bytearray()

        def flush():
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()

        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                run.append(self.byte_of[i])
                continue
            flush()
            if kind != CONTROL:
                out.append(self.unk_surface if kind == UNKNOWN else self.pieces[i].replace(MARK, " "))
        flush()
        return "".join(out)

    def decode(self, ids) -> str:
        ids = [i for i in ids if self.kinds[i] != CONTROL]
        text = self.decode_run(ids)
        drops = self.add_dummy or self.remove_extra
        return text[1:] if drops and ids and self.pieces[ids[0]].startswith(MARK) else text


def _utf8(data: bytes) -> str:
    """Bytes as text, U+FFFD for each byte that is not part of a whole character."""
    out, at = [], 0
    while at < len(data):
        b = data[at]
        n = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        try:
            out.append(data[at : at + n].decode() if n and at + n <= len(data) else "�")
            at += max(1, n) if n and at + n <= len(data) else 1
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, starts array<int>, ends array<int>: every piece with its span of original bytes."""

    def work(texts):
        return list(zip(*[load(model_path).encode_spans(t or "") for t in texts], strict=True))

    return map_texts(docs, id_col, [text_col], "ids array<int>, starts array<int>, ends array<int>", lambda: work)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    small_batches(encoded.sparkSession)

    @F.pandas_udf("string")
    def run(ids):
        model = load(model_path)
        return ids.map(lambda x: model.decode([] if x is None else [int(i) for i in x]))

    return encoded.withColumn(out_col, run(ids_col))


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() of every text, of which only counts and digests leave the workers.

    spans_crc32 is that of the pieces' end bytes in the text as given (int32), last_end the last of them.
    """

    def one(model, norm, source, words):
        n = at = last = spans = 0
        ids, back = sha256(), sha256()
        for block in model.blocks(norm, words):
            ends = at + np.cumsum(np.frombuffer(b"".join([w[2] for w in block]), np.uint8), dtype=np.int64)
            covered = source[ends]
            spans, at, last = crc32(covered.tobytes(), spans), int(ends[-1]), int(covered[-1])
            whole = "".join([w[1] for w in block])
            ids.update(("," if n else "").encode() + ",".join([w[0] for w in block]).encode())
            # The dummy mark's space is dropped.
            back.update((whole[1:] if not n and norm.startswith(MARK) else whole).encode())
            n += len(ends)
        return n, ids.hexdigest(), back.hexdigest(), last, spans

    def work(texts):
        model, got, short = load(model_path), [None] * len(texts), []
        for i, t in enumerate(texts):
            if len(t or "") > LONG_TEXT:
                got[i] = one(model, *model.normalise(t), None)
            else:
                norm, source = model.normalise(t or "")
                short.append((i, norm, source, model.words.findall(norm)))
        model.learn({w for s in short for w in s[3]})  # of all rows together: words of equal length are one matrix
        for i, *rest in short:
            got[i] = one(model, *rest)
        return list(zip(*got, strict=True))

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string, last_end long, spans_crc32 long"
    return map_texts(docs, id_col, [text_col], schema, lambda: work, rows=1000)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

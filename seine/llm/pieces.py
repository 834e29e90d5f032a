"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Distinct words of equal length advance together, one character at a time.  At each end
position and for each piece length, the hash of the substring probes the sorted hashes of
all pieces; the best candidate of each word is a vectorised maximum whose length is stored
as backpointer.

For a unigram model the score of a path is the sum of its pieces' scores.  A BPE model has
no such sum: its pieces come from merges in rank order.  Yet a sequence of pieces is the
result of those merges exactly if every two neighbours stay apart when they are merged
alone, so here the lattice keeps only such neighbours, and each prefix has one way in.
Results equal the sentencepiece library's.  `stays_apart` of a pair is computed once and
remembered.

Scale.  Encoding is local to a row.  Words are looked up in a bounded table that each
worker keeps, so only new ones are encoded.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.llm.tables import rows, texts

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = "▁"
_UNIT = re.compile(f"{_SPACE}+[^{_SPACE}]*")
#: Words that a worker remembers, pairs that it remembers, and words encoded at a time.
REMEMBERED, PAIRS, AT_ONCE = 500_000, 1_000_000, 20_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Vocabulary:
    """Pieces with ids and scores; `kind` is "bpe" or "unigram"."""

    def __init__(self, pieces: dict[str, tuple[int, float]], kind: str, bytes_of: list[int] | None, unknown: int):
        self.kind, self.unknown, self.byte_ids = kind, unknown, bytes_of
        self.id_of = {p: i for p, (i, _) in pieces.items()}
        self.score_of = {p: s for p, (_, s) in pieces.items()}
        self.longest = max(map(len, pieces), default=1)
        text = list(pieces)
        keys = self._hashes(text)
        order = np.argsort(keys)
        self.keys = keys[order]
        if len(np.unique(self.keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.may = np.zeros(1 << 20, bool)  # by a key's first 20 bits: most substrings need no search
        self.may[self.keys >> np.uint64(44)] = True
        self.ids = np.array([pieces[text[i]][0] for i in order], np.int64)
        self.scores = np.array([pieces[text[i]][1] for i in order], np.float64)
        self.text_of = {i: p for p, (i, _) in pieces.items()}
        self.apart: dict[int, bool] = {}

    @staticmethod
    def _hashes(text: list[str]) -> np.ndarray:
        out = np.zeros(len(text), np.uint64)
        size = np.array([len(p) for p in text])
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            codes = np.frombuffer("".join(text[i] for i in own).encode("utf-32-le"), "<u4").reshape(len(own), n)
            mixed = _mixed(codes.astype(np.uint64) + np.uint64(1))
            for column in range(n):
                out[own] = out[own] * _BASE + mixed[:, column]
        return out

    @classmethod
    def load(cls, model: str, kind: str) -> Vocabulary:
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_file=model if "/" in model else public_tokenizers.path(model))
        pieces, as_bytes = {}, {}
        for i in range(own.vocab_size()):
            if own.is_byte(i):
                as_bytes[int(own.id_to_piece(i)[3:5], 16)] = i
            elif not (own.is_control(i) or own.is_unknown(i) or own.is_unused(i)):
                pieces[own.id_to_piece(i)] = (i, own.get_score(i))
        return cls(pieces, kind, [as_bytes[b] for b in range(256)] if len(as_bytes) == 256 else None, own.unk_id())

    def merged(self, text: str) -> list[str]:
        """`text` by merging the best-scored neighbours, leftmost first: the definition of BPE.

        Neighbours wait in a heap and parts are a linked list, so long words cost n log n.
        """
        parts: list = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts):
                score = self.score_of.get(parts[i] + parts[j])
                if score is not None:
                    heappush(heap, (-score, i, parts[i], parts[j]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, left, right = heappop(heap)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue  # one of the two has merged meanwhile
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in parts if x is not None]

    def stays_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of piece ids: are they the merge result of their joined text?

        -1 is an unknown character, which merges with nothing; -2 is the begin of the word.
        """
        known, where = np.unique(((left + 2) << 32) | (right + 2), return_inverse=True)
        if len(self.apart) > PAIRS:
            self.apart = {}
        answer = np.array([-1 if x is None else x for x in map(self.apart.get, known.tolist())], np.int8)
        for n in np.flatnonzero(answer < 0).tolist():
            key = int(known[n])
            a, b = (key >> 32) - 2, (key & 0xFFFFFFFF) - 2
            if b == -1 or a == -1:
                got = b == -1 or self.merged(self.text_of[b]) == [self.text_of[b]]
            else:
                own = [self.text_of[b]] if a == -2 else [self.text_of[a], self.text_of[b]]
                got = self.merged("".join(own)) == own
            self.apart[key] = got
            answer[n] = got
        return answer[where] > 0

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words given as rows of code points: length and id of each prefix's last piece, and is there a path."""
        m, n = words.shape
        mixed = _mixed(words.astype(np.uint64) + np.uint64(1))
        best = np.full((m, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((m, n + 1), np.int64)
        last = np.full((m, n + 1), -2, np.int64)
        low = float(self.scores.min(initial=0)) - 10  # a unigram model's score of an unknown character
        hashed = np.zeros((m, 0), np.uint64)  # of substrings that end here, one column a start
        for end in range(1, n + 1):
            hashed = np.concatenate([hashed, np.zeros((m, 1), np.uint64)], axis=1) * _BASE + mixed[:, end - 1 : end]
            hashed = hashed[:, -self.longest :]
            flat = hashed.ravel()
            maybe = np.flatnonzero(self.may[flat >> np.uint64(44)])
            found = np.minimum(np.searchsorted(self.keys, flat[maybe]), len(self.keys) - 1)
            at, hit = np.zeros(flat.shape, np.int64), np.zeros(flat.shape, bool)
            at[maybe], hit[maybe] = found, self.keys[found] == flat[maybe]
            at, hit = at.reshape(hashed.shape), hit.reshape(hashed.shape)
            width = hashed.shape[1]
            score = np.full((m, width), -np.inf)
            piece = np.full((m, width), -1, np.int64)
            row, column = np.nonzero(hit)
            start = end - width + column
            open_ = best[row, start] > -np.inf
            row, column, start = row[open_], column[open_], start[open_]
            new = self.ids[at[row, column]]
            piece[row, column] = new
            if self.kind == "unigram":
                score[row, column] = best[row, start] + self.scores[at[row, column]]
            else:
                fits = self.stays_apart(last[row, start], new)
                score[row[fits], column[fits]] = end
            single = ~hit[:, -1] & (best[:, end - 1] > -np.inf)  # an unknown character is a piece of its own
            score[single, -1] = best[single, end - 1] + low if self.kind == "unigram" else end
            choice = score.argmax(axis=1)
            every = np.arange(m)
            best[:, end], last[:, end] = score[every, choice], piece[every, choice]
            back[:, end] = width - choice
        return back, last, best[:, n] > -np.inf

    @staticmethod
    def _walk(back: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[int], list[bool]]:
        """All words' pieces, followed backwards together: ids (right-aligned), their number, and are all characters known."""
        m, n = len(back), back.shape[1] - 1
        at, every = np.full(m, n), np.arange(m)
        columns, size, plain = [], np.zeros(m, np.int64), np.ones(m, bool)
        while (at > 0).any():
            ids = np.where(at > 0, last[every, at], 0)
            plain &= ids >= 0
            size += at > 0
            columns.append(ids)
            at = np.maximum(at - np.maximum(back[every, at], 1), 0)
        return np.stack(columns[::-1], axis=1).astype("<u4"), size.tolist(), plain.tolist()

    def _ids(self, word: str, cuts: list[int]) -> bytes:
        out, start = [], 0
        for end in cuts:
            piece = word[start:end]
            i = self.id_of.get(piece)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
            start = end
        return np.array(out, "<u4").tobytes()

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word, as little-endian unsigned 32-bit numbers."""
        out = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, same in by_length.items():
            step = max(1, AT_ONCE * 8 // n)
            for a in range(0, len(same), step):
                part = same[a : a + step]
                codes = np.frombuffer("".join(part).encode("utf-32-le"), "<u4").reshape(len(part), n)
                back, last, found = self.viterbi(codes)
                ids, size, plain = self._walk(back, last)
                raw, width = ids.tobytes(), 4 * ids.shape[1]
                for i, w in enumerate(part):
                    if plain[i] and found[i]:
                        out[w] = raw[(i + 1) * width - 4 * size[i] : (i + 1) * width]
                        continue
                    cuts, end = [], n
                    while end and found[i]:
                        cuts.append(end)
                        end -= int(back[i, end])
                    out[w] = self._ids(w, cuts[::-1] if found[i] else np.cumsum([len(p) for p in self.merged(w)]).tolist())
        return out


def words_of(text: str) -> list[str]:
    """`text` as SentencePiece sees it (space marks, one in front), cut before each run of marks.

    No piece holds a mark after another character, so these words are encoded alone.
    """
    return _UNIT.findall(_SPACE + text.replace(" ", _SPACE)) if text else []


class Encoder:
    def __init__(self, model: str = "piece_bpe_32k.model", kind: str = "bpe"):
        self.vocabulary = Vocabulary.load(model, kind)
        self.known: dict[str, bytes] = {}
        self.piece = np.full(max(self.vocabulary.text_of, default=0) + 1, None, object)
        for i, p in self.vocabulary.text_of.items():
            self.piece[i] = p.replace(_SPACE, " ").encode()
        for b, i in enumerate(self.vocabulary.byte_ids or []):
            self.piece[i] = bytes([b])

    def encode(self, batch: list[str]) -> list[bytes]:
        split = [words_of(t) for t in batch]
        held = set().union(*split) if split else set()
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = [w for w in held if w not in self.known]
        long = {}
        for w, ids in self.vocabulary.encode_words(new).items():
            (self.known if len(w) <= 40 else long)[w] = ids
        known = {**self.known, **long} if long else self.known
        return [b"".join([known[w] for w in words]) for words in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids; the mark in front is dropped, and bytes that are no text become U+FFFD."""
        pieces = self.piece[np.frombuffer(ids, "<u4")]
        return b"".join(p if p is not None else b"\xef\xbf\xbd" for p in pieces).decode(errors="replace")[1:]


@lru_cache(1)
def _encoder(model: str, kind: str) -> Encoder:
    """One a worker process, with what it remembers, for all its tasks."""
    return Encoder(model, kind)


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row of `docs`; null and empty texts have no ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        own = _encoder(model, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids, lines = (c.to_pylist() for c in batch.slice(at, 1000).columns)
                coded = [np.frombuffer(x, "<u4").astype(np.int32) for x in own.encode(lines)]
                yield rows(schema, {"doc_id": ids, "ids": coded})

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, model: str = "piece_bpe_32k.model", kind: str = "bpe") -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        own = _encoder(model, kind)
        for batch in batches:
            ids, lines = (c.to_pylist() for c in batch.columns)
            text = [None if x is None else own.decode(np.array(x, "<u4").tobytes()) for x in lines]
            yield rows(schema, {"doc_id": ids, "text": text})

    return coded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame, model: str = "piece_bpe_32k.model", kind: str = "bpe") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256, same): every whole text encoded and decoded again.

    The only text that does not come back is one with U+2581, which stands for a space.
    A null text counts as empty and has no ids; repeated rows and rows without doc_id each
    come back; other columns are not read.  An empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("same", pa.bool_())])

    def run(batches):
        own = _encoder(model, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids, lines = (c.to_pylist() for c in batch.slice(at, 1000).columns)
                coded = own.encode(lines)
                back = [own.decode(x) for x in coded]
                yield rows(
                    schema,
                    {
                        "doc_id": ids,
                        "n_ids": [len(x) // 4 for x in coded],
                        "ids_crc32": [zlib.crc32(x) for x in coded],
                        "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in back],
                        "same": [a == b for a, b in zip(lines, back)],
                    },
                )

    return texts(docs).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, same boolean")

"""SentencePiece encoding and decoding with a merge-type vocabulary.

A text's characters are symbols; an agenda holds every adjacent pair whose join is a piece, best score first and, of
equal scores, leftmost first. The best pair is merged and the pairs that it now forms go on the agenda, until none is
left. Symbols that are no piece become byte pieces.

Where no piece has a word mark after another character, or anything but a letter after a letter, and around characters
that are part of one-character pieces only (or of none), nothing merges across; so each stretch between such places has
its own agenda and gives the same pieces alone as within its text. Which of these hold is read off the vocabulary.
Workers remember the ids of short stretches, a bounded number of them. Each stretch that a worker meets first is also
encoded by the sentencepiece library, batch by batch: column agrees.

Decoding joins the pieces' bytes; a word mark is a space, the one that encoding puts first is dropped, and bytes that
are no UTF-8 become U+FFFD.

Defined cases: a null or empty text is the begin and end ids, decoded empty; texts of any length are taken whole; a
null id comes back null; rows that repeat are encoded one by one; of equal scores the left pair is merged; an empty
table gives an empty result; other columns are ignored. A vocabulary that is not of merge type, changes characters
before encoding, or has unused pieces is refused with ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"
#: Stretches whose ids a worker keeps, and the longest such stretch.
CACHE, CACHE_CHARS = 800_000, 64
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


def _any_of(characters: set[str]) -> str:
    return "[" + re.escape("".join(sorted(characters))) + "]" if characters else r"(?!)"


class Vocabulary:
    """Pieces, scores and rules of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            parts = list(_fields(file.read()))
        entries = [dict(_fields(v)) for f, v in parts if f == 1]
        trainer, normaliser = (dict(_fields(next((v for f, v in parts if f == k), b""))) for k in (2, 3))
        kinds = [e.get(3, NORMAL) for e in entries]
        texts = [e[1].decode() for e in entries]
        if trainer.get(3, 1) != BPE or trainer.get(24, 0) or UNUSED in kinds:
            raise ValueError("a vocabulary of merge type without unused pieces is needed")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("a vocabulary that changes no characters is needed")
        self.prefix = bool(normaliser.get(3, 1))
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.unknown = kinds.index(UNKNOWN)
        self.ids = {t: i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k in (NORMAL, USER)}
        self.scores = {t: struct.unpack("<f", entries[i].get(2, bytes(4)))[0] for t, i in self.ids.items()}
        self.bytes = [0] * 256 if trainer.get(35) else None
        self.surface, self.is_byte = [], np.zeros(len(texts), bool)
        for i, (text, kind) in enumerate(zip(texts, kinds, strict=True)):
            if kind == BYTE:
                value = int(text[3:5], 16)
                self.is_byte[i] = True
                self.surface.append(bytes([value]))
                if self.bytes:
                    self.bytes[value] = i
            elif kind == UNKNOWN:
                self.surface.append(trainer.get(44, b" \xe2\x81\x87 "))
            else:
                self.surface.append(b"" if kind == CONTROL else text.replace(MARK, " ").encode())
        self.user = {t for t, k in zip(texts, kinds, strict=True) if k == USER}
        longer = [t for t in self.ids if len(t) > 1]
        joins = {c for t in longer for c in t} - {MARK}
        letters = {c for c in joins if c.isalpha()}
        crossed = {y for t in longer for x, y in zip(t, t[1:], strict=False) if x in letters and y not in letters}
        whole = "".join(re.escape(t) + "|" for t in sorted(self.user, key=len, reverse=True))
        if any(MARK in t.lstrip(MARK) for t in longer):  # a piece goes over a word's start
            body = f"{_any_of(joins | {MARK})}+"
        elif crossed:
            body = f"{MARK}*{_any_of(joins)}+|{MARK}+"
        else:  # no piece has anything else after a letter
            body = f"{MARK}*{_any_of(joins - letters)}*{_any_of(letters)}+|{MARK}*{_any_of(joins - letters)}+|{MARK}+"
        #: Stretches that nothing merges across.
        self.stretch = re.compile(f"{whole}{body}|.", re.DOTALL)
        order = sorted(set(self.scores.values()), reverse=True)
        rank = {score: i for i, score in enumerate(order)}
        #: A piece's place by score: 0 is merged first.
        self.places = {t: rank[x] for t, x in self.scores.items()}

    def merged(self, stretch: str) -> list[str]:
        """The stretch's symbols after all merges."""
        if stretch in self.user or len(stretch) == 1:
            return [stretch]
        place, push, pop = self.places.get, heapq.heappush, heapq.heappop
        symbols: list[str] = list(stretch)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for left in range(n - 1):
            joined = stretch[left : left + 2]
            at = place(joined)
            if at is not None:
                agenda.append((at, left, left + 1, joined))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, joined = pop(agenda)
            # A symbol that has been merged since is longer, or empty.
            if not symbols[right] or symbols[left] + symbols[right] != joined:
                continue
            symbols[left] = joined
            symbols[right] = ""
            beyond = after[left] = after[right]
            if beyond >= 0:
                before[beyond] = left
                longer = joined + symbols[beyond]
                at = place(longer)
                if at is not None:
                    push(agenda, (at, left, beyond, longer))
            ahead = before[left]
            if ahead >= 0:
                longer = symbols[ahead] + joined
                at = place(longer)
                if at is not None:
                    push(agenda, (at, ahead, left, longer))
        return [s for s in symbols if s]

    def stretch_ids(self, stretch: str) -> list[int]:
        ids: list[int] = []
        for symbol in self.merged(stretch):
            known = self.ids.get(symbol)
            if known is not None:
                ids.append(known)
            elif self.bytes:
                ids += [self.bytes[b] for b in symbol.encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def normal(self, text: str) -> str:
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for."""
        parts = [self.surface[i] for i in ids.tolist()]
        if self.prefix:
            first = next((k for k, p in enumerate(parts) if p), None)
            if first is not None and parts[first].startswith(b" ") and not self.is_byte[ids[first]] and ids[first] != self.unknown:
                parts[first] = parts[first][1:]
        try:
            if all(parts[1:-1]):  # no control piece parts bytes
                return b"".join(parts).decode()
        except UnicodeDecodeError:
            pass
        out = []
        for byte, run in itertools.groupby(range(len(parts)), lambda k: bool(self.is_byte[ids[k]])):
            data = b"".join(parts[k] for k in run)
            out.append(_lenient(data) if byte else data.decode())
        return "".join(out)


def _lenient(data: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that is part of no character."""
    out, at = [], 0
    while at < len(data):
        size = next((s for s in (1, 2, 3, 4) if _valid(data[at : at + s], s)), 0)
        out.append(data[at : at + size].decode() if size else "�")
        at += size or 1
    return "".join(out)


def _valid(data: bytes, size: int) -> bool:
    try:
        return len(data) == size and len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


class Encoder:
    """Ids of whole texts, and whether the library agrees on each stretch met."""

    def __init__(self, path: str):
        import sentencepiece

        self.vocabulary = Vocabulary(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, bytes] = {}
        self.differ: set[str] = set()

    def _by_library(self, stretches: list[str]) -> list[list[int]]:
        """A stretch after a line end, which merges with nothing in a vocabulary where that is no piece's part; the
        library puts a word mark before all."""
        lead = self.library.encode("\n")
        return [ids[len(lead) :] for ids in self.library.encode(["\n" + s.replace(MARK, " ") for s in stretches], num_threads=1)]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
        voc, known = self.vocabulary, self.known
        parts = [voc.stretch.findall(voc.normal(t)) for t in texts]
        if len(known) > CACHE:
            known.clear()
            self.differ.clear()
        new = [s for s in set(itertools.chain.from_iterable(parts)) if s not in known]
        by_library = self._by_library(new) if new else []
        for stretch, theirs in zip(new, by_library, strict=True):
            ids = voc.stretch_ids(stretch)
            known[stretch] = np.array(ids, "<u4").tobytes()
            if ids != theirs:
                self.differ.add(stretch)
        ends = [np.array([i] if i >= 0 else [], "<u4").tobytes() for i in (voc.begin, voc.end)]
        for stretches in parts:
            data = b"".join([ends[0], *map(known.__getitem__, stretches), ends[1]])
            yield np.frombuffer(data, "<u4"), not self.differ or self.differ.isdisjoint(stretches)
        for stretch in new:
            if len(stretch) > CACHE_CHARS:
                del known[stretch]
                self.differ.discard(stretch)


_ENCODERS: dict[str, Encoder] = {}


def _encoded(path: str, chars: int = 2_000_000):
    """For mapInArrow: doc_id, text to one row of digests each; so many characters at a time."""

    def run(batches):
        import pyarrow as pa

        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        for batch in batches:
            texts, at = [t or "" for t in batch.column(1).to_pylist()], 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= chars):
                    size += len(texts[stop])
                    stop += 1
                out: list[list] = [[], [], [], []]
                for ids, agrees in encoder.encode(texts[at:stop]):
                    decoded = encoder.vocabulary.decode(ids)
                    for column, x in zip(out, (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), agrees), strict=True):
                        column.append(x)
                types = (pa.int64(), pa.string(), pa.string(), pa.bool_())
                columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])
                at = stop

    return run


def _ids(path: str):
    """For mapInArrow: doc_id, text to the ids themselves and the text that they decode to."""

    def run(batches):
        import pyarrow as pa

        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        for batch in batches:
            for row in range(batch.num_rows):
                (ids, _), = encoder.encode([batch.column(1)[row].as_py() or ""])
                columns = [batch.column(0).slice(row, 1), pa.array([ids.astype(np.int32)], pa.list_(pa.int32())), pa.array([encoder.vocabulary.decode(ids)])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

    return run


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids with begin and end, decoded: for those who go on with the tokens."""
    return _given(docs, id_col, text_col).mapInArrow(_ids(model or default_model()), "doc_id long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and whether the library agrees."""
    return _given(docs, id_col, text_col).mapInArrow(_encoded(model or default_model()), ENCODED)

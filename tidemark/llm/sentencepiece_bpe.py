"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

An encoding is right if each token encodes to itself and each pair of neighbours encodes to that pair.
So a text is read left to right: take the longest vocabulary entry that starts here (Aho-Corasick finds
all entries in one pass), check that it stands next to the token before by merging the two again, go on;
where nothing fits, mark the position as failed in a bitfield, step back and try the next shorter entry.

The model's file is read with a small protobuf reader of its own; the sentencepiece library is not needed
(the tests hold the results against it). The path of the file is a parameter; with ``None`` each executor
finds it in its own installed package.
"""

from __future__ import annotations

import hashlib
import re
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, vocabulary_path

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[i]
        i += 1
        out |= (x & 127) << shift
        if x < 128:
            return out, i
        shift += 7


def _fields(b: bytes):
    """(number, value) of a protobuf message: ints, and bytes for the other kinds."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class Model:
    """A merge-type model with byte fallback and identity normalisation."""

    CACHE, PAIRS = 200_000, 500_000  # chunks and pairs remembered per process

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        self.pieces, self.kinds, self.scores = [], [], []
        trainer, normalizer = {}, {}
        for number, value in message:
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or normalizer.get(2, b"") or normalizer.get(4, 1) or USER_DEFINED in self.kinds:
            raise ValueError("a BPE model without normalisation rules and own symbols is expected")
        self.prefix = bool(normalizer.get(3, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        self.fallback = bool(trainer.get(35, 0))
        self.bytes = [0] * 256
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds)):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.merged = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.known = {p for p in self.merged if len(p) == 1}
        # A chunk may start at a space mark after another character only if no entry spans that place.
        self.chunks = None if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.merged) else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.automaton = ahocorasick.Automaton()
        sound = {p: i for p, i in self.merged.items() if self.merge(p) == [i]}  # others never come out of merging
        for p, i in sound.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.lengths = [len(p) for p in self.pieces]
        self.shorter = [-1] * len(self.pieces)  # the next shorter entry that starts alike
        for p, i in sound.items():
            self.shorter[i] = next((sound[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in sound), -1)
        self.special = frozenset(i for i, k in enumerate(self.kinds) if k != NORMAL)
        self.pairs: dict[int, bool] = {}  # by first << 20 | second
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def merge(self, text: str) -> list[int]:
        """Plain merging: the neighbours whose union scores best, leftmost first, until none unite."""
        parts, get, scores = list(text), self.merged.get, self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if at < 0:
                return [get(p, -1) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, a: int, b: int) -> bool:
        if len(self.pairs) > self.PAIRS:
            self.pairs.clear()
        found = self.pairs[a << 20 | b] = self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
        return found

    def _backtrack(self, text: str) -> list[int]:
        """Token ids of a text all of whose characters are entries."""
        n = len(text)
        longest = [0] * n
        for end, (token, length) in self.automaton.iter(text):
            longest[end - length + 1] = token  # of equal starts the longest ends last
        lengths, shorter, pairs = self.lengths, self.shorter, self.pairs
        failed = 0  # bit p: nothing that can stand before p lets the text go on from there
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            while token >= 0:
                end = at + lengths[token]
                if not (failed and failed >> end & 1):
                    if last < 0:
                        break
                    fits = pairs.get(last << 20 | token)
                    if fits is None:
                        fits = self._fits(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, longest[end]
            else:
                if not out:
                    return self.merge(text)  # no compatible path: cannot happen with a sound vocabulary
                failed |= 1 << at
                token = out.pop()
                at -= lengths[token]
                token, last = shorter[token], out[-1] if out else -1

    def _encode_chunk(self, chunk: str) -> list[int]:
        if self.known.issuperset(chunk):
            return self._backtrack(chunk)
        ids, run = [], []
        for c in chunk:
            if c in self.known:
                run.append(c)
                continue
            if run:
                ids += self._backtrack("".join(run))
                run = []
            ids += [self.bytes[b] for b in c.encode()] if self.fallback else [self.unknown]
        if run:
            ids += self._backtrack("".join(run))
        return ids

    def _chunks_of(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if self.prefix:
            text = SPACE + text
        return self.chunks.findall(text) if self.chunks else [text]

    def encode(self, text: str | None) -> list[int]:
        return [i for chunk in self._chunks_of(text or "") for i in self._encode_chunk(chunk)]

    def _decode(self, ids) -> str:
        """Pieces joined; runs of byte entries are read as UTF-8, each byte that is none as U+FFFD."""
        if self.special.isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out, pending = [], bytearray()

        def flush():
            while pending:
                try:
                    out.append(pending.decode())
                    pending.clear()
                except UnicodeDecodeError as e:
                    out.append(pending[: e.start].decode() + "�")
                    del pending[: e.start + 1]

        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                pending.append(int(self.pieces[i][3:5], 16))
                continue
            flush()
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            elif kind != CONTROL:
                out.append(self.pieces[i].replace(SPACE, " "))
        flush()
        return "".join(out)

    def decode(self, ids) -> str:
        text = self._decode(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), self.unknown)
        return text[1:] if self.prefix and self.pieces[first].startswith(SPACE) else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(tokens, decimal ids joined by commas, decoded text), by chunks seen before where possible."""
        n, ids, decoded, cache = 0, [], [], self.cache
        for chunk in self._chunks_of(text or ""):
            found = cache.get(chunk)
            if found is None:
                found = self.older.get(chunk)
                if found is None:
                    own = self._encode_chunk(chunk)
                    found = (len(own), ",".join(map(str, own)), self._decode(own))
                if len(chunk) <= 64:
                    if 2 * len(cache) >= self.CACHE:  # the older half goes, what was seen of late stays
                        self.older, self.cache = cache, {}
                        cache = self.cache
                    cache[chunk] = found
            n += found[0]
            ids.append(found[1])
            decoded.append(found[2])
        text = "".join(decoded)
        return n, ",".join(ids), text[1:] if self.prefix and text.startswith(" ") else text


_MODELS: dict[str, Model] = {}


def model_at(path: str | None = None) -> Model:
    """The model of a file, read once per process."""
    path = path or vocabulary_path("piece_bpe_32k.model")
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """Token ids of each whole text, and the text decoded from them: (id_col, ids array<int>, decoded).

    A null text counts as empty and has no tokens. Repeated rows stay repeated, other columns are left
    out, a null id stays null, an empty table gives an empty table. One narrow pass, no shuffle.
    """

    def run(batches):
        model = model_at(model_path)
        for pdf in batches:
            ids = [model.encode(t) for t in pdf["t"]]
            yield pd.DataFrame({"i": pdf["i"], "ids": ids, "decoded": [model.decode(x) for x in ids]})

    return map_rows(df, id_col, {"t": F.col(text_col)}, run, "ids array<int>, decoded string")


def decode_ids(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model_path: str | None = None) -> DataFrame:
    """df with the text of an array of token ids; null ids give a null text."""

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        model = model_at(model_path)
        return ids.map(lambda x: None if x is None else model.decode(x))

    return df.withColumn(out_col, run(F.col(ids_col)))


def encode_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """As encode_texts, with digests for tokens and text: (id_col, n_tokens, ids_sha256, decoded_sha256,
    round_trip: the decoded text equals the text). Chunks that recur are encoded once per process."""

    def run(batches):
        model, sha = model_at(model_path), hashlib.sha256
        for pdf in batches:
            n, ids, decoded, same = [], [], [], []
            for text in pdf["t"]:
                k, joined, back = model.digest(text)
                n.append(k)
                ids.append(sha(joined.encode()).hexdigest())
                decoded.append(sha(back.encode()).hexdigest())
                same.append(back == (text or ""))
            yield pd.DataFrame({"i": pdf["i"], "n_tokens": pd.Series(n, dtype="int64"), "ids_sha256": ids, "decoded_sha256": decoded, "round_trip": pd.Series(same, dtype="bool")})

    return map_rows(df, id_col, {"t": F.col(text_col)}, run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean")

"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A token sequence is the one BPE gives iff every two neighbours are *stable*: merging
their joined bytes gives these two tokens again.  So the encoder is a transducer
whose configurations are (last token, bytes read since): a byte extends the bytes
read, and where they spell a token that is stable after the last one, a
configuration starts afresh and emits it.  The live configurations are a state of
the determinised machine.  States and moves are made as the text asks for them, kept in
tables of bounded size (``MAX_STATES``, ``MAX_PIECES``, ``MAX_PAIRS``: some 200 MB in all), shared by all texts of a task and
emptied when it ends, so that workers that Spark keeps do not hold them.  Exactly one configuration
spells the whole prefix; outputs that all live ones share are emitted at once, and
the longest token bounds how far that lags behind.

Pieces (matches of the tokenizer's pattern) repeat, so their packed ids are kept as
well.  As in tiktoken, a piece that is itself a token is that token.

Decoding joins the tokens' bytes and follows UTF-8 by a state machine whose moves
over whole tokens are tabled lazily; it says after every token whether the text so far ends at
a character's end.

Defined cases: null and empty texts have no tokens; invalid ids raise; lone
surrogates can't occur in Spark strings; a very long text is encoded whole, piece by piece, and a
piece of any length in one pass over its bytes; rows repeat as they come, whatever their ids; an empty table
stays empty; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import gc
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries after which a task's tables start afresh.
MAX_STATES, MAX_PIECES, MAX_PAIRS = 200_000, 300_000, 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file: base64 token and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encodes the pieces of one vocabulary; makes its states as needed.

    Bytes read are a node of the vocabulary's trie, and a configuration is one
    integer: the last token's number + 1, then NODE_BITS bits of the node (0: none read).
    """

    NODE_BITS = 20

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte
        self.token_at = [-1]
        self.inner = [True]
        for text, rank in ranks.items():
            node = 0
            for byte in text:
                self.inner[node] = True
                key = node << 8 | byte
                if (node := self.child.get(key, -1)) < 0:
                    node = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
            self.token_at[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.states: dict[tuple[int, ...], dict] = {}  # a state: its configurations under -1, its moves under their bytes
        self.steps: dict[tuple, tuple] = {}  # what many moves have in common
        self.start = self._state((0,))

    def forget(self) -> None:
        self.pairs.clear()
        self.halves.clear()
        self._restart()

    def _state(self, configs: tuple[int, ...]) -> dict:
        if (state := self.states.get(configs)) is None:
            state = self.states[configs] = {-1: configs}
        return state

    def merge(self, piece: bytes, until: int = 1) -> list[int]:
        """Plain BPE of a few bytes, until so many parts are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.ranks.get
        while len(parts) > until:
            rank, i = min((get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token's bytes joins; None for a byte, and for a token that merging never makes."""
        if token not in self.halves:
            text = self.bytes_of[token]
            parts = self.merge(text, 2) if len(text) > 1 else []
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def stable(self, last: int, token: int) -> bool:
        """Whether merging leaves the boundary between two neighbours alone.

        Undo the merges next to the boundary, the latest first: were there, at any
        moment, a merge across it of lower rank than the one undone, it would have come first.
        """
        key = last << 20 | token
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self._stable(last, token)
        return ok

    def _stable(self, a: int, b: int) -> bool:
        text, get = self.bytes_of, self.ranks.get
        limit = 1 << 60
        while True:
            if get(text[a] + text[b], 1 << 60) < limit:
                return False
            left, right = self.split(a), self.split(b)
            if left and (a > b or not right):
                limit, a = a, left[1]  # of equal ranks the leftmost merges first: the one across comes later
            elif right:
                limit, b = b + 1, right[0]
            else:
                return True

    def _move(self, state: dict, byte: int) -> tuple:
        """(next state, the configurations there come from, the token each emits or -1, and if only one lives: that it does)."""
        configs, parents, outs = [], [], []
        child, token_at, inner, bits, known = self.child.get, self.token_at, self.inner, self.NODE_BITS, self.pairs.get
        mask, ended, k = (1 << bits) - 1, False, -1
        for c in state[-1]:
            k += 1
            if (node := child((c & mask) << 8 | byte)) is None:
                continue
            if not ended and (token := token_at[node]) >= 0:
                if c <= mask or (ok if (ok := known((c >> bits) - 1 << 20 | token)) is not None else self.stable((c >> bits) - 1, token)):
                    ended = True
                    configs.append(token + 1 << bits)
                    parents.append(k)
                    outs.append(token)
            if inner[node]:
                configs.append(c & ~mask | node)
                parents.append(k)
                outs.append(-1)
        step = tuple(parents), tuple(outs), len(outs) == 1
        move = state[byte] = self._state(tuple(configs)), *self.steps.setdefault(step, step)
        return move

    def encode(self, piece: bytes) -> list[int]:
        if (token := self.ranks.get(piece)) is not None:
            return [token]
        if len(self.states) > MAX_STATES:
            self._restart()
        done: list[int] = []
        state, trail = self.start, []  # trail: the moves whose output is not yet common to all
        for byte in piece:
            move = state.get(byte) or self._move(state, byte)
            state = move[0]
            if not move[3]:
                trail.append(move)
            elif trail:  # one configuration lives: its output is final
                trail.append(move)
                done += self._output(trail, 0)
                trail.clear()
                if len(self.states) > MAX_STATES:
                    configs = state[-1]
                    self._restart()
                    state = self._state(configs)
            elif (token := move[2][0]) >= 0:
                done.append(token)
        if trail:
            mask = (1 << self.NODE_BITS) - 1
            done += self._output(trail, next(k for k, c in enumerate(state[-1]) if not c & mask))
        return done

    @staticmethod
    def _output(trail: list[tuple], k: int) -> list[int]:
        """What the k-th configuration at the trail's end has emitted along it."""
        out = []
        for _, parents, outs, _ in reversed(trail):
            if (token := outs[k]) >= 0:
                out.append(token)
            k = parents[k]
        return out[::-1]


class Decoder:
    """Streaming decoder: bytes of ids, and whether they end at a character's end or are invalid."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.steps: dict[tuple, tuple | None] = {}
        self.whole = np.zeros(max(ranks.values(), default=0) + 1, bool)
        for token, rank in ranks.items():
            self.whole[rank] = token.isascii() or self.step((), rank) == ()

    @staticmethod
    def byte_step(state: tuple | None, byte: int) -> tuple | None:
        """state: the (low, high) ranges that the bytes to come must lie in; () between characters; None once invalid."""
        if state is None:
            return None
        if state:
            return state[1:] if state[0][0] <= byte <= state[0][1] else None
        if byte < 0x80:
            return ()
        more = (0x80, 0xBF)
        if 0xC2 <= byte <= 0xDF:
            return (more,)
        if 0xE0 <= byte <= 0xEF:
            return ((0xA0, 0xBF) if byte == 0xE0 else (0x80, 0x9F) if byte == 0xED else more, more)
        if 0xF0 <= byte <= 0xF4:
            return ((0x90, 0xBF) if byte == 0xF0 else (0x80, 0x8F) if byte == 0xF4 else more, more, more)
        return None

    def step(self, state: tuple | None, token: int) -> tuple | None:
        key = state, token
        if key not in self.steps:
            for byte in self.bytes_of[token]:
                state = self.byte_step(state, byte)
            self.steps[key] = state
        return self.steps[key]

    def decode(self, ids: np.ndarray) -> tuple[bytes, bool]:
        """The bytes, and whether they are valid UTF-8 that ends at a character's end.

        Tokens that lead from a character's end to a character's end need no
        step of the machine where they stand at one.
        """
        state = ()
        for i in np.flatnonzero(~self.whole[ids]).tolist():
            if state == () or i == at + 1:
                state, at = self.step(state, int(ids[i])), i
            else:  # a whole token stands between: what is open is cut off
                state = None
            if state is None:
                break
        if state and at + 1 < len(ids):
            state = None
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())), state == ()


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process: the vocabulary is read once, its tables are emptied by :func:`in_use`."""
    return Codec(path, pattern)


@contextlib.contextmanager
def in_use(path: str, pattern: str) -> Iterator[Codec]:
    """The codec for the time of a task.  Its millions of small objects hold no cycles: the collector looks at them rarely."""
    own, before = codec(path, pattern), gc.get_threshold()
    gc.set_threshold(200_000, 50, 100)
    try:
        yield own
    finally:
        own.forget()
        gc.set_threshold(*before)


class Codec:
    """Encoder and decoder of whole texts, with the packed ids of pieces and of words kept.

    A space with non-spaces on both sides always starts a piece, so a text can be
    cut before each of these and what stands between, a word with its marks, be looked up whole.
    """

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.pieces = regex.compile(pattern)
        self.transducer, self.decoder = Transducer(ranks), Decoder(ranks)
        self.packed: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def forget(self) -> None:
        self.packed.clear()
        self.words.clear()
        self.transducer.forget()
        self.decoder.steps.clear()

    def _pack_piece(self, piece: str) -> bytes:
        if (out := self.packed.get(piece)) is None:
            if len(self.packed) >= MAX_PIECES:
                self.packed.clear()
            ids = self.transducer.encode(piece.encode())
            out = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= 100:
                self.packed[piece] = out
        return out

    def _pack(self, chunk: str) -> bytes:
        return b"".join(map(self._pack_piece, self.pieces.findall(chunk)))

    def _pack_word(self, word: str) -> bytes:
        """A space and a word; None for a word that can't be cut off by itself."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        pieces = self.pieces.findall(" " + word)
        if len(pieces) > 1:
            out = b"".join(map(self._pack_piece, pieces))
        else:  # kept as a word, not as a piece as well
            ids = self.transducer.encode(pieces[0].encode())
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 100:
            if len(self.words) >= MAX_PIECES:
                self.words.clear()
            self.words[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        first, *words = text.split(" ")
        if first and not first[-1].isspace():
            get, pack = self.words.get, self._pack_word
            out = [get(w) or pack(w) for w in words]
            if None not in out:
                return self._pack(first) + b"".join(out)
        chunks, at = [], first  # runs of white space: cut only before single spaces
        for w in words:
            if w and at and not w[0].isspace() and not at[-1].isspace():
                chunks.append(at)
                at = " " + w
            else:
                at += " " + w
        return b"".join(map(self._pack, [*chunks, at]))

    def decode(self, packed: bytes) -> tuple[bytes, bool]:
        return self.decoder.decode(np.frombuffer(packed, "<u4"))


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, ids array<long>): the tokens of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with in_use(path, pattern) as own:
            for batch in batches:
                ids = [memoryview(own.encode(t.as_py() or "")).cast("I").tolist() for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_column]}, ids array<long>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, data binary, whole boolean) of rows (doc_id, ids): whole says that the bytes are valid, complete UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(load_ranks(path))
        for batch in batches:
            out = [decoder.decode(np.array(t.as_py() or [], np.int64)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.bool_())], names=["doc_id", "data", "whole"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, data binary, whole boolean")


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256, whole): encodes each text and decodes its ids, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with in_use(path, pattern) as own:
            for batch in batches:
                rows = []
                for t in batch.column(1):
                    ids = own.encode(t.as_py() or "")
                    data, whole = own.decode(ids)
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest(), whole))
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "whole"])

    schema = f"doc_id {dict(docs.dtypes)[id_column]}, n_tokens long, ids_sha256 string, decoded_sha256 string, whole boolean"
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)

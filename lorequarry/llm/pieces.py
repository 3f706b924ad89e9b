"""SentencePiece-style encoding: unigram Viterbi over a double-array trie.

The vocabulary is the piece list of a public model file, with its stored scores
taken as log scores.  A text gets a leading space, spaces become the marker
``U+2581``, and the best-scoring segmentation is found by Viterbi.  A character
that no piece holds costs a penalty and is written as byte pieces, so any text is
encoded and decodes to itself.

No piece holds a marker after another character, nor a line break, so the best
segmentation of a text is that of its space-led chunks one after another.  Chunks
are solved once for each batch, many side by side in numpy, and remembered.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lorequarry.llm.arrow import map_batches, pick

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
#: Scores at or below this mark pieces that were never ranked.
UNRANKED = -1e8
#: Chunks remembered at once by a worker; beyond that the memory starts anew.
REMEMBERED = 400_000

_CHUNK = re.compile(r"\n| +[^ \n]*|[^ \n]+")


class DoubleArrayTrie:
    """Byte strings to values in arrays ``base``, ``check`` and ``value``.

    The child of state ``s`` by byte ``c`` is ``base[s] + c + 1``, if its ``check``
    is ``s``.  State 0 is the root; ``value`` is -1 where no key ends.
    """

    def __init__(self, keys: dict[bytes, int]) -> None:
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, value in keys.items():
            at = 0
            for c in key:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][c]
            ends[at] = value
        self._place(children, ends)

    def _place(self, children: list[dict[int, int]], ends: list[int]) -> None:
        """Give each node a state.  A lone child takes the first free slot; several
        look at a few places, then go behind all that is used."""
        used = bytearray(300)
        used[0] = 1
        base, check, value = {}, {}, {}
        queue, lone, several = deque([(0, 0)]), 300, 1
        while queue:
            node, state = queue.popleft()
            value[state] = ends[node]
            kids = children[node]
            if not kids:
                continue
            if len(kids) == 1:
                while lone < len(used) and used[lone]:
                    lone += 1
                at = lone - 1 - next(iter(kids))
            else:
                first = 1 + min(kids)
                for at in range(max(1, several - first), max(1, several - first) + 64):
                    if not any(at + c + 1 < len(used) and used[at + c + 1] for c in kids):
                        break
                else:
                    at = len(used)
                several = max(several, at + first - 32)
            base[state] = at
            for c, child in kids.items():
                slot = at + c + 1
                if slot >= len(used):
                    used.extend(bytes(slot + 1 - len(used)))
                used[slot] = 1
                check[slot] = state
                queue.append((child, slot))
        size = len(used) + 260
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        for array, filled in ((self.base, base), (self.check, check), (self.value, value)):
            array[list(filled)] = list(filled.values())


@dataclass
class PieceModel:
    """What encoding needs of a vocabulary, small enough to ship to executors."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    trie: DoubleArrayTrie
    longest: int
    unknown: float

    @classmethod
    def load(cls, path: str = VOCABULARY) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces, scores, byte_ids, keys = [], np.zeros(n), np.zeros(256, np.int32), {}
        for i in range(n):
            piece, scores[i] = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                pieces.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                pieces.append(b"")
            else:
                pieces.append(piece.replace(MARKER, " ").encode())
                keys[piece.encode()] = i
        if any(MARKER in k.decode().lstrip(MARKER) or b"\n" in k for k in keys):
            raise ValueError("a piece crosses a chunk's bounds")
        unknown = float(scores[scores > UNRANKED].min()) - UNKNOWN_PENALTY
        # Pieces that were never ranked (runs of spaces) cost what an unknown character does.
        scores[scores <= UNRANKED] = unknown
        return cls(pieces, scores, byte_ids, DoubleArrayTrie(keys), max(map(len, keys)), unknown)


class Encoder:
    """Encodes texts with a ``PieceModel``; remembers the ids of chunks."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.known: dict[str, bytes] = {}

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        chunked = [_CHUNK.findall(" " + t) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        self._solve({c for chunks in chunked for c in chunks}.difference(known))
        return [np.frombuffer(b"".join(map(known.__getitem__, chunks)), np.int32) for chunks in chunked]

    def decode(self, ids: np.ndarray) -> str:
        return decode(self.model, ids)

    def _solve(self, chunks: set[str]) -> None:
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for c in chunks:
            if MARKER in c:  # a marker that stands in the text is not a space: only bytes can spell it
                self.known[c] = self._with_marker(c)
            else:
                raw = c.replace(" ", MARKER).encode("utf-8", "surrogatepass")
                by_length.setdefault(len(raw), []).append((c, raw))
        for length, found in by_length.items():
            step = max(1, (1 << 20) // length)
            for at in range(0, len(found), step):
                part = found[at : at + step]
                rows = np.frombuffer(b"".join(raw for _, raw in part), np.uint8).reshape(len(part), length)
                for (c, _), ids in zip(part, self._viterbi(rows), strict=True):
                    self.known[c] = ids

    def _with_marker(self, chunk: str) -> bytes:
        """A chunk that holds the marker itself: its bytes stand between the rest."""
        out = []
        for k, part in enumerate(chunk.split(MARKER)):
            if k:
                out.append(self.model.byte_ids[list(MARKER.encode())].astype(np.int32).tobytes())
            if part:
                if part not in self.known:
                    self._solve({part})
                out.append(self.known[part])
        return b"".join(out)

    def _viterbi(self, rows: np.ndarray) -> list[bytes]:
        """Best segmentations of byte strings of one length, side by side.

        Ties go to the piece that starts later.
        """
        m, trie = self.model, self.model.trie
        n, length = rows.shape
        best = np.full((length + 1, n), -np.inf)
        start = np.zeros((length + 1, n), np.int32)
        piece = np.full((length + 1, n), -1, np.int32)
        best[0] = 0
        lead = (rows & 0xC0) != 0x80
        columns = rows.T.astype(np.int32)
        for i in range(length):
            at = np.flatnonzero(lead[:, i])
            if not len(at):
                continue
            here = best[i, at]
            # A single character can always be spelt in bytes.
            width = np.where(columns[i, at] < 0x80, 1, np.where(columns[i, at] < 0xE0, 2, np.where(columns[i, at] < 0xF0, 3, 4)))
            end = np.minimum(i + width, length)
            better = here + m.unknown >= best[end, at]
            best[end[better], at[better]] = here[better] + m.unknown
            start[end[better], at[better]] = i
            piece[end[better], at[better]] = -1
            state, live, score = np.zeros(len(at), np.int32), at, here
            for j in range(i, min(length, i + m.longest)):
                following = trie.base[state] + columns[j, live] + 1
                ok = (trie.check[following] == state) & (trie.base[state] > 0)
                if not ok.any():
                    break
                state, live, score = following[ok], live[ok], score[ok]
                ids = trie.value[state]
                ends = ids >= 0
                if ends.any():
                    who, total = live[ends], score[ends] + m.scores[ids[ends]]
                    better = total >= best[j + 1, who]
                    who = who[better]
                    best[j + 1, who] = total[better]
                    start[j + 1, who] = i
                    piece[j + 1, who] = ids[ends][better]
        return self._trace(rows, start, piece)

    def _trace(self, rows: np.ndarray, start: np.ndarray, piece: np.ndarray) -> list[bytes]:
        """Follow the best segmentations back, all at once; ids fill a row from its end."""
        n, length = rows.shape
        ids = np.empty((n, length), np.int32)
        at, free = np.full(n, length, np.int64), np.full(n, length, np.int64)
        live = np.arange(n)
        while len(live):
            here, begin = piece[at[live], live], start[at[live], live]
            known = here >= 0
            who = live[known]
            free[who] -= 1
            ids[who, free[who]] = here[known]
            for k, frm in zip(live[~known].tolist(), begin[~known].tolist(), strict=True):
                spelt = self.model.byte_ids[rows[k, frm : at[k]]]
                free[k] -= len(spelt)
                ids[k, free[k] : free[k] + len(spelt)] = spelt
            at[live] = begin
            live = live[begin > 0]
        raw, width = ids.tobytes(), 4 * length
        return [raw[width * k + 4 * f : width * (k + 1)] for k, f in enumerate(free.tolist())]


def decode(model: PieceModel, ids: np.ndarray) -> str:
    """The text of some ids: pieces joined, markers as spaces, the leading space off."""
    raw = b"".join(map(model.pieces.__getitem__, ids.tolist()))
    return raw[1:].decode("utf-8", "surrogatepass") if raw.startswith(b" ") else raw.decode("utf-8", "replace")


def encode(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_ids, ids, round_trip`` for each row of ``docs``.

    ``round_trip`` says whether decoding gives the text again.  Null and empty
    texts give the one piece of the leading space; very long words are encoded
    whole; repeated rows stay; an empty table gives an empty one; other columns are
    ignored.  The vocabulary is read by the driver and shipped; its size is fixed.
    """
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    schema = T.StructType(
        [
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("n_ids", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("round_trip", T.BooleanType()),
        ]
    )
    shipped = docs.sparkSession.sparkContext.broadcast(PieceModel.load(path))
    held: list[Encoder] = []

    def step(cols: dict[str, pa.Array]) -> dict[str, object]:
        if not held:
            held.append(Encoder(shipped.value))
        texts = [x or "" for x in cols["text"].to_pylist()]
        made = held[0].encode_batch(texts)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
        flat = np.concatenate(made) if made else np.zeros(0, np.int32)
        return {
            "doc_id": cols["doc_id"],
            "n_ids": np.diff(offsets).astype(np.int64),
            "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())),
            "round_trip": [held[0].decode(x) == t for x, t in zip(made, texts, strict=True)],
        }

    return map_batches(rows, step, schema)

"""A unigram vocabulary read from a SentencePiece model file.

The file's pieces and scores are taken as they are, whatever merge procedure they came from: the best segmentation is
the one with the largest sum of scores. The driver reads the file; tasks receive the pieces (some hundred kilobytes),
so executors need no file.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Character classes of the tables: code points below 382, the visible space, others.
WIDTH = 384
#: A character without a piece costs this much more than the worst piece (fixed by the published unigram model).
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    ordinary: frozenset[int]
    byte_ids: tuple[int, ...]
    unknown_id: int
    name: str

    @staticmethod
    def read(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in ids]
        ordinary = frozenset(i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
        at = {f"<0x{b:02X}>": b for b in range(256)}
        found = {at[pieces[i]]: i for i in ids if model.is_byte(i)}
        return Vocabulary(pieces, [model.get_score(i) for i in ids], ordinary,
                          tuple(found[b] for b in range(256)) if len(found) == 256 else (), model.unk_id(),
                          f"{path}:{zlib.crc32(model.serialized_model_proto())}")

    @cached_property
    def entries(self) -> dict[str, tuple[int, float]]:
        return {self.pieces[i]: (i, self.scores[i]) for i in self.ordinary}

    def spellings(self) -> tuple[dict[int, int], list[int]]:
        """The beginnings of pieces as numbered nodes, 0 the empty one: (node << 21 | character) to the next node, and the
        piece of each node or -1."""
        nodes, edges, piece_of = {"": 0}, {}, [-1]
        for piece, (i, _) in sorted(self.entries.items()):
            for n in range(1, len(piece) + 1):
                if piece[:n] not in nodes:
                    nodes[piece[:n]] = len(nodes)
                    edges[nodes[piece[:n - 1]] << 21 | ord(piece[n - 1])] = nodes[piece[:n]]
                    piece_of.append(-1)
            piece_of[nodes[piece]] = i
        return edges, piece_of

    @cached_property
    def trie(self) -> tuple[dict[int, int], list[int], list[float]]:
        """``spellings`` and the score of each node's piece, for walks character by character."""
        edges, piece_of = self.spellings()
        return edges, piece_of, [self.scores[i] if i >= 0 else 0.0 for i in piece_of]

    @cached_property
    def steps(self) -> tuple[np.ndarray, ...]:
        """The part of the trie that is spelled with common characters, its rows laid into each other: the next node of
        ``node`` by class ``c`` is ``target[base[node] + c]`` if ``owner`` of that place is the node. Classes are the code
        points below ``WIDTH``, the visible space, and anything else. Returns base, owner, target, piece of a node or -1, its score."""
        edges, piece_of = self.spellings()
        rows: dict[int, list[tuple[int, int]]] = {}
        for key, to in edges.items():
            char = key & 0x1FFFFF
            kind = WIDTH - 2 if char == ord(SPACE) else char
            if char == ord(SPACE) or kind < WIDTH - 2:
                rows.setdefault(key >> 21, []).append((kind, to))
        base = np.zeros(len(piece_of), np.int32)
        # rows with many entries first; each at the first place where its entries meet no others
        taken, used, lowest, window = np.zeros(len(edges) * 2 + 24 * WIDTH, bool), [], WIDTH, np.arange(4096)
        for node in sorted(rows, key=lambda n: -len(rows[n])):
            kinds = np.array([kind for kind, _ in rows[node]])
            lowest += int(np.argmin(taken[lowest:]))
            at = lowest - int(kinds.min())
            while len(kinds) > 1 and not (free := ~taken[(at + window)[:, None] + kinds].any(axis=1)).any():
                at += len(window)
            at += int(np.argmax(free)) if len(kinds) > 1 else 0
            base[node] = at
            taken[at + kinds] = True
            used += [(at + kind, node, to) for kind, to in rows[node]]
        owner = np.full(int(base.max()) + WIDTH, -1, np.int32)
        target = np.zeros(len(owner), np.int32)
        at, nodes, to = np.array(used).T
        owner[at], target[at] = nodes, to
        pieces = np.array(piece_of, np.int32)
        return base, owner, target, pieces, np.where(pieces >= 0, np.array(self.scores)[pieces], 0.0)

    @cached_property
    def worth(self) -> np.ndarray:
        """Score by id; of the bytes of an unknown character the first carries its score."""
        out = np.zeros(len(self.pieces))
        for i, score in self.entries.values():
            out[i] = score
        out[self.unknown_id] = self.unknown_score
        for byte, i in enumerate(self.byte_ids):
            out[i] = 0.0 if 0x80 <= byte < 0xC0 else self.unknown_score
        return out

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.entries))

    @cached_property
    def unknown_score(self) -> float:
        return min(score for _, score in self.entries.values()) - UNKNOWN_PENALTY

    @cached_property
    def pairs(self) -> frozenset[str]:
        """Neighbouring characters inside pieces. Between any other two characters every segmentation has a boundary."""
        return frozenset(p[i:i + 2] for p in self.entries for i in range(len(p) - 1))

    @cached_property
    def apart(self) -> bool:
        """Whether no piece goes on into a new run of spaces."""
        return not any(a != SPACE and b == SPACE for a, b in self.pairs)

    @cached_property
    def words(self) -> re.Pattern:
        """Parts of a text that can be segmented apart: up to each new run of spaces, if no piece crosses there."""
        return re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if self.apart else r"[\s\S]+")

    def unknown(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")] if self.byte_ids else [self.unknown_id]

    @cached_property
    def spelled(self) -> pa.Array:
        """What each id stands for in a decoded text, as bytes."""
        out = [p.encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return pa.array(out, pa.binary())


def normalised(text: str) -> str:
    """A space in front, and spaces made visible; an empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""

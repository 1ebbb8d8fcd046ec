"""A sentencepiece BPE model read for the token counter and the encoder: pieces, scores, and the chunks that merges can't cross."""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

SPACE = "▁"
#: Kinds of pieces in the model file (fixed values of its format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class PieceModel:
    """Only BPE models with byte fallback and ordinary pieces are taken; others raise ValueError."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError(f"{path}: a BPE model with byte fallback, without user-defined or unused pieces, is needed")
        if proto.trainer_spec.treat_whitespace_as_suffix or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError(f"{path}: white space must be escaped as a prefix")
        self.spec = proto.normalizer_spec
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        #: Lower is merged earlier; equal scores give equal ranks, and then the leftmost pair is first.
        self.rank = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        if missing := {c for p in self.ids for c in p} - {*self.ids}:
            raise ValueError(f"{path}: characters of pieces that are no pieces themselves: {sorted(missing)[:5]}")
        #: rank and number of the piece that two pieces (first * 2**32 + second) make.
        self.pairs = {self.ids[p[:k]] << 32 | self.ids[p[k:]]: (self.rank[p], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.eos = proto.trainer_spec.eos_id
        self.chunks = re.compile(self._pattern()).findall

    def _pattern(self) -> str:
        """Chunks of escaped text such that no piece of the vocabulary spans two of them, so each can be merged alone."""
        pairs = {(a, b) for p in self.rank for a, b in zip(p, p[1:], strict=False)}
        if any(b == SPACE != a for a, b in pairs):
            return r"(?s:.+)"
        odd = "".join(sorted({c for p in self.rank for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()}))  # such as superscript digits
        letter = re.compile(rf"[^\W\d_{odd}]").match
        if any(a != SPACE and bool(letter(a)) != bool(letter(b)) for a, b in pairs):
            return rf"{SPACE}*[^{SPACE}]+|{SPACE}+"
        return rf"{SPACE}*[^\W\d_{odd}]+|{SPACE}*(?:[^\w{SPACE}]|[\d_{odd}])+|{SPACE}+"

    def merge(self, chunk: str) -> tuple[list[int], list[int], int]:
        """Symbols, the place after each, and how many merges were made: the pair of lowest rank, leftmost of equals, again and again.

        Symbols are numbers of pieces, or -1 for a character that is none, in a doubly linked list by place; pairs wait in a heap. An entry whose pair
        has changed since is passed over.
        """
        n, pairs = len(chunk), self.pairs
        symbols = [self.ids.get(c, -1) for c in chunk]
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        heap = [(found[0], i, pair) for i in range(n - 1) if symbols[i + 1] >= 0 and (found := pairs.get(pair := symbols[i] << 32 | symbols[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] << 32 | symbols[j] != pair or before[j] != i:
                continue
            merges += 1
            symbols[i], after[i] = new, k = pairs[pair][1], after[j]
            before[j] = -2  # no more in the list
            symbols[j] = -1
            if k < n:
                before[k] = i
                if symbols[k] >= 0 and (found := pairs.get(pair := new << 32 | symbols[k])):
                    heapq.heappush(heap, (found[0], i, pair))
            if (h := before[i]) >= 0 and symbols[h] >= 0 and (found := pairs.get(pair := symbols[h] << 32 | new)):
                heapq.heappush(heap, (found[0], h, pair))
        return symbols, after, merges


@lru_cache(2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)

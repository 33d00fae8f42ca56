"""Byte-pair encoding of text with the rank file of a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
import os

import regex

#: The pattern that splits text before the merges, fixed by the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """A rank file in `folder`, else in TOKENIZERS_DIR, /opt/tokenizers or the installed package of public tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    places = [folder, os.environ.get("TOKENIZERS_DIR"), "/opt/tokenizers", os.path.dirname(spec.origin) if spec and spec.origin else None]
    found = [p for p in (os.path.join(d, name) for d in places if d) if os.path.exists(p)]
    if not found:
        raise FileNotFoundError(f"no {name} in {[d for d in places if d]}")
    return found[0]


class Encoder:
    """Token ids of texts; pieces up to 64 bytes are remembered, up to `remember` of them."""

    def __init__(self, path: str, remember: int = 200_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.remember = remember

    def piece(self, data: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, the leftmost of equals, until none is left.

        A segment tree over the byte positions holds at each live token's start the rank of its pair with the next one,
        joined with the position, so that the root is the leftmost smallest. A merge removes the right token and updates
        three leaves: the merged token's, the removed one's, and the one before, its live neighbours.
        """
        ranks, n, far = self.ranks, len(data), 1 << 62
        if n == 1:
            return [ranks[data]]
        size = 1 << (n - 1).bit_length()
        tree = [far] * (2 * size)
        for i in range(n - 1):
            r = ranks.get(data[i : i + 2])
            if r is not None:
                tree[size + i] = r << 32 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        longest = self.longest
        while tree[1] != far:
            p = tree[1] & 0xFFFFFFFF
            q = nxt[p]
            end = nxt[q]
            nxt[p] = end
            if end < n:
                prev[end] = p
            before = prev[p]
            for at, stop in ((q, -1), (p, nxt[end] if end < n else -1), (before, end)):
                if at < 0:
                    continue
                r = ranks.get(data[at:stop]) if 0 < stop - at <= longest else None
                i = size + at
                tree[i] = far if r is None else r << 32 | at
                i >>= 1
                while i:
                    a, b = tree[2 * i], tree[2 * i + 1]
                    v = a if a < b else b
                    if tree[i] == v:
                        break
                    tree[i] = v
                    i >>= 1
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : nxt[i]]])
            i = nxt[i]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text, all of it ordinary text."""
        out: list[int] = []
        known = self.known
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.piece(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(known) >= self.remember:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a rank file, loaded once."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
